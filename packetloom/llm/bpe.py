"""Batched byte-level BPE: the ids of a tokenizer file, computed for whole Arrow batches.

A batch is cut into pre-tokens with array operations, equal pre-tokens are found once by Arrow's dictionary encoding, and
only the distinct ones are merged. The vocabulary comes from the tokenizer's JSON file; texts this module does not
cover (special-token strings, unassigned code points) and files of another kind go to the ``tokenizers`` library.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from array import array

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, END, UNKNOWN = range(6)
#: Unicode White_Space (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a pre-token of its own (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
SENTINEL = 0x110000
#: A worker remembers the ids of at most so many pre-tokens that came twice in a batch; beyond it, it starts anew.
KNOWN = 200_000


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point, and of the sentinel after each text."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get((c := unicodedata.category(chr(i)))[0], UNKNOWN if c == "Cn" else OTHER) for i in range(SENTINEL)), np.uint8, SENTINEL)
    table[WHITE] = SPACE
    return np.append(table, np.uint8(END))


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the file's vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Ids of a byte-level BPE ``tokenizer.json``; ``end`` is appended after each text."""

    def __init__(self, path: str, end: int):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.end, self.known = path, end, {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        names = _byte_names()
        kind = json.dumps(spec.get("pre_tokenizer") or {})
        self.fast = spec["model"]["type"] == "BPE" and '"ByteLevel"' in kind and '"add_prefix_space": true' not in kind and spec.get("normalizer") is None
        if self.fast:
            ranks = {bytes(names[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
            merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
            order = [spec["model"]["vocab"][a + b] for a, b in merges]
            self.fast = all(x < y for x, y in zip(order, order[1:])) and {bytes([b]) for b in range(256)} <= set(ranks)
        if self.fast:
            self.core = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    @functools.cached_property
    def library(self):
        """The ``tokenizers`` library's own form, made for the first text that needs it. Where no string is special, theirs are text."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.encode_special_tokens = not self.special
        return library

    def _starts(self, points: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Where a pre-token begins. A space joins the run after it, a run of white space leaves its last one to what follows."""
        before, after = np.roll(cls, 1), np.roll(cls, -1)
        before[0], after[-1] = END, END
        blank = np.roll(points == 0x20, 1)
        blank[0] = False
        gap = cls == SPACE
        start = np.where(gap, (before != SPACE) | ((after != SPACE) & (after != END)), (cls != before) & ~blank) | (cls == END)
        quote = np.flatnonzero((points == 0x27) & start & ~gap)
        for word in CONTRACTIONS:  # a match: the next characters join the apostrophe, what follows starts anew
            n = len(word)
            at = quote[quote + n < len(points)]
            for k, ch in enumerate(word):
                at = at[points[at + 1 + k] == ord(ch)]
            start[at + 1] = False
            start[at + 1 + n] = True
        return start

    def _merged(self, words: pa.Array, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each distinct pre-token, which came ``count`` times, one after another, and their numbers. The empty one ends a text."""
        names = words.to_pylist()
        out = list(map(self.known.get, names))
        for i, ids in enumerate(out):
            if ids is None:
                w = names[i]
                out[i] = array("I", self.core.encode_single_piece(w) if w else (self.end,)).tobytes()
                if count[i] > 1:
                    self.known[w] = out[i]
        if len(self.known) > KNOWN:
            self.known.clear()
        return np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _slow(self, text: str) -> np.ndarray:
        return np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end], np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts one after another, and the number of ids of each text (its end id counts)."""
        texts = [t or "" for t in texts]
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        odd = np.array([not self.fast or any(s in t for s in self.special) for t in texts])
        parts = [np.frombuffer(("" if o else t).encode("utf-32-le", "surrogatepass"), np.uint32) for t, o in zip(texts, odd, strict=True)]
        end = np.array([SENTINEL], np.uint32)
        points = np.concatenate([x for p in parts for x in (p, end)])
        cls = _classes()[points]
        if (cls == UNKNOWN).any():
            stops = np.cumsum([len(p) + 1 for p in parts])
            odd[np.unique(np.searchsorted(stops, np.flatnonzero(cls == UNKNOWN), "right"))] = True
        start = self._starts(points, cls)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        width[cls == END] = 0
        place = np.cumsum(width) - width
        data = b"".join(t.encode("utf-8", "replace") for t, o in zip(texts, odd, strict=True) if not (o and (not self.fast or any(s in t for s in self.special))))
        at = np.flatnonzero(start)
        offsets = np.append(place[at], len(data)).astype(np.int32)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = words.indices.to_numpy()
        flat, sizes = self._merged(words.dictionary, np.bincount(which, minlength=len(words.dictionary)))
        first, n = (np.cumsum(sizes) - sizes)[which], sizes[which]
        stop = np.cumsum(n)
        ids = flat[np.repeat(first - (stop - n), n) + np.arange(stop[-1])]
        ends = stop[np.flatnonzero(cls[at] == END)]
        counts = np.diff(np.concatenate([[0], ends]))
        if odd.any():
            pieces = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd):
                pieces[i] = self._slow(texts[i])
            ids, counts = np.concatenate(pieces), np.array([len(p) for p in pieces])
        return ids, counts


@functools.lru_cache(2)
def load(path: str, end: int) -> Bpe:
    return Bpe(path, end)
