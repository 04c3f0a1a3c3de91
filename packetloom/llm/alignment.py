"""Cross-tokenizer alignment: tokens of two tokenizers grouped by divide and conquer at byte offsets where both have a token end."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.llm.bpe import Bpe, _byte_names
from packetloom.llm.common import give_back, query, slices, staged, table
from packetloom.llm.packing import tokenizer_path

#: Texts are tokenised and aligned in blocks of about so many bytes; pair counts are summed inside a block first.
BLOCK_BYTES = 2 << 20
#: Both tokenizers and the search for cuts take so many bytes of a block at once: their arrays take some 100 bytes for each of them.
PIECE_BYTES = 512 << 10
#: How the ids of a block are kept on disk and in shuffles.
CODEC = "zstd"


class Tokens:
    """Ids and bytes of the tokens of both tokenizers. A gets a space before each text, as B adds one by itself."""

    def __init__(self, a_path: str, b_path: str):
        self.a = Bpe(a_path, 0)
        self.a.special = []  # their strings in a text are text
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        names, added = _byte_names(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = {i: bytes(names[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in added} | {i: t.encode() for t, i in added.items()}
        self.a_bytes = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # the bytes of all tokens one after another, where each begins, and how many it has
        self.a_spelling, self.b_spelling = ((np.frombuffer(b"".join(t), np.uint8), np.cumsum(n) - n, n) for t, n in ((self.a_bytes, self.a_size), (self.b_bytes, self.b_size)))
        widest = max(len(self.a_bytes), len(self.b_bytes))
        self.kind = np.dtype("<u2" if widest <= 1 << 16 else "<u4")
        self.key = np.dtype(np.uint32 if len(self.a_bytes) * len(self.b_bytes) < 1 << 32 else np.uint64)
        # each id in decimal, followed by each of the separators: what the text form of an alignment is made of
        self.shown = [f"{i}{end}" for i in range(widest) for end in ",|;"]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text; none where the bytes of either are not those of the text behind a space."""
        flat, counts = self.a.encode([" " + t if t else "" for t in texts])
        a = [x[:-1] for x in np.split(flat, np.cumsum(counts)[:-1])] if len(texts) else []
        b = [np.array(x, np.int64) for x in self.b.encode([t or "" for t in texts], num_threads=1)] if len(texts) else []
        none = np.empty(0, np.int64)
        spelled = np.logical_and(*(self._spelled(ids, texts, *of) for ids, of in ((a, self.a_spelling), (b, self.b_spelling)))) if len(texts) else []
        for i in np.flatnonzero(~np.asarray(spelled, bool)):
            a[i] = b[i] = none
        return a, b

    @staticmethod
    def _spelled(ids: list[np.ndarray], texts: list[str | None], letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the bytes of the ids of each text are those of the text behind a space; not for null and empty texts."""
        wanted = [b" " + t.encode("utf-8", "replace") if t else b"" for t in texts]
        length = np.fromiter(map(len, wanted), np.int64, len(wanted))
        flat, counts = _flat(ids)
        same = (length > 0) & (_sums(size[flat], counts) == length)
        # texts of the right length lie at the same places on both sides
        flat = flat[np.repeat(same, counts)]
        n = size[flat]
        got = letters[np.repeat(start[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        off = np.flatnonzero(got != np.frombuffer(b"".join(w for w, s in zip(wanted, same, strict=True) if s), np.uint8))
        same[np.flatnonzero(same)[np.searchsorted(np.cumsum(length[same]), off, "right")]] = False
        return same

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])


@functools.lru_cache(1)
def load(a_path: str, b_path: str) -> Tokens:
    return Tokens(a_path, b_path)


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to the end of each group, over texts laid end to end.

    ``a_end, b_end`` are the byte offsets where tokens end; ``a_count, b_count`` the tokens of each text. Every text is an
    interval. In each interval the A end nearest to the middle that is a B end too is located by bisection among the B ends:
    the middle first, then a neighbourhood that doubles until it holds one. The interval is cut there and both halves go on;
    an interval without a cut, or with a single token on a side, is a group. All intervals of a level are searched together.
    """
    a_stop, b_stop = np.cumsum(a_count), np.cumsum(b_count)
    level = np.stack([a_stop - a_count, a_stop, b_stop - b_count, b_stop]).astype(np.int64)[:, a_count > 0]
    done = []
    while level.shape[1]:
        whole = (level[1] - level[0] < 2) | (level[3] - level[2] < 2)
        done.append(level[1::2, whole])
        level = level[:, ~whole]
        first, last = level[0], level[1] - 2  # the ends that may cut: all but the interval's own
        middle = (first + last) // 2
        at = np.full(len(middle), -1)
        open_, near, far = np.arange(len(middle)), 0, 1
        while len(open_):
            m, lo, hi = middle[open_], first[open_], last[open_]
            # new on both sides: distances near .. far - 1
            sides = [(np.maximum(lo, m - far + 1), np.minimum(m - near, hi)), (np.maximum(lo, m + max(near, 1)), np.minimum(m + far - 1, hi))]
            best = np.full(len(open_), np.iinfo(np.int64).max)
            for begin, stop in sides:
                n = np.maximum(stop - begin + 1, 0)
                if some := n.sum():
                    owner = np.repeat(np.arange(len(n)), n)
                    i = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(some)
                    j = np.searchsorted(b_end, a_end[i])
                    hit = np.flatnonzero(b_end[j] == a_end[i])  # the last B end closes the last text, so j is inside
                    np.minimum.at(best, owner[hit], np.abs(i[hit] - m[owner[hit]]) * 2 + (i[hit] > m[owner[hit]]))
            found = best < np.iinfo(np.int64).max
            at[open_[found]] = m[found] + np.where(best[found] & 1, 1, -1) * (best[found] >> 1)
            more = ~found & ((m - far >= lo) | (m + far <= hi))
            open_, near, far = open_[more], far, 2 * far
        leaf = at < 0
        done.append(level[1::2, leaf])
        level, at = level[:, ~leaf], at[~leaf] + 1
        cut = np.searchsorted(b_end, a_end[at - 1]) + 1
        # both halves side by side, so that intervals stay in order of offsets
        level = np.stack([np.stack([level[0], at], 1), np.stack([at, level[1]], 1), np.stack([level[2], cut], 1), np.stack([cut, level[3]], 1)]).reshape(4, -1)
    cuts = np.concatenate(done, 1) if done else np.zeros((2, 0), np.int64)
    return tuple(np.sort(cuts, 1))


def links(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``a, b`` of each pair of tokens whose byte ranges overlap, by a; and the number of links of each A token."""
    start = np.append(0, a_end[:-1]) if len(a_end) else a_end
    first = np.searchsorted(b_end, start, "right")
    n = np.searchsorted(b_end, a_end, "left") - first + 1
    return np.repeat(np.arange(len(n)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of the given lengths (0 included)."""
    total = np.append(0, np.cumsum(values))
    stop = np.cumsum(counts)
    return total[stop] - total[stop - counts]


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int64), *parts]).astype(np.int64), np.array([len(p) for p in parts], np.int64)


def _shown(tokens: Tokens, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, a_count: np.ndarray, b_count: np.ndarray) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids of A and of B, group by group."""
    ends = np.cumsum(a_count), np.cumsum(b_count)
    marks = [np.zeros(len(x), np.int64) for x in (a, b)]
    marks[0][a_cuts - 1], marks[1][b_cuts - 1] = 1, 2
    place = []
    for x, cuts, other, shift in ((a, a_cuts, b_cuts, 0), (b, b_cuts, a_cuts, 1)):
        size = np.diff(cuts, prepend=0)
        # the A ids of a group follow all B ids of the groups before it, its B ids all A ids up to its own
        skip = other if shift else np.append(0, other[:-1])[:len(other)]
        place.append(np.arange(len(x)) + np.repeat(skip, size))
    code = np.empty(len(a) + len(b), np.int64)
    code[place[0]], code[place[1]] = a * 3 + marks[0], b * 3 + marks[1]
    names = list(map(tokens.shown.__getitem__, code.tolist()))
    stops = (ends[0] + ends[1]).tolist()
    return ["".join(names[i:j])[:-1] for i, j in zip([0, *stops[:-1]], stops, strict=True)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or tokenizer_path("byte_bpe_50k.json"), b_path or tokenizer_path("piece_bpe_32k.model")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, a_ids, b_ids, a_ends, b_ends`` for each row of ``docs``: the ids of both tokenizers and, group by group, the
    number of A and of B tokens up to its end. Arrays are empty for a text without tokens (see :func:`alignment_counts`)."""
    paths = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(*paths)
        for whole in batches:
            for part in slices(whole, size=PIECE_BYTES):
                a, b = tokens.encode(part.column("text").to_pylist())
                (a, a_count), (b, b_count) = _flat(a), _flat(b)
                cuts = shared_cuts(*tokens.ends(a, b), a_count, b_count)
                columns = [part.column("doc_id")]
                for flat, n in ((a, a_count), (b, b_count)):
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat.astype(np.int32))))
                for cut, n in zip(cuts, (a_count, b_count), strict=True):
                    begins = np.append(0, np.cumsum(n))
                    bounds = np.searchsorted(cut, begins, "right")
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((cut - np.repeat(begins[:-1], np.diff(bounds))).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


def aligned_block(tokens: Tokens, part: pa.RecordBatch, size: int) -> tuple[list[pa.Array], bytes, np.ndarray, np.ndarray]:
    """Cells with an entry a text, ids, pairs and their counts of a block (see ``alignment_blocks``), made from pieces of about ``size`` bytes."""
    ids, cells, linked = ([], []), [], []
    for piece in slices(part, size=size):
        a, b = tokens.encode(piece.column("text").to_pylist())
        (a, a_count), (b, b_count) = _flat(a), _flat(b)
        a_end, b_end = tokens.ends(a, b)
        a_cuts, b_cuts = shared_cuts(a_end, b_end, a_count, b_count)
        digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in _shown(tokens, a, b, a_cuts, b_cuts, a_count, b_count)]
        n_groups = np.diff(np.searchsorted(a_cuts, np.append(0, np.cumsum(a_count)), "right"))
        i, j, _ = links(a_end, b_end)
        linked.append(a[i].astype(tokens.key) * tokens.key.type(len(tokens.b_bytes)) + b[j].astype(tokens.key))
        cells.append([piece.column("doc_id"), *map(pa.array, (a_count, b_count, n_groups)), pa.array(digests, pa.string())])
        for kept, found in zip(ids, (a, b), strict=True):
            kept.append(found.astype(tokens.kind))
    pairs, counts = np.unique(np.concatenate(linked), return_counts=True)
    packed = pa.compress(np.concatenate([*ids[0], *ids[1]]).tobytes(), codec=CODEC, asbytes=True)
    return [pa.concat_arrays(c) for c in zip(*cells, strict=True)], packed, pairs, counts


def alignment_blocks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligned texts, a row for each block of them; write the result before use, since a block is a matter of the task that made it.

    ``doc_ids, a_counts, b_counts, n_groups, groups`` have one entry a text (``groups`` is the digest of its alignment), ``ids``
    has all A ids and then all B ids, 16 or 32 bits each, compressed. ``pairs, counts`` are the id pairs linked in the
    block, as ``a * size of B's vocabulary + b``, and their links.
    """
    paths = _paths(a_path, b_path)
    schema = "block long, doc_ids array<long>, a_counts array<long>, b_counts array<long>, n_groups array<long>, groups array<string>, ids binary, pairs array<long>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, block = load(*paths), TaskContext.get().partitionId() << 36
        for whole in batches:
            for part in slices(whole, size=BLOCK_BYTES):
                cells, packed, pairs, counts = aligned_block(tokens, part, PIECE_BYTES)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (*cells, pa.array(pairs.astype(np.int64)), pa.array(counts.astype(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists[:5], pa.array([packed], pa.binary()), *lists[5:]], [c.split()[0] for c in schema.split(", ")])
                block += 1
                give_back()

    return _rows(docs, id_col, text_col).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, b_size: int) -> DataFrame:
    """``pair, total, best``: links of each id pair over all texts, and whether no other pair has more for its B id (ties are all best)."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    totals = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("total")).withColumn("b", F.col("pair") % b_size)
    totals = staged(totals, "pair-counts")
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for each row of ``docs``.

    ``n_links`` counts pairs of A and B token occurrences whose byte ranges overlap; a pair of ids has as its count the links that
    hold it in all texts. ``n_best`` counts links whose pair is the most frequent of its B id, ``count_sum`` adds the counts
    over the links. ``groups`` is the SHA-256 of the alignment as text (``a1,a2|b1;a3|b2,b3``), empty without tokens.

    Texts are tokenised once, into blocks whose pair counts are summed in the task. Distinct pairs of a block, not links, are
    shuffled: to be added up, and back to their block, where its links look their counts up. A pair comes at most once from a
    block, so no pair is hot.

    Null and empty texts, and texts whose tokens don't spell a space and the text (a tokenizer that rewrites it), have no tokens
    and zeros. Null and repeated ids are separate rows; repeated rows count as often as they occur. Strings of special tokens
    are plain text. Other columns play no part.
    """
    paths = _paths(a_path, b_path)
    b_size = load(*paths).b.get_piece_size()
    blocks = staged(alignment_blocks(docs, a_path, b_path, id_col, text_col), "aligned")
    scored = pair_counts(blocks, b_size)
    own = blocks.select(F.col("block").alias("home"), F.explode("pairs").alias("pair"))
    back = own.join(scored, "pair").select("home", "pair", "total", "best")
    texts = blocks.drop("pairs", "counts")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tokens, out = load(*paths), []
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, total, best = pair[order].astype(tokens.key), right.column("total").to_numpy()[order], right.column("best").to_numpy()[order]
        for row in left.to_pylist():  # one block
            a_count, b_count = (np.array(row[c], np.int64) for c in ("a_counts", "b_counts"))
            size = (a_count.sum() + b_count.sum()) * tokens.kind.itemsize
            a, b = np.split(np.frombuffer(pa.decompress(row["ids"], int(size), codec=CODEC, asbytes=True), tokens.kind), [a_count.sum()])
            i, j, n = links(*tokens.ends(a, b))
            at = np.searchsorted(pair, a[i].astype(tokens.key) * tokens.key.type(b_size) + b[j].astype(tokens.key))
            n_links = _sums(n, a_count)
            out.append(pa.Table.from_arrays([pa.array(row["doc_ids"], pa.int64()), *map(pa.array, (a_count, b_count, np.array(row["n_groups"], np.int64), n_links, _sums(best[at].astype(np.int64), n_links), _sums(total[at], n_links))),
                                             pa.array(row["groups"], pa.string())], [c.split()[0] for c in schema.split(", ")]))
        give_back()
        return pa.concat_tables(out)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    return texts.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(run, schema)


@query("op12_cut_alignment")
def op12_cut_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment_counts(table(spark, d, "documents")).withColumnRenamed("groups", "groups_sha256")
