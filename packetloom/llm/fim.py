"""Fill-in-the-middle: cuts chosen by token rank, found through a piecewise-linear learned index of all token boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from packetloom.llm.common import query, slices, table

#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: White space between units (fixed values).
WHITE = [0x20, *range(0x09, 0x0E)]
END = 0x110000


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all unit boundaries of each text, 0 first, one text after another; and where each text's begin (one more at the end).

    A unit is a run of other characters with the white space before it; white space at the end of a text is one more.
    """
    points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    stops = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    points[stops] = END
    blank = np.isin(points, WHITE)
    ends = points == END
    edge = np.zeros(len(points), bool)
    edge[1:] = np.where(blank[:-1], ends[1:], blank[1:] | ends[1:]) & ~ends[:-1]
    opens = np.append(0, stops[:-1] + 1)
    edge[opens] = True
    at = np.flatnonzero(edge)
    first = np.searchsorted(at, np.append(opens, len(points)))
    return at - np.repeat(opens, np.diff(first)), first


class RankIndex:
    """From the rank of a boundary to its offset: lines that miss no offset by more than ``error``, and what they miss it by.

    Line ``k`` serves the ranks from ``first[k]`` on and predicts ``base + rise * (rank - first) // run``. ``residual`` has one
    small integer for each boundary, so prediction plus residual is exact. All arithmetic is on integers.

    Every text starts with one line through its first and last boundary, moved halfway between the largest misses on both
    sides. A line that still misses by more is halved. All lines of a level are fitted together, over all texts.
    """

    def __init__(self, offsets: np.ndarray, begins: np.ndarray, error: int):
        lo, hi = begins[:-1].astype(np.int64), begins[1:].astype(np.int64)
        self.residual = np.zeros(len(offsets), next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).max >= error))
        done = []
        while len(lo):
            count = hi - lo
            opens = np.cumsum(count) - count
            run, rise = np.maximum(count - 1, 1), offsets[hi - 1] - offsets[lo]
            step = np.arange(count.sum()) - np.repeat(opens, count)
            at = np.repeat(lo, count) + step
            miss = offsets[at] - np.repeat(offsets[lo], count) - np.repeat(rise, count) * step // np.repeat(run, count)
            least, most = np.minimum.reduceat(miss, opens), np.maximum.reduceat(miss, opens)
            shift = (least + most) // 2
            good = np.maximum(most - shift, shift - least) <= error
            done.append(np.stack([lo, offsets[lo] + shift, rise, run])[:, good])
            keep = np.repeat(good, count)
            self.residual[at[keep]] = (miss - np.repeat(shift, count))[keep]
            lo, hi = lo[~good], hi[~good]
            middle = (lo + hi) // 2
            lo, hi = np.concatenate([lo, middle]), np.concatenate([middle, hi])
        lines = np.concatenate(done, 1) if done else np.zeros((4, 0), np.int64)
        self.first, self.base, self.rise, self.run = lines[:, np.argsort(lines[0])]

    def predict(self, rank: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.first, rank, "right") - 1
        return self.base[k] + self.rise[k] * (rank - self.first[k]) // self.run[k]

    def offset(self, rank: np.ndarray) -> np.ndarray:
        return self.predict(rank) + self.residual[rank]


def rank_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", error: int = 127) -> DataFrame:
    """``doc_id, n, first, base, rise, run, residuals`` of each row of ``docs``: its index as a table, to be cut again later without its text.

    ``first, base, rise, run`` have one entry a line (see :class:`RankIndex`); ``residuals`` is a little-endian integer of
    ``len(residuals) / (n + 1)`` bytes for each boundary, one byte up to an ``error`` of 127. A null text is empty and has the one boundary 0.
    """
    schema = "doc_id long, n long, first array<long>, base array<long>, rise array<long>, run array<long>, residuals binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                offsets, begins = boundaries([t or "" for t in part.column("text").to_pylist()])
                index = RankIndex(offsets, begins, error)
                lines = np.searchsorted(index.first, begins)
                cut = pa.array(lines.astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (index.first - np.repeat(begins[:-1], np.diff(lines)), index.base, index.rise, index.run)]
                width = index.residual.itemsize
                binary = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begins * width).astype(np.int32)), pa.py_buffer(index.residual.tobytes())])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(begins) - 1), *lists, binary], ["doc_id", "n", "first", "base", "rise", "run", "residuals"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, error: int = 127) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, n_lines, output`` for each row of ``docs``.

    ``percent`` of the texts change their form; of these ``spm_percent`` put the suffix first (``spm``), the others the prefix
    (``psm``). Both choices and the two cuts, as ranks among the ``n + 1`` unit boundaries, are hashes of seed and id, so reruns
    and retried tasks agree. A rank becomes an offset by the text's rank index: predicted by its line, corrected by the residual.
    ``n_lines`` is the size of that index.

    A null text is empty. Empty texts and texts that hold a mark stay ``plain``: their output is the text, their lengths are
    null. A null id hashes as no digits. Repeated ids are cut by the same hashes, each in its own text. Other columns play no part.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, n_lines long, output string"
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h[2] % 100 >= percent), "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                texts, forms = part.column("text").to_pylist(), part.column("form").to_pylist()
                offsets, begins = boundaries(texts)
                index, n = RankIndex(offsets, begins, error), np.diff(begins) - 1
                drawn = np.sort(np.stack([part.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")]), 0)
                one, two = index.offset(drawn + begins[:-1])
                lines = np.diff(np.searchsorted(index.first, begins))
                out = []
                for t, f, a, b in zip(texts, forms, one.tolist(), two.tolist(), strict=True):
                    if f == "psm":
                        t = f"{PREFIX}{t[:a]}{SUFFIX}{t[b:]}{MIDDLE}{t[a:b]}"
                    elif f == "spm":
                        t = f"{SUFFIX}{t[b:]}{PREFIX}{t[:a]}{MIDDLE}{t[a:b]}"
                    out.append(t)
                plain = np.array([f == "plain" for f in forms])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), part.column("form"), pa.array(one, mask=plain), pa.array(two - one, mask=plain), pa.array(lines), pa.array(out, pa.string())],
                                                 ["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_lines", "output"])

    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made from. No part holds a mark, and no mark begins inside another, so the marks found are those set."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return F.when(F.col(form) == "psm", F.concat(*[parts[i] for i in at["psm"]])).when(F.col(form) == "spm", F.concat(*[parts[i] for i in at["spm"]])).otherwise(F.col(output))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


@query("op11_rank_index_fim", rf"""
with d as (select doc_id, coalesce(text, '') as t, sha256(concat('42:', doc_id)) as h from documents),
u as (select doc_id, t, regexp_extract_all(t, '{_UNIT}') as u, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from u),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(pre || mid || suf) as restored_sha256
from p""")
def op11_rank_index_fim(spark: SparkSession, d: str) -> DataFrame:
    made = fill_in_middle(table(spark, d, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
