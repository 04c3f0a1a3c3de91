"""Spans of windows as few aligned blocks, so that what lies inside a span is found by an equi join.

A span ``[first, last]`` is cut into blocks of ``2**level`` windows that begin at multiples of their length: two of each
level at most, some 40 for a million windows. A window lies in one block of each level. The window and a span that holds it
share exactly one block, whatever the span's length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_BLOCKS = ("flatten(transform(sequence(0, length(bin({last} - {first} + 1)) - 1), l -> filter(array("
           "if({a} < {b} and {a} & 1 = 1, struct(l as level, {a} as block), null), if({a} < {b} and {b} & 1 = 1, struct(l as level, {b} - 1 as block), null)), x -> x is not null)))")


def span_blocks(first: str, last: str) -> Column:
    """The blocks of ``[first, last]`` as an array of ``level, block``; empty where ``last < first`` or either is null.

    At each level the part that is left starts at the next and ends at the last multiple of the block length. It gives up a
    block on a side whose border is odd, since the level above can't hold that one.
    """
    first, last = f"cast({first} as bigint)", f"cast({last} as bigint)"
    cut = _BLOCKS.format(first=first, last=last, a=f"shiftright({first} + shiftleft(1L, l) - 1, l)", b=f"shiftright({last} + 1, l)")
    return F.expr(f"if({first} <= {last}, {cut}, cast(array() as array<struct<level:int,block:bigint>>))")


def in_blocks(points: DataFrame, at: str, top: Column | int) -> DataFrame:
    """``points`` once for each level up to ``top``, with ``_level, _block``: the block of that level that holds ``at``."""
    levels = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(top) if isinstance(top, int) else top)))
    return levels.withColumn("_block", F.expr(f"shiftright(cast({at} as bigint), _level)"))


def top_level(spans: DataFrame, first: str, last: str) -> Column:
    """The highest level that a span of the table can use, as a scalar subquery; 0 for an empty table."""
    longest = F.expr(f"max(if({first} <= {last}, length(bin(cast({last} as bigint) - cast({first} as bigint) + 1)) - 1, 0))")
    return spans.agg(F.coalesce(longest, F.lit(0)).cast("int").alias("top")).scalar()


def join_spans(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, first: str, last: str,
               windows: DataFrame | None = None) -> DataFrame:
    """Every point with every span of the same ``keys`` that holds its window ``at``; all columns of both sides.

    Rows with a null key, window or border match nothing. Columns of the spans must not be named like those of the points,
    the keys aside. Spans are found once for each window of a key, then joined to its points. ``windows`` has the points' keys and
    windows where a smaller table than the points does.
    """
    cut = spans.withColumn("_b", F.explode(span_blocks(first, last))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")
    occupied = (points if windows is None else windows).select(*keys, at).filter(F.col(at).isNotNull()).distinct()
    held = in_blocks(occupied, at, top_level(spans, first, last)).join(cut, [*keys, "_level", "_block"]).drop("_level", "_block")
    return points.join(held, [*keys, at])


def window_sums(spans: DataFrame, windows: DataFrame, keys: Sequence[str], at: str, first: str, last: str, values: dict[str, Column]) -> DataFrame:
    """For each of the ``windows`` (``keys, at``) the sums of ``values`` over the spans that hold it; windows in no span are left out.

    Spans are summed by block before anything is joined, so a window meets one row of each level, not the spans themselves.
    """
    cut = spans.select(*keys, F.explode(span_blocks(first, last)).alias("_b"), *[v.alias(n) for n, v in values.items()])
    blocks = cut.groupBy(*keys, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block")).agg(*[F.sum(n).alias(n) for n in values])
    marked = in_blocks(windows.select(*keys, at).filter(F.col(at).isNotNull()).distinct(), at, top_level(spans, first, last))
    return marked.join(blocks, [*keys, "_level", "_block"]).groupBy(*keys, at).agg(*[F.sum(n).alias(n) for n in values])
