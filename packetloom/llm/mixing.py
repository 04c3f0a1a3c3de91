"""Mixing sources to target weights by subset-sum budget fitting over document lengths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from packetloom.functions.ordered import global_row_number
from packetloom.llm.common import join_lookup, numbered, query, staged, table, unboxed

#: White-space separated words: the size of a text.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: The dynamic program fits remaining budgets up to about so many words; proportional shares take what is above.
FIT = 1 << 16


def source_targets(sizes: DataFrame, total_share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, n_docs, target``: weighted shares of ``total_share`` of all sizes, none above ``most`` times its source.

    Excess is reshared by weight among the other sources until none is above. Sources stay a table: only sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = global_row_number(per.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source"], "_rank").drop("_null")
    nth = (F.col("_rank") - 1) % len(weights)
    per = staged(per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth + 1).cast("int"))).drop("_rank"), "sources")
    cap = F.col("source_size") * float(most)
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the water level only rises; each round fixes at least one more source, and few rounds are needed
        full = F.lit(level) * F.col("w") >= cap
        open_w, fixed = per.agg(F.sum(F.when(~full, F.col("w"))), F.sum(F.when(full, cap))).first()
        new = (total_share * total - (fixed or 0.0)) / open_w if open_w else level
        if not open_w or new <= level:
            break
        level = new
    return per.withColumn("target", F.least(F.lit(level) * F.col("w"), cap)).drop("w")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their lengths add up to ``budget``, or as near below as can be.

    Every length first gives its proportional share; single further documents, in seeded order of lengths, bring the rest
    of the budget near ``FIT``; a bounded-knapsack dynamic program over what is left fits the remaining budget.
    """
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    order = np.random.default_rng(seed).permutation(len(lengths))
    rest = budget - int((taken * lengths).sum())
    for i in order:  # shares are rounded down: one more of each length always exceeds the rest
        if rest <= FIT:
            break
        if taken[i] < counts[i] and lengths[i] <= rest:
            taken[i] += 1
            rest -= int(lengths[i])
    via = np.full(rest + 1, -1, np.int64)  # the part that first reached a sum
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    parts: list[tuple[int, int]] = []
    for i in order:
        n, left = int(lengths[i]), int(min(counts[i] - taken[i], rest // lengths[i] if lengths[i] else 0))
        k = 1
        while left > 0 and not reached[rest]:
            k = min(k, left)
            w = n * k
            if w <= rest:
                new = np.flatnonzero(reached[:rest + 1 - w] & ~reached[w:]) + w
                via[new] = len(parts)
                reached[new] = True
                parts.append((i, k))
            left -= k
            k *= 2
        if reached[rest]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = parts[via[at]]
        taken[i] += k
        at -= int(lengths[i]) * k
    return taken


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", total_share: float = 1.5, most: float = 2.0,
                weights: tuple[float, ...] = WEIGHTS, seed: int = 29, row_col: str | None = None) -> DataFrame:
    """``row, doc_id, size, source, source_size, target, copies, taken``: how often the mix takes each input row.

    A source whose target passes its size gives every document once (or more often) and the rest of its target again.
    Documents of one source and exact length are interchangeable: they are counted, the budget is fitted on the counts,
    and that many documents of each length are chosen by a seeded hash of id and row. The plan per source holds its
    distinct lengths only, which the longest document bounds.

    ``row`` numbers the input rows; with ``row_col`` it is that column. Null texts have size 0, null sources are one source (the last). Null or repeated ids are
    separate documents. Empty texts are chosen like any other length and add nothing; a source without words is not taken.
    """
    text = F.col(text_col).cast("string")
    sizes = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = staged(sizes.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "source", "size")), "sizes")
    targets = staged(source_targets(sizes, total_share, most, weights), "targets")
    shape = "source string, size long, whole long, extra long"

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        target, total = float(group["target"].iloc[0]), int(group["source_size"].iloc[0])
        whole = int(math.floor(target / total)) if total else 0
        budget = int(round(target - whole * total)) if total else 0
        extra = fit_budget(group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64), budget, seed)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "whole": whole, "extra": extra})

    counts = join_lookup(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), targets, ["source"])
    plans = staged(counts.groupBy("source").applyInPandas(plan, shape), "plans")
    placed = staged(global_row_number(sizes, ["source", "size", "draw", "doc_id", "row"], "_at"), "placed")
    begin = placed.groupBy("source", "size").agg((F.min("_at") - 1).alias("begin"))
    on = [plans["source"].eqNullSafe(begin["source"]), plans["size"] == begin["size"]]
    wanted = staged(plans.join(begin, on).select(plans["source"], plans["size"], "whole", "extra", "begin"), "wanted")
    out = join_lookup(join_lookup(placed, wanted, ["source", "size"]), targets.select("source", "source_size", "target"), ["source"])
    copies = F.col("whole") + (F.col("_at") - F.col("begin") <= F.col("extra")).cast("long")
    return out.withColumn("copies", copies).select("row", "doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` as the mix takes them: rows it doesn't take are left out, rows it takes twice appear twice.

    Rows keep their numbers on every read (see ``numbered``). Null and empty texts have no words and are chosen like any other
    length; a source without words is not taken, and an empty table gives an empty one.
    """
    held = numbered(docs, "mixing")
    own = F.col("_d").getField
    narrow = held.select("_row", own(id_col).alias("id"), own(source_col).alias("source"), own(text_col).alias("text"))
    marks = mix_sources(narrow, "id", "source", "text", row_col="_row", **options).filter("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies"))
    both = held.join(marks, "_row").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return unboxed(both)


@query("op3_source_mixing")
def op3_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    mix = mix_sources(table(spark, d, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")
