"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import running, with_row, word_count

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """One row per source of (source, size): source_size, weight and target.

    Sources in code point order, null last, take the weights in turn. The targets share the sum of all
    sizes by weight; none exceeds `most` times its source's size, the excess goes to the others by weight.
    Sorted by size / weight, the sources at their limit come first, and the level of the rest is what is
    left over the weight that is left. The windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(names) - 1) % len(weights)
    per = per.withColumn("weight", F.array(*map(F.lit, weights))[turn].cast("long")).withColumn("limit", F.col("source_size") * most)
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("at", F.row_number().over(by)).withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("at", "level"))
    per = per.withColumn("first", F.min(fits).over(every))
    free = F.col("at") >= F.col("first.at")
    target = F.when(free, F.col("first.level") * F.col("weight")).otherwise(F.col("limit").cast("double"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """Mix (_row, doc_id, source, size): adds source_size, target, passes (copies taken) and taken (words).

    Each source's documents queue in md5 order of doc_id, for up to `most` passes. A document finishes at
    the source's words up to and with it, divided by the source's target. All (document, pass) pairs are
    range-sorted by finish time and taken from the front while the sum of sizes stays within the sum of
    all sizes. Only whole documents are taken, so a source misses its target by about one document.

    Null or repeated doc_ids are ordinary rows; null source is its own source; documents without words
    queue at the time of the words before them. Empty input gives no rows.
    """
    targets = source_targets(rows.select("source", "size"), weights, most)
    queued = running(
        rows.withColumn("_h", F.md5(F.col("doc_id").cast("string"))), [F.asc_nulls_first("_h"), "doc_id", "size", "_row"],
        group=["source"], value="size", total="_ahead",
    )
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    queued = queued.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_no")
    turns = queued.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1)).cast("array<long>")))
    end = F.col("_pass") * F.col("source_size") + F.col("_ahead") + F.col("size")
    turns = turns.withColumn("_finish", F.when(F.col("target") > 0, end / F.col("target")).otherwise(F.col("_pass").cast("double")))
    budget = rows.agg(F.sum("size")).first()[0] or 0
    order = ["_finish", F.asc_nulls_last("source"), "_pass", F.asc_nulls_first("_h"), "doc_id", "size", "_row"]
    line = running(turns, order, value="size", total="_sum")
    took = (F.col("_sum") + F.col("size") <= F.lit(budget)).cast("long")
    return line.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")],
        F.sum(took).alias("passes"), F.sum(took * F.col("size")).alias("taken"),
    )


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """`docs` (doc_id, text, source and any others) as mixed: each row as often as the mix takes it.

    Null, empty, repeated and clashing inputs as in `mix_plan`; the columns are those of `docs`.
    """
    staged = with_row(docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count(F.col("text")).alias("size")))
    plan = mix_plan(staged.select("_row", "doc_id", "source", "size"), weights).filter("passes > 0").select("_row", "passes")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes")))
    return staged.join(plan, "_row").withColumn("time", times).select("doc.*")
