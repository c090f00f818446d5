"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import cut

#: Words of the contracts: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_ROWS_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """32 bytes that are equal for equal texts; null for null."""
    return F.unhex(F.sha2(text, 256))


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """Give every row its own number and write the rows, so that later passes see the same numbers.

    Repeated rows and repeated or null ids stay apart by this number.
    """
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def running(
    df: DataFrame, order: Sequence[Column | str], number: str = "_no", group: Sequence[str] = (), value: str | None = None,
    total: str = "_before",
) -> DataFrame:
    """Add each row's gapless number (from 0) in `order` within `group`, and the sum of `value` before it.

    Rows are range-partitioned by (group, order), sorted and written; a group may span any number of
    partitions, so no key is one task. What lies before a partition comes from a table with one row per
    (group, partition), at most groups + partitions rows. Rows equal in all of `order` get numbers in
    some order: the caller names enough columns to make such rows interchangeable. Group columns may be null.
    """
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = cut(placed).withColumn("_part", F.shiftright("_at", _ROWS_BITS))
    amount = F.lit(0).cast("long") if value is None else F.col(value).cast("long")
    totals = placed.groupBy("_part", *group).agg(F.count("*").alias("_n"), F.sum(amount).alias("_v"), F.min("_at").alias("_first"))
    back = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first",
        F.coalesce(F.sum("_n").over(back), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_v").over(back), F.lit(0)).alias("_v0"),
    )
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    # Without groups the carry table has one row per partition, so its size is known.
    joined = placed.join(carry if group else F.broadcast(carry), same)
    out = joined.withColumn(number, F.col("_at") - F.col("_first") + F.col("_n0"))
    if value is not None:
        own = Window.partitionBy("_part", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(total, F.col("_v0") + F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return out.select(*df.columns, number, *([total] if value is not None else []))


def text_batches(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most `size` rows, which bounds what a task holds of very long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (src, dst: long): rows (id, root), root the smallest id reached.

    Every round each id takes the smallest label among its neighbours, then the label of that label, so
    the number of rounds is about the logarithm of the longest path. Labels are written each round, which
    cuts lineage. Joins are on ids with one row on the label side; adaptive execution splits hot ids.
    Empty input gives no rows.
    """
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels = cut(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.col("id")).alias("root")))
    for _ in range(rounds):
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("root").alias("near"))
        best = labels.join(near, labels.id == near.src).select("id", F.col("root").alias("old"), F.least("root", "near").alias("r"))
        jump = labels.select(F.col("id").alias("r"), F.col("root").alias("far"))
        new = cut(best.join(jump, "r", "left").select("id", "old", F.least("r", F.coalesce("far", "r")).alias("root")))
        changed = new.filter("old <> root").limit(1).count()
        labels = new.select("id", "root")
        if not changed:
            return labels
    raise RuntimeError(f"components not settled after {rounds} rounds")
