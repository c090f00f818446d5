"""Running totals, ranks and quantiles that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here the rows are
range-partitioned by (key, order) into blocks of about equal size and written, so a (key, block)
group holds at most one block's rows however skewed the key is. Block totals are pre-aggregated,
turned into carries over the blocks of each key, and added to the running value inside the block.
No block edge passes through the driver. Frames of few rows use one block, which is the plain
window; both ways give the same rows, null keys included. ``tidemark.blocks`` in the session sets
the number of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut, plan_bytes

_ROWS_BITS = 33  # monotonically_increasing_id keeps the partition above this bit
BLOCK_ROWS = 2_000_000
UNCOUNTED_BYTES = 4 << 20  # inputs below this are not counted first


def blocks_for(df: DataFrame) -> int:
    """Blocks that hold about ``BLOCK_ROWS`` rows each; there is no upper limit."""
    forced = df.sparkSession.conf.get("tidemark.blocks", None)
    if forced:
        return int(forced)
    return 1 if plan_bytes(df) <= UNCOUNTED_BYTES else max(1, math.ceil(df.count() / BLOCK_ROWS))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows to scan and their number of blocks; what is not small is written first, so it is computed once."""
    forced = df.sparkSession.conf.get("tidemark.blocks", None)
    if forced == "1" or not forced and plan_bytes(df) <= UNCOUNTED_BYTES:
        return df, 1
    held = cut(df)
    return held, int(forced) if forced else max(1, math.ceil(held.count() / BLOCK_ROWS))


def in_blocks(df: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """Rows in range partitions of ``keys``, written, with their partition ``_blk`` and their place ``_at`` in the whole order."""
    placed = df.repartitionByRange(blocks, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return cut(placed).withColumn("_blk", F.shiftright("_at", _ROWS_BITS))


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plain: Sequence[str] = ()) -> DataFrame:
    """Join on equal ``keys``, where null equals null, and on ``plain``, where it does not; columns as in a join by name."""
    names = {k: f"_right_{i}" for i, k in enumerate([*keys, *plain])}
    renamed = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[names[k]])
    for k in plain:
        on = on & (left[k] == renamed[names[k]])
    return left.join(renamed, on, how).drop(*names.values())


def block_edges(df: DataFrame, col: str, blocks: int | None = None) -> list[float]:
    """Cut points giving blocks of about equal row count; empty when one block is enough."""
    if blocks is None:
        blocks = blocks_for(df)
    if blocks <= 1:
        return []
    probs = [i / blocks for i in range(1, blocks)]
    return sorted(set(df.approxQuantile(col, probs, 1.0 / (4 * blocks))))


def with_block(df: DataFrame, col: str, edges: Sequence[float], out: str = "_blk") -> DataFrame:
    """Attach the block number of ``col`` (binary search in the JVM)."""
    splits = [-math.inf, *edges, math.inf]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def prefix_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Add inclusive running sums, running last non-null values and per-key totals.

    ``by`` columns may be null, which is a key of its own, and so may ``order``, nulls first. Rows that tie on the whole
    of ``order`` get an arbitrary relative order, so pre-aggregate or add a unique column.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    by, order = list(by), list(order)
    key = [F.col(c) for c in by] or [F.lit(0)]
    if blocks is None:
        df, blocks = counted(df)
    if blocks <= 1:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole = Window.partitionBy(*key)
        return df.select(
            "*",
            *[F.sum(c).over(w).alias(n) for n, c in sums.items()],
            *[F.last(c, ignorenulls=True).over(w).alias(n) for n, c in lasts.items()],
            *[F.sum(c).over(whole).alias(n) for n, c in totals.items()],
        )

    placed = in_blocks(df, [*by, *order], blocks)
    part = placed.groupBy(*by, "_blk").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), F.col("_at"))).alias(f"_l_{n}") for n, c in lasts.items()],
        *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()],
        F.count(F.lit(1)).alias("_rows"),
    )
    before = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*key)
    carry = part.select(
        *by,
        "_blk",
        *[F.sum(f"_s_{n}").over(before).alias(f"_s_{n}") for n in sums],
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_l_{n}") for n in lasts],
        *[F.sum(f"_t_{n}").over(whole).alias(f"_t_{n}") for n in totals],
    )
    joined = join_keys(placed, carry, [*by, "_blk"], "left")
    w = Window.partitionBy(*key, "_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    keep = [c for c in df.columns]
    return joined.select(
        *keep,
        *[_plus(F.sum(c).over(w), F.col(f"_s_{n}")).alias(n) for n, c in sums.items()],
        *[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_l_{n}")).alias(n) for n, c in lasts.items()],
        *[F.col(f"_t_{n}").alias(n) for n in totals],
    )


def running_vectors(df: DataFrame, by: Sequence[str], order: Sequence[str], vec: str, out: str, blocks: int | None = None) -> DataFrame:
    """Add the inclusive running sum of an array column, element by element, as one array however long it is.

    ``vec`` holds arrays of one length, none of them null. Blocks and carries are those of :func:`prefix_scan`.
    """
    by, order = list(by), list(order)
    key = [F.col(c) for c in by] or [F.lit(0)]
    if blocks is None:
        df, blocks = counted(df)

    def total(c: str):
        return Summarizer.metrics("sum").summary(F.col(c))

    def summed(frame: DataFrame, name: str) -> DataFrame:
        return frame.withColumn(name, vector_to_array(F.col(name)["sum"]))

    if blocks <= 1:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        held = df.withColumn("_vector", array_to_vector(vec))
        return summed(held.withColumn(out, total("_vector").over(w)).drop("_vector"), out)
    placed = in_blocks(df, [*by, *order], blocks).withColumn("_vector", array_to_vector(vec))
    part = summed(placed.groupBy(*by, "_blk").agg(total("_vector").alias("_own")), "_own").withColumn("_vector", array_to_vector("_own"))
    before = Window.partitionBy(*key).orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)
    upto = summed(part.withColumn("_upto", total("_vector").over(before)), "_upto")
    carry = upto.select(*by, "_blk", F.zip_with("_upto", "_own", lambda a, b: a - b).alias("_carry"))
    w = Window.partitionBy(*key, "_blk").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = join_keys(placed, carry, [*by, "_blk"], "left").withColumn(out, total("_vector").over(w))
    return summed(joined, out).withColumn(out, F.zip_with(out, "_carry", lambda a, b: a + b)).select(*df.columns, out)


def _plus(local: Column, carried: Column) -> Column:
    """Sum of two nullable parts; null only when both are."""
    return F.coalesce(local + carried, local, carried)


def counts_by_value(df: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """One row per (key, value) with its row count: the map-side reduction before any ordering."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("_n"))


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    blocks: int | None = None,
    n_out: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key, one row per key (one row in all when ``by`` is empty)."""
    by = list(by)
    known = df.filter(F.col(value).isNotNull())
    if blocks is None and not df.sparkSession.conf.get("tidemark.blocks", None) and plan_bytes(df) <= UNCOUNTED_BYTES:
        blocks = 1
    if blocks is not None and blocks <= 1:
        aggs = [F.percentile(value, F.lit(q)).alias(name) for name, q in quantiles.items()]
        if n_out:
            aggs.append(F.count(F.lit(1)).alias(n_out))
        return known.groupBy(*by).agg(*aggs)
    counts = counts_by_value(df, by, value)
    runs = prefix_scan(counts, by, [value], sums={"_cum": F.col("_n")}, totals={"_all": F.col("_n")}, blocks=blocks)
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("_all") - 1)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum")), F.col(value)))

        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        frac = F.max(pos - F.floor(pos))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    if n_out:
        aggs.append(F.max("_all").alias(n_out))
    return runs.groupBy(*by).agg(*aggs)


def quantile_table(
    df: DataFrame, by: Sequence[str], specs: Mapping[str, tuple[str, float]], blocks: int | None = None
) -> DataFrame:
    """Quantiles of several columns at once: output name -> (column, quantile), one pass over ``df``."""
    by = list(by)
    cols = list(dict.fromkeys(c for c, _ in specs.values()))
    if blocks is None and not df.sparkSession.conf.get("tidemark.blocks", None) and plan_bytes(df.select(*by, *cols)) <= UNCOUNTED_BYTES:
        blocks = 1
    if blocks is not None and blocks <= 1:
        return df.groupBy(*by).agg(*[F.percentile(c, F.lit(q)).alias(o) for o, (c, q) in specs.items()])
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    long = df.selectExpr(*by, f"stack({len(cols)}, {pairs}) AS (_col, _value)")
    qs = {f"_q{i}": q for i, q in enumerate(sorted({q for _, q in specs.values()}))}
    name_of = {q: n for n, q in qs.items()}
    tall = exact_quantiles(long, [*by, "_col"], "_value", qs, blocks)
    wide = tall.groupBy(*by).agg(
        *[F.max(F.when(F.col("_col") == c, F.col(name_of[q]))).alias(o) for o, (c, q) in specs.items()]
    )
    # groups without any value keep their row
    return join_keys(df.select(*by).distinct(), wide, by, "left") if by else wide


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, out: str, blocks: int | None = None
) -> DataFrame:
    """Tie-averaged 1-based rank of ``value`` inside each key, added to every row."""
    by = list(by)
    runs = prefix_scan(counts_by_value(df, by, value), by, [value], sums={"_cum": F.col("_n")}, blocks=blocks)
    ranks = runs.select(*by, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))
    return join_keys(df, ranks, by, "left", plain=[value])


def id_hash(id_col: str | Column, seed: int | str = 0) -> Column:
    """Seeded hash of an id as hex text; the same on every engine and for any partitioning."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat(c.cast("string"), F.lit(f":{seed}")))


def hash_unit(hex_text: Column) -> Column:
    """First eight hex digits as a number in [0, 1)."""
    return F.conv(F.substring(hex_text, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_rank(
    df: DataFrame, by: Sequence[str], hash_col: str, out: str, split: bool | None = None
) -> DataFrame:
    """1-based position by hash inside each key, ranked bucket by bucket.

    A null key or hash is a value of its own, as in a window. Hashes are uniform, so 4096 prefix buckets split any key evenly; only the bucket counts
    (4096 rows per key at most) are ordered globally.
    """
    by = list(by)
    if not (blocks_for(df) > 1 if split is None else split):
        w = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)])).orderBy(hash_col)
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    bucket = df.withColumn("_hb", F.conv(F.substring(hash_col, 1, 3), 16, 10).cast("int"))
    counts = bucket.groupBy(*by, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*([F.col(c) for c in by] or [F.lit(0)])).orderBy("_hb")
    offsets = counts.select(*by, "_hb", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    w = Window.partitionBy(*by, "_hb").orderBy(hash_col)
    return (
        join_keys(bucket, offsets, [*by, "_hb"])
        .withColumn(out, F.col("_off") + F.row_number().over(w))
        .drop("_hb", "_off")
    )


def size_rank(df: DataFrame, size: str, hash_col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based position by descending ``size`` then hash, without a global sort of the rows.

    Only the table of (size, hash bucket) counts is ordered in one place; it has 256 rows per
    distinct size at most, and a total of N rows has at most sqrt(2N) distinct group sizes.
    """
    by = list(by)
    key = [F.col(c) for c in by] or [F.lit(0)]
    marked = df.withColumn("_hb", F.substring(hash_col, 1, 2))
    counts = marked.groupBy(*by, size, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy(F.col(size).desc(), "_hb")
    offsets = counts.select(*by, size, "_hb", (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    w = Window.partitionBy(*by, size, "_hb").orderBy(hash_col)
    return (
        join_keys(marked, offsets, [*by, size, "_hb"])
        .withColumn(out, F.col("_off") + F.row_number().over(w))
        .drop("_hb", "_off")
    )
