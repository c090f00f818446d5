"""Folds, author splits and seeded samples: all by hashed ids, so the same rows on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import FOLDS, SEED
from tidemark.operators.joins import with_one_row
from tidemark.operators.metrics import qcut
from tidemark.operators.scan import hash_rank, id_hash, join_keys, prefix_scan, size_rank
from tidemark.session import cut


def _snake(rank: Column, k: int) -> Column:
    """Fold of a 1-based rank when folds are dealt 0…k-1, k-1…0, and so on."""
    pos = F.pmod(rank - 1, F.lit(2 * k))
    return F.when(pos < k, pos).otherwise(2 * k - 1 - pos).cast("bigint")


def fold_table(df: DataFrame, by: str, k: int = FOLDS, seed: int | str = SEED) -> DataFrame:
    """Fold per key, balanced by row count: keys in order of size are dealt in snake order; null is a key like any other."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    hashed = sizes.withColumn("_h", F.coalesce(id_hash(by, seed), F.lit("")))
    ranked = size_rank(hashed, "n", "_h", "_rank")
    return ranked.select(by, "n", _snake(F.col("_rank"), k).alias("fold"))


def group_kfold(df: DataFrame, by: str, k: int = FOLDS, seed: int | str = SEED) -> DataFrame:
    """Whole keys in one fold each."""
    return join_keys(df, fold_table(df, by, k, seed).select(by, "fold"), [by], "left")


def stratified_fold_table(
    df: DataFrame, by: str, label: str, k: int = 5, strata: int = 4, seed: int | str = SEED
) -> DataFrame:
    """Fold per key, balanced by label rate and size: the snake runs inside each band of label rate."""
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col(label).cast("double"), F.lit(0.0))).alias("rate"))
    band = F.least(F.floor(F.col("rate") * strata), F.lit(strata - 1)).cast("bigint")
    hashed = sizes.withColumns({"_h": F.coalesce(id_hash(by, seed), F.lit("")), "band": band})
    ranked = size_rank(hashed, "n", "_h", "_rank", by=["band"])
    return ranked.select(by, "n", "band", _snake(F.col("_rank"), k).alias("fold"))


def stratified_group_kfold(df: DataFrame, by: str, label: str, k: int = 5, **kw) -> DataFrame:
    return join_keys(df, stratified_fold_table(df, by, label, k, **kw).select(by, "fold"), [by], "left")


GOLDEN = 0.6180339887498949  # its multiples modulo 1 are spread evenly over every stretch
HEAVY = 32  # a group of more than 1 / (HEAVY * folds) of the rows is placed by itself


def balanced_fold_table(df: DataFrame, by: str, label: str, k: int = 5, seed: int | str = SEED) -> DataFrame:
    """Fold per key so that folds agree in size and label share, also when some keys hold much of the table.

    Heavy keys, HEAVY * k at most, are placed one by one on the fold that their label counts fit best. Folds that
    they left behind get more of the tail. Null is a key. A null label is not 1.
    """
    sizes = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("hits"))
    sizes = cut(sizes.withColumn("_h", F.coalesce(id_hash(by, seed), F.lit(""))))
    rows, hits = sizes.agg(F.sum("n"), F.sum("hits")).first()
    spark = df.sparkSession
    kind = sizes.schema[by].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"`{by}` {kind}, n bigint, fold bigint")
    edge = rows / (HEAVY * k)
    heavy = sizes.filter(F.col("n") > edge).orderBy(F.desc("n"), "_h").collect()  # fewer than HEAVY * k rows
    size, won = [0] * k, [0] * k
    placed = []
    for r in heavy:
        def worst(f: int) -> tuple:
            """How far the fold would be above its share of rows and of each label."""
            more = (size[f] + r["n"], won[f] + r["hits"], size[f] - won[f] + r["n"] - r["hits"])
            return max(x / max(t / k, 1) for x, t in zip(more, (rows, hits, rows - hits), strict=True)), size[f], f

        f = min(range(k), key=worst)
        size[f], won[f] = size[f] + r["n"], won[f] + r["hits"]
        placed.append((r[by], r["n"], f))
    table = spark.createDataFrame(placed, f"`{by}` {kind}, n bigint, fold bigint")
    # The tail, in order of label rate and size, is dealt so that any stretch of it falls to the folds in proportion to
    # the room left: a group of rate r asks r parts for the room of label 1 and 1 - r parts for that of the others.
    tail = sizes.filter(F.col("n") <= edge).withColumn("_rate", F.round(F.col("hits") / F.col("n"), 1))
    ordered = prefix_scan(tail, [], ["_rate", "n", "_h"], sums={"_rank": F.lit(1)})

    def parts(total: float, held: list[int]) -> list[float]:
        room = [max(total / k - x, 0.0) for x in held]
        return [x / sum(room) if sum(room) else 1 / k for x in room]

    ones, others = parts(hits, won), parts(rows - hits, [s - w for s, w in zip(size, won, strict=True)])
    rate, turn = F.col("_rate"), F.pmod(F.col("_rank") * F.lit(GOLDEN), F.lit(1.0))
    fold = F.lit(k - 1)
    for f in reversed(range(k - 1)):
        fold = F.when(turn < rate * sum(ones[: f + 1]) + (1 - rate) * sum(others[: f + 1]), f).otherwise(fold)
    return table.unionByName(ordered.select(by, "n", fold.cast("bigint").alias("fold")))


def grouped_folds(df: DataFrame, by: str, key: str, label: str, k: int = 5, seed: int | str = SEED) -> DataFrame:
    """Folds of whole groups, balanced by size and label; with fewer groups than folds, folds of rows balanced by label."""
    groups = df.select(by).distinct().limit(k).count()
    if groups < k:
        return stratified_kfold(df, key, label, k, seed)
    return join_keys(df, balanced_fold_table(df, by, label, k, seed).select(by, "fold"), [by], "left")


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int | str = SEED) -> DataFrame:
    """Row folds balanced by label, for data with too few groups."""
    ranked = hash_rank(df.withColumn("_h", id_hash(key, seed)), [label], "_h", "_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("bigint")).drop("_h", "_rank")


def author_split(
    df: DataFrame, by: str, fractions: Sequence[float] = (0.70, 0.85), seed: int | str = SEED
) -> DataFrame:
    """Whole authors into train, valid and test by hashed rank; the fractions are cumulative."""
    authors = df.filter(F.col(by).isNotNull()).select(by).distinct().withColumn("_h", id_hash(by, seed))
    ranked = hash_rank(authors, [], "_h", "_rank")
    total = authors.agg(F.count(F.lit(1)).alias("_n"))
    edge = [F.floor(F.lit(f) * F.col("_n")) for f in fractions]
    split = F.when(F.col("_rank") <= edge[0], "train").when(F.col("_rank") <= edge[1], "valid").otherwise("test")
    table = with_one_row(ranked, total).select(by, split.alias("split"))
    return df.join(table, by, "left")


def balanced_sample(df: DataFrame, key: str, label: str, n: int, seed: int | str = SEED) -> DataFrame:
    """Up to n / 2 rows per class, the first by hashed id."""
    ranked = hash_rank(df.withColumn("_h", id_hash(key, seed)), [label], "_h", "_rank")
    return ranked.filter(F.col("_rank") <= n // 2).drop("_h", "_rank")


def stratified_sample(df: DataFrame, key: str, strata: Sequence[str], fraction: float, seed: int | str = SEED) -> DataFrame:
    """ceil(fraction * size) rows of every stratum; null is a stratum of its own."""
    ranked = hash_rank(df.withColumn("_h", id_hash(key, seed)), strata, "_h", "_rank")
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    return (
        join_keys(ranked, sizes, list(strata))
        .filter(F.col("_rank") <= F.ceil(F.lit(fraction) * F.col("_n")))
        .drop("_h", "_rank", "_n")
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int | str = SEED) -> DataFrame:
    """n rows, the first by hashed id."""
    return df.withColumn("_h", id_hash(key, seed)).orderBy("_h").limit(n).drop("_h")


def strided_sample(df: DataFrame, key: str, step: int, cap: int, seed: int | str = SEED) -> DataFrame:
    """Every ``step``-th row in hashed order, at most ``cap``."""
    ranked = hash_rank(df.withColumn("_h", id_hash(key, seed)), [], "_h", "_rank")
    every = F.pmod(F.col("_rank") - 1, F.lit(step)) == 0
    return ranked.filter(every & (F.col("_rank") <= F.lit(step) * cap)).drop("_h", "_rank")


def ips_weights(df: DataFrame, size: str, parts: int = 5) -> DataFrame:
    """Inverse share of the row's size bucket, scaled to mean one."""
    marked = qcut(df, size, parts, "bucket")
    shares = marked.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    # sum over rows of 1 / share is rows * buckets, so the mean weight is the bucket count
    total = shares.agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_buckets"))
    weighted = with_one_row(shares, total).select("bucket", (F.col("_total") / F.col("_n") / F.col("_buckets")).alias("weight"))
    return marked.join(F.broadcast(weighted), "bucket", "left")  # one row per bucket

