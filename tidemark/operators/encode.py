"""Fold-safe encodings: fitted on train rows, applied to all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import with_one_row


def target_encode(
    df: DataFrame, key: str, label: str, train: Column, out: str, leave_one_out: bool = False
) -> DataFrame:
    """Train mean of ``label`` per key; unseen keys take the train mean.

    ``leave_one_out`` takes a train row's own label out of its own encoding.
    """
    fit = df.filter(train)
    stats = fit.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(label).alias("_s"), F.count(label).alias("_n"))
    overall = fit.agg(F.avg(label).alias("_g"))
    j = with_one_row(df.join(stats, key, "left"), overall)
    s, n = F.col("_s"), F.col("_n")
    if leave_one_out:
        own = F.when(train & F.col(label).isNotNull(), 1).otherwise(0)  # an unknown label is not in the count
        s, n = s - own * F.coalesce(F.col(label), F.lit(0)), n - own
    return j.withColumn(out, F.coalesce(F.when(n > 0, s / n), F.col("_g"))).drop("_s", "_n", "_g")


def train_popularity(df: DataFrame, key: str, train: Column, out: str) -> DataFrame:
    """log1p of the key's train row count, zero for unseen keys."""
    counts = df.filter(train).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(counts, key, "left").withColumn(out, F.log1p(F.coalesce("_n", F.lit(0)))).drop("_n")


def tag_target_encode(
    df: DataFrame, key: str, tags: str, label: str, train: Column, out: str, min_uses: int = 1
) -> DataFrame:
    """Mean train rate over the row's known tags; no known tag gives the train mean.

    Rates are sums and counts, so hot tags are reduced before the shuffle; ``min_uses`` keeps
    only tags used that often in train.
    """
    tall = df.select(key, F.explode(tags).alias("_tag"), F.col(label).alias("_y"), train.alias("_train"))
    rates = (
        tall.filter("_train")
        .groupBy("_tag")
        .agg(F.avg("_y").alias("_rate"), F.count(F.lit(1)).alias("_uses"))
        .filter(F.col("_uses") >= min_uses)
    )
    known = tall.select(key, "_tag").join(rates.select("_tag", "_rate"), "_tag")
    per_row = known.groupBy(key).agg(F.avg("_rate").alias("_m"))
    overall = df.filter(train).agg(F.avg(label).alias("_g"))
    j = with_one_row(df.join(per_row, key, "left"), overall)
    return j.withColumn(out, F.coalesce("_m", "_g")).drop("_m", "_g")


def one_hot(df: DataFrame, key: str, categories: list[str], prefix: str) -> DataFrame:
    """One 0/1 column per declared category."""
    return df.withColumns(
        {f"{prefix}_{c}": F.coalesce((F.col(key) == c).cast("int"), F.lit(0)) for c in categories}
    )
