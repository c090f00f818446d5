"""Panel work: counters at a horizon, ratios, own-norm labels, splits and thresholds."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import COUNTERS, DAY_US, ENGAGEMENT, HORIZON_DAYS, MIN_ITEMS, MIN_PLAY, TEMPORAL_QUANTILES
from tidemark.operators.joins import asof_join, with_one_row
from tidemark.operators.scan import exact_quantiles, quantile_table
from tidemark.session import cut, fresh_path


def ordered_panel(panel: DataFrame, key: str, day: str, buckets: int = 64) -> DataFrame:
    """The panel written once as a table that is bucketed by item and sorted by (item, day) inside each bucket.

    Aggregations and joins by item read it without a shuffle. The files lie in the shared folder; the table's
    name lives as long as the session.
    """
    spark, name = panel.sparkSession, f"panel_{uuid.uuid4().hex}"
    # Rows of a bucket come together first, so that a bucket is few files and not one per task.
    placed = panel.repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key, day).option("path", fresh_path(spark, "panel")).saveAsTable(name)
    return spark.table(name)


def dead_columns(df: DataFrame) -> list[str]:
    """Columns that hold no value, or one and the same in every row, from one aggregate over the rows."""
    plain = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct", "variant")]
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(plain)],
        *[(F.min(c).eqNullSafe(F.max(c))).alias(f"_s{i}") for i, c in enumerate(plain)],
    ).first()
    return [c for i, c in enumerate(plain) if one["_rows"] and (one[f"_n{i}"] == 0 or one[f"_s{i}"] and one[f"_n{i}"] == one["_rows"])]


def clean_rows(df: DataFrame, views: str, author: str, dead: Sequence[str] | None = None) -> DataFrame:
    """Rows with positive views and a known author, without the dead columns (those named, or those that are found dead)."""
    kept = df.filter((F.col(views) > 0) & F.col(author).isNotNull())
    gone = dead_columns(kept) if dead is None else dead
    return kept.drop(*[c for c in gone if c not in (views, author)])


def latest_at(panel: DataFrame, key: str, day: str, horizon: int, cols: Sequence[str] = COUNTERS) -> DataFrame:
    """The whole last row with ``day <= horizon`` per item, nulls in it included."""
    last = panel.filter(F.col(day) <= horizon).groupBy(key).agg(F.max_by(F.struct(*cols), day).alias("_r"))
    return last.select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def latest_at_many(panel: DataFrame, key: str, day: str, value: str, horizons: Sequence[int]) -> DataFrame:
    """One column per horizon with the last value at or before it, in one aggregation."""
    def pick(h: int) -> Column:
        inside = F.col(day) <= h
        return F.max_by(F.struct(value), F.when(inside, F.col(day)))[value].alias(f"{value}_{h}")

    return panel.groupBy(key).agg(*[pick(h) for h in horizons])


def null_skipping_sum(cols: Sequence[str]) -> Column:
    """Sum that treats nulls as zero."""
    total = F.lit(0.0)
    for c in cols:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return total


def at_least_one(c: str | Column) -> Column:
    """Denominator guard: values below one become one, null stays null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNotNull(), F.greatest(col, F.lit(1.0)))


def breakout(views: str, followers: str) -> Column:
    return F.col(views) / at_least_one(followers)


def engagement_rate(engaged: str, views: str) -> Column:
    return F.col(engaged) / at_least_one(views)


def growth(later: str, earlier: str) -> Column:
    return (F.col(later) - F.col(earlier)) / at_least_one(earlier)


def strict_engagement_rate(engaged: Column, views: str) -> Column:
    """Engagement over views, unknown unless views are positive."""
    return F.when(F.col(views) > 0, engaged / F.col(views))


def eligible_flag(views: str = "views_at_H", followers: str = "followers_at_post", floor: int = MIN_PLAY) -> Column:
    return F.coalesce(((F.col(views) >= floor) & F.col(followers).isNotNull()).cast("int"), F.lit(0))


def eligible(df: DataFrame) -> DataFrame:
    return df.filter("elig = 1")


def centre(df: DataFrame, value: str, by: str, out: str, fit: Column | None = None) -> DataFrame:
    """Value minus its key's median; ``fit`` restricts the rows the median is taken over."""
    base = df if fit is None else df.filter(fit)
    med = exact_quantiles(base.filter(F.col(by).isNotNull()), [by], value, {"_med": 0.5})
    return df.join(med, by, "left").withColumn(out, F.col(value) - F.col("_med")).drop("_med")


def within_group_label(df: DataFrame, value: str, by: str, centred: str, label: str) -> DataFrame:
    """1 where the centred value beats the global median of centred values.

    An unknown value gives 0, and ``<label>_known`` tells it apart.
    """
    c = centre(df, value, by, centred)
    cut = exact_quantiles(c.select(centred), [], centred, {"_cut": 0.5})
    beats = F.coalesce((F.col(centred) > F.col("_cut")).cast("int"), F.lit(0))
    return with_one_row(c, cut).withColumns(
        {label: beats, f"{label}_known": F.col(centred).isNotNull().cast("int")}
    ).drop("_cut")


def temporal_split(
    df: DataFrame, ts: str, qs: Sequence[float] = TEMPORAL_QUANTILES, out: str = "split", unknown: str = "unknown"
) -> DataFrame:
    """``train`` up to the first quantile of time, ``valid`` up to the second, then ``test``."""
    cuts = exact_quantiles(df.select(ts), [], ts, {"_q1": qs[0], "_q2": qs[1]})
    split = (
        F.when(F.col(ts).isNull(), unknown)
        .when(F.col(ts) <= F.col("_q1"), "train")
        .when(F.col(ts) <= F.col("_q2"), "valid")
        .otherwise("test")
    )
    return with_one_row(df, cuts).withColumn(out, split).drop("_q1", "_q2")


def newest_split(df: DataFrame, ts: str, fraction: float, out: str = "split") -> DataFrame:
    """The newest ``fraction`` of rows is ``test``; the cut is a time value, so ties stay together."""
    cut = exact_quantiles(df.select(ts), [], ts, {"_cut": 1.0 - fraction})
    return with_one_row(df, cut).withColumn(
        out, F.when(F.col(ts) > F.col("_cut"), "test").otherwise("train")
    ).drop("_cut")


def fit_thresholds(train: DataFrame, by: str, value: str, q: float = 0.5, min_items: int = MIN_ITEMS) -> DataFrame:
    """Per-key quantile thresholds for keys with enough rows; ``(key null)`` is never a match.

    The one-row global threshold comes from :func:`global_threshold`.
    """
    t = exact_quantiles(train.filter(F.col(by).isNotNull()), [by], value, {"threshold": q}, n_out="n")
    return t.filter(F.col("n") >= min_items)


def global_threshold(train: DataFrame, value: str, q: float = 0.5) -> DataFrame:
    return exact_quantiles(train.select(value), [], value, {"global_threshold": q})


def label_by_threshold(
    df: DataFrame, by: str, value: str, thresholds: DataFrame, overall: DataFrame, label: str
) -> DataFrame:
    """Strictly above the frozen threshold of its key, else of all; unknown values give null."""
    j = with_one_row(df.join(thresholds.select(by, "threshold"), by, "left"), overall)
    j = j.withColumn("threshold", F.coalesce("threshold", "global_threshold"))
    return j.withColumn(label, (F.col(value) > F.col("threshold")).cast("int")).drop("global_threshold")


def absolute_label(df: DataFrame, value: str, q: float, out: str, fit: Column | None = None) -> DataFrame:
    """Contrast label: at or above a global quantile, no per-key norm."""
    base = df if fit is None else df.filter(fit)
    cut = exact_quantiles(base.select(value), [], value, {"_cut": q})
    return with_one_row(df, cut).withColumn(
        out, F.coalesce((F.col(value) >= F.col("_cut")).cast("int"), F.lit(0))
    ).drop("_cut")


def mean_normalise(df: DataFrame, value: str, by: str, train: Column, out: str) -> DataFrame:
    """Value minus its key's train mean; unseen keys use the global train mean."""
    fit = df.filter(train)
    means = fit.groupBy(by).agg(F.avg(value).alias("_m"))
    overall = fit.agg(F.avg(value).alias("_g"))
    j = with_one_row(df.join(means, by, "left"), overall)
    return j.withColumn(out, F.col(value) - F.coalesce("_m", "_g")).drop("_m", "_g")


def winsorise(df: DataFrame, cols: Sequence[str], train: Column, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Clip to train quantiles."""
    specs = {f"_lo_{c}": (c, lo) for c in cols} | {f"_hi_{c}": (c, hi) for c in cols}
    bounded = with_one_row(df, quantile_table(df.filter(train), [], specs))

    def clip(c: str) -> Column:
        inside = F.least(F.greatest(F.col(c), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))
        return F.when(F.col(c).isNotNull(), inside)

    return bounded.withColumns({c: clip(c) for c in cols}).drop(*specs)


def canonical(items: DataFrame, panel: DataFrame, state: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Items with horizon counters, as-of followers, own-norm labels, day-1 signals and split.

    ``items``: item_id, author_id, t (microseconds); ``panel``: item_id, days_since_post and the
    counters; ``state``: author_id, t, follower_count.
    """
    items = temporal_split(items, "t")
    counters = F.struct(*COUNTERS)
    day = F.col("days_since_post")
    both = panel.groupBy("item_id").agg(
        F.max_by(counters, F.when(day <= horizon, day)).alias("_h"),
        F.max_by(counters, F.when(day <= 1, day)).alias("_d1"),
    )

    def engaged(side: str) -> Column:
        total = null_skipping_sum([f"{side}.{c}" for c in ENGAGEMENT])
        return F.when(F.col(side).isNotNull(), total)

    df = items.join(both, "item_id", "left").select(
        *items.columns,
        F.col("_h.play_count").alias("views_at_H"),
        engaged("_h").alias("_eng"),
        F.col("_d1.play_count").alias("_p1"),
        F.col("_d1.like_count").alias("_l1"),
        engaged("_d1").alias("_e1"),
    )
    df = df.withColumn("_tH", F.col("t") + F.lit(horizon * DAY_US))
    both_times = df.select("author_id", "t").unionByName(df.select("author_id", F.col("_tH").alias("t"))).distinct()
    known = asof_join(both_times, state, "author_id", "t", "t", {"follower_count": "_f"})
    df = df.join(known.withColumnRenamed("_f", "followers_at_post"), ["author_id", "t"], "left")
    later = known.select("author_id", F.col("t").alias("_tH"), F.col("_f").alias("followers_at_H"))
    df = df.join(later, ["author_id", "_tH"], "left")
    df = df.withColumns(
        {
            "breakout": breakout("views_at_H", "followers_at_post"),
            "er": engagement_rate("_eng", "views_at_H"),
            "growth": growth("followers_at_H", "followers_at_post"),
            "elig": eligible_flag(),
            "log_play_d1": F.log1p(F.coalesce("_p1", F.lit(0.0))),
            "log_like_d1": F.log1p(F.coalesce("_l1", F.lit(0.0))),
            "er_d1": F.coalesce(F.col("_e1") / at_least_one("_p1"), F.lit(0.0)),
        }
    ).drop("_eng", "_p1", "_l1", "_e1", "_tH")
    df = cut(df)  # three passes follow: own medians, centring, global cuts
    values = ["breakout", "er", "growth", "log_play_d1"]
    df = _centre_many(df, values, "author_id")
    df = df.withColumnsRenamed(
        {"breakout_c": "breakout_wc", "er_c": "er_wc", "growth_c": "follgrow", "log_play_d1_c": "log_play_d1_vs_author"}
    )
    cuts = quantile_table(df, [], {f"_cut_{c}": (c, 0.5) for c in ("breakout_wc", "er_wc", "follgrow")})
    return with_one_row(df, cuts).withColumns(
        {
            f"y_{c}": F.coalesce((F.col(c) > F.col(f"_cut_{c}")).cast("int"), F.lit(0))
            for c in ("breakout_wc", "er_wc", "follgrow")
        }
    ).drop("_cut_breakout_wc", "_cut_er_wc", "_cut_follgrow")


def _centre_many(df: DataFrame, values: Sequence[str], by: str) -> DataFrame:
    """Own-median centring of several columns with one lookup table per key."""
    keyed = df.filter(F.col(by).isNotNull())
    meds = quantile_table(keyed, [by], {f"_m_{v}": (v, 0.5) for v in values})
    return df.join(meds, by, "left").withColumns(
        {f"{v}_c": F.col(v) - F.col(f"_m_{v}") for v in values}
    ).drop(*[f"_m_{v}" for v in values])
