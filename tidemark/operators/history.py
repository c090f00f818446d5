"""Author history that counts only outcomes already known at post time.

An outcome of a post at time t becomes visible at t + gap. Each feature is a running total over
one merged stream per author: visible outcomes ("releases") and posts ("queries") in time order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import DAY_US, HORIZON_DAYS
from tidemark.functions.vectors import dot, unit
from tidemark.operators.joins import asof_join
from tidemark.operators.panel import at_least_one
from tidemark.operators.scan import blocks_for, prefix_scan, running_vectors

GAP_US = HORIZON_DAYS * DAY_US
CHUNK = 4096
DECAY = 0.6
DECAY_TERMS = 64  # 0.6 ** 64 is below 1e-14


def closed_window_sums(
    df: DataFrame, by: str, ts: str, values: Mapping[str, Column], gap: int = GAP_US, blocks: int | None = None
) -> DataFrame:
    """Add sums over the rows of the same key with ``prior.ts + gap <= ts`` (zero when none)."""
    known = F.col(by).isNotNull() & F.col(ts).isNotNull()
    blocks = blocks_for(df) if blocks is None else blocks
    if blocks <= 1:
        w = Window.partitionBy(by).orderBy(ts).rangeBetween(Window.unboundedPreceding, -gap)
        return df.withColumns(
            {n: F.coalesce(F.when(known, F.sum(c).over(w)), F.lit(0.0)) for n, c in values.items()}
        )
    named = df.filter(known).select(by, F.col(ts).alias("_t"), *[c.cast("double").alias(n) for n, c in values.items()])
    releases = named.withColumn("_t", F.col("_t") + F.lit(gap)).withColumn("_side", F.lit(0))
    queries = named.select(by, "_t").distinct().withColumn("_side", F.lit(1))
    stream = releases.unionByName(queries, allowMissingColumns=True)
    stream = stream.groupBy(by, "_t", "_side").agg(*[F.sum(n).alias(n) for n in values])
    run = prefix_scan(
        stream, [by], ["_t", "_side"], sums={f"_run_{n}": F.col(n) for n in values}, blocks=blocks
    )
    at = run.filter("_side = 1").select(by, F.col("_t").alias(ts), *[F.col(f"_run_{n}").alias(n) for n in values])
    return df.join(at, [by, ts], "left").withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in values})


def author_history(
    df: DataFrame, by: str, ts: str, views: str, followers: str, gap: int = GAP_US, blocks: int | None = None
) -> DataFrame:
    """Mean log breakout and mean log views of visible posts, and log of their number."""
    v = F.coalesce(F.col(views).cast("double"), F.lit(0.0))
    f = F.coalesce(F.col(followers).cast("double"), F.lit(0.0))
    sums = {
        "_hb": F.log1p(v / at_least_one(f)),
        "_hp": F.log1p(v),
        "_hn": F.lit(1.0),
    }
    s = closed_window_sums(df, by, ts, sums, gap, blocks)
    n = F.col("_hn")
    return s.withColumns(
        {
            "author_hist_breakout": F.when(n > 0, F.col("_hb") / n).otherwise(0.0),
            "author_hist_pop": F.when(n > 0, F.col("_hp") / n).otherwise(0.0),
            "author_nprior_log": F.log1p(n),
        }
    ).drop("_hb", "_hp", "_hn")


def author_recency(
    df: DataFrame, by: str, ts: str, key: str, value: str, gap: int = GAP_US, decay: float = DECAY,
    blocks: int | None = None,
) -> DataFrame:
    """Mean of the last three visible known values, decayed mean, momentum, and log days since the last post.

    Posts are numbered per author, then cut into chunks of consecutive numbers with a short
    overlap, so the row frames below never see a whole author at once.
    """
    rows = df.filter(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(by, ts, key, F.col(value).alias("_v"))
    seq = prefix_scan(rows, [by], [ts, key], sums={"_seq": F.lit(1), "_cum": F.col("_v"), "_known": F.when(F.col("_v").isNotNull(), 1).otherwise(0)}, blocks=blocks)
    chunk = F.floor((F.col("_seq") - 1) / CHUNK)
    in_tail = (F.col("_seq") - 1) % CHUNK >= CHUNK - (DECAY_TERMS - 1)
    spread = seq.withColumn("_home", chunk).withColumn(
        "_chunk", F.explode(F.when(in_tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    order = Window.partitionBy(by, "_chunk").orderBy("_seq")
    recent = F.collect_list("_v").over(order.rowsBetween(-(DECAY_TERMS - 1), 0))
    local = spread.withColumns({"_recent": recent, "_prev": F.lag(ts).over(order)}).filter("_chunk = _home")
    weighted = F.aggregate(
        "_recent",
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")),
        lambda a, x: F.struct((a["s"] * decay + x).alias("s"), (a["w"] * decay + 1.0).alias("w")),
        lambda a: F.when(a["w"] > 0, a["s"] / a["w"]),
    )
    last3 = F.slice("_recent", -F.greatest(F.lit(1), F.least(F.size("_recent"), F.lit(3))), F.lit(3))
    some = F.size("_recent") > 0  # unknown values are not collected
    mean3 = F.when(some, F.aggregate(last3, F.lit(0.0), lambda a, x: a + x) / F.size(last3))
    states = local.select(
        by,
        key,
        (F.col(ts) + F.lit(gap)).alias("_at"),
        "_seq",
        mean3.alias("_r3"),
        F.when(some, weighted).alias("_ew"),
        F.when(F.col("_known") > 0, F.col("_cum") / F.col("_known")).alias("_life"),
    )
    seen = asof_join(
        df, states, by, ts, "_at", {"_seq": "_n", "_r3": "_r3", "_ew": "_ew", "_life": "_life"}, blocks
    )
    gaps = local.select(key, ((F.col(ts) - F.col("_prev")) / F.lit(float(DAY_US))).alias("_dsl"))
    return (
        seen.join(gaps, key, "left")
        .withColumns(
            {
                "auth_recent3": F.coalesce("_r3", F.lit(0.0)),
                "auth_ewm": F.coalesce("_ew", F.lit(0.0)),
                "auth_momentum": F.coalesce(F.col("_r3") - F.col("_life"), F.lit(0.0)),
                "auth_days_since_last_log": F.log1p(F.coalesce("_dsl", F.lit(0.0))),
            }
        )
        .drop("_n", "_r3", "_ew", "_life", "_dsl")
    )


def author_fit(
    df: DataFrame, by: str, ts: str, vec: str, label: str, dim: int, gap: int = GAP_US, blocks: int | None = None
) -> DataFrame:
    """Cosine of the row's vector to the centroid of its author's visible winners, and log of their number.

    ``gap=1`` gives the strictly-earlier variant, which looks ahead of the label and is for audits only.
    """
    unit_v = df.withColumn("_u", unit(F.transform(vec, lambda x: x.cast("double"))))
    zeros = F.array_repeat(F.lit(0.0), dim)
    padded = F.slice(F.concat(F.coalesce("_u", F.array().cast("array<double>")), zeros), 1, dim)
    filled = F.transform(padded, lambda x: F.coalesce(x, F.lit(0.0)))
    known = unit_v.filter(F.col(by).isNotNull() & F.col(ts).isNotNull())
    wins = known.filter(F.col(label) == 1).select(
        by, (F.col(ts) + F.lit(gap)).alias("_t"), F.lit(0).alias("_side"), F.concat(filled, F.array(F.lit(1.0))).alias("_s")
    )
    asked = known.select(by, F.col(ts).alias("_t")).distinct()
    asked = asked.select("*", F.lit(1).alias("_side"), F.array_repeat(F.lit(0.0), dim + 1).alias("_s"))
    # The sum of the winners' vectors and, as its last element, their number: one column however wide the vectors are.
    run = running_vectors(wins.unionByName(asked), [by], ["_t", "_side"], "_s", "_sum", blocks)
    seen = run.filter("_side = 1").select(by, F.col("_t").alias(ts), "_sum")
    s = unit_v.join(seen, [by, ts], "left").withColumn("_wins", F.coalesce(F.element_at("_sum", -1), F.lit(0.0)))
    n = F.col("_wins")
    centroid = unit(F.transform(F.slice("_sum", 1, dim), lambda x: x / n))
    return s.withColumns(
        {
            "author_fit": F.when(n > 0, dot(F.col("_u"), centroid)).otherwise(0.0),
            "n_prior_wins_log": F.log1p(n),
        }
    ).select(*df.columns, "author_fit", "n_prior_wins_log")
