"""Token momentum: recent uses of a token against its own baseline rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.constants import DAY_US
from tidemark.operators.scan import prefix_scan

RECENT_DAYS = 7
BASE_DAYS = 28


def momentum_table(
    uses: DataFrame, token: str, ts: str, recent: int = RECENT_DAYS, base: int = BASE_DAYS, blocks: int | None = None
) -> DataFrame:
    """Momentum per (token, time of use), and the token's total uses.

    Uses in [t - recent, t) against the rate of uses in [t - recent - base, t - recent). Uses are
    first counted per (token, time). Each use then emits three changes of the two counters (when it
    enters, moves and leaves), and a running sum reads both counts at any time. Sliding range
    frames would re-add the whole window for every row, which is quadratic for a hot token.
    """
    short, long = recent * DAY_US, (recent + base) * DAY_US
    counts = (
        uses.filter(F.col(token).isNotNull() & F.col(ts).isNotNull())
        .groupBy(token, F.col(ts).alias("_t"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    def change(shift: int, r: int, b: int):
        return F.struct(F.lit(shift).cast("bigint").alias("dt"), F.lit(r).alias("r"), F.lit(b).alias("b"))

    moves = F.explode(F.array(change(0, 1, 0), change(short, -1, 1), change(long, 0, -1))).alias("_m")
    deltas = counts.select(token, "_t", "_n", moves).select(
        token,
        (F.col("_t") + F.col("_m.dt")).alias("_t"),
        F.lit(1).alias("_side"),
        (F.col("_n") * F.col("_m.r")).alias("_dr"),
        (F.col("_n") * F.col("_m.b")).alias("_db"),
        F.when(F.col("_m.dt") == 0, F.col("_n")).otherwise(0).alias("_use"),
    )
    stream = deltas.unionByName(counts.select(token, "_t", F.lit(0).alias("_side")), allowMissingColumns=True)
    run = prefix_scan(
        stream, [token], ["_t", "_side"],
        sums={"_recent": F.col("_dr"), "_base": F.col("_db")}, totals={"uses": F.col("_use")}, blocks=blocks,
    )
    read = run.filter("_side = 0").select(
        token, "_t", F.coalesce("_recent", F.lit(0)).alias("_recent"), F.coalesce("_base", F.lit(0)).alias("_base"), "uses"
    )
    rate = F.col("_base") / F.lit(float(max(base, 1))) * F.lit(float(recent))
    return read.select(
        token, F.col("_t").alias(ts), "uses", (F.log1p(F.col("_recent")) - F.log1p(rate)).alias("momentum")
    )


def token_momentum(df: DataFrame, token: str, ts: str, out: str = "trend_token", **kw) -> DataFrame:
    """Momentum of the row's token at its time; tokens used once give zero."""
    m = momentum_table(df, token, ts, **kw)
    hit = F.when(F.col("uses") > 1, F.col("momentum"))
    return df.join(m, [token, ts], "left").withColumn(out, F.coalesce(hit, F.lit(0.0))).drop("uses", "momentum")


def multi_token_momentum(df: DataFrame, key: str, tokens: str, ts: str, out: str = "trend_tags", **kw) -> DataFrame:
    """Mean momentum over the row's tokens used more than once; none gives zero."""
    tall = df.select(key, ts, F.explode(tokens).alias("_token"))
    m = momentum_table(tall, "_token", ts, **kw).filter("uses > 1")
    per_row = tall.join(m, ["_token", ts]).groupBy(key).agg(F.avg("momentum").alias("_m"))
    return df.join(per_row, key, "left").withColumn(out, F.coalesce("_m", F.lit(0.0))).drop("_m")
