"""Joins: as-of, defaults and medians for missing rows, coverage, semi and anti."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import prefix_scan, quantile_table


def micros(col: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (session zone must be UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.cast("timestamp"))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: str,
    left_ts: str,
    right_ts: str,
    values: Mapping[str, str],
    blocks: int | None = None,
) -> DataFrame:
    """Attach, per left row, the last right values with the same key and ``right_ts <= left_ts``.

    ``values`` maps right column to output column. Times are numeric. Both sides are reduced to
    one row per (key, time) and merged into one ordered stream, so the work is a running "last
    value" and no pair of rows is ever formed. For several right rows at one (key, time) the
    largest value tuple is kept.
    """
    cols = list(values)
    have = right.filter(F.col(by).isNotNull() & F.col(right_ts).isNotNull())
    have = have.groupBy(F.col(by), F.col(right_ts).alias("_t")).agg(F.max(F.struct(*cols)).alias("_v"))
    want = left.filter(F.col(by).isNotNull() & F.col(left_ts).isNotNull())
    want = want.select(by, F.col(left_ts).alias("_t")).distinct()
    stream = have.select(by, "_t", F.lit(0).alias("_side"), "_v").unionByName(
        want.select(by, "_t", F.lit(1).alias("_side")), allowMissingColumns=True
    )
    seen = prefix_scan(stream, [by], ["_t", "_side"], lasts={"_last": F.col("_v")}, blocks=blocks)
    found = seen.filter("_side = 1").select(
        by, F.col("_t").alias(left_ts), *[F.col(f"_last.`{c}`").alias(o) for c, o in values.items()]
    )
    return left.join(found, [by, left_ts], "left")


def left_with_default(df: DataFrame, other: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join where an absent row or value takes a declared default."""
    joined = df.join(other.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), _lit(v)) for c, v in defaults.items()})


def left_with_zero_vector(df: DataFrame, other: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """Left join of a vector column; rows without a vector get zeros of the same length."""
    joined = df.join(other.select(key, vec), key, "left")
    zero = F.array_repeat(F.lit(0.0), dim)
    return joined.withColumn(vec, F.coalesce(F.col(vec).cast("array<double>"), zero))


def left_with_median(df: DataFrame, other: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Left join where gaps take the median over the matched rows of ``df``."""
    joined = df.join(other.select(key, *cols), key, "left")
    meds = quantile_table(joined, [], {f"_med_{c}": (c, 0.5) for c in cols})
    filled = joined.crossJoin(F.broadcast(meds))  # one row of medians
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols]
    )


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row (a global aggregate, so broadcast is safe)."""
    return df.crossJoin(F.broadcast(one))


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows on the left, rows matched on the right, and the matched share."""
    marked = left.select(key).join(right.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    n, hit = F.count(F.lit(1)), F.count("_hit")
    return marked.agg(n.alias("n"), hit.alias("matched"), (hit / n).alias("share"))


def _lit(value: object) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)
