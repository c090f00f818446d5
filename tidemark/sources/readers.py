"""Readers: pruned Parquet, typed CSV, tolerant JSON and materialise-once tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_columns(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Parquet scan that reads only the named columns."""
    return spark.read.parquet(path).select(*columns)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and declared types; ids stay text."""
    return spark.read.schema(schema).csv(path, header=True)


def read_json_scores(
    spark: SparkSession, path: str, schema: str, key: str = "item_id", multi_line: bool = True
) -> DataFrame:
    """Union of many JSON files (arrays, or one object per line): broken ones are skipped, numbers coerced, one row kept per key.

    The row from the first path wins, then the first position in the file: a file's pieces by their start,
    the rows of a piece in reading order.
    """
    declared = T.StructType.fromDDL(f"{schema}, _corrupt_record string")
    rows = (
        spark.read.schema(declared)
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .select(
            "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_pos"),
        )
        .filter(F.col("_corrupt_record").isNull() & F.col(key).isNotNull())
    )
    values = [f.name for f in declared.fields if f.name not in (key, "_corrupt_record")]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*values), F.struct("_file", "_start", "_pos")).alias("_row"))
    return best.select(key, *[F.expr(f"try_cast(_row.`{c}` AS double)").alias(c) for c in values])


def materialise_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """Return the table at ``path``; build and write it first when it is missing or ``force`` is set."""
    if force or not table_exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """True when a finished table lies at ``path`` on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; a pre-aggregated pick, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Bounded preview."""
    return df.orderBy(*order).limit(n)


def latest_status(ledger: DataFrame, key: str, order: str) -> DataFrame:
    """Last status per key of an append-only ledger."""
    return ledger.groupBy(key).agg(F.max_by("status", order).alias("status"))


def retry_set(manifest: DataFrame, ledger: DataFrame, key: str, order: str, done: Sequence[str]) -> DataFrame:
    """Manifest rows never tried, or whose last status is not final."""
    last = latest_status(ledger, key, order)
    return manifest.join(last, key, "left").filter(
        F.col("status").isNull() | ~F.col("status").isin(*done)
    )


