"""Sinks: upserts, resumable increments, partitioned outputs, run log and report assembly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_keep_old(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows win; only unseen keys of ``new`` are added."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ledger replace: rows of ``new`` take the place of rows with the same key."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def increment(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the output yet."""
    return source.join(done.select(key), key, "left_anti")


def write_split(df: DataFrame, path: str, by: str = "split") -> None:
    """One folder per split value, so readers of one split prune the rest."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def append_log(row: DataFrame, path: str) -> None:
    """Append one run to the log table."""
    row.write.mode("append").parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result table as Parquet, CSV with a header, or JSON lines."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def assemble_report(sections: Mapping[str, DataFrame | None], template: DataFrame) -> DataFrame:
    """Result tables under one another with a ``section`` column; missing ones leave a flagged row."""
    parts = []
    for pos, (name, table) in enumerate(sections.items()):
        if table is None:
            one = template.sparkSession.range(1).select(F.lit(1).alias("missing"))
        else:
            one = table.select("*", F.lit(0).alias("missing"))
        parts.append(one.select(F.lit(pos).alias("position"), F.lit(name).alias("section"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
