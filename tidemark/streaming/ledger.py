"""A keyed table that micro-batches add to, in folders of the shared store.

Every batch writes one delta folder, partitioned by a hash of the key, and never rewrites what an earlier
batch wrote; a batch that is run again writes the same folder again. Reading merges the newest base with the
deltas after it; after some batches the finished deltas are merged into a new base.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished folders ``path/name=<number>``, ascending."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.listStatus(root) if fs.exists(root) else []:
        folder, number = status.getPath(), status.getPath().getName().removeprefix(f"{name}=")
        if number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, "_SUCCESS")):
            found.append(int(number))
    return sorted(found)


class Ledger:
    """Rows of ``schema`` by ``key``. ``merge`` turns any rows of the ledger into one row per key, in any order and grouping."""

    def __init__(
        self, spark: SparkSession, path: str, schema: str, key: str, merge: Callable[[DataFrame], DataFrame], buckets: int = 16, every: int = 20
    ):
        self.spark, self.path, self.schema, self.key, self.merge = spark, path, schema, key, merge
        self.buckets, self.every = buckets, every

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _part(self, kind: str, number: int) -> DataFrame:
        at = f"{self.path}/{kind}={number}"
        return self.spark.read.schema(f"{self.schema}, _bucket int").option("basePath", at).parquet(at)

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        rows.withColumn("_bucket", self._bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{kind}={number}")

    def parts(self, before: int | None = None) -> list[tuple[str, int]]:
        """The folders that hold everything of the batches below ``before`` (all batches when it is not given)."""
        bases = [b for b in numbered(self.spark, self.path, "base") if before is None or b < before]
        base = bases[-1:]
        deltas = [d for d in numbered(self.spark, self.path, "batch") if d > (base[0] if base else -1) and (before is None or d < before)]
        return [("base", b) for b in base] + [("batch", d) for d in deltas]

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """One row per key as of the batches below ``before``; with ``keys`` only the buckets that these fall into are read."""
        parts = [self._part(*p) for p in self.parts(before)]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, parts)
        if keys is not None:
            hit = [r[0] for r in keys.select(self._bucket()).distinct().collect()]  # as many as buckets at most
            rows = rows.filter(F.col("_bucket").isin(hit)).join(keys.select(self.key).distinct(), self.key, "left_semi")
        return self.merge(rows.drop("_bucket"))

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows of a batch. All lower batches are finished by then, so they may become a base first."""
        if sum(kind == "batch" for kind, _ in self.parts(batch_id)) >= self.every:
            self.compact(batch_id - 1)
        self._write(rows, "batch", batch_id)

    def compact(self, upto: int) -> None:
        """Merge everything up to the batch ``upto`` into a base; the folders it replaces stay until :meth:`vacuum`."""
        self._write(self.read(upto + 1), "base", upto)

    def vacuum(self) -> None:
        """Delete folders that a finished base replaces. No reader of an older state may be running."""
        keep = self.parts()
        for kind in ("base", "batch"):
            for number in numbered(self.spark, self.path, kind):
                if (kind, number) not in keep and keep and keep[0][0] == "base" and number <= keep[0][1]:
                    at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={number}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
