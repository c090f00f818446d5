"""Source and sink queries: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.panel import temporal_split
from tidemark.plans.registry import query
from tidemark.session import fresh_path
from tidemark.sources import fixtures as fx
from tidemark.sources import readers, sinks


@query("column_pruned_scan", "SELECT l_orderkey, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity >= 25 GROUP BY l_orderkey")
def column_pruned_scan(spark, d):
    li = readers.read_columns(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return li.filter("l_quantity >= 25").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"))


@query("csv_manifest", "SELECT lpad(doc_id::VARCHAR, 6, '0') AS item_id, source AS author_id, n_chars::DOUBLE AS n_chars FROM documents")
def csv_manifest(spark, d):
    """Ids with leading zeros survive because the schema says they are text."""
    path = fresh_path(spark, "manifest")
    m = fx.table(spark, d, "documents").select(
        F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("item_id"), F.col("source").alias("author_id"), "n_chars"
    )
    sinks.write_result(m, path, "csv")
    return readers.read_csv(spark, path, "item_id string, author_id string, n_chars double")


@query(
    "json_scores_union",
    "SELECT doc_id::VARCHAR AS item_id, quality::DOUBLE AS hook, CASE WHEN doc_id % 5 <> 0 THEN toxic::DOUBLE END AS clarity FROM labels",
)
def json_scores_union(spark, d):
    """Two batches of score files; the second repeats every id with other values, between broken lines."""
    path = fresh_path(spark, "scores")
    lab = fx.table(spark, d, "labels")
    item = F.col("doc_id").cast("string").alias("item_id")
    bad = F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise(F.col("toxic").cast("string"))
    lab.select(item, F.col("quality").cast("string").alias("hook"), bad.alias("clarity")).write.json(f"{path}/batch=1")
    start = F.concat(F.lit('{"item_id": "'), F.col("doc_id").cast("string"), F.lit('", "hook": '))
    again = F.concat(start, (F.col("quality") + 5).cast("string"), F.lit(', "clarity": 9}'))
    lab.select(F.explode(F.array(start, again))).write.text(f"{path}/batch=2")
    scores = readers.read_json_scores(
        spark, f"{path}/*", "item_id string, hook string, clarity string", multi_line=False
    )
    return scores.select("item_id", "hook", "clarity")


@query(
    "partitioned_output",
    "WITH " + fx.SCORED_SQL + " SELECT item_id, value, split FROM scored WHERE split = 'test'",
)
def partitioned_output(spark, d):
    path = fresh_path(spark, "splits")
    sinks.write_split(temporal_split(fx.items(spark, d), "t").select("item_id", "value", "split"), path)
    return spark.read.parquet(path).filter("split = 'test'").select("item_id", "value", F.col("split").cast("string").alias("split"))


@query("materialise_once", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def materialise_once(spark, d):
    path = fresh_path(spark, "once")
    build = lambda: fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    readers.materialise_once(spark, path, build)
    return readers.materialise_once(spark, path, build)


@query(
    "run_log_append",
    "SELECT c_mktsegment AS label, count(*) AS n, 2::BIGINT AS runs FROM customer GROUP BY c_mktsegment",
)
def run_log_append(spark, d):
    """Two runs appended to one log."""
    path = fresh_path(spark, "log")
    for run in (1, 2):
        one = fx.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"))
        sinks.append_log(one.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).groupBy("label", "n").agg(F.count("run").alias("runs"))


@query("resumable_increment", "SELECT doc_id, n_chars FROM documents")
def resumable_increment(spark, d):
    """A second run adds only what the first left out."""
    path = fresh_path(spark, "increment")
    docs = fx.table(spark, d, "documents").select("doc_id", "n_chars")
    sinks.append_log(docs.join(fx.table(spark, d, "labels"), "doc_id", "left_semi"), path)
    done = spark.read.parquet(path)
    sinks.append_log(sinks.increment(docs, done, "doc_id"), path)
    return spark.read.parquet(path)
