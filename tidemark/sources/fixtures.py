"""Roles of the supplied tables: which columns play item, author, time, panel, text and vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.joins import micros
from tidemark.operators.panel import temporal_split, within_group_label
from tidemark.operators.scan import hash_unit, id_hash, prefix_scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as items: the user is the author, the event type the topic, ``props.k`` the token."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("item_id"),
        F.col("user_id").alias("author_id"),
        "ts",
        micros("ts").alias("t"),
        F.col("event_type").alias("topic"),
        "value",
        F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("bigint").alias("k"),
    )


ITEMS_SQL = """
    items AS (
        SELECT event_id AS item_id, user_id AS author_id, ts, epoch_us(ts) AS t, event_type AS topic, value,
               CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
        FROM events)"""


def score() -> Column:
    """A deterministic score in [0, 1) that leans on the outcome, so that rank metrics are not trivial."""
    noise = hash_unit(id_hash("item_id", "score"))
    return F.round(0.7 * noise + 0.3 * F.least(F.col("value") / 150.0, F.lit(1.0)), 4)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the own-norm label ``y``, a score ``p`` and the temporal split."""
    df = within_group_label(items(spark, sf_dir), "value", "author_id", "centred", "y")
    return temporal_split(df.withColumn("p", score()), "t")


SCORED_SQL = ITEMS_SQL + """,
    meds AS (SELECT author_id, quantile_cont(value, 0.5) AS med FROM items GROUP BY author_id),
    centred AS (SELECT i.*, i.value - m.med AS centred FROM items i LEFT JOIN meds m USING (author_id)),
    cutoffs AS (SELECT quantile_cont(centred, 0.5) AS cut FROM centred),
    tq AS (SELECT quantile_cont(CAST(t AS DOUBLE), 0.70) AS q1, quantile_cont(CAST(t AS DOUBLE), 0.85) AS q2 FROM items),
    scored AS (
        SELECT c.*, CASE WHEN centred > cut THEN 1 ELSE 0 END AS y,
               round(0.7::DOUBLE * (('0x' || substr(md5(item_id::VARCHAR || ':score'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)
                     + 0.3::DOUBLE * least(value / 150.0::DOUBLE, 1.0::DOUBLE), 4) AS p,
               CASE WHEN t <= q1 THEN 'train' WHEN t <= q2 THEN 'valid' ELSE 'test' END AS split
        FROM centred c, cutoffs, tq)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a cumulative panel: one row per (order, line number), three days per line number."""
    li = table(spark, sf_dir, "lineitem")
    daily = li.groupBy(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("n")).agg(
        F.sum("l_quantity").alias("play"),
        F.round(F.sum(F.col("l_discount") * 100)).alias("likes"),
        F.round(F.sum(F.col("l_tax") * 100)).alias("comments"),
        F.count(F.lit(1)).cast("double").alias("shares"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1.0)).alias("collects"),
    )
    running = prefix_scan(
        daily,
        ["item_id"],
        ["n"],
        sums={
            "play_count": F.col("play"),
            "like_count": F.col("likes"),
            "comment_count": F.col("comments"),
            "share_count": F.col("shares"),
            "collect_count": F.col("collects"),
        },
    )
    return running.select(
        "item_id",
        ((F.col("n") - 1) * 3).alias("days_since_post"),
        "play_count", "like_count", "comment_count", "share_count", "collect_count",
    )


PANEL_SQL = """
    daily AS (
        SELECT l_orderkey AS item_id, l_linenumber AS n, sum(l_quantity) AS play,
               round(sum(l_discount * 100)) AS likes, round(sum(l_tax * 100)) AS comments,
               CAST(count(*) AS DOUBLE) AS shares,
               sum(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE END) AS collects
        FROM lineitem GROUP BY ALL),
    panel AS (
        SELECT item_id, (n - 1) * 3 AS days_since_post,
               sum(play) OVER w AS play_count, sum(likes) OVER w AS like_count,
               sum(comments) OVER w AS comment_count, sum(shares) OVER w AS share_count,
               sum(collects) OVER w AS collect_count
        FROM daily WINDOW w AS (PARTITION BY item_id ORDER BY n ROWS UNBOUNDED PRECEDING))"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as items posted by customers."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("author_id"), micros("o_orderdate").alias("t")
    )


def order_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author state: money spent so far, in thousands, stands for the follower count."""
    o = table(spark, sf_dir, "orders")
    spend = o.groupBy(F.col("o_custkey").alias("author_id"), micros("o_orderdate").alias("t")).agg(
        F.sum(F.floor(F.col("o_totalprice") / 1000)).cast("double").alias("spent")
    )
    run = prefix_scan(spend, ["author_id"], ["t"], sums={"follower_count": F.col("spent")})
    return run.select("author_id", "t", "follower_count")


ORDERS_SQL = """
    order_items AS (
        SELECT o_orderkey AS item_id, o_custkey AS author_id, epoch_us(o_orderdate) AS t FROM orders),
    spend AS (
        SELECT o_custkey AS author_id, epoch_us(o_orderdate) AS t,
               CAST(sum(floor(o_totalprice / 1000)) AS DOUBLE) AS spent FROM orders GROUP BY ALL),
    author_state AS (
        SELECT author_id, t, sum(spent) OVER (PARTITION BY author_id ORDER BY t) AS follower_count FROM spend)"""


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a caption composed from their columns, marks of every kind included."""
    i = items(spark, sf_dir)
    k, v = F.col("k"), F.floor("value").cast("bigint")
    caption = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 7 == 0, F.concat(F.lit("WOW BEST "), "topic", F.lit(" ever! visit https://x.io/"), v.cast("string")))
        .when(
            k % 5 == 0,
            F.concat(F.lit("#"), "topic", F.lit(" #fún_"), k.cast("string"), F.lit(" @user."), v.cast("string"),
                     F.lit(" why bad? 🔥✨ follow me")),
        )
        .when(k % 3 == 0, F.concat(F.lit("love  this #"), "topic", F.lit("\tLink in bio "), v.cast("string"), F.lit("%")))
        .otherwise(F.concat("topic", F.lit(" day "), v.cast("string"), F.lit(" Дуже круто ok")))
    )
    return i.withColumn("caption", caption)


CAPTIONS_SQL = ITEMS_SQL + """,
    captions AS (
        SELECT *, CASE
            WHEN k % 11 = 0 THEN ''
            WHEN k % 7 = 0 THEN 'WOW BEST ' || topic || ' ever! visit https://x.io/' || floor(value)::BIGINT
            WHEN k % 5 = 0 THEN '#' || topic || ' #fún_' || k || ' @user.' || floor(value)::BIGINT || ' why bad? 🔥✨ follow me'
            WHEN k % 3 = 0 THEN 'love  this #' || topic || chr(9) || 'Link in bio ' || floor(value)::BIGINT || '%'
            ELSE topic || ' day ' || floor(value)::BIGINT || ' Дуже круто ok' END AS caption
        FROM items)"""
