"""Panel, label, as-of and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import DAY_US, ENGAGEMENT, HORIZON_DAYS
from tidemark.operators import joins as J
from tidemark.operators import panel as P
from tidemark.operators.guards import overlap
from tidemark.operators.scan import prefix_scan
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx
from tidemark.sources import readers, sinks

WITH_ITEMS = "WITH " + fx.ITEMS_SQL
WITH_SCORED = "WITH " + fx.SCORED_SQL
WITH_PANEL = "WITH " + fx.PANEL_SQL
ENG_SQL = "coalesce(like_count,0) + coalesce(comment_count,0) + coalesce(share_count,0) + coalesce(collect_count,0)"

CANONICAL_SQL = f"""
WITH {fx.PANEL_SQL}, {fx.ORDERS_SQL},
h AS (SELECT item_id, arg_max(struct_pack(p := play_count, e := {ENG_SQL}), days_since_post) AS s
      FROM panel WHERE days_since_post <= 14 GROUP BY item_id),
d AS (SELECT item_id, arg_max(struct_pack(p := play_count, l := like_count, e := {ENG_SQL}), days_since_post) AS s
      FROM panel WHERE days_since_post <= 1 GROUP BY item_id),
timed AS (SELECT *, t + 14 * 86400000000 AS t_h FROM order_items),
f0 AS (SELECT i.*, s.follower_count AS f0 FROM timed i ASOF LEFT JOIN author_state s
       ON i.author_id = s.author_id AND i.t >= s.t),
f1 AS (SELECT i.*, s.follower_count AS f1 FROM f0 i ASOF LEFT JOIN author_state s
       ON i.author_id = s.author_id AND i.t_h >= s.t),
vals AS (
    SELECT f1.item_id, f1.author_id, f1.t, h.s.p AS views, f0, f1,
           h.s.p / greatest(f0, 1) AS breakout,
           CASE WHEN h.s IS NOT NULL THEN h.s.e / greatest(h.s.p, 1) END AS er,
           (f1 - f0) / greatest(f0, 1) AS growth,
           ln(1 + coalesce(d.s.p, 0)) AS lp, ln(1 + coalesce(d.s.l, 0)) AS ll,
           coalesce(d.s.e / greatest(d.s.p, 1), 0) AS er_d1
    FROM f1 LEFT JOIN h USING (item_id) LEFT JOIN d USING (item_id)),
cen AS (
    SELECT *, breakout - quantile_cont(breakout, 0.5) OVER (PARTITION BY author_id) AS bc,
           er - quantile_cont(er, 0.5) OVER (PARTITION BY author_id) AS ec,
           growth - quantile_cont(growth, 0.5) OVER (PARTITION BY author_id) AS gc,
           lp - quantile_cont(lp, 0.5) OVER (PARTITION BY author_id) AS lc FROM vals),
g AS (SELECT quantile_cont(bc, 0.5) AS mb, quantile_cont(ec, 0.5) AS me, quantile_cont(gc, 0.5) AS mg,
             quantile_cont(t::DOUBLE, 0.70) AS q1, quantile_cont(t::DOUBLE, 0.85) AS q2 FROM cen)
SELECT item_id, author_id, views AS views_at_h, f0 AS followers_at_post,
       round(bc, 6) AS breakout_wc, round(ec, 6) AS er_wc, round(gc, 6) AS follgrow,
       CASE WHEN bc > mb THEN 1 ELSE 0 END AS y_breakout_wc,
       CASE WHEN ec > me THEN 1 ELSE 0 END AS y_er_wc,
       CASE WHEN gc > mg THEN 1 ELSE 0 END AS y_follgrow,
       CASE WHEN views >= 50 AND f0 IS NOT NULL THEN 1 ELSE 0 END AS elig,
       round(lp, 6) AS log_play_d1, round(ll, 6) AS log_like_d1, round(er_d1, 6) AS er_d1,
       round(lc, 6) AS log_play_d1_vs_author,
       CASE WHEN t <= q1 THEN 'train' WHEN t <= q2 THEN 'valid' ELSE 'test' END AS split
FROM cen, g"""


@query("canonical_frame", CANONICAL_SQL)
def canonical_frame(spark, d):
    df = P.canonical(fx.order_items(spark, d), fx.panel(spark, d), fx.order_state(spark, d))
    return df.select(
        "item_id", "author_id", F.col("views_at_H").alias("views_at_h"), "followers_at_post",
        *[F.round(c, 6).alias(c) for c in ("breakout_wc", "er_wc", "follgrow")],
        "y_breakout_wc", "y_er_wc", "y_follgrow", "elig",
        *[F.round(c, 6).alias(c) for c in ("log_play_d1", "log_like_d1", "er_d1", "log_play_d1_vs_author")],
        "split",
    )


@query(
    "within_author_label",
    WITH_SCORED + " SELECT item_id, author_id, round(centred, 6) AS centred, y, 1 AS y_known FROM scored",
)
def within_author_label(spark, d):
    df = P.within_group_label(fx.items(spark, d), "value", "author_id", "centred", "y")
    return df.select("item_id", "author_id", F.round("centred", 6).alias("centred"), "y", "y_known")


@query("temporal_split", WITH_SCORED + " SELECT split, count(*) AS n, min(t) AS first, max(t) AS last FROM scored GROUP BY split")
def temporal_split(spark, d):
    return P.temporal_split(fx.items(spark, d), "t").groupBy("split").agg(
        F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last")
    )


@query(
    "newest_split",
    WITH_ITEMS + """, c AS (SELECT quantile_cont(t::DOUBLE, 0.8) AS cut FROM items)
    SELECT CASE WHEN t > cut THEN 'test' ELSE 'train' END AS split, count(*) AS n, max(t) AS last FROM items, c GROUP BY 1""",
)
def newest_split(spark, d):
    return P.newest_split(fx.items(spark, d), "t", 0.2).groupBy("split").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query(
    "latest_at_horizon",
    WITH_PANEL + """ SELECT item_id, arg_max(play_count, days_since_post) AS play_count,
    arg_max(like_count, days_since_post) AS like_count,
    arg_max(struct_pack(c := collect_count), days_since_post).c AS collect_count
    FROM panel WHERE days_since_post <= 14 GROUP BY item_id""",
)
def latest_at_horizon(spark, d):
    return P.latest_at(fx.panel(spark, d), "item_id", "days_since_post", HORIZON_DAYS).select(
        "item_id", "play_count", "like_count", "collect_count"
    )


@query(
    "ordered_panel",
    WITH_PANEL + """ SELECT item_id, arg_max(play_count, days_since_post) AS play_count, arg_max(like_count, days_since_post) AS like_count
    FROM panel WHERE days_since_post <= 14 GROUP BY item_id""",
)
def ordered_panel(spark, d):
    """The values at the horizon, read without a shuffle from a panel that is bucketed and sorted by item."""
    panel = P.ordered_panel(fx.panel(spark, d), "item_id", "days_since_post")
    return P.latest_at(panel, "item_id", "days_since_post", HORIZON_DAYS).select("item_id", "play_count", "like_count")


DAYS = (0, 1, 2, 3, 5, 7, 14)


@query(
    "multi_horizon_wide",
    WITH_PANEL + " SELECT item_id, " + ", ".join(
        f"arg_max(play_count, days_since_post) FILTER (WHERE days_since_post <= {h}) AS play_count_{h}" for h in DAYS
    ) + " FROM panel GROUP BY item_id",
)
def multi_horizon_wide(spark, d):
    return P.latest_at_many(fx.panel(spark, d), "item_id", "days_since_post", "play_count", DAYS)


def daily_state(spark, d):
    """Author state from items: posts so far, one row per active day, stamped at the start of the day."""
    i = fx.items(spark, d)
    daily = i.groupBy("author_id", (F.floor(F.col("t") / DAY_US) * DAY_US).alias("day")).agg(F.count("*").alias("n"))
    return prefix_scan(daily, ["author_id"], ["day"], sums={"posts": F.col("n")}).select("author_id", "day", "posts")


@query(
    "asof_author_state",
    WITH_ITEMS + """, daily AS (SELECT author_id, t // 86400000000 * 86400000000 AS day, count(*) AS n FROM items GROUP BY ALL),
    state AS (SELECT author_id, day, CAST(sum(n) OVER (PARTITION BY author_id ORDER BY day) AS BIGINT) AS posts FROM daily),
    shifted AS (SELECT *, t - 2 * 86400000000 AS t2 FROM items)
    SELECT i.item_id, i.author_id, s.posts::DOUBLE AS posts FROM shifted i ASOF LEFT JOIN state s
    ON i.author_id = s.author_id AND i.t2 >= s.day""",
)
def asof_author_state(spark, d):
    shifted = fx.items(spark, d).withColumn("t2", F.col("t") - 2 * DAY_US)
    return J.asof_join(shifted, daily_state(spark, d), "author_id", "t2", "day", {"posts": "posts"}).select(
        "item_id", "author_id", F.col("posts").cast("double").alias("posts")
    )


@query(
    "ratio_metrics_eligibility",
    WITH_PANEL + f""", h AS (SELECT item_id, arg_max(struct_pack(p := play_count, e := {ENG_SQL}), days_since_post) AS s
        FROM panel WHERE days_since_post <= 14 GROUP BY item_id)
    SELECT o.o_orderkey AS item_id, s.p AS views_at_h, round(s.p / greatest(o_totalprice / 100000, 1), 6) AS breakout,
           CASE WHEN s IS NOT NULL THEN round(s.e / greatest(s.p, 1), 6) END AS er,
           CASE WHEN s.p >= 50 THEN 1 ELSE 0 END AS elig
    FROM orders o LEFT JOIN h ON o.o_orderkey = h.item_id""",
)
def ratio_metrics_eligibility(spark, d):
    return _rated(spark, d).select("item_id", "views_at_h", *[F.round(c, 6).alias(c) for c in ("breakout", "er")], "elig")


def _rated(spark, d):
    h = P.latest_at(fx.panel(spark, d), "item_id", "days_since_post", HORIZON_DAYS)
    h = h.withColumn("eng", P.null_skipping_sum(ENGAGEMENT)).withColumnRenamed("play_count", "views_at_h")
    o = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_totalprice") / 100000).alias("followers")
    )
    return o.join(h, "item_id", "left").select(
        "item_id", "views_at_h", P.breakout("views_at_h", "followers").alias("breakout"),
        P.engagement_rate("eng", "views_at_h").alias("er"), P.eligible_flag("views_at_h", "followers").alias("elig"),
    )


@query(
    "eligible_load",
    WITH_PANEL + """, h AS (SELECT item_id, arg_max(struct_pack(p := play_count), days_since_post) AS s FROM panel WHERE days_since_post <= 14 GROUP BY item_id)
    SELECT o_orderkey AS item_id, s.p AS views_at_h FROM orders JOIN h ON o_orderkey = h.item_id WHERE s.p >= 50 AND o_totalprice IS NOT NULL""",
)
def eligible_load(spark, d):
    return P.eligible(_rated(spark, d)).select("item_id", "views_at_h")


@query(
    "coverage_floor_fair",
    WITH_PANEL + f""", h AS (SELECT item_id, arg_max(struct_pack(p := play_count, e := {ENG_SQL}), days_since_post) AS s
        FROM panel WHERE days_since_post <= 14 GROUP BY item_id)
    SELECT item_id, s.p AS play_count, CASE WHEN s.p > 0 THEN round(s.e / s.p, 6) END AS er FROM h
    WHERE s.p >= 50 AND EXISTS (SELECT 1 FROM panel x WHERE x.item_id = h.item_id AND x.days_since_post <= 1)""",
)
def coverage_floor_fair(spark, d):
    panel = fx.panel(spark, d)
    h = P.latest_at(panel, "item_id", "days_since_post", HORIZON_DAYS)
    first_day = panel.filter("days_since_post <= 1").select("item_id")
    fair = h.filter("play_count >= 50").join(first_day, "item_id", "left_semi")
    er = P.strict_engagement_rate(P.null_skipping_sum(ENGAGEMENT), "play_count")
    return fair.select("item_id", "play_count", F.round(er, 6).alias("er"))


@query(
    "row_cleaning",
    "SELECT o_orderkey AS item_id, o_custkey AS author_id, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 0 AND o_custkey IS NOT NULL",
)
def row_cleaning(spark, d):
    o = fx.table(spark, d, "orders").drop("o_orderdate").withColumnsRenamed({"o_orderkey": "item_id", "o_custkey": "author_id"})
    return P.clean_rows(o.withColumn("source", F.lit("one")), "o_totalprice", "author_id", ["o_orderpriority", "source"])


@query(
    "dead_columns",
    """SELECT name FROM (VALUES ('constant', 1), ('empty', 1), ('o_custkey', 0), ('o_orderkey', 0), ('o_orderstatus', 0), ('o_totalprice', 0)) v(name, dead)
    WHERE dead = 1 AND EXISTS (FROM orders)""",
)
def dead_columns(spark, d):
    """Columns found dead: what a table of orders carries besides its own columns."""
    o = fx.table(spark, d, "orders").drop("o_orderdate", "o_orderpriority").withColumns({"constant": F.lit(7), "empty": F.lit(None).cast("string")})
    return spark.createDataFrame([(c,) for c in P.dead_columns(o)], "name string")


@query(
    "author_relative_frozen",
    WITH_SCORED + """, m AS (SELECT author_id, quantile_cont(value, 0.5) AS med2 FROM scored WHERE split = 'train' GROUP BY author_id)
    SELECT item_id, round(value - med2, 6) AS rel FROM scored LEFT JOIN m USING (author_id)""",
)
def author_relative_frozen(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    return P.centre(s, "value", "author_id", "rel", fit=F.col("split") == "train").select(
        "item_id", F.round("rel", 6).alias("rel")
    )


@query(
    "train_frozen_threshold",
    WITH_SCORED + """, tr AS (SELECT * FROM scored WHERE split = 'train'),
    th AS (SELECT author_id, quantile_cont(value, 0.5) AS thr, count(value) AS n FROM tr GROUP BY author_id HAVING count(value) >= 50),
    g AS (SELECT quantile_cont(value, 0.5) AS gthr FROM tr)
    SELECT item_id, round(coalesce(thr, gthr), 6) AS threshold, CASE WHEN value > coalesce(thr, gthr) THEN 1 ELSE 0 END AS label
    FROM scored LEFT JOIN th USING (author_id), g""",
)
def train_frozen_threshold(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    train = s.filter("split = 'train'")
    thr = P.fit_thresholds(train, "author_id", "value")
    out = P.label_by_threshold(s, "author_id", "value", thr, P.global_threshold(train, "value"), "label")
    return out.select("item_id", F.round("threshold", 6).alias("threshold"), "label")


@query(
    "absolute_labels",
    WITH_SCORED + """, q AS (SELECT quantile_cont(value, 0.7) AS a FROM scored),
    r AS (SELECT quantile_cont(value, 0.75) AS b FROM scored WHERE split = 'train')
    SELECT item_id, CASE WHEN value >= a THEN 1 ELSE 0 END AS top30, CASE WHEN value >= b THEN 1 ELSE 0 END AS top_quartile
    FROM scored, q, r""",
)
def absolute_labels(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    s = P.absolute_label(s, "value", 0.7, "top30")
    return P.absolute_label(s, "value", 0.75, "top_quartile", fit=F.col("split") == "train").select(
        "item_id", "top30", "top_quartile"
    )


@query(
    "author_mean_norm",
    WITH_SCORED + """, m AS (SELECT author_id, avg(value) AS m FROM scored WHERE split = 'train' GROUP BY author_id),
    g AS (SELECT avg(value) AS g FROM scored WHERE split = 'train')
    SELECT item_id, round(value - coalesce(m, g), 6) AS norm FROM scored LEFT JOIN m USING (author_id), g""",
)
def author_mean_norm(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    return P.mean_normalise(s, "value", "author_id", F.col("split") == "train", "norm").select(
        "item_id", F.round("norm", 6).alias("norm")
    )


@query(
    "winsorise_train",
    WITH_SCORED + """, b AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi,
        quantile_cont(k, 0.01) AS klo, quantile_cont(k, 0.99) AS khi FROM scored WHERE split = 'train')
    SELECT item_id, round(least(greatest(value, lo), hi), 6) AS value, round(least(greatest(k, klo), khi), 6) AS k FROM scored, b""",
)
def winsorise_train(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    w = P.winsorise(s, ["value", "k"], F.col("split") == "train")
    return w.select("item_id", F.round("value", 6).alias("value"), F.round(F.col("k").cast("double"), 6).alias("k"))


@query(
    "left_join_default",
    """SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, -1) AS toxic
    FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def left_join_default(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    return J.left_with_default(docs, fx.table(spark, d, "labels"), "doc_id", {"quality": 0, "toxic": -1})


@query(
    "left_join_zero_vector",
    """SELECT d.doc_id, round(coalesce(e.embedding[1]::DOUBLE, 0), 6) AS v0, CASE WHEN e.vec_id IS NULL THEN 0 ELSE 1 END AS present
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def left_join_zero_vector(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    vecs = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    j = J.left_with_zero_vector(docs, vecs, "doc_id", "embedding", 64)
    present = F.exists("embedding", lambda x: x != 0).cast("int")
    return j.select("doc_id", F.round(F.col("embedding")[0], 6).alias("v0"), present.alias("present"))


@query(
    "left_join_median",
    """WITH m AS (SELECT quantile_cont(l.toxic + d.doc_id % 7, 0.5) AS med FROM documents d JOIN labels l USING (doc_id))
    SELECT d.doc_id, coalesce(l.toxic + d.doc_id % 7, med)::DOUBLE AS dim FROM documents d LEFT JOIN labels l USING (doc_id), m""",
)
def left_join_median(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id")
    judged = fx.table(spark, d, "labels").withColumn("dim", (F.col("toxic") + F.col("doc_id") % 7).cast("double"))
    return J.left_with_median(docs, judged, "doc_id", ["dim"])


@query(
    "manifest_coverage",
    """SELECT count(*) AS n, count(e.vec_id) AS matched, round(count(e.vec_id) / count(*)::DOUBLE, 6) AS share
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id""",
)
def manifest_coverage(spark, d):
    vecs = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    c = J.coverage(fx.table(spark, d, "documents").select("doc_id"), vecs, "doc_id")
    return c.withColumn("share", F.round("share", 6))


@query("increment_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def increment_anti(spark, d):
    return sinks.increment(fx.table(spark, d, "documents"), fx.table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("semi_join_ids", "SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT vec_id FROM embeddings)")
def semi_join_ids(spark, d):
    vecs = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return fx.table(spark, d, "labels").join(vecs, "doc_id", "left_semi").select("doc_id", "quality")


@query(
    "upsert_keep_old",
    """SELECT doc_id, quality, 'old' AS origin FROM labels UNION ALL
    SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, 'new' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def upsert_keep_old(spark, d):
    old = fx.table(spark, d, "labels").select("doc_id", "quality", F.lit("old").alias("origin"))
    new = fx.table(spark, d, "documents").select(
        "doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit("new").alias("origin")
    )
    return sinks.upsert_keep_old(old, new, "doc_id")


@query(
    "ledger_replace",
    """SELECT c_custkey AS author_id, c_acctbal AS v FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey""",
)
def ledger_replace(spark, d):
    old = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("author_id"), F.col("c_acctbal").alias("v"))
    new = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("author_id")).agg(F.max("o_totalprice").alias("v"))
    return sinks.replace_by_key(old, new, ["author_id"])


LEDGER_SQL = "SELECT user_id, arg_max(event_type, ts) AS status FROM events GROUP BY user_id"


@query(
    "status_ledger",
    f"WITH l AS ({LEDGER_SQL}) SELECT status, count(*) AS n FROM l GROUP BY status",
)
def status_ledger(spark, d):
    ledger = fx.table(spark, d, "events").withColumnRenamed("event_type", "status")
    return readers.latest_status(ledger, "user_id", "ts").groupBy("status").agg(F.count("*").alias("n"))


@query(
    "retry_set",
    f"""WITH l AS ({LEDGER_SQL}) SELECT c_custkey AS user_id, status FROM customer LEFT JOIN l ON c_custkey = user_id
    WHERE status IS NULL OR status NOT IN ('purchase', 'view')""",
)
def retry_set(spark, d):
    ledger = fx.table(spark, d, "events").withColumnRenamed("event_type", "status")
    manifest = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return readers.retry_set(manifest, ledger, "user_id", "ts", ["purchase", "view"])


@query(
    "keep_first_by_key",
    """SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_suppkey, l_partkey, l_quantity)) AS l_partkey
    FROM lineitem GROUP BY ALL""",
)
def keep_first_by_key(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_suppkey", "l_partkey", "l_quantity")
    first = readers.keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_suppkey", "l_partkey", "l_quantity"])
    return first.select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    "author_overlap",
    WITH_SCORED + """ SELECT count(*) AS shared FROM (SELECT author_id FROM scored WHERE split = 'train'
    INTERSECT SELECT author_id FROM scored WHERE split = 'test')""",
)
def author_overlap(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    shared = overlap(s.filter("split = 'train'"), s.filter("split = 'test'"), "author_id")
    return shared.agg(F.count("*").alias("shared"))


@query("except_ids", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def except_ids(spark, d):
    return fx.table(spark, d, "documents").select("doc_id").exceptAll(fx.table(spark, d, "labels").select("doc_id"))


@query(
    "union_class_parts",
    """SELECT doc_id, 1 AS part FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 0 FROM labels WHERE quality = 0""",
)
def union_class_parts(spark, d):
    lab = fx.table(spark, d, "labels")
    part = lambda q: lab.filter(F.col("quality") == q).select("doc_id", F.lit(q).alias("part"))
    return part(1).unionByName(part(0))


@query(
    "report_sections",
    """SELECT 0 AS position, 'authors' AS section, c_mktsegment AS name, count(*)::DOUBLE AS n, 0 AS missing FROM customer GROUP BY c_mktsegment
    UNION ALL SELECT 1, 'languages', lang, count(*), 0 FROM documents GROUP BY lang
    UNION ALL SELECT 2, 'ensemble', NULL, NULL, 1""",
)
def report_sections(spark, d):
    authors = fx.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").cast("double").alias("n"))
    langs = fx.table(spark, d, "documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").cast("double").alias("n"))
    return sinks.assemble_report({"authors": authors, "languages": langs, "ensemble": None}, authors)


@query("head_preview", "SELECT event_id, ts::DATE::VARCHAR AS day, value FROM events ORDER BY ts, event_id LIMIT 20")
def head_preview(spark, d):
    e = readers.read_columns(spark, f"{d}/events.parquet", ["event_id", "ts", "value"])
    return readers.head(e, 20, ["ts", "event_id"]).select("event_id", F.col("ts").cast("date").cast("string").alias("day"), "value")
