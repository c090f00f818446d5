"""Tracking queries: events replayed as snapshot streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.joins import micros
from tidemark.operators.scan import exact_quantiles
from tidemark.plans.registry import query
from tidemark.session import cut, fresh_path
from tidemark.sources import fixtures as fx
from tidemark.streaming import track as T


def snapshots(spark, d, stream=True):
    """Every user is a tracked item of one of ten authors, every event a snapshot of it."""
    schema = fx.table(spark, d, "events").schema
    src = T.snapshot_stream(spark, d, schema, "events.parquet") if stream else fx.table(spark, d, "events")
    return src.select(
        F.col("user_id").cast("string").alias("item_id"), (F.col("user_id") % 10).cast("string").alias("author"), "ts",
        F.lit(None).cast("string").alias("upload_date"), F.lit(None).cast("timestamp").alias("added_at"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("views"), (F.col("event_id") % 50).cast("double").alias("likes"),
    )


def baselines(spark, d):
    s = snapshots(spark, d, stream=False).filter("author <> '3'")
    return exact_quantiles(s, ["author"], "views", {"median_views": 0.5})


LOG_SQL = """WITH RECURSIVE ev AS (SELECT user_id AS item, user_id % 10 AS author, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN value END AS views,
      (event_id % 50)::DOUBLE AS likes FROM events),
    base AS (SELECT author, quantile_cont(views, 0.5) AS med FROM ev WHERE author <> 3 GROUP BY author),
    acc(item, t) AS (SELECT item, min(t) FROM ev GROUP BY item
      UNION ALL SELECT a.item, min(e.t) FROM acc a JOIN ev e ON e.item = a.item AND e.t >= a.t + 21600000000 GROUP BY a.item),
    st AS (SELECT item, min(t) AS start FROM ev GROUP BY item),
    snap AS (SELECT e.*, e.t - start AS age, med FROM acc JOIN ev e ON e.item = acc.item AND e.t = acc.t JOIN st ON st.item = e.item LEFT JOIN base USING (author)),
    lab AS (SELECT item, min(t) AS lt FROM snap WHERE age >= 1209600000000 AND med IS NOT NULL AND views IS NOT NULL GROUP BY item),
    d1 AS (SELECT item, arg_min(struct_pack(v := views, l := likes, a := age / 86400000000.0::DOUBLE), t) AS s FROM snap WHERE age >= 86400000000 GROUP BY item),
    note AS (SELECT item, 1 AS noted FROM snap LEFT JOIN lab USING (item) WHERE age >= 1209600000000 AND (lt IS NULL OR t < lt) AND (med IS NULL OR views IS NULL) GROUP BY item),
    tracked AS (SELECT st.item::VARCHAR AS item_id, (st.item % 10)::VARCHAR AS author, s.v AS day1_views, s.l AS day1_likes, round(s.a, 6) AS age_at_freeze,
      CASE WHEN s.a IS NULL THEN 'unknown' WHEN s.a <= 2 THEN 'ok' ELSE 'unreliable' END AS day1_validity,
      CASE WHEN lt IS NOT NULL THEN 'labeled' ELSE 'tracking' END AS status,
      CASE WHEN lt IS NOT NULL THEN (sn.views > sn.med)::INT::DOUBLE END AS label,
      CASE WHEN lt IS NULL AND noted = 1 THEN 'no_baseline' END AS note
      FROM st LEFT JOIN d1 USING (item) LEFT JOIN lab USING (item) LEFT JOIN note USING (item) LEFT JOIN snap sn ON sn.item = st.item AND sn.t = lt)"""


def tracked(spark, d):
    return T.tracked_table(T.replay(T.track_stream(snapshots(spark, d), baselines(spark, d)), "track"))


@query("day1_freeze", LOG_SQL + " SELECT item_id, day1_views, day1_likes, age_at_freeze, day1_validity FROM tracked")
def day1_freeze(spark, d):
    return tracked(spark, d).select("item_id", "day1_views", "day1_likes", F.round("age_at_freeze", 6).alias("age_at_freeze"), "day1_validity")


@query("mature_label", LOG_SQL + " SELECT item_id, author, status, label, note FROM tracked")
def mature_label(spark, d):
    return tracked(spark, d).select("item_id", "author", "status", F.col("label").cast("double").alias("label"), "note")


@query(
    "pool_status",
    LOG_SQL + """ SELECT sum((status = 'tracking')::INT)::BIGINT AS tracking, sum((status = 'labeled')::INT)::BIGINT AS labeled, sum((label = 1)::INT)::BIGINT AS hit,
    sum((label = 0)::INT)::BIGINT AS flop, (count(label) >= 25)::INT AS ready,
    CASE WHEN count(label) >= 10 AND greatest(sum((label = 1)::INT), sum((label = 0)::INT)) / count(label)::DOUBLE > 0.8 THEN 'one_class' END AS warning FROM tracked""",
)
def pool_status(spark, d):
    return T.pool_status(tracked(spark, d))


@query(
    "day1_lookup",
    LOG_SQL + """ SELECT c_custkey::VARCHAR AS item_id, day1_views AS play_count, CASE WHEN day1_views IS NOT NULL THEN coalesce(day1_likes, 0) END AS like_count
    FROM customer LEFT JOIN tracked ON item_id = c_custkey::VARCHAR""",
)
def day1_lookup(spark, d):
    keys = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"))
    return T.day1_lookup(keys, tracked(spark, d))


@query(
    "snapshot_ingest",
    "SELECT user_id::VARCHAR AS item_id, count(*) AS n, round(sum(CASE WHEN event_type <> 'error' THEN value END), 4) AS views FROM events GROUP BY user_id",
)
def snapshot_ingest(spark, d):
    table = T.replay(snapshots(spark, d), "ingest")
    return table.groupBy("item_id").agg(F.count("*").alias("n"), F.round(F.sum("views"), 4).alias("views"))


@query(
    "training_feed",
    LOG_SQL + """ SELECT item_id, author AS author_id, label AS y, 'Customer#' || lpad(item_id, 9, '0') AS "desc", 1 AS is_english, 0 AS is_ads FROM tracked WHERE label IS NOT NULL""",
)
def training_feed(spark, d):
    out, rows = fresh_path(spark, "tracked"), fresh_path(spark, "training")
    T.track_run(snapshots(spark, d), baselines(spark, d), out, fresh_path(spark, "tracked-checkpoint"))
    content = fx.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("item_id"), F.col("c_name").alias("desc"))
    T.feed_training(T.tracked_log(spark, out, stream=True), content, rows, fresh_path(spark, "training-checkpoint"))
    return spark.read.option("basePath", rows).parquet(rows).select(
        "item_id", "author_id", F.col("y").cast("double").alias("y"), "desc", F.col("is_english").cast("int").alias("is_english"),
        F.col("is_ads").cast("int").alias("is_ads"),
    )


def deliveries(spark, d, parts: int = 6, late_by: int = 2):
    """``events`` as they would arrive: in slices of time, each with a late copy of an earlier slice."""
    e = fx.table(spark, d, "events")
    lo, hi = e.select(F.min(micros("ts")), F.max(micros("ts"))).first()
    if lo is None:
        return []
    edges = [lo + (hi + 1 - lo) * i // parts for i in range(parts + 1)]
    part = [e.filter(micros("ts").between(a, b - 1)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [p if i < late_by else p.unionByName(part[i - late_by]) for i, p in enumerate(part)]


def short_items(e):
    """Every (user, event type) is an item of a few snapshots; a third have an upload date, a third the time they were added."""
    third = F.col("user_id") % 3
    return e.select(
        F.concat_ws(":", "user_id", "event_type").alias("item_id"), (F.col("user_id") % 10).cast("string").alias("author"), "ts",
        F.when(third == 0, "20231231").alias("upload_date"), F.when(third == 1, F.lit("2024-01-01").cast("timestamp")).alias("added_at"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("views"), (F.col("event_id") % 50).cast("double").alias("likes"),
    )


def short_log(spark, d) -> str:
    """A run per delivery, with a retention so short that many items return after their state is gone."""
    e = fx.table(spark, d, "events")
    src, out, checkpoint = (fresh_path(spark, n) for n in ("deliveries", "returns", "returns-checkpoint"))
    # Every micro-batch joins the baselines, so they are computed once.
    base = cut(exact_quantiles(short_items(e).filter("author <> '3'"), ["author"], "views", {"median_views": 0.5}))
    for part in deliveries(spark, d):
        part.write.mode("append").parquet(src)
        stream = short_items(T.snapshot_stream(spark, src, e.schema))
        T.track_run(stream, base, out, checkpoint, maturity_days=3, late="12 hours", retention_days=3)
    return out


RETURNS_SQL = """WITH RECURSIVE ev AS (SELECT user_id || ':' || event_type AS item, (user_id % 10)::VARCHAR AS author, epoch_us(ts) AS t, (event_id % 50)::DOUBLE AS likes,
      CASE WHEN event_id % 7 <> 0 THEN value END AS views,
      CASE user_id % 3 WHEN 0 THEN epoch_us(TIMESTAMP '2023-12-31') WHEN 1 THEN epoch_us(TIMESTAMP '2024-01-01') END AS given FROM events),
    base AS (SELECT author, quantile_cont(views, 0.5) AS med FROM ev WHERE author <> '3' GROUP BY author),
    acc(item, t) AS (SELECT item, min(t) FROM ev GROUP BY item
      UNION ALL SELECT a.item, min(e.t) FROM acc a JOIN ev e ON e.item = a.item AND e.t >= a.t + 21600000000 GROUP BY a.item),
    st AS (SELECT item, min(t) AS first, min(author) AS author, coalesce(min(given), min(t)) AS start FROM ev GROUP BY item),
    snap AS (SELECT e.*, e.t - start AS age, med FROM acc JOIN ev e ON e.item = acc.item AND e.t = acc.t JOIN st ON st.item = e.item AND e.t > st.first
      LEFT JOIN base ON base.author = e.author),
    lab AS (SELECT item, arg_min((views > med)::INT, t) AS label, min(t) AS lt FROM snap WHERE age >= 259200000000 AND med IS NOT NULL AND views IS NOT NULL GROUP BY item),
    d1 AS (SELECT item, arg_min(struct_pack(v := views, a := age / 86400000000.0::DOUBLE), t) AS s FROM snap LEFT JOIN lab USING (item)
      WHERE age >= 86400000000 AND (lt IS NULL OR t <= lt) GROUP BY item),
    note AS (SELECT DISTINCT item FROM snap LEFT JOIN lab USING (item) WHERE age >= 259200000000 AND (lt IS NULL OR t < lt) AND (med IS NULL OR views IS NULL))"""


@query(
    "tracking_returns",
    RETURNS_SQL + """ SELECT st.item AS item_id, 1 AS registered, (d1.item IS NOT NULL)::INT AS day1, (lab.item IS NOT NULL)::INT AS labelled, (note.item IS NOT NULL)::INT AS noted,
    lab.label::DOUBLE AS label, (lab.item IS NOT NULL)::INT AS training_rows FROM st LEFT JOIN d1 USING (item) LEFT JOIN lab USING (item) LEFT JOIN note USING (item)""",
)
def tracking_returns(spark, d):
    """Events and training rows per item when items return after retention and deliveries hold late copies: one of each."""
    out, rows = short_log(spark, d), fresh_path(spark, "training")
    content = short_items(fx.table(spark, d, "events")).select("item_id", F.col("author").alias("desc")).distinct()
    T.feed_training(T.tracked_log(spark, out, stream=True), content, rows, fresh_path(spark, "training-checkpoint"))
    n = lambda e: F.count(F.when(F.col("event") == e, 1)).cast("int")
    per = T.tracked_log(spark, out).groupBy("item_id").agg(
        n("registered").alias("registered"), n("day1").alias("day1"), n("label").alias("labelled"), n("no_baseline").alias("noted"),
        F.max("label").cast("double").alias("label"),
    )
    fed = spark.read.option("basePath", rows).parquet(rows).groupBy("item_id").agg(F.count("*").cast("int").alias("training_rows"))
    return per.join(fed, "item_id", "left").fillna(0, ["training_rows"])


@query(
    "age_with_fallback",
    RETURNS_SQL + " SELECT st.item AS item_id, round(s.a, 6) AS age_at_freeze, s.v AS day1_views FROM st LEFT JOIN d1 USING (item)",
)
def age_with_fallback(spark, d):
    """The age at which first-day values froze, counted from the upload date, else the time added, else the first snapshot."""
    got = T.tracked_table(T.tracked_log(spark, short_log(spark, d)))
    return got.select("item_id", F.round("age_at_freeze", 6).alias("age_at_freeze"), "day1_views")


@query(
    "pool_status_stream",
    RETURNS_SQL + """ SELECT count(*) - count(lab.item) AS tracking, count(lab.item) AS labeled, coalesce(sum((lab.label = 1)::INT), 0)::BIGINT AS hit,
    coalesce(sum((lab.label = 0)::INT), 0)::BIGINT AS flop, (count(lab.item) >= 25)::INT AS ready,
    CASE WHEN count(lab.item) >= 10 AND greatest(sum((lab.label = 1)::INT), sum((lab.label = 0)::INT)) / count(lab.item)::DOUBLE > 0.8 THEN 'one_class' END AS warning
    FROM st LEFT JOIN lab USING (item)""",
)
def pool_status_stream(spark, d):
    return T.pool_status_stream(T.tracked_log(spark, short_log(spark, d), stream=True))


@query(
    "baseline_stream",
    """WITH r AS (SELECT user_id::VARCHAR AS author, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
    SELECT author, round(quantile_cont(v, 0.5), 6) AS median_views, count(v) AS n FROM r WHERE rn <= 15 GROUP BY author HAVING count(v) >= 5""",
)
def baseline_stream(spark, d):
    """``baseline_last15`` kept by a stream, one batch per delivery."""
    e = fx.table(spark, d, "events")
    src, out, checkpoint = (fresh_path(spark, n) for n in ("deliveries", "rings", "rings-checkpoint"))
    for part in deliveries(spark, d, late_by=99):
        part.write.mode("append").parquet(src)
        items = T.snapshot_stream(spark, src, e.schema).select(
            F.col("user_id").cast("string").alias("author"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v")
        )
        T.feed_baselines(items, out, checkpoint, every=3)
    return T.fed_baselines(spark, out, every=3).select("author", "n", F.round("median_views", 6).alias("median_views"))


@query(
    "baseline_upsert",
    """SELECT (user_id % 10)::VARCHAR AS author, arg_max(value, ts) AS median_views, arg_max(event_id, ts) AS n FROM events GROUP BY user_id % 10""",
)
def baseline_upsert(spark, d):
    schema = fx.table(spark, d, "events").schema
    updates = T.snapshot_stream(spark, d, schema, "events.parquet").select(
        (F.col("user_id") % 10).cast("string").alias("author"), F.col("value").alias("median_views"),
        F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("updated_at"),
    )
    out = fresh_path(spark, "baselines")
    T.upsert_baselines(updates, out, fresh_path(spark, "baselines-checkpoint"))
    return T.current_baselines(spark, out).select("author", "median_views", "n")


@query(
    "tumbling_counts",
    "SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01')::DATE::VARCHAR AS week, count(*) AS n FROM events GROUP BY 1",
)
def tumbling_counts(spark, d):
    schema = fx.table(spark, d, "events").schema
    counts = T.tumbling_counts(T.snapshot_stream(spark, d, schema, "events.parquet"), "ts", "7 days")
    return T.run_updates(counts, "weekly", ["start"]).select(F.col("start").cast("date").cast("string").alias("week"), "n")
