"""Profiling, split, sampling and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import profile as Q
from tidemark.operators import similar as S
from tidemark.operators import splits as Z
from tidemark.operators.guards import guard_report as report
from tidemark.operators.guards import imbalance
from tidemark.operators.joins import with_one_row
from tidemark.operators.panel import latest_at, latest_at_many, null_skipping_sum, temporal_split
from tidemark.plans.registry import query
from tidemark.session import cut
from tidemark.sources import fixtures as fx

WITH_ITEMS = "WITH " + fx.ITEMS_SQL
WITH_SCORED = "WITH " + fx.SCORED_SQL
WITH_PANEL = "WITH " + fx.PANEL_SQL


def rounded(*cols):
    return [F.round(F.col(c).cast("double"), 6).alias(c) for c in cols]


@query("value_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def value_counts(spark, d):
    return Q.value_counts(fx.table(spark, d, "customer"), "c_mktsegment")


@query(
    "top_share",
    WITH_ITEMS + """, c AS (SELECT k, count(*) AS n FROM items GROUP BY k)
    SELECT count(*) AS distinct_values, sum(n)::BIGINT AS rows, round((SELECT sum(n) FROM (SELECT n FROM c ORDER BY n DESC, k LIMIT 10)) / sum(n), 6)::DOUBLE AS top_share FROM c""",
)
def top_share(spark, d):
    return Q.top_share(fx.items(spark, d), "k", 10).select("distinct_values", "rows", *rounded("top_share"))


@query(
    "concentration",
    """WITH p AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey)
    SELECT round(max(n) / sum(n), 6)::DOUBLE AS largest_row_share, round((SELECT sum(v) FROM (SELECT v FROM p ORDER BY v DESC, o_custkey LIMIT 5)) / sum(v), 6) AS top5_value_share, """
    + ", ".join(f"sum((n >= {k})::INT)::BIGINT AS keys_ge_{k}, round(sum(CASE WHEN n >= {k} THEN n ELSE 0 END) / sum(n), 6)::DOUBLE AS rows_ge_{k}" for k in (2, 3, 5, 10))
    + " FROM p",
)
def concentration(spark, d):
    c = Q.concentration(fx.table(spark, d, "orders"), "o_custkey", "o_totalprice")
    return c.select(*[f"keys_ge_{k}" for k in (2, 3, 5, 10)], *rounded(*[x for x in c.columns if not x.startswith("keys")]))


@query("distinct_per_group", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS distinct_values FROM orders GROUP BY o_custkey")
def distinct_per_group(spark, d):
    return Q.distinct_per_group(fx.table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("top_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def top_groups(spark, d):
    return Q.value_counts(fx.table(spark, d, "orders"), "o_custkey").orderBy(F.col("n").desc(), "o_custkey").limit(10)


@query("recent_items", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 25")
def recent_items(spark, d):
    return fx.table(spark, d, "events").orderBy(F.col("ts").desc(), "event_id").limit(25).select("event_id", "user_id")


def _describe_sql(table, cols):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS n, round(avg({c}), 6) AS mean, min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.5), 6)::DOUBLE AS median, "
        f"round(quantile_cont({c}, 0.9), 6)::DOUBLE AS p90, round(quantile_cont({c}, 0.99), 6)::DOUBLE AS p99, max({c})::DOUBLE AS max FROM {table}" for c in cols
    )


@query("describe", _describe_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def describe(spark, d):
    q = Q.describe(fx.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return q.select("col", "n", "min", "max", *rounded("mean", "median", "p90", "p99"))


@query(
    "missingness",
    """WITH t AS (SELECT l.quality, CASE WHEN d.doc_id % 7 = 0 THEN '  ' ELSE d.source END AS source, c.text AS said FROM documents d LEFT JOIN labels l USING (doc_id)
      LEFT JOIN conversations c ON c.conv_id = d.doc_id)
    SELECT 'quality' AS col, round(avg((quality IS NULL)::INT), 6) AS missing_share FROM t UNION ALL SELECT 'source', round(avg((coalesce(trim(source), '') = '')::INT), 6) FROM t
    UNION ALL SELECT 'said', round(avg((coalesce(trim(said), '') = '')::INT), 6) FROM t""",
)
def missingness(spark, d):
    c = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("text").alias("said"))
    source = F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("source"))
    t = fx.table(spark, d, "documents").select("doc_id", source.alias("source"))
    t = t.join(fx.table(spark, d, "labels"), "doc_id", "left").join(c, "doc_id", "left")
    return Q.missingness(t, ["quality", "source", "said"]).select("col", *rounded("missing_share"))


@query(
    "eta_squared",
    WITH_ITEMS + """, g AS (SELECT author_id, count(*) AS n, avg(ln(1 + value)) AS m FROM items GROUP BY author_id), a AS (SELECT avg(ln(1 + value)) AS m, var_pop(ln(1 + value)) * count(*) AS tot FROM items)
    SELECT round(sum(g.n * (g.m - a.m) * (g.m - a.m)) / any_value(tot), 6) AS eta_squared FROM g, a""",
)
def eta_squared(spark, d):
    return Q.eta_squared(fx.items(spark, d).withColumn("v", F.log1p("value")), "v", "author_id").select(*rounded("eta_squared"))


@query(
    "histogram",
    """WITH x AS (SELECT log10(greatest(value, 1)) AS x FROM events), s AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
    SELECT least(floor((x - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n, round(any_value(lo) + least(floor((x - lo) / ((hi - lo) / 20)), 19) * any_value((hi - lo) / 20), 6) AS left_edge FROM x, s GROUP BY ALL""".replace(
        "GROUP BY ALL", "GROUP BY least(floor((x - lo) / ((hi - lo) / 20)), 19)"
    ),
)
def histogram(spark, d):
    h = Q.histogram(fx.table(spark, d, "events"), F.log10(F.greatest(F.col("value"), F.lit(1.0))), 20)
    return h.select("bin", "n", *rounded("left_edge"))


@query(
    "histogram_capped",
    """WITH c AS (SELECT count(*)::DOUBLE AS x FROM orders GROUP BY o_custkey), p AS (SELECT quantile_cont(x, 0.99) AS cap FROM c), x AS (SELECT least(x, cap) AS x FROM c, p),
    s AS (SELECT min(x) AS lo, max(x) AS hi FROM x)
    SELECT least(floor((x - lo) / ((hi - lo) / 10)), 9)::BIGINT AS bin, count(*) AS n FROM x, s GROUP BY 1""",
)
def histogram_capped(spark, d):
    per = Q.value_counts(fx.table(spark, d, "orders"), "o_custkey")
    return Q.histogram(per, F.col("n"), 10, cap=0.99).select("bin", "n")


@query(
    "trajectory",
    WITH_PANEL + " SELECT days_since_post, count(*) AS n, round(avg(play_count), 6) AS mean, round(quantile_cont(play_count, 0.5), 6) AS median FROM panel GROUP BY days_since_post",
)
def trajectory(spark, d):
    return Q.trajectory(fx.panel(spark, d), "days_since_post", "play_count").select("days_since_post", "n", *rounded("mean", "median"))


@query(
    "early_late_ratio",
    WITH_PANEL + """, w AS (SELECT item_id, arg_max(play_count, days_since_post) FILTER (WHERE days_since_post <= 3) AS a, arg_max(play_count, days_since_post) FILTER (WHERE days_since_post <= 14) AS b FROM panel GROUP BY item_id)
    SELECT round(quantile_cont(a / b, 0.5), 6) AS median_ratio, count(a / b) AS n FROM w WHERE b > 0""",
)
def early_late_ratio(spark, d):
    return Q.median_ratio(fx.panel(spark, d), "item_id", "days_since_post", "play_count", 3, 14).select("n", *rounded("median_ratio"))


@query("weekly_counts", "SELECT date_trunc('week', ts)::DATE::VARCHAR AS period, count(*) AS n FROM events GROUP BY 1")
def weekly_counts(spark, d):
    return Q.counts_by_period(fx.table(spark, d, "events"), "ts", "week")


@query(
    "monthly_yearly_counts",
    """SELECT 'month' AS unit, date_trunc('month', o_orderdate)::DATE::VARCHAR AS period, count(*) AS n FROM orders GROUP BY ALL
    UNION ALL SELECT 'year', date_trunc('year', o_orderdate)::DATE::VARCHAR, count(*) FROM orders GROUP BY ALL""",
)
def monthly_yearly_counts(spark, d):
    o = fx.table(spark, d, "orders")
    one = lambda u: Q.counts_by_period(o, "o_orderdate", u).select(F.lit(u).alias("unit"), "period", "n")
    return one("month").unionByName(one("year"))


@query("pearson", "SELECT round(corr(ln(1 + l_quantity), ln(1 + l_extendedprice)), 6) AS r FROM lineitem")
def pearson(spark, d):
    return fx.table(spark, d, "lineitem").agg(F.round(F.corr(F.log1p("l_quantity"), F.log1p("l_extendedprice")), 6).alias("r"))


@query(
    "horizon_choice",
    WITH_PANEL + ", ".join(
        [""] + [f"""h{h} AS (SELECT item_id, arg_max(play_count, days_since_post) AS p, arg_max(coalesce(like_count, 0) + coalesce(comment_count, 0) + coalesce(share_count, 0), days_since_post) AS e
        FROM panel WHERE days_since_post <= {h} GROUP BY item_id)""" for h in (6, 9, 12)]
    ) + """, f AS (SELECT item_id, max(days_since_post) AS last, arg_max(play_count, days_since_post) AS fin FROM panel GROUP BY item_id), """ + ", ".join(
        f"""e{h} AS (SELECT item_id, author, p, er, (er > quantile_cont(er, 0.5) OVER (PARTITION BY author))::INT AS y
        FROM (SELECT item_id, o_custkey AS author, p, e / greatest(p, 1) AS er FROM h{h} JOIN orders ON o_orderkey = item_id))""" for h in (6, 9, 12)
    ) + ", " + ", ".join(
        f"""k{h} AS (SELECT {h} AS horizon, (a - c) / (1 - c) AS kappa FROM (SELECT avg((x = y)::INT) AS a, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS c
        FROM (SELECT coalesce(o.y, 0) AS x, z.y AS y FROM e12 z LEFT JOIN e{h} o ON z.item_id = o.item_id))),
        r{h} AS (SELECT {h} AS horizon, (SELECT avg((last >= {h})::INT) FROM f) AS coverage,
        (SELECT quantile_cont(p / greatest(fin, 1), 0.5) FROM h{h} JOIN f USING (item_id) WHERE last >= {h}) AS median_ratio)""" for h in (6, 9, 12)
    ) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM r{h} JOIN k{h} USING (horizon)" for h in (6, 9, 12)) + """),
    m AS (SELECT min(horizon) FILTER (WHERE coverage >= 0.6 AND median_ratio >= 0.6) AS pick FROM u)
    SELECT horizon, round(coverage, 6) AS coverage, round(median_ratio, 6) AS median_ratio, round(kappa, 6) AS kappa, coalesce((horizon = pick)::INT, 0) AS chosen FROM u, m""",
)
def horizon_choice(spark, d):
    authors = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("author_id"))
    p = fx.panel(spark, d).join(authors, "item_id")
    h = Q.horizon_choice(
        p, "item_id", "author_id", "days_since_post", "play_count", ["like_count", "comment_count", "share_count"], (6, 9, 12), 12, need=0.6
    )
    return h.select("horizon", "chosen", *rounded("coverage", "median_ratio", "kappa"))


@query(
    "first_day_window",
    WITH_PANEL + """, w AS (SELECT item_id, min(days_since_post) AS fst, arg_max(play_count, days_since_post) FILTER (WHERE days_since_post <= 1) AS a,
      arg_max(play_count, days_since_post) FILTER (WHERE days_since_post <= 14) AS b FROM panel GROUP BY item_id)
    SELECT round(avg((fst <= 0)::INT), 6) AS coverage_d0, round(avg((fst <= 1)::INT), 6) AS coverage_d1, round(corr(ln(1 + a), ln(1 + b)), 6) AS log_corr FROM w""",
)
def first_day_window(spark, d):
    p = fx.panel(spark, d)
    wide = latest_at_many(p, "item_id", "days_since_post", "play_count", [1, 14])
    first = p.groupBy("item_id").agg(F.min("days_since_post").alias("first"))
    return Q.first_day_window(wide.join(first, "item_id"), "first", "play_count_1", "play_count_14").select(
        *rounded("coverage_d0", "coverage_d1", "log_corr")
    )


@query(
    "view_floors",
    WITH_PANEL + """, h AS (SELECT item_id, arg_max(play_count, days_since_post) AS p, arg_max(coalesce(like_count, 0) + coalesce(comment_count, 0), days_since_post) / greatest(arg_max(play_count, days_since_post), 1) AS er
      FROM panel WHERE days_since_post <= 14 GROUP BY item_id)
    SELECT floor, round(avg((p >= floor)::INT), 6) AS kept, round(avg(CASE WHEN p >= floor THEN (er > 1)::INT END), 6) AS er_above_one FROM h, (SELECT unnest([0, 50, 100, 200, 500]) AS floor) GROUP BY floor""",
)
def view_floors(spark, d):
    p = fx.panel(spark, d)
    h = latest_at(p, "item_id", "days_since_post", 14)
    er = null_skipping_sum(["like_count", "comment_count"]) / F.greatest(F.col("play_count"), F.lit(1.0))
    return Q.view_floors(h.withColumn("er", er), "play_count", "er").select("floor", *rounded("kept", "er_above_one"))


COMPARE = {"items": "count(1)", "authors": "count(distinct author)", "max_value": "max(v)"}


@query(
    "dataset_comparison",
    """WITH a AS (SELECT user_id AS author, value AS v FROM events), b AS (SELECT o_custkey AS author, o_totalprice AS v FROM orders),
    sa AS (SELECT count(*)::DOUBLE AS i, count(DISTINCT author)::DOUBLE AS au, quantile_cont(v, 0.5) AS m, max(v) AS x FROM a),
    sb AS (SELECT count(*)::DOUBLE AS i, count(DISTINCT author)::DOUBLE AS au, quantile_cont(v, 0.5) AS m, max(v) AS x FROM b)
    SELECT 'items' AS dimension, sa.i AS events, sb.i AS orders FROM sa, sb UNION ALL SELECT 'authors', sa.au, sb.au FROM sa, sb
    UNION ALL SELECT 'median_value', sa.m, sb.m FROM sa, sb UNION ALL SELECT 'max_value', sa.x, sb.x FROM sa, sb""",
)
def dataset_comparison(spark, d):
    a = fx.table(spark, d, "events").select(F.col("user_id").alias("author"), F.col("value").alias("v"))
    b = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("author"), F.col("o_totalprice").alias("v"))
    return Q.compare_tables({"events": a, "orders": b}, COMPARE, {"median_value": "v"})


@query(
    "ordered_list",
    WITH_PANEL + " SELECT item_id, string_agg(play_count::BIGINT::VARCHAR, ',' ORDER BY days_since_post) AS series FROM panel GROUP BY item_id",
)
def ordered_list(spark, d):
    v = Q.ordered_values(fx.panel(spark, d), "item_id", "days_since_post", "play_count")
    return v.select("item_id", F.array_join(F.transform("values", lambda x: x.cast("bigint").cast("string")), ",").alias("series"))


T0, B = (1.0, 3.0, 9.0), (0.5, 1.5, 3.0)
CURVES = [(t0, b) for t0 in T0 for b in B]


@query(
    "growth_grid",
    WITH_PANEL + ", s AS (SELECT item_id, days_since_post + 1 AS t, play_count AS v, days_since_post FROM panel WHERE days_since_post <= 9), c AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {t0}::DOUBLE, {b}::DOUBLE)" for i, (t0, b) in enumerate(CURVES))
    + """) c(curve, t0, b)), per AS (SELECT item_id, count(*) AS n, max(v) AS mx, arg_max(v, days_since_post) AS lastv, sum(v * v) AS vv FROM s GROUP BY item_id),
    f AS (SELECT item_id, curve, t0, b, sum(v / (1 + pow(t0 / t, b))) AS vs, sum(1 / pow(1 + pow(t0 / t, b), 2)) AS ss FROM s, c GROUP BY ALL),
    a AS (SELECT f.*, per.*, greatest(lastv, least(vs / ss, lastv * 50 + 10)) AS a FROM f JOIN per USING (item_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(vv - 2 * a * vs + a * a * ss, 6), curve) AS rn FROM a)
    SELECT item_id, n AS points, lastv AS last_value, CASE WHEN n >= 3 AND mx > 0 THEN curve ELSE -1 END AS curve,
      round(CASE WHEN n >= 3 AND mx > 0 THEN a / (1 + pow(t0 / 15.0::DOUBLE, b)) ELSE lastv END, 6) AS predicted FROM r WHERE rn = 1""",
)
def growth_grid(spark, d):
    g = Q.growth_grid(fx.panel(spark, d), "item_id", "days_since_post", "play_count", 14, 9, T0, B)
    return g.select("item_id", "points", "last_value", "curve", *rounded("predicted"))


def _growth_sql(rounds: int = 3) -> str:
    """The fit round by round: (t0, b) candidates, their A, and the best by squared error."""
    shape = lambda p="x": f"(1 / (1 + pow(c.t0 / {p}.t, c.b)))"
    out = """ pts AS (SELECT item_id, list(struct_pack(t := (days_since_post + 1)::DOUBLE, v := play_count::DOUBLE) ORDER BY days_since_post) FILTER (days_since_post <= 9) AS p,
      list(struct_pack(t := (days_since_post + 1)::DOUBLE, v := play_count::DOUBLE) ORDER BY days_since_post) FILTER (days_since_post > 9) AS later
      FROM panel WHERE days_since_post <= 14 GROUP BY item_id HAVING count(*) FILTER (days_since_post <= 9) > 0),
    base AS (SELECT *, p[len(p)].v AS last FROM pts),
    c0 AS (SELECT item_id, i, t0, b FROM base, (VALUES """ + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(CURVES)) + ") g(i, t0, b))"
    for r in range(rounds + 1):
        out += f""",
    a{r} AS (SELECT c.*, p, greatest(last, least(list_sum(list_transform(p, lambda x: x.v * {shape()})) / list_sum(list_transform(p, lambda x: {shape()} * {shape()})), last * 50 + 10)) AS a
      FROM c{r} c JOIN base USING (item_id)),
    f{r} AS (SELECT item_id, t0, b, a FROM a{r} c QUALIFY row_number() OVER (PARTITION BY item_id
      ORDER BY round(list_sum(list_transform(p, lambda x: pow(x.v - c.a * {shape()}, 2))), 6), i) = 1)"""
        if r < rounds:
            ratio, step = 2.0 ** (0.5**r), 0.5 ** (r + 1)
            out += f""",
    c{r + 1} AS (SELECT item_id, i * 3 + j AS i, t0 * m AS t0, greatest(b + s, 0.05::DOUBLE) AS b FROM f{r},
      (VALUES (0, {1 / ratio!r}::DOUBLE), (1, 1::DOUBLE), (2, {ratio!r}::DOUBLE)) x(i, m), (VALUES (0, {-step}::DOUBLE), (1, 0::DOUBLE), (2, {step}::DOUBLE)) y(j, s))"""
    at = lambda t: f"(c.a / (1 + pow(c.t0 / {t}, c.b)))"
    return out + f""",
    r AS (SELECT base.*, c.t0, c.b, c.a, len(p) >= 3 AND list_max(list_transform(p, lambda x: x.v)) > 0 AS ok FROM base JOIN f{rounds} c USING (item_id))
    SELECT item_id, len(p) AS points, last AS last_value, round(CASE WHEN ok THEN t0 END, 6) AS t0, round(CASE WHEN ok THEN b END, 6) AS b,
      round(CASE WHEN ok THEN {at("15.0::DOUBLE")} ELSE last END, 6) AS predicted,
      round(list_sum(list_transform(later, lambda x: abs(CASE WHEN ok THEN {at("x.t")} ELSE last END - x.v))) / len(later), 6) AS error,
      round(list_sum(list_transform(later, lambda x: abs(last - x.v))) / len(later), 6) AS last_error FROM r c"""


@query("growth_curves", WITH_PANEL + "," + _growth_sql())
def growth_curves(spark, d):
    g = Q.growth_curves(fx.panel(spark, d), "item_id", "days_since_post", "play_count", 14, 9, T0, B)
    return g.select("item_id", F.col("points").cast("bigint").alias("points"), "last_value", *rounded("t0", "b", "predicted", "error", "last_error"))


@query("balanced_folds", "SELECT count(*) AS rows, 0 AS split_keys, 5 AS folds, 1 AS shares_ok FROM events")
def balanced_folds(spark, d):
    """Five folds of whole authors, one of whom holds a third of the rows: label shares within 0.03 of the whole."""
    s = fx.scored(spark, d).withColumn("author_id", F.when(F.col("author_id") % 3 == 0, -1).otherwise(F.col("author_id")))
    folded = cut(Z.grouped_folds(s, "author_id", "item_id", "y").select("author_id", "y", "fold"))
    split = folded.groupBy("author_id").agg(F.countDistinct("fold").alias("k")).agg(F.sum((F.col("k") > 1).cast("int")).cast("int").alias("split_keys"))
    whole = folded.agg(F.count("*").alias("rows"), F.avg("y").alias("_share"))
    shares = with_one_row(folded.groupBy("fold").agg(F.avg("y").alias("_y")), whole)
    one = shares.agg(F.max("rows").alias("rows"), F.count("*").cast("int").alias("folds"), (F.max(F.abs(F.col("_y") - F.col("_share"))) <= 0.03).cast("int").alias("shares_ok"))
    return with_one_row(one, split)


@query(
    "baseline_last15",
    """WITH r AS (SELECT user_id AS author, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
    SELECT author, round(quantile_cont(v, 0.5), 6) AS median_value, count(v) AS n FROM r WHERE rn <= 15 GROUP BY author HAVING count(v) >= 5""",
)
def baseline_last15(spark, d):
    e = fx.table(spark, d, "events").select(
        F.col("user_id").alias("author"), "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("v")
    )
    return Q.baseline_median(e, "author", "ts", "v").select("author", "n", *rounded("median_value"))


@query(
    "population_stability",
    WITH_SCORED + """, e AS (SELECT list_distinct(quantile_cont(value, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS es FROM scored WHERE split = 'train'),
    b AS (SELECT len(list_filter(es, lambda x: x <= value)) AS bucket, sum((split = 'train')::INT) AS e, sum((split = 'test')::INT) AS a FROM scored, e WHERE split <> 'valid' GROUP BY 1),
    s AS (SELECT greatest(e / sum(e) OVER (), 1e-6) AS e, greatest(a / sum(a) OVER (), 1e-6) AS a FROM b) SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM s""",
)
def population_stability(spark, d):
    s = temporal_split(fx.items(spark, d), "t")
    return Q.population_stability(s.filter("split = 'train'"), s.filter("split = 'test'"), "value").select(*rounded("psi"))


GUARDED = ["play_count", "like_count", "log_play_d1", "er_d1", "y_follgrow", "days_since_post"]


@query(
    "guard_report",
    WITH_PANEL + """, f AS (SELECT play_count, like_count, ln(1 + play_count) AS log_play_d1, like_count / greatest(play_count, 1) AS er_d1,
      CASE WHEN days_since_post > 3 THEN 1 END AS y_follgrow, days_since_post FROM panel WHERE days_since_post <= 3),
    n AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known FROM f" for c in GUARDED) + """)
    SELECT feature, known, (feature IN ('y_follgrow') OR regexp_matches(feature, 'play_count|like_count|_d1|day1'))::INT AS refused_pre,
      (feature IN ('y_follgrow') OR feature NOT IN ('log_play_d1', 'er_d1') AND regexp_matches(feature, 'play_count|like_count'))::INT AS refused_day1 FROM n""",
)
def guard_report(spark, d):
    """Which columns of a first-day frame may be features before publication, and which on the first day."""
    f = fx.panel(spark, d).filter("days_since_post <= 3").withColumns(
        {
            "log_play_d1": F.log1p("play_count"), "er_d1": F.col("like_count") / F.greatest("play_count", F.lit(1.0)),
            "y_follgrow": F.when(F.col("days_since_post") > 3, 1),
        }
    )
    return report(f, GUARDED)


@query("imbalance_warning", "SELECT sum((quality = 1)::INT)::BIGINT AS hit, sum((quality = 0)::INT)::BIGINT AS flop, CASE WHEN count(quality) >= 10 AND greatest(sum((quality = 1)::INT), sum((quality = 0)::INT)) / count(quality)::DOUBLE > 0.8 THEN 'one_class' END AS warning FROM labels")
def imbalance_warning(spark, d):
    return imbalance(fx.table(spark, d, "labels"), "quality")


# ---- folds and samples


def snake_sql(rank: str, k: int) -> str:
    return f"CASE WHEN ({rank} - 1) % {2 * k} < {k} THEN ({rank} - 1) % {2 * k} ELSE {2 * k - 1} - ({rank} - 1) % {2 * k} END"


@query(
    "group_kfold",
    WITH_ITEMS + f""", s AS (SELECT author_id, count(*) AS n FROM items GROUP BY author_id),
    r AS (SELECT author_id, row_number() OVER (ORDER BY n DESC, md5(author_id || ':0')) AS rk FROM s)
    SELECT item_id, author_id, {snake_sql('rk', 4)} AS fold FROM items JOIN r USING (author_id)""",
)
def group_kfold(spark, d):
    return Z.group_kfold(fx.items(spark, d), "author_id").select("item_id", "author_id", "fold")


@query(
    "stratified_group_kfold",
    WITH_SCORED + f""", s AS (SELECT author_id, count(*) AS n, least(floor(avg(y) * 4), 3) AS band FROM scored GROUP BY author_id),
    r AS (SELECT author_id, band, row_number() OVER (PARTITION BY band ORDER BY n DESC, md5(author_id || ':0')) AS rk FROM s)
    SELECT author_id, band::BIGINT AS band, {snake_sql('rk', 5)} AS fold FROM r""",
)
def stratified_group_kfold(spark, d):
    return Z.stratified_fold_table(fx.scored(spark, d), "author_id", "y").select("author_id", "band", "fold")


@query(
    "stratified_kfold",
    WITH_SCORED + " SELECT item_id, y, (row_number() OVER (PARTITION BY y ORDER BY md5(item_id || ':0')) - 1) % 5 AS fold FROM scored",
)
def stratified_kfold(spark, d):
    return Z.stratified_kfold(fx.scored(spark, d), "item_id", "y").select("item_id", "y", "fold")


@query(
    "author_split",
    WITH_ITEMS + """, r AS (SELECT author_id, row_number() OVER (ORDER BY md5(author_id || ':0')) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT author_id FROM items))
    SELECT item_id, CASE WHEN rk <= floor(0.7::DOUBLE * n) THEN 'train' WHEN rk <= floor(0.85::DOUBLE * n) THEN 'valid' ELSE 'test' END AS split FROM items JOIN r USING (author_id)""",
)
def author_split(spark, d):
    return Z.author_split(fx.items(spark, d), "author_id").select("item_id", "split")


@query(
    "balanced_sample",
    WITH_SCORED + " SELECT item_id, y FROM (SELECT item_id, y, row_number() OVER (PARTITION BY y ORDER BY md5(item_id || ':0')) AS rk FROM scored) WHERE rk <= 500",
)
def balanced_sample(spark, d):
    return Z.balanced_sample(fx.scored(spark, d), "item_id", "y", 1000).select("item_id", "y")


@query(
    "stratified_sample",
    WITH_SCORED + """ SELECT item_id, split, y FROM (SELECT item_id, split, y, row_number() OVER (PARTITION BY split, y ORDER BY md5(item_id || ':0')) AS rk,
      count(*) OVER (PARTITION BY split, y) AS n FROM scored) WHERE rk <= ceil(0.1::DOUBLE * n)""",
)
def stratified_sample(spark, d):
    return Z.stratified_sample(fx.scored(spark, d), "item_id", ["split", "y"], 0.1).select("item_id", "split", "y")


@query("seeded_sample", "SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || ':7') LIMIT 200")
def seeded_sample(spark, d):
    return Z.seeded_sample(fx.table(spark, d, "embeddings"), "vec_id", 200, seed=7).select("vec_id", "label")


@query(
    "strided_sample",
    "SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY md5(page_id || ':0')) AS rk FROM pages) WHERE (rk - 1) % 5 = 0 AND rk <= 5 * 30",
)
def strided_sample(spark, d):
    return Z.strided_sample(fx.table(spark, d, "pages"), "page_id", 5, 30).select("page_id")


# ---- similarity

KNN_SQL = """u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.vec_id, b.vec_id AS nb, b.label, list_cosine_similarity(a.v, b.v) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nb) AS rk FROM s)"""


@query(
    "knn_label",
    f"WITH {KNN_SQL} SELECT vec_id, round(avg((label % 2)::DOUBLE), 6) AS knn_success, round(avg(sim), 5) AS knn_sim FROM r WHERE rk <= 50 GROUP BY vec_id",
)
def knn_label(spark, d):
    e = fx.table(spark, d, "embeddings").withColumn("hit", (F.col("label") % 2).cast("int"))
    n = S.knn_join(e, e, "vec_id", "vec_id", "embedding", "embedding", 50, payload=["hit"])
    f = S.knn_features(n, "vec_id", "hit")
    return f.select("vec_id", F.round("knn_success", 6).alias("knn_success"), F.round("knn_sim", 5).alias("knn_sim"))


@query(
    "nearest_examples",
    f"WITH {KNN_SQL} SELECT vec_id, rk AS rank, nb AS neighbour, round(sim, 5) AS score, CASE WHEN label % 2 = 1 THEN 'hit' ELSE 'flop' END AS outcome FROM r WHERE rk <= 3",
)
def nearest_examples(spark, d):
    e = fx.table(spark, d, "embeddings").withColumn("hit", (F.col("label") % 2).cast("int"))
    n = S.knn_join(e, e, "vec_id", "vec_id", "embedding", "embedding", 3, payload=["hit"])
    return n.select(
        "vec_id", F.col("rank").cast("bigint").alias("rank"), "neighbour", F.round("score", 5).alias("score"),
        F.when(F.col("hit") == 1, "hit").otherwise("flop").alias("outcome"),
    )


@query(
    "nearest_same_author",
    """WITH u AS (SELECT vec_id, label AS author, embedding::DOUBLE[] AS v FROM embeddings), bank AS (SELECT vec_id, v, CASE WHEN author < 6 THEN author ELSE author + 100 END AS author FROM u),
    s AS (SELECT a.vec_id, b.vec_id AS nb, (a.author < 6)::INT AS same_group, list_distance(a.v, b.v) AS dist FROM u a JOIN bank b ON a.vec_id <> b.vec_id AND (a.author = b.author OR a.author >= 6)),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nb) AS rk FROM s)
    SELECT vec_id, rk AS rank, nb AS neighbour, same_group, round(dist, 5) AS score FROM r WHERE rk <= 3""",
)
def nearest_same_author(spark, d):
    e = fx.table(spark, d, "embeddings").withColumnRenamed("label", "author")
    renamed = F.when(F.col("author") < 6, F.col("author")).otherwise(F.col("author") + 100)  # groups no query knows
    n = S.knn_prefer_group(e, e.withColumn("author", renamed), "vec_id", "vec_id", "embedding", "embedding", 3, "author", cosine=False)
    return n.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "neighbour", "same_group", F.round("score", 5).alias("score"))


@query("knn_cost", "SELECT count(*) * count(*) AS all_pairs, 1 AS within_all FROM embeddings")
def knn_cost(spark, d):
    """Row pairs the two passes of ``knn_label`` compare; how few they are depends on how the vectors cluster."""
    e = fx.table(spark, d, "embeddings")
    cost = S.knn_search(e, e, "vec_id", "vec_id", "embedding", "embedding", 50)[1]
    return cost.select("all_pairs", (F.col("compared") <= F.col("all_pairs")).cast("int").alias("within_all"))


@query("knn_lsh_recall", "SELECT 50 * count(*) AS neighbours, 1 AS reached FROM embeddings")
def knn_lsh_recall(spark, d):
    """Whether hashed neighbours hold at least 0.9 of the exact 50 of every row."""
    e = fx.table(spark, d, "embeddings")
    exact = S.knn_join(e, e, "vec_id", "vec_id", "embedding", "embedding", 50)
    got = S.knn_lsh(e, e, "vec_id", "vec_id", "embedding", "embedding", 50, similarity=0.2, recall=0.95, bits=3)
    return S.knn_recall(exact, got, "vec_id").select("neighbours", (F.col("recall") >= 0.9).cast("int").alias("reached"))


@query(
    "jaccard_pairs",
    """WITH j AS (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9'']+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9'']+')) AS b
      FROM conversations c JOIN documents d ON d.doc_id = c.conv_id)
    SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1)::DOUBLE, 6) AS jaccard FROM j""",
)
def jaccard_pairs(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), X.token_set("text").alias("b"))
    c = fx.table(spark, d, "conversations").select("conv_id", "turn", X.token_set("text").alias("a"))
    return c.join(docs, "conv_id").select("conv_id", "turn", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))

