"""Metric, bootstrap and decision queries over scored items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import HORIZON_DAYS
from tidemark.operators import decide as D
from tidemark.operators import metrics as M
from tidemark.operators import resample as R
from tidemark.operators.joins import with_one_row
from tidemark.operators.panel import absolute_label, latest_at_many
from tidemark.operators.scan import exact_quantiles, prefix_scan
from tidemark.operators.splits import ips_weights
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

WITH_SCORED = "WITH " + fx.SCORED_SQL
WITH_PANEL = "WITH " + fx.PANEL_SQL


def auc_sql(src: str, p: str = "p", y: str = "y", by: str = "") -> str:
    """Mann-Whitney AUC with ties, per key."""
    key, grp, on = (f"{by}, ", f"GROUP BY {by}", f"PARTITION BY {by}") if by else ("", "", "")
    return f"""SELECT {key}(sum(CASE WHEN {y} = 1 THEN r END) - sum({y}) * (sum({y}) + 1) / 2.0::DOUBLE) / nullif(sum({y}) * sum(1 - {y}), 0) AS roc_auc
    FROM (SELECT *, rank() OVER ({on} ORDER BY {p}) + (count(*) OVER (PARTITION BY {key}{p}) - 1) / 2.0::DOUBLE AS r FROM {src}) {grp}"""


def ap_sql(src: str, p: str = "p", y: str = "y", by: str = "") -> str:
    """Step-wise average precision, per key."""
    key, grp, on = (f"{by}, ", f"GROUP BY {by}", f"PARTITION BY {by}") if by else ("", "", "")
    return f"""SELECT {key}sum(pos / total * tp / seen) AS avg_precision FROM (
      SELECT {key}pos, sum(pos) OVER ({on}) AS total, sum(pos) OVER ({on} ORDER BY {p} DESC) AS tp, sum(n) OVER ({on} ORDER BY {p} DESC) AS seen
      FROM (SELECT {key}{p}, sum({y})::DOUBLE AS pos, count(*)::DOUBLE AS n FROM {src} GROUP BY {key}{p})) {grp}"""


def rounded(*cols):
    return [F.round(F.col(c).cast("double"), 9).alias(c) for c in cols]


@query(
    "rank_metrics_by_split",
    WITH_SCORED + f", a AS ({auc_sql('scored', by='split')}), b AS ({ap_sql('scored', by='split')}) "
    "SELECT split, round(roc_auc, 9) AS roc_auc, round(avg_precision, 9) AS avg_precision FROM a JOIN b USING (split)",
)
def rank_metrics_by_split(spark, d):
    return M.rank_metrics(fx.scored(spark, d), "y", "p", ["split"]).select("split", *rounded("roc_auc", "avg_precision"))


@query("roc_auc", WITH_SCORED + f" SELECT round(roc_auc, 9) AS roc_auc FROM ({auc_sql('scored')})")
def roc_auc(spark, d):
    return M.rank_metrics(fx.scored(spark, d), "y", "p").select(*rounded("roc_auc"))


@query("avg_precision", WITH_SCORED + f" SELECT round(avg_precision, 9) AS avg_precision FROM ({ap_sql('scored')})")
def avg_precision(spark, d):
    return M.rank_metrics(fx.scored(spark, d), "y", "p").select(*rounded("avg_precision"))


@query(
    "brier_confusion",
    WITH_SCORED + """, c AS (SELECT split, count(*) AS n, avg((p - y) * (p - y)) AS brier, sum((p >= 0.5 AND y = 1)::INT) AS tp,
      sum((p >= 0.5 AND y = 0)::INT) AS fp, sum((p < 0.5 AND y = 1)::INT) AS fn, sum((p < 0.5 AND y = 0)::INT) AS tn FROM scored GROUP BY split)
    SELECT split, n, round(brier, 12) AS brier, round((tp + fn) / n::DOUBLE, 9) AS base_rate, round((tp + tn) / n::DOUBLE, 9) AS accuracy,
      round(tp / (tp + fp)::DOUBLE, 9) AS precision_pos, round(tp / (tp + fn)::DOUBLE, 9) AS recall_pos, (tp + fp)::BIGINT AS n_pos_calls,
      round(tn / (tn + fn)::DOUBLE, 9) AS precision_neg, round(tn / (tn + fp)::DOUBLE, 9) AS recall_neg,
      round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 9) AS f1_pos, round(2 * tn / (2 * tn + fp + fn)::DOUBLE, 9) AS f1_neg,
      round((2 * tp / (2 * tp + fp + fn)::DOUBLE + 2 * tn / (2 * tn + fp + fn)::DOUBLE) / 2, 9) AS macro_f1 FROM c""",
)
def brier_confusion(spark, d):
    m = M.metrics(fx.scored(spark, d), "y", "p", by=["split"])
    return m.select(
        "split", "n", "n_pos_calls",
        F.round("brier", 12).alias("brier"),
        *rounded("base_rate", "accuracy", "precision_pos", "recall_pos", "precision_neg", "recall_neg", "f1_pos", "f1_neg", "macro_f1"),
    )


@query(
    "confusion_no_calls",
    WITH_SCORED + """ SELECT topic, sum((p < 2 AND y = 1)::INT)::BIGINT AS fn, sum((p < 2 AND y = 0)::INT)::BIGINT AS tn, 0::BIGINT AS tp,
    0::BIGINT AS fp, NULL::DOUBLE AS precision_pos, 0::DOUBLE AS recall_pos, 0::DOUBLE AS f1_pos FROM scored GROUP BY topic""",
)
def confusion_no_calls(spark, d):
    c = M.confusion(fx.scored(spark, d), "y", "p", t=2.0, by=["topic"])
    return c.select("topic", "fn", "tn", "tp", "fp", "precision_pos", "recall_pos", "f1_pos")


@query(
    "reliability_uniform",
    WITH_SCORED + """ SELECT least(floor(p * 10), 9)::BIGINT AS bin, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate, count(*) AS n FROM scored GROUP BY 1""",
)
def reliability_uniform(spark, d):
    return M.reliability(fx.scored(spark, d), "y", "p").select("bin", "n", *rounded("mean_p", "rate"))


@query(
    "reliability_quantile",
    WITH_SCORED + """, e AS (SELECT list_distinct(quantile_cont(p, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS es, min(p) AS lo FROM scored)
    SELECT len(list_filter(es, lambda x: x <= p AND x > lo)) AS bin, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS rate, count(*) AS n FROM scored, e GROUP BY 1""",
)
def reliability_quantile(spark, d):
    return M.reliability(fx.scored(spark, d), "y", "p", kind="quantile").select("bin", "n", *rounded("mean_p", "rate"))


@query(
    "ece",
    WITH_SCORED + """, b AS (SELECT split, least(floor(p * 10), 9) AS bin, avg(p) AS mp, avg(y) AS rate, count(*) AS n FROM scored GROUP BY ALL)
    SELECT split, round(sum(n * abs(rate - mp)) / sum(n), 12) AS ece FROM b GROUP BY split""",
)
def ece(spark, d):
    return M.ece(fx.scored(spark, d), "y", "p", by=["split"]).select("split", F.round("ece", 12).alias("ece"))


@query(
    "segment_metrics",
    WITH_SCORED + f""", top AS (SELECT topic FROM scored GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 8),
    sz AS (SELECT item_id, count(*) OVER (PARTITION BY author_id) AS size FROM scored), se AS (SELECT list_distinct(quantile_cont(size, [0.25, 0.5, 0.75])) AS es FROM sz),
    s AS (SELECT 'all' AS dimension, 'all' AS segment, y, p FROM scored
      UNION ALL SELECT 'topic', topic, y, p FROM scored WHERE topic IN (FROM top)
      UNION ALL SELECT 'duration', CASE WHEN value < 7 THEN '<7' WHEN value < 15 THEN '7-15' WHEN value < 30 THEN '15-30' WHEN value < 60 THEN '30-60' ELSE '60+' END, y, p FROM scored
      UNION ALL SELECT 'author_size', len(list_filter(es, lambda x: x < size))::VARCHAR, y, p FROM scored JOIN sz USING (item_id), se),
    a AS ({auc_sql('s', by='dimension, segment')}),
    e AS (SELECT dimension, segment, sum(n * abs(rate - mp)) / sum(n) AS ece FROM (SELECT dimension, segment, least(floor(p * 10), 9) AS bin,
          avg(p) AS mp, avg(y) AS rate, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
    b AS (SELECT dimension, segment, count(*) AS n, avg(y) AS base_rate, avg((p - y) * (p - y)) AS brier FROM s GROUP BY ALL)
    SELECT dimension, segment, n, round(base_rate, 9) AS base_rate, round(brier, 12) AS brier, round(roc_auc, 12) AS roc_auc, round(ece, 12) AS ece
    FROM b JOIN a USING (dimension, segment) JOIN e USING (dimension, segment) WHERE n >= 50 AND roc_auc IS NOT NULL""",
)
def segment_metrics(spark, d):
    s = fx.scored(spark, d)
    top = s.groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "topic").limit(8)
    s = s.join(F.broadcast(top.select("topic", F.lit(1).alias("_top"))), "topic", "left")  # eight rows
    s = M.qcut(s.join(s.groupBy("author_id").agg(F.count("*").alias("size")), "author_id"), "size", 4, "quartile")
    v = F.col("value")
    band = F.when(v < 7, "<7").when(v < 15, "7-15").when(v < 30, "15-30").when(v < 60, "30-60").otherwise("60+")
    dims = {"topic": F.when(F.col("_top") == 1, F.col("topic")), "duration": band, "author_size": F.col("quartile")}
    return M.segment_metrics(s, "y", "p", dims).select("dimension", "segment", "n", *[F.round(c, 12).alias(c) for c in ("brier", "roc_auc", "ece")], *rounded("base_rate"))


@query(
    "univariate_influence",
    WITH_SCORED + f""", f AS (SELECT y, 'value' AS feature, value AS v FROM scored UNION ALL SELECT y, 'k', k FROM scored UNION ALL SELECT y, 'p', p FROM scored
      UNION ALL SELECT y, 'one', 1 FROM scored),
    a AS ({auc_sql('f', p='v', by='feature')}),
    rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rv,
             rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0::DOUBLE AS ry FROM f),
    c AS (SELECT feature, corr(rv, ry) AS rho FROM rk GROUP BY feature)
    SELECT feature, round(roc_auc, 9) AS roc_auc, round(roc_auc - 0.5, 9) AS signed_lift, round(rho, 9) AS spearman FROM a JOIN c USING (feature) WHERE feature <> 'one'""",
)
def univariate_influence(spark, d):
    s = fx.scored(spark, d).withColumn("one", F.lit(1.0))
    return M.feature_auc(s, "y", ["value", "k", "p", "one"]).select("feature", *rounded("roc_auc", "signed_lift", "spearman"))


@query(
    "spearman_matrix",
    WITH_SCORED + """, r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS a,
       rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0::DOUBLE AS b, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS c FROM scored)
    SELECT 'value' AS a, 'k' AS b, round(corr(a, b), 9) AS spearman FROM r UNION ALL SELECT 'value', 'p', round(corr(a, c), 9) FROM r UNION ALL SELECT 'k', 'p', round(corr(b, c), 9) FROM r""",
)
def spearman_matrix(spark, d):
    return M.spearman_matrix(fx.scored(spark, d), ["value", "k", "p"]).select("a", "b", *rounded("spearman"))


@query(
    "spearman_size",
    WITH_SCORED + """, z AS (SELECT author_id, count(*) AS size FROM scored GROUP BY author_id), j AS (SELECT p, size FROM scored JOIN z USING (author_id)),
    r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2.0::DOUBLE AS b FROM j)
    SELECT round(corr(a, b), 9) AS spearman FROM r""",
)
def spearman_size(spark, d):
    s = fx.scored(spark, d)
    sizes = s.groupBy("author_id").agg(F.count("*").alias("size"))
    return M.spearman(s.join(sizes, "author_id"), "p", "size").select(*rounded("spearman"))


RANK_SQL = (
    WITH_SCORED + """, g AS (SELECT author_id, count(*) AS n, min(value) AS lo, max(value) AS hi FROM scored GROUP BY author_id HAVING count(*) >= 3 AND min(value) < max(value)),
    r AS (SELECT s.author_id, p AS sc, value - lo AS gain, value FROM scored s JOIN g USING (author_id)),
    t AS (SELECT author_id, sc, count(*) AS n, avg(gain) AS g FROM r GROUP BY ALL),
    e AS (SELECT *, sum(n) OVER (PARTITION BY author_id ORDER BY sc DESC) AS fin FROM t),
    dc AS (SELECT author_id, sum(g * ((CASE WHEN fin >= 1 THEN 1 ELSE 0 END + CASE WHEN fin >= 2 THEN 1 / log2(3) ELSE 0 END + CASE WHEN fin >= 3 THEN 0.5 ELSE 0 END)
        - (CASE WHEN fin - n >= 1 THEN 1 ELSE 0 END + CASE WHEN fin - n >= 2 THEN 1 / log2(3) ELSE 0 END + CASE WHEN fin - n >= 3 THEN 0.5 ELSE 0 END))) AS dcg FROM e GROUP BY author_id),
    ir AS (SELECT author_id, gain, row_number() OVER (PARTITION BY author_id ORDER BY gain DESC) AS i FROM r),
    ic AS (SELECT author_id, sum(gain / log2(i + 1)) AS idcg FROM ir WHERE i <= 3 GROUP BY author_id),
    rk AS (SELECT author_id, rank() OVER (PARTITION BY author_id ORDER BY sc) + (count(*) OVER (PARTITION BY author_id, sc) - 1) / 2.0::DOUBLE AS a,
           rank() OVER (PARTITION BY author_id ORDER BY value) + (count(*) OVER (PARTITION BY author_id, value) - 1) / 2.0::DOUBLE AS b FROM r),
    sp AS (SELECT author_id, corr(a, b) AS rho FROM rk GROUP BY author_id),
    q AS (SELECT author_id, g.n, rho AS spearman, dcg / idcg AS ndcg_3 FROM g JOIN dc USING (author_id) JOIN ic USING (author_id) JOIN sp USING (author_id))"""
)


@query("rank_quality", RANK_SQL + " SELECT author_id, n, round(spearman, 9) AS spearman, round(ndcg_3, 9) AS ndcg_3 FROM q")
def rank_quality(spark, d):
    return M.rank_quality(fx.scored(spark, d), "author_id", "p", "value").select("author_id", "n", *rounded("spearman", "ndcg_3"))


@query("rank_quality_summary", RANK_SQL + " SELECT round(avg(spearman), 9) AS spearman, round(avg(ndcg_3), 9) AS ndcg_3, count(spearman) AS keys FROM q")
def rank_quality_summary(spark, d):
    per = M.rank_quality(fx.scored(spark, d), "author_id", "p", "value")
    return M.rank_quality_summary(per).select(*rounded("spearman", "ndcg_3"), "keys")


@query(
    "dense_relevance",
    WITH_SCORED + " SELECT item_id, dense_rank() OVER (PARTITION BY author_id ORDER BY floor(value / 10)) - 1 AS relevance FROM scored",
)
def dense_relevance(spark, d):
    i = fx.items(spark, d).withColumn("step", F.floor(F.col("value") / 10).cast("bigint"))
    steps = i.select("author_id", "step").distinct()
    ranks = prefix_scan(steps, ["author_id"], ["step"], sums={"r": F.lit(1)})
    return i.join(ranks, ["author_id", "step"]).select("item_id", (F.col("r") - 1).alias("relevance"))


@query(
    "fame_leak",
    WITH_SCORED + f""", z AS (SELECT author_id, sum(value) AS fame FROM scored GROUP BY author_id), q AS (SELECT quantile_cont(value, 0.7) AS c FROM scored),
    j AS (SELECT y AS own, (value >= c)::INT AS raw, fame FROM scored JOIN z USING (author_id), q),
    l AS (SELECT 'own_norm' AS label, own AS y, fame FROM j UNION ALL SELECT 'absolute', raw, fame FROM j), a AS ({auc_sql('l', p='fame', by='label')})
    SELECT label, round(greatest(roc_auc, 1 - roc_auc), 9) AS leak FROM a""",
)
def fame_leak(spark, d):
    s = absolute_label(fx.scored(spark, d), "value", 0.7, "absolute").withColumnRenamed("y", "own_norm")
    fame = s.groupBy("author_id").agg(F.round(F.sum("value"), 4).alias("fame"))
    return M.fame_leak(s.join(fame, "author_id"), ["own_norm", "absolute"], "fame").select("label", *rounded("leak"))


EARLY_DAYS = tuple(range(HORIZON_DAYS + 1))


@query(
    "early_window",
    WITH_PANEL + ", w AS (SELECT item_id, " + ", ".join(
        f"coalesce(arg_max(play_count, days_since_post) FILTER (WHERE days_since_post <= {h}), 0) AS d{h}" for h in EARLY_DAYS
    ) + f""" FROM panel GROUP BY item_id),
    m AS (SELECT quantile_cont(d14, 0.5) AS med FROM w),
    tall AS ({" UNION ALL ".join(f"SELECT {h} AS day, (d14 > med)::INT AS y, d{h} AS v FROM w, m" for h in EARLY_DAYS)}),
    a AS ({auc_sql('tall', p='v', by='day')}), f AS (SELECT roc_auc AS fin FROM a WHERE day = 14)
    SELECT day, round(roc_auc, 9) AS roc_auc, round((roc_auc - 0.5) / (fin - 0.5), 9) AS share_of_final FROM a, f""",
)
def early_window(spark, d):
    wide = latest_at_many(fx.panel(spark, d), "item_id", "days_since_post", "play_count", EARLY_DAYS).fillna(0.0)
    median = exact_quantiles(wide, [], "play_count_14", {"_median": 0.5})
    labelled = with_one_row(wide, median).withColumn("y", (F.col("play_count_14") > F.col("_median")).cast("int"))
    return M.early_window(labelled, "y", {h: f"play_count_{h}" for h in EARLY_DAYS}, HORIZON_DAYS).select("day", *rounded("roc_auc", "share_of_final"))


@query(
    "paired_cosine",
    """WITH p AS (SELECT a.vec_id, d.lang, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
      JOIN documents d ON d.doc_id = a.vec_id)
    SELECT lang, round(quantile_cont(c, 0.5), 9) AS median_cosine, count(*) AS n FROM p GROUP BY lang""",
)
def paired_cosine(spark, d):
    e = fx.table(spark, d, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    pairs = M.paired_cosine(e.join(nxt, "vec_id").join(docs, "vec_id"), "embedding", "other")
    return exact_quantiles(pairs, ["lang"], "cosine", {"median_cosine": 0.5}, n_out="n").select("lang", "n", *rounded("median_cosine"))


@query(
    "paired_fidelity",
    WITH_SCORED + """, d AS (SELECT split, abs(p - least(p * 0.5 + k / 250.0::DOUBLE, 1.0::DOUBLE)) AS dp FROM scored)
    SELECT split, count(*) AS n, round(quantile_cont(dp, 0.5), 9) AS abs_dp_median, round(quantile_cont(dp, 0.9), 9) AS abs_dp_p90 FROM d GROUP BY split""",
)
def paired_fidelity(spark, d):
    """How far two scores of the same rows are apart."""
    s = fx.scored(spark, d).withColumn("p2", F.least(F.col("p") * 0.5 + F.col("k") / 250.0, F.lit(1.0)))
    return M.paired_difference(s, "p", "p2", ["split"]).select("split", "n", *rounded("abs_dp_median", "abs_dp_p90"))


@query(
    "label_agreement",
    """SELECT round(avg(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a = b)::INT::DOUBLE END), 9) AS agree, sum((a IS NOT NULL AND b IS NOT NULL)::INT)::BIGINT AS both,
      sum((a IS NOT NULL AND b IS NULL)::INT)::BIGINT AS only_first, sum((a IS NULL AND b IS NOT NULL)::INT)::BIGINT AS only_second, sum((a IS NULL AND b IS NULL)::INT)::BIGINT AS neither
    FROM (SELECT l.quality AS a, CASE WHEN e.label IS NOT NULL THEN (e.label >= 3)::INT END AS b FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""",
)
def label_agreement(spark, d):
    lab = fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("a"))
    vec = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), (F.col("label") >= 3).cast("int").alias("b"))
    j = fx.table(spark, d, "documents").select("doc_id").join(lab, "doc_id", "left").join(vec, "doc_id", "left")
    return M.agreement(j, "a", "b").withColumn("agree", F.round("agree", 9))


# ---- bootstrap

POISSON_SQL = " + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in R.poisson_edges())


def boot_sql(reps: int, scores: dict[str, str], seed: str) -> str:
    """Replicate weights, then AUC, AP, F1 and recall per (score name, replicate)."""
    parts = " UNION ALL ".join(f"SELECT '{n}' AS s, item_id, y, {e} AS p FROM scored" for n, e in scores.items())
    return WITH_SCORED + f""", src AS ({parts}),
    wts AS (SELECT item_id, rep, {POISSON_SQL} AS w FROM (SELECT item_id, rep,
        ('0x' || substr(md5(item_id || ':' || ((rep - 1) // 4) || ':{seed}'), 8 * ((rep - 1) % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
        FROM items, (SELECT unnest(range(1, {reps + 1})) AS rep))),
    tab AS (SELECT s, rep, p, sum(w * y)::DOUBLE AS pos, sum(w * (1 - y))::DOUBLE AS neg FROM src JOIN wts USING (item_id) WHERE w > 0 GROUP BY ALL),
    cum AS (SELECT *, sum(pos) OVER b AS tp, sum(neg) OVER b AS fp, sum(pos) OVER a AS cp, sum(neg) OVER a AS cn, sum(pos) OVER (PARTITION BY s, rep) AS allp, sum(neg) OVER (PARTITION BY s, rep) AS alln
      FROM tab WINDOW a AS (PARTITION BY s, rep ORDER BY p), b AS (PARTITION BY s, rep ORDER BY p DESC)),
    reps AS (SELECT s, rep, sum(pos * (cn - neg / 2)) / max(allp * alln) AS roc_auc, sum(pos / allp * tp / (tp + fp)) AS avg_precision,
      2 * sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) / (2 * sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) + sum(CASE WHEN p >= 0.5 THEN neg ELSE 0 END) + sum(CASE WHEN p < 0.5 THEN pos ELSE 0 END)) AS f1_pos,
      sum(CASE WHEN p >= 0.5 THEN pos ELSE 0 END) / sum(pos) AS recall_pos FROM cum GROUP BY s, rep)"""


@query(
    "bootstrap_auc",
    boot_sql(1000, {"a": "p"}, "0") + " SELECT round(quantile_cont(roc_auc, 0.025), 9) AS lo, round(quantile_cont(roc_auc, 0.975), 9) AS hi, count(*) AS replicates FROM reps",
)
def bootstrap_auc(spark, d):
    return R.bootstrap_ci(fx.scored(spark, d), "roc_auc", "y", "p", "item_id").select("replicates", *rounded("lo", "hi"))


@query(
    "bootstrap_delta",
    boot_sql(1000, {"a": "p", "b": "least(p * 0.5 + k / 250.0::DOUBLE, 1)"}, "0") + """, j AS (SELECT b.roc_auc - a.roc_auc AS roc_auc, b.avg_precision - a.avg_precision AS avg_precision,
      b.f1_pos - a.f1_pos AS f1_pos, b.recall_pos - a.recall_pos AS recall_pos FROM reps a JOIN reps b USING (rep) WHERE a.s = 'a' AND b.s = 'b'),
    t AS (UNPIVOT j ON roc_auc, avg_precision, f1_pos, recall_pos INTO NAME metric VALUE delta)
    SELECT metric, round(quantile_cont(delta, 0.025), 9) AS lo, round(quantile_cont(delta, 0.5), 9) AS mid, round(quantile_cont(delta, 0.975), 9) AS hi FROM t GROUP BY metric""",
)
def bootstrap_delta(spark, d):
    s = fx.scored(spark, d).withColumn("p2", F.least(F.col("p") * 0.5 + F.col("k") / 250.0, F.lit(1.0)))
    return R.bootstrap_delta(s, "y", "p", "p2", "item_id").select("metric", *rounded("lo", "mid", "hi"))


@query(
    "bootstrap_metric",
    WITH_SCORED + f""", wts AS (SELECT rep, pow(p - y, 2) AS sq, {POISSON_SQL} AS w FROM (SELECT y, p, rep,
        ('0x' || substr(md5(item_id || ':' || ((rep - 1) // 4) || ':0'), 8 * ((rep - 1) % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM scored, (SELECT unnest(range(1, 1001)) AS rep))),
    m AS (SELECT rep, sum(w * sq) / sum(w) AS brier FROM wts GROUP BY rep)
    SELECT round(quantile_cont(brier, 0.025), 9) AS lo, round(quantile_cont(brier, 0.5), 9) AS mid, round(quantile_cont(brier, 0.975), 9) AS hi, count(*) AS replicates FROM m""",
)
def bootstrap_metric(spark, d):
    """A metric of the caller's own, here the Brier score, over the same resamples."""
    parts = {"n": F.lit(1.0), "sq": F.pow(F.col("p") - F.col("y"), 2)}
    got = R.bootstrap_metric(fx.scored(spark, d), parts, lambda s: s["sq"] / s["n"], "item_id")
    return got.select(*rounded("lo", "mid", "hi"), "replicates")


MEDIAN_SQL = "WITH " + fx.ITEMS_SQL + """, b AS (SELECT author_id, count(value) AS n FROM items GROUP BY author_id HAVING count(value) > 0),
    ms AS (SELECT DISTINCT n, unnest([(n + 1) // 2, n // 2 + 1]) AS m FROM b),
    rs AS (SELECT n, m, unnest(range(1, n + 1)) AS r FROM ms),
    ks AS (SELECT n, m, r, unnest(range(m, n + 1)) AS k FROM rs WHERE r < n),
    tails AS (SELECT n, m, r, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(r / n::DOUBLE) + (n - k) * ln(1 - r / n::DOUBLE))) AS p FROM ks GROUP BY ALL
      UNION ALL SELECT n, m, r, 1 FROM rs WHERE r = n),
    pl AS (SELECT n, m, min(CASE WHEN p >= 0.025 THEN r END) AS l, min(CASE WHEN p >= 0.975 THEN r END) AS u FROM tails GROUP BY ALL),
    o AS (SELECT author_id, value, row_number() OVER (PARTITION BY author_id ORDER BY value) AS i FROM items WHERE value IS NOT NULL),
    ends AS (SELECT b.author_id, b.n, avg(x.value) AS median, avg(y.value) AS lo, avg(z.value) AS hi FROM b JOIN pl ON pl.n = b.n
      JOIN o x ON x.author_id = b.author_id AND x.i = pl.m JOIN o y ON y.author_id = b.author_id AND y.i = pl.l
      JOIN o z ON z.author_id = b.author_id AND z.i = pl.u GROUP BY ALL),
    ci AS (SELECT *, CASE WHEN median > 0 THEN (hi - lo) / median END AS rel_width FROM ends)"""


@query("group_median_ci", MEDIAN_SQL + " SELECT author_id, n, round(median, 9) AS median, round(lo, 9) AS lo, round(hi, 9) AS hi, round(rel_width, 9) AS rel_width FROM ci")
def group_median_ci(spark, d):
    return R.group_median_ci(fx.items(spark, d), "author_id", "value").select("author_id", "n", *rounded("median", "lo", "hi", "rel_width"))


SIZES = ((1, 49), (50, 59), (60, 69), (70, 79), (80, 1_000_000_000))


@query(
    "minimum_group_size",
    MEDIAN_SQL + ", s AS (SELECT *, CASE " + " ".join(f"WHEN n BETWEEN {a} AND {b} THEN '{a}-{b}'" for a, b in SIZES)
    + " END AS bucket FROM ci) SELECT bucket, count(*) AS keys, round(quantile_cont(rel_width, 0.5), 9) AS rel_width FROM s WHERE rel_width IS NOT NULL GROUP BY bucket",
)
def minimum_group_size(spark, d):
    per = R.group_median_ci(fx.items(spark, d), "author_id", "value")
    return R.minimum_group_size(per, SIZES).select("bucket", "keys", *rounded("rel_width"))


# ---- decisions

BANDS_SQL = WITH_SCORED + """, cand AS (SELECT DISTINCT p AS th FROM scored), n AS (SELECT count(*) AS n FROM scored),
    sw AS (SELECT th, sum((p >= th)::INT) AS nge, sum((p >= th)::INT * y) AS pge, sum((p < th)::INT) AS nlt, sum((p < th)::INT * y) AS plt FROM cand, scored GROUP BY th),
    qs AS (SELECT quantile_cont(p, 0.2) AS q20, quantile_cont(p, 0.8) AS q80 FROM scored),
    pick AS (SELECT coalesce(max(CASE WHEN nlt >= greatest(0.05 * n, 20) AND 1 - plt / nullif(nlt, 0)::DOUBLE >= 0.65 THEN th END), any_value(q20)) AS lo,
        coalesce(min(CASE WHEN nge >= greatest(0.05 * n, 20) AND pge / nullif(nge, 0)::DOUBLE >= 0.65 THEN th END), any_value(q80)) AS hi,
        any_value(q20) AS q20, any_value(q80) AS q80 FROM sw, n, qs),
    bands AS (SELECT round(CASE WHEN lo > hi THEN q20 ELSE lo END, 4) AS t_low, round(CASE WHEN lo > hi THEN q80 ELSE hi END, 4) AS t_high FROM pick)"""


@query("decision_bands", BANDS_SQL + " SELECT t_low, t_high FROM bands")
def decision_bands(spark, d):
    return D.decision_bands(fx.scored(spark, d), "y", "p")


@query(
    "band_report",
    BANDS_SQL + """, dec AS (SELECT y, CASE WHEN p >= t_high THEN 'Post' WHEN p < t_low THEN 'Do not post' ELSE 'Unsure' END AS decision FROM scored, bands),
    g AS (SELECT decision, count(*) AS n, avg(y) AS base_rate FROM dec GROUP BY decision)
    SELECT l.decision, coalesce(g.n, 0) AS n, round(coalesce(g.n, 0) / (SELECT n FROM n)::DOUBLE, 9) AS coverage, round(base_rate, 9) AS base_rate
    FROM (VALUES ('Post'), ('Unsure'), ('Do not post')) l(decision) LEFT JOIN g USING (decision)""",
)
def band_report(spark, d):
    s = fx.scored(spark, d)
    return D.band_report(s, "y", "p", D.decision_bands(s, "y", "p")).select("decision", "n", *rounded("coverage", "base_rate"))


@query(
    "threshold_sweep",
    WITH_SCORED + """, r AS (SELECT p, y FROM scored), c AS (SELECT DISTINCT p AS t FROM r)
    SELECT t, sum((p >= t)::INT)::DOUBLE AS n_ge, round(sum((p >= t)::INT * y) / nullif(sum((p >= t)::INT), 0)::DOUBLE, 9) AS precision FROM c, r GROUP BY t""",
)
def threshold_sweep(spark, d):
    s = D.sweep(fx.scored(spark, d), "y", "p")
    return s.select("t", "n_ge", F.round(F.col("pos_ge") / F.col("n_ge"), 9).alias("precision"))


@query(
    "supported_thresholds",
    WITH_SCORED + """, r AS (SELECT p, y FROM scored), c AS (SELECT DISTINCT p AS t FROM r), tot AS (SELECT sum(y) AS allp, sum(1 - y) AS alln FROM r),
    hi AS (SELECT t, sum(y) AS tp, count(*) AS n FROM c JOIN r ON p >= t GROUP BY t), lo AS (SELECT t, sum(1 - y) AS tn, count(*) AS n FROM c JOIN r ON p <= t GROUP BY t),
    h AS (SELECT min(t) AS h FROM hi, tot WHERE tp / n::DOUBLE >= 0.65 AND tp / allp::DOUBLE >= 0.05 AND n >= 20),
    l AS (SELECT max(t) AS l FROM lo, tot WHERE tn / n::DOUBLE >= 0.65 AND tn / alln::DOUBLE >= 0.05 AND n >= 20),
    q AS (SELECT quantile_cont(p, 0.35) AS q35, quantile_cont(p, 0.65) AS q65 FROM r),
    b AS (SELECT CASE WHEN l > 0 AND l < h AND h < 1 THEN l ELSE q35 END AS a, CASE WHEN l > 0 AND l < h AND h < 1 THEN h ELSE q65 END AS z FROM h, l, q),
    f AS (SELECT least(a, 0.45) AS t_low, greatest(z, 0.55) AS t_high FROM b)
    SELECT t_low, t_high, (sum((p >= t_high)::INT) >= 20 AND avg(CASE WHEN p >= t_high THEN y END) >= 0.65 AND sum((p <= t_low)::INT) >= 20
      AND avg(CASE WHEN p <= t_low THEN 1 - y END) >= 0.65)::INT AS reached FROM r, f GROUP BY t_low, t_high""",
)
def supported_thresholds(spark, d):
    return D.supported_thresholds(fx.scored(spark, d), "y", "p")


@query(
    "keep_delete",
    WITH_SCORED + """, g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p),
    c AS (SELECT p, sum(pos) OVER (ORDER BY p) AS cp, sum(neg) OVER (ORDER BY p) AS cn FROM g), tot AS (SELECT sum(y) AS allp, count(*) AS n FROM scored),
    tg AS (SELECT unnest([0.9, 0.8, 0.7, 0.65]::DOUBLE[]) AS target),
    b AS (SELECT target, max(cp + cn) AS k, max(cp) AS lost, max(p) AS threshold FROM tg LEFT JOIN c ON cn / (cp + cn)::DOUBLE >= target GROUP BY target)
    SELECT target, coalesce(k, 0)::BIGINT AS deleted, round(coalesce(k, 0) / n::DOUBLE, 9) AS deleted_share, coalesce(lost, 0)::BIGINT AS hits_lost,
      round(coalesce(lost, 0) / allp::DOUBLE, 9) AS hits_lost_share, threshold FROM b, tot""",
)
def keep_delete(spark, d):
    k = D.keep_delete(fx.scored(spark, d), "y", "p", [0.9, 0.8, 0.7, 0.65])
    return k.select("target", "deleted", "hits_lost", "threshold", *rounded("deleted_share", "hits_lost_share"))


@query("verdict", WITH_SCORED + " SELECT item_id, CASE WHEN p <= 0.3 THEN 'Delete' ELSE 'Keep' END AS verdict FROM scored")
def verdict(spark, d):
    s = fx.items(spark, d).withColumn("p", fx.score())
    return s.select("item_id", D.verdict("p", F.lit(0.3)).alias("verdict"))


@query(
    "f1_threshold",
    WITH_SCORED + """, g AS (SELECT round(0.05 + i * 0.005, 3)::DOUBLE AS th FROM range(181) r(i)),
    c AS (SELECT th, sum((p >= th)::INT * y) AS tp, sum((p >= th)::INT) AS n, sum(y) AS allp FROM g, scored GROUP BY th), f AS (SELECT th AS t, 2 * tp / (n + allp)::DOUBLE AS f1 FROM c)
    SELECT t, round(f1, 9) AS f1 FROM f ORDER BY f1 DESC, t LIMIT 1""",
)
def f1_threshold(spark, d):
    return D.f1_threshold(fx.scored(spark, d), "y", "p").select("t", *rounded("f1"))


@query(
    "cost_bands",
    BANDS_SQL + """, c AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN '-1' ELSE round(c_custkey % 50 / 10.0::DOUBLE + 0.1, 1)::VARCHAR END AS ratio FROM customer),
    r AS (SELECT c_custkey, try_cast(ratio AS DOUBLE) AS r FROM c)
    SELECT c_custkey, CASE WHEN r > 0 THEN round(r / (1 + r), 4) ELSE t_high END AS cost_t_high,
      CASE WHEN r > 0 THEN round(greatest(least(t_low, r / (1 + r) - 0.05), 0.01), 4) ELSE t_low END AS cost_t_low FROM r, bands""",
)
def cost_bands(spark, d):
    k = F.col("c_custkey")
    ratio = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "bad").when(k % 5 == 2, "-1").otherwise(
        F.round(k % 50 / 10.0 + 0.1, 1).cast("string")
    )
    c = fx.table(spark, d, "customer").select("c_custkey", ratio.alias("ratio"))
    bands = D.decision_bands(fx.scored(spark, d), "y", "p")
    return D.cost_bands(c, "ratio", bands).select("c_custkey", "cost_t_high", "cost_t_low")


def conformal_sql(by_class: bool) -> str:
    key = "y" if by_class else "0"
    return WITH_SCORED + f""", cal AS (SELECT {key} AS c, CASE WHEN y = 1 THEN 1 - p ELSE p END AS s FROM scored WHERE split = 'valid'),
    o AS (SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY s) AS rn, count(*) OVER (PARTITION BY c) AS n FROM cal),
    lim AS (SELECT c, min(s) AS q FROM o WHERE rn >= ceil(least(1, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1 GROUP BY c),
    q AS (SELECT max(q) FILTER (WHERE c = 0) AS q0, max(q) FILTER (WHERE c = {'1' if by_class else '0'}) AS q1 FROM lim),
    st AS (SELECT item_id, y, p <= q0 AS i0, (1 - p) <= q1 AS i1 FROM scored, q WHERE split = 'test'),
    sets AS (SELECT item_id, y, '{{' || CASE WHEN i0 AND i1 THEN '0,1' WHEN i0 THEN '0' WHEN i1 THEN '1' ELSE '' END || '}}' AS pred_set,
      CASE WHEN i1 AND NOT i0 THEN 'Post' WHEN i0 AND NOT i1 THEN 'Do not post' ELSE 'Unsure' END AS decision FROM st)"""


def _conformal(spark, d, by_class):
    s = fx.scored(spark, d)
    limits = D.conformal_fit(s.filter("split = 'valid'"), "y", "p", by_class=by_class)
    return D.conformal_sets(s.filter("split = 'test'"), "p", limits)


@query("conformal_sets", conformal_sql(True) + " SELECT item_id, pred_set, decision FROM sets")
def conformal_sets(spark, d):
    return _conformal(spark, d, True).select("item_id", "pred_set", "decision")


@query("conformal_marginal", conformal_sql(False) + " SELECT item_id, pred_set, decision FROM sets")
def conformal_marginal(spark, d):
    return _conformal(spark, d, False).select("item_id", "pred_set", "decision")


@query(
    "conformal_coverage",
    conformal_sql(True) + """ SELECT count(*) AS n, round(avg(contains(pred_set, y::VARCHAR)::INT), 9) AS coverage, round(avg(CASE WHEN y = 0 THEN contains(pred_set, '0')::INT END), 9) AS coverage_0,
      round(avg(CASE WHEN y = 1 THEN contains(pred_set, '1')::INT END), 9) AS coverage_1, round(avg((decision = 'Unsure')::INT), 9) AS abstain FROM sets""",
)
def conformal_coverage(spark, d):
    return D.conformal_coverage(_conformal(spark, d, True), "y").select("n", *rounded("coverage", "coverage_0", "coverage_1", "abstain"))


@query(
    "qcut_buckets",
    """WITH e AS (SELECT list_distinct(quantile_cont(c_acctbal, [0.25, 0.5, 0.75])) AS es FROM customer)
    SELECT c_custkey, len(list_filter(es, lambda x: x < c_acctbal)) AS bucket FROM customer, e""",
)
def qcut_buckets(spark, d):
    return M.qcut(fx.table(spark, d, "customer"), "c_acctbal", 4, "bucket").select("c_custkey", "bucket")


@query(
    "ips_weights",
    """WITH n AS (SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey), j AS (SELECT o_orderkey, size FROM orders JOIN n USING (o_custkey)),
    e AS (SELECT list_distinct(quantile_cont(size, [0.2, 0.4, 0.6, 0.8])) AS es FROM j), b AS (SELECT o_orderkey, len(list_filter(es, lambda x: x < size)) AS bucket FROM j, e),
    s AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket), t AS (SELECT sum(n) AS tot, count(*) AS nb FROM s)
    SELECT o_orderkey, bucket, round(tot / n / nb, 9)::DOUBLE AS weight FROM b JOIN s USING (bucket), t""",
)
def ips_weights_query(spark, d):
    o = fx.table(spark, d, "orders")
    size = o.groupBy("o_custkey").agg(F.count("*").alias("size"))
    return ips_weights(o.join(size, "o_custkey"), "size").select("o_orderkey", "bucket", F.round("weight", 9).alias("weight"))
