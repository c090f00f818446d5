"""Learning queries: encoders, models, folds, calibration, fusion, explanations and the challenger."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import DURATION_BANDS
from tidemark.functions.text import CAPTION_FEATURES, EMOTIONS
from tidemark.operators import decide as D
from tidemark.operators import learn as L
from tidemark.operators import panel as P
from tidemark.operators import splits as Z
from tidemark.operators.guards import LeakageError
from tidemark.operators.history import author_history
from tidemark.operators.joins import left_with_default
from tidemark.operators.metrics import metrics, rank_metrics
from tidemark.operators.scan import exact_quantiles, quantile_table
from tidemark.operators.similar import knn_features, knn_join
from tidemark.plans import experiment as X
from tidemark.plans.decisions import day1_columns
from tidemark.plans.metric_queries import auc_sql
from tidemark.plans.registry import query
from tidemark.session import cut, cut_evenly, fresh_path
from tidemark.sources import fixtures as fx

WITH_SCORED = "WITH " + fx.SCORED_SQL
CONTENT = ["caption", "duration", "timing"]
FULL = [*CONTENT, "topic", "music", "hashtags", "author_history"]


def model_items(spark, d) -> DataFrame:
    """Items with caption, tags, label and split in the columns the feature blocks expect, written once."""
    c = fx.captions(spark, d)
    c = P.temporal_split(P.within_group_label(c, "value", "author_id", "centred", "y"), "t")
    k = F.col("k")
    return cut_evenly(
        c.select(
            "item_id", "author_id", "ts", "t", "topic", "y", "split", "value", F.col("caption").alias("desc"),
            (k % 97).cast("double").alias("duration"), k.alias("music_id"), F.col("value").alias("views_at_H"),
            F.lit(100.0).alias("followers_at_post"), F.array("topic", F.concat(F.lit("t"), (k % 20).cast("string"))).alias("tags"),
            F.lit(None).cast("string").alias("transcript"), F.col("caption").alias("text"),
        ),
        fx.table(spark, d, "events").count(),
    )


def numeric_items(spark, d) -> tuple[DataFrame, list[str]]:
    """Items with content features only, folds included."""
    ready, names = X.build_blocks(model_items(spark, d), CONTENT, F.col("split") == "train", "y")
    folded = Z.group_kfold(ready, "author_id")
    return cut(folded.select("item_id", "author_id", "y", "split", "fold", "desc", "transcript", *names)), names


def labelled_docs(spark, d) -> DataFrame:
    return fx.table(spark, d, "documents").join(fx.table(spark, d, "labels"), "doc_id").select(
        "doc_id", "text", "source", F.col("quality").alias("y"), (F.col("doc_id") % 4).alias("fold")
    )


@query("tfidf_svd")
def tfidf_svd(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    v = L.tfidf_svd(docs, "text", F.col("doc_id") % 4 != 0)
    return v.select("doc_id", F.size("sv").alias("dim"), *[F.round(F.col("sv")[i], 6).alias(f"sv{i}") for i in range(3)])


@query("tfidf_bigrams")
def tfidf_bigrams(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "text")
    v = L.tfidf_svd(docs, "text", F.col("doc_id") % 4 != 0, terms=4000, bigrams=True)
    return v.select("doc_id", F.size("sv").alias("dim"), F.round(F.col("sv")[0], 6).alias("sv0"))


@query("pca_vectors")
def pca_vectors(spark, d):
    e = fx.table(spark, d, "embeddings")
    p = L.pca(e, "embedding", F.col("vec_id") % 5 != 0, "pc")
    return p.select("vec_id", F.round(F.abs(F.col("pc")[0]), 6).alias("pc0"), F.size("pc").alias("dim"))


@query("cluster_prior")
def cluster_prior(spark, d):
    e = fx.table(spark, d, "embeddings").withColumn("y", F.col("label") % 2)
    c = L.cluster_prior(e, "embedding", "y", F.col("vec_id") % 5 != 0)
    return c.select("vec_id", "cluster", F.round("cluster_rate", 6).alias("cluster_rate"), F.round("cluster_size_log", 6).alias("cluster_size_log"))


def _temporal(spark, d, names, **params):
    items, feats = numeric_items(spark, d)
    train, test = items.filter("split = 'train'"), items.filter("split = 'test'")
    gaps = L.with_gaps(items, feats)  # of any split: a feature whole in train may lack values in test
    rows = [
        metrics(L.predict(L.fit(train, n, feats, "y", gaps=gaps, **params.get(n, {})), test), "y", "p").select(
            F.lit(n).alias("model"), "n", F.round("roc_auc", 6).alias("roc_auc"), F.round("brier", 6).alias("brier")
        )
        for n in names
    ]
    return reduce(DataFrame.unionByName, rows)


@query("logit_temporal")
def logit_temporal(spark, d):
    return _temporal(spark, d, ["logit"])


@query("gbt_temporal")
def gbt_temporal(spark, d):
    return _temporal(spark, d, ["gbt"], gbt={"maxIter": 20})


@query("model_families")
def model_families(spark, d):
    return _temporal(
        spark, d, ["mlp", "forest", "gaussian_nb", "linear_svc", "balanced_logit"],
        forest={"numTrees": 300},
    )


@query(
    "knn_vote",
    f"""WITH n AS (SELECT q.vec_id, (q.label % 2)::INT AS y, (b.label % 2)::INT AS hit,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rk
      FROM embeddings q JOIN embeddings b ON b.vec_id % 5 <> 0 AND b.vec_id <> q.vec_id),
    v AS (SELECT vec_id, any_value(y) AS y, sum(hit) / count(*)::DOUBLE AS p FROM n WHERE rk <= 50 GROUP BY vec_id), a AS ({auc_sql('v')})
    SELECT (SELECT count(*) FROM v) AS n, round(roc_auc, 9) AS roc_auc, (SELECT round(avg((p - y) * (p - y)), 9) FROM v) AS brier,
      (SELECT round(avg((y = (p >= 0.5)::INT)::INT::DOUBLE), 9) FROM v) AS accuracy FROM a""",
)
def knn_vote(spark, d):
    """Share of positive labels among the nearest train vectors, as a classifier."""
    e = fx.table(spark, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int"))
    bank = e.filter("vec_id % 5 <> 0")  # the train rows; every row is scored, none finds itself
    near = knn_features(
        knn_join(e, bank.withColumnRenamed("y", "hit"), "vec_id", "vec_id", "embedding", "embedding", 50, payload=["hit"]),
        "vec_id", "hit",
    )
    return metrics(e.join(near, "vec_id"), "y", "knn_success").select(
        "n", *[F.round(c, 9).alias(c) for c in ("roc_auc", "brier", "accuracy")]
    )


@query("sample_weighted_fit")
def sample_weighted_fit(spark, d):
    items, feats = numeric_items(spark, d)
    size = items.groupBy("author_id").agg(F.count("*").alias("size"))
    train = Z.ips_weights(items.filter("split = 'train'").join(size, "author_id"), "size")
    test = items.filter("split = 'test'")
    rows = [
        metrics(L.predict(L.fit(train, "logit", feats, "y", weight=w), test), "y", "p").select(
            F.lit(w or "none").alias("weighting"), "n", F.round("roc_auc", 6).alias("roc_auc")
        )
        for w in (None, "weight")
    ]
    return reduce(DataFrame.unionByName, rows)


@query("calibrated_scores")
def calibrated_scores(spark, d):
    s = fx.scored(spark, d)
    valid, test = s.filter("split = 'valid'"), s.filter("split = 'test'")
    for method in ("isotonic", "sigmoid"):
        test = L.apply_calibration(test, "p", L.calibrate(valid, "p", "y", method), f"p_{method}")
    return test.select("item_id", "y", "p", F.round("p_isotonic", 6).alias("p_isotonic"), F.round("p_sigmoid", 6).alias("p_sigmoid"))


@query("out_of_fold")
def out_of_fold(spark, d):
    items, feats = numeric_items(spark, d)
    return L.out_of_fold(items, "logit", feats, "y", "item_id").select("item_id", "fold", "y", F.round("p", 6).alias("p"))


@query("experiment_run")
def experiment_run(spark, d):
    return X.run_experiment(model_items(spark, d), FULL, "logit", replicates=1000).drop("seconds")


@query("staged_ablation")
def staged_ablation(spark, d):
    stages = [("caption", ["caption"]), ("+timing", ["caption", "timing"]), ("+history", ["caption", "timing", "author_history"])]
    return X.ablation(model_items(spark, d), stages, "logit").drop("seconds")


@query("add_one_ablation")
def add_one_ablation(spark, d):
    return X.ablation(model_items(spark, d), X.add_one(["caption"], ["topic", "music"]), "logit").drop("seconds")


@query("drop_group_ablation")
def drop_group_ablation(spark, d):
    return X.ablation(model_items(spark, d), X.drop_group(["caption", "timing"]), "logit").drop("seconds")


@query("theory_table")
def theory_table(spark, d):
    families = [("caption", ["caption"]), ("timing", ["timing"]), ("recency", ["author_recency"]), ("trend", ["trend"])]
    return X.ablation(model_items(spark, d), families, "logit", protocols=["cross_author"]).drop("seconds", "delta")


@query("target_contrast")
def target_contrast(spark, d):
    items = P.absolute_label(model_items(spark, d), "value", 0.7, "y_absolute")
    configs = {"content": ["caption"], "history": ["author_history"]}
    return X.target_contrast(items, configs, ["y", "y_absolute"], "logit").drop("seconds")


@query("semantic_block")
def semantic_block(spark, d):
    return X.run_experiment(
        model_items(spark, d), ["caption", "semantic"], "logit"
    ).drop("seconds")


@query("stacking")
def stacking(spark, d):
    items, feats = numeric_items(spark, d)
    oof = {
        "logit": cut(L.out_of_fold(items, "logit", feats, "y", "item_id")),
        "nb": cut(L.out_of_fold(items, "gaussian_nb", feats, "y", "item_id")),
        "forest": cut(L.out_of_fold(items, "forest", feats, "y", "item_id")),
    }
    stacked = L.stack_oof(oof, "item_id", "y")
    return metrics(stacked, "y", "p_stack").select("n", F.round("roc_auc", 6).alias("roc_auc"), F.round("brier", 6).alias("brier"))


@query(
    "mean_ensemble",
    WITH_SCORED + " SELECT item_id, round(CASE WHEN k % 5 = 0 THEN p ELSE (p + k / 100.0::DOUBLE) / 2 END, 9) AS p_mean FROM scored",
)
def mean_ensemble(spark, d):
    s = fx.items(spark, d).withColumn("p", fx.score()).withColumn("p2", F.when(F.col("k") % 5 != 0, F.col("k") / 100.0))
    return L.mean_ensemble(s, ["p", "p2"]).select("item_id", F.round("p_mean", 9).alias("p_mean"))


@query(
    "early_fusion",
    """SELECT d.doc_id, len(coalesce(e.embedding, [])) + 2 AS dim, round(coalesce(list_sum(e.embedding::DOUBLE[]), 0) + d.n_chars, 4) AS total
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def early_fusion(spark, d):
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = fx.table(spark, d, "documents").select("doc_id", F.array(F.col("n_chars").cast("double"), F.lit(0.0)).alias("meta"))
    j = docs.join(v, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))
    f = L.early_fusion(j, ["embedding", "meta"], "fused")
    total = F.aggregate("fused", F.lit(0.0), lambda a, x: a + x)
    return f.select("doc_id", F.size("fused").cast("bigint").alias("dim"), F.round(total, 4).alias("total"))


@query("search")
def search(spark, d):
    items, feats = numeric_items(spark, d)
    space = {"regParam": [1e-5, 1e-4, 1e-3, 0.01, 0.1], "elasticNetParam": [0.0, 0.5], "maxIter": [5, 10, 20]}
    s = L.halving_search(items, "logit", feats, "y", "item_id", space)
    return s.select("trial", "rung", F.round("share", 6).alias("share"), "params", F.round("mean_auc", 6).alias("mean_auc"), "chosen")


@query(
    "select_by_brier",
    WITH_SCORED + """, b AS (SELECT 'score' AS model, avg((p - y) * (p - y)) AS brier FROM scored UNION ALL SELECT 'half', avg((0.5 - y) * (0.5 - y))::DOUBLE FROM scored)
    SELECT model, round(brier, 12) AS brier, (brier = min(brier) OVER ())::INT AS chosen FROM b""",
)
def select_by_brier(spark, d):
    s = fx.scored(spark, d)
    b = L.select_by_brier({"score": s, "half": s.withColumn("p", F.lit(0.5))}, "y")
    return b.select("model", F.round("brier", 12).alias("brier"), "chosen")


@query("permutation_importance")
def permutation_importance(spark, d):
    items, feats = numeric_items(spark, d)
    model = L.fit(items.filter("split = 'train'"), "logit", feats, "y")
    model_table = L.permutation_importance(model, items.filter("split = 'valid'"), feats, "y", "item_id")
    return model_table.select("feature", F.round("importance", 6).alias("importance"), F.round("spread", 6).alias("spread"))


LINEAR = (("value", 0.7), ("k", -0.3), ("p", 1.1))


@query(
    "linear_contributions",
    WITH_SCORED + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f, _ in LINEAR)
    + " FROM scored WHERE split = 'train') " + " UNION ALL ".join(
        f"SELECT item_id, '{f}' AS feature, round({c}::DOUBLE * ({f} - m_{f}) / s_{f}, 6) + 0.0::DOUBLE AS contribution FROM scored, m" for f, c in LINEAR
    ),
)
def linear_contributions(spark, d):
    s = fx.scored(spark, d)
    c = L.linear_contributions(s, "item_id", [f for f, _ in LINEAR], _linear_table(s))
    return c.select("item_id", "feature", (F.round("contribution", 6) + 0.0).alias("contribution"))


def _linear_table(s: DataFrame) -> DataFrame:
    """A declared linear model with train mean and deviation per feature, as rows."""
    train = s.filter("split = 'train'")
    one = train.agg(*[e for f, _ in LINEAR for e in (F.avg(f).alias(f"m_{f}"), F.stddev_samp(f).alias(f"s_{f}"))])
    cells = ", ".join(f"'{f}', m_{f}, m_{f}, s_{f}, CAST({c} AS DOUBLE), CAST(-0.2 AS DOUBLE)" for f, c in LINEAR)
    return one.selectExpr(f"stack({len(LINEAR)}, {cells}) AS (feature, median, mean, std, coef, intercept)")


@query(
    "linear_scorer",
    WITH_SCORED + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f, _ in LINEAR)
    + " FROM scored WHERE split = 'train') SELECT item_id, round(1 / (1 + exp(-(-0.2::DOUBLE + "
    + " + ".join(f"{c}::DOUBLE * ({f} - m_{f}) / s_{f}" for f, c in LINEAR) + "))), 6) AS p_linear FROM scored, m",
)
def linear_scorer(spark, d):
    s = fx.scored(spark, d)
    return L.linear_score(s, [f for f, _ in LINEAR], _linear_table(s), "p_linear").select("item_id", F.round("p_linear", 6).alias("p_linear"))


@query(
    "top_factors",
    WITH_SCORED + ", m AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f, _ in LINEAR)
    + " FROM scored WHERE split = 'train'), c AS (" + " UNION ALL ".join(
        f"SELECT item_id, '{'text' if f == 'k' else f}' AS factor, {c}::DOUBLE * ({f} - m_{f}) / s_{f} AS v FROM scored, m" for f, c in LINEAR
    ) + """), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY abs(v) DESC, factor) AS rank FROM c)
    SELECT item_id, rank, factor, round(v, 6) + 0.0::DOUBLE AS contribution FROM r WHERE rank <= 2""",
)
def top_factors(spark, d):
    s = fx.scored(spark, d)
    t = L.top_factors(s, "item_id", [f for f, _ in LINEAR], _linear_table(s), n=2, bucket={"k": "text"})
    return t.select("item_id", F.col("rank").cast("bigint").alias("rank"), "factor", (F.round("contribution", 6) + 0.0).alias("contribution"))


@query("linear_contributions_fitted")
def linear_contributions_fitted(spark, d):
    items, feats = numeric_items(spark, d)
    model = L.fit(items.filter("split = 'train'"), "logit", feats, "y")
    table = L.linear_table(model, feats, spark)
    return L.linear_contributions(items, "item_id", feats, table).groupBy("feature").agg(
        F.round(F.avg(F.abs("contribution")), 6).alias("mean_size")
    )


@query("median_sensitivity")
def median_sensitivity(spark, d):
    items, feats = numeric_items(spark, d)
    train = items.filter("split = 'train'")
    model = L.fit(train, "logit", feats, "y")
    one = quantile_table(train, [], {c: (c, 0.5) for c in feats}).first()
    s = L.median_sensitivity(model, items, "item_id", feats, one.asDict())
    return s.select("item_id", "feature", F.round("delta", 6).alias("delta"))


@query("score_batch")
def score_batch(spark, d):
    items, feats = numeric_items(spark, d)
    model = L.fit(items.filter("split = 'train'"), "logit", feats, "y")
    valid = cut(L.predict(model, items.filter("split = 'valid'"), "p_raw"))
    cal = L.calibrate(valid, "p_raw", "y")
    bands = D.decision_bands(L.apply_calibration(valid, "p_raw", cal, "p"), "y", "p")
    scored = X.score_batch(
        items.filter("split = 'test'").withColumn("duration", F.col("duration_s")), model, cal, bands
    )
    return scored.select("item_id", F.round("p", 6).alias("p"), "decision", F.array_join("warnings", ";").alias("warnings"), "rationale")


BASE_SQL = WITH_SCORED + """, tr AS (SELECT * FROM scored WHERE split = 'train'), pr AS (SELECT author_id, avg(y) AS m FROM tr GROUP BY author_id), g AS (SELECT avg(y) AS g FROM tr),
    te AS (SELECT s.y, coalesce(m, g) AS p_author, g AS p_majority FROM scored s LEFT JOIN pr USING (author_id), g WHERE split = 'test'),
    tall AS (SELECT 'p_author' AS baseline, y, p_author AS p FROM te UNION ALL SELECT 'p_majority', y, p_majority FROM te)"""


@query(
    "baselines",
    BASE_SQL + f""", a AS ({auc_sql('tall', by='baseline')}), b AS (SELECT baseline, count(*) AS n, avg((p - y) * (p - y)) AS brier FROM tall GROUP BY baseline)
    SELECT baseline, n, round(roc_auc, 9) AS roc_auc, round(brier, 9) AS brier FROM a JOIN b USING (baseline)""",
)
def baselines(spark, d):
    b = X.baselines(fx.scored(spark, d))
    return b.select("baseline", "n", F.round("roc_auc", 9).alias("roc_auc"), F.round("brier", 9).alias("brier"))


@query("caption_baseline")
def caption_baseline(spark, d):
    b = X.baselines(model_items(spark, d), caption="desc")
    return b.select("baseline", "n", F.round("roc_auc", 6).alias("roc_auc"), F.round("brier", 6).alias("brier"))


RUNS = {
    ("content", "pre"): (["caption", "meta", "missing", "emotion", "vector:vec,64", "scores"], len(CAPTION_FEATURES) + 4 + 2 + len(EMOTIONS) + 2 + 64 + 1),
    ("first day", "day1"): (["caption", "day1", "retrieval:10"], len(CAPTION_FEATURES) + 4 + 2),
    ("first day, basic", "day1"): (["duration", "timing", "day1_basic"], 1 + len(DURATION_BANDS) + 7 + 3),
}


@query(
    "experiment_log",
    WITH_SCORED + ", r AS (" + " UNION ALL ".join(
        f"SELECT '{name}' AS label, '{stage}' AS stage, {n} AS n_features" for (name, stage), (_, n) in RUNS.items()
    ) + """) SELECT label, stage, protocol, n_features, CASE protocol WHEN 'temporal' THEN (SELECT count(*) FROM scored WHERE split = 'test') ELSE (SELECT count(*) FROM scored) END AS n,
      1 AS scored FROM r, (VALUES ('cross_author'), ('temporal')) p(protocol) UNION ALL SELECT 'leak', 'pre', 'refused', 0, 0, 0""",
)
def experiment_log(spark, d):
    """The log of a run per stage and set of blocks; a run with a leaking feature is refused and leaves no row."""
    e = fx.table(spark, d, "embeddings")
    size, path = e.count(), fresh_path(spark, "runs")
    items = model_items(spark, d)
    items = items.withColumn("_vec", F.col("item_id") % size).join(e.select(F.col("vec_id").alias("_vec"), F.col("embedding").alias("vec")), "_vec")
    items = items.withColumn("likes", F.col("value") / 10).withColumns(day1_columns("value", ["likes"])).withColumns(
        {c: F.when(F.col("item_id") % 4 != 0, (F.col("item_id") % (7 + i)) / 10.0) for i, c in enumerate([*EMOTIONS, "speaking_rate"])}
        | {"is_english": F.col("item_id") % 2 == 0, "created_by_ai": F.lit(None).cast("boolean"), "is_ads": F.col("item_id") % 5 == 0, "ratio": F.lit("0.5625")}
    )
    items = cut(items)
    X.median_filled_block("scores", items.filter(F.col("value") > 20).select("item_id", (F.col("item_id") % 13).cast("double").alias("mood")), ["mood"])
    for (name, stage), (specs, _) in RUNS.items():
        X.run_experiment(items, specs, "logit", stage=stage, name=name, log=path)
    refused = 0
    try:
        X.run_experiment(items, ["caption", "day1"], "logit", stage="pre", name="leak", log=path)
    except LeakageError:
        refused = 1
    log = spark.read.parquet(path)
    rows = log.select("label", "stage", "protocol", F.col("n_features").cast("int").alias("n_features"), "n", F.col("roc_auc").isNotNull().cast("int").alias("scored"))
    leak = spark.range(refused).select(
        F.lit("leak").alias("label"), F.lit("pre").alias("stage"), F.lit("refused").alias("protocol"), F.lit(0).alias("n_features"),
        F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("scored"),
    )
    return rows.unionByName(leak)


@query(
    "cold_author",
    WITH_SCORED + f""", h AS (SELECT *, count(*) OVER (PARTITION BY author_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1209600000000 PRECEDING) AS prior FROM scored),
    c AS (SELECT y, p, CASE WHEN prior <= 2 THEN 'cold' ELSE 'warm' END AS slice FROM h), a AS ({auc_sql('c', by='slice')})
    SELECT slice, round(roc_auc, 9) AS roc_auc, (SELECT count(*) FROM c x WHERE x.slice = a.slice) AS n FROM a""",
)
def cold_author(spark, d):
    s = fx.scored(spark, d).withColumn("followers", F.lit(1.0))
    h = author_history(s, "author_id", "t", "value", "followers")
    sliced = h.withColumn("slice", F.when(F.round(F.expm1("author_nprior_log")) <= 2, "cold").otherwise("warm"))
    size = sliced.groupBy("slice").agg(F.count("*").alias("n"))
    return rank_metrics(sliced, "y", "p", ["slice"]).join(size, "slice").select("slice", "n", F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "label_refit_cv",
    WITH_SCORED + ", " + ", ".join(
        f"""t{k} AS (SELECT author_id, quantile_cont(value, 0.5) AS thr FROM scored WHERE item_id % 4 <> {k} GROUP BY author_id HAVING count(*) >= 20),
        l{k} AS (SELECT {k} AS fold, p, (value > coalesce(thr, (SELECT quantile_cont(value, 0.5) FROM scored WHERE item_id % 4 <> {k})))::INT AS y
        FROM scored LEFT JOIN t{k} USING (author_id) WHERE item_id % 4 = {k})""" for k in range(4)
    ) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM l{k}" for k in range(4)) + f"), a AS ({auc_sql('u', by='fold')}) SELECT fold, round(roc_auc, 9) AS roc_auc FROM a",
)
def label_refit_cv(spark, d):
    s = fx.items(spark, d).withColumns({"p": fx.score(), "fold": (F.col("item_id") % 4).cast("int")})
    parts = []
    for k in range(4):
        train = s.filter(F.col("fold") != k)
        thr = P.fit_thresholds(train, "author_id", "value", min_items=20)
        test = P.label_by_threshold(s.filter(F.col("fold") == k), "author_id", "value", thr, P.global_threshold(train, "value"), "y")
        parts.append(test.select("fold", "p", "y"))
    m = rank_metrics(reduce(DataFrame.unionByName, parts), "y", "p", ["fold"])
    return m.select("fold", F.round("roc_auc", 9).alias("roc_auc"))


@query(
    "assessment_table",
    WITH_SCORED + """ SELECT item_id, topic, CASE WHEN p >= 0.6 THEN 'Post' WHEN p < 0.3 THEN 'Do not post' ELSE 'Unsure' END AS decision, y,
    CASE WHEN p >= 0.6 THEN (y = 1)::INT::DOUBLE WHEN p < 0.3 THEN (y = 0)::INT::DOUBLE END AS correct FROM scored""",
)
def assessment_table(spark, d):
    s = fx.scored(spark, d)
    bands = spark.range(1).select(F.lit(0.3).alias("t_low"), F.lit(0.6).alias("t_high"))
    a = X.assessment(s.select("item_id", "y", "p"), fx.items(spark, d).select("item_id", "topic"), bands)
    return a.select("item_id", "topic", "decision", "y", F.col("correct").cast("double").alias("correct"))


SIGNS = "abcdefghijklmnopqrstuvwxyz .,!?0123456789"


def sign_shares(texts: list[str]) -> np.ndarray:
    """A small encoder: the share of each sign in a text."""
    counts = np.array([[t.count(c) for c in SIGNS] for t in texts], np.float64).reshape(len(texts), len(SIGNS))
    return counts / np.maximum(np.array([[len(t)] for t in texts], np.float64).reshape(len(texts), 1), 1)


@query(
    "encoder_plugin",
    f"""WITH s AS (SELECT doc_id, greatest(length(coalesce(text, '')), 1) AS n, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, {len(SIGNS)} AS dim, round((length(t) - length(replace(t, 'e', ''))) / n::DOUBLE, 6) AS share_e,
      round((length(t) - length(replace(t, ' ', ''))) / n::DOUBLE, 6) AS share_blank FROM s""",
)
def encoder_plugin(spark, d):
    """Vectors of an encoder that the caller supplies."""
    docs = L.encode_text(fx.table(spark, d, "documents").select("doc_id", "text"), "text", sign_shares, len(SIGNS), "vec")
    at = lambda c: F.round(F.col("vec")[SIGNS.index(c)], 6)
    return docs.select("doc_id", F.size("vec").alias("dim"), at("e").alias("share_e"), at(" ").alias("share_blank"))


@query("transfer_head")
def transfer_head(spark, d):
    """A head fitted on the vectors of labelled documents predicts for web pages: two tables, one encoder."""
    docs = labelled_docs(spark, d).select("doc_id", "text", "y")
    source = L.encode_text(docs, "text", sign_shares, len(SIGNS), "vec")
    pages = fx.table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    target = L.encode_text(pages, "text", sign_shares, len(SIGNS), "vec")
    return L.transfer_head(source, target, "vec", "y", "pred_quality").select("page_id", F.round("pred_quality", 6).alias("pred_quality"))


@query("text_quality_model")
def text_quality_model(spark, d):
    """Out-of-fold quality prediction from text vectors, the encoder refitted inside every fold."""
    docs = labelled_docs(spark, d)

    def encode(df, train):
        vec = L.TextEncoder().fit(df.filter(train), "text")
        return L.spread_vector(vec.transform(df, "text", "_sv"), "_sv", "sv", vec.k)[0]

    oof = L.out_of_fold(docs, "logit", [f"sv{i}" for i in range(60)], "y", "doc_id", encode=encode)
    return metrics(oof, "y", "p").select("n", F.round("roc_auc", 6).alias("roc_auc"), F.round("brier", 6).alias("brier"))


@query("challenger_report")
def challenger_report(spark, d):
    items = model_items(spark, d)
    base = items.filter("split IN ('train', 'test')")
    matured = items.filter("split = 'valid'").drop("split")
    return X.challenger_report(base, matured, ["caption", "timing", "duration"], "logit")


@query(
    "score_quantiles",
    WITH_SCORED + " SELECT split, round(quantile_cont(p, 0.5), 9) AS p50, round(quantile_cont(p, 0.9), 9) AS p90 FROM scored GROUP BY split",
)
def score_quantiles(spark, d):
    q = exact_quantiles(fx.scored(spark, d), ["split"], "p", {"p50": 0.5, "p90": 0.9})
    return q.select("split", F.round("p50", 9).alias("p50"), F.round("p90", 9).alias("p90"))

