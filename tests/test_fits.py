"""Fits, experiments and resamples do shared work once: dealt rows, folds, blocks, joins and draws."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learn as L
from tidemark.operators import resample as R
from tidemark.plans import experiment as X
from tidemark.session import cut_evenly


def one_by_one(ids, n, seed):
    tails = [f"{b}:{seed}" for b in range((n + 3) // 4)]
    hexes = [hashlib.md5((("" if i is None else f"{i}:") + t).encode()).hexdigest() for i in ids for t in tails]
    u = np.array([[int(h[8 * j : 8 * j + 8], 16) / 2**32 for j in range(4)] for h in hexes]).reshape(len(ids), -1)[:, :n]
    return sum((u >= e).astype(int) for e in R.poisson_edges())


def test_weights_are_those_of_single_hashes_and_hash_rows_together(monkeypatch):
    ids = [None, "", "0", "7", "-12", "ключ", *["x" * k for k in range(40, 70)], *[str(i) for i in range(90, 400, 3)]]
    for n, seed in ((1, 0), (7, "42"), (50, "a-long-seed"), (401, 0)):
        assert (R.drawn_weights(ids, n, seed) == one_by_one(ids, n, seed)).all(), (n, seed)
    calls, real = [], hashlib.md5
    monkeypatch.setattr(R.hashlib, "md5", lambda text: calls.append(1) or real(text))
    R.drawn_weights([str(i) for i in range(100)], 1000, 0)
    assert not calls


def test_few_large_files_become_a_file_per_core(spark):
    df = spark.range(200_000).coalesce(1)
    got = cut_evenly(df, 200_000)
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in tasks) == 200_000
    assert len(cut_evenly(df.limit(500), 500).inputFiles()) == 1


def featured(spark, n=400):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=n), rng.normal(size=n)
    a[::17], b[::13] = np.nan, np.nan
    pdf = pd.DataFrame({
        "item_id": np.arange(n), "author_id": np.arange(n) % 23, "fold": np.arange(n) % 4, "a": a, "b": b,
        "y": (np.nan_to_num(a) + rng.normal(size=n) > 0).astype(int), "z": rng.integers(0, 2, n),
        "split": np.where(np.arange(n) % 5 == 0, "test", "train"), "wide": "x" * 50,
    })
    df = spark.createDataFrame(pdf)
    return df.withColumn("b", F.when(~F.isnan("b"), F.col("b")))  # gaps: NaN in a, null in b


@pytest.mark.parametrize("name", ["logit", "linear_svc", "gaussian_nb"])
def test_sensitivity_scores_arrays_as_the_model_scores_columns(spark, name):
    df = featured(spark)
    model = L.fit(df, name, ["a", "b"], "y")
    def by_columns(rows):
        return {r.item_id: r.p for r in L.predict(model, rows).collect()}

    own = by_columns(df)
    cells = L.predict_cells(model, df.select("item_id", F.array("a", "b").alias("c")), "c")
    assert {r.item_id: r.p for r in cells.collect()} == pytest.approx(own, abs=1e-12)
    medians = {"a": 0.25, "b": -0.5}
    table = L.median_sensitivity(model, df, "item_id", ["a", "b"], medians)
    assert "_f0" not in table._jdf.queryExecution().analyzed().toString()  # no column per feature
    got = {(r.item_id, r.feature): r.delta for r in table.collect()}
    want = {(i, f): own[i] - p for f, m in medians.items() for i, p in by_columns(df.withColumn(f, F.lit(m))).items()}
    assert got == pytest.approx(want, abs=1e-12)


def test_stacking_joins_the_scores_once(spark):
    df, read = featured(spark), spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    scores = {n: df.select("item_id", "y", "fold", F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias("p")) for n, c in (("one", "a"), ("two", "b"))}
    scores["one"] = scores["one"].mapInPandas(count, scores["one"].schema)
    stacked = L.stack_oof(scores, "item_id", "y").collect()
    assert len(stacked) == 400 and read.value == 400
    assert all(0 < r.p_stack < 1 and not math.isnan(r.p_stack) for r in stacked)


def test_contrast_and_ablation_share_blocks_and_folds(spark, monkeypatch):
    df, built, dealt = featured(spark).drop("fold"), [], []

    @X.block("probe")
    def _probe(df, train, label, arg):
        built.append(label)
        return df, ["a", "b"]

    real = X.fold_table
    monkeypatch.setattr(X, "fold_table", lambda *a, **k: dealt.append(1) or real(*a, **k))
    try:
        alone = {t: X.run_experiment(df, ["probe"], "logit", label=t).collect() for t in ("y", "z")}
        built.clear()
        both = X.target_contrast(df, {"set": ["probe"]}, ["y", "z"], "logit").collect()
        assert len(built) == 1 and len(dealt) == 1
        kept, _ = X._frozen(df, ["probe"], ["y"], "pre", "item_id", "author_id", 4, True)
        assert set(kept.columns) == {"item_id", "y", "fold", "split", "a", "b"}
        stages = X.ablation(df, [("first", ["probe"]), ("again", ["probe"])], "logit").collect()
        assert len(dealt) == 2
    finally:
        del X.BLOCKS["probe"]
    for t, rows in alone.items():
        want = {r.protocol: (r.n, r.roc_auc, r.brier) for r in rows}
        assert {r.protocol: (r.n, r.roc_auc, r.brier) for r in both if r.target == t} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    want = {r.protocol: r.roc_auc for r in alone["y"]}
    assert len(stages) == 4 and all(r.roc_auc == pytest.approx(want[r.protocol], abs=1e-9) for r in stages)


def test_a_block_that_repeats_rows_gets_folds_of_its_own_sizes(spark):
    df = featured(spark).drop("fold")

    @X.block("repeat")
    def _repeat(df, train, label, arg):
        times = F.when(F.col("author_id") % 3 == 0, 4).otherwise(1)
        return df.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n"), ["a", "b"]

    try:
        want = {r.protocol: (r.n, r.roc_auc) for r in X.run_experiment(df, ["repeat"], "logit").collect()}
        got = X.ablation(df, [("one", ["repeat"])], "logit").collect()
    finally:
        del X.BLOCKS["repeat"]
    assert {r.protocol: (r.n, r.roc_auc) for r in got} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_only_features_with_gaps_are_imputed_and_scores_are_the_same(spark):
    df = featured(spark).withColumns({"full": F.col("item_id") % 7 / 3.0, "flag": F.col("item_id") % 2 == 0})
    names = ["full", "a", "flag", "b"]
    gaps = L.with_gaps(df, names)
    assert gaps == ["a", "b"] and L.with_gaps(df, ["full"]) == []
    assert L.with_gaps(df.withColumn("text", F.lit("1.5")), ["text", "full"]) == ["text"]  # no number, so it is cast
    assert L.with_gaps(df.limit(0), names) == names
    for some in (gaps, ["b", "a"]):
        plain, short = L.fit(df, "logit", names, "y"), L.fit(df, "logit", names, "y", gaps=some)
        assert len(plain.stages[1].getInputCols()) == 4 and len(short.stages[1].getInputCols()) == 2
        want, got = ({r.item_id: r.p for r in L.predict(m, df).collect()} for m in (plain, short))
        assert got == pytest.approx(want)
    whole = L.fit(df, "logit", ["full", "flag"], "y", gaps=[])
    assert len(whole.stages) == 3
    want = {r.item_id: r.p for r in L.predict(L.fit(df, "logit", ["full", "flag"], "y"), df).collect()}
    assert {r.item_id: r.p for r in L.predict(whole, df).collect()} == pytest.approx(want)


def no_imputer(monkeypatch):
    def refuse(**kw):
        raise AssertionError(f"imputed {kw['inputCols']}")

    monkeypatch.setattr(L, "Imputer", refuse)


def test_search_fills_nothing_that_is_full_and_a_rung_reads_its_share(spark, monkeypatch):
    df = featured(spark).withColumns({"u": F.col("item_id") % 7 / 3.0, "v": F.col("item_id") % 2 + F.col("y")})
    no_imputer(monkeypatch)
    read, real = [], L.metrics

    def metrics(rows, *args, **kw):
        read.append(spark.read.parquet(*rows.inputFiles()).count())
        return real(rows, *args, **kw)

    monkeypatch.setattr(L, "metrics", metrics)
    table = L.halving_search(df, "logit", ["u", "v"], "y", "item_id", {"regParam": [1e-4, 1.0]}, trials=2, folds=2).toPandas()
    assert table.groupby("rung").size().tolist() == [2, 1, 1] and table["mean_auc"].notna().all()
    assert len(read) == 4 and 0 < read[0] == read[1] < 200 < read[2] < 500 and read[3] == 800  # two folds of 400 rows


def test_a_folds_encoded_rows_are_written_once_and_not_imputed(spark, monkeypatch):
    df = featured(spark).withColumn("u", F.col("item_id") % 7 / 3.0).drop("a", "b")
    no_imputer(monkeypatch)
    written, real = [], L.cut
    monkeypatch.setattr(L, "cut", lambda rows: written.append(rows.columns) or real(rows))
    oof = L.out_of_fold(df, "logit", ["e"], "y", "item_id", encode=lambda rows, train: rows.withColumn("e", F.col("u") + F.col("y")))
    assert written == [["item_id", "y", "fold", "e"]] * 4
    assert oof.count() == 400 and oof.select("item_id").distinct().count() == 400


def test_experiments_impute_only_what_is_missing(spark, monkeypatch):
    df = featured(spark).drop("fold").withColumn("vec", F.array(F.col("item_id") % 7 / 3.0, F.col("y") + F.col("item_id") % 3 / 2.0))
    no_imputer(monkeypatch)
    got = {r.protocol: r for r in X.run_experiment(df, ["vector:vec,2"], "logit").collect()}
    assert set(got) == {"cross_author", "temporal"} and got["cross_author"].n == 400 and got["temporal"].n == 80


def test_model_families_impute_only_what_is_missing(spark, monkeypatch):
    """A feature that lacks values only in test rows is filled too; the score is that of imputing all."""
    from tidemark.plans import model_queries as Q

    df = featured(spark).withColumn("a", F.when(F.col("split") == "test", F.col("a")).otherwise(F.nanvl("a", F.lit(0.0))))
    df = df.withColumn("b", F.coalesce("b", F.lit(0.0))).withColumn("c", F.col("z") + F.col("a") * 0 + F.col("author_id") / 23)
    df = df.withColumn("c", F.coalesce(F.nanvl("c", F.lit(0.5)), F.lit(0.5)))
    monkeypatch.setattr(Q, "numeric_items", lambda spark, d: (df, ["a", "b", "c"]))
    seen, real = [], L.fit
    monkeypatch.setattr(Q.L, "fit", lambda *a, **kw: seen.append(kw.get("gaps")) or real(*a, **kw))
    few = Q._temporal(spark, "", ["logit", "gaussian_nb"]).collect()
    assert seen == [["a"], ["a"]]
    monkeypatch.setattr(Q.L, "fit", lambda *a, gaps=None, **kw: real(*a, **kw))
    assert few == Q._temporal(spark, "", ["logit", "gaussian_nb"]).collect()
