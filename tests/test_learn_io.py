import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import learn as L
from tidemark.operators.guards import LeakageError
from tidemark.operators.metrics import metrics
from tidemark.plans import experiment as X
from tidemark.session import fresh_path
from tidemark.sources import readers, sinks


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    rows = [(i, int(i % 12), float(a), None if i % 10 == 0 else float(b), int(c), int(i % 4), "train" if i < 200 else "test")
            for i, ((a, b), c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "item_id int, author_id int, x0 double, x1 double, y int, fold int, split string")


@pytest.mark.parametrize("name", ["logit", "forest", "gaussian_nb", "linear_svc", "balanced_logit"])
def test_families_rank_well(table, name):
    model = L.fit(table.filter("split = 'train'"), name, ["x0", "x1"], "y")
    p = L.predict(model, table.filter("split = 'test'"))
    r = metrics(p, "y", "p").first()
    assert r.roc_auc > 0.8
    low, high = p.agg(F.min("p"), F.max("p")).first()
    assert 0 <= low <= high <= 1


def test_out_of_fold_scores_every_row_once(table):
    oof = L.out_of_fold(table, "logit", ["x0", "x1"], "y", "item_id")
    assert oof.count() == oof.select("item_id").distinct().count() == 300


def test_isotonic_is_monotone_and_clips(table):
    scored = L.predict(L.fit(table, "logit", ["x0"], "y"), table)
    cal = L.calibrate(scored, "p", "y")
    far = scored.select("p").unionByName(scored.sparkSession.createDataFrame([(-5.0,), (7.0,)], "p double"))
    got = L.apply_calibration(far, "p", cal).orderBy("p").toPandas()["p_cal"].to_numpy()
    assert (np.diff(got) >= -1e-12).all() and got.min() >= 0 and got.max() <= 1


def test_contributions_reproduce_the_model(table, spark):
    model = L.fit(table, "logit", ["x0", "x1"], "y")
    rows = L.linear_table(model, ["x0", "x1"], spark)
    scored = L.linear_score(table, ["x0", "x1"], rows, "p2").select("item_id", "p2")
    j = scored.join(L.predict(model, table), "item_id").toPandas()
    np.testing.assert_allclose(j["p"], j["p2"], atol=1e-9)
    c = L.linear_contributions(table, "item_id", ["x0", "x1"], rows).toPandas()
    assert len(c) == 600 and c[c.feature == "x1"]["value"].isna().sum() == 30
    total = c.groupby("item_id")["contribution"].sum() + c.groupby("item_id")["intercept"].first()
    np.testing.assert_allclose(j.set_index("item_id")["p"].sort_index(), 1 / (1 + np.exp(-total.sort_index())), atol=1e-9)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item_id" not in plan
    top = L.top_factors(table, "item_id", ["x0", "x1"], rows, n=1).toPandas().set_index("item_id")["factor"]
    size = c.assign(s=c["contribution"].abs()).pivot(index="item_id", columns="feature", values="s")
    assert (size.idxmax(axis=1).sort_index() == top.sort_index()).all()
    both = L.top_factors(table, "item_id", ["x0", "x1"], rows, bucket={"x": "all"}).toPandas()
    assert set(both["factor"]) == {"all"} and len(both) == 300


def test_permutation_keeps_the_values(table):
    shuffled = L.permute_column(table, "item_id", "x0", 0).toPandas().sort_values("item_id")
    own = table.toPandas().sort_values("item_id")
    assert sorted(shuffled["x0"]) == sorted(own["x0"]) and (shuffled["x0"].to_numpy() != own["x0"].to_numpy()).any()


def test_guard_stops_an_experiment(table):
    @X.block("leaky")
    def leaky(df, train, label, arg):
        return df.withColumn("play_count", F.lit(1.0)), ["play_count"]

    with pytest.raises(LeakageError):
        X.run_experiment(table, ["leaky"], "logit", protocols=["temporal"])
    with pytest.raises(ValueError):
        X.build_blocks(table, ["no such block"], F.lit(True), "y")


def test_text_encoder_separates_topics(spark):
    rows = [(i, "cats purr softly and cats sleep" if i % 2 else "rockets burn fuel and rockets fly") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string")
    v = L.tfidf_svd(df, "text", F.col("id") < 30, k=2, min_df=1).toPandas()
    a, b = np.stack(v[v.id % 2 == 1]["sv"]), np.stack(v[v.id % 2 == 0]["sv"])
    assert abs((a @ b.T)).max() < 1e-6 < (a @ a.T).min()


def test_text_vectors_have_k_numbers_whatever_the_vocabulary(spark):
    rows = [(0, "cats purr"), (1, "cats sleep"), (2, None), (3, ""), (4, "unknown words only")]
    v = L.tfidf_svd(spark.createDataFrame(rows, "id int, text string"), "text", F.col("id") < 2, k=9, min_df=1).toPandas().set_index("id")["sv"]
    assert {len(x) for x in v} == {9} and not any(map(any, v[2:5])) and all(map(any, v[:2]))


def test_projection_of_sparse_rows_in_chunks(monkeypatch):
    import pandas as pd

    rng = np.random.default_rng(3)
    dense = rng.normal(size=(30, 12)) * (rng.random((30, 12)) < 0.3)
    basis = rng.normal(size=(12, 4))
    ids = pd.Series([np.flatnonzero(r) for r in dense])
    monkeypatch.setattr(L, "TERMS_AT_ONCE", 7)
    np.testing.assert_allclose(L._project(ids, pd.Series([r[r != 0] for r in dense]), basis), dense @ basis, atol=1e-12)


def test_challenger_needs_enough_rows(table):
    few = table.limit(3).drop("split")
    r = X.challenger_report(table, few, [], "logit").first()
    assert r.n_new == 3 and r.verdict == "too_few_rows"


def test_json_arrays_skip_bad_files_and_keep_the_first(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"item_id": "1", "hook": "0.5"}, {"item_id": "2", "hook": "oops"}]))
    (tmp_path / "b.json").write_text("[{broken")
    (tmp_path / "c.json").write_text(json.dumps([{"item_id": "1", "hook": "0.9"}, {"item_id": "3", "hook": 1}]))
    got = {r.item_id: r.hook for r in readers.read_json_scores(spark, f"{tmp_path}/*.json", "item_id string, hook string").collect()}
    assert got == {"1": 0.5, "2": None, "3": 1.0}


def test_json_lines_of_equal_file_names_keep_the_first_folder(spark, tmp_path):
    for folder, value in (("b", "0.9"), ("a", "0.5")):
        (tmp_path / folder).mkdir()
        lines = [{"item_id": str(i), "hook": value} for i in range(50)] + [{"item_id": "0", "hook": "7"}]
        (tmp_path / folder / "part.json").write_text("\n".join(map(json.dumps, lines)))
    got = readers.read_json_scores(spark, f"{tmp_path}/*/part.json", "item_id string, hook string", multi_line=False).collect()
    assert {r.hook for r in got} == {0.5} and len(got) == 50


def test_materialise_once_builds_once(spark):
    calls, path = [], fresh_path(spark, "once")

    def build():
        calls.append(1)
        return spark.range(3)

    readers.materialise_once(spark, path, build)
    assert readers.materialise_once(spark, path, build).count() == 3 and len(calls) == 1
    readers.materialise_once(spark, path, build, force=True)
    assert len(calls) == 2


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new")], "id int, v string")
    assert sorted(map(tuple, sinks.upsert_keep_old(old, new, "id").collect())) == [(1, "old"), (2, "old"), (3, "new")]
    assert sorted(map(tuple, sinks.replace_by_key(old, new, ["id"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]
