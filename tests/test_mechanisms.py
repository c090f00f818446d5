"""Scans, order statistics, wide vectors, searches and folds: against plain Python, and by what their plans read."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import history as H
from tidemark.operators import learn as L
from tidemark.operators import metrics as M
from tidemark.operators import panel as P
from tidemark.operators import profile as Q
from tidemark.operators import resample as R
from tidemark.operators import scan as S
from tidemark.operators import splits as Z


def counted(spark, df):
    """The same rows, and how often each was read so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return df.mapInPandas(count, df.schema), lambda: seen.value / df.count()


@pytest.fixture
def forced(spark):
    """Runs a plan with several blocks."""
    spark.conf.set("tidemark.blocks", "5")
    yield
    spark.conf.unset("tidemark.blocks")


@pytest.mark.parametrize("blocks", [None, 4])
def test_rank_matrix_of_ten_columns_reads_the_rows_twice(spark, blocks):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(np.round(rng.normal(size=(200, 10)), 1), columns=[f"c{i}" for i in range(10)])
    pdf["c3"] = pdf["c0"] * -2 + np.round(rng.normal(size=200), 1)
    pdf["c4"] = np.where(np.arange(200) % 7 == 0, np.nan, pdf["c4"])
    pdf["c5"] = np.where(np.arange(200) % 2 == 0, np.nan, np.arange(200) // 50 * 2.0)  # a median between two values
    pdf["c6"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{c} double" for c in pdf.columns))
    rows, read = counted(spark, df)
    got = {(r.a, r.b): r.spearman for r in M.spearman_matrix(rows, list(pdf.columns), blocks).collect()}
    assert len(got) == 45 and read() <= 2
    want = pdf.fillna(pdf.median()).rank().corr()
    for (a, b), v in got.items():
        assert (v is None or np.isnan(v)) if "c6" in (a, b) else v == pytest.approx(want.loc[a, b]), (a, b)


def test_rank_metrics_read_the_rows_once_in_blocks(spark, hot, forced):
    pdf, df = hot
    rows, read = counted(spark, df)
    got = M.metrics(rows, "y", "p").first()
    assert read() <= 1 and got.n == 600
    assert "Bucketizer" not in M.ranked_scores(M.score_table(df, "y", "p"))._jdf.queryExecution().toString()


def test_blocks_cut_a_hot_key_and_keep_its_order(spark, hot):
    _, df = hot
    placed = S.in_blocks(df, ["a", "t", "id"], 12)
    sizes = placed.filter("a = 0").groupBy("_blk").count().collect()
    assert len(sizes) > 2 and max(r["count"] for r in sizes) < 150  # of 200
    rows = placed.orderBy("_at").select("a", "t", "id").collect()
    assert rows == sorted(rows)


def test_spearman_keeps_a_null_group(spark, hot):
    _, df = hot
    g = df.withColumn("g", F.when(F.col("tok") < 3, F.col("tok")))
    for blocks in (None, 3):
        assert M.spearman(g, "v", "p", ["g"], blocks).count() == 4


def test_median_limits_are_those_of_resampling(spark):
    rng = np.random.default_rng(7)
    groups = {n: np.round(rng.lognormal(size=n), 3) for n in (1, 2, 5, 30, 61)}
    rows = [(n, float(v)) for n, vs in groups.items() for v in vs] + [(None, 1.0), (None, 3.0), (5, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for blocks in (None, 3):
        got = {r.g: r for r in R.group_median_ci(df, "g", "v", blocks).collect()}
        assert set(got) == {*groups, None} and got[None].n == 2 and got[1].rel_width == 0
        for n, vs in groups.items():
            drawn = np.sort(rng.choice(vs, (20_000, n)), axis=1)
            # The two middle places of even groups have limits of their own.
            for limit, q in (("lo", 0.025), ("hi", 0.975)):
                near = [np.quantile(drawn[:, m], x, method="inverted_cdf") for m in ((n - 1) // 2, n // 2) for x in (q - 0.006, q + 0.006)]
                assert (near[0] + near[2]) / 2 - 1e-9 <= getattr(got[n], limit) <= (near[1] + near[3]) / 2 + 1e-9
            assert got[n].median == pytest.approx(np.median(vs))
    assert R.median_places(10**9)[0] == pytest.approx(5e8 - 1.96 * 10**4.5 / 2, rel=1e-4)
    small = R.minimum_group_size(R.group_median_ci(df, "g", "v"), [(1, 2), (3, 100)]).collect()
    assert {r.bucket: r["keys"] for r in small} == {"1-2": 3, "3-100": 3}


@pytest.mark.parametrize("dim", [3, 768])
def test_author_fit_of_wide_vectors(spark, dim):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, dim))
    rows = [(i, i % 3 if i % 11 else None, int(rng.integers(0, 30)), vecs[i].tolist(), int(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a int, t bigint, v array<double>, y int")
    plans = []
    for blocks in (1, 4):
        got = H.author_fit(df, "a", "t", "v", "y", dim, gap=5, blocks=blocks)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
        out = {r.id: r for r in got.collect()}
        for i, a, t, v, _ in rows:
            wins = [np.array(w) for _, b, s, w, y in rows if a is not None and b == a and y == 1 and s + 5 <= t]
            unit = lambda x: x / (np.linalg.norm(x) + 1e-8)
            want = float(unit(np.array(v)) @ unit(np.mean([unit(w) for w in wins], axis=0))) if wins else 0.0
            assert out[i].author_fit == pytest.approx(want, abs=1e-6) and out[i].n_prior_wins_log == pytest.approx(np.log1p(len(wins)))
    assert all(p.count("windowspecdefinition") <= 4 for p in plans)


def test_running_vectors_in_blocks(spark, hot):
    pdf, df = hot
    rows = df.withColumn("w", F.array("v", F.lit(1.0), F.col("p")))
    one, many = (S.running_vectors(rows, ["a"], ["t", "id"], "w", "s", b).orderBy("id").toPandas() for b in (1, 6))
    np.testing.assert_allclose(np.stack(one["s"]), np.stack(many["s"]))
    want = pdf.sort_values(["a", "t", "id"]).groupby("a")["v"].cumsum().sort_index()
    np.testing.assert_allclose(np.stack(one["s"])[:, 0], want)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.4 * x[:, 1] + 0.6 * rng.normal(size=400) > 0).astype(int)
    rows = [(i, *map(float, r), int(c), int(i % 4)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "item_id int, x0 double, x1 double, x2 double, y int, fold int").cache()


def test_halving_is_as_good_as_random_search(labelled):
    space = {"regParam": [1e-4, 0.1, 10.0], "elasticNetParam": [0.0, 1.0], "maxIter": [1, 20]}
    feats = ["x0", "x1", "x2"]
    table = L.halving_search(labelled, "logit", feats, "y", "item_id", space, trials=9, folds=4).toPandas()
    assert table.groupby("rung").size().tolist() == [9, 3, 1] and table["chosen"].sum() == 1
    assert table.groupby("rung")["share"].first().tolist() == pytest.approx([1 / 9, 1 / 3, 1.0])
    best = table[table.chosen == 1].iloc[0]
    full = L.search(labelled, "logit", feats, "y", "item_id", space, trials=9, folds=4).toPandas()
    assert best["rung"] == 2 and best["mean_auc"] >= full["mean_auc"].max() - 0.01


def test_importance_reads_the_held_out_rows_once(spark, labelled):
    feats = ["x0", "x1", "x2"]
    model = L.fit(labelled, "logit", feats, "y")
    rows, read = counted(spark, labelled)
    got = {r.feature: r for r in L.permutation_importance(model, rows, feats, "y", "item_id").collect()}
    assert read() <= 1 and set(got) == set(feats)
    assert got["x0"].importance > got["x1"].importance > abs(got["x2"].importance) and got["x0"].spread > 0


def test_panel_sorted_by_item_is_read_without_a_shuffle(spark):
    rows = [(i, d, float(i * d)) for i in range(50) for d in range(5)]
    panel = P.ordered_panel(spark.createDataFrame(rows, "item bigint, day int, v double"), "item", "day", buckets=4)
    got = P.latest_at(panel, "item", "day", 3, ["v"])
    assert {r.item: r.v for r in got.collect()} == {i: i * 3.0 for i in range(50)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_folds_of_skewed_groups_agree(spark):
    rng = np.random.default_rng(4)
    sizes = [500, 400, 350, 300, 120, 110, 100, *rng.integers(1, 12, 400)]
    rates = [0.8, 0.2, 0.5, 0.7, 0.2, 0.8, 0.5, *rng.random(400)]
    rows = [(g if g else None, int(rng.random() < r)) for g, (n, r) in enumerate(zip(sizes, rates, strict=True)) for _ in range(n)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, g int, y int")
    folded = Z.grouped_folds(df, "g", "id", "y", 5).toPandas()
    assert len(folded) == len(rows) and folded["fold"].notna().all()
    assert folded.groupby(folded["g"].fillna(-1))["fold"].nunique().max() == 1
    per = folded.groupby("fold")["y"].agg(["size", "mean"])
    assert abs(per["mean"] - folded["y"].mean()).max() < 0.1 and per["size"].max() < 1.35 * len(rows) / 5
    even = Z.grouped_folds(df.filter("g > 6"), "g", "id", "y", 5).toPandas().groupby("fold")["y"].agg(["size", "mean"])
    assert abs(even["mean"] - even["mean"].mean()).max() < 0.05 and even["size"].max() < 1.1 * even["size"].mean()


def test_folds_of_few_groups_are_folds_of_rows(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2) for i in range(60)], "id int, g int, y int")
    got = Z.grouped_folds(df, "g", "id", "y", 5).groupBy("fold", "y").count().collect()
    assert len(got) == 10 and all(r["count"] == 6 for r in got)
    assert Z.grouped_folds(df.limit(0), "g", "id", "y", 5).count() == 0


def test_a_null_author_has_a_fold(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 7, i % 2) for i in range(80)], "id int, a int, y int")
    for got in (Z.group_kfold(df, "a"), Z.stratified_group_kfold(df, "a", "y")):
        assert got.count() == 80 and got.filter("fold IS NULL").count() == 0
        assert got.filter("a IS NULL").select("fold").distinct().count() == 1


def test_growth_curves_find_a_known_curve(spark):
    rows = [("up", d, 1000 / (1 + (4.0 / (d + 1)) ** 1.3)) for d in range(14)] + [("flat", d, 10.0) for d in range(0, 14, 2)]
    rows += [("two", 0, 5.0), ("two", 1, 6.0), ("zero", 0, 0.0), ("zero", 1, 0.0), ("zero", 2, 0.0), ("late", 12, 3.0), ("up", 3, None)]
    df = spark.createDataFrame(rows, "item string, day int, v double")
    got = {r.item: r for r in Q.growth_curves(df, "item", "day", "v", 13, 9, (1.0, 3.0, 9.0), (0.5, 1.5, 3.0), rounds=6).collect()}
    assert set(got) == {"up", "flat", "two", "zero"}  # nothing is known of `late` by day 9
    assert got["up"].predicted == pytest.approx(rows[13][2], rel=0.02) and got["up"].error < 0.2 * got["up"].last_error
    assert got["two"].predicted == 6.0 and got["two"].error is None and got["zero"].predicted == 0.0
    rough = {r.item: r for r in Q.growth_curves(df, "item", "day", "v", 13, 9, (1.0, 3.0, 9.0), (0.5, 1.5, 3.0), rounds=0).collect()}
    assert got["up"].error <= rough["up"].error


def test_dead_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None, 3, "a"), (2, 0.0, None, 3, None), (3, 7.0, None, 3, "a")], "id int, v double, e string, c int, s string")
    assert P.dead_columns(df) == ["e", "c"] and P.dead_columns(df.limit(0)) == []
    kept = P.clean_rows(df.withColumn("a", F.col("id")), "v", "a")
    assert kept.columns == ["id", "v", "a"] and kept.count() == 2  # of the rows with views, s is the same too


def test_a_metric_of_the_caller_over_the_same_resamples(spark, hot):
    _, df = hot
    loss = F.abs(F.col("p") - F.col("y"))
    got = R.bootstrap_metric(df, {"n": F.lit(1.0), "loss": loss}, lambda s: s["loss"] / s["n"], "id", n=60).first()
    drawn = R.replicate(df.select("id", loss.alias("x")), "id", 60).groupBy("rep").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("m")).toPandas()["m"]
    assert (got.lo, got.mid, got.hi) == pytest.approx((drawn.quantile(0.025), drawn.median(), drawn.quantile(0.975))) and got.replicates == 60
    none = R.bootstrap_metric(df.withColumn("p", F.lit(None).cast("double")), {"p": F.col("p")}, lambda s: F.nullif(s["p"], F.lit(0.0)), "id", n=4).first()
    assert none.lo is None and none.replicates == 0


def test_an_encoder_of_the_caller(spark):
    from tidemark.plans import experiment as X

    df = spark.createDataFrame([(i, t, int(i > 3)) for i, t in enumerate(["aa", None, "", "abab", "b" * 50, "ba"])], "item_id int, text string, y int")
    vec = lambda texts: np.array([[t.count("a"), len(t)] for t in texts], float)
    got = {r.item_id: r.v for r in L.encode_text(df, "text", vec, 2, "v", batch=2).collect()}
    assert got == {0: [2, 2], 1: [0, 0], 2: [0, 0], 3: [2, 4], 4: [0, 50], 5: [1, 2]}
    with pytest.raises(Exception, match="the encoder returned"):
        L.encode_text(df, "text", vec, 3, "v").collect()
    fitted = []
    X.encoder("letters", lambda train, text: fitted.append(train.count()) or vec, 2)
    ready, names = X.build_blocks(df, ["letters:text"], F.col("item_id") < 4, "y")
    assert fitted == [4] and len(names) == 2 and ready.filter("item_id = 3").select(*names).first()[:] == (2.0, 4.0)


def test_decisions_of_odd_candidates(spark):
    from tidemark.plans import decisions as B

    rows = [(1, 0.5, False, None, "cap", [1.0, 0.0]), (2, None, True, "9", "", None), (3, 2.0, None, "bad", None, [0.0, 1.0]), (4, -2.0, True, "-1", "x", [0.9, 0.1])]
    c = spark.createDataFrame(rows, "id int, x double, has_day1 boolean, ratio string, desc string, vec array<double>")
    c = c.withColumns({"duration": F.lit(3.0), "transcript": F.lit("t")})
    bank = spark.createDataFrame([(1, [1.0, 0.0], 1), (10, [1.0, 0.1], 1), (11, [0.0, 1.0], 0)], "id int, vec array<double>, hit int")
    table = spark.createDataFrame([("x", 0.0, 0.0, 1.0, 1.0, 0.0)], "feature string, median double, mean double, std double, coef double, intercept double")
    one = lambda **kw: spark.createDataFrame([tuple(kw.values())], ", ".join(f"{k} double" for k in kw))
    scorer = B.Scorer(["x"], table, one(t_low=0.4, t_high=0.7), one(q0=0.5, q1=0.5))
    got = {r.id: r for r in B.decide_batch(c, "id", scorer, scorer, "ratio", bank, "vec", "hit", n_examples=2).collect()}
    assert sorted(got) == [1, 2, 3, 4] and [got[i].model for i in (1, 2, 3, 4)] == ["pre", "day1", "pre", "day1"]
    assert [got[i].decision for i in (1, 2, 3, 4)] == ["Unsure", "Unsure", "Post", "Do not post"]  # cost ratio 9 asks for 0.9
    assert got[2].t_high == 0.9 and got[2].p == 0.5 and got[2].examples is None and got[2].warnings == ["no caption"]
    assert [(e.id, e.outcome) for e in got[1].examples] == [(10, "hit"), (11, "flop")]  # never itself
    assert got[4].certain and got[4].pred_set == "{0}" and got[3].factors[0].factor == "x"
    day1 = spark.createDataFrame([(7.0, -3.0, None), (None, 2.0, "x")], "v double, l double, m string")
    cols = day1.select(*[e.alias(n) for n, e in B.day1_columns("v", ["l"], "m").items()]).collect()
    assert cols[0].log_like_d1 == 0 and cols[0].log_play_d1_vs_author == 0 and cols[1].log_play_d1 == 0 and cols[1].er_d1 == 2


def test_a_refused_run_leaves_no_log_row(spark, labelled, tmp_path):
    from tidemark.operators.guards import LeakageError, guard_report
    from tidemark.plans import experiment as X

    df = labelled.drop("fold").withColumns({"author_id": F.col("item_id") % 9, "split": F.when(F.col("item_id") < 300, "train").otherwise("test"), "log_play_d1": F.col("x1")})
    X.block("plain")(lambda df, train, label, arg: (df, ["x0"]))
    X.block("leaky")(lambda df, train, label, arg: (df, ["x0", "log_play_d1"]))
    log = str(tmp_path / "log")
    assert X.run_experiment(df, ["plain"], "logit", log=log, name="a").count() == 2
    with pytest.raises(LeakageError):
        X.run_experiment(df, ["leaky"], "logit", log=log, name="b")
    X.run_experiment(df, ["leaky"], "logit", stage="day1", log=log, name="c")
    assert sorted((r.label, r.protocol) for r in spark.read.parquet(log).collect()) == [(n, p) for n in "ac" for p in ("cross_author", "temporal")]
    report = {r.feature: (r.known, r.refused_pre, r.refused_day1) for r in guard_report(df, ["x0", "log_play_d1"]).collect()}
    assert report == {"x0": (400, 0, 0), "log_play_d1": (400, 1, 0)}


def test_importance_is_the_same_in_blocks(spark, labelled):
    feats = ["x0", "x1", "x2"]
    model = L.fit(labelled, "logit", feats, "y")

    def importance():
        table = L.permutation_importance(model, labelled, feats, "y", "item_id")
        return {r.feature: (round(r.importance, 9), round(r.spread, 9)) for r in table.collect()}

    plain = importance()
    spark.conf.set("tidemark.blocks", "3")
    try:
        assert importance() == plain and set(plain) == set(feats)
    finally:
        spark.conf.unset("tidemark.blocks")


def test_small_vocabularies_need_no_iterative_solver(spark, monkeypatch):
    rng = np.random.default_rng(8)
    names = [a + b + "o" for a in "bcdfghkl" for b in "aeiu"]
    texts = [(i, " ".join(rng.choice(names, 12, p=np.arange(1, 33) / 528))) for i in range(400)]
    docs = spark.createDataFrame(texts, "id int, text string").repartition(3)
    monkeypatch.setattr(L, "GRAM_TERMS", 0)
    slow = L.TextEncoder(min_df=1, k=5).fit(docs, "text").basis
    monkeypatch.undo()

    def refuse(*args):
        raise AssertionError("passes over the rows many times")

    monkeypatch.setattr(L.RowMatrix, "computeSVD", refuse)
    basis = L.TextEncoder(min_df=1, k=5).fit(docs, "text").basis
    assert basis.shape == slow.shape == (32, 5) and np.abs(basis - slow).max() < 1e-7
