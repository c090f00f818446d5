import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import decide as D
from tidemark.operators import metrics as M
from tidemark.operators import resample as R


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))


def average_precision(y, p):
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        sel = p >= t
        recall = y[sel].sum() / y.sum()
        total += (recall - last) * y[sel].mean()
        last = recall
    return total


@pytest.mark.parametrize("blocks", [None, 6])
def test_rank_metrics(hot, blocks):
    pdf, df = hot
    r = M.rank_metrics(df, "y", "p", blocks=blocks).first()
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    assert r.roc_auc == pytest.approx(auc(y, p))
    assert r.avg_precision == pytest.approx(average_precision(y, p))
    keyed = {x.a: x.roc_auc for x in M.rank_metrics(df, "y", "p", ["a"], blocks=blocks).collect()}
    part = pdf[pdf["a"] == 0]
    assert keyed[0] == pytest.approx(auc(part["y"].to_numpy(), part["p"].to_numpy()))


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, p double")
    m = M.metrics(df, "y", "p").first()
    assert m.roc_auc is None and m.avg_precision is None
    assert m.precision_neg == 0.0 and m.recall_pos == 0.5


def test_no_calls_gives_null_precision(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1)], "y int, p double")
    m = M.metrics(df, "y", "p", t=0.9).first()
    assert m.precision_pos is None and m.recall_pos == 0 and m.n_pos_calls == 0


def bands_by_hand(y, p, target=0.65, cov=0.05):
    n, high, low = len(y), None, None
    for t in np.unique(np.round(p, 4)):
        sel = p >= t
        if sel.sum() >= max(cov * n, 20) and y[sel].mean() >= target:
            high = t
            break
    for t in np.unique(np.round(p, 4))[::-1]:
        sel = p < t
        if sel.sum() >= max(cov * n, 20) and 1 - y[sel].mean() >= target:
            low = t
            break
    high = np.quantile(p, 0.8) if high is None else high
    low = np.quantile(p, 0.2) if low is None else low
    if low > high:
        low, high = np.quantile(p, 0.2), np.quantile(p, 0.8)
    return round(low, 4), round(high, 4)


@pytest.mark.parametrize("blocks,strength", [(None, 0.0), (None, 0.5), (5, 0.5), (None, 1.5)])
def test_decision_bands(spark, blocks, strength):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 7)
    y = (rng.random(400) < 0.5 + strength * (p - 0.5)).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = D.decision_bands(df, "y", "p", blocks=blocks).first()
    assert (got.t_low, got.t_high) == pytest.approx(bands_by_hand(y, p))
    assert got.t_low <= got.t_high
    report = {r.decision: r for r in D.band_report(df, "y", "p", D.decision_bands(df, "y", "p")).collect()}
    assert set(report) == set(D.DECISIONS) and sum(r.n for r in report.values()) == 400


def test_conformal_limits(hot):
    pdf, df = hot
    got = D.conformal_fit(df, "y", "p", blocks=4).first()
    for k in (0, 1):
        part = pdf[pdf["y"] == k]["p"].to_numpy()
        scores = 1 - part if k == 1 else part
        n = len(scores)
        level = min(1.0, np.ceil((n + 1) * 0.9) / n)
        assert got[f"q{k}"] == pytest.approx(np.quantile(scores, level, method="higher"))
    cover = D.conformal_coverage(D.conformal_sets(df, "p", D.conformal_fit(df, "y", "p")), "y").first()
    assert cover.coverage >= 0.9


def test_keep_delete_takes_the_largest_set(spark):
    rows = [(0, 0.1), (0, 0.2), (1, 0.3), (0, 0.4), (0, 0.5), (1, 0.6)]
    df = spark.createDataFrame(rows, "y int, p double")
    got = {r.target: r for r in D.keep_delete(df, "y", "p", [1.0, 0.8]).collect()}
    assert (got[1.0].deleted, got[1.0].hits_lost) == (2, 0)
    assert (got[0.8].deleted, got[0.8].hits_lost) == (5, 1)


def test_f1_threshold(hot):
    pdf, df = hot
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    grid = np.round(0.05 + np.arange(181) * 0.005, 3)
    f1 = [2 * (y * (p >= t)).sum() / ((p >= t).sum() + y.sum()) for t in grid]
    got = D.f1_threshold(df, "y", "p").first()
    assert got.f1 == pytest.approx(max(f1)) and got.t == pytest.approx(grid[int(np.argmax(f1))])


def test_rank_quality_averages_ties(spark):
    df = spark.createDataFrame([("a", 0.5, 3.0), ("a", 0.5, 1.0), ("a", 0.2, 0.0), ("b", 0.1, 1.0), ("b", 0.2, 1.0), ("b", 0.3, 1.0)], "a string, p double, v double")
    got = M.rank_quality(df, "a", "p", "v").collect()
    assert [r.a for r in got] == ["a"]  # b has a constant target
    top2 = (3.0 + 1.0) / 2 * (1 + 1 / np.log2(3))
    assert got[0].ndcg_3 == pytest.approx(top2 / (3 + 1 / np.log2(3)))


def test_spearman(hot):
    pdf, df = hot
    want = pdf["v"].rank().corr(pdf["p"].rank())
    assert M.spearman(df, "v", "p", blocks=4).first().spearman == pytest.approx(want)


def test_bootstrap_is_stable_and_covers(hot):
    pdf, df = hot
    one = R.bootstrap_ci(df, "roc_auc", "y", "p", "id", n=40).first()
    two = R.bootstrap_ci(df.repartition(5), "roc_auc", "y", "p", "id", n=40).first()
    assert one == two
    assert one.lo < auc(pdf["y"].to_numpy(), pdf["p"].to_numpy()) < one.hi


def test_poisson_weights_have_mean_one(spark):
    w = R.replicate(spark.range(4000).withColumn("one", F.lit(1)), "id", 5).groupBy("rep").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s / 4000 - 1) < 0.05 for r in w)


def test_ece_of_a_perfect_score_is_zero(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0)] * 10, "y int, p double")
    assert M.ece(df, "y", "p").first().ece == 0


def test_bootstrap_edges_of_the_input(spark):
    typed = "id long, y int, p double, q double"
    none = spark.createDataFrame([], typed)
    assert R.bootstrap_ci(none, "roc_auc", "y", "p", "id", n=8).first().replicates == 0
    rows = [(i, i % 2, 0.5, 0.1 * (i % 7)) for i in range(60)] + [(None, 1, 0.5, None), (61, None, 0.5, 0.3), (62, 1, None, 0.4)]
    df = spark.createDataFrame(rows, typed)
    tied = R.replicate_metrics(df, "y", "p", "id", n=8).collect()
    assert len(tied) == 8 and all(r.roc_auc == 0.5 for r in tied)
    assert {r.metric for r in R.bootstrap_delta(df, "y", "p", "q", "id", n=8).collect()} == {"f1_pos", "recall_pos", "avg_precision", "roc_auc"}
