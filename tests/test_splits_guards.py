import pytest
from pyspark.sql import functions as F

from tidemark.operators import guards as G
from tidemark.operators import profile as Q
from tidemark.operators import splits as Z


def test_group_folds_are_disjoint_and_balanced(hot):
    pdf, df = hot
    folded = Z.group_kfold(df.filter("a <> 0"), "a")
    G.guard_disjoint(folded, "a")
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.6 * min(sizes)


def test_leaky_folds_are_refused(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1)], "a string, fold int")
    with pytest.raises(G.LeakageError):
        G.guard_disjoint(df, "a")


def test_column_guards():
    with pytest.raises(G.LeakageError):
        G.guard_columns(["char_len", "log_play_d1"], "pre")
    G.guard_columns(["log_play_d1", "er_d1", "char_len"], "day1")
    for bad in ("play_count", "breakout_wc"):
        with pytest.raises(G.LeakageError):
            G.guard_columns([bad], "day1")


def test_contract_guard(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    G.guard_contract(df, ["a", "b"])
    with pytest.raises(G.LeakageError):
        G.guard_contract(df, ["b", "a"])


def test_samples_are_exact_and_repeatable(hot):
    pdf, df = hot
    one = Z.balanced_sample(df, "id", "y", 100)
    assert {r.y: r["count"] for r in one.groupBy("y").count().collect()} == {0: 50, 1: 50}
    again = Z.balanced_sample(df.repartition(9), "id", "y", 100)
    assert one.select("id").exceptAll(again.select("id")).count() == 0
    part = Z.stratified_sample(df, "id", ["y"], 0.25).groupBy("y").count().collect()
    for r in part:
        n = int((pdf["y"] == r.y).sum())
        assert r["count"] == -(-n // 4)


def test_author_split_keeps_authors_whole(hot):
    _, df = hot
    s = Z.author_split(df, "a").select("a", "split").distinct()
    assert s.count() == s.select("a").distinct().count() == 20
    assert {r.split: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 14, "valid": 3, "test": 3}


def test_ips_weights_have_mean_one(hot):
    _, df = hot
    w = Z.ips_weights(df, "v").agg(F.avg("weight")).first()[0]
    assert w == pytest.approx(1.0)


def test_imbalance_warning(spark):
    df = spark.createDataFrame([(1,)] * 12, "y int")
    assert G.imbalance(df, "y").first().warning is not None
    assert G.imbalance(df.limit(9), "y").first().warning is None


def test_baseline_needs_five_known_values(spark):
    rows = [("a", t, float(t)) for t in range(30)] + [("b", t, 1.0 if t < 4 else None) for t in range(10)]
    df = spark.createDataFrame(rows, "author string, t int, v double")
    got = {r.author: (r.median_value, r.n) for r in Q.baseline_median(df, "author", "t", "v").collect()}
    assert got == {"a": (22.0, 15)}


def test_eta_squared_bounds(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    assert Q.eta_squared(df, "v", "g").first().eta_squared == pytest.approx(1.0)


def test_growth_grid_finds_the_curve(spark):
    rows = [("x", d, 100 / (1 + (3.0 / (d + 1)) ** 1.5)) for d in range(8)] + [("y", 0, 4.0)]
    df = spark.createDataFrame(rows, "item string, day int, v double")
    got = {r.item: r for r in Q.growth_grid(df, "item", "day", "v", 14, 7, [1.0, 3.0, 9.0], [0.5, 1.5, 3.0]).collect()}
    assert got["x"].predicted == pytest.approx(100 / (1 + (3.0 / 15) ** 1.5), rel=1e-6)
    assert got["y"].predicted == 4.0 and got["y"].curve == -1


def test_psi_of_equal_samples_is_zero(hot):
    _, df = hot
    assert Q.population_stability(df, df, "v").first().psi == pytest.approx(0.0)
