"""Null keys, labels and scores: the same rows with one block and with several, and none dropped."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import encode, history, learn, scan, splits
from tidemark.operators.metrics import metrics


@pytest.fixture
def both(spark):
    """Runs a plan with one block and with several."""

    def run(plan):
        out = []
        for blocks in ("1", "5"):
            spark.conf.set("tidemark.blocks", blocks)
            try:
                out.append(sorted(map(repr, plan().collect())))
            finally:
                spark.conf.unset("tidemark.blocks")
        return out

    return run


@pytest.fixture
def nully(spark, hot):
    _, df = hot
    return df.withColumn("a", F.when(F.col("id") % 4 > 0, F.col("a"))).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("tok") % 2))


def test_hash_rank_keeps_null_keys(both, nully):
    ranked = lambda: scan.hash_rank(nully.withColumn("h", scan.id_hash("id")), ["a"], "h", "r").select("id", "r")
    one, many = both(ranked)
    assert one == many and len(one) == 600


def test_quantiles_and_ranks_keep_null_and_empty_groups(both, nully):
    df = nully.withColumn("v", F.when(F.col("a") != 3, F.col("v")))
    one, many = both(lambda: scan.quantile_table(df, ["a"], {"m": ("v", 0.5)}))
    assert one == many and any("a=None" in r for r in one) and any("m=None" in r for r in one)
    one, many = both(lambda: scan.average_ranks(nully, ["a"], "v", "r").select("id", "r"))
    assert one == many and len(one) == 600 and not any("r=None" in r for r in one)


def test_metrics_of_a_null_group(both, nully):
    one, many = both(lambda: metrics(nully, "y", "p", by=["g"]).select("g", F.round("roc_auc", 9).alias("auc"), F.round("avg_precision", 9).alias("ap")))
    assert one == many and len(one) == 3 and "None" not in "".join(r.split("auc")[1] for r in one)


def test_samples_keep_null_strata(both, nully):
    one, many = both(lambda: splits.stratified_sample(nully, "id", ["g"], 0.5).select("id", "g"))
    assert one == many and sum("g=None" in r for r in one) == 100


def test_recency_skips_unknown_values(both, nully):
    df = nully.withColumn("a", F.coalesce("a", F.lit(0))).withColumn("v", F.when(F.col("id") % 2 == 0, F.col("v")))
    cols = ["auth_recent3", "auth_ewm", "auth_momentum", "auth_days_since_last_log"]
    one, many = both(lambda: history.author_recency(df, "a", "t", "id", "v").select("id", *[F.round(c, 6).alias(c) for c in cols]))
    assert one == many and len(one) == 600


def test_leave_one_out_with_an_unknown_label(spark):
    df = spark.createDataFrame([(1, "k", 1), (2, "k", None), (3, "k", 0)], "id long, k string, y int")
    got = {r.id: r.e for r in encode.target_encode(df, "k", "y", F.lit(True), "e", leave_one_out=True).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0}


@pytest.mark.parametrize("method", ["isotonic", "logistic"])
def test_calibration_keeps_rows_without_a_score(spark, method):
    rows = spark.createDataFrame([(i / 10, int(i > 4)) for i in range(10)], "s double, y int")
    model = learn.calibrate(rows, "s", "y", method)
    got = learn.apply_calibration(rows.select("s").union(spark.createDataFrame([(None,), (float("nan"),)], "s double")), "s", model).collect()
    assert len(got) == 12 and sum(r.p_cal is None for r in got) == 2


def test_the_perceptron_refuses_weights(spark):
    rows = spark.createDataFrame([(0.1, 0, 1.0), (0.9, 1, 2.0)], "x double, y int, w double")
    with pytest.raises(ValueError):
        learn.fit(rows, "mlp", ["x"], "y", weight="w")
