import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan as S


@pytest.mark.parametrize("blocks", [1, 2, 7, 50])
def test_prefix_scan_equals_pandas(hot, blocks):
    pdf, df = hot
    got = S.prefix_scan(
        df, ["a"], ["t", "id"], sums={"s": F.col("v")}, lasts={"l": F.when(F.col("y") == 1, F.col("v"))},
        totals={"n": F.lit(1)}, blocks=blocks,
    ).toPandas().sort_values("id").reset_index(drop=True)
    want = pdf.sort_values(["a", "t", "id"]).copy()
    want["s"] = want.groupby("a")["v"].cumsum()
    want["l"] = want["v"].where(want["y"] == 1)
    want["l"] = want.groupby("a")["l"].ffill()
    want["n"] = want.groupby("a")["v"].transform("size")
    want = want.sort_values("id").reset_index(drop=True)
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["s"], want["s"])
    np.testing.assert_allclose(got["l"].astype(float), want["l"])
    assert (got["n"] == want["n"]).all()


def test_global_scan_without_key(hot):
    pdf, df = hot
    got = S.prefix_scan(df, [], ["t", "id"], sums={"s": F.col("v")}, blocks=6).toPandas()
    assert got["s"].max() == pdf["v"].sum()
    assert np.allclose(got.sort_values(["t", "id"])["s"], pdf.sort_values(["t", "id"])["v"].cumsum())


def test_blocks_bound_the_hot_key(hot):
    """A key with a third of the rows is spread over the blocks."""
    _, df = hot
    edges = S.block_edges(df, "t", 10)
    largest = S.with_block(df, "t", edges).filter("a = 0").groupBy("_blk").count().agg(F.max("count")).first()[0]
    assert largest < 60  # of 200


@pytest.mark.parametrize("by", [[], ["a"]])
def test_exact_quantiles(hot, by):
    pdf, df = hot
    qs = {"lo": 0.1, "mid": 0.5, "hi": 0.93}
    got = S.exact_quantiles(df, by, "v", qs, blocks=5, n_out="n").toPandas()
    groups = pdf.groupby("a") if by else [(None, pdf)]
    for key, part in groups:
        row = got[got["a"] == key].iloc[0] if by else got.iloc[0]
        for name, q in qs.items():
            assert row[name] == pytest.approx(np.quantile(part["v"], q))
        assert row["n"] == len(part)
    plain = S.exact_quantiles(df, by, "v", qs).toPandas()
    assert np.allclose(sorted(plain["mid"]), sorted(got["mid"]))


def test_quantile_table_both_ways(hot):
    _, df = hot
    specs = {"a5": ("v", 0.5), "b9": ("p", 0.9)}
    one = S.quantile_table(df, ["a"], specs).orderBy("a").toPandas()
    two = S.quantile_table(df, ["a"], specs, blocks=4).orderBy("a").toPandas()
    assert np.allclose(one, two)


def test_average_ranks(hot):
    pdf, df = hot
    got = S.average_ranks(df, ["a"], "v", "r", blocks=4).toPandas().sort_values("id")
    want = pdf.groupby("a")["v"].rank(method="average")
    assert np.allclose(got["r"], want)


def test_hash_rank_split_equals_plain(hot):
    _, df = hot
    h = df.withColumn("h", S.id_hash("id", 3))
    one = S.hash_rank(h, ["y"], "h", "r", split=False).orderBy("id").toPandas()
    two = S.hash_rank(h, ["y"], "h", "r", split=True).orderBy("id").toPandas()
    assert (one["r"] == two["r"]).all()


def test_result_does_not_depend_on_partitioning(hot):
    _, df = hot
    one = S.exact_quantiles(df.repartition(7), ["a"], "v", {"m": 0.5}, blocks=3).orderBy("a").toPandas()
    two = S.exact_quantiles(df.coalesce(1), ["a"], "v", {"m": 0.5}, blocks=9).orderBy("a").toPandas()
    assert one.equals(two)
