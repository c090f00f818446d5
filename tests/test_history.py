import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.constants import DAY_US
from tidemark.operators import history as H
from tidemark.operators import trend as T
from tidemark.operators.joins import asof_join


def visible(pdf, row, gap):
    seen = pdf[(pdf["a"] == row.a) & (pdf["t"] + gap <= row.t)]
    return seen.sort_values(["t", "id"])


@pytest.mark.parametrize("blocks", [None, 5])
def test_author_history(hot, blocks):
    pdf, df = hot
    got = H.author_history(df.withColumn("f", F.lit(10.0)), "a", "t", "v", "f", blocks=blocks).toPandas().set_index("id")
    for row in pdf.sample(60, random_state=1).itertuples():
        seen = visible(pdf, row, 14 * DAY_US)
        want = np.log1p(seen["v"] / 10).mean() if len(seen) else 0.0
        assert got.loc[row.id, "author_hist_breakout"] == pytest.approx(want)
        assert got.loc[row.id, "author_nprior_log"] == pytest.approx(np.log1p(len(seen)))


@pytest.mark.parametrize("blocks,chunk", [(None, 4096), (4, 80)])
def test_author_recency(hot, blocks, chunk, monkeypatch):
    monkeypatch.setattr(H, "CHUNK", chunk)
    pdf, df = hot
    pdf = pdf.copy()
    got = H.author_recency(df, "a", "t", "id", "v", blocks=blocks).toPandas().set_index("id")
    assert len(got) == len(pdf)
    for row in pdf.sample(60, random_state=2).itertuples():
        values = visible(pdf, row, 14 * DAY_US)["v"].to_numpy()
        if len(values):
            w = 0.6 ** np.arange(len(values))[::-1]
            assert got.loc[row.id, "auth_recent3"] == pytest.approx(values[-3:].mean())
            assert got.loc[row.id, "auth_ewm"] == pytest.approx((w * values).sum() / w.sum())
            assert got.loc[row.id, "auth_momentum"] == pytest.approx(values[-3:].mean() - values.mean())
        else:
            assert got.loc[row.id, "auth_recent3"] == 0
        own = pdf[pdf["a"] == row.a].sort_values(["t", "id"])
        at = own["id"].tolist().index(row.id)
        since = 0 if at == 0 else (own["t"].iloc[at] - own["t"].iloc[at - 1]) / DAY_US
        assert got.loc[row.id, "auth_days_since_last_log"] == pytest.approx(np.log1p(since))


@pytest.mark.parametrize("blocks", [None, 3])
def test_author_fit_sees_only_matured_winners(spark, blocks):
    rows = [(0, "a", 0, 1, [1.0, 0.0]), (1, "a", 5 * DAY_US, 0, [1.0, 0.0]), (2, "a", 24 * DAY_US, 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, a string, t bigint, y int, v array<double>")
    got = H.author_fit(df, "a", "t", "v", "y", 2, blocks=blocks).orderBy("id").toPandas()
    assert got["n_prior_wins_log"].tolist()[:2] == [0, 0]
    assert got["n_prior_wins_log"].iloc[2] == pytest.approx(np.log(2))
    assert got["author_fit"].iloc[2] == pytest.approx(1.0, abs=1e-6)
    early = H.author_fit(df, "a", "t", "v", "y", 2, gap=1, blocks=blocks).orderBy("id").toPandas()
    assert early["n_prior_wins_log"].iloc[1] > 0


@pytest.mark.parametrize("blocks", [None, 6])
def test_token_momentum(hot, blocks):
    pdf, df = hot
    got = T.token_momentum(df, "tok", "t", blocks=blocks).toPandas().set_index("id")
    for row in pdf.sample(60, random_state=3).itertuples():
        t = pdf[pdf["tok"] == row.tok]["t"].to_numpy()
        recent = ((t < row.t) & (t >= row.t - 7 * DAY_US)).sum()
        base = ((t < row.t - 7 * DAY_US) & (t >= row.t - 35 * DAY_US)).sum()
        assert got.loc[row.id, "trend_token"] == pytest.approx(np.log1p(recent) - np.log1p(base / 28 * 7))


def test_single_use_token_is_neutral(spark):
    df = spark.createDataFrame([(1, 10, 5), (2, 11, 9)], "id int, tok int, t bigint")
    assert [r.trend_token for r in T.token_momentum(df, "tok", "t").collect()] == [0.0, 0.0]


@pytest.mark.parametrize("blocks", [None, 1, 5])
def test_asof_join(hot, spark, blocks):
    pdf, df = hot
    state = pdf[pdf["y"] == 1].groupby(["a", "t"])["v"].max().reset_index()
    right = spark.createDataFrame(state.rename(columns={"t": "rt", "v": "rv"}))
    got = asof_join(df, right, "a", "t", "rt", {"rv": "found"}, blocks=blocks).toPandas().set_index("id")
    assert len(got) == len(pdf)
    for row in pdf.sample(80, random_state=4).itertuples():
        seen = state[(state["a"] == row.a) & (state["t"] <= row.t)].sort_values("t")
        if len(seen):
            assert got.loc[row.id, "found"] == seen["v"].iloc[-1]  # an exact time match counts
        else:
            assert np.isnan(got.loc[row.id, "found"])
