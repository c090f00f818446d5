import pytest
from pyspark.sql import functions as F

from tidemark.constants import DAY_US
from tidemark.operators import encode as E
from tidemark.operators import joins as J
from tidemark.operators import panel as P


def test_within_group_label(spark):
    rows = [(i, a, v) for i, (a, v) in enumerate([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 10.0), ("b", 20.0), ("b", 30.0)])]
    df = spark.createDataFrame(rows, "id int, a string, v double")
    got = P.within_group_label(df, "v", "a", "c", "y").orderBy("id").collect()
    assert [r.y for r in got] == [0, 0, 1, 0, 0, 1]


def test_unknown_value_is_zero_and_marked(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 5.0)], "id int, a string, v double")
    got = {r.id: r for r in P.within_group_label(df, "v", "a", "c", "y").collect()}
    assert len(got) == 3
    assert (got[2].y, got[2].y_known) == (0, 0)
    assert (got[3].y, got[3].y_known) == (0, 0)


def test_latest_keeps_the_last_row_even_if_null(spark):
    panel = spark.createDataFrame(
        [("x", 0, 5.0), ("x", 7, None), ("x", 20, 9.0), ("y", 16, 1.0)], "item_id string, day int, play double"
    )
    got = {r.item_id: r.play for r in P.latest_at(panel, "item_id", "day", 14, ["play"]).collect()}
    assert got == {"x": None}
    wide = {r.item_id: (r.play_3, r.play_14, r.play_30) for r in P.latest_at_many(panel, "item_id", "day", "play", [3, 14, 30]).collect()}
    assert wide["x"] == (5.0, None, 9.0)


def test_canonical_hand_case(spark):
    items = spark.createDataFrame([("i1", "a", 10 * DAY_US), ("i2", "a", 20 * DAY_US), ("i3", "b", 5 * DAY_US)], "item_id string, author_id string, t bigint")
    panel = spark.createDataFrame(
        [("i1", 0, 10.0, 1.0, None, 1.0, None), ("i1", 14, 100.0, 5.0, 1.0, None, 2.0), ("i1", 15, 999.0, 0.0, 0.0, 0.0, 0.0), ("i2", 1, 60.0, 3.0, 0.0, 0.0, 0.0)],
        "item_id string, days_since_post int, play_count double, like_count double, comment_count double, share_count double, collect_count double",
    )
    state = spark.createDataFrame([("a", 10 * DAY_US, 50.0), ("a", 30 * DAY_US, 80.0)], "author_id string, t bigint, follower_count double")
    got = {r.item_id: r for r in P.canonical(items, panel, state).collect()}
    assert got["i1"].views_at_H == 100 and got["i1"].followers_at_post == 50 and got["i1"].breakout == 2.0
    assert got["i1"].er == pytest.approx(0.08) and got["i1"].elig == 1
    assert got["i2"].followers_at_H == 80 and got["i2"].growth == pytest.approx(0.6)
    assert got["i3"].followers_at_post is None and got["i3"].elig == 0 and got["i3"].y_breakout_wc == 0
    assert got["i3"].log_play_d1 == 0 and got["i3"].er_d1 == 0


def test_target_encode_is_fold_safe(hot):
    pdf, df = hot
    enc = E.target_encode(df, "a", "y", F.col("id") < 300, "te")
    flipped = df.withColumn("y", F.when(F.col("id") < 300, F.col("y")).otherwise(1 - F.col("y")))
    other = E.target_encode(flipped, "a", "y", F.col("id") < 300, "te")
    one = enc.orderBy("id").select("te").toPandas()["te"]
    assert (one == other.orderBy("id").select("te").toPandas()["te"]).all()
    train = pdf[pdf["id"] < 300]
    want = pdf["a"].map(train.groupby("a")["y"].mean()).fillna(train["y"].mean())
    assert (abs(one - want) < 1e-12).all()


def test_tags_unknown_to_train_are_dropped(spark):
    df = spark.createDataFrame(
        [(1, ["x"], 1, True), (2, ["x", "y"], 0, True), (3, ["y", "new"], 0, False), (4, ["new"], 0, False), (5, [], 1, False)],
        "id int, tags array<string>, y int, train boolean",
    )
    got = {r.id: r.te for r in E.tag_target_encode(df, "id", "tags", "y", F.col("train"), "te").collect()}
    assert got == {1: 0.5, 2: 0.25, 3: 0.0, 4: 0.5, 5: 0.5}


def test_median_fill_uses_matched_rows(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    other = spark.createDataFrame([(1, 4.0), (2, 6.0), (9, 100.0)], "id int, s double")
    got = {r.id: r.s for r in J.left_with_median(df, other, "id", ["s"]).collect()}
    assert got == {1: 4.0, 2: 6.0, 3: 5.0}


def test_unknown_time_is_its_own_split(spark):
    df = spark.createDataFrame([(i, i) for i in range(1, 21)] + [(99, None)], "id int, t bigint")
    got = {r.id: r.split for r in P.temporal_split(df, "t").collect()}
    assert got[1] == "train" and got[20] == "test" and got[99] == "unknown"
