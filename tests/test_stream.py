import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.session import fresh_path
from tidemark.streaming import track as T
from tidemark.streaming.ledger import Ledger

T0 = dt.datetime(2024, 6, 1)
SCHEMA = "item_id string, author string, ts timestamp, upload_date string, added_at timestamp, views double, likes double"


def snap(item, hours, views, author="a", upload=None):
    return (item, author, T0 + dt.timedelta(hours=hours), upload, None, float(views), 1.0)


def run(spark, batches, **kw):
    """Every batch is one file and one micro-batch."""
    src = fresh_path(spark, "snaps")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    base = spark.createDataFrame([("a", 500.0)], "author string, median_views double")
    stream = T.snapshot_stream(spark, src, SCHEMA, files_per_batch=1)
    log = T.replay(T.track_stream(stream, base, **kw), "track")
    return log, {r.item_id: r for r in T.tracked_table(log).collect()}


def test_label_at_maturity_and_frozen_day1(spark):
    rows = [snap("hit", 0, 10), snap("hit", 30, 200), snap("hit", 60, 300), snap("hit", 24 * 15, 900), snap("hit", 24 * 16, 1)]
    rows += [snap("flop", 0, 5), snap("flop", 24 * 15, 100), snap("open", 0, 5, "nobody"), snap("open", 24 * 15, 9e9, "nobody")]
    log, got = run(spark, [rows])
    assert (got["hit"].label, got["hit"].day1_views, got["hit"].day1_validity) == (1, 200.0, "ok")
    assert (got["flop"].label, got["flop"].day1_validity) == (0, "unreliable")
    assert (got["open"].label, got["open"].status, got["open"].note) == (None, "tracking", "no_baseline")
    assert log.filter("event = 'registered'").count() == 3


def test_an_item_costs_little_beside_its_rows(spark):
    """A call of the stateful function sees one item, so whole-frame work such as sorting or casting is not in it; nulls stay null."""
    for inner in T.raw_events.__code__.co_consts:
        assert not {"sort_values", "astype", "reindex", "iloc"} & set(getattr(inner, "co_names", ()))
    rows = [snap("x", 0, 10), (("x", None, T0 + dt.timedelta(hours=30), None, None, None, None)), snap("x", 24 * 15, 900)]
    log, got = run(spark, [rows])
    frozen = log.filter("event = 'day1'").first()
    assert (frozen.views, frozen.likes, frozen.author, frozen.age_days) == (None, None, None, 1.25) and got["x"].label == 1


def test_a_call_sees_the_items_of_a_bucket(spark):
    """Calls have a fixed cost, so their number is bounded by the buckets; every item of a bucket is decided and retired by its own clock."""
    rows = [snap(f"i{k}", h, 400 + 30 * k + h / 100) for h in (0, 30, 31, 24 * 15) for k in range(8)]
    parts = [rows[:24] + [snap("new", 40, 1)], rows[24:] + [snap("clock", 24 * 60, 1)], [snap("i3", 24 * 61, 1), snap("new", 24 * 61, 900)]]
    apart, _ = log_of(spark, parts)
    buckets, T.STATE_BUCKETS = T.STATE_BUCKETS, 2
    try:
        together, out = log_of(spark, parts)
        groups = T.raw_events(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("a", 1.0)], "author string, median_views double"), 6, 14, "1 day", 15)
    finally:
        T.STATE_BUCKETS = buckets
    assert together == apart and len(together) == 8 * 3 + 4
    assert {r.item_id for r in T.retired_items(spark, out).read().collect()} >= {f"i{k}" for k in range(8)}
    assert "pmod(xxhash64(item_id" in groups._jdf.queryExecution().logical().toString()


def test_split_into_batches_gives_the_same_table(spark):
    rows = [snap("x", h, 100.0 + h) for h in range(0, 24 * 16, 5)]
    _, one = run(spark, [rows])
    _, many = run(spark, [rows[:20], rows[20:40], rows[40:]])
    assert one == many and one["x"].label is not None


def test_min_gap_and_late_snapshots_change_nothing(spark):
    rows = [snap("x", 0, 1), snap("x", 23, 2), snap("x", 25, 3), snap("x", 30, 4)]
    _, got = run(spark, [rows])
    assert got["x"].day1_views == 4.0  # 25 h is within six hours of the accepted 23 h
    _, late = run(spark, [rows, [snap("x", 26, 77), snap("x", 0, 88)]])
    assert late == got


def test_age_counts_from_upload_date(spark):
    _, got = run(spark, [[snap("x", 0, 1, upload="20240510"), snap("x", 7, 900, upload="20240510")]])
    assert got["x"].label == 1 and got["x"].day1_validity == "unreliable"


def test_pool_status(spark):
    tracked = spark.createDataFrame(
        [(f"i{i}", "labeled", 1) for i in range(12)] + [("j", "tracking", None)], "item_id string, status string, label int"
    )
    s = T.pool_status(tracked).first()
    assert (s.tracking, s.labeled, s.hit, s.flop, s.ready) == (1, 12, 12, 0, 0) and s.warning
    assert T.pool_status(tracked, min_rows=10).first().ready == 1


def test_resumed_run_adds_only_new_rows(spark):
    src, out, ck = (fresh_path(spark, n) for n in ("src", "out", "ck"))
    base = spark.createDataFrame([("a", 500.0)], "author string, median_views double")

    def go(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        T.run_available(T.track_stream(T.snapshot_stream(spark, src, SCHEMA), base), out, ck)
        return sorted((r.item_id, r.event) for r in spark.read.parquet(out).collect())

    assert go([snap("x", 0, 1)]) == [("x", "registered")]
    assert go([snap("x", 0, 1), snap("x", 26, 2)]) == [("x", "day1"), ("x", "registered")]


@pytest.mark.parametrize("upload", [None, "not a date"])
def test_bad_upload_date_falls_back(spark, upload):
    _, got = run(spark, [[snap("x", 0, 1, upload=upload), snap("x", 25, 5, upload=upload)]])
    assert got["x"].age_at_freeze == pytest.approx(25 / 24)


def log_of(spark, deliveries, base=(("a", 500.0),), **kw):
    """One run per delivery, as a daily job would do it; the log, and the folders."""
    src, out, ck = (fresh_path(spark, n) for n in ("src", "out", "ck"))
    base = spark.createDataFrame(list(base), "author string, median_views double")
    for rows in deliveries:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        T.track_run(T.snapshot_stream(spark, src, SCHEMA), base, out, ck, **({"late": "1 day", "retention_days": 15} | kw))
    log = T.tracked_log(spark, out)
    return sorted((r.item_id, r.event, r.t, r.views, r.label) for r in log.collect()), out


def events(log):
    return sorted((item, event) for item, event, *_ in log)


def test_a_labelled_item_that_returns_after_retention_is_not_labelled_again(spark):
    first = [snap("x", 0, 10), snap("x", 26, 200), snap("x", 24 * 15, 900)]
    others = [[snap("clock", 24 * d, 1, "b")] for d in (60, 61, 62)]
    back = [snap("x", 24 * 400, 1), snap("x", 24 * 402, 2), snap("x", 24 * 420, 3), snap("x", 25, 77)]
    log, out = log_of(spark, [first, *others, back, [snap("x", 24 * 440, 5)]])
    assert [e for e in events(log) if e[0] == "x"] == [("x", "day1"), ("x", "label"), ("x", "registered")]
    assert [r[4] for r in log if r[1] == "label"] == [1]
    kept = T.retired_items(spark, out).read().filter("item_id = 'x'").first()
    assert kept.labelled and kept.day1 and T.training_rows(T.tracked_log(spark, out), spark.createDataFrame([], "item_id string")).count() == 1


@pytest.mark.parametrize("views,when,label", [(900.0, 24 * 200, 1), (None, 24 * 201, 0)])
def test_an_open_item_that_returns_goes_on_where_it_ended(spark, views, when, label):
    """Age still counts from the first snapshot ever, so the first known value after the return is the label."""
    clock = [[snap("clock", 24 * d, 1, "b")] for d in (60, 61, 62)]
    first = ("x", "a", T0 + dt.timedelta(hours=24 * 200), None, None, views, 1.0)
    log, _ = log_of(spark, [[snap("x", 0, 10), snap("x", 3, 20)], *clock, [first], [snap("x", 24 * 201, 30)], [snap("x", 24 * 300, 7000)]])
    got = {e: (t, v, y) for i, e, t, v, y in log if i == "x"}
    expect = ["day1", "label", "registered"] + (["no_baseline"] if views is None else [])
    assert sorted(got) == sorted(expect) and len([r for r in log if r[0] == "x"]) == len(expect)
    at = int((T0 + dt.timedelta(hours=when) - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert got["label"][0] == at and got["label"][2] == label and got["day1"][1] == views


def test_state_that_is_kept_and_state_that_returns_give_one_log(spark):
    rows = [snap(f"i{k}", h * (k + 1), 300 + 40 * k + h, upload="20240530" if k % 2 else None) for k in range(6) for h in range(0, 24 * 40, 31)]
    rows.sort(key=lambda r: r[2])
    parts = [rows[i : i + 25] for i in range(0, len(rows), 25)]
    short, _ = log_of(spark, parts, maturity_days=2, retention_days=2)
    long, _ = log_of(spark, parts, maturity_days=2, retention_days=4000)
    assert short == long and len(short) >= 18


def test_retention_below_maturity_is_refused(spark):
    with pytest.raises(ValueError):
        log_of(spark, [[snap("x", 0, 1)]], maturity_days=14, retention_days=5)


def test_running_counters_equal_the_batch_status(spark):
    rows = [snap(f"i{k}", h, 400 + 30 * k) for h in (0, 30, 24 * 15) for k in range(12)] + [snap("open", 24 * 15, 1)]
    _, out = log_of(spark, [rows[:20], rows[20:], [snap("late", 24 * 16, 5)]])
    want = T.pool_status(T.tracked_table(T.tracked_log(spark, out))).first()
    assert T.pool_status_stream(T.tracked_log(spark, out, stream=True)).first() == want and want.labeled == 12 and want.tracking == 2
    moved = T.status_changes(T.tracked_log(spark, out).filter("item_id = 'i0'")).collect()
    assert sorted((r.counter, r.delta) for r in moved) == [("flop", 1), ("labeled", 1), ("tracking", -1), ("tracking", 1)]


def test_baselines_of_a_stream_equal_the_batch_after_every_delivery(spark):
    from tidemark.operators.profile import baseline_median

    src, out, ck = (fresh_path(spark, n) for n in ("src", "rings", "ck"))
    rows = [("hot" if i % 3 else f"a{i % 7}", T0 + dt.timedelta(minutes=(i * 37) % 500, seconds=i), None if i % 5 == 0 else float(i)) for i in range(200)]
    rows += [("few", T0, 1.0), (None, T0, 2.0)]
    schema = "author string, ts timestamp, v double"
    for at in range(0, len(rows), 30):
        spark.createDataFrame(rows[at : at + 30], schema).coalesce(1).write.mode("append").parquet(src)
        T.feed_baselines(T.snapshot_stream(spark, src, schema), out, ck, every=2)
        seen = spark.createDataFrame(rows[: at + 30], schema).filter("author IS NOT NULL")
        want = sorted((r.author, r.median_value, r.n) for r in baseline_median(seen, "author", "ts", "v").collect())
        assert sorted((r.author, r.median_views, r.n) for r in T.fed_baselines(spark, out, every=2).collect()) == want
    ledger = T.newest_items(spark, out, every=2)
    assert any(kind == "base" for kind, _ in ledger.parts()) and len(ledger.parts()) <= 4
    before = sorted(map(str, ledger.read().collect()))
    ledger.vacuum()
    assert sorted(map(str, ledger.read().collect())) == before


def test_a_batch_that_runs_again_replaces_its_rows(spark):
    ledger = Ledger(spark, fresh_path(spark, "ledger"), "k string, n bigint", "k", lambda d: d.groupBy("k").agg(F.sum("n").alias("n")), buckets=3, every=2)
    put = lambda i, *rows: ledger.put(spark.createDataFrame(rows, "k string, n bigint"), i)
    assert ledger.read().count() == 0
    put(0, ("x", 1), ("y", 2))
    put(1, ("x", 10))
    put(1, ("x", 100))
    put(2, ("z", 5))
    put(3, ("z", 7))
    assert {r.k: r.n for r in ledger.read().collect()} == {"x": 101, "y": 2, "z": 12}
    assert {r.k: r.n for r in ledger.read(before=2).collect()} == {"x": 101, "y": 2}
    keys = spark.createDataFrame([("z",), ("new",)], "k string")
    assert {r.k: r.n for r in ledger.read(keys=keys).collect()} == {"z": 12}
