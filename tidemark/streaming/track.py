"""Delayed-label tracking as a stream: register, thin, freeze the first day, label at maturity.

Snapshots of an item arrive over weeks. Per item the stream keeps a few numbers, the items of a bucket
together, and emits an append-only log of what became final: ``registered``, ``day1`` and ``label`` (or ``no_baseline``).
The clock is the snapshot's own time, so a replay gives the same log as the live run. A snapshot
that is not newer than the last accepted one is late and changes nothing.

State of an item goes some time after its last snapshot. :func:`track_run` then keeps what was
decided in a durable ledger, so an item that returns goes on where it ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.constants import (
    BASELINE_ITEMS, BASELINE_MIN, BIAS_MAX_SHARE, BIAS_MIN_LABELS, DAY_US, HORIZON_DAYS, MIN_GAP_HOURS, RETRAIN_MIN_ROWS,
)
from tidemark.functions.calendar import day1_validity
from tidemark.session import fresh_path
from tidemark.streaming.ledger import Ledger

HOUR_US = 3_600_000_000
LOG = "item_id string, author string, event string, t bigint, views double, likes double, age_days double, label int"
RAW = LOG + ", began bigint, known boolean, median_views double, day1 boolean, labelled boolean, noted boolean"
STATE = "items binary"
STATE_BUCKETS = 512  # items are dealt to so many states; a call sees one of them, which holds about 40 bytes and the id of each item
ITEM = {"began": np.int64, "last": np.int64, "due": np.int64, "day1": np.bool_, "labelled": np.bool_, "noted": np.bool_, "valued": np.bool_}
RETIRED = "item_id string, began bigint, day1 boolean, labelled boolean, noted boolean"
RETENTION_DAYS = 120


def snapshot_stream(
    spark: SparkSession, path: str, schema, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as a stream; ``files_per_batch`` bounds the rows one batch brings per item."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def track_stream(
    snapshots: DataFrame, baselines: DataFrame, gap_hours: float = MIN_GAP_HOURS, maturity_days: float = HORIZON_DAYS,
    late: str = "30 days", retention_days: float = RETENTION_DAYS,
) -> DataFrame:
    """The event log of a snapshot stream.

    ``snapshots``: item_id, author, ts, upload_date, added_at, views, likes; ``baselines``:
    author, median_views. Age counts from the upload date, else from ``added_at``, else from the
    first snapshot. An item's state goes once event time is ``retention_days`` past its last
    snapshot; seen again after that it is a new item here, and only :func:`track_run` knows better.
    """
    raw = raw_events(snapshots, baselines, gap_hours, maturity_days, late, retention_days)
    return raw.filter("event NOT IN ('valued', 'retired')").select(*[c.split()[0] for c in LOG.split(", ")])


def raw_events(
    snapshots: DataFrame, baselines: DataFrame, gap_hours: float, maturity_days: float, late: str, retention_days: float
) -> DataFrame:
    """Events of :func:`track_stream`, and two more that each appear once per life of a state: ``valued``, the first
    accepted snapshot that could be labelled whatever its age, and ``retired``, what was decided when the state goes."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.coalesce(F.unix_micros(F.coalesce(F.try_to_timestamp("upload_date", F.lit("yyyyMMdd")), F.col("added_at"))), t)
    rows = (
        snapshots.join(baselines.select("author", "median_views"), "author", "left")
        .select(
            "item_id", "author", F.col("ts").cast("timestamp").alias("ts"), t.alias("t"), start.alias("start"),
            F.col("views").cast("double").alias("views"), F.col("likes").cast("double").alias("likes"), "median_views",
            F.pmod(F.xxhash64("item_id"), F.lit(STATE_BUCKETS)).cast("int").alias("_bucket"),
        )
        .filter("item_id IS NOT NULL AND ts IS NOT NULL")
        .withWatermark("ts", late)
    )
    gap, mature, keep_ms = int(gap_hours * HOUR_US), int(maturity_days * DAY_US), int(retention_days * 86_400_000)

    # A call costs about a millisecond whatever it holds, so it sees the items of a bucket, not one item.
    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, held = _unpacked(state.get[0]) if state.exists else _no_items()
        now, log, seen = state.getCurrentWatermarkMs(), [], np.empty(0, np.int64)
        if not state.hasTimedOut:
            parts = list(batches)
            rows = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in ("item_id", "t", "author", "start", "views", "likes", "median_views")}
            code, names = pd.factorize(rows["item_id"])
            seen = pd.Index(ids).get_indexer(names)
            items = {c: np.where(seen < 0, v.dtype.type(0), v[seen] if len(ids) else v.dtype.type(0)) for c, v in held.items()}
            log = [_advanced(rows, code, items, seen < 0, gap, mature)]
            items["due"] = np.maximum(items["last"] // 1000, now) + keep_ms
        gone = held["due"] < now
        gone[seen[seen >= 0]] = False
        if gone.any():
            log.append(_retired(ids[gone], {c: v[gone] for c, v in held.items()}))
        stay = ~gone
        stay[seen[seen >= 0]] = False
        ids, held = ids[stay], {c: v[stay] for c, v in held.items()}
        if len(seen):
            ids, held = np.concatenate([ids, names]), {c: np.concatenate([v, items[c]]) for c, v in held.items()}
        if len(ids):
            state.update((_packed(ids, held),))
            state.setTimeoutTimestamp(int(held["due"].min()))
        elif state.exists:
            state.remove()
        yield from (e for e in log if len(e))

    return rows.groupBy("_bucket").applyInPandasWithState(advance, RAW, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _no_items() -> tuple[np.ndarray, dict[str, np.ndarray]]:
    return np.empty(0, object), {c: np.empty(0, kind) for c, kind in ITEM.items()}


def _packed(ids: np.ndarray, items: dict[str, np.ndarray]) -> bytes:
    """The ids and the numbers of some items as one value."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *[pa.array(items[c]) for c in ITEM]], names=["item_id", *ITEM])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    with pa.ipc.open_stream(pa.py_buffer(bytes(value))) as given:
        batch = given.read_next_batch()
    return np.array(batch.column(0).to_pylist(), object), {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ITEM}


def _first_from(times: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The first place of each range ``low`` to ``high`` whose time is no less than ``least``, else ``high``; times ascend in a range."""
    low, high = low.copy(), high.copy()
    while (wide := np.flatnonzero(low < high)).size:
        middle = (low[wide] + high[wide]) // 2
        before = times[middle] < least[wide]
        low[wide[before]] = middle[before] + 1
        high[wide[~before]] = middle[~before]
    return low


def _advanced(rows: dict, code: np.ndarray, items: dict, new: np.ndarray, gap: int, mature: int) -> pd.DataFrame:
    """Take the snapshots of many items in the order of their times and change ``items``; the events this makes.

    ``code`` says whose snapshot a row is, ``new`` which items have no state yet. All items go from one accepted snapshot to
    their next one together, so a round costs a few array operations.
    """
    order = np.lexsort((rows["t"], code))
    times, whose = rows["t"][order], code[order]
    low, high = (np.searchsorted(whose, np.arange(len(new)), side) for side in ("left", "right"))
    then = lambda t: np.maximum(t + gap, t + 1)
    at = np.where(new, low, _first_from(times, low, high, then(items["last"])))
    known_rows = ~(np.isnan(rows["views"]) | np.isnan(rows["median_views"]))
    new, log = new.copy(), []
    while (live := np.flatnonzero((at < high) & ~items["labelled"])).size:
        row = order[at[live]]
        t, known, first = rows["t"][row], known_rows[row], new[live]
        items["began"][live] = np.where(first, rows["start"][row], items["began"][live])
        age = t - items["began"][live]
        due = ~first & (age >= mature)
        made = {
            "registered": first, "valued": known & ~items["valued"][live], "day1": ~first & (age >= DAY_US) & ~items["day1"][live],
            "label": due & known, "no_baseline": due & ~known & ~items["noted"][live],
        }
        for flag, event in (("valued", "valued"), ("day1", "day1"), ("labelled", "label"), ("noted", "no_baseline")):
            items[flag][live[made[event]]] = True
        new[live], items["last"][live] = False, t
        at[live] = _first_from(times, at[live] + 1, high[live], then(t))
        log.extend((np.full(int(m.sum()), event, object), row[m], age[m], known[m]) for event, m in made.items() if m.any())
    return _events(rows, *(np.concatenate(x) for x in zip(*log, strict=True))) if log else _frame(0, {}, {}, {})


def _frame(n: int, texts: dict, numbers: dict, whole: dict) -> pd.DataFrame:
    """Rows of RAW from the columns that are given; the others are null."""
    columns = {}
    for name, kind in (c.split() for c in RAW.split(", ")):
        if kind == "string":
            columns[name] = texts.get(name, np.full(n, None, object))
        elif kind == "double":
            columns[name] = numbers.get(name, np.full(n, np.nan))
        else:
            columns[name] = pd.array(whole.get(name, [None] * n), dtype={"bigint": "Int64", "int": "Int32", "boolean": "boolean"}[kind])
    return pd.DataFrame(columns)


def _events(rows: dict, event: np.ndarray, row: np.ndarray, age: np.ndarray, known: np.ndarray) -> pd.DataFrame:
    texts = {"item_id": rows["item_id"][row], "author": rows["author"][row], "event": event}
    numbers = {c: rows[c][row] for c in ("views", "likes", "median_views")} | {"age_days": age / DAY_US}
    above = (numbers["views"] > numbers["median_views"]).astype(np.int32)
    label = pd.arrays.IntegerArray(above, event != "label")
    return _frame(len(row), texts, numbers, {"t": rows["t"][row], "began": rows["t"][row] - age, "known": known, "label": label})


def _retired(ids: np.ndarray, items: dict) -> pd.DataFrame:
    whole = {"t": items["last"]} | {c: items[c] for c in ("began", "day1", "labelled", "noted")}
    return _frame(len(ids), {"item_id": ids, "event": np.full(len(ids), "retired", object)}, {}, whole)


def retired_items(spark: SparkSession, out: str) -> Ledger:
    """What was decided about items whose state is gone: their start and three flags, which never go back."""
    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("item_id").agg(F.min("began").alias("began"), *[F.max(c).alias(c) for c in ("day1", "labelled", "noted")])

    return Ledger(spark, f"{out}/retired", RETIRED, "item_id", merge)


def _resumed(events: DataFrame, mature: int) -> DataFrame:
    """Events of items that return: their snapshots are judged by the age and the decisions of their earlier life.

    Retention is no shorter than maturity, so a returning item is old enough for both decisions: the day-1 values
    come from its first snapshot and the label from its first one with known values. ``events`` has the ledger's
    columns with ``was_`` before them.
    """
    age = F.col("t") - F.col("was_began")
    new = F.when((F.col("event") == "registered") & ~F.col("was_day1") & (age >= DAY_US), F.lit("day1"))
    new = F.array_compact(
        F.array(
            new,
            F.when((F.col("event") == "valued") & ~F.col("was_labelled") & (age >= mature), F.lit("label")),
            F.when((F.col("event") == "registered") & ~F.col("known") & ~F.col("was_noted") & ~F.col("was_labelled") & (age >= mature), F.lit("no_baseline")),
        )
    )
    rows = events.withColumn("_new", F.explode(new)).withColumn("age_days", age / F.lit(float(DAY_US)))
    label = F.when(F.col("_new") == "label", (F.col("views") > F.col("median_views")).cast("int"))
    return rows.withColumn("label", label).withColumn("event", F.col("_new")).drop("_new")


def track_run(
    snapshots: DataFrame, baselines: DataFrame, out: str, checkpoint: str, gap_hours: float = MIN_GAP_HOURS, maturity_days: float = HORIZON_DAYS,
    late: str = "30 days", retention_days: float = RETENTION_DAYS,
) -> None:
    """Process what there is of a snapshot stream and append one log to ``out``: each event at most once per item, for ever.

    State is bounded by retention; what it held goes to a ledger, and every batch looks its items up there. A batch
    that is run again writes the same folders again. A rerun goes on where the last one ended.
    """
    if retention_days < max(maturity_days, 1):
        raise ValueError("retention is shorter than maturity: a returning item could be too young to decide")
    spark, mature = snapshots.sparkSession, int(maturity_days * DAY_US)
    retired, columns = retired_items(spark, out), [c.split()[0] for c in LOG.split(", ")]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/raw/batch={batch_id}")  # the stateful plan runs once
        rows = spark.read.schema(RAW).parquet(f"{out}/raw/batch={batch_id}")
        was = retired.read(batch_id, rows.select("item_id"))
        was = was.select("item_id", *[F.col(c).alias(f"was_{c}") for c in ("began", "day1", "labelled", "noted")])
        joined = rows.join(was, "item_id", "left")
        fresh = joined.filter("was_began IS NULL AND event NOT IN ('valued', 'retired')")
        back = _resumed(joined.filter("was_began IS NOT NULL AND event IN ('registered', 'valued')"), mature)
        fresh.select(*columns).unionByName(back.select(*columns)).write.mode("overwrite").parquet(f"{out}/log/batch={batch_id}")
        gone = rows.filter("event = 'retired'").select("item_id", "began", "day1", "labelled", "noted")
        flags = [(F.col("event") == e).alias(c) for e, c in (("day1", "day1"), ("label", "labelled"), ("no_baseline", "noted"))]
        retired.put(gone.unionByName(back.select("item_id", F.col("was_began").alias("began"), *flags)), batch_id)

    stream = raw_events(snapshots, baselines, gap_hours, maturity_days, late, retention_days)
    run_batches(stream, write, checkpoint)


def tracked_log(spark: SparkSession, out: str, stream: bool = False) -> DataFrame:
    """The log of :func:`track_run`, whole or as a stream of its batches."""
    return (spark.readStream if stream else spark.read).schema(LOG).option("basePath", f"{out}/log").parquet(f"{out}/log/batch=*")


def run_batches(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Give every micro-batch there is to ``write`` and stop."""
    q = (
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything there is, append it to ``out``, and stop; a rerun goes on where it ended."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .option("path", out).trigger(availableNow=True).start()
    )
    q.awaitTermination()


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into a new table of the shared folder and read it."""
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, f"{name}-table"), fresh_path(spark, f"{name}-checkpoint")
    run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


def tracked_table(log: DataFrame) -> DataFrame:
    """One row per item from the event log."""
    def of(event: str, value: str):
        # the first event counts: an item seen again after its state was dropped changes nothing
        return F.min_by(F.col(value), F.when(F.col("event") == event, F.col("t")))

    return log.groupBy("item_id").agg(
        of("registered", "author").alias("author"), of("registered", "t").alias("added_t"),
        of("day1", "views").alias("day1_views"), of("day1", "likes").alias("day1_likes"),
        of("day1", "age_days").alias("age_at_freeze"), of("label", "label").alias("label"),
        of("label", "t").alias("labeled_t"),
        F.max(F.when(F.col("event") == "no_baseline", "no_baseline")).alias("_note"),
    ).select(
        "item_id", "author", "added_t", F.when(F.col("label").isNotNull(), "labeled").otherwise("tracking").alias("status"),
        "day1_views", "day1_likes", "age_at_freeze", day1_validity("age_at_freeze").alias("day1_validity"),
        "label", "labeled_t", F.when(F.col("label").isNull(), F.col("_note")).alias("note"),
    )


def pool_status(tracked: DataFrame, min_rows: int = RETRAIN_MIN_ROWS) -> DataFrame:
    """One row: counts by status and label, readiness to retrain, and whether one class dominates."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    one = tracked.agg(
        n(F.col("status") == "tracking").alias("tracking"), n(F.col("status") == "labeled").alias("labeled"),
        n(F.col("label") == 1).alias("hit"), n(F.col("label") == 0).alias("flop"),
    )
    return _readiness(one, min_rows)


def _readiness(one: DataFrame, min_rows: int) -> DataFrame:
    total = F.col("hit") + F.col("flop")
    biased = (total >= BIAS_MIN_LABELS) & (F.greatest("hit", "flop") / total > BIAS_MAX_SHARE)
    return one.withColumns({"ready": (total >= min_rows).cast("int"), "warning": F.when(biased, "one_class")})


def status_changes(log: DataFrame) -> DataFrame:
    """Every event as the counters it moves: an item that is labelled leaves ``tracking`` and enters two others."""
    def move(counter, by: int):
        return F.struct(counter.alias("counter") if not isinstance(counter, str) else F.lit(counter).alias("counter"), F.lit(by).cast("bigint").alias("delta"))

    outcome = F.when(F.col("label") == 1, "hit").otherwise("flop")
    moves = F.when(F.col("event") == "registered", F.array(move("tracking", 1)))
    moves = moves.when(F.col("event") == "label", F.array(move("tracking", -1), move("labeled", 1), move(outcome, 1)))
    return log.select(F.explode(moves).alias("m")).select("m.*")


def pool_status_stream(log_stream: DataFrame, name: str = "pool", min_rows: int = RETRAIN_MIN_ROWS) -> DataFrame:
    """:func:`pool_status` from running counters: each batch adds its changes, and no batch reads the log again.

    Update mode: a batch writes the counters that it moved, at most four rows.
    """
    counts = status_changes(log_stream).groupBy("counter").agg(F.sum("delta").alias("n"))
    last = run_updates(counts, name, ["counter"])
    wide = [F.coalesce(F.max(F.when(F.col("counter") == c, F.col("n"))), F.lit(0)).alias(c) for c in ("tracking", "labeled", "hit", "flop")]
    return _readiness(last.agg(*wide), min_rows)


def day1_lookup(keys: DataFrame, tracked: DataFrame) -> DataFrame:
    """Frozen first-day counters by item; items not frozen yet give null."""
    frozen = tracked.filter("day1_views IS NOT NULL").select(
        "item_id", F.col("day1_views").alias("play_count"), F.coalesce("day1_likes", F.lit(0.0)).alias("like_count")
    )
    return keys.join(frozen, "item_id", "left")


def training_rows(log: DataFrame, content: DataFrame) -> DataFrame:
    """Labelled items in the training schema, unknown flags set to neutral values."""
    labelled = log.filter("event = 'label'").select("item_id", F.col("author").alias("author_id"), F.col("label").alias("y"))
    return labelled.join(content, "item_id", "left").withColumns(
        {"is_english": F.lit(True), "created_by_ai": F.lit(False), "is_ads": F.lit(False)}
    )


def feed_training(log_stream: DataFrame, content: DataFrame, out: str, checkpoint: str) -> None:
    """Append newly labelled items to the training table; a repeated batch replaces its own folder.

    Give it the log of :func:`track_run`, where an item is labelled once however often it returns.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        training_rows(batch, content).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(log_stream, write, checkpoint)


def upsert_baselines(updates: DataFrame, out: str, checkpoint: str) -> None:
    """Append baseline updates batch by batch; :func:`current_baselines` reads the newest per author."""
    def write(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("author").agg(F.max_by(F.struct("median_views", "n", "updated_at"), "updated_at").alias("b"))
        newest.select("author", "b.*").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(updates, write, checkpoint)


def newest_items(spark: SparkSession, out: str, last: int = BASELINE_ITEMS, every: int = 20) -> Ledger:
    """The newest ``last`` items of every author as a ring: (ts, v) in descending time.

    Rings merge in any order, so batches may bring items late, and a batch reads nothing of what is stored.
    """
    def merge(rows: DataFrame) -> DataFrame:
        all_rings = F.flatten(F.collect_list("ring"))  # an author has at most `every` + 1 rings
        return rows.groupBy("author").agg(F.slice(F.sort_array(all_rings, asc=False), 1, last).alias("ring"))

    return Ledger(spark, out, "author string, ring array<struct<ts: timestamp, v: double>>", "author", merge, every=every)


def feed_baselines(items: DataFrame, out: str, checkpoint: str, last: int = BASELINE_ITEMS, every: int = 20) -> None:
    """Keep every author's newest items from a stream of (author, ts, v); :func:`fed_baselines` has their medians.

    A batch is reduced to a ring per (author, salt) and then per author, so a hot author is no single task's work.
    """
    ledger = newest_items(items.sparkSession, out, last, every)
    newest = lambda c: F.slice(F.sort_array(c, asc=False), 1, last)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("author IS NOT NULL AND ts IS NOT NULL").select(
            "author", F.col("ts").cast("timestamp").alias("ts"), F.col("v").cast("double").alias("v"), F.pmod(F.xxhash64("ts", "v"), F.lit(64)).alias("_salt")
        )
        local = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("author", "_salt").orderBy(F.col("ts").desc()))).filter(F.col("_rn") <= last)
        ledger.put(local.groupBy("author").agg(newest(F.collect_list(F.struct("ts", "v"))).alias("ring")), batch_id)

    run_batches(items, write, checkpoint)


def fed_baselines(spark: SparkSession, out: str, last: int = BASELINE_ITEMS, need: int = BASELINE_MIN, every: int = 20) -> DataFrame:
    """author, median_views and n: the median of the known values among each author's newest items; too few give no row."""
    tall = newest_items(spark, out, last, every).read().select("author", F.explode("ring.v").alias("v")).filter("v IS NOT NULL")
    return tall.groupBy("author").agg(F.percentile("v", F.lit(0.5)).alias("median_views"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need)


def current_baselines(spark: SparkSession, out: str) -> DataFrame:
    """The newest baseline of every author."""
    log = spark.read.parquet(out)
    newest = F.max_by(F.struct("median_views", "n", "updated_at"), F.struct("updated_at", "batch"))
    return log.groupBy("author").agg(newest.alias("b")).select("author", "b.*")


def tumbling_counts(stream: DataFrame, ts: str, width: str, late: str = "1 day") -> DataFrame:
    """Rows per window."""
    return (
        stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
        .groupBy(F.window(ts, width)).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), "n")
    )


def run_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a windowed aggregate to its end and return the last row of every key.

    Update mode: a batch writes the windows that it changed, and state of windows behind the watermark goes.
    A batch that is run again writes the same folder again.
    """
    spark = stream.sparkSession
    out, checkpoint = fresh_path(spark, f"{name}-result"), fresh_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run_batches(stream, write, checkpoint, "update")
    schema = stream.schema.add("batch", "long")
    rest = [c for c in stream.columns if c not in keys]
    log = spark.read.schema(schema).option("basePath", out).parquet(out)
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return newest.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])
