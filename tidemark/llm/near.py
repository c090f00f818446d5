"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, text_batches, text_key
from tidemark.session import cut

N = 5
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs exactly at the threshold; pairs above it are found more surely
HASHES = 80
BLOCK = 256  # members of a bucket that one unit of work compares with as many others


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): most rows per band, thus fewest false candidates, that reach the recall with so many hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        agree = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-agree)) if agree < 1 else 1
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, n: int = N) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct n-word runs; a text of fewer words is one run, none without words.

    Words are runs of characters other than ASCII white space. With m runs in two texts, the chance of a
    collision that changes their similarity is below m * m / 2**64.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = _mix(out + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
    return np.unique(out)


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:hashes] | np.uint64(1), seeds[hashes:]


def band_keys(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band from the minima of bands * rows hash functions."""
    a, b = _factors(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        part = grams[at : at + 2048]
        np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1), out=low)
    keys = np.zeros(bands, np.uint64)
    for row in low.reshape(bands, rows).T:
        keys = _mix(keys * np.uint64(31) + row)
    return keys


def _signatures(bands: int, rows: int):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            keys = []
            for text in batch.column("text").to_pylist():
                grams = ngrams(text)
                keys.append(band_keys(grams, bands, rows).view(np.int64) if len(grams) else np.empty(0, np.int64))
            sizes = np.cumsum([0, *map(len, keys)])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), lists], names=["key", "doc_id", "keys"])

    return tasks


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_batches(batches):
        sets = [ngrams(t).view(np.int64) for t in batch.column("text").to_pylist()]
        sizes = np.cumsum([0, *map(len, sets)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("tid"), lists], names=["tid", "grams"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _first_bands(keys_a: np.ndarray, keys_b: np.ndarray) -> np.ndarray:
    """First band in which each pair agrees."""
    return np.argmax(keys_a[:, None, :] == keys_b[None, :, :], axis=2)


def _units(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, dict]]:
    """Rows of each unit (band, key, i, j) of a sorted stream; a unit is at most two blocks of a bucket."""
    held: dict[str, list] = {c: [] for c in columns}
    now: tuple | None = None
    for batch in batches:
        heads = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "key", "i", "j")], axis=1)
        data = {c: (_lists(batch.column(c)) if pa.types.is_list(batch.column(c).type) else batch.column(c).to_numpy(zero_copy_only=False)) for c in columns}
        starts = [0, *(np.flatnonzero((heads[1:] != heads[:-1]).any(axis=1)) + 1).tolist(), len(heads)]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            if a == z:
                continue
            head = tuple(heads[a].tolist())
            if head != now:
                if now is not None:
                    yield now, held
                now, held = head, {c: [] for c in columns}
            for c in columns:
                held[c].extend(data[c][a:z])
    if now is not None:
        yield now, held


def _sides(head: tuple, side: list) -> tuple[np.ndarray, np.ndarray, bool]:
    """Member positions of the two blocks of a unit, and whether they are the same block."""
    s = np.asarray(side)
    same = head[2] == head[3]
    return np.flatnonzero(s == head[2]), np.flatnonzero(s == head[3]), same


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that have a pair to be checked in this unit: one whose first common band is the unit's."""
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        names = ["band", "key", "i", "j", "side", "tid"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], names=names)

    for head, held in _units(batches, ["side", "tid", "keys"]):
        left, right, same = _sides(head, held["side"])
        if len(left) and len(right) and (not same or len(left) > 1):
            keys = np.stack(held["keys"])
            own = np.zeros((len(left), len(right)), bool)
            for at in range(0, len(left), 64):
                own[at : at + 64] = _first_bands(keys[left[at : at + 64]], keys[right]) == head[0]
            if same:
                own &= ~np.eye(len(left), dtype=bool)
            used = {*left[own.any(axis=1)].tolist(), *right[own.any(axis=0)].tolist()}
            out += [(*head, held["side"][m], held["tid"][m]) for m in sorted(used)]
        if len(out) >= 20_000:
            yield emit()
            out = []
    yield emit()


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices over slices of the common elements."""
    members = np.concatenate([left, right])
    flat = np.concatenate([sets[m] for m in members])
    row = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    values, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    code = place[code]
    total = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    for at in range(0, len(shared), 4096):
        a, z = np.searchsorted(code, [at, at + 4096])
        grid = np.zeros((len(members), 4096), np.float32)
        grid[row[a:z], code[a:z] - at] = 1
        total += grid[: len(left)] @ grid[len(left) :].T
    return total


def _verify(threshold: float):
    def linked(head: tuple, held: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        left, right, same = _sides(head, held["side"])
        sets, keys = held["grams"], np.stack(held["keys"])
        sizes = np.asarray([len(s) for s in sets], np.float64)
        if len(left) * len(right) <= 16:
            both = np.zeros((len(left), len(right)))
            for x, m in enumerate(left):
                for y, o in enumerate(right):
                    if not same or x < y:
                        both[x, y] = len(np.intersect1d(sets[m], sets[o], assume_unique=True))
            both = np.maximum(both, both.T) if same else both
        else:
            both = _overlaps(sets, left, right).astype(np.float64)
        union = sizes[left][:, None] + sizes[right][None, :] - both
        ok = (both >= threshold * union) & (_first_bands(keys[left], keys[right]) == head[0])
        return left, right, ok & ~np.eye(len(left), dtype=bool) if same else ok, same

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["tid", "root", "links"])

        for head, held in _units(batches, ["side", "tid", "keys", "grams"]):
            left, right, ok, same = linked(head, held)
            tids = np.asarray(held["tid"])
            degree: dict[int, int] = {}
            root: dict[int, int] = {}

            def top(x: int, root=root) -> int:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x, y in zip(*np.nonzero(ok), strict=True):
                a, b = int(tids[left[x]]), int(tids[right[y]])
                degree[a] = degree.get(a, 0) + 1
                if not same:
                    degree[b] = degree.get(b, 0) + 1
                ra, rb = top(a), top(b)
                root[max(ra, rb)] = min(ra, rb)
            out += [(t, top(t), d) for t, d in degree.items()]
            if len(out) >= 20_000:
                yield emit()
                out = []
        yield emit()

    return tasks


def distinct_texts(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per different text of (key, doc_id, text): tid, key, keys, lowest doc_id, copies.

    A text that is null has no key and is left out. Copies are added up before the shuffle.
    """
    made = docs.select("key", "doc_id", "text").mapInArrow(_signatures(bands, rows), "key binary, doc_id long, keys array<long>")
    grouped = made.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("keys").alias("keys")
    )
    return cut(grouped.withColumn("tid", F.monotonically_increasing_id()))


def links(texts: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(tid, root, links) of every checked unit: the texts linked in it, the least linked one, and how many links.

    Band keys are shuffled first. A bucket of many texts is split into blocks, and a unit compares two
    blocks, so its size is bounded and pairs exist only inside a task. A pair is counted in the first band
    it shares, so n-gram sets travel only to units that have a pair to check; they are made from the texts
    again, for candidates alone.
    """
    keyed = texts.filter(F.size("keys") > 0).select("tid", "keys")
    entries = keyed.select("tid", F.posexplode("keys").alias("band", "key"))
    full = entries.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / block)
    members = entries.join(full, ["band", "key"]).select("band", "key", "tid", blocks.alias("b"), F.pmod(F.xxhash64("tid"), blocks).alias("side"))
    spread = members.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    units = spread.select(F.col("band").cast("long").alias("band"), "key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "tid")
    head = ["band", "key", "i", "j"]
    typed = "band long, key long, i long, j long, side long, tid long"
    light = units.join(keyed, "tid").repartition(*head).sortWithinPartitions(*head)
    needed = cut(light.mapInArrow(_needed, typed))
    wanted = needed.select("tid").distinct().join(texts.select("tid", "key"), "tid")
    # Copies collapse before the shuffle, so a text that many rows share is no hot key.
    words = docs.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key").select("tid", "text")
    sets = words.mapInArrow(_grams, "tid long, grams array<long>")
    heavy = needed.join(sets.join(keyed, "tid"), "tid").repartition(*head).sortWithinPartitions(*head)
    return heavy.mapInArrow(_verify(threshold), "tid long, root long, links long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Different texts of (key, doc_id, text) with class: key, doc_id (lowest), copies, links, class (lowest doc_id), top.

    `links` counts the other texts at the threshold or above. A class is what links connect; `top` marks its
    text with the lowest doc_id (null ids last, then by key), which stands for it. Texts without words have
    no n-grams and are linked to nothing but their copies.
    """
    bands, rows = choose_bands(threshold)
    texts = distinct_texts(docs, bands, rows)
    found = cut(links(texts, docs, threshold))
    degree = found.groupBy("tid").agg(F.sum("links").alias("links"))
    joined = components(found.filter("tid <> root").select(F.col("tid").alias("src"), F.col("root").alias("dst")))
    placed = texts.select("tid", "key", "doc_id", "copies").join(degree, "tid", "left").join(joined.withColumnRenamed("id", "tid"), "tid", "left")
    placed = cut(placed.select("key", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "tid").alias("root")))
    lead = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("lead"))
    out = placed.join(lead, "root").select("key", "doc_id", "copies", "links", F.col("lead.doc_id").alias("class"), (F.col("key") == F.col("lead.key")).alias("top"))
    return out


def near_table(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links and n_copies of every document of (doc_id, text).

    class_id is the lowest doc_id among the documents that links or equal texts connect. n_links counts the
    different other texts linked to the document's own, n_copies the documents with its text. A null text
    has no class and no links. Repeated rows are copies; empty input gives no rows.
    """
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    found = cut(classes(keyed).select("key", "class", "links", "copies"))
    joined = keyed.select("doc_id", "key").join(found, "key", "left")
    return joined.select(
        "doc_id", F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_per_class(docs: DataFrame) -> DataFrame:
    """One row of each class of `docs`, that with the lowest doc_id (null ids last); rows with null text all stay.

    Of rows with equal text the least by (doc_id, other columns) stands for it, found before the shuffle.
    """
    rest = sorted(c for c in docs.columns if c not in ("doc_id", "text"))
    whole = docs.select(F.struct("*").alias("doc"), "doc_id", "text", text_key(F.col("text")).alias("key"))
    tops = cut(classes(whole.select("key", "doc_id", "text"))).filter("top").select("key")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *[F.col("doc")[c].cast("string") for c in rest])
    kept = whole.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min_by("doc", order).alias("doc")).join(tops, "key", "left_semi")
    return kept.select("doc.*").unionByName(whole.filter(F.col("key").isNull()).select("doc.*"))
