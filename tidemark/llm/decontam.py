"""Benchmark decontamination on a positional inverted index that is split by documents.

Every block of documents has its own postings: a row per (block, term) with the term's positions in the
block. A phrase is found by shifting each of its terms' position lists by the term's place in the phrase
and intersecting them, starting from the rarest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import running, text_batches, text_key
from tidemark.session import cut, fresh_path

WINDOW = 13
SHARE = 20  # a document is contaminated if SHARE * hit words >= words
BLOCK_WORDS = 4_000_000
ITEM_BYTES = 2 << 20  # benchmark text that one group of the search holds
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of folded text

#: ASCII other than letters and digits separates words; A-Z become lower case; all else is part of a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _postings(batches: Iterator[pa.RecordBatch], keys: pa.Schema, block_words: int) -> Iterator[pa.RecordBatch]:
    """A block's documents (kind 0: key columns, n_words, base) and terms (kind 1: term, position steps)."""
    part = TaskContext.get().partitionId()
    fields = [("kind", pa.int32()), ("block", pa.int64()), *((f.name, f.type) for f in keys), ("n_words", pa.int64())]
    schema = pa.schema([*fields, ("base", pa.int64()), ("term", pa.binary()), ("steps", pa.list_(pa.int32()))])

    def emit(rows: int, **columns) -> pa.RecordBatch:
        given = {"kind": pa.array(np.full(rows, columns.pop("kind")), pa.int32()), "block": pa.array(np.full(rows, block), pa.int64())}
        return pa.RecordBatch.from_arrays(
            [given.get(f.name, columns.get(f.name)) if f.name in given or f.name in columns else pa.nulls(rows, f.type) for f in schema],
            schema=schema,
        )

    def flush() -> Iterator[pa.RecordBatch]:
        for own, sizes, bases in held:
            yield emit(len(sizes), kind=0, n_words=pa.array(sizes, pa.int64()), base=pa.array(bases, pa.int64()), **own)
        if seen:
            ids, at = np.concatenate(seen), np.concatenate(places)
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order]
            first = np.flatnonzero(np.diff(ids, prepend=-1))
            steps = np.diff(at, prepend=0)
            steps[first] = at[first]
            terms = list(vocabulary)
            offsets = np.append(first, len(ids))
            for a in range(0, len(terms), 50_000):
                z = min(a + 50_000, len(terms))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets[a : z + 1] - offsets[a], pa.int32()), pa.array(steps[offsets[a] : offsets[z]], pa.int32())
                )
                yield emit(z - a, kind=1, term=pa.array(terms[a:z], pa.binary()), steps=lists)

    block, top = part << 33, 0
    vocabulary: dict[bytes, int] = {}
    held: list = []
    seen: list = []
    places: list = []
    for batch in text_batches(batches):
        sizes, bases = [], []
        for text in batch.column("_text").to_pylist():
            got = words(text)
            bases.append(top)
            sizes.append(len(got))
            if got:
                for w in set(got).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                seen.append(np.fromiter(map(vocabulary.__getitem__, got), np.int32, len(got)))
                places.append(np.arange(top, top + len(got), dtype=np.int64))
            top += len(got) + 1  # a gap, so that no phrase runs from one document into the next
        held.append(({f.name: batch.column(f.name) for f in keys}, sizes, bases))
        if top >= block_words:
            yield from flush()
            block, top = block + 1, 0
            vocabulary, held, seen, places = {}, [], [], []
    yield from flush()


def build_index(docs: DataFrame, keys: list[str], text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Write the index of `docs` to the shared folder and return it.

    `keys` are columns kept per document. A block is one task's documents, at most `block_words` words and
    one batch of texts more. Null and empty texts are documents without postings.
    """
    slim = docs.select(*[F.col(k) for k in keys], F.col(text).alias("_text"))
    typed = slim.select(*keys).limit(0).toArrow().schema if keys else pa.schema([])
    spark_types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.select(*keys).schema)
    schema = f"kind int, block long, {spark_types}n_words long, base long, term binary, steps array<int>"
    path = fresh_path(docs.sparkSession, "postings")
    slim.mapInArrow(lambda b: _postings(b, typed, block_words), schema).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def index_documents(index: DataFrame) -> DataFrame:
    return index.filter("kind = 0").drop("kind", "term", "steps")


def index_terms(index: DataFrame) -> DataFrame:
    return index.filter("kind = 1").select("block", "term", "steps")


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive sorted numbers."""
    if not len(starts):
        return starts, starts
    breaks = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.append(0, breaks + 1)], starts[np.append(breaks, len(starts) - 1)]


def phrase_starts(lists: dict[bytes, np.ndarray], phrase: list[bytes], frequency: dict[bytes, int]) -> np.ndarray:
    """Positions at which `phrase` starts: offset-adjusted lists, intersected from the rarest term."""
    order = sorted(range(len(phrase)), key=lambda j: frequency.get(phrase[j], 0))
    starts = None
    for j in order:
        at = lists.get(phrase[j])
        if at is None:
            return np.empty(0, np.int64)
        if starts is None:
            starts = at - j
        else:
            want = starts + j
            slot = np.searchsorted(at, want)
            slot[slot == len(at)] = len(at) - 1
            starts = starts[at[slot] == want]
        if not len(starts):
            break
    return starts


def near_starts(lists: dict[bytes, np.ndarray], terms: list[bytes], slop: int, frequency: dict[bytes, int], bases: np.ndarray) -> np.ndarray:
    """Positions of the rarest term that have every other term at most `slop` words away in the same document.

    `bases` are the positions at which the block's documents start.
    """
    order = sorted(set(terms), key=lambda t: (frequency.get(t, 0), t))
    if not order or any(t not in lists for t in order):
        return np.empty(0, np.int64)
    at = lists[order[0]]
    for t in order[1:]:
        other, doc = lists[t], np.searchsorted(bases, at, "right")
        ends = np.append(bases[1:], np.iinfo(np.int64).max)
        low, high = np.maximum(at - slop, bases[doc - 1]), np.minimum(at + slop, ends[doc - 1] - 1)
        at = at[np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")]
    return at


def windows_of(item: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    return [tuple(item[i : i + window]) for i in range(max(1, len(item) - window + 1))]


def _lists(postings: pa.Table) -> tuple[dict[bytes | None, np.ndarray], dict[bytes, int]]:
    """Positions of each term in the block (of the starts of documents under None), and its frequency in the whole index."""
    terms = postings["term"].to_pylist()
    steps = [np.cumsum(np.asarray(x.values, np.int64)) for x in postings["steps"]]
    return dict(zip(terms, steps, strict=True)), dict(zip(terms, postings["n"].to_pylist(), strict=True))


def _found(block: int | None, rows: list[tuple]) -> pa.Table:
    cells = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = [pa.string(), pa.int64(), pa.int64()]
    return pa.table([pa.array([block] * len(rows), pa.int64()), *[pa.array(c, k) for c, k in zip(cells, kinds, strict=True)]], names=["block", "item", "first", "last"])


def _phrases(window: int):
    def search(postings: pa.Table, items: pa.Table) -> pa.Table:
        """All occurrences of all item windows in one block, as runs of word positions per item."""
        if not len(postings) or not len(items):
            return _found(None, [])
        lists, frequency = _lists(postings)
        found: dict[tuple, np.ndarray] = {}
        rows = []
        for item, got in zip(items["item"].to_pylist(), items["words"].to_pylist(), strict=True):
            hits = []
            for phrase in windows_of(got, window):
                if phrase not in found:
                    found[phrase] = phrase_starts(lists, list(phrase), frequency)
                if len(found[phrase]):
                    hits.append((found[phrase], len(phrase)))
            if hits:
                size = hits[0][1]
                first, last = _runs(np.unique(np.concatenate([h for h, _ in hits])))
                rows += [(item, a, z + size - 1) for a, z in zip(first.tolist(), last.tolist(), strict=True)]
        return _found(postings["block"][0].as_py(), rows)

    return search


def _proximity(slop: int):
    def search(postings: pa.Table, items: pa.Table) -> pa.Table:
        """Places of the rarest term of each item that have all its other terms near."""
        if not len(postings) or not len(items):
            return _found(None, [])
        lists, frequency = _lists(postings)
        names, wanted = items["item"].to_pylist(), items["words"].to_pylist()
        rows = [(item, p, p) for item, terms in zip(names, wanted, strict=True) for p in near_starts(lists, terms, slop, frequency, lists[None]).tolist()]
        return _found(postings["block"][0].as_py(), rows)

    return search


def _everywhere(index: DataFrame, items: DataFrame, search, chunk_bytes: int) -> DataFrame:
    """`search` on every (block, chunk of items): the block's postings of the chunk's terms beside the chunk's items.

    `items` has item and text. A chunk is at most `chunk_bytes` of item text, or one item, so a group is bounded by
    a block and a chunk. Frequencies that order the terms are those of the whole index. Items stay a table.
    """
    typed = "block long, item string, first long, last long"
    spoken = items.select(F.col("item").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    spoken = spoken.withColumns({"size": F.octet_length("text").cast("long"), "h": F.xxhash64("text")}).filter(F.regexp_count("text", F.lit(_WORD)) > 0)
    placed = cut(running(spoken, ["item", "h"], value="size").select("item", "text", F.expr(f"_before div {chunk_bytes}").alias("chunk")))
    last = placed.agg(F.max("chunk")).first()[0]
    if last is None:
        return items.sparkSession.createDataFrame([], typed)
    upper = "".join(map(chr, range(65, 91)))
    worded = placed.select("chunk", "item", F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(_WORD), 0).cast("array<binary>").alias("words"))
    asked = worded.select("chunk", F.explode("words").alias("term")).distinct()
    terms = index_terms(index)
    counts = terms.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum(F.size("steps")).alias("n"))
    known = cut(asked.join(counts, "term"))
    chosen = terms.join(known, "term").select("block", "chunk", "term", "steps", "n")
    # The starts of a block's documents, as many as it has, go with its postings in the same form.
    starts = index_documents(index).groupBy("block").agg(F.sort_array(F.collect_list("base")).alias("b"))
    starts = starts.withColumn("steps", F.transform("b", lambda x, i: (x - F.when(i > 0, F.get("b", i - 1)).otherwise(0)).cast("int")))
    starts = starts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    chosen = chosen.unionByName(starts.select("block", "chunk", F.lit(None).cast("binary").alias("term"), "steps", F.lit(0).cast("long").alias("n")))
    blocks = index_documents(index).select(F.col("block").alias("of")).distinct()
    chunks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    given = chunks.join(worded, F.col("part") == F.col("chunk")).select("of", "part", "item", "words")
    return chosen.groupBy("block", "chunk").cogroup(given.groupBy("of", "part")).applyInArrow(search, typed)


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Occurrences of item windows: (block, item, first, last), word positions in the block, both included."""
    return _everywhere(index, items.select(F.col("item_id").alias("item"), "text"), _phrases(window), item_bytes)


def near_matches(index: DataFrame, queries: DataFrame | Iterable[tuple[str, list[str]]], slop: int, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(block, item, first, last) where all terms of a query lie within `slop` words of its rarest term, at `first`.

    `queries` is a table of (item, text), or a short list of (name, words).
    """
    if not isinstance(queries, DataFrame):
        queries = index.sparkSession.createDataFrame([(name, " ".join(terms)) for name, terms in queries], "item string, text string")
    return _everywhere(index, queries, _proximity(slop), item_bytes)


def _covered(spans: np.ndarray) -> int:
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    start = np.maximum(spans[1:, 0], top[:-1] + 1)
    return int(spans[0, 1] - spans[0, 0] + 1 + np.maximum(spans[1:, 1] - start + 1, 0).sum())


def in_documents(found: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Word counts of hits per document: keys, n_words, n_hit, items (distinct, sorted as strings)."""
    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*keys).schema)

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = left.sort_by("base")
        hit, items = np.zeros(len(docs), np.int64), [[] for _ in range(len(docs))]
        if len(right) and len(docs):
            first, last = right["first"].to_numpy(), right["last"].to_numpy()
            at = np.searchsorted(docs["base"].to_numpy(), first, "right") - 1  # the last document that starts at or before the hit
            order = np.argsort(at, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                hit[at[rows[0]]] = _covered(np.stack([first[rows], last[rows]], axis=1))
                items[at[rows[0]]] = sorted(set(right["item"].take(pa.array(rows)).to_pylist()))
        columns = [docs[k] for k in keys] + [docs["n_words"], pa.array(hit), pa.array(items, pa.list_(pa.string()))]
        return pa.table(columns, names=[*keys, "n_words", "n_hit", "items"])

    # A block is bounded, so its documents and hits are one group.
    both = documents.groupBy("block").cogroup(found.groupBy("block"))
    return both.applyInArrow(assign, f"{types}n_words long, n_hit long, items array<string>")


def contaminated(hit: str = "n_hit", n: str = "n_words"):
    return (F.col(hit) > 0) & (SHARE * F.col(hit) >= F.col(n))


def contamination(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_words, n_hit and items of every document of (keys, text) against `benchmark` (item_id, text).

    Null or empty texts have no words and no hits; an item without words has no window; repeated documents
    and items are rows of their own, an item id counts once. Empty tables give no rows, or no hits.
    """
    index = build_index(docs, keys)
    return in_documents(cut(matches(index, benchmark)), index_documents(index), keys)


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = contamination(docs, benchmark, ["doc_id"])
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def proximity_table(docs: DataFrame, benchmark: DataFrame, slop: int = WINDOW) -> DataFrame:
    """doc_id, n_near and n_items of the documents that hold all terms of an item within `slop` words of its rarest one.

    `n_near` counts the places of the rarest term, `n_items` the items. Null and empty texts are near nothing;
    repeated documents are rows of their own.
    """
    index = build_index(docs.select("doc_id", "text"), ["doc_id"])
    found = cut(near_matches(index, benchmark.select(F.col("item_id").alias("item"), "text"), slop))
    return in_documents(found, index_documents(index), ["doc_id"]).filter("n_hit > 0").select(
        "doc_id", F.col("n_hit").alias("n_near"), F.size("items").cast("long").alias("n_items")
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated ones; all columns and repeated rows stay as they are.

    What is contaminated depends on the text alone, so texts are matched by their key.
    """
    keyed = docs.select(F.struct("*").alias("doc"), text_key(F.col("text")).alias("key"), "text")
    bad = contamination(keyed, benchmark, ["key"]).filter(contaminated()).select("key").distinct()
    return keyed.select("doc", "key").join(bad, "key", "left_anti").select("doc.*")
