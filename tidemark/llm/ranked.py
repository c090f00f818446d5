"""Ranked lexical search with range-maximum tables over posting lists.

Every block of documents has its own postings (term, ascending document numbers, occurrences). For a term of
a query each posting has an impact, its part of the document's score; a sparse table answers which posting
of a list has the largest impact in a range of documents. The sum of these maxima over a query's terms
bounds the score of every document in an interval. Intervals are taken best bound first, split at the
document of their largest single impact, which is scored, and dropped once their bound is out of reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import running, text_batches, with_row
from tidemark.session import cut, fresh_path

TOP = 20
BLOCK_WORDS = 2_000_000
QUERY_TERMS = 100_000  # terms of the queries that one group holds
#: ASCII other than letters and digits separates terms; A-Z become lower case; all else is part of a term.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("term", pa.binary()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
INDEX = "kind int, block long, term binary, docs array<long>, counts array<int>"


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(values[offsets[0] : offsets[-1]], kind))


def _postings(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[pa.RecordBatch]:
    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids = pa.chunked_array([pa.array(i, pa.int64()) for i in owners]).combine_chunks()
        order = np.asarray(pa.compute.array_sort_indices(ids, null_placement="at_start"))
        sizes, number = np.array([len(h) for h in held]), np.empty(len(held), np.int64)
        number[order] = np.arange(len(held))  # documents are numbered in doc_id order, null first
        head = [pa.array([0], pa.int32()), pa.array([block]), pa.nulls(1, pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [*head, pa.ListArray.from_arrays([0, len(ids)], ids.take(pa.array(order))), pa.array([sizes[order]], pa.list_(pa.int32()))], schema=_ROW
        )
        keys, counts = np.unique(np.concatenate(held) * len(held) + np.repeat(number, sizes), return_counts=True)
        term, doc = keys // len(held), keys % len(held)
        starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(keys))
        terms = list(vocabulary)
        for a in range(0, len(terms), 50_000):
            z = min(a + 50_000, len(terms))
            same = [pa.array(np.full(z - a, 1), pa.int32()), pa.array(np.full(z - a, block)), pa.array(terms[a:z], pa.binary())]
            yield pa.RecordBatch.from_arrays([*same, _lists(doc, starts[a : z + 1], pa.int64()), _lists(counts, starts[a : z + 1], pa.int32())], schema=_ROW)

    block, words = TaskContext.get().partitionId() << 33, 0
    vocabulary: dict[bytes, int] = {}
    held: list[np.ndarray] = []
    owners: list[list] = []
    for batch in text_batches(batches):
        own = []
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            got = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
            if got:
                for w in set(got).difference(vocabulary):
                    vocabulary[w] = len(vocabulary)
                held.append(np.fromiter(map(vocabulary.__getitem__, got), np.int64, len(got)))
                own.append(doc_id)
                words += len(got)
        owners.append(own)
        if words >= block_words:
            yield from flush()
            block, words, vocabulary, held, owners = block + 1, 0, {}, [], []
    yield from flush()


def build_index(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Write the index of `docs` (doc_id, text) to the shared folder and return it.

    Kind 0: one row per block with the doc_ids and numbers of terms of its documents. Kind 1: a row per
    (block, term). A block is at most `block_words` words of one task and a batch of texts more. Null texts
    and texts without terms are not in the index; repeated rows are documents of their own.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    path = fresh_path(docs.sparkSession, "ranked")
    slim.mapInArrow(lambda b: _postings(b, block_words), INDEX).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Postings:
    """The posting lists of one block, one after the other, with impacts and a sparse table for range maxima."""

    def __init__(self, terms: list[bytes], docs: list[np.ndarray], counts: list[np.ndarray], weights: list[int], length_part: np.ndarray):
        self.number = {t: i for i, t in enumerate(terms)}
        self.size = len(length_part)
        self.ends = np.cumsum([len(d) for d in docs])
        self.starts = self.ends - [len(d) for d in docs]
        own = np.repeat(np.arange(len(terms)), self.ends - self.starts)
        self.doc = np.concatenate(docs)
        self.key = own * self.size + self.doc
        tf = np.concatenate(counts).astype(np.int64)
        self.impact = np.asarray(weights, np.int64)[own] * ((1_000_000_000 * tf) // (1000 * tf + 12 * length_part[self.doc]))
        longest, n = int((self.ends - self.starts).max()), len(self.doc)
        self.best = np.empty((longest.bit_length(), n), np.int32)  # of 2^level postings from here on, the place of the largest impact
        self.best[0] = np.arange(n)
        for level in range(1, len(self.best)):
            half = 1 << (level - 1)
            self.best[level] = self.best[level - 1]
            left, right = self.best[level - 1, : n - half], self.best[level - 1, half:]
            self.best[level, : n - half] = np.where(self.impact[left] >= self.impact[right], left, right)

    def maximum(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of the largest impact among postings a to b - 1, the first of equal ones."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        left, right = self.best[level, a], self.best[level, b - (1 << level)]
        return np.where(self.impact[left] >= self.impact[right], left, right)

    def top(self, terms: list[bytes], times: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k documents of the highest scores above 0, equal scores by document number."""
        known = [(self.number[t], c) for t, c in zip(terms, times, strict=True) if t in self.number]
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        if not known:
            return docs, scores
        term, mult = (np.array(c, np.int64) for c in zip(*known, strict=True))
        front = self._nodes(np.zeros(len(term), np.int64), term, mult, self.starts[term], self.ends[term], np.zeros(1, np.int64))
        take = 8
        while True:
            # The last place can be taken by a higher score, or by an equal one of a smaller number.
            bound, low = front["bound"], front["low"]
            reach = (bound > scores[-1]) | ((bound == scores[-1]) & (low < docs[-1])) if len(docs) == k else bound > 0
            front = self._only(front, np.flatnonzero(reach))
            n = len(front["bound"])
            if not n:
                return docs, scores
            chosen = np.arange(n)
            if n > take:
                chosen = np.argpartition(front["bound"], n - take)[n - take :]
            rest = np.ones(n, bool)
            rest[chosen] = False
            now, front = self._only(front, chosen), self._only(front, np.flatnonzero(rest))
            take = min(2 * take, 2048)
            first = np.flatnonzero(np.diff(now["node"], prepend=-1))
            # The document of each interval's largest single impact.
            largest = np.maximum.reduceat(now["value"], first)
            at = np.flatnonzero(now["value"] == largest[now["node"]])
            at = at[np.flatnonzero(np.diff(now["node"][at], prepend=-1))]
            split = self.doc[now["place"][at]]
            here = split[now["node"]]
            c = np.searchsorted(self.key, now["term"] * self.size + here)
            has = (c < now["b"]) & (self.doc[np.minimum(c, len(self.doc) - 1)] == here)
            score = np.add.reduceat(np.where(has, now["mult"] * self.impact[np.minimum(c, len(self.doc) - 1)], 0), first)
            docs, scores = np.append(docs, split[score > 0]), np.append(scores, score[score > 0])
            order = np.lexsort((docs, -scores))[:k]
            docs, scores = docs[order], scores[order]
            m = len(split)
            # Left parts are intervals 0 to m - 1, right parts m to 2m - 1; postings of the split document leave.
            node = np.append(now["node"], now["node"] + m)
            a, b = np.append(now["a"], c + has), np.append(c, now["b"])
            some = np.flatnonzero(b > a)
            both = [np.append(now[x], now[x])[some] for x in ("term", "mult")]
            parts = self._nodes(node[some], *both, a[some], b[some], np.append(now["low"], split + 1))
            front = self._joined(front, parts)

    def _nodes(self, node, term, mult, a, b, low) -> dict:
        """Intervals from (node, term) pairs sorted by node; intervals without postings vanish."""
        place = self.maximum(a, b)
        value = mult * self.impact[place]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        bound = np.add.reduceat(value, first) if len(first) else np.empty(0, np.int64)
        dense = np.cumsum(np.diff(node, prepend=node[:1]) != 0) if len(node) else node
        return {"bound": bound, "low": low[node[first]], "node": dense, "term": term, "mult": mult, "a": a, "b": b, "place": place, "value": value}

    @staticmethod
    def _only(front: dict, chosen: np.ndarray) -> dict:
        """Some of the intervals, numbered anew in ascending order."""
        n = len(front["bound"])
        keep = np.zeros(n, bool)
        keep[chosen] = True
        number = np.cumsum(keep) - 1
        pairs = np.flatnonzero(keep[front["node"]])
        out = {x: front[x][pairs] for x in ("term", "mult", "a", "b", "place", "value")}
        return {"bound": front["bound"][keep], "low": front["low"][keep], "node": number[front["node"][pairs]], **out}

    @staticmethod
    def _joined(one: dict, two: dict) -> dict:
        return {x: np.append(one[x], two[x] + len(one["bound"]) if x == "node" else two[x]) for x in one}


def _searcher(n: int, total: int, k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query": [], "doc_id": [], "score": []}
        kinds = left["kind"].to_numpy()
        if len(right) and (kinds == 1).any():
            held = left.filter(pa.array(kinds == 0))
            ids, sizes = held["docs"][0].values, np.asarray(held["counts"][0].values, np.int64)
            lists = left.filter(pa.array(kinds == 1))
            docs = [np.asarray(x.values) for x in lists["docs"]]
            counts = [np.asarray(x.values) for x in lists["counts"]]
            index = Postings(lists["term"].to_pylist(), docs, counts, lists["w"].to_pylist(), 75 + (25 * sizes * n) // total)
            for query, terms in zip(right["query"].to_pylist(), right["terms"].to_pylist(), strict=True):
                at, score = index.top([t["term"] for t in terms], [t["times"] for t in terms], k)
                out["query"] += [query] * len(at)
                out["doc_id"] += ids.take(pa.array(at)).to_pylist()
                out["score"] += score.tolist()
        return pa.table({x: pa.array(v, pa.int64()) for x, v in out.items()})

    return search


def folded_terms(text: Column) -> Column:
    """The terms of a text in order, as an array; null has none."""
    upper = "".join(map(chr, range(65, 91)))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(_TERM), 0)


def weight(n: int, df: Column) -> Column:
    return F.floor(1000 * F.log((2.0 * n + 2) / (2 * df + 1))).cast("long")


def search(index: DataFrame, queries: DataFrame, k: int = TOP, query_terms: int = QUERY_TERMS) -> DataFrame:
    """The k best documents of each query: query, rank (from 1), doc_id, score; equal scores by ascending doc_id.

    `queries` has query (long, one row each) and text. Queries are searched in chunks of at most
    `query_terms` distinct terms (or one query) against every block, so a group is one block and one chunk;
    each returns its k best. Queries without known terms, and an empty index, give no rows.
    """
    spark = index.sparkSession
    blocks, lists = index.filter("kind = 0"), index.filter("kind = 1")
    n, total = blocks.agg(F.sum(F.size("docs")), F.sum(F.expr("aggregate(counts, 0L, (a, x) -> a + x)"))).first()
    if not n:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    words = queries.select("query", F.explode(folded_terms(F.col("text"))).alias("term"))
    words = words.withColumn("term", F.col("term").cast("binary"))
    words = cut(words.groupBy("query", "term").agg(F.count("*").alias("times")))
    held = words.groupBy("query").agg(F.collect_list(F.struct("term", "times")).alias("terms"), F.count("*").alias("size"))
    held = running(held, ["query"], value="size").select("query", "terms", F.expr(f"_before div {query_terms}").alias("chunk"))
    held = cut(held)
    last = held.agg(F.max("chunk")).first()[0]
    if last is None:
        return spark.createDataFrame([], "query long, rank int, doc_id long, score long")
    asked = held.select("chunk", F.explode("terms.term").alias("term")).distinct()
    known = lists.join(asked.select("term").distinct(), "term", "left_semi")
    weights = known.groupBy("term").agg(F.sum(F.size("docs")).alias("df")).select("term", weight(n, F.col("df")).alias("w"))
    asked = cut(asked.join(weights, "term"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("chunk")
    left = lists.join(asked, "term").select("block", "chunk", "kind", "term", "docs", "counts", "w")
    left = left.unionByName(blocks.select("block", chunk, "kind", "term", "docs", "counts", F.lit(None).cast("long").alias("w")))
    right = blocks.select(F.col("block").alias("of"), chunk).join(held, "chunk").select("of", F.col("chunk").alias("part"), "query", "terms")
    got = left.groupBy("block", "chunk").cogroup(right.groupBy("of", "part")).applyInArrow(_searcher(n, total, k), "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query", "rank", "doc_id", "score")


def search_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each benchmark row's best documents; null and empty items and documents match nothing, repeated items are searched twice."""
    items = with_row(benchmark.select("item_id", "text"), "query")
    found = search(build_index(docs), items)
    return found.join(items.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS (SELECT r, doc_id, n_words, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n_words, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM tf, size GROUP BY term, n),
part AS (SELECT r, doc_id, term, CAST(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n_words * n) // l))) AS BIGINT) AS impact
  FROM tf JOIN df USING (term), size),
ask AS (SELECT q, item_id, term, count(*) AS times FROM (SELECT q, item_id, unnest(w) AS term FROM b) GROUP BY ALL),
hit AS (SELECT q, item_id, r, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM ask JOIN part USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM hit
WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 20
"""
