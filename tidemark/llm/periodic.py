"""Periodic runs of words by a dictionary of basic factors.

The dictionary names every word stretch whose length is a power of two, so that equal stretches of a
document have equal names. Next occurrences of a name that are at most twice its length away form
arithmetic progressions; the step of three or more terms is a proposed period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WORD

LEAST = 6  # words of a run
POWER = 4  # periods of a run
GROUP_CHARS = 1 << 20  # texts handled together hold about so many characters; a longer text is a group of its own
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _word_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of a text's words; a long text is split in parts cut at white space, so few words exist at once."""
    parts, at = [], 0
    while at < len(text):
        end = at + GROUP_CHARS
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys that occur more than once: positions ordered by key, then place, and the key's number beside each."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    new = np.diff(keys, prepend=keys[:1] - 1) != 0
    name = np.cumsum(new) - 1
    often = np.bincount(name, minlength=1)[name] > 1 if len(name) else new
    return at[often], name[often], order[often]


def _union(low: np.ndarray, high: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals [low, high) of one step become one."""
    if not len(low):
        return low, high, step
    order = np.lexsort((low, step))
    low, high, step = low[order], high[order], step[order]
    span = int(high.max()) + 1
    rank = np.cumsum(np.diff(step, prepend=step[:1]) != 0)
    reach = np.maximum.accumulate(rank * span + high) - rank * span
    new = np.append(True, (low[1:] > reach[:-1]) | (step[1:] != step[:-1]))
    first = np.flatnonzero(new)
    return low[first], reach[np.append(first[1:], len(low)) - 1], step[first]


def proposals(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [low, high) in which x[i] == x[i + step], from progressions of basic factors of every length.

    A run of period q has, at the first power of two that is no less than q, the same successor distance q
    at all its places (a nearer one would give it a smaller period) and three terms from its first word on,
    so it is always proposed. A factor that crosses two documents never repeats.
    """
    at = np.arange(len(x))
    keys = doc * (int(x.max()) + 1 if len(x) else 1) + x
    found, length = [], 1
    while len(at):
        at, name, _ = _repeated(keys, at)
        if not len(at):
            break
        gap = np.where(np.diff(name, append=-1) == 0, np.diff(at, append=0), 0)  # to the next place of the name
        near = (gap > 0) & (gap <= 2 * length)
        twice = near & (np.append(gap[1:], 0) == gap)  # this place, the next and the one after: a progression
        low, step = np.append(at[twice], (at + gap)[twice]), np.append(gap[twice], gap[twice])
        found.append((low, low + length, step))
        # A factor of twice the length is the pair of its halves; both must repeat.
        names = np.full(len(x), -1, np.int64)
        names[at] = name
        at = np.sort(at)
        at = at[at + length < len(x)]
        at = at[names[at + length] >= 0]
        keys = names[at] * (int(name.max()) + 1) + names[at + length]
        length *= 2
    none = np.empty(0, np.int64)
    return _union(*(np.concatenate(c) for c in zip(*found, strict=True))) if found else (none, none, none)


def find_runs(x: np.ndarray, doc: np.ndarray, least: int = LEAST, power: int = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs of at least `least` words and `power` periods.

    `x` are word numbers of documents one after the other, `doc` the document number of each word.
    `power` is 4 or more: below it the proposals are not complete.
    """
    if power < 4:
        raise ValueError("runs of fewer than four periods are not all proposed")
    low, high, step = proposals(x, doc)
    fits = high - low + step >= np.maximum(least, power * step)
    low, high, step = low[fits].copy(), high[fits].copy(), step[fits]
    grow = np.arange(len(low))
    while len(grow):
        i = low[grow] - 1
        grow = grow[(i >= 0) & (x[i] == x[i + step[grow]]) & (doc[i] == doc[i + step[grow]])]
        low[grow] -= 1
    grow = np.arange(len(low))
    while len(grow):
        i, j = high[grow], high[grow] + step[grow]
        inside = j < len(x)
        grow, i, j = grow[inside], i[inside], j[inside]
        grow = grow[(x[i] == x[j]) & (doc[i] == doc[j])]
        high[grow] += 1
    length = high - low + step
    order = np.lexsort((step, length, low))  # of the periods of one stretch the smallest comes first
    low, length, step = low[order], length[order], step[order]
    new = np.append(True, (np.diff(low) != 0) | (np.diff(length) != 0))[: len(low)]
    low, length, step = low[new], length[new], step[new]
    order = np.lexsort((step, low))
    return low[order], length[order], step[order]


def _group(texts: list[str | None], least: int, power: int) -> tuple[list[int], pa.Array, list[str]]:
    vocabulary: dict[bytes, int] = {}
    parts = [_word_ids((t or "").encode(), vocabulary) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    x, doc = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
    low, length, period = find_runs(x, doc, least, power)
    gone = np.zeros(len(x) + 1, np.int64)
    np.add.at(gone, low + period, 1)
    np.add.at(gone, low + length, -1)
    keep = np.cumsum(gone)[: len(x)] == 0
    words = [w.decode() for w in vocabulary]
    texts = [" ".join(map(words.__getitem__, x[e - n : e][keep[e - n : e]].tolist())) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    own = doc[low] if len(low) else low
    runs = pa.StructArray.from_arrays([pa.array(low - (ends - sizes)[own]), pa.array(length), pa.array(period)], names=RUN.names)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(parts)))])
    return sizes.tolist(), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs), texts


def _runs(batches: Iterator[pa.RecordBatch], least: int, power: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.asarray(batch.column("size"))
        at = 0
        while at < batch.num_rows:
            held = np.cumsum(size[at:])
            end = at + max(1, int(np.searchsorted(held, GROUP_CHARS, "right")))
            part = batch.slice(at, end - at)
            n, runs, kept = _group(part.column("text").to_pylist(), least, power)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), runs, pa.array(kept)], names=["key", "n_words", "runs", "collapsed"])
            at = end


def periodic_runs(docs: DataFrame, keys: list[str], text: str | Column = "text", least: int = LEAST, power: int = POWER) -> DataFrame:
    """Runs of every text: the `keys` columns, n_words, runs (start, length, period) and the collapsed text.

    Runs are ordered by start, then period. `collapsed` leaves out every word that a run contains after its
    first period and joins the others by one space. Null and empty texts have no words, no runs and an empty
    collapsed text; repeated rows each get their own row; empty tables give none. A task holds one group of
    texts at a time, or one very long text as numbers. Rows are never shuffled.
    """
    slim = docs.select(F.struct(*keys).alias("key"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"))
    slim = slim.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    fields = [slim.schema["key"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    got = slim.mapInArrow(lambda b: _runs(b, least, power), T.StructType(fields))
    return got.select("key.*", "n_words", "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the contract's share of documents repeats its words from a place on with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    rows = rows.withColumn("w", F.when(F.col("g").isNotNull(), F.regexp_extract_all("text", F.lit(WORD), 0)))
    n, g = F.size("w"), F.col("g")
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, (g % n).cast("int")))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    turned = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.get("w", F.col("a") + i % F.col("p")))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), turned), " ")).otherwise(F.col("text")).alias("text"))


def run_table(docs: DataFrame) -> DataFrame:
    """Digests of the runs of all documents. A null doc_id has no crc32, so its words stay as they are."""
    got = periodic_runs(planted(docs), ["doc_id"])
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    got = got.withColumn("best", best)
    return got.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("(1000 * best.length) div (-best.p)").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


SQL = rf"""
WITH src AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w0,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, 3988292384::BIGINT * (v & 1)))),
      4294967295::BIGINT) AS h FROM documents),
sized AS (SELECT *, len(w0) AS n, h // 10 AS g FROM src),
cutat AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM sized),
per AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cutat),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w0
    ELSE list_concat(w0[1 : a], list_transform(range(n - a), lambda j: w0[a + 1 + j % p])) END AS w FROM per),
words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM d),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM same),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM islands GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, s, l, min(q) AS q FROM stretch GROUP BY r, s, l),
agg AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY l DESC, s, q) = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS body FROM words w ANTI JOIN gone g ON w.r = g.r AND w.i = g.i GROUP BY w.r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(s AS BIGINT) AS start, CAST(l AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
  CAST((1000 * l) // q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM d LEFT JOIN agg ON d.r = agg.r LEFT JOIN best ON d.r = best.r LEFT JOIN kept ON d.r = kept.r
"""
