"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text and normalised by length."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_batches

REJECT = 0.7
SAMPLE_ROWS = 8_000  # labelled documents to learn from, those first by md5 of their id
ENTRIES = 400  # lexicon entries
EXCEPTIONS = 400
LONGEST = 40  # characters of a word that may be an entry
LEAST_WEIGHT = 2.0  # log ratio of document shares
LEAST_EVIDENCE = 24.0  # likelihood-ratio statistic of an entry; chance reaches it about once in a million terms
STEMS = range(4, 8)  # lengths of word beginnings that may be entries besides whole words

#: Characters that look like a Latin letter, and signs written for one.
LOOKALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "ӏ": "l", "α": "a", "ο": "o", "ρ": "p", "ι": "i",
    "ν": "v", "υ": "u", "κ": "k", "τ": "t", "ε": "e", "χ": "x", "γ": "y", "η": "n", "σ": "o", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g",
    "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
DIGIT = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_FOLD = {ord(k): ord(v) for k, v in {**LOOKALIKE, **DIGIT}.items()}
_FOLD |= {0xFF41 + i: 97 + i for i in range(26)}  # full width
_TABLE = np.arange(0x110000, dtype=np.uint32)
for _k, _v in _FOLD.items():
    _TABLE[_k] = _v
_ASCII = bytes(_TABLE[i] for i in range(128)) + bytes(range(128, 256))
_WORDS = re.compile(r"[^\W_]+(?:[@$!]+[^\W_]+)*")  # runs of letters and digits, with @, $ and ! inside them
_HIDDEN = re.compile("[​‌‍⁠﻿­]")
_INVISIBLE = str.maketrans(dict.fromkeys("​‌‍⁠﻿­"))


def fold(text: str) -> tuple[str, str]:
    """A text without invisible characters, and the same with look-alikes, digits and case folded, of equal length."""
    if text.isascii():
        return text, text.lower().encode().translate(_ASCII).decode()
    plain = text.translate(_INVISIBLE) if _HIDDEN.search(text) else text
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    return plain, _TABLE[codes].tobytes().decode("utf-32-le", "surrogatepass")


@dataclass
class Lexicon:
    """Weights of entries. `word` holds whole words and phrases, `stem` beginnings of words; exceptions are phrases or words that hold no entry."""

    word: dict[str, float] = field(default_factory=dict)
    stem: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    coefficients: tuple[float, ...] = (-4.0, 1.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        """All patterns in one automaton: value (length, whole-word weight or None, stem weight or None, exception)."""
        machine = ahocorasick.Automaton()
        for p in {*self.word, *self.stem, *self.exceptions}:
            machine.add_word(p, (len(p), self.word.get(p), self.stem.get(p), p in self.exceptions))
        if len(machine):
            machine.make_automaton()
        return machine


def find(text: str, machine: ahocorasick.Automaton) -> list[tuple[int, float]]:
    """Start and weight of the hits in a text, at most one per word: its heaviest entry that lies in no exception.

    Boundaries are those of the text before folding, so signs around a word are no part of it.
    """
    if not len(machine):
        return []
    plain, folded = fold(text)
    hits: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    n = len(plain)
    for last, (size, whole, stem, exception) in machine.iter(folded):
        start, end = last - size + 1, last + 1
        if start and plain[start - 1].isalnum():
            continue
        closed = end == n or not plain[end].isalnum()
        if exception and closed:
            free.append((start, end))
            continue
        weight = whole if closed and whole is not None else stem
        if weight is not None and (start not in hits or weight > hits[start][1]):
            hits[start] = (end, weight)
    return [(s, w) for s, (e, w) in hits.items() if not any(a <= s and e <= b for a, b in free)]


def features(text: str, machine: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Hit weight per square root of the words, hit weight per word (as a log), and the number of hits (as a log)."""
    found = find(text, machine)
    if not found:
        return 0.0, 0.0, 0.0
    words = 1 + text.count(" ") + text.count("\n")
    total = sum(w for _, w in found)
    return total / math.sqrt(words), math.log1p(100 * total / words), math.log1p(len(found))


def score(text: str, machine: ahocorasick.Automaton, coefficients: tuple[float, ...]) -> float:
    z = coefficients[0] + sum(c * x for c, x in zip(coefficients[1:], features(text, machine), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _terms(text: str) -> tuple[set[str], set[str]]:
    """Folded words of a text and their beginnings."""
    plain, folded = fold(text)
    whole = {folded[m.start() : m.end()] for m in _WORDS.finditer(plain)}
    whole = {w for w in whole if len(w) <= LONGEST}
    return whole, {w[:k] for w in whole for k in STEMS if k < len(w)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents per word and word beginning, added up per batch."""
    for batch in text_batches(batches, 2000):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            whole, stems = _terms(text or "")
            seen[1 if label else 0].update({("w", w) for w in whole} | {("s", s) for s in stems})
        names = list({*seen[0], *seen[1]})
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in names], pa.string()), pa.array([t for _, t in names], pa.string()),
                pa.array([seen[1][x] for x in names], pa.int64()), pa.array([seen[0][x] for x in names], pa.int64()),
            ],
            names=["kind", "term", "bad", "good"],
        )


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of the training rows: labelled documents whose crc32(doc_id) mod 3 is not 1, `rows` at most.

    The bound is the documented size of the sample; it is drawn by md5 of the id, so it is the same on every run.
    """
    own = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    known = labels.filter(F.col("toxic").isNotNull() & own).select("doc_id", F.col("toxic").cast("int").alias("label"))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")  # `rows` ids at most


def _evidence(share: float) -> Column:
    """Likelihood-ratio statistic of a term's toxic and clean documents against the toxic share of all."""
    parts = [(F.col("bad"), share), (F.col("good"), 1 - share)]
    both = F.col("bad") + F.col("good")
    return 2 * sum((F.when(n > 0, n * F.log(n / (both * p))).otherwise(0.0) for n, p in parts), F.lit(0.0))


def learn(sample: DataFrame, phrases: tuple[str, ...] = ()) -> Lexicon:
    """Lexicon and coefficients from (text, label).

    Words and word beginnings are weighted by the log ratio of the toxic and clean documents that hold them;
    an entry needs a likelihood-ratio statistic that chance does not reach among so many terms.
    An entry whose beginning already has most of its weight is left out. Words that begin like an entry but
    are as frequent in clean documents become exceptions; `phrases` are exceptions that the caller adds.
    With no toxic or no clean row the lexicon is empty and every score is low.
    """
    totals = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n_bad, n_good = totals[0] or 0, totals[1] or 0
    lexicon = Lexicon(exceptions={fold(p)[1] for p in phrases})
    if not n_bad or not n_good:
        return lexicon
    counts = sample.mapInArrow(_count, "kind string, term string, bad long, good long").groupBy("kind", "term").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")
    )
    weight = F.log((F.col("bad") + 0.5) / (n_bad + 1.0)) - F.log((F.col("good") + 0.5) / (n_good + 1.0))
    counts = counts.withColumn("weight", weight).withColumn("evidence", _evidence(n_bad / (n_bad + n_good))).persist()
    value = F.col("weight") * F.sqrt("bad")
    top = counts.filter((F.col("evidence") >= LEAST_EVIDENCE) & (F.col("weight") >= LEAST_WEIGHT)).orderBy(value.desc(), F.length("term"), "kind", "term")
    for r in top.limit(4 * ENTRIES).collect():
        held = [lexicon.stem[r["term"][:k]] for k in STEMS if r["term"][:k] in lexicon.stem]
        if len(lexicon.word) + len(lexicon.stem) < ENTRIES and not (held and max(held) >= r["weight"] - 1.0):
            (lexicon.stem if r["kind"] == "s" else lexicon.word)[r["term"]] = r["weight"]
    if lexicon.stem:
        begins = F.lit(False)
        for k in STEMS:
            own = [s for s in lexicon.stem if len(s) == k]
            begins = begins | (F.substring("term", 1, k).isin(own) if own else F.lit(False))
        benign = counts.filter((F.col("kind") == "w") & (F.col("good") >= 3) & (F.col("weight") <= 0) & begins)
        lexicon.exceptions |= {r["term"] for r in benign.orderBy(F.desc("good"), "term").limit(EXCEPTIONS).collect()} - set(lexicon.word)
    counts.unpersist()
    return _fit(sample, lexicon)


def _fit(sample: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Coefficients by Newton steps over the features of the sample, three numbers a row.

    The intercept is then moved so that the score REJECT is the limit with the best F1 on the sample.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in text_batches(batches):
            rows = [features(t or "", machine) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.float64()) for i in range(3)] + [batch.column("label").cast(pa.float64())],
                names=["a", "b", "c", "y"],
            )

    made = sample.mapInArrow(tasks, "a double, b double, c double, y double").toPandas().to_numpy()  # four numbers per sampled row
    made = made[np.lexsort(made.T)]  # the same sums on every run
    x, y = np.column_stack([np.ones(len(made)), made[:, :3]]), made[:, 3]
    scale = np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1.0
    x, b = x / scale, np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        ridge = np.diag([0.0, 1e-1, 1e-1, 1e-1])
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(4), x.T @ (y - p) - ridge @ b)
    b[0] += math.log(REJECT / (1 - REJECT)) - _best_limit(x @ b, y)
    lexicon.coefficients = tuple((b / scale).tolist())
    return lexicon


def _best_limit(z: np.ndarray, y: np.ndarray) -> float:
    """The limit halfway between two different values of z that has the best F1 for labels y; the lowest of equals."""
    values, at = np.unique(z, return_inverse=True)
    if len(values) < 2:
        return float(values[0]) + 1.0
    bad, every = (np.bincount(at, w, len(values))[::-1].cumsum()[::-1] for w in (y, np.ones(len(y))))
    f1 = 2 * bad[1:] / (every[1:] + y.sum())
    best = int(np.argmax(f1))
    return float(values[best] + values[best + 1]) / 2


def scored(docs: DataFrame, lexicon: Lexicon, name: str = "score") -> DataFrame:
    """`docs` with a score from 0 to 1 of their whole text, which is the only input; null text scores as empty."""
    plain = docs.select(F.struct("*").alias("doc"), "text")
    types = plain.schema["doc"].dataType.simpleString()

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in text_batches(batches):
            values = [score(t or "", machine, lexicon.coefficients) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(values, pa.float64())], names=["doc", "_score"])

    out = plain.mapInArrow(tasks, f"doc {types}, _score double")
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != name], F.col("_score").alias(name))


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null doc_id is not held out."""
    got = scored(docs.select("doc_id", "text"), learn(labelled(docs, labels)))
    return got.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with a score below the limit; all columns and repeated rows stay."""
    lexicon = learn(labelled(docs, labels))
    plain = docs.select(F.struct("*").alias("doc"), "text")
    return scored(plain, lexicon, "score").filter(F.col("score") < REJECT).select("doc.*")
