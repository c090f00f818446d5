"""Quality by weak supervision: rules vote or abstain, EM finds their accuracies, a posterior decides.

DataFrame functions only. Counting is done inside each row; the model sees one row per vote pattern.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, word_count
from tidemark.session import cut

SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\v\f\r"
SPAN = 8  # words of a repeated window
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent
KEEP = 0.5
ROUNDS = 50
START_GOOD = 0.8  # share of good documents before the first round
START = {-1: (0.001, 0.3), 0: (0.449, 0.32), 1: (0.55, 0.38)}  # shares of each vote among good and bad documents before it
BELIEF = 0.5
FALSE_ALARM = 0.003  # most good documents that a rule may call bad


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once; inside a lambda a plain expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, span: int = SPAN) -> Column:
    """Words of an array in windows of `span` words that occur more than once in it.

    Windows are compared by a 64-bit hash inside one text: with n words the chance that two different
    windows meet is below n * n / 2**65. Sorted hashes show whether any repeats; only then are (hash,
    start) pairs sorted, which brings equal windows side by side.
    """
    def covered(hits: Column) -> Column:
        after = F.concat(F.slice(hits, 2, F.size(hits)), F.array(F.lit(2**31 - 1)))
        return F.aggregate(F.zip_with(hits, after, lambda a, b: F.least(b - a, F.lit(span))), F.lit(0), lambda s, v: s + v)

    def flagged(pairs: Column) -> Column:
        none = F.array(F.lit(None).cast(_PAIR))
        before = F.zip_with(pairs, F.concat(none, pairs), lambda x, y: x["h"] == y["h"])
        after = F.zip_with(pairs, F.concat(F.slice(pairs, 2, F.size(pairs)), none), lambda x, y: x["h"] == y["h"])
        twice = F.zip_with(before, after, lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
        at = F.zip_with(pairs, twice, lambda x, t: F.when(t, x["i"]))  # the longer `before` ends with nulls
        return F.sort_array(F.filter(at, lambda i: i.isNotNull()))

    def within(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        unique = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unique, F.lit(0)).otherwise(let(let(pairs, flagged), covered))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (span - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(span))))

    return let(words, lambda w: F.when(F.size(w) >= span, let(hashed(w), within)).otherwise(F.lit(0))).cast("long")


_PAIR = "struct<h:bigint,i:int>"


def _signs(text: Column, signs: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")


def counted(docs: DataFrame) -> DataFrame:
    """`docs` as a struct `doc`, with the counts that the rules read. Null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    words = F.array_remove(F.split(text, rf"[{SPACE}]+"), "")
    upper = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    return docs.select(
        F.struct("*").alias("doc"), word_count(text).alias("n_words"), F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        _signs(text, SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("all"))).alias("l"),
        repeated_words(words).alias("n_repeat_words"), _signs(text, "!").alias("n_calls"), _signs(text, ".").alias("n_stops"),
        upper.alias("n_upper"),
    ).withColumns({"n_dup_lines": F.col("l.dup"), "n_lines": F.col("l.all")}).drop("l")


def _vote(bad: Column, good: Column | None = None) -> Column:
    return F.when(bad, F.lit(-1)).when(F.lit(False) if good is None else good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes of the rules on counted rows: 1 good, -1 bad, 0 abstains."""
    n, c = F.col("n_words"), F.col
    chars = c("word_chars")
    return {
        "symbols": _vote(100 * c("n_symbols") > 10 * n),
        "capitals": _vote(100 * c("n_upper") > 30 * chars),
        "calls": _vote(100 * c("n_calls") > 10 * n),
        "repeats": _vote(100 * c("n_repeat_words") > 15 * n),
        "lines": _vote(100 * c("n_dup_lines") > 25 * c("n_lines")),
        "stops": _vote(F.lit(False), (100 * c("n_stops") >= 4 * n) & (100 * c("n_stops") <= 25 * n)),
        "length": _vote(n < LEAST_WORDS, n >= 2 * LEAST_WORDS),
        "word_size": _vote((10 * chars < 20 * n) | (10 * chars > 150 * n), (10 * chars >= 30 * n) & (10 * chars <= 90 * n)),
        "line_size": _vote(n < 3 * c("n_lines")),
    }


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)


Table = dict[str, dict[int, tuple[float, float]]]  # rule, vote: its share among good and among bad documents


def _good(share: float, table: Table) -> Column:
    """Posterior probability of good, given the votes. All numbers are in one array, so the plan stays the same."""
    odds = [math.log(share / (1 - share))] + [math.log(g / b) for votes in table.values() for _, (g, b) in sorted(votes.items())]
    held = F.array(*map(F.lit, odds))
    total = F.get(held, F.lit(0))
    for i, r in enumerate(table):
        total = total + F.get(held, F.col(r) + F.lit(2 + 3 * i))
    return 1 / (1 + F.exp(-total))


def fit(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, Table]:
    """Share of good documents and how good and bad ones are voted on, by expectation maximisation over all documents.

    A rule's accuracy is its share of right votes in each class; abstaining is an answer too. Documents are
    first counted per vote pattern (3 ** rules patterns at most); a round is one aggregation over the
    patterns. START is a prior that weighs BELIEF as much as the documents. A rule calls at most FALSE_ALARM
    of the good documents bad, which fixes what good means and keeps a rare defect from passing for good.
    Without documents the starting values come back.
    """
    patterns = cut(votes.groupBy(*names).agg(F.count("*").cast("double").alias("n")).coalesce(1))
    share, table = START_GOOD, {r: dict(START) for r in names}
    cells = [(r, v) for r in names for v in START]
    held = patterns.agg(F.sum("n").alias("all"), *[F.sum(F.when(F.col(r) == v, F.col("n")).otherwise(0.0)).alias(f"{r} {v}") for r, v in cells]).first()
    for _ in range(rounds if held["all"] else 0):
        mass = F.col("n") * F.col("p")
        sums = [F.sum(F.when(F.col(r) == v, mass).otherwise(0.0)).alias(f"{r} {v}") for r, v in cells]
        got = patterns.withColumn("p", _good(share, table)).agg(F.sum(mass).alias("good"), *sums).first()
        good, bad = got["good"], held["all"] - got["good"]
        new: Table = {r: {} for r in names}
        for r, v in cells:
            g, b = got[f"{r} {v}"], held[f"{r} {v}"] - got[f"{r} {v}"]
            new[r][v] = tuple((x + BELIEF * k * s + 1e-9) / (k * (1 + BELIEF) + 3e-9) for x, k, s in zip((g, b), (good, bad), START[v], strict=True))
        for r in names:  # a false alarm stays rare; what is cut off goes to abstaining
            g, b = new[r][-1]
            over = max(0.0, g - FALSE_ALARM)
            new[r] |= {-1: (g - over, b), 0: (new[r][0][0] + over, new[r][0][1])}
        moved = max(abs(x - y) for r, v in cells for x, y in zip(new[r][v], table[r][v], strict=True))
        share, table = min(0.999, max(0.001, good / held["all"])), new
        if moved < 1e-4:
            break
    return share, table


def _judge(counts: DataFrame) -> DataFrame:
    names = list(rules())
    staged = cut(counts.withColumns(rules()))
    share, table = fit(staged, names)
    out = staged.withColumn("base_failed", base_failed()).withColumn("quality", _good(share, table))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept; counts and texts are written once and serve both model and verdict."""
    return _judge(counted(docs)).filter("kept").select("doc.*")


def quality_table(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the posterior of every document of (doc_id, text).

    Empty and null texts have counts of 0 and fail the base; repeated rows and ids are rows of their own.
    Empty input gives no rows.
    """
    counts = counted(docs.select("doc_id", "text"))
    return _judge(counts.withColumn("doc_id", F.col("doc.doc_id")).drop("doc")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
