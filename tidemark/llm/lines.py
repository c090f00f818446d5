"""Line dedup by winnowing: window minima are fingerprints, repeated windows make up runs, later runs go.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, with_row, word_count
from tidemark.llm.quality import let
from tidemark.session import cut

RUN_LINES = 3
RUN_WORDS = 20
_LINE = "struct<i:int,a:bigint,b:bigint,w:bigint>"
_WINDOW = "struct<i:int,last:int,f:bigint,p:int,a:bigint,b:bigint>"


def windows(text: Column, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS, both_ways: bool = False) -> Column:
    """The windows of a text: at each line with a word, the fewest lines from there that have `run_words` words, or `run_lines` lines.

    With `both_ways` also the fewest lines that end there, where these are not one of the former windows.

    Lines without words are passed over; a window that the end of the text cuts short is left out. Each has
    the places of its first and last line, its fingerprint (the least of its lines' hashes and the last place
    that has it) and two 64-bit hashes of its lines. Equal windows have their fingerprint at the same place,
    so a repeated run of at least one window is found by a fingerprint, wherever the run begins.
    """

    def line(x: Column, i: Column) -> Column:
        return F.struct(i.alias("i"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), word_count(x).alias("w"))

    def window(held: Column) -> Column:
        first, last = held[0], F.element_at(held, -1)
        least = F.array_min(F.transform(held, lambda x: F.struct(x["a"].alias("a"), (-x["i"]).alias("p"))))
        return F.struct(
            first["i"].alias("i"), last["i"].alias("last"), least["a"].alias("f"), (-least["p"]).alias("p"),
            F.xxhash64(F.transform(held, lambda x: x["a"])).alias("a"), F.xxhash64(F.transform(held, lambda x: x["b"])).alias("b"),
        )

    def grown(lines: Column) -> Column:
        """Each line with those that follow it in its window; null where the text ends before the window does."""

        def take(k: Column) -> Column:
            size = F.lit(None).cast("int")
            for n in range(run_lines, 0, -1):
                enough = F.aggregate(F.slice(lines, k + 1, F.lit(n)), F.lit(0).cast("long"), lambda s, x: s + x["w"]) >= run_words
                here = k + n <= F.size(lines)
                size = F.when(here & (enough if n < run_lines else F.lit(True)), F.lit(n)).otherwise(size)
            return let(size, lambda n: F.when(n.isNotNull(), window(F.slice(lines, k + 1, n))))

        def words(start: Column, n: Column) -> Column:
            return F.aggregate(F.slice(lines, start + 1, n), F.lit(0).cast("long"), lambda s, x: s + x["w"])

        def take_back(k: Column) -> Column:
            """Null also where these lines are the window from the first of them on."""
            size = F.lit(None).cast("int")
            for n in range(run_lines, 1, -1):
                enough = F.lit(True) if n == run_lines else words(k - n + 1, F.lit(n)) >= run_words
                size = F.when(k + 1 >= n, F.when(enough, F.lit(n)).otherwise(size)).otherwise(size)
            size = F.when(lines[k]["w"] >= run_words, F.lit(None).cast("int")).otherwise(size)
            return let(size, lambda n: F.when(n.isNotNull() & (words(k - n + 1, n - 1) >= run_words), window(F.slice(lines, k - n + 2, n))))

        at = F.sequence(F.lit(0), F.size(lines) - 1)
        held = F.concat(F.transform(at, take), F.transform(at, take_back)) if both_ways else F.transform(at, take)
        return F.filter(held, lambda x: x.isNotNull())

    lines = F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["w"] > 0)
    none = F.array().cast(f"array<{_WINDOW}>")
    return let(lines, lambda x: F.when(F.size(x) > 0, grown(x)).otherwise(none))


def later_runs(staged: DataFrame, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS, both_ways: bool = False) -> DataFrame:
    """(_row, gone): places of the lines of (_row, doc_id, text) that lie in a window met before, blank ones between them too.

    Before means a lower doc_id (null ids last), then a lower row number, then an earlier place. Only windows
    whose fingerprint occurs at two places are compared; those that overlap or touch make up a run. A
    window's first place is an aggregate, so no pairs are formed.

    Windows from a line on reach the start of a repeat, but not short lines at its end. With `both_ways` the
    windows up to a line are compared too, and the runs are the matches extended both ways, whichever earlier
    place they are with: a line of a repeated stretch that holds a whole window lies in a window from it on
    or, behind the last of these, in the window up to it; both lie inside the stretch.
    """
    found = staged.select("_row", "doc_id", F.explode(windows(F.coalesce("text", F.lit("")), run_lines, run_words, both_ways)).alias("w"))
    found = cut(found.select("_row", "doc_id", "w.*"))
    prints = found.groupBy("f").agg(
        F.min("_row").alias("r0"), F.max("_row").alias("r1"), F.min("p").alias("p0"), F.max("p").alias("p1")
    ).filter("r0 <> r1 or p0 <> p1").select("f")
    seen = found.join(prints, "f")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "i")
    first = seen.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("a", "b", "first")
    later = seen.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    spans = later.groupBy("_row").agg(F.collect_list(F.struct("i", "last")).alias("spans"))  # a text's own windows
    places = F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["last"])))
    return spans.select("_row", F.array_sort(F.array_distinct(places)).alias("gone"))


def deduped(docs: DataFrame, run_lines: int = RUN_LINES, run_words: int = RUN_WORDS, both_ways: bool = False) -> DataFrame:
    """`docs` as a struct `doc`, with the text left, and the line places deleted from it (`gone`).

    Only the lines of later repeated runs go; blank lines and everything else stay as they are. A null text
    stays null. Repeated rows are repeated texts. Texts are written once, so that row numbers hold.
    """
    staged = with_row(docs.select(F.struct("*").alias("doc")))
    text = F.col("doc")["text"]
    gone = later_runs(staged.select("_row", F.col("doc")["doc_id"].alias("doc_id"), text.alias("text")), run_lines, run_words, both_ways)

    def left(gone: Column) -> Column:
        lines = F.transform(F.split(text, "\n"), lambda x, i: F.when(~F.array_contains(gone, i), x))
        return F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")

    solid = let(F.split(text, "\n"), lambda held: F.filter("gone", lambda i: word_count(F.get(held, i)) > 0))
    return staged.join(gone, "_row", "left").withColumn("gone", solid).select(
        "doc", F.col("doc")["doc_id"].alias("doc_id"), F.when(F.col("gone").isNull(), text).otherwise(let(F.col("gone"), left)).alias("text"),
        F.coalesce("gone", F.array().cast("array<int>")).alias("gone"),
    )


def line_table(docs: DataFrame, both_ways: bool = False) -> DataFrame:
    """doc_id, text left, n_words left, n_deleted lines and deleted line places of every document of (doc_id, text)."""
    return deduped(docs.select("doc_id", "text"), both_ways=both_ways).select(
        "doc_id", "text", word_count(F.col("text")).alias("n_words"), F.size("gone").cast("long").alias("n_deleted"),
        F.array_join(F.col("gone").cast("array<string>"), ",").alias("deleted"),
    )


#: The same in SQL, both ways: windows are compared as text, first places by a window function.
SQL = rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
counted AS (SELECT *, len(regexp_extract_all(line, '{WORD}')) w FROM raw),
solid AS (
  SELECT *, lead(i, 1) OVER d i1, lead(i, 2) OVER d i2, lead(line, 1) OVER d l1, lead(line, 2) OVER d l2, lead(w, 1) OVER d w1,
    lag(i, 1) OVER d j1, lag(i, 2) OVER d j2, lag(line, 1) OVER d m1, lag(line, 2) OVER d m2, lag(w, 1) OVER d v1
  FROM counted WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
win AS (
  SELECT doc_id, i, CASE WHEN w >= {RUN_WORDS} THEN i WHEN w + w1 >= {RUN_WORDS} THEN i1 ELSE i2 END AS last,
    CASE WHEN w >= {RUN_WORDS} THEN line WHEN w + w1 >= {RUN_WORDS} THEN line || chr(10) || l1 ELSE line || chr(10) || l1 || chr(10) || l2 END AS body
  FROM solid),
back AS (
  SELECT doc_id, CASE WHEN w >= {RUN_WORDS} THEN i WHEN w + v1 >= {RUN_WORDS} THEN j1 ELSE j2 END AS i, i AS last,
    CASE WHEN w >= {RUN_WORDS} THEN line WHEN w + v1 >= {RUN_WORDS} THEN m1 || chr(10) || line ELSE m2 || chr(10) || m1 || chr(10) || line END AS body
  FROM solid),
both_ways AS (SELECT doc_id, i, last, body FROM win WHERE last IS NOT NULL UNION SELECT doc_id, i, last, body FROM back WHERE i IS NOT NULL),
later AS (
  SELECT doc_id, i, last FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) n FROM both_ways) WHERE n > 1),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM solid s JOIN later l ON s.doc_id = l.doc_id AND s.i BETWEEN l.i AND l.last),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n_deleted,
    string_agg(CAST(g.i AS VARCHAR), ',' ORDER BY g.i) AS deleted
  FROM counted r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.i = g.i GROUP BY r.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END AS text,
  len(regexp_extract_all(coalesce(k.t, ''), '{WORD}')) AS n_words, coalesce(k.n_deleted, 0) AS n_deleted, coalesce(k.deleted, '') AS deleted
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
