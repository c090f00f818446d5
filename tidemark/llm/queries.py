"""The registered queries of the corpus operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidemark.llm import archives, chat, decontam, lines, mixing, near, periodic, quality, ranked, sharding, token_counts, token_files, toxicity
from tidemark.llm.common import WORD, table, with_row, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda s, d: toxicity.toxicity_table(table(s, d, "documents"), table(s, d, "labels")),
    "op2_quality_rules": lambda s, d: quality.quality_table(table(s, d, "documents")),
    "op3_sharding": lambda s, d: sharding.shard_table(table(s, d, "documents")),
    "op4_token_files": lambda s, d: token_files.token_table(table(s, d, "documents")),
    "op5_decontamination": lambda s, d: decontam.contamination_table(table(s, d, "documents"), table(s, d, "benchmark")),
    "op5_proximity": lambda s, d: decontam.proximity_table(table(s, d, "documents"), table(s, d, "benchmark")),
    "op6_archives": lambda s, d: archives.archive_table(table(s, d, "pages")),
    "op7_chat": lambda s, d: chat.chat_table(table(s, d, "conversations")),
    "op8_mixing": lambda s, d: mix_table(table(s, d, "documents")),
    "op9_line_dedup": lambda s, d: lines.line_table(table(s, d, "documents"), both_ways=True),
    "op10_ngram_join": lambda s, d: near.near_table(table(s, d, "documents")),
    "op11_periodic_runs": lambda s, d: periodic.run_table(table(s, d, "documents")),
    "op12_token_counts": lambda s, d: token_counts.count_table(table(s, d, "documents")),
    "op13_ranked_search": lambda s, d: ranked.search_table(table(s, d, "documents"), table(s, d, "benchmark")),
    "pipeline": corpus_pipeline.run,
}


def mix_table(docs: DataFrame) -> DataFrame:
    rows = with_row(docs.select("doc_id", "source", word_count(docs["text"]).alias("size")))
    return mixing.mix_plan(rows).select("doc_id", "size", "source_size", "target", "taken")


_MIX = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS lim FROM per),
s AS (SELECT *, row_number() OVER r AS k, (sum(source_size) OVER () - coalesce(sum(lim) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM w WINDOW r AS (ORDER BY lim / CAST(weight AS DOUBLE), source NULLS LAST)),
f AS (SELECT min(k) AS k FROM s WHERE level * weight <= lim),
t AS (SELECT source, source_size, CASE WHEN s.k >= f.k THEN (SELECT level FROM s JOIN f USING (k)) * weight ELSE CAST(lim AS DOUBLE) END AS target FROM s, f),
q AS (SELECT d.*, t.source_size, t.target, md5(CAST(doc_id AS VARCHAR)) AS h,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)) NULLS FIRST, doc_id, size) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT q.*, pass, CASE WHEN target > 0 THEN (pass * source_size + upto) / target ELSE CAST(pass AS DOUBLE) END AS finish FROM q, (VALUES (0), (1), (2)) v(pass)),
o AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, h NULLS FIRST, doc_id, size ROWS UNBOUNDED PRECEDING) AS total FROM p)
SELECT doc_id, size, source_size, target,
  CAST(sum(CASE WHEN total <= (SELECT sum(size) FROM d) THEN size ELSE 0 END) AS BIGINT) AS taken
FROM o GROUP BY doc_id, size, source_size, target, source, h
"""

_CONTAMINATION = r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS body FROM (
    SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM wins),
grams AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS body FROM (
    SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM folded, sizes WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.i, g.k, n.item_id FROM grams g JOIN wins n ON g.k = n.k AND g.body = n.body),
marked AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM folded f LEFT JOIN marked m ON f.doc_id = m.doc_id LEFT JOIN named n ON f.doc_id = n.doc_id
"""

SQL: dict[str, str] = {
    "op5_decontamination": _CONTAMINATION, "op6_archives": archives.SQL, "op7_chat": chat.SQL, "op8_mixing": _MIX, "op9_line_dedup": lines.SQL,
    "op11_periodic_runs": periodic.SQL, "op13_ranked_search": ranked.SQL,
}
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
