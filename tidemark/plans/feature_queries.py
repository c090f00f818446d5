"""Caption, calendar, rule, encoding, history and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.constants import DAY_US
from tidemark.functions import calendar as C
from tidemark.functions import numeric as N
from tidemark.functions import text as X
from tidemark.functions.rules import RULES, rule_score
from tidemark.operators import encode as E
from tidemark.operators import history as H
from tidemark.operators import joins as J
from tidemark.operators import panel as P
from tidemark.operators import trend as T
from tidemark.operators.guards import look_ahead_rows
from tidemark.plans.registry import query
from tidemark.sources import fixtures as fx

WITH_ITEMS = "WITH " + fx.ITEMS_SQL
WITH_SCORED = "WITH " + fx.SCORED_SQL
WITH_CAPTIONS = "WITH " + fx.CAPTIONS_SQL


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{X.SPACE}'), lambda w: w <> '')"


def caption_sql(c: str) -> str:
    """The twelve caption columns of text expression ``c``."""
    w = _words_sql(c)
    upper = f"list_filter({w}, lambda w: length(w) > 1 AND regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]'))"
    n = lambda p: f"len(regexp_extract_all({c}, {_sql_text(p)}))"
    f = lambda p: f"CASE WHEN regexp_matches({c}, {_sql_text(p)}) THEN 1 ELSE 0 END::BIGINT"
    return f"""length({c}) AS char_len, len({w}) AS word_len, {n(X.HASHTAG)} AS n_hashtags, {n(X.MENTION)} AS n_mentions,
    CASE WHEN contains({c}, '?') THEN 1 ELSE 0 END::BIGINT AS has_question,
    CASE WHEN contains({c}, '!') THEN 1 ELSE 0 END::BIGINT AS has_exclam, {n(X.EMOJI)} AS n_emoji,
    {f(X.URL)} AS has_url, {f(X.CTA)} AS has_cta, {n(chr(92) + 'p{Nd}')} / greatest(length({c}), 1)::DOUBLE AS digit_ratio,
    CASE WHEN {c} = '' THEN 1 ELSE 0 END::BIGINT AS caption_is_empty,
    len({upper}) / greatest(len({w}), 1)::DOUBLE AS allcaps_ratio"""


def _rounded(cols):
    return [F.round(c, 6).alias(c) if c in ("digit_ratio", "allcaps_ratio") else F.col(c) for c in cols]


ROUND_CAPTION = ", ".join(
    f"round({c}, 6) AS {c}" if c in ("digit_ratio", "allcaps_ratio") else c for c in X.CAPTION_FEATURES
)


@query("caption_features", WITH_CAPTIONS + f", f AS (SELECT item_id, {caption_sql('caption')} FROM captions) SELECT item_id, {ROUND_CAPTION} FROM f")
def caption_features(spark, d):
    return X.caption_features(fx.captions(spark, d), "caption").select("item_id", *_rounded(X.CAPTION_FEATURES))


@query("caption_features_documents", f"WITH f AS (SELECT doc_id, {caption_sql('text')} FROM documents) SELECT doc_id, {ROUND_CAPTION} FROM f")
def caption_features_documents(spark, d):
    return X.caption_features(fx.table(spark, d, "documents"), "text").select("doc_id", *_rounded(X.CAPTION_FEATURES))


def _list_sql(values):
    return "(" + ", ".join(_sql_text(v) for v in values) + ")"


def sentiment_sql() -> str:
    w = _words_sql("caption")
    bare = "lower(regexp_replace(w, '^[.,!?#@]+|[.,!?#@]+$', '', 'g'))"
    hits = lambda words, emoji: (
        f"(len(list_filter({w}, lambda w: {bare} IN {_list_sql(words)})) + len(regexp_extract_all(caption, '[{emoji}]')))"
    )
    alpha = f"regexp_extract_all(caption, '{X.ALPHA_WORD}')"
    cta = " OR ".join(f"contains(lower(caption), {_sql_text(p)})" for p in X.CTA_PHRASES)
    return WITH_CAPTIONS + f""", f AS (
    SELECT item_id, {hits(X.POSITIVE_WORDS, X.POSITIVE_EMOJI)} AS pos, {hits(X.NEGATIVE_WORDS, X.NEGATIVE_EMOJI)} AS neg,
           len({w}) AS nw, list_sum(list_transform({w}, lambda w: length(w))) AS chars, {alpha} AS alpha,
           CASE WHEN {cta} THEN 1 ELSE 0 END::BIGINT AS has_cta,
           len(regexp_extract_all(caption, '{X.WIDE_EMOJI}')) AS ne,
           CASE WHEN regexp_matches(caption, '{X.WIDE_URL}') THEN 1 ELSE 0 END::BIGINT AS has_url
    FROM captions)
    SELECT item_id, round((pos - neg) / (pos + neg + 1.0)::DOUBLE, 6) AS sentiment, least(ne, 20) AS n_emoji,
           CASE WHEN ne > 0 THEN 1 ELSE 0 END::BIGINT AS has_emoji, has_url, has_cta,
           round(least(coalesce(chars, 0) / greatest(nw, 1)::DOUBLE, 30), 6) AS mean_word_len,
           round(len(list_filter(alpha, lambda x: regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '[\\p{{Ll}}\\p{{Lt}}]')))
                 / greatest(len(alpha), 1)::DOUBLE, 6) AS allcaps_word_ratio
    FROM f"""


@query("sentiment_lexicon", sentiment_sql())
def sentiment_lexicon(spark, d):
    f = X.extended_caption_features(fx.captions(spark, d), "caption")
    return f.select(
        "item_id", F.round("sentiment", 6).alias("sentiment"), "n_emoji", "has_emoji", "has_url", "has_cta",
        F.round("mean_word_len", 6).alias("mean_word_len"), F.round("allcaps_word_ratio", 6).alias("allcaps_word_ratio"),
    )


@query(
    "duration_bands",
    "SELECT event_id, " + ", ".join(
        f"CASE WHEN value >= {lo}{'' if hi is None else f' AND value < {hi}'} THEN 1 ELSE 0 END::BIGINT AS {n}"
        for n, lo, hi in C.DURATION_BANDS
    ) + ", CASE WHEN value >= 15 AND value < 60 THEN 1 ELSE 0 END::BIGINT AS wide_mid FROM events",
)
def duration_bands(spark, d):
    e = fx.table(spark, d, "events")
    wide = C.duration_bands(e.select("event_id", "value"), "value", C.WIDE_DURATION_BANDS).select(
        "event_id", "value", F.col("dur_mid").alias("wide_mid")
    )
    return C.duration_bands(wide, "value").drop("value")


@query(
    "calendar_features",
    """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
    round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_cos,
    round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos,
    CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END::BIGINT AS is_weekend,
    round(sin(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS fhour_sin,
    round(cos(2 * pi() * (hour(ts) + minute(ts) / 60.0::DOUBLE) / 24), 6) AS fhour_cos FROM events""",
)
def calendar_features(spark, d):
    f = C.fractional_hour(C.calendar_features(fx.table(spark, d, "events"), "ts"), "ts")
    cols = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "fhour_sin", "fhour_cos"]
    return f.select("event_id", "is_weekend", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "part_of_day",
    "SELECT event_id, " + ", ".join(
        f"CASE WHEN hour(ts) >= {lo} AND hour(ts) < {hi} THEN 1 ELSE 0 END::BIGINT AS pod_{n}" for n, lo, hi in C.DAY_PARTS
    ) + " FROM events",
)
def part_of_day(spark, d):
    f = C.day_part(fx.table(spark, d, "events"), "ts")
    return f.select("event_id", *[f"pod_{n}" for n, _, _ in C.DAY_PARTS])


@query(
    "epoch_plausibility",
    f"""WITH s AS (SELECT event_id, (epoch_us(ts) // 1000000) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 0 END AS sec FROM events)
    SELECT event_id, CASE WHEN sec BETWEEN {C.EPOCH_RANGE[0]} AND {C.EPOCH_RANGE[1]} THEN strftime(make_timestamp(sec * 1000000), '%Y-%m-%d %H:%M:%S') END AS posted FROM s""",
)
def epoch_plausibility(spark, d):
    e = fx.table(spark, d, "events")
    unit = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 1000).otherwise(0)
    s = e.select("event_id", (F.floor(J.micros("ts") / 1000000) * unit).alias("sec"))
    return s.select("event_id", F.date_format(C.plausible_epoch("sec"), "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query(
    "lenient_types",
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw,
        CASE WHEN o_orderkey % 4 = 0 THEN '540p' ELSE (o_orderkey % 10)::VARCHAR END AS ratio,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS flag FROM orders)
    SELECT o_orderkey::VARCHAR AS item_id, strftime(try_cast(raw AS DATE), '%Y-%m-%d') AS day, try_cast(ratio AS DOUBLE) AS aspect,
           CASE WHEN flag THEN 1 ELSE 0 END AS is_f FROM s""",
)
def lenient_types(spark, d):
    o = fx.table(spark, d, "orders")
    k = F.col("o_orderkey")
    s = o.select(
        k.cast("string").alias("item_id"),
        F.when(k % 3 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("raw"),
        F.when(k % 4 == 0, "540p").otherwise((k % 10).cast("string")).alias("ratio"),
        F.when(k % 5 != 0, F.col("o_orderstatus") == "F").alias("flag"),
    )
    return s.select(
        "item_id", F.date_format(C.parse_time("raw"), "yyyy-MM-dd").alias("day"), N.to_number("ratio").alias("aspect"),
        N.true_flag("flag").alias("is_f"),
    )


@query(
    "arousal_sum",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
    round(coalesce(CASE WHEN l_returnflag = 'R' THEN l_discount END, 0) + coalesce(l_tax, 0), 6) AS arousal FROM lineitem""",
)
def arousal_sum(spark, d):
    li = fx.table(spark, d, "lineitem").withColumn("anger", F.when(F.col("l_returnflag") == "R", F.col("l_discount")))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        F.round(N.sum_known(["anger", "l_tax"]), 6).alias("arousal"),
    )


@query(
    "log_clip_ratio",
    """SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, least(greatest(o_totalprice, 1000), 200000) AS clipped FROM orders""",
)
def log_clip_ratio(spark, d):
    return fx.table(spark, d, "orders").select(
        "o_orderkey", F.round(F.log1p("o_totalprice"), 6).alias("log_price"),
        N.clip(F.col("o_totalprice"), 1000.0, 200000.0).alias("clipped"),
    )


@query(
    "text_field",
    """WITH t AS (SELECT d.doc_id, coalesce(c.turn, -1) AS turn, d.text, c.text AS said FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id)
    SELECT doc_id, turn, length(f) AS n, md5(f) AS digest FROM (SELECT doc_id, turn, trim(coalesce(text, '') || ' ' || coalesce(said, '') || ' ' || '', ' ') AS f FROM t)""",
)
def text_field(spark, d):
    c = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("said"))
    t = fx.table(spark, d, "documents").select("doc_id", "text").join(c, "doc_id", "left").withColumn("none", F.lit(None).cast("string"))
    f = X.text_field(["text", "said", "none"])
    turn = F.coalesce("turn", F.lit(-1).cast("bigint")).alias("turn")
    return t.select("doc_id", turn, F.length(f).cast("bigint").alias("n"), F.md5(f).alias("digest"))


@query(
    "missing_indicators",
    """SELECT d.doc_id, coalesce(c.turn, -1) AS turn, CASE WHEN trim(d.text) <> '' THEN 1 ELSE 0 END::BIGINT AS has_caption,
    CASE WHEN trim(coalesce(c.text, '')) <> '' THEN 1 ELSE 0 END::BIGINT AS has_transcript,
    CASE WHEN e.vec_id IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS has_audio
    FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
)
def missing_indicators(spark, d):
    c = fx.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.col("text").alias("said"))
    v = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    t = fx.table(spark, d, "documents").select("doc_id", "text").join(c, "doc_id", "left").join(v, "doc_id", "left")
    m = X.missing_indicators(t, {"caption": "text", "transcript": "said"}, {"audio": "embedding"})
    turn = F.coalesce("turn", F.lit(-1).cast("bigint")).alias("turn")
    return m.select("doc_id", turn, "has_caption", "has_transcript", "has_audio")


@query(
    "one_hot_topic",
    "SELECT event_id, " + ", ".join(
        f"CASE WHEN event_type = '{t}' THEN 1 ELSE 0 END AS topic_{t}" for t in ("click", "error", "purchase", "view")
    ) + " FROM events",
)
def one_hot_topic(spark, d):
    cats = ["click", "error", "purchase", "view"]
    f = E.one_hot(fx.table(spark, d, "events"), "event_type", cats, "topic")
    return f.select("event_id", *[f"topic_{c}" for c in cats])



@query(
    "ascii_language",
    """WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS a, len(regexp_extract_all(text, '[A-Za-z]')) AS b FROM documents)
    SELECT doc_id, CASE WHEN a > 0 THEN (b / a::DOUBLE > 0.8)::INT::DOUBLE END AS is_english FROM s""",
)
def ascii_language(spark, d):
    return fx.table(spark, d, "documents").select("doc_id", X.ascii_language("text").alias("is_english"))


@query(
    "url_handle",
    """WITH u AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://x.io/@Some.User-' || page_id || '/VIDEO/' || page_id * 37 ELSE url END AS url FROM pages)
    SELECT page_id, nullif(regexp_extract(url, '(?i)@([\\p{L}\\p{N}_.-]+)/video/([0-9]+)', 1), '') AS handle,
           nullif(regexp_extract(url, '(?i)@([\\p{L}\\p{N}_.-]+)/video/([0-9]+)', 2), '') AS video_id,
           nullif(regexp_extract(url, '^https?://([^/]+)', 1), '') AS host FROM u""",
)
def url_handle(spark, d):
    k = F.col("page_id")
    made = F.concat(F.lit("https://x.io/@Some.User-"), k.cast("string"), F.lit("/VIDEO/"), (k * 37).cast("string"))
    u = fx.table(spark, d, "pages").select("page_id", F.when(k % 2 == 0, made).otherwise(F.col("url")).alias("url"))
    host = F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(""))
    return X.url_identity(u, "url").select("page_id", "handle", "video_id", host.alias("host"))


SCORED_RULES = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for _, c, w in RULES)


@query(
    "rule_score",
    WITH_CAPTIONS + f""", f AS (SELECT item_id, value AS duration_s, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
        {caption_sql('caption')} FROM captions)
    SELECT item_id, round(1 / (1 + exp(-({SCORED_RULES}))), 6) AS rule_score,
           {' + '.join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for _, c, _ in RULES)} AS n_fired FROM f""",
)
def rule_score_query(spark, d):
    f = X.caption_features(fx.captions(spark, d), "caption").withColumn("duration_s", F.col("value"))
    r = rule_score(C.calendar_features(f, "ts"))
    return r.select("item_id", F.round("rule_score", 6).alias("rule_score"), F.size("fired").alias("n_fired"))


RAW_SQL = """raw AS (SELECT event_id, event_type, CASE event_id % 6
        WHEN 0 THEN 'Sure: {"summary": "' || event_type || '", "topic": "Cooking_Food", "hook": ' || round(value / 100, 2) || ', "cta": "0.4", "emotions": {"joy": 1.7, "fear": -1}} done'
        WHEN 1 THEN '{"topic": "Nonsense", "hook": "high"}' WHEN 2 THEN 'no object here' WHEN 3 THEN ''
        WHEN 4 THEN '{"topic": "Others", "cta": 0.25, "emotions": null}' ELSE NULL END AS raw FROM events)"""


@query(
    "json_normalise",
    f"""WITH {RAW_SQL}, b AS (SELECT *, regexp_extract(coalesce(raw, ''), '(?s)\\{{.*\\}}', 0) AS body FROM raw),
    p AS (SELECT *, body <> '' AND json_valid(body) AS ok, CASE WHEN body <> '' AND json_valid(body) THEN body ELSE '{{}}' END AS j FROM b)
    SELECT event_id, coalesce(json_extract_string(j, '$.summary'), event_type) AS summary,
      CASE WHEN json_extract_string(j, '$.topic') IN {_list_sql(X.TOPICS)} THEN json_extract_string(j, '$.topic') ELSE 'Others' END AS topic,
      greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.hook') AS DOUBLE), 0)))::DOUBLE AS hook,
      greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.cta') AS DOUBLE), 0)))::DOUBLE AS cta,
      greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.emotions.joy') AS DOUBLE), 0)))::DOUBLE AS joy,
      greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.emotions.fear') AS DOUBLE), 0)))::DOUBLE AS fear,
      ok::INT::BIGINT AS parsed FROM p""",
)
def json_normalise(spark, d):
    e = fx.table(spark, d, "events")
    k = F.col("event_id") % 6
    full = F.concat(
        F.lit('Sure: {"summary": "'), "event_type", F.lit('", "topic": "Cooking_Food", "hook": '),
        F.round(F.col("value") / 100, 2).cast("string"), F.lit(', "cta": "0.4", "emotions": {"joy": 1.7, "fear": -1}} done'),
    )
    raw = (
        F.when(k == 0, full).when(k == 1, '{"topic": "Nonsense", "hook": "high"}').when(k == 2, "no object here")
        .when(k == 3, "").when(k == 4, '{"topic": "Others", "cta": 0.25, "emotions": null}')
    )
    n = X.normalise_extraction(e.withColumn("raw", raw), "raw", "event_type")
    return n.select("event_id", "summary", "topic", "hook", "cta", "joy", "fear", "parsed")


@query(
    "clamp_inputs",
    """SELECT d.doc_id, length(substr(text, 1, 5000)) AS n, greatest(0, least(n_chars - 100, 7200))::DOUBLE AS duration,
    (n_chars - 50 > 0)::INT AS has_plays,
    CASE WHEN n_chars - 50 > 0 THEN round(least(1, greatest(doc_id % 900, 0) / greatest(n_chars - 50, 1)::DOUBLE), 6) ELSE 0 END::DOUBLE AS er_d1
    FROM documents d""",
)
def clamp_inputs(spark, d):
    t = fx.table(spark, d, "documents").select(
        "doc_id", "text", (F.col("n_chars") - 100).cast("double").alias("duration"),
        (F.col("n_chars") - 50).cast("double").alias("plays"), (F.col("doc_id") % 900).cast("double").alias("likes"),
    )
    c = X.clamp_inputs(t, "text", "duration", "plays", "likes")
    return c.select(
        "doc_id", F.length("text").cast("bigint").alias("n"), "duration", (F.col("plays") > 0).cast("int").alias("has_plays"),
        F.round("er_d1", 6).alias("er_d1"),
    )


@query(
    "data_warnings",
    WITH_CAPTIONS + """, w AS (SELECT item_id, value, (trim(caption) = '')::INT AS a, (k % 4 = 0)::INT AS b, (k % 9 = 0)::INT AS c FROM captions)
    SELECT item_id, array_to_string(list_filter([CASE WHEN a = 1 THEN 'no caption' END, CASE WHEN b = 1 THEN 'no duration' END,
        CASE WHEN c = 1 THEN 'no extra text' END], lambda x: x IS NOT NULL), ';') AS warnings,
        round(0.5 + (least(value / 500, 1) - 0.5) * pow(0.5, a + b), 6) AS p FROM w""",
)
def data_warnings(spark, d):
    c = fx.captions(spark, d).withColumns(
        {
            "duration": F.when(F.col("k") % 4 != 0, F.col("value")),
            "extra": F.when(F.col("k") % 9 != 0, F.col("topic")),
            "p": F.least(F.col("value") / 500, F.lit(1.0)),
        }
    )
    missing = (F.trim("caption") == "").cast("int") + F.col("duration").isNull().cast("int")
    return c.select(
        "item_id", F.array_join(X.data_warnings("caption", "duration", "extra"), ";").alias("warnings"),
        F.round(X.confidence_shrink("p", missing), 6).alias("p"),
    )


@query(
    "day1_validity",
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE (o_orderkey % 40) / 10.0::DOUBLE END AS age FROM orders)
    SELECT o_orderkey, CASE WHEN age IS NULL THEN 'unknown' WHEN age < 1 THEN 'immature' WHEN age <= 2 THEN 'ok' ELSE 'unreliable' END AS day1 FROM a""",
)
def day1_validity(spark, d):
    k = F.col("o_orderkey")
    a = fx.table(spark, d, "orders").select("o_orderkey", F.when(k % 10 != 0, (k % 40) / 10.0).alias("age"))
    return a.select("o_orderkey", C.day1_validity("age").alias("day1"))


@query("text_lengths", "SELECT page_id, length(url) AS url_len, length(html) AS html_len, CASE WHEN trim(html) <> '' THEN 1 ELSE 0 END AS has_html FROM pages")
def text_lengths(spark, d):
    return fx.table(spark, d, "pages").select(
        "page_id", F.length("url").cast("bigint").alias("url_len"), F.length("html").cast("bigint").alias("html_len"),
        (F.trim("html") != "").cast("int").alias("has_html"),
    )


# ---- encodings


@query(
    "target_encode_topic",
    WITH_SCORED + """, te AS (SELECT topic, avg(y) AS m FROM scored WHERE split = 'train' GROUP BY topic),
    g AS (SELECT avg(y) AS g FROM scored WHERE split = 'train'),
    tk AS (SELECT k, avg(y) AS m FROM scored WHERE split = 'train' GROUP BY k)
    SELECT item_id, round(te.m, 6) AS topic_te, round(coalesce(tk.m, g), 6) AS k_te FROM scored s LEFT JOIN te USING (topic)
    LEFT JOIN tk ON s.k = tk.k, g""",
)
def target_encode_topic(spark, d):
    s = fx.scored(spark, d)
    train = F.col("split") == "train"
    e = E.target_encode(E.target_encode(s, "topic", "y", train, "topic_te"), "k", "y", train, "k_te")
    return e.select("item_id", F.round("topic_te", 6).alias("topic_te"), F.round("k_te", 6).alias("k_te"))


@query(
    "target_encode_leave_one_out",
    WITH_SCORED + """, te AS (SELECT author_id, sum(y) AS s, count(*) AS n FROM scored WHERE split = 'train' GROUP BY author_id),
    g AS (SELECT avg(y) AS g FROM scored WHERE split = 'train')
    SELECT item_id, round(CASE WHEN split <> 'train' THEN coalesce(s / n::DOUBLE, g) WHEN n > 1 THEN (s - y) / (n - 1)::DOUBLE ELSE g END, 6) AS author_te
    FROM scored LEFT JOIN te USING (author_id), g""",
)
def target_encode_leave_one_out(spark, d):
    s = fx.scored(spark, d)
    e = E.target_encode(s, "author_id", "y", F.col("split") == "train", "author_te", leave_one_out=True)
    return e.select("item_id", F.round("author_te", 6).alias("author_te"))


@query(
    "popularity_train",
    WITH_SCORED + """, c AS (SELECT k, count(*) AS n FROM scored WHERE split = 'train' GROUP BY k)
    SELECT item_id, round(ln(1 + coalesce(n, 0)), 6) AS k_pop_log FROM scored LEFT JOIN c USING (k)""",
)
def popularity_train(spark, d):
    s = P.temporal_split(fx.items(spark, d), "t")
    return E.train_popularity(s, "k", F.col("split") == "train", "k_pop_log").select(
        "item_id", F.round("k_pop_log", 6).alias("k_pop_log")
    )


def _tags():
    k = F.col("k")
    return F.when(k % 13 == 0, F.array().cast("array<string>")).otherwise(
        F.array(F.concat(F.lit("a"), (k % 10).cast("string")), F.concat(F.lit("b"), k.cast("string")), F.col("topic"))
    )


TAGS_SQL = """, tagged AS (SELECT *, CASE WHEN k % 13 = 0 THEN []::VARCHAR[] ELSE ['a' || k % 10, 'b' || k, topic] END AS tags FROM scored),
    tall AS (SELECT item_id, t, y, split, unnest(tags) AS tag FROM tagged)"""


def _tag_sql(min_uses: int) -> str:
    return WITH_SCORED + TAGS_SQL + f""", r AS (SELECT tag, avg(y) AS rate FROM tall WHERE split = 'train' GROUP BY tag HAVING count(*) >= {min_uses}),
    m AS (SELECT item_id, avg(rate) AS m FROM tall JOIN r USING (tag) GROUP BY item_id), g AS (SELECT avg(y) AS g FROM scored WHERE split = 'train')
    SELECT item_id, round(coalesce(m, g), 6) AS tag_te FROM scored LEFT JOIN m USING (item_id), g"""


@query("tag_target_encode", _tag_sql(1))
def tag_target_encode(spark, d):
    s = fx.scored(spark, d).withColumn("tags", _tags())
    e = E.tag_target_encode(s, "item_id", "tags", "y", F.col("split") == "train", "tag_te")
    return e.select("item_id", F.round("tag_te", 6).alias("tag_te"))


@query("tag_neighbourhood", _tag_sql(60))
def tag_neighbourhood(spark, d):
    s = fx.scored(spark, d).withColumn("tags", _tags())
    e = E.tag_target_encode(s, "item_id", "tags", "y", F.col("split") == "train", "tag_te", min_uses=60)
    return e.select("item_id", F.round("tag_te", 6).alias("tag_te"))


# ---- closed windows


@query(
    "author_history_closed",
    WITH_ITEMS + """, h AS (SELECT item_id, avg(ln(1 + value / greatest(k, 1))) OVER w AS hb, avg(ln(1 + value)) OVER w AS hp, count(*) OVER w AS n FROM items
      WINDOW w AS (PARTITION BY author_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1209600000000 PRECEDING))
    SELECT item_id, round(coalesce(hb, 0), 6) AS author_hist_breakout, round(coalesce(hp, 0), 6) AS author_hist_pop,
           round(ln(1 + n), 6) AS author_nprior_log FROM h""",
)
def author_history_closed(spark, d):
    h = H.author_history(fx.items(spark, d), "author_id", "t", "value", "k")
    cols = ["author_hist_breakout", "author_hist_pop", "author_nprior_log"]
    return h.select("item_id", *[F.round(c, 6).alias(c) for c in cols])


@query(
    "author_recency_closed",
    WITH_ITEMS + """, q AS (SELECT item_id, author_id, t, ln(1 + value) AS v, row_number() OVER (PARTITION BY author_id ORDER BY t, item_id) AS seq,
        t - lag(t) OVER (PARTITION BY author_id ORDER BY t, item_id) AS dsl FROM items),
    vis AS (SELECT a.item_id, list(b.v ORDER BY b.seq DESC) AS vs FROM q a JOIN q b
            ON a.author_id = b.author_id AND b.t + 1209600000000 <= a.t GROUP BY a.item_id),
    f AS (SELECT item_id, list_avg(vs[1:3]) AS r3, list_avg(vs) AS life,
          list_sum(list_transform(vs, lambda x, i: x * pow(0.6::DOUBLE, i - 1))) / list_sum(list_transform(vs, lambda x, i: pow(0.6::DOUBLE, i - 1))) AS ew FROM vis)
    SELECT item_id, round(coalesce(r3, 0), 6) AS auth_recent3, round(coalesce(ew, 0), 6) AS auth_ewm,
           round(coalesce(r3 - life, 0), 6) + 0.0::DOUBLE AS auth_momentum,
           round(ln(1 + coalesce(dsl / 86400000000.0::DOUBLE, 0)), 6) AS auth_days_since_last_log FROM q LEFT JOIN f USING (item_id)""",
)
def author_recency_closed(spark, d):
    i = fx.items(spark, d).withColumn("log_value", F.log1p("value"))
    r = H.author_recency(i, "author_id", "t", "item_id", "log_value")
    cols = ["auth_recent3", "auth_ewm", "auth_momentum", "auth_days_since_last_log"]
    return r.select("item_id", *[(F.round(c, 6) + 0.0).alias(c) for c in cols])


def _fit_sql(gap: int) -> str:
    return f"""WITH e AS (SELECT vec_id, label % 3 AS author, vec_id * 7200000000 AS t, embedding::DOUBLE[] AS v, (vec_id % 2 = 0)::INT AS y FROM embeddings),
    u AS (SELECT *, list_transform(v, lambda x: x / (sqrt(list_sum(list_transform(v, lambda z: z * z))) + 1e-8::DOUBLE)) AS un FROM e),
    dims AS (SELECT vec_id, author, t, y, unnest(un) AS x, generate_subscripts(un, 1) AS i FROM u),
    c AS (SELECT a.vec_id, b.i, avg(b.x) AS c, count(*) AS n FROM u a JOIN dims b ON a.author = b.author AND b.y = 1 AND b.t + {gap} <= a.t GROUP BY ALL),
    nn AS (SELECT vec_id, sqrt(sum(c * c)) AS nrm, max(n) AS n FROM c GROUP BY vec_id),
    f AS (SELECT c.vec_id, sum(d.x * c.c / (nrm + 1e-8::DOUBLE)) AS fit, max(nn.n) AS n FROM c JOIN nn USING (vec_id)
          JOIN dims d ON d.vec_id = c.vec_id AND d.i = c.i GROUP BY c.vec_id)
    SELECT vec_id, round(coalesce(fit, 0), 6) AS author_fit, round(ln(1 + coalesce(n, 0)), 6) AS n_prior_wins_log FROM e LEFT JOIN f USING (vec_id)"""


def _vector_items(spark, d):
    e = fx.table(spark, d, "embeddings")
    return e.select(
        "vec_id", (F.col("label") % 3).alias("author"), (F.col("vec_id") * 7200000000).alias("t"), "embedding",
        (F.col("vec_id") % 2 == 0).cast("int").alias("y"),
    )


@query("author_fit_closed", _fit_sql(1209600000000))
def author_fit_closed(spark, d):
    f = H.author_fit(_vector_items(spark, d), "author", "t", "embedding", "y", 64)
    return f.select("vec_id", F.round("author_fit", 6).alias("author_fit"), F.round("n_prior_wins_log", 6).alias("n_prior_wins_log"))


@query("author_fit_strictly_earlier", _fit_sql(1))
def author_fit_strictly_earlier(spark, d):
    f = H.author_fit(_vector_items(spark, d), "author", "t", "embedding", "y", 64, gap=1)
    return f.select("vec_id", F.round("author_fit", 6).alias("author_fit"), F.round("n_prior_wins_log", 6).alias("n_prior_wins_log"))


MOMENTUM_SQL = """SELECT a.{k} AS tok, a.t, ln(1 + (SELECT count(*) FROM {s} b WHERE b.{k} = a.{k} AND b.t < a.t AND b.t >= a.t - 604800000000))
    - ln(1 + (SELECT count(*) FROM {s} b WHERE b.{k} = a.{k} AND b.t < a.t - 604800000000 AND b.t >= a.t - 3024000000000) / 28.0::DOUBLE * 7) AS m,
    (SELECT count(*) FROM {s} b WHERE b.{k} = a.{k}) AS uses FROM (SELECT DISTINCT {k}, t FROM {s}) a"""


@query(
    "token_momentum",
    WITH_ITEMS + f", m AS ({MOMENTUM_SQL.format(k='k', s='items')}) SELECT item_id, round(CASE WHEN uses > 1 THEN m ELSE 0 END, 6) + 0.0::DOUBLE AS trend_token "
    "FROM items i JOIN m ON i.k = m.tok AND i.t = m.t",
)
def token_momentum(spark, d):
    return T.token_momentum(fx.items(spark, d), "k", "t").select("item_id", (F.round("trend_token", 6) + 0.0).alias("trend_token"))


@query(
    "multi_token_momentum",
    WITH_SCORED + TAGS_SQL + f""", m AS ({MOMENTUM_SQL.format(k='tag', s='tall')}),
    a AS (SELECT item_id, avg(m) AS v FROM tall JOIN m ON tall.tag = m.tok AND tall.t = m.t WHERE uses > 1 GROUP BY item_id)
    SELECT item_id, round(coalesce(v, 0), 6) + 0.0::DOUBLE AS trend_tags FROM items LEFT JOIN a USING (item_id)""",
)
def multi_token_momentum(spark, d):
    i = fx.items(spark, d).withColumn("tags", _tags())
    return T.multi_token_momentum(i, "item_id", "tags", "t").select("item_id", (F.round("trend_tags", 6) + 0.0).alias("trend_tags"))


@query(
    "look_ahead_guard",
    WITH_ITEMS + """, h AS (SELECT item_id, t, max(t) OVER (PARTITION BY author_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1209600000000 PRECEDING) AS seen FROM items)
    SELECT count(*) AS rows, count(seen) AS with_history, coalesce(sum((seen + 1209600000000 > t)::INT), 0)::BIGINT AS look_ahead FROM h""",
)
def look_ahead_guard(spark, d):
    i = fx.items(spark, d)
    seen = J.asof_join(
        i.withColumn("t_open", F.col("t") - 14 * DAY_US), i.select("author_id", F.col("t").alias("t_prior")),
        "author_id", "t_open", "t_prior", {"t_prior": "last_seen"},
    )
    bad = look_ahead_rows(seen, "last_seen", "t").agg(F.count("*").alias("look_ahead"))
    return J.with_one_row(seen.agg(F.count("*").alias("rows"), F.count("last_seen").alias("with_history")), bad)
