"""Experiments: feature blocks, cross-author and temporal protocols, ablation, scoring and the challenger."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.constants import FOLDS, RETRAIN_MIN_ROWS
from tidemark.functions import calendar as C
from tidemark.functions import text as X
from tidemark.operators import encode as E
from tidemark.operators import learn as L
from tidemark.operators.decide import apply_bands
from tidemark.operators.guards import guard_columns
from tidemark.operators.history import author_history, author_recency
from tidemark.operators.joins import left_with_default, left_with_median, with_one_row
from tidemark.operators.metrics import metrics
from tidemark.operators.resample import bootstrap_ci
from tidemark.operators.scan import join_keys
from tidemark.operators.similar import knn_features, knn_join
from tidemark.operators.splits import fold_table, group_kfold
from tidemark.operators.trend import multi_token_momentum, token_momentum
from tidemark.session import cut, in_parallel
from tidemark.sources.sinks import append_log

Block = Callable[..., tuple[DataFrame, list[str]]]
BLOCKS: dict[str, Block] = {}
FITTED: set[str] = set()


def block(name: str, fitted: bool = False) -> Callable[[Block], Block]:
    """Register a feature block: ``fn(df, train, label, arg) -> (df with new columns, their names)``.

    ``fitted`` marks blocks that learn from train rows; all others are computed once and shared by
    every fold.
    """
    def register(fn: Block) -> Block:
        BLOCKS[name] = fn
        if fitted:
            FITTED.add(name)
        return fn

    return register


def split_specs(specs: Sequence[str]) -> tuple[list[str], list[str]]:
    """Specs that need no fitting, and those refitted per fold."""
    fitted = [s for s in specs if s.partition(":")[0] in FITTED]
    return [s for s in specs if s not in fitted], fitted


def build_blocks(df: DataFrame, specs: Sequence[str], train: Column, label: str) -> tuple[DataFrame, list[str]]:
    """Apply blocks by name (``name`` or ``name:argument``); encoders see train rows only."""
    names: list[str] = []
    for spec in specs:
        name, _, arg = spec.partition(":")
        if name not in BLOCKS:
            raise ValueError(f"unknown block {name!r}")
        df, new = BLOCKS[name](df, train, label, arg or None)
        names += [n for n in new if n not in names]
    return df, names


@block("caption")
def _caption(df, train, label, arg):
    return X.caption_features(df, arg or "desc"), list(X.CAPTION_FEATURES)


@block("emotion")
def _emotion(df, train, label, arg):
    cols = [*X.EMOTIONS, "speaking_rate"]
    df = df.withColumns({c: F.col(c).try_cast("double") for c in cols})
    arousal = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in X.AROUSAL])
    return df.withColumn("arousal", arousal), [*cols, "arousal"]


@block("duration")
def _duration(df, train, label, arg):
    df = df.withColumn("duration_s", F.col(arg or "duration").try_cast("double"))
    return C.duration_bands(df, "duration_s"), ["duration_s", *[n for n, _, _ in C.DURATION_BANDS]]


@block("timing")
def _timing(df, train, label, arg):
    names = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_weekend", "month_sin", "month_cos"]
    return C.calendar_features(df, arg or "ts"), names


@block("meta")
def _meta(df, train, label, arg):
    flags = {f"{c}_i": F.coalesce((F.col(c) == F.lit(True)).cast("int"), F.lit(0)) for c in ("is_english", "created_by_ai", "is_ads")}
    return df.withColumns(flags | {"aspect": F.col("ratio").try_cast("double")}), [*flags, "aspect"]


@block("missing")
def _missing(df, train, label, arg):
    texts = {"caption": "desc", "transcript": "transcript"}
    vectors = {m: m for m in ("audio", "video") if m in df.columns}
    return X.missing_indicators(df, texts, vectors), [f"has_{m}" for m in [*texts, *vectors]]


@block("topic", fitted=True)
def _topic(df, train, label, arg):
    return E.target_encode(df, arg or "topic", label, train, "topic_te"), ["topic_te"]


@block("music", fitted=True)
def _music(df, train, label, arg):
    key = arg or "music_id"
    df = E.target_encode(df, key, label, train, "music_te")
    return E.train_popularity(df, key, train, "music_pop_log"), ["music_te", "music_pop_log"]


@block("hashtags", fitted=True)
def _hashtags(df, train, label, arg):
    return E.tag_target_encode(df, "item_id", arg or "tags", label, train, "htag_te"), ["htag_te"]


@block("semantic", fitted=True)
def _semantic(df, train, label, arg):
    k = int(arg or 60)
    vec = L.TextEncoder(k=k).fit(df.filter(train), "text")
    return L.spread_vector(vec.transform(df, "text", "_sv"), "_sv", "sv", vec.k)


@block("vector")
def _vector(df, train, label, arg):
    col, dim = arg.split(",")
    return L.spread_vector(df, col, col, int(dim))


@block("author_history")
def _history(df, train, label, arg):
    names = ["author_hist_breakout", "author_hist_pop", "author_nprior_log"]
    return author_history(df, "author_id", "t", "views_at_H", "followers_at_post"), names


@block("author_recency")
def _recency(df, train, label, arg):
    ratio = F.log1p(F.coalesce("views_at_H", F.lit(0.0)) / F.greatest(F.coalesce("followers_at_post", F.lit(1.0)), F.lit(1.0)))
    df = author_recency(df.withColumn("_lb", ratio), "author_id", "t", "item_id", "_lb").drop("_lb")
    return df, ["auth_recent3", "auth_ewm", "auth_momentum", "auth_days_since_last_log"]


@block("trend")
def _trend(df, train, label, arg):
    df = token_momentum(df, arg or "music_id", "t", "trend_music")
    if "tags" not in df.columns:
        return df, ["trend_music"]
    return multi_token_momentum(df, "item_id", "tags", "t", "trend_hashtag"), ["trend_music", "trend_hashtag"]


@block("retrieval", fitted=True)
def _retrieval(df, train, label, arg):
    """Mean label and similarity of the nearest train rows; a row never finds itself."""
    k = int(arg or 50)
    near = knn_join(df, df.filter(train).withColumn("_y", F.col(label)), "item_id", "item_id", "vec", "vec", k, payload=["_y"])
    feats = knn_features(near, "item_id", "_y")
    return left_with_default(df, feats, "item_id", {"knn_success": 0.0, "knn_sim": 0.0}), ["knn_success", "knn_sim"]


def encoder(name: str, fit: Callable[[DataFrame, str], Callable[[list[str]], np.ndarray]], dim: int, text: str = "text") -> None:
    """Register a text encoder of the caller as the block ``name``.

    ``fit`` sees the train rows and the text column, and returns a function from texts to an array of texts x ``dim``.
    """
    @block(name, fitted=True)
    def _encoded(df, train, label, arg):
        column = arg or text
        return L.spread_vector(L.encode_text(df, column, fit(df.filter(train), column), dim, f"_{name}"), f"_{name}", name, dim)


@block("day1")
def _day1(df, train, label, arg):
    return df, ["log_play_d1", "log_like_d1", "er_d1", "log_play_d1_vs_author"]


@block("day1_basic")
def _day1_basic(df, train, label, arg):
    return df, ["log_play_d1", "log_like_d1", "er_d1"]


def median_filled_block(name: str, table: DataFrame, cols: Sequence[str]) -> None:
    """Register a block that joins a table of per-item scores and fills gaps with the median."""
    @block(name)
    def _scores(df, train, label, arg):
        wanted = arg.split(",") if arg else list(cols)
        return left_with_median(df, table, "item_id", wanted), wanted


# ---- protocols


def run_experiment(
    df: DataFrame, specs: Sequence[str], model: str, label: str = "y", stage: str = "pre", folds: int = FOLDS,
    key: str = "item_id", by: str = "author_id", protocols: Sequence[str] = ("cross_author", "temporal"),
    replicates: int = 0, name: str | None = None, log: str | None = None, dealt: tuple[DataFrame, int] | None = None,
    built: tuple[DataFrame, list[str]] | None = None, **params,
) -> DataFrame:
    """One row per protocol in the shape of the run log; with ``log`` the rows are appended to it.

    Experiments on the same rows can share ``dealt``, the fold of each group and the number of rows, and with the same blocks ``built``,
    what needs no fitting.

    ``cross_author``: out-of-fold over author folds; ``temporal``: train split to test split.
    The column guard runs before any model is fitted, so a refused feature leaves no log row.
    """
    start = time.time()
    if built is None:
        built = _frozen(df, specs, [label], stage, key, by, folds, "cross_author" in protocols, dealt)
    shared, frozen = built
    parts, width = [], 0
    for protocol in protocols:
        if protocol == "cross_author":
            scored, width = _cross_author(shared, frozen, specs, model, label, stage, folds, key, params)
        else:
            ready, feats = _features(shared, frozen, specs, F.col("split") == "train", label, stage, key, "split")
            fitted = L.fit(ready.filter("split = 'train'"), model, feats, label, gaps=L.with_gaps(ready, feats), **params)
            scored, width = L.predict(fitted, ready.filter("split = 'test'")), len(feats)
        row = metrics(scored, label, "p").select("n", "roc_auc", "avg_precision", "brier")
        if replicates:
            ci = bootstrap_ci(scored, "roc_auc", label, "p", key, replicates)
            row = with_one_row(row, ci.select(F.col("lo").alias("auc_lo"), F.col("hi").alias("auc_hi")))
        else:
            row = row.withColumns({"auc_lo": F.lit(None).cast("double"), "auc_hi": F.lit(None).cast("double")})
        parts.append(row.withColumn("protocol", F.lit(protocol)))
    out = reduce(DataFrame.unionByName, parts)
    rows = out.select(
        F.lit(name or "+".join(specs)).alias("label"), F.lit(model).alias("model"), F.lit(label).alias("target"),
        F.lit(stage).alias("stage"), F.lit(width).cast("bigint").alias("n_features"), "protocol", "n", "roc_auc",
        "auc_lo", "auc_hi", "avg_precision", "brier", F.lit(round(time.time() - start, 3)).alias("seconds"),
    )
    if log is None:
        return rows
    rows = cut(rows)
    append_log(rows, log)
    return rows


def _dealt(df, by: str = "author_id", folds: int = FOLDS, protocols: Sequence[str] = ("cross_author", "temporal"), **_) -> tuple[DataFrame, int] | None:
    """The fold of each group, written once for all experiments on the same rows, and their number; none if no protocol asks for folds."""
    return (cut(fold_table(df, by, folds).select(by, "fold")), df.count()) if "cross_author" in protocols else None


def _frozen(df, specs, labels, stage, key, by, folds, folded: bool, dealt: tuple[DataFrame, int] | None = None) -> tuple[DataFrame, list[str]]:
    """Fold numbers and the blocks that need no fitting, computed and written once.

    Where nothing is fitted later, only what the protocols read is written.
    """
    plain, fitted = split_specs(specs)
    shared, names = build_blocks(df, plain, F.lit(True), labels[0])
    guard_columns(names, stage)

    def written(rows: DataFrame) -> DataFrame:
        keep = rows.columns if fitted else [c for c in dict.fromkeys([key, *labels, "fold", "split", *names]) if c in rows.columns]
        return cut(rows.select(*keep))

    if folded and dealt is not None:
        table = written(join_keys(shared, dealt[0], [by], "left"))
        if table.count() == dealt[1]:
            return table, names  # else a block repeated rows, and the groups have other sizes
    return written(group_kfold(shared, by, folds) if folded else shared), names


def _features(shared, frozen, specs, train: Column, label, stage, key, part) -> tuple[DataFrame, list[str]]:
    """Guarded feature table of one fold; written once when encoders were fitted for it."""
    fitted = split_specs(specs)[1]
    ready, new = build_blocks(shared, fitted, train, label)
    names = [*frozen, *[n for n in new if n not in frozen]]
    guard_columns(names, stage)
    table = ready.select(key, label, part, *names)
    return (cut(table) if fitted else table), names


def _cross_author(shared, frozen, specs, model, label, stage, folds, key, params) -> tuple[DataFrame, int]:
    alike = None if split_specs(specs)[1] else L.with_gaps(shared, frozen)  # without fitted blocks all folds have the same columns

    def one(k: int) -> tuple[DataFrame, int]:
        ready, feats = _features(shared, frozen, specs, F.col("fold") != k, label, stage, key, "fold")
        gaps = L.with_gaps(ready, feats) if alike is None else alike
        fitted = L.fit(ready.filter(F.col("fold") != k), model, feats, label, gaps=gaps, **params)
        return L.predict(fitted, ready.filter(F.col("fold") == k)).select(key, label, "fold", "p"), len(feats)

    done = in_parallel(shared.sparkSession, [partial(one, k) for k in range(folds)])
    return cut(reduce(DataFrame.unionByName, [scored for scored, _ in done])), done[0][1]


def out_of_fold_scores(
    df: DataFrame, specs: Sequence[str], model: str, label: str = "y", stage: str = "pre", folds: int = FOLDS,
    key: str = "item_id", by: str = "author_id", **params,
) -> DataFrame:
    """Cross-author scores: key, label, fold, p."""
    shared, frozen = _frozen(df, specs, [label], stage, key, by, folds, True)
    return _cross_author(shared, frozen, specs, model, label, stage, folds, key, params)[0]


def ablation(df: DataFrame, stages: Sequence[tuple[str, Sequence[str]]], model: str, **kw) -> DataFrame:
    """One experiment per stage, in order, with the change of AUC from the stage before."""
    dealt = _dealt(df, **kw)

    def one(i: int, name: str, specs: Sequence[str]) -> DataFrame:
        return run_experiment(df, specs, model, name=name, dealt=dealt, **kw).withColumn("position", F.lit(i))

    parts = in_parallel(df.sparkSession, [partial(one, i, n, s) for i, (n, s) in enumerate(stages)])
    rows = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("protocol").orderBy("position")  # one row per stage
    return rows.withColumn("delta", F.col("roc_auc") - F.lag("roc_auc").over(w))


def add_one(base: Sequence[str], extras: Sequence[str]) -> list[tuple[str, list[str]]]:
    return [("base", list(base)), *[(f"+{e}", [*base, e]) for e in extras]]


def drop_group(specs: Sequence[str]) -> list[tuple[str, list[str]]]:
    return [("all", list(specs)), *[(f"-{s}", [x for x in specs if x != s]) for s in specs]]


def target_contrast(df: DataFrame, configs: Mapping[str, Sequence[str]], targets: Sequence[str], model: str, **kw) -> DataFrame:
    """The same feature sets against several labels; folds are dealt once, and the blocks that need no fitting built once per set."""
    given = {"stage": "pre", "key": "item_id", "by": "author_id", "folds": FOLDS, "protocols": ("cross_author", "temporal")} | kw
    stage, key, by, folds, folded = given["stage"], given["key"], given["by"], given["folds"], "cross_author" in given["protocols"]
    dealt, parts = _dealt(df, **kw), []
    for name, specs in configs.items():
        built = _frozen(df, specs, list(targets), stage, key, by, folds, folded, dealt)
        parts += [run_experiment(df, specs, model, label=t, name=name, built=built, **kw) for t in targets]
    return reduce(DataFrame.unionByName, parts)


def baselines(df: DataFrame, label: str = "y", by: str = "author_id", caption: str | None = None) -> DataFrame:
    """Majority class, author prior, rule score and, given the caption's column, a logistic model of the caption alone, on the temporal test split."""
    if caption is not None:
        df, feats = build_blocks(df, [f"caption:{caption}"], F.lit(True), label)
        df = L.predict(L.fit(df.filter("split = 'train'"), "logit", feats, label), df, "p_caption")
    train = F.col("split") == "train"
    prior = E.target_encode(df, by, label, train, "p_author").filter("split = 'test'")
    share = df.filter(train).agg(F.avg(label).alias("p_majority"))
    scored = with_one_row(prior, share)
    names = ["p_majority", "p_author"] + [c for c in ("rule_score", "p_caption") if c in df.columns]
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    tall = scored.selectExpr(label, f"stack({len(names)}, {pairs}) AS (baseline, p)")
    return metrics(tall, label, "p", by=["baseline"]).select("baseline", "n", "roc_auc", "avg_precision", "brier")


def assessment(oof: DataFrame, items: DataFrame, bands: DataFrame, key: str = "item_id", label: str = "y") -> DataFrame:
    """Per item: out-of-fold score, decision, outcome, and whether it was right (unknown when Unsure)."""
    d = apply_bands(oof, "p", bands)
    right = F.when(F.col("decision") == "Unsure", F.lit(None)).otherwise(
        ((F.col("decision") == "Post") == (F.col(label) == 1)).cast("int")
    )
    return d.withColumn("correct", right).join(items, key, "left")


def score_batch(
    candidates: DataFrame, model, calibration, bands: DataFrame, key: str = "item_id", caption: str = "desc",
    duration: str = "duration", extra: str = "transcript",
) -> DataFrame:
    """Calibrated probability, decision, input warnings and where p lies between the band edges, per candidate; none is dropped."""
    scored = L.apply_calibration(L.predict(model, candidates, "p_raw"), "p_raw", calibration, "p")
    d = apply_bands(scored, "p", bands).withColumn("warnings", X.data_warnings(caption, duration, extra))
    p, low, high = F.col("p"), F.col("t_low"), F.col("t_high")
    why = (
        F.when(p.isNull(), "p unknown").when(F.col("decision") == "Post", F.format_string("p %.3f >= %.3f", p, high))
        .when(F.col("decision") == "Do not post", F.format_string("p %.3f < %.3f", p, low))
        .otherwise(F.format_string("%.3f <= p %.3f < %.3f", low, p, high))
    )
    return with_one_row(d, bands.select("t_low", "t_high")).select(key, "p", "decision", "warnings", why.alias("rationale"))


def challenger_report(
    base: DataFrame, matured: DataFrame, specs: Sequence[str], model: str = "gbt", label: str = "y",
    min_rows: int = RETRAIN_MIN_ROWS, **params,
) -> DataFrame:
    """Champion (base train rows) against challenger (plus matured rows) on the fixed test split.

    One row; with too few matured rows it only says so. Nothing is promoted here.
    """
    n_new = matured.filter(F.col(label).isNotNull()).count()
    if n_new < min_rows:
        return base.sparkSession.range(1).select(F.lit(n_new).alias("n_new"), F.lit("too_few_rows").alias("verdict"))
    everything = base.unionByName(matured.withColumn("split", F.lit("new")), allowMissingColumns=True)
    ready, feats = build_blocks(everything, specs, F.col("split") == "train", label)
    ready = cut(ready.select("item_id", label, "split", *feats))
    test = ready.filter("split = 'test'")
    fits = {
        "champion": L.fit(ready.filter("split = 'train'"), model, feats, label, **params),
        "challenger": L.fit(ready.filter("split IN ('train', 'new')"), model, feats, label, **params),
    }
    rows = reduce(
        DataFrame.unionByName, [L.predict(m, test).select(label, "p", F.lit(n).alias("who")) for n, m in fits.items()]
    )
    m = metrics(rows, label, "p", by=["who"])
    auc = lambda who: F.max(F.when(F.col("who") == who, F.col("roc_auc")))
    one = m.agg(
        auc("champion").alias("champion_auc"), auc("challenger").alias("challenger_auc"),
        F.max(F.when(F.col("who") == "challenger", F.col("brier"))).alias("challenger_brier"),
    )
    verdict = F.when(F.col("challenger_auc") >= F.col("champion_auc"), "not_worse").otherwise("worse")
    return one.select(F.lit(n_new).alias("n_new"), "*", verdict.alias("verdict"))

