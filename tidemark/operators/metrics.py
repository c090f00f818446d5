"""Rank, calibration and class metrics, all read off one table of counts per distinct score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.vectors import as_double, cosine
from tidemark.operators.joins import with_one_row
from tidemark.operators.scan import exact_quantiles, join_keys, prefix_scan, quantile_table
from tidemark.session import cut


def score_table(df: DataFrame, y: str, p: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Positives and negatives per (key, score): the only pass over the rows."""
    w = F.lit(1.0) if weight is None else weight
    # A filter on the score would be pushed below the model that makes it, which would then run twice for every row.
    return (
        df.filter(F.col(y).isNotNull())
        .groupBy(*by, F.col(p).alias("p"))
        .agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"),
             F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("neg"), F.count(F.col(p)).alias("_known"))
        .filter((F.col("pos") + F.col("neg") > 0) & (F.col("_known") > 0))
        .drop("_known")
    )


def ranked_scores(table: DataFrame, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Score table with cumulative counts up to and including each score, and totals ``all_pos``, ``all_neg``."""
    return prefix_scan(
        table, by, ["p"], sums={"cpos": F.col("pos"), "cneg": F.col("neg")},
        totals={"all_pos": F.col("pos"), "all_neg": F.col("neg")}, blocks=blocks,
    )


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("cneg") - F.col("neg") / 2))
    area = F.max("all_pos") * F.max("all_neg")
    return F.when(area > 0, wins / area)


def _average_precision() -> Column:
    tp = F.col("all_pos") - F.col("cpos") + F.col("pos")
    fp = F.col("all_neg") - F.col("cneg") + F.col("neg")
    return F.when((F.max("all_pos") > 0) & (F.max("all_neg") > 0), F.sum(F.col("pos") / F.col("all_pos") * tp / (tp + fp)))


def rank_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Tie-aware ROC-AUC and step-wise average precision; null when only one class is present."""
    runs = ranked_scores(score_table(df, y, p, by), by, blocks)
    return runs.groupBy(*by).agg(_auc().alias("roc_auc"), _average_precision().alias("avg_precision"))


def _safe(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def _class_columns(t: float) -> dict[str, Column]:
    hit = F.col("p") >= t
    tp = F.sum(F.when(hit, F.col("pos")).otherwise(0.0))
    fp = F.sum(F.when(hit, F.col("neg")).otherwise(0.0))
    fn = F.sum(F.when(hit, 0.0).otherwise(F.col("pos")))
    tn = F.sum(F.when(hit, 0.0).otherwise(F.col("neg")))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn}


def _class_metrics() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    f1_pos, f1_neg = _safe(2 * tp, 2 * tp + fp + fn), _safe(2 * tn, 2 * tn + fp + fn)
    return {
        "n": (tp + fp + fn + tn).cast("bigint"),
        "base_rate": (tp + fn) / (tp + fp + fn + tn),
        "accuracy": (tp + tn) / (tp + fp + fn + tn),
        "precision_pos": F.when(tp + fp > 0, tp / (tp + fp)),
        "recall_pos": _safe(tp, tp + fn),
        "n_pos_calls": (tp + fp).cast("bigint"),
        "precision_neg": _safe(tn, tn + fn),
        "recall_neg": _safe(tn, tn + fp),
        "f1_pos": f1_pos,
        "f1_neg": f1_neg,
        "macro_f1": (f1_pos + f1_neg) / 2,
    }


def confusion(df: DataFrame, y: str, p: str, t: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and per-class precision, recall and F1 at one threshold."""
    counts = score_table(df, y, p, by).groupBy(*by).agg(*[c.alias(n) for n, c in _class_columns(t).items()])
    out = counts.withColumns(_class_metrics())
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("tp", "fp", "fn", "tn")})


def metrics(
    df: DataFrame, y: str, p: str, t: float = 0.5, by: Sequence[str] = (), blocks: int | None = None
) -> DataFrame:
    """The whole bundle, one row per key."""
    runs = ranked_scores(score_table(df, y, p, by), by, blocks)
    sq = F.sum(F.col("pos") * F.pow(1 - F.col("p"), 2) + F.col("neg") * F.pow("p", F.lit(2)))
    one = runs.groupBy(*by).agg(
        _auc().alias("roc_auc"),
        _average_precision().alias("avg_precision"),
        (sq / F.sum(F.col("pos") + F.col("neg"))).alias("brier"),
        *[c.alias(n) for n, c in _class_columns(t).items()],
    )
    return one.withColumns(_class_metrics()).drop("tp", "fp", "fn", "tn")


def uniform_bin(p: str, bins: int = 10) -> Column:
    """Number of the equal-width bin of a probability; 1.0 falls in the last."""
    return F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("bigint")


def reliability(df: DataFrame, y: str, p: str, bins: int = 10, kind: str = "uniform", by: Sequence[str] = ()) -> DataFrame:
    """Mean score, observed rate and size of every non-empty bin (equal width, or equal count by quantile edges)."""
    known = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    if kind == "uniform":
        marked = known.withColumn("bin", uniform_bin(p, bins))
    else:
        marked = quantile_bucket(known, p, [i / bins for i in range(1, bins)], "bin")
    return marked.groupBy(*by, "bin").agg(
        F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def quantile_bucket(df: DataFrame, value: str, probs: Sequence[float], out: str) -> DataFrame:
    """0-based bucket between the distinct quantile edges; equal values always share a bucket.

    Edges lying on the minimum are dropped, as no value lies below them.
    """
    specs = {f"_e{i}": (value, q) for i, q in enumerate(probs)} | {"_min": (value, 0.0)}
    edges = quantile_table(df.select(value), [], specs)
    listed = F.array_distinct(F.array(*[F.col(f"_e{i}") for i in range(len(probs))]))
    one = edges.select(F.filter(listed, lambda e: e > F.col("_min")).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e <= F.col(value))).cast("bigint")
    return with_one_row(df, one).withColumn(out, F.when(F.col(value).isNotNull(), below)).drop("_edges")


def qcut(df: DataFrame, value: str, parts: int, out: str) -> DataFrame:
    """Quantile buckets closed on the right; the lowest value belongs to the first, duplicates merge."""
    probs = [i / parts for i in range(1, parts)]
    specs = {f"_e{i}": (value, q) for i, q in enumerate(probs)}
    edges = quantile_table(df.select(value), [], specs)
    one = edges.select(F.array_distinct(F.array(*[F.col(c) for c in specs])).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value))).cast("bigint")
    return with_one_row(df, one).withColumn(out, F.when(F.col(value).isNotNull(), below)).drop("_edges")


def ece(df: DataFrame, y: str, p: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error."""
    r = reliability(df, y, p, bins, by=by)
    gap = F.sum(F.col("n") * F.abs(F.col("rate") - F.col("mean_p")))
    return r.groupBy(*by).agg((gap / F.sum("n")).alias("ece"))


def segment_metrics(
    df: DataFrame, y: str, p: str, dims: Mapping[str, Column], min_n: int = 50, blocks: int | None = None
) -> DataFrame:
    """AUC, Brier and ECE for all rows and for every value of every dimension, in one pass.

    Segments that are small or hold one class are left out.
    """
    pairs = [F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("segment"))]
    pairs += [F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("segment")) for n, c in dims.items()]
    tall = df.select(y, p, F.explode(F.array(*pairs)).alias("_s")).select(y, p, "_s.*").filter("segment IS NOT NULL")
    keys = ["dimension", "segment"]
    table = score_table(tall, y, p, keys)
    runs = ranked_scores(table, keys, blocks)
    sq = F.sum(F.col("pos") * F.pow(1 - F.col("p"), 2) + F.col("neg") * F.pow("p", F.lit(2)))
    n = F.sum(F.col("pos") + F.col("neg"))
    one = runs.groupBy(*keys).agg(
        n.cast("bigint").alias("n"), (F.sum("pos") / n).alias("base_rate"), _auc().alias("roc_auc"), (sq / n).alias("brier")
    )
    return one.filter((F.col("n") >= min_n) & F.col("roc_auc").isNotNull()).join(ece(tall, y, p, by=keys), keys)


def feature_auc(df: DataFrame, y: str, features: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Single-feature AUC, lift over one half and Spearman sign per feature; constant features are left out."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in features)
    tall = df.selectExpr(y, f"stack({len(features)}, {pairs}) AS (feature, value)").filter("value IS NOT NULL")
    auc = rank_metrics(tall, y, "value", ["feature"], blocks).select("feature", "roc_auc")
    rho = spearman(tall, "value", y, ["feature"], blocks)
    return (
        auc.join(rho, "feature")
        .filter("spearman IS NOT NULL")
        .select("feature", "roc_auc", (F.col("roc_auc") - 0.5).alias("signed_lift"), "spearman")
    )


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Tie-averaged rank correlation per key, null being a key, reduced to distinct pairs first."""
    by = list(by)
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_w"))
    ra = _ranks(pairs, by, a, "_ra", blocks)
    rb = _ranks(pairs, by, b, "_rb", blocks)
    j = join_keys(join_keys(pairs, ra, by, plain=[a]), rb, by, plain=[b])
    return j.groupBy(*by).agg(weighted_corr("_ra", "_rb", "_w").alias("spearman"))


def _ranks(pairs: DataFrame, by: list[str], col: str, out: str, blocks: int | None) -> DataFrame:
    counts = pairs.groupBy(*by, col).agg(F.sum("_w").alias("_n"))
    runs = prefix_scan(counts, by, [col], sums={"_cum": F.col("_n")}, blocks=blocks)
    return runs.select(*by, col, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))


def weighted_corr(a: str, b: str, w: str) -> Column:
    """Pearson correlation under row weights, as one aggregate; null for constant columns."""
    n, wa, wb = F.sum(w), F.sum(F.col(w) * F.col(a)), F.sum(F.col(w) * F.col(b))
    cov = F.sum(F.col(w) * F.col(a) * F.col(b)) - wa * wb / n
    va = F.sum(F.col(w) * F.col(a) * F.col(a)) - wa * wa / n
    vb = F.sum(F.col(w) * F.col(b) * F.col(b)) - wb * wb / n
    return F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb))


def spearman_matrix(df: DataFrame, cols: Sequence[str], blocks: int | None = None) -> DataFrame:
    """Rank correlation of every pair of columns in long form, gaps filled with the median.

    The rows are read twice however many columns there are: once into counts per (column, value), from which
    medians and ranks of all columns come in one scan, and once to put the ranks beside each other.
    """
    pairs = ", ".join(f"{i}, CAST(`{c}` AS DOUBLE)" for i, c in enumerate(cols))
    tall = f"stack({len(cols)}, {pairs}) AS (_col, _value)"
    counts = cut(df.selectExpr(tall).groupBy("_col", "_value").agg(F.count(F.lit(1)).alias("_n")))
    known = counts.filter("_value IS NOT NULL")
    runs = cut(prefix_scan(known, ["_col"], ["_value"], sums={"_cum": F.col("_n")}, totals={"_all": F.col("_n")}, blocks=blocks))
    at = lambda rank: F.max(F.when((F.col("_cum") - F.col("_n") <= rank) & (rank < F.col("_cum")), F.col("_value")))
    middle = (F.col("_all") - 1) / 2
    gaps = counts.filter("_value IS NULL").select(F.col("_col").alias("_gap"), F.col("_n").alias("_gaps"))
    meds = runs.groupBy("_col").agg(((at(F.floor(middle)) + at(F.ceil(middle))) / 2).alias("_median"))
    meds = cut(meds.join(gaps, F.col("_col") == F.col("_gap"), "left").drop("_gap"))  # one row per column
    # Gaps add their number to the median; a median that no row has is a value of its own.
    moved = runs.select("_col", "_value", "_cum", "_n").join(F.broadcast(meds), "_col")
    extra = F.coalesce("_gaps", F.lit(0))
    moved = moved.select("_col", "_value", F.when(F.col("_value") == F.col("_median"), F.col("_n") + extra).otherwise(F.col("_n")).alias("_n"),
                         (F.col("_cum") + F.when(F.col("_value") >= F.col("_median"), extra).otherwise(0)).alias("_cum"))
    own = runs.select(F.col("_col").alias("_c"), F.col("_value").alias("_v"))
    alone = meds.filter("_gaps IS NOT NULL").join(own, (F.col("_col") == F.col("_c")) & (F.col("_median") == F.col("_v")), "left_anti")
    below = F.coalesce(F.max(F.when(F.col("_v") < F.col("_median"), F.col("_cum"))), F.lit(0))
    upto = runs.select(F.col("_col").alias("_c"), F.col("_value").alias("_v"), "_cum")
    alone = alone.join(upto, F.col("_col") == F.col("_c"), "left").groupBy("_col", F.col("_median").alias("_value"), F.col("_gaps").alias("_n")).agg(below.alias("_below"))
    alone = alone.select("_col", "_value", "_n", (F.col("_below") + F.col("_n")).alias("_cum"))
    ranks = cut(moved.unionByName(alone).select("_col", "_value", (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias("_rank")))
    rows = df.withColumn("_row", F.monotonically_increasing_id()).selectExpr("_row", tall)
    rows = rows.join(F.broadcast(meds.select("_col", "_median")), "_col").select("_row", "_col", F.coalesce("_value", "_median").alias("_value"))
    wide = rows.join(ranks, ["_col", "_value"]).groupBy("_row").agg(*[F.max(F.when(F.col("_col") == i, F.col("_rank"))).alias(f"_r{i}") for i in range(len(cols))])
    both = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    one = wide.agg(*[F.corr(f"_r{i}", f"_r{j}").alias(f"_c{n}") for n, (i, j) in enumerate(both)])
    cells = ", ".join(f"'{cols[i]}', '{cols[j]}', _c{n}" for n, (i, j) in enumerate(both))
    return one.selectExpr(f"stack({len(both)}, {cells}) AS (a, b, spearman)")


def _discount(rank: Column, k: int) -> Column:
    """Sum of the discounts 1 / log2(i + 1) of the first ``min(rank, k)`` positions."""
    steps = F.lit(0.0)
    for i in range(1, k + 1):
        steps = steps + F.when(rank >= i, 1 / F.log2(F.lit(i + 1.0))).otherwise(0.0)
    return steps


def rank_quality(
    df: DataFrame, by: str, score: str, target: str, k: int = 3, min_n: int = 3, blocks: int | None = None
) -> DataFrame:
    """Per key: Spearman of score and target, and NDCG@k with tied scores averaged.

    Keys with few rows or a constant target are left out.
    """
    key = [by]
    size = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(target).alias("_lo"), F.max(target).alias("_hi")
    ).filter((F.col("n") >= min_n) & (F.col("_lo") < F.col("_hi")))
    rows = join_keys(df, size, key).withColumn("_gain", (F.col(target) - F.col("_lo")).cast("double"))

    by_score = rows.groupBy(by, (-F.col(score)).alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_gain").alias("_g")
    )
    got = prefix_scan(by_score, key, ["_s"], sums={"_end": F.col("_n")}, blocks=blocks)
    by_gain = rows.groupBy(by, (-F.col("_gain")).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    ideal = prefix_scan(by_gain, key, ["_s"], sums={"_end": F.col("_n")}, blocks=blocks).withColumn("_g", -F.col("_s"))

    def dcg(t: DataFrame, out: str) -> DataFrame:
        span = _discount(F.col("_end"), k) - _discount(F.col("_end") - F.col("_n"), k)
        return t.groupBy(by).agg(F.sum(F.col("_g") * span).alias(out))

    ndcg = join_keys(dcg(got, "_dcg"), dcg(ideal, "_idcg"), key)
    rho = spearman(rows, score, target, key, blocks)
    return join_keys(join_keys(size.select(by, "n"), ndcg, key), rho, key, "left").select(
        by, "n", "spearman", (F.col("_dcg") / F.col("_idcg")).alias(f"ndcg_{k}")
    )


def rank_quality_summary(per_key: DataFrame, k: int = 3) -> DataFrame:
    return per_key.agg(
        F.avg("spearman").alias("spearman"), F.avg(f"ndcg_{k}").alias(f"ndcg_{k}"), F.count("spearman").alias("keys")
    )


def fame_leak(df: DataFrame, labels: Sequence[str], size: str, blocks: int | None = None) -> DataFrame:
    """How well author size alone separates each candidate label: max(AUC, 1 - AUC)."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in labels)
    tall = df.selectExpr(size, f"stack({len(labels)}, {pairs}) AS (label, _y)")
    auc = rank_metrics(tall, "_y", size, ["label"], blocks)
    return auc.select("label", F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc")).alias("leak"))


def early_window(df: DataFrame, y: str, by_day: Mapping[int, str], final: int, blocks: int | None = None) -> DataFrame:
    """AUC of the value known on each day, and its share of the final day's separation."""
    pairs = ", ".join(f"{d}, CAST(`{c}` AS DOUBLE)" for d, c in by_day.items())
    tall = df.selectExpr(y, f"stack({len(by_day)}, {pairs}) AS (day, value)").fillna(0.0, ["value"])
    auc = rank_metrics(tall, y, "value", ["day"], blocks).select("day", "roc_auc")
    last = auc.filter(F.col("day") == final).select(F.col("roc_auc").alias("_last"))
    return with_one_row(auc, last).select(
        "day", "roc_auc", ((F.col("roc_auc") - 0.5) / (F.col("_last") - 0.5)).alias("share_of_final")
    )


def paired_cosine(df: DataFrame, a: str, b: str, out: str = "cosine") -> DataFrame:
    return df.withColumn(out, cosine(as_double(a), as_double(b)))


def paired_difference(df: DataFrame, a: str, b: str, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """Median and 90 % quantile of the absolute difference of two scores, over the rows that have both."""
    gap = df.withColumn("_dp", F.abs(F.col(a) - F.col(b)))
    return exact_quantiles(gap, by, "_dp", {"abs_dp_median": 0.5, "abs_dp_p90": 0.9}, blocks, n_out="n")


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal labels, and how many rows have both, one or none of the two."""
    x, y = F.col(a), F.col(b)
    both = x.isNotNull() & y.isNotNull()

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("bigint"))

    return df.agg(
        F.avg(F.when(both, (x == y).cast("double"))).alias("agree"),
        n(both).alias("both"),
        n(x.isNotNull() & y.isNull()).alias("only_first"),
        n(x.isNull() & y.isNotNull()).alias("only_second"),
        n(x.isNull() & y.isNull()).alias("neither"),
    )
