"""Three-way decisions: bands, thresholds, delete policy and conformal sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.constants import CONFORMAL_ALPHA, PRECISION_TARGET
from tidemark.operators.joins import with_one_row
from tidemark.operators.metrics import ranked_scores, score_table
from tidemark.operators.scan import exact_quantiles, prefix_scan

DECISIONS = ("Post", "Unsure", "Do not post")


def sweep(df: DataFrame, y: str, p: str, candidates: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """Counts on both sides of every threshold ``t``: ``n_ge, pos_ge`` for p >= t, ``n_lt, pos_lt`` for p < t.

    ``candidates`` is a one-column table of thresholds ``t``; by default every distinct score.
    Thresholds and scores are merged into one ordered stream, so nothing is compared pairwise.
    """
    scores = score_table(df, y, p)
    marks = scores.select(F.col("p").alias("t")) if candidates is None else candidates.select("t").distinct()
    stream = scores.select("p", F.lit(1).alias("_side"), "pos", "neg").unionByName(
        marks.select(F.col("t").alias("p"), F.lit(0).alias("_side"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    )
    run = prefix_scan(
        stream, [], ["p", "_side"], sums={"pos_lt": F.col("pos"), "neg_lt": F.col("neg")},
        totals={"all_pos": F.col("pos"), "all_neg": F.col("neg")}, blocks=blocks,
    )
    return run.filter("_side = 0").select(
        F.col("p").alias("t"),
        (F.col("all_pos") + F.col("all_neg") - F.col("pos_lt") - F.col("neg_lt")).alias("n_ge"),
        (F.col("all_pos") - F.col("pos_lt")).alias("pos_ge"),
        (F.col("pos_lt") + F.col("neg_lt")).alias("n_lt"),
        "pos_lt", "all_pos", "all_neg",
    )


def decision_bands(
    df: DataFrame, y: str, p: str, target: float = PRECISION_TARGET, min_cov: float = 0.05, digits: int = 4,
    blocks: int | None = None,
) -> DataFrame:
    """One row ``t_low, t_high``: the lowest threshold precise enough for Post, the highest for Do not post.

    Candidates are the scores rounded to ``digits``; each side needs max(min_cov * n, 20) rows.
    An unreachable side falls back to the 0.80 / 0.20 quantile, crossed bands to both.
    """
    cands = df.filter(F.col(p).isNotNull()).select(F.round(p, digits).alias("t"))
    s = sweep(df, y, p, cands, blocks)
    floor = F.greatest(F.lit(min_cov) * (F.col("all_pos") + F.col("all_neg")), F.lit(20.0))
    high = (F.col("n_ge") >= floor) & (F.col("pos_ge") / F.col("n_ge") >= target)
    low = (F.col("n_lt") >= floor) & (1 - F.col("pos_lt") / F.col("n_lt") >= target)
    found = s.agg(F.min(F.when(high, F.col("t"))).alias("_h"), F.max(F.when(low, F.col("t"))).alias("_l"))
    qs = exact_quantiles(df.select(p), [], p, {"_q20": 0.2, "_q80": 0.8}, blocks)
    both = with_one_row(found, qs).select(
        F.coalesce("_l", "_q20").alias("_l"), F.coalesce("_h", "_q80").alias("_h"), "_q20", "_q80"
    )
    crossed = F.col("_l") > F.col("_h")
    return both.select(
        F.round(F.when(crossed, F.col("_q20")).otherwise(F.col("_l")), 4).alias("t_low"),
        F.round(F.when(crossed, F.col("_q80")).otherwise(F.col("_h")), 4).alias("t_high"),
    )


def supported_thresholds(
    df: DataFrame, y: str, p: str, target: float = PRECISION_TARGET, min_rec: float = 0.05, min_n: int = 20,
    margin: float = 0.05, blocks: int | None = None,
) -> DataFrame:
    """Thresholds with precision, recall and support floors, a margin around one half, and a ``reached`` flag.

    Of the thresholds that qualify the one with most recall wins. Weak signal falls back to the
    0.35 / 0.65 quantiles.
    """
    scores = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
    s = sweep(scores, y, p, blocks=blocks)
    hit = s.filter(
        (F.col("pos_ge") / F.col("n_ge") >= target)
        & (F.col("pos_ge") / F.greatest(F.col("all_pos"), F.lit(1.0)) >= min_rec)
        & (F.col("n_ge") >= min_n)
    ).agg(F.min("t").alias("_h"))
    # Do-not-post side: p <= t is the upper tail of 1 - p.
    r = ranked_scores(score_table(scores, y, p), blocks=blocks)
    size = F.col("cpos") + F.col("cneg")
    miss = r.filter(
        (F.col("cneg") / size >= target)
        & (F.col("cneg") / F.greatest(F.col("all_neg"), F.lit(1.0)) >= min_rec)
        & (size >= min_n)
    ).agg(F.max("p").alias("_l"))
    qs = exact_quantiles(scores.select(p), [], p, {"_q35": 0.35, "_q65": 0.65}, blocks)
    one = with_one_row(with_one_row(hit, miss), qs)
    ok = (F.col("_l") > 0) & (F.col("_l") < F.col("_h")) & (F.col("_h") < 1)
    okq = (F.col("_q35") > 0) & (F.col("_q35") < F.col("_q65")) & (F.col("_q65") < 1)

    def pick(own: str, fallback: str, last: float) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), F.col(own)).when(okq, F.col(fallback)).otherwise(last)

    bands = one.select(
        F.least(pick("_l", "_q35", 0.45), F.lit(0.5 - margin)).alias("t_low"),
        F.greatest(pick("_h", "_q65", 0.55), F.lit(0.5 + margin)).alias("t_high"),
    )
    tails = with_one_row(scores, bands).groupBy("t_low", "t_high").agg(
        F.sum((F.col(p) >= F.col("t_high")).cast("bigint")).alias("_nh"),
        F.avg(F.when(F.col(p) >= F.col("t_high"), F.col(y).cast("double"))).alias("_ph"),
        F.sum((F.col(p) <= F.col("t_low")).cast("bigint")).alias("_nl"),
        F.avg(F.when(F.col(p) <= F.col("t_low"), 1 - F.col(y).cast("double"))).alias("_pl"),
    )
    reached = (F.col("_nh") >= min_n) & (F.col("_ph") >= target) & (F.col("_nl") >= min_n) & (F.col("_pl") >= target)
    return tails.select("t_low", "t_high", F.coalesce(reached.cast("int"), F.lit(0)).alias("reached"))


def apply_bands(df: DataFrame, p: str, bands: DataFrame, out: str = "decision") -> DataFrame:
    """Post at or above ``t_high``, Do not post below ``t_low``, else Unsure."""
    d = F.when(F.col(p) >= F.col("t_high"), "Post").when(F.col(p) < F.col("t_low"), "Do not post").otherwise("Unsure")
    return with_one_row(df, bands.select("t_low", "t_high")).withColumn(out, d).drop("t_low", "t_high")


def band_report(df: DataFrame, y: str, p: str, bands: DataFrame) -> DataFrame:
    """Coverage, size and base rate per decision; decisions never taken show zero rows."""
    sizes = apply_bands(df, p, bands).groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("base_rate")
    )
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    labels = df.sparkSession.createDataFrame([(d,) for d in DECISIONS], "decision string")
    return with_one_row(labels.join(sizes, "decision", "left"), total).select(
        "decision",
        F.coalesce("n", F.lit(0)).alias("n"),
        (F.coalesce("n", F.lit(0)) / F.col("_all")).alias("coverage"),
        "base_rate",
    )


def cost_bands(df: DataFrame, ratio: str, bands: DataFrame) -> DataFrame:
    """Bands from a cost ratio r: Post from r / (1 + r); an unusable ratio keeps the stored bands."""
    r = F.col(ratio).try_cast("double")
    usable = F.coalesce(r > 0, F.lit(False))
    high = r / (1 + r)
    low = F.greatest(F.least(F.col("t_low"), high - 0.05), F.lit(0.01))
    return with_one_row(df, bands.select("t_low", "t_high")).withColumns(
        {
            "cost_t_high": F.when(usable, F.round(high, 4)).otherwise(F.col("t_high")),
            "cost_t_low": F.when(usable, F.round(low, 4)).otherwise(F.col("t_low")),
        }
    ).drop("t_low", "t_high")


def keep_delete(df: DataFrame, y: str, p: str, targets: Sequence[float], blocks: int | None = None) -> DataFrame:
    """Per target: the largest set of lowest scores whose share of duds reaches it, and the hits it loses.

    Rows with equal scores are deleted together, so the policy is a threshold on the score.
    """
    runs = ranked_scores(score_table(df, y, p), blocks=blocks)
    size = F.col("cpos") + F.col("cneg")
    best = runs.agg(
        *[F.max(F.when(F.col("cneg") / size >= t, F.struct(size.alias("k"), F.col("cpos").alias("lost"), F.col("p")))).alias(f"_b{i}")
          for i, t in enumerate(targets)],
        F.max("all_pos").alias("_P"), F.max(F.col("all_pos") + F.col("all_neg")).alias("_n"),
    )
    cells = ", ".join(f"CAST({t} AS DOUBLE), _b{i}" for i, t in enumerate(targets))
    tall = best.selectExpr("_P", "_n", f"stack({len(targets)}, {cells}) AS (target, _b)")
    k, lost = F.coalesce("_b.k", F.lit(0.0)), F.coalesce("_b.lost", F.lit(0.0))
    return tall.select(
        "target", k.cast("bigint").alias("deleted"), (k / F.col("_n")).alias("deleted_share"),
        lost.cast("bigint").alias("hits_lost"), F.when(F.col("_P") > 0, lost / F.col("_P")).alias("hits_lost_share"),
        F.col("_b.p").alias("threshold"),
    )


def verdict(p: str, t_low: Column) -> Column:
    return F.when(F.col(p) <= t_low, "Delete").otherwise("Keep")


def f1_threshold(df: DataFrame, y: str, p: str, blocks: int | None = None) -> DataFrame:
    """The threshold of the grid 0.05 … 0.95 with the best F1 of the positive class; the lowest on ties."""
    grid = df.sparkSession.range(181).select(F.round(F.lit(0.05) + F.col("id") * 0.005, 3).alias("t"))
    s = sweep(df, y, p, grid, blocks)
    f1 = F.when(F.col("n_ge") + F.col("all_pos") > 0, 2 * F.col("pos_ge") / (F.col("n_ge") + F.col("all_pos"))).otherwise(0.0)
    scored = s.withColumn("f1", f1)
    best = scored.agg(F.max(F.struct("f1", (-F.col("t")).alias("nt"))).alias("_b"))
    return best.select((-F.col("_b.nt")).alias("t"), F.col("_b.f1").alias("f1"))


def conformal_fit(
    df: DataFrame, y: str, p: str, alpha: float = CONFORMAL_ALPHA, by_class: bool = True, blocks: int | None = None
) -> DataFrame:
    """One row ``q0, q1``: the calibrated nonconformity limit per class (equal when not ``by_class``).

    The limit is the order statistic at ceil(level * (n - 1)), level = min(1, ceil((n + 1)(1 - alpha)) / n).
    """
    own = F.when(F.col(y) == 1, 1 - F.col(p)).otherwise(F.col(p))
    key = F.col(y) if by_class else F.lit(0)
    counts = (
        df.filter(F.col(p).isNotNull() & F.col(y).isNotNull())
        .groupBy(key.cast("int").alias("_k"), own.alias("_s"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    runs = prefix_scan(counts, ["_k"], ["_s"], sums={"_cum": F.col("_n")}, totals={"_all": F.col("_n")}, blocks=blocks)
    level = F.least(F.lit(1.0), F.ceil((F.col("_all") + 1) * F.lit(1 - alpha)) / F.col("_all"))
    place = F.ceil(level * (F.col("_all") - 1)) + 1
    limits = runs.filter(F.col("_cum") >= place).groupBy("_k").agg(F.min("_s").alias("_q"))

    def q(k: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_k") == (k if by_class else 0), F.col("_q"))), F.lit(1.0)).alias(f"q{k}")

    return limits.agg(q(0), q(1))


def conformal_sets(df: DataFrame, p: str, limits: DataFrame) -> DataFrame:
    """Prediction set as text and the decision it implies; only one-class sets decide."""
    in0, in1 = F.col(p) <= F.col("q0"), (1 - F.col(p)) <= F.col("q1")
    name = F.concat(F.lit("{"), F.concat_ws(",", F.when(in0, "0"), F.when(in1, "1")), F.lit("}"))
    decision = F.when(in1 & ~in0, "Post").when(in0 & ~in1, "Do not post").otherwise("Unsure")
    return with_one_row(df, limits).withColumns({"pred_set": name, "decision": decision}).drop("q0", "q1")


def conformal_coverage(sets: DataFrame, y: str) -> DataFrame:
    """Empirical coverage, overall and per class, and the share of abstentions."""
    inside = F.contains(F.col("pred_set"), F.col(y).cast("int").cast("string")).cast("double")
    return sets.agg(
        F.avg(inside).alias("coverage"),
        F.avg(F.when(F.col(y) == 0, inside)).alias("coverage_0"),
        F.avg(F.when(F.col(y) == 1, inside)).alias("coverage_1"),
        F.avg((F.col("decision") == "Unsure").cast("double")).alias("abstain"),
        F.count(F.lit(1)).alias("n"),
    )
