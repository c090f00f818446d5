"""Rule score: weighted predicates over caption, duration and time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import sigmoid

# Rule name, condition, weight.
RULES = (
    ("question hook", "has_question = 1", 0.30),
    ("call-to-action", "has_cta = 1", 0.25),
    ("3-5 hashtags (niche)", "n_hashtags BETWEEN 3 AND 6", 0.20),
    ("no hashtags", "n_hashtags = 0", -0.20),
    ("hashtag spam (>10)", "n_hashtags > 10", -0.25),
    ("watchable duration 7-30s", "duration_s BETWEEN 7 AND 30", 0.25),
    ("too long (>90s)", "duration_s > 90", -0.25),
    ("caption length 20-150", "char_len BETWEEN 20 AND 150", 0.15),
    ("empty caption", "caption_is_empty = 1", -0.35),
    ("moderate emoji 1-5", "n_emoji BETWEEN 1 AND 5", 0.10),
    ("ALL-CAPS spam", "allcaps_ratio > 0.5", -0.20),
    ("off-platform URL", "has_url = 1", -0.20),
    ("evening/weekend post", "is_weekend = 1", 0.05),
)


def rule_score(df: DataFrame, rules=RULES, out: str = "rule_score") -> DataFrame:
    """Sigmoid of the weights of the rules that hold, and those rules by descending weight size."""
    total: Column = F.lit(0.0)
    fired = []
    for pos, (name, cond, weight) in enumerate(rules):
        holds = F.coalesce(F.expr(cond), F.lit(False))
        total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        fired.append(
            F.when(
                holds,
                F.struct((-F.lit(abs(weight))).alias("key"), F.lit(pos).alias("pos"), F.lit(name).alias("rule"),
                         F.lit(weight).alias("weight")),
            )
        )
    hits = F.array_sort(F.filter(F.array(*fired), lambda r: r.isNotNull()))
    return df.withColumns(
        {out: sigmoid(total), "fired": F.transform(hits, lambda r: F.struct(r["rule"], r["weight"]))}
    )
