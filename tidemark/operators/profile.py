"""Profiling: shares, concentration, quantiles, missingness, histograms, trajectories, derived constants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import with_one_row
from tidemark.operators.panel import latest_at_many, null_skipping_sum
from tidemark.operators.scan import exact_quantiles, quantile_table


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def top_share(df: DataFrame, col: str, top: int) -> DataFrame:
    """Distinct values, rows, and the share of rows held by the ``top`` most used values."""
    counts = value_counts(df.filter(F.col(col).isNotNull()), col)
    head = counts.orderBy(F.col("n").desc(), col).limit(top).agg(F.sum("n").alias("_top"))
    whole = counts.agg(F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("rows"))
    return with_one_row(whole, head).select("distinct_values", "rows", (F.col("_top") / F.col("rows")).alias("top_share"))


def concentration(df: DataFrame, by: str, value: str, floors: Sequence[int] = (2, 3, 5, 10)) -> DataFrame:
    """Row share of the largest key, value share of the five largest, and rows covered by keys of a minimum size."""
    per = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"))
    top5 = per.orderBy(F.col("v").desc(), by).limit(5).agg(F.sum("v").alias("_top"))
    cover = [F.sum(F.when(F.col("n") >= k, F.col("n")).otherwise(0)).alias(f"_c{k}") for k in floors]
    keys = [F.sum((F.col("n") >= k).cast("bigint")).alias(f"keys_ge_{k}") for k in floors]
    whole = per.agg(F.max("n").alias("_max"), F.sum("n").alias("_n"), F.sum("v").alias("_v"), *cover, *keys)
    return with_one_row(whole, top5).select(
        (F.col("_max") / F.col("_n")).alias("largest_row_share"),
        (F.col("_top") / F.col("_v")).alias("top5_value_share"),
        *[f"keys_ge_{k}" for k in floors],
        *[(F.col(f"_c{k}") / F.col("_n")).alias(f"rows_ge_{k}") for k in floors],
    )


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, minimum, median, p90, p99 and maximum per column, one row each."""
    names = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    qs = quantile_table(df, [], {f"{c}__{n}": (c, q) for c in cols for n, q in names.items()})
    stats = df.agg(
        *[e for c in cols for e in (F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__mean"),
                                    F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max"))]
    )
    fields = ["n", "mean", "min", "median", "p90", "p99", "max"]
    cells = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{f}`" for f in fields) for c in cols)
    return with_one_row(stats, qs).selectExpr(f"stack({len(cols)}, {cells}) AS (col, {', '.join(fields)})")


def missingness(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of null values per column; blank text counts as missing."""
    kinds = dict(df.dtypes)

    def absent(c: str) -> Column:
        gone = F.col(c).isNull()
        return gone | (F.trim(F.col(c)) == "") if kinds[c] == "string" else gone

    one = df.agg(*[F.avg(F.coalesce(absent(c), F.lit(True)).cast("double")).alias(c) for c in cols])
    cells = ", ".join(f"'{c}', `{c}`" for c in cols)
    return one.selectExpr(f"stack({len(cols)}, {cells}) AS (col, missing_share)")


def eta_squared(df: DataFrame, value: str, by: str) -> DataFrame:
    """Between-group share of the total sum of squares, from per-group moments."""
    per = df.filter(F.col(value).isNotNull()).groupBy(by).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    overall = per.agg(
        F.sum("_n").alias("_total"), (F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")).alias("_mean")
    )
    dev = F.col("_n") * F.pow(F.col("_m") - F.col("_mean"), 2)
    inside = F.col("_n") * F.col("_v")
    return with_one_row(per, overall).agg((F.sum(dev) / F.sum(dev + inside)).alias("eta_squared"))


def histogram(df: DataFrame, value: Column, bins: int, cap: float | None = None) -> DataFrame:
    """Equal-width bins between minimum and maximum, clipped first at quantile ``cap`` when given."""
    x = df.select(value.cast("double").alias("_x")).filter("_x IS NOT NULL")
    if cap is not None:
        top = exact_quantiles(x, [], "_x", {"_cap": cap})
        x = with_one_row(x, top).select(F.least("_x", "_cap").alias("_x"))
    span = x.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return with_one_row(x, span).groupBy(place.cast("bigint").alias("bin"), "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("n")
    ).select("bin", "n", (F.col("_lo") + F.col("bin") * width).alias("left_edge"))


def trajectory(panel: DataFrame, day: str, value: str) -> DataFrame:
    """Mean and median counter by age."""
    mean = panel.groupBy(day).agg(F.avg(value).alias("mean"))
    return mean.join(exact_quantiles(panel, [day], value, {"median": 0.5}, n_out="n"), day)


def median_ratio(panel: DataFrame, key: str, day: str, value: str, early: int, late: int) -> DataFrame:
    """Median over items of the early counter divided by the late one."""
    wide = latest_at_many(panel, key, day, value, [early, late])
    r = F.when(F.col(f"{value}_{late}") > 0, F.col(f"{value}_{early}") / F.col(f"{value}_{late}"))
    return exact_quantiles(wide.select(r.alias("_r")), [], "_r", {"median_ratio": 0.5}, n_out="n")


def counts_by_period(df: DataFrame, ts: str, unit: str) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, F.col(ts)).cast("date").cast("string").alias("period")).agg(
        F.count(F.lit(1)).alias("n")
    )


def horizon_choice(
    panel: DataFrame, key: str, author: str, day: str, value: str, engaged: Sequence[str], grid: Sequence[int],
    base: int, need: float = 0.95,
) -> DataFrame:
    """Per horizon: coverage, median share of the final counter, agreement (kappa) with the base horizon's
    own-norm label, and whether it is the smallest that qualifies. ``panel`` carries the author.
    """
    inside = {h: F.when(F.col(day) <= h, F.col(day)) for h in grid}
    state = F.struct(value, null_skipping_sum(engaged).alias("eng"))
    wide = panel.groupBy(key, author).agg(
        F.max(day).alias("_last"),
        F.max_by(value, day).alias("_final"),
        *[F.max_by(state, inside[h]).alias(f"_s{h}") for h in grid],
    )

    def er(h: int) -> Column:
        s = F.col(f"_s{h}")
        return F.when(s.isNotNull(), s["eng"] / F.greatest(s[value], F.lit(1.0)))

    rates = wide.withColumns({f"_er{h}": er(h) for h in grid} | {
        f"_ratio{h}": F.when(F.col("_last") >= h, F.col(f"_s{h}")[value] / F.greatest("_final", F.lit(1.0))) for h in grid
    })
    meds = quantile_table(rates, [author], {f"_med{h}": (f"_er{h}", 0.5) for h in grid})
    labelled = rates.join(meds, author).withColumns(
        {f"_y{h}": F.when(F.col(f"_er{h}").isNotNull(), (F.col(f"_er{h}") > F.col(f"_med{h}")).cast("int")) for h in grid}
    )
    ratio = quantile_table(rates, [], {f"_q{h}": (f"_ratio{h}", 0.5) for h in grid})
    known = F.col(f"_y{base}").isNotNull()

    def kappa(h: int) -> Column:
        a, b = F.coalesce(F.col(f"_y{h}"), F.lit(0)), F.col(f"_y{base}")
        share = lambda c: F.avg(F.when(known, c.cast("double")))
        agree, pa, pb = share(a == b), share(a), share(b)
        chance = pa * pb + (1 - pa) * (1 - pb)
        return F.when(chance < 1, (agree - chance) / (1 - chance)).otherwise(1.0)

    one = labelled.agg(
        *[F.avg((F.col("_last") >= h).cast("double")).alias(f"_cov{h}") for h in grid],
        *[kappa(h).alias(f"_k{h}") for h in grid],
    )
    cells = ", ".join(f"{h}, _cov{h}, _q{h}, _k{h}" for h in grid)
    tall = with_one_row(one, ratio).selectExpr(f"stack({len(grid)}, {cells}) AS (horizon, coverage, median_ratio, kappa)")
    good = (F.col("coverage") >= need) & (F.col("median_ratio") >= need)
    pick = tall.agg(F.min(F.when(good, F.col("horizon"))).alias("_h"))
    return with_one_row(tall, pick).withColumn(
        "chosen", F.coalesce((F.col("horizon") == F.col("_h")).cast("int"), F.lit(0))
    ).drop("_h")


def first_day_window(wide: DataFrame, first: str, early: str, late: str) -> DataFrame:
    """Coverage of day 0 and day 1, and the log-log correlation of the early with the late counter.

    ``wide`` has one row per item: first observed day, early counter and late counter.
    """
    return wide.agg(
        F.avg((F.col(first) <= 0).cast("double")).alias("coverage_d0"),
        F.avg((F.col(first) <= 1).cast("double")).alias("coverage_d1"),
        F.corr(F.log1p(early), F.log1p(late)).alias("log_corr"),
    )


def view_floors(df: DataFrame, views: str, er: str, floors: Sequence[int] = (0, 50, 100, 200, 500)) -> DataFrame:
    """Share of items kept and of engagement rates above one at each floor on views."""
    one = df.agg(
        *[F.avg((F.col(views) >= f).cast("double")).alias(f"_k{f}") for f in floors],
        *[F.avg(F.when(F.col(views) >= f, (F.col(er) > 1).cast("double"))).alias(f"_g{f}") for f in floors],
    )
    cells = ", ".join(f"{f}, _k{f}, _g{f}" for f in floors)
    return one.selectExpr(f"stack({len(floors)}, {cells}) AS (floor, kept, er_above_one)")


def compare_tables(
    tables: Mapping[str, DataFrame], dims: Mapping[str, str], medians: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per dimension, one column per table.

    ``dims`` maps a name to an aggregate expression, ``medians`` a name to a column.
    """
    medians = dict(medians or {})
    names = [*dims, *medians]
    out = None
    for name, df in tables.items():
        one = df.agg(*[F.expr(e).cast("double").alias(f"_{i}") for i, e in enumerate(dims.values())])
        if medians:
            specs = {f"_{len(dims) + i}": (c, 0.5) for i, c in enumerate(medians.values())}
            one = with_one_row(one, quantile_table(df, [], specs))
        cells = ", ".join(f"'{d}', _{i}" for i, d in enumerate(names))
        tall = one.selectExpr(f"stack({len(names)}, {cells}) AS (dimension, `{name}`)")
        out = tall if out is None else out.join(tall, "dimension")
    return out


def ordered_values(panel: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """The counter values of an item in day order (a bounded list: one entry per day)."""
    pairs = F.sort_array(F.collect_list(F.struct(day, value)))
    return panel.groupBy(key).agg(F.transform(pairs, lambda p: p[value]).alias("values"))


def distinct_per_group(df: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values per key, de-duplicated in parallel before they are counted."""
    return df.select(by, value).filter(F.col(value).isNotNull()).distinct().groupBy(by).agg(
        F.count(F.lit(1)).alias("distinct_values")
    )


def growth_grid(
    panel: DataFrame, key: str, day: str, value: str, target_day: int, max_day: int,
    t0_grid: Sequence[float], b_grid: Sequence[float],
) -> DataFrame:
    """Value at ``target_day`` extrapolated by the best log-logistic curve A / (1 + (t0 / t)^b) of a grid.

    For fixed (t0, b) the least-squares A is a ratio of two sums, clipped to [last, 50 * last + 10].
    Every panel row adds its terms for all curves of the small grid, so one aggregation per item
    fits them all. Items with fewer than three points, or no positive value, keep the last value.
    """
    curves = [(t0, b) for t0 in t0_grid for b in b_grid]
    t = F.col(day) + 1.0
    seen = panel.filter(F.col(day) <= max_day)
    shape = [1.0 / (1.0 + F.pow(F.lit(t0) / t, F.lit(b))) for t0, b in curves]
    sums = [e for i, s in enumerate(shape) for e in (F.sum(F.col(value) * s).alias(f"_vs{i}"), F.sum(s * s).alias(f"_ss{i}"))]
    per = seen.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.max(value).alias("_mx"), F.max_by(value, day).alias("_lastv"),
        F.sum(F.col(value) * F.col(value)).alias("_vv"), *sums,
    )
    fits = []
    for i, (t0, b) in enumerate(curves):
        a = F.greatest(F.col("_lastv"), F.least(F.col(f"_vs{i}") / F.col(f"_ss{i}"), F.col("_lastv") * 50 + 10))
        sse = F.col("_vv") - 2 * a * F.col(f"_vs{i}") + a * a * F.col(f"_ss{i}")
        at = a / (1.0 + F.pow(F.lit(t0 / (target_day + 1.0)), F.lit(b)))
        fits.append(F.struct(F.round(sse, 6).alias("sse"), F.lit(i).alias("curve"), at.alias("at")))
    best = F.array_min(F.array(*fits))
    ok = (F.col("_n") >= 3) & (F.col("_mx") > 0)
    return per.select(
        key, F.col("_n").alias("points"), F.col("_lastv").alias("last_value"),
        F.when(ok, best["at"]).otherwise(F.col("_lastv")).alias("predicted"),
        F.when(ok, best["curve"]).otherwise(-1).alias("curve"),
    )


def _curve(t: Column, t0: Column, b: Column) -> Column:
    return 1.0 / (1.0 + F.pow(t0 / t, b))


def growth_curves(
    panel: DataFrame, key: str, day: str, value: str, target_day: int, max_day: int, t0_grid: Sequence[float], b_grid: Sequence[float], rounds: int = 3
) -> DataFrame:
    """Log-logistic growth A / (1 + (t0 / t)^b) fitted per item from coarse to fine, and how well it predicts later days.

    An item's points up to ``max_day`` are one short array (a panel has at most a month of days). The best pair of the
    coarse grid is refined ``rounds`` times: nine pairs around it, each round half as far apart. For a pair the
    least-squares A is a ratio of two sums, clipped to [last, 50 * last + 10]. Items with fewer than three points,
    or no positive value, keep the last value. ``error`` and ``last_error`` are the mean absolute errors of the
    curve and of the last value on the days after ``max_day``, null where there are none.
    """
    point = F.struct((F.col(day) + 1.0).alias("t"), F.col(value).cast("double").alias("v"))
    per = panel.filter(F.col(value).isNotNull() & (F.col(day) <= target_day)).groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col(day) <= max_day, point))).alias("_p"),
        F.sort_array(F.collect_list(F.when(F.col(day) > max_day, point))).alias("_later"),
    )
    per = per.filter(F.size("_p") > 0).withColumn("_last", F.element_at("_p", -1)["v"])

    def total(points: Column, of) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + of(p))

    def best(t0s: list[Column], bs: list[Column]) -> Column:
        """The pair of least squared error, the first of equal ones, with its A."""
        pairs = F.array(*[F.struct(F.lit(i).alias("i"), a.alias("t0"), b.alias("b")) for i, (a, b) in enumerate((a, b) for a in t0s for b in bs)])

        def fitted(c: Column) -> Column:
            shape = lambda p: _curve(p["t"], c["t0"], c["b"])
            a = total(F.col("_p"), lambda p: p["v"] * shape(p)) / total(F.col("_p"), lambda p: shape(p) * shape(p))
            return F.struct(c["i"].alias("i"), c["t0"].alias("t0"), c["b"].alias("b"), F.greatest("_last", F.least(a, F.col("_last") * 50 + 10)).alias("a"))

        def scored(c: Column) -> Column:
            sse = total(F.col("_p"), lambda p: F.pow(p["v"] - c["a"] * _curve(p["t"], c["t0"], c["b"]), F.lit(2.0)))
            return F.struct(F.round(sse, 6).alias("sse"), c["i"].alias("i"), c["t0"].alias("t0"), c["b"].alias("b"), c["a"].alias("a"))

        return F.array_min(F.transform(F.transform(pairs, fitted), scored))

    per = per.withColumn("_f", best([F.lit(float(x)) for x in t0_grid], [F.lit(float(x)) for x in b_grid]))
    for r in range(rounds):
        ratio, step = 2.0 ** (0.5**r), 0.5 ** (r + 1)
        t0s = [F.col("_f.t0") * (1 / ratio), F.col("_f.t0"), F.col("_f.t0") * ratio]
        per = per.withColumn("_f", best(t0s, [F.greatest(F.col("_f.b") + s, F.lit(0.05)) for s in (-step, 0.0, step)]))
    ok = (F.size("_p") >= 3) & (F.array_max(F.transform("_p", lambda p: p["v"])) > 0)
    at = lambda t: F.when(ok, F.col("_f.a") * _curve(t, F.col("_f.t0"), F.col("_f.b"))).otherwise(F.col("_last"))
    off = lambda of: F.when(F.size("_later") > 0, total(F.col("_later"), lambda p: F.abs(of(p["t"]) - p["v"])) / F.size("_later"))
    return per.select(
        key, F.size("_p").alias("points"), F.col("_last").alias("last_value"), F.when(ok, F.col("_f.t0")).alias("t0"), F.when(ok, F.col("_f.b")).alias("b"),
        at(F.lit(target_day + 1.0)).alias("predicted"), off(at).alias("error"), off(lambda t: F.col("_last")).alias("last_error"),
    )


def baseline_median(items: DataFrame, by: str, ts: str, value: str, last: int = 15, need: int = 5) -> DataFrame:
    """Median of the non-null values among each key's newest ``last`` items; too few gives no row.

    The newest items are kept by a bounded top-n aggregate in two steps, so hot keys are reduced
    inside the first one.
    """
    newest = lambda c: F.slice(F.sort_array(c, asc=False), 1, last)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64(ts, value), F.lit(64)))
    w = Window.partitionBy(by, "_salt").orderBy(F.col(ts).desc())
    local = salted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last)
    top = local.groupBy(by).agg(newest(F.collect_list(F.struct(ts, F.col(value).alias("v")))).alias("_r"))
    tall = top.select(by, F.explode("_r").alias("_e")).select(by, F.col("_e.v").alias("_v")).filter("_v IS NOT NULL")
    return tall.groupBy(by).agg(
        F.percentile("_v", F.lit(0.5)).alias("median_value"), F.count(F.lit(1)).alias("n")
    ).filter(F.col("n") >= need)


def population_stability(base: DataFrame, now: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """PSI between two samples over the base's quantile buckets."""
    specs = {f"_e{i}": (value, i / parts) for i in range(1, parts)}
    edges = quantile_table(base.select(value), [], specs).select(
        F.array_distinct(F.array(*[F.col(c) for c in specs])).alias("_edges")
    )
    both = base.select(value, F.lit(0).alias("_now")).unionByName(now.select(value, F.lit(1).alias("_now")))
    marked = with_one_row(both.filter(F.col(value).isNotNull()), edges).select(
        "_now", F.size(F.filter("_edges", lambda e: e <= F.col(value))).alias("bucket")
    )
    counts = marked.groupBy("bucket").agg(
        F.sum(1 - F.col("_now")).alias("_e"), F.sum("_now").alias("_a")
    )
    totals = counts.agg(F.sum("_e").alias("_all_e"), F.sum("_a").alias("_all_a"))
    e = F.greatest(F.col("_e") / F.col("_all_e"), F.lit(1e-6))
    a = F.greatest(F.col("_a") / F.col("_all_a"), F.lit(1e-6))
    return with_one_row(counts, totals).agg(F.sum((a - e) * F.log(a / e)).alias("psi"))

