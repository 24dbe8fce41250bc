"""Descriptive statistics, tests, correlations and signal audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions import distributions as dist
from shelfsense.operators import ordered
from shelfsense.operators.joins import with_scalar
from shelfsense.operators.quality import union_all
from shelfsense.session import durable

Z95 = dist.NORMAL.inv_cdf(0.975)


def mean_interval(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    c = F.col(column).cast("double")
    half = F.lit(Z95) * F.stddev_samp(c) / F.sqrt(F.count(c))
    return df.groupBy(*keys).agg(
        F.count(c).alias("n"),
        F.avg(c).alias("estimate"),
        (F.avg(c) - half).alias("ci_lower"),
        (F.avg(c) + half).alias("ci_upper"),
    )


def proportion_interval(df: DataFrame, flag: str, keys: Sequence[str] = ()) -> DataFrame:
    p = F.avg(F.col(flag).cast("int"))
    half = F.lit(Z95) * F.sqrt(p * (1 - p) / F.greatest(F.count(flag), F.lit(1)))
    return df.groupBy(*keys).agg(
        F.count(flag).alias("n"), p.alias("estimate"), (p - half).alias("ci_lower"), (p + half).alias("ci_upper")
    )


def _arm(column: Column, arm: Column) -> list[Column]:
    x = F.when(arm, column.cast("double"))
    return [F.count(x), F.avg(x), F.var_samp(x)]


def welch_test(df: DataFrame, value: str, first: Column, second: Column) -> DataFrame:
    """Unequal-variance t statistic of two groups, with its degrees of freedom and p value."""
    n1, m1, v1 = _arm(F.col(value), first)
    n2, m2, v2 = _arm(F.col(value), second)
    r = df.agg(*[c.alias(n) for n, c in zip(["n1", "m1", "v1", "n2", "m2", "v2"], [n1, m1, v1, n2, m2, v2])]).first()
    a, b = r.v1 / r.n1, r.v2 / r.n2
    t = (r.m1 - r.m2) / (a + b) ** 0.5
    dof = (a + b) ** 2 / (a * a / (r.n1 - 1) + b * b / (r.n2 - 1))
    row = (t, dof, dist.student_t_two_sided(t, dof))
    return df.sparkSession.createDataFrame([row], "t_stat double, dof double, p_value double")


def two_proportion_test(df: DataFrame, flag: str, first: Column, second: Column) -> DataFrame:
    """Pooled z test of two response rates."""
    y = F.col(flag).cast("int")
    r = df.agg(
        F.sum(F.when(first, y)).alias("k1"),
        F.count(F.when(first, y)).alias("n1"),
        F.sum(F.when(second, y)).alias("k2"),
        F.count(F.when(second, y)).alias("n2"),
    ).first()
    p1, p2, pool = r.k1 / r.n1, r.k2 / r.n2, (r.k1 + r.k2) / (r.n1 + r.n2)
    z = (p1 - p2) / (pool * (1 - pool) * (1 / r.n1 + 1 / r.n2)) ** 0.5
    row = (p1, p2, p1 - p2, z, dist.normal_two_sided(z))
    return df.sparkSession.createDataFrame([row], "rate_1 double, rate_2 double, effect double, z double, p_value double")


def label_effects(df: DataFrame, labels: Sequence[str], treated: str) -> DataFrame:
    """Effect, unpooled standard error and z per outcome column."""
    cells = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in labels])
    long = df.select(F.col(treated).cast("int").alias("t"), F.inline(cells))
    g = long.groupBy("label").agg(
        F.avg(F.when(F.col("t") == 1, F.col("y"))).alias("treatment"),
        F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("control"),
        F.sum("t").alias("_nt"),
        F.sum(1 - F.col("t")).alias("_nc"),
    )
    rt, rc = F.col("treatment"), F.col("control")
    se = F.sqrt(rt * (1 - rt) / F.col("_nt") + rc * (1 - rc) / F.col("_nc"))
    return g.select(
        "label", "control", "treatment", (rt - rc).alias("effect"), se.alias("se"), F.when(se > 0, (rt - rc) / se).alias("z")
    )


def autocorrelation(series: DataFrame, time: str, value: str, lags: int = 8) -> DataFrame:
    """Autocorrelation of one ordered series (one row per period) at lags 0..n."""
    centred = with_scalar(series, series.agg(F.avg(value).alias("_mean")), "_mean").withColumn(
        "_d", F.col(value) - F.col("_mean")
    )
    w = Window.orderBy(time)
    shifted = centred.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    base = F.sum(F.col("_d") * F.col("_d"))
    one = shifted.agg(F.lit(1.0).alias("0"), *[(F.sum(F.col("_d") * F.col(f"_l{k}")) / base).alias(str(k)) for k in range(1, lags + 1)])
    long = one.unpivot([], [f"`{k}`" for k in range(lags + 1)], "lag", "acf")
    return long.withColumn("lag", F.col("lag").cast("int"))


def beta_posterior(df: DataFrame, flag: str, prior_a: float = 1.0, prior_b: float = 1.0) -> DataFrame:
    r = df.agg(F.sum(F.col(flag).cast("int")).alias("k"), F.count(flag).alias("n")).first()
    a, b = prior_a + (r.k or 0), prior_b + r.n - (r.k or 0)
    row = (a, b, a / (a + b), dist.beta_quantile(0.025, a, b), dist.beta_quantile(0.975, a, b))
    return df.sparkSession.createDataFrame([row], "alpha double, beta double, mean double, ci_lower double, ci_upper double")


# --- correlations ------------------------------------------------------------------------


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlation of every column pair in one aggregation over the rows (no row is copied)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(a).alias("left_col"), F.lit(b).alias("right_col"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return one.select(F.inline(F.array(*rows)))


def _presence_classes(points: DataFrame, width: int) -> list[int]:
    """Per column ``c<i>`` the first column that is NULL in just the same rows (one row is collected)."""
    differ = [
        F.max((F.col(f"c{i}").isNull() != F.col(f"c{j}").isNull()).cast("int")).alias(f"d{i}_{j}")
        for i in range(width)
        for j in range(i)
    ]
    apart = points.agg(*differ).first().asDict() if differ else {}
    return [next((j for j in range(i) if not apart[f"d{i}_{j}"]), i) for i in range(width)]


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], least: int = 2) -> DataFrame:
    """Rank correlation per column pair over the rows where both are present.

    Equal rows are counted first. A column is ranked (average ranks) once per set of rows its
    partners are present in, so columns without NULLs have one rank however many pairs they are
    in; the rows then meet their ranks once, and one aggregate yields all pairs.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    cells = [f"c{i}" for i in range(len(columns))]
    points = durable(
        df.select(*[F.col(c).cast("double").alias(f"c{i}") for c, i in at.items()])
        .groupBy(*cells)
        .agg(F.count("*").alias("n"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    classes = _presence_classes(points, len(columns))
    wanted: list[list[int]] = [[] for _ in columns]
    for a, b in pairs:
        for own, other in ((at[a], at[b]), (at[b], at[a])):
            if classes[other] not in wanted[own]:
                wanted[own].append(classes[other])
    slots = max((len(w) for w in wanted), default=0)
    sums = [f"p{k}" for k in range(slots)]

    def cell(i: int) -> Column:
        present = [F.when(F.col(f"c{j}").isNotNull(), F.col("n")).otherwise(0) for j in wanted[i]]
        present += [F.lit(0).cast("long")] * (slots - len(present))
        return F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("value"), *[v.alias(s) for v, s in zip(present, sums)])

    long = points.select("id", "n", F.inline(F.array(*[cell(i) for i in range(len(columns))]))).filter("value is not null")
    counts = long.groupBy("column", "value").agg(*[F.sum(s).alias(s) for s in sums])
    placed = ordered.positions(counts, ["column"], ["value"], sums={s: s for s in sums}, totals=False)
    ranks = placed.select("column", "value", *[(F.col(f"{s}_before") + (F.col(s) + 1) / 2.0).alias(f"rank_{s}") for s in sums])
    met = long.select("id", "n", "column", "value").join(ranks, ["column", "value"])
    # All cells of a row have its count, so nothing is joined back.
    by_row = met.groupBy("id").agg(
        F.max("n").alias("n"),
        *[
            F.max(F.when(F.col("column") == i, F.col(f"rank_{s}"))).alias(f"r{i}_{j}")
            for i in range(len(columns))
            for s, j in zip(sums, wanted[i])
        ],
    )
    # A rank is NULL where its column is; a pair counts the rows that have both.
    measures = []
    for q, (left, right) in enumerate(pairs):
        a, b = F.col(f"r{at[left]}_{classes[at[right]]}"), F.col(f"r{at[right]}_{classes[at[left]]}")
        n = F.when(a.isNotNull() & b.isNotNull(), F.col("n"))
        sides = {"n": n, "sa": n * a, "sb": n * b, "saa": n * a * a, "sbb": n * b * b, "sab": n * a * b}
        measures += [F.sum(v).alias(f"{k}{q}") for k, v in sides.items()]
    one = by_row.agg(*measures)
    rows = [
        F.struct(
            F.lit(left).alias("left_col"),
            F.lit(right).alias("right_col"),
            *[F.col(f"{k}{q}").alias(k) for k in ("n", "sa", "sb", "saa", "sbb", "sab")],
        )
        for q, (left, right) in enumerate(pairs)
    ]
    m = F.col("n")
    cov = F.col("sab") - F.col("sa") * F.col("sb") / m
    va = F.col("saa") - F.col("sa") * F.col("sa") / m
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / m
    return one.select(F.inline(F.array(*rows))).filter(m >= least).select(
        "left_col",
        "right_col",
        m.alias("n_pairs"),
        F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)).alias("spearman_r"),
    )


def drop_correlated(pairs: DataFrame, columns: Sequence[str], limit: float = 0.90) -> list[str]:
    """Columns to remove: walking the list, a column goes when an earlier kept one correlates."""
    high = {
        (r["left_col"], r["right_col"]) for r in pairs.filter(F.abs("correlation") >= limit).select("left_col", "right_col").collect()
    }
    dropped: list[str] = []
    for i, c in enumerate(columns):
        if any((a, c) in high for a in columns[:i] if a not in dropped):
            dropped.append(c)
    return dropped


# --- balance -----------------------------------------------------------------------------


def balance_numeric(df: DataFrame, columns: Sequence[str], treated: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.col(treated).cast("int").alias("t"), F.inline(cells))
    return _smd(long.withColumn("level", F.lit(None).cast("string")), "numeric")


def _smd(long: DataFrame, kind: str) -> DataFrame:
    t = F.when(F.col("t") == 1, F.col("x"))
    c = F.when(F.col("t") == 0, F.col("x"))
    g = long.groupBy("feature", "level").agg(
        F.avg(c).alias("control_mean"),
        F.avg(t).alias("treatment_mean"),
        ((F.var_samp(t) + F.var_samp(c)) / 2.0).alias("_v"),
    )
    gap = F.col("treatment_mean") - F.col("control_mean")
    return g.select(
        "feature",
        "level",
        F.lit(kind).alias("kind"),
        "control_mean",
        "treatment_mean",
        F.when(F.col("_v") > 0, gap / F.sqrt("_v")).when(F.col("_v") == 0, 0.0).alias("smd"),
    )


def balance_categorical(df: DataFrame, columns: Sequence[str], treated: str) -> DataFrame:
    """Worst level per category column, from level counts per arm."""
    t = F.col(treated).cast("int")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])
    counts = (
        df.select(t.alias("t"), F.inline(cells))
        .groupBy("feature", "level")
        .agg(F.sum("t").alias("kt"), F.sum(1 - F.col("t")).alias("kc"))
    )
    arms = df.agg(F.sum(t).alias("nt"), F.sum(1 - t).alias("nc"))
    c = with_scalar(counts.filter("level is not null"), arms, "nt", "nc")
    pt, pc = F.col("kt") / F.col("nt"), F.col("kc") / F.col("nc")
    vt = pt * (1 - pt) * F.col("nt") / (F.col("nt") - 1)
    vc = pc * (1 - pc) * F.col("nc") / (F.col("nc") - 1)
    pooled = (vt + vc) / 2.0
    per_level = c.select(
        "feature",
        "level",
        F.lit("categorical").alias("kind"),
        pc.alias("control_mean"),
        pt.alias("treatment_mean"),
        F.when(pooled > 0, (pt - pc) / F.sqrt(pooled)).otherwise(0.0).alias("smd"),
    )
    worst = per_level.groupBy("feature").agg(
        F.max_by(
            F.struct("level", "kind", "control_mean", "treatment_mean", "smd"), F.struct(F.abs("smd"), F.col("level"))
        ).alias("w")
    )
    return worst.select("feature", "w.*")


def balance_table(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], treated: str) -> DataFrame:
    table = balance_numeric(df, numeric, treated).unionByName(balance_categorical(df, categorical, treated))
    size = F.abs("smd")
    return table.withColumn("abs_smd", size).withColumn(
        "status", F.when(size > 0.25, "SEVERE").when(size > 0.10, "imbalanced").otherwise("balanced")
    )


def arm_means(df: DataFrame, columns: Sequence[str], treated: str) -> DataFrame:
    return df.groupBy(F.col(treated).cast("int").alias("arm")).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )


# --- single-feature signal ---------------------------------------------------------------


def single_feature_auc(df: DataFrame, label: str, numeric: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """Direction-free AUC per feature; NULL numbers take the median, categories their target mean."""
    y = F.col(label).cast("int")
    frames = []
    if numeric:
        filled = ordered.quantile_values(df, numeric, [0.5])
        cells = [
            F.struct(
                F.lit(c).alias("feature"),
                F.coalesce(F.col(c).cast("double"), F.lit(filled[c][0] if c in filled else None)).alias("x"),
            )
            for c in numeric
        ]
        frames.append(df.select(y.alias("y"), F.inline(F.array(*cells))).groupBy("feature", "x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    if categorical:
        cells = [
            F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c).cast("string"), F.lit("__MISSING__")).alias("level"))
            for c in categorical
        ]
        levels = (
            df.select(y.alias("y"), F.inline(F.array(*cells)))
            .groupBy("feature", "level")
            .agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
            .withColumn("x", F.col("pos") / (F.col("pos") + F.col("neg")))
        )
        # Levels with the same target mean tie, as equal scores do.
        frames.append(levels.groupBy("feature", "x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    steps = ordered.positions(
        union_all(frames), ["feature"], ["x"], sums={"pos": "pos", "neg": "neg"}
    )
    wins = F.sum((F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).cast("double"))
    auc = steps.groupBy("feature").agg(
        F.count("*").alias("n_values"),
        (wins / (F.max("pos_total").cast("double") * F.max("neg_total"))).alias("auc"),
    )
    a = F.col("auc")
    return auc.select("feature", "n_values", F.when(F.col("n_values") > 1, F.greatest(a, 1 - a)).alias("auc"))


def leakage_audit(signal: DataFrame, exact: Sequence[str], contains: Sequence[str], limit: float = 0.95) -> DataFrame:
    """Keep or drop each feature by name rules and by a suspiciously high single-feature AUC."""
    name = F.lower("feature")
    part = F.lit(None).cast("string")
    for key in reversed(list(contains)):
        part = F.when(name.contains(key), f"rule_blacklist_contains:{key}").otherwise(part)
    auto = F.coalesce(F.col("auc") >= limit, F.lit(False))
    reasons = F.concat_ws(
        ";",
        F.when(F.col("feature").isin(list(exact)), "rule_blacklist_exact"),
        part,
        F.when(auto, f"auto_leak_auc>={limit:.2f}"),
    )
    return signal.select(
        "feature",
        "auc",
        auto.alias("auto_flag"),
        F.when(reasons == "", "keep").otherwise("drop").alias("action"),
        F.when(reasons == "", "none").otherwise(reasons).alias("reasons"),
    )


def leakage_verdict(signal: DataFrame, forbid: float = 0.97, suspect: float = 0.65) -> DataFrame:
    return signal.withColumn(
        "verdict",
        F.when(F.col("auc") >= forbid, "forbidden")
        .when(F.col("auc") >= suspect, "suspicious")
        .otherwise("safe-looking"),
    )


def category_spread(df: DataFrame, columns: Sequence[str], outcome: str) -> DataFrame:
    """Largest minus smallest outcome rate over the levels of each category, in points."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])
    rates = (
        df.select(F.col(outcome).alias("y"), F.inline(cells))
        .filter("level is not null")
        .groupBy("feature", "level")
        .agg(F.avg("y").alias("rate"))
    )
    return _spread(rates)


def _spread(rates: DataFrame) -> DataFrame:
    return rates.groupBy("feature").agg(
        F.count("*").alias("bins"), ((F.max("rate") - F.min("rate")) * 100).alias("spread_pp")
    )


def quantile_bins(value: Column, edges: Sequence[float]) -> Column:
    """Right-closed quantile bin from 1; repeated edges merge, the lowest edge is included."""
    cuts = sorted(set(edges))
    above = sum((F.when(value > c, 1).otherwise(0) for c in cuts[1:-1]), F.lit(1))
    return F.when(value.isNotNull(), above)


def numeric_spread(df: DataFrame, columns: Sequence[str], outcome: str, bins: int = 5) -> DataFrame:
    edges = ordered.quantile_values(df, columns, [i / bins for i in range(bins + 1)])
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), quantile_bins(F.col(c).cast("double"), edges[c]).alias("level"))
            for c in columns
        ]
    )
    rates = (
        df.select(F.col(outcome).alias("y"), F.inline(cells))
        .filter("level is not null")
        .groupBy("feature", "level")
        .agg(F.avg("y").alias("rate"))
    )
    return _spread(rates)


def group_effects(df: DataFrame, group: str, label: str, treated: str, least: int = 30) -> DataFrame:
    """Effect with its 95% half-width per group; groups with a small arm are left out."""
    t, y = F.col(treated).cast("int"), F.col(label).cast("int")
    g = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.sum(t).alias("n_treatment"),
        F.sum(1 - t).alias("n_control"),
        F.avg(F.when(t == 1, y)).alias("response_t"),
        F.avg(F.when(t == 0, y)).alias("response_c"),
    ).filter((F.col("n_treatment") >= least) & (F.col("n_control") >= least) & F.col(group).isNotNull())
    rt, rc = F.col("response_t"), F.col("response_c")
    se = F.sqrt(rt * (1 - rt) / F.col("n_treatment") + rc * (1 - rc) / F.col("n_control"))
    return g.withColumn("uplift", rt - rc).withColumn("ci95", 1.96 * se)


def equal_within(df: DataFrame, left: str, right: str, tolerance: float = 0.01) -> Column:
    near = F.abs(F.col(left) - F.col(right)) < tolerance
    return F.avg(F.coalesce(near, F.lit(False)).cast("int"))


def outcome_rates(df: DataFrame, group: str, outcome: str) -> DataFrame:
    return (
        df.groupBy(group)
        .agg(F.count("*").alias("n"), F.avg(outcome).alias("rate"))
        .orderBy(F.col("rate").desc(), group)
    )


def as_metric_rows(frames: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    return union_all([df.select(F.lit(n).alias("metric"), *columns) for n, df in frames.items()])


