"""Tests and experiment statistics: sufficient statistics by Spark, tails on the aggregated rows.

Two-group frames are (group column, metric column); group values a and b (control
and treatment) are literals. With ``tails=False`` the sufficient statistics and
test statistics come back without the Arrow step.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import tails as tl

from .ordering import cumulated, dealt, one_row, running, scanned


def two_groups(df: DataFrame, group: str, metric: str, a, b) -> DataFrame:
    """One row: n, mean and sample variance of both groups."""
    x = F.col(metric).cast("double")
    side = lambda v, s: [f(F.when(F.col(group) == F.lit(v), x)).alias(f"{n}_{s}") for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    return df.agg(*side(a, "a"), *side(b, "b"))


def welch(df: DataFrame, group: str, metric: str, a, b, alpha: float = 0.05, tails: bool = True) -> DataFrame:
    """difference is b minus a, t is a minus b (both named so), with lift, Cohen's d, interval and p."""
    g = two_groups(df, group, metric, a, b)
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    g = g.withColumns({"diff_b_minus_a": F.col("m_b") - F.col("m_a"), "se": F.sqrt(sa + sb), "df": F.try_divide((sa + sb) ** 2, sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1))})
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    g = g.withColumns({"t_a_minus_b": F.try_divide(-F.col("diff_b_minus_a"), F.col("se")), "lift": F.try_divide("diff_b_minus_a", F.abs("m_a")), "cohens_d": F.try_divide(F.col("diff_b_minus_a"), pooled)})
    if not tails:
        return g
    half = tl.q_t(F.lit(1 - alpha / 2), "df") * F.col("se")
    return g.withColumns({"p": tl.p_t("t_a_minus_b", "df"), "low": F.col("diff_b_minus_a") - half, "high": F.col("diff_b_minus_a") + half})


def proportions(df: DataFrame, group: str, hit: Column, a, b, alpha: float = 0.05, tails: bool = True) -> DataFrame:
    """Pooled z for the test, unpooled standard error for the interval."""
    g = df.agg(*[x for v, s in ((a, "a"), (b, "b")) for x in (F.count_if(F.col(group) == F.lit(v)).alias(f"n_{s}"), F.count_if((F.col(group) == F.lit(v)) & hit).alias(f"k_{s}"))])
    pa, pb = F.try_divide("k_a", "n_a"), F.try_divide("k_b", "n_b")
    pool = F.try_divide(F.col("k_a") + F.col("k_b"), F.col("n_a") + F.col("n_b"))
    g = g.withColumns({"p_a": pa, "p_b": pb, "difference": pb - pa, "z": F.try_divide(pb - pa, F.sqrt(pool * (1 - pool) * (1 / F.col("n_a") + 1 / F.col("n_b"))))})
    half = tl.normal_quantile(1 - alpha / 2) * F.sqrt(F.col("p_a") * (1 - F.col("p_a")) / F.col("n_a") + F.col("p_b") * (1 - F.col("p_b")) / F.col("n_b"))
    g = g.withColumns({"low": F.col("difference") - half, "high": F.col("difference") + half, "lift": F.try_divide("difference", "p_a")})
    return g.withColumn("p", tl.p_normal("z")) if tails else g


def mean_interval(df: DataFrame, metric: str, confidence: float = 0.95, by: Sequence[str] = (), tails: bool = True) -> DataFrame:
    g = df.groupBy(*by).agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), (F.stddev_samp(metric) / F.sqrt(F.count(metric))).alias("se"))
    if not tails:
        return g
    half = tl.q_t(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double")) * F.col("se")
    return g.withColumns({"low": F.col("mean") - half, "high": F.col("mean") + half})


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """rank with ties averaged, and how many rows share it. Values are counted first, so only distinct values are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("ties"))
    return cumulated(counts, [*by], "_v", "ties").withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2).drop("upto", "total")


def mann_whitney(df: DataFrame, group: str, metric: str, a, b, tails: bool = True) -> DataFrame:
    """U of the first group, tie-corrected normal z with continuity, medians and rank-biserial correlation."""
    two = df.where(F.col(group).isin(a, b) & F.col(metric).isNotNull()).select(F.when(F.col(group) == F.lit(a), 1).otherwise(0).alias("is_a"), F.col(metric).cast("double").alias("x"))
    per = two.groupBy("x").agg(F.sum("is_a").alias("ka"), F.count("*").alias("ties"))
    parts = dealt(per.withColumn("kb", F.col("ties") - F.col("ka")), [], ["x"])
    totals = parts.agg(F.sum("ka").alias("n_a"), F.sum("kb").alias("n_b"))
    ranked = scanned(parts, [], ["x"], {"upto_a": ("sum", F.col("ka")), "upto_b": ("sum", F.col("kb"))}).crossJoin(F.broadcast(totals))  # one row
    ranked = ranked.withColumn("rank", F.col("upto_a") + F.col("upto_b") - (F.col("ties") - 1) / 2)
    at = lambda s, place: F.min(F.when(F.col(f"upto_{s}") > place((F.col(f"n_{s}") - 1) / 2), F.col("x")))
    medians = [((at(s, F.floor) + at(s, F.ceil)) / 2).alias(f"median_{s}") for s in "ab"]
    g = ranked.agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), *medians, F.sum(F.col("rank") * F.col("ka")).alias("r"), F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie"))
    n, prod = F.col("n_a") + F.col("n_b"), F.col("n_a") * F.col("n_b")
    g = g.withColumn("u", F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2)
    sd = F.sqrt(prod / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1.0))))
    off = F.col("u") - prod / 2
    g = g.withColumns({"z": F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd), "rank_biserial": 2 * F.col("u") / prod - 1}).drop("r", "tie")
    return g.withColumn("p", tl.p_normal("z")) if tails else g


def chi_square(df: DataFrame, row: str, column: str, tails: bool = True) -> DataFrame:
    """Independence on a contingency table; Yates' correction on 2 x 2."""
    c = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("n"))
    rs, cs = c.groupBy("r").agg(F.sum("n").alias("nr")), c.groupBy("c").agg(F.sum("n").alias("nc"))
    grid = rs.crossJoin(cs).join(c, ["r", "c"], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # margins of the table
    total = c.agg(F.sum("n").alias("t"), F.count_distinct("r").alias("kr"), F.count_distinct("c").alias("kc"))
    grid = grid.crossJoin(F.broadcast(total)).withColumn("e", F.col("nr") * F.col("nc") / F.col("t"))  # one row
    gap = F.abs(F.col("n") - F.col("e"))
    gap = F.when((F.col("kr") == 2) & (F.col("kc") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    out = grid.agg(F.sum(gap * gap / F.col("e")).alias("chi2"), ((F.max("kr") - 1) * (F.max("kc") - 1)).alias("df"), F.max("t").alias("n"))
    return out.withColumn("p", tl.p_chi2("chi2", F.col("df").cast("double"))) if tails else out


def bootstrap(df: DataFrame, key: str, metric: str, replicates: int = 200, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of a mean by Poisson bootstrap: every row has a seeded Poisson(1) weight in each replicate.

    Weights come from a hash of the row's key, so the result does not depend on partitions; rows are summed map-side per replicate.
    """
    cdf, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        cdf.append(total)
        p /= k + 1
    x = F.col(metric).cast("double")
    rows = df.where(x.isNotNull()).select(x.alias("x"), F.col(key).alias("k"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    u = F.pmod(F.xxhash64(F.lit(seed), "b", "k"), F.lit(1 << 30)) / float(1 << 30)
    w = F.lit(len(cdf))
    for k in reversed(range(len(cdf))):
        w = F.when(F.col("u") < cdf[k], k).otherwise(w)
    rows = rows.withColumn("u", u).select("x", "b", w.cast("double").alias("w"))
    est = rows.groupBy("b").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    tail = (1 - confidence) / 2
    return est.agg(F.percentile("m", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("median"), F.col("q")[2].alias("high"))


def adjust(tests: DataFrame, p: str = "p", key: str = "test") -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjusted values of a table of tests."""
    up, down, all_ = Window.orderBy(p, key), Window.orderBy(F.desc(p), F.desc(key)), Window.partitionBy()
    t = tests.withColumns({"_m": F.count("*").over(all_), "_k": F.row_number().over(up)})
    t = t.withColumns({"bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m")), "_h": F.col(p) * (F.col("_m") - F.col("_k") + 1), "_b": F.col(p) * F.col("_m") / F.col("_k")})
    return t.withColumns({"holm": F.least(F.lit(1.0), F.max("_h").over(up)), "bh": F.least(F.lit(1.0), F.min("_b").over(down))}).drop("_m", "_k", "_h", "_b")


def jarque_bera(df: DataFrame, metric: str, by: Sequence[str] = (), tails: bool = True) -> DataFrame:
    """Normality from one-pass moments."""
    g = df.groupBy(*by).agg(F.count(metric).alias("n"), F.skewness(metric).alias("skew"), F.kurtosis(metric).alias("kurtosis"))
    g = g.withColumn("jb", F.col("n") / 6.0 * (F.col("skew") ** 2 + F.col("kurtosis") ** 2 / 4))
    return g.withColumn("p", tl.p_chi2("jb", F.lit(2.0))) if tails else g


def describe_shape(df: DataFrame, metric: str) -> DataFrame:
    """Population moments with a shape word."""
    g = df.agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.skewness(metric).alias("skew"), F.kurtosis(metric).alias("kurtosis"))
    g = g.crossJoin(one_row(df, {metric: F.col(metric)}, {"median": 0.5}).toDF("median")).select("n", "mean", "median", "sd", "skew", "kurtosis")  # one row each
    return g.withColumn("shape", F.when(F.abs("skew") < 0.5, "symmetric").when(F.col("skew") > 0, "right-skewed").otherwise("left-skewed"))


def rank_dimensions(df: DataFrame, metric: str, dims: Sequence[str], tails: bool = True) -> DataFrame:
    """Dimensions by eta squared; groups of one row leave the between sum but stay in the total."""
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("v")) for c in dims])
    rows = df.where(F.col(metric).isNotNull()).select(F.col(metric).cast("double").alias("x"), F.explode(cells).alias("c")).select("c.dim", "c.v", "x")
    total = rows.groupBy("dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("ss_total"))
    groups = rows.where("v IS NOT NULL").groupBy("dim", "v").agg(F.count("*").alias("k"), F.avg("x").alias("m")).where("k > 1")
    between = groups.join(total, "dim").groupBy("dim").agg(F.sum(F.col("k") * (F.col("m") - F.col("mean")) ** 2).alias("ss_between"), F.count("*").alias("groups"))
    out = total.join(between, "dim").withColumn("eta2", F.try_divide("ss_between", "ss_total"))
    out = out.withColumn("f", F.try_divide(F.col("ss_between") / (F.col("groups") - 1), (F.col("ss_total") - F.col("ss_between")) / (F.col("n") - F.col("groups"))))
    out = out.select("dim", "n", "groups", "eta2", "f")
    return out.withColumn("p", tl.p_f("f", (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double"))) if tails else out


def ratio_metric(df: DataFrame, group: str, num: str, den: str, a, b, tails: bool = True) -> DataFrame:
    """Difference of ratios of means with delta-method variances."""
    def side(v, s):
        g = F.col(group) == F.lit(v)
        x, y = F.when(g, F.col(num).cast("double")), F.when(g, F.col(den).cast("double"))
        return [F.count(x).alias(f"n_{s}"), F.avg(x).alias(f"x_{s}"), F.avg(y).alias(f"y_{s}"), F.var_samp(x).alias(f"vx_{s}"), F.var_samp(y).alias(f"vy_{s}"), F.covar_samp(x, y).alias(f"c_{s}")]

    g = df.agg(*side(a, "a"), *side(b, "b"))
    for s in "ab":
        r = F.col(f"x_{s}") / F.col(f"y_{s}")
        g = g.withColumns({f"r_{s}": r, f"var_{s}": (F.col(f"vx_{s}") - 2 * r * F.col(f"c_{s}") + r * r * F.col(f"vy_{s}")) / (F.col(f"y_{s}") ** 2 * F.col(f"n_{s}"))})
    g = g.select("n_a", "n_b", "r_a", "r_b", (F.col("r_b") - F.col("r_a")).alias("difference"), F.try_divide(F.col("r_b") - F.col("r_a"), F.sqrt(F.col("var_a") + F.col("var_b"))).alias("z"))
    return g.withColumn("p", tl.p_normal("z")) if tails else g


def srm(df: DataFrame, group: str, expected: dict, threshold: float = 0.01, by: Sequence[str] = (), tails: bool = True) -> DataFrame:
    """Chi-square of assignment counts against expected shares; over 0.05 PASS, over threshold WARNING, else BLOCK."""
    n = {k: F.count_if(F.col(group) == F.lit(k)) for k in expected}
    total, share = sum(n.values()), sum(expected.values())
    chi = sum((c - total * (expected[k] / share)) ** 2 / (total * (expected[k] / share)) for k, c in n.items())
    out = df.groupBy(*by).agg(total.alias("n"), chi.alias("chi2"), F.lit(len(expected) - 1).alias("df"))
    if not tails:
        return out
    out = out.withColumn("p", tl.p_chi2("chi2", F.col("df").cast("double")))
    return out.withColumn("status", F.when(F.col("p") > 0.05, "PASS").when(F.col("p") > threshold, "WARNING").otherwise("BLOCK"))


def by_segment(df: DataFrame, segments: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows repeated once a segment column: (dim, value, kept columns)."""
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in segments])
    return df.select(*keep, F.explode(cells).alias("x")).select("x.dim", "x.value", *keep)


def few_valued(df: DataFrame, columns: Sequence[str] | None = None, most: int = 19) -> list[str]:
    """Columns of 2 to ``most`` values, in order: an approximate count rules out most, the rest are counted exactly."""
    names = [f.name for f in df.schema if columns is None or f.name in columns]
    if not names:
        return []
    about = df.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in names]).first()
    near = [c for c in names if about[c] <= 2 * most]
    exact = df.agg(*[F.count_distinct(F.col(c)).alias(c) for c in near]).first() if near else {}
    return [c for c in near if 2 <= exact[c] <= most]


def srm_by_segments(df: DataFrame, group: str, expected: dict, columns: Sequence[str] | None = None, threshold: float = 0.01, tails: bool = True) -> DataFrame:
    """SRM within every value of every column that has few of them (all but the group's own unless named)."""
    found = few_valued(df.drop(group) if columns is None else df, columns)
    if not found:
        found = []
        df = df.where("false").withColumn("_none", F.lit(None).cast("string"))
    return srm(by_segment(df, found or ["_none"], [group]), group, expected, threshold, ["dim", "value"], tails)


def cuped(df: DataFrame, group: str, pre: str, post: str, a, b, tails: bool = True) -> DataFrame:
    """theta over all rows; adjusted means and variances by algebra on the same moments."""
    def side(v, s):
        g = F.col(group) == F.lit(v)
        x, y = F.when(g, F.col(pre).cast("double")), F.when(g, F.col(post).cast("double"))
        return [F.count(y).alias(f"n_{s}"), F.avg(x).alias(f"x_{s}"), F.avg(y).alias(f"y_{s}"), F.var_samp(x).alias(f"vx_{s}"), F.var_samp(y).alias(f"vy_{s}"), F.covar_samp(x, y).alias(f"c_{s}")]

    g = df.agg(F.try_divide(F.covar_samp(pre, post), F.var_samp(pre)).alias("theta"), F.avg(pre).alias("xm"), F.var_samp(post).alias("v_all"), (F.corr(pre, post) ** 2).alias("reduction"), *side(a, "a"), *side(b, "b"))
    for s in "ab":
        g = g.withColumns({f"m_{s}": F.col(f"y_{s}") - F.col("theta") * (F.col(f"x_{s}") - F.col("xm")), f"v_{s}": F.col(f"vy_{s}") - 2 * F.col("theta") * F.col(f"c_{s}") + F.col("theta") ** 2 * F.col(f"vx_{s}")})
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    g = g.select("theta", "reduction", "m_a", "m_b", (F.col("m_b") - F.col("m_a")).alias("effect"), F.sqrt(sa + sb).alias("se"), F.try_divide((sa + sb) ** 2, sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)).alias("df"))
    return g.withColumn("p", tl.p_t(F.try_divide("effect", "se"), "df")) if tails else g


def confidence_sequence(df: DataFrame, metric: str, by: str, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Running mean with an anytime interval at each observation; null bounds before the second.

    The variance is that of merged centred moments, so a mean far from zero does not swallow it.
    """
    rows = running(df.select(by, *order, F.col(metric).cast("double").alias("x")), [by], order, {"m": ("moments", F.col("x"))})
    rows = rows.select(by, *order, "x", F.col("m.n").alias("n"), F.col("m.mean").alias("mean"), F.try_divide("m.m2", F.col("m.n") - 1).alias("v"))
    half = F.sqrt(2 * F.col("v") * F.log(2 * F.log2(2 * F.col("n")) / alpha * 1.7) / F.col("n") * 1.1)
    return rows.withColumns({"low": F.when(F.col("n") >= 2, F.col("mean") - half), "high": F.when(F.col("n") >= 2, F.col("mean") + half)}).drop("v")


def e_value(df: DataFrame, metric: str, by: str, order: Sequence[str], null_mean: float = 0.0) -> DataFrame:
    """Anytime-valid p: a betting martingale whose stake at t depends on earlier observations only.

    One ordering of the rows and three scans over it: sums of the past, the running log e-value (floor 1e-10 under the
    logarithm, cap 500), and its maximum so far.
    """
    d = F.col(metric).cast("double") - null_mean
    zero = F.coalesce("d", F.lit(0.0))
    parts = dealt(df.select(by, *order, d.alias("d")), [by], order)
    rows = scanned(parts, [by], order, {"s1": ("sum", zero), "s2": ("sum", zero**2)})
    rows = rows.withColumns({"s1": F.col("s1") - zero, "s2": F.col("s2") - zero**2})
    stake = F.when(F.col("s2") > 0, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), F.col("s1") / F.col("s2")))).otherwise(0.0)
    rows = rows.select(by, *order, "_p", F.log(F.greatest(F.lit(1e-10), 1 + stake * F.col("d"))).alias("gain"))
    rows = scanned(rows, [by], order, {"e": ("sum", F.col("gain"))}).withColumn("log_e", F.least(F.lit(500.0), F.coalesce("e", F.lit(0.0))))
    rows = scanned(rows, [by], order, {"best": ("max", F.col("log_e"))})
    return rows.select(by, *order, "log_e", F.least(F.lit(1.0), F.exp(-F.col("best"))).alias("p"))


def beta_posterior(df: DataFrame, group: str, hit: Column, a, b, prior: tuple[float, float] = (1.0, 1.0), tails: bool = True) -> DataFrame:
    """Beta posteriors of two rates, and P(b > a) by quadrature over their densities (z is that of the normal approximation)."""
    g = df.agg(*[x for v, s in ((a, "a"), (b, "b")) for x in ((F.count_if((F.col(group) == F.lit(v)) & hit) + prior[0]).alias(f"al_{s}"), (F.count_if((F.col(group) == F.lit(v)) & ~hit) + prior[1]).alias(f"be_{s}"))])
    for s in "ab":
        al, be = F.col(f"al_{s}"), F.col(f"be_{s}")
        g = g.withColumns({f"mean_{s}": al / (al + be), f"var_{s}": al * be / ((al + be) ** 2 * (al + be + 1))})
    g = g.withColumn("z", F.try_divide(F.col("mean_b") - F.col("mean_a"), F.sqrt(F.col("var_a") + F.col("var_b"))))
    return g.withColumn("p_better", tl.p_beta_better("al_a", "be_a", "al_b", "be_b")) if tails else g


def normal_posterior(df: DataFrame, group: str, metric: str, a, b, prior_mean: float = 0.0, prior_var: float = 1e6, tails: bool = True) -> DataFrame:
    """Normal posteriors of two means; P(b > a) and expected losses in closed form."""
    g = two_groups(df, group, metric, a, b)
    for s in "ab":
        w = 1 / (1 / F.lit(prior_var) + F.col(f"n_{s}") / F.col(f"v_{s}"))
        g = g.withColumns({f"pv_{s}": w, f"pm_{s}": w * (prior_mean / prior_var + F.col(f"n_{s}") * F.col(f"m_{s}") / F.col(f"v_{s}"))})
    sd = F.sqrt(F.col("pv_a") + F.col("pv_b"))
    g = g.select("pm_a", "pm_b", "pv_a", "pv_b", sd.alias("sd"), F.try_divide(F.col("pm_b") - F.col("pm_a"), sd).alias("z"))
    if not tails:
        return g
    density = F.exp(-F.col("z") ** 2 / 2) / math.sqrt(2 * math.pi)
    g = g.withColumn("p_better", tl.phi("z"))
    return g.withColumn("loss_b", F.col("sd") * (density - F.col("z") * (1 - F.col("p_better")))).withColumn("loss_a", F.col("sd") * (density + F.col("z") * F.col("p_better")))


def prob_best(posteriors: DataFrame, points: int = 400) -> DataFrame:
    """P(best) of normal posteriors (variant, mean, var), and the loss to expect from choosing a variant: how far the best
    lies above it on average. Quadrature over one grid."""
    span = posteriors.agg(F.min(F.col("mean") - 6 * F.sqrt("var")).alias("lo"), F.max(F.col("mean") + 6 * F.sqrt("var")).alias("hi"))
    grid = span.select(((F.col("hi") - F.col("lo")) / points).alias("h"), "lo", F.explode(F.sequence(F.lit(0), F.lit(points))).alias("i")).select("h", "i", (F.col("lo") + F.col("i") * F.col("h")).alias("x"))
    cells = posteriors.crossJoin(F.broadcast(grid)).withColumn("z", (F.col("x") - F.col("mean")) / F.sqrt("var"))  # variants x a fixed grid
    cells = cells.withColumn("logcdf", F.log(F.greatest(F.lit(1e-300), tl.phi("z"))))
    cells = cells.withColumn("others", F.sum("logcdf").over(Window.partitionBy("i")) - F.col("logcdf"))
    weight = F.exp(-F.col("z") ** 2 / 2) / (F.sqrt("var") * math.sqrt(2 * math.pi)) * F.col("h")
    cells = cells.withColumn("mass", weight * F.exp("others"))
    best = cells.agg(F.sum(F.col("x") * F.col("mass")).alias("best"))
    out = cells.groupBy("variant").agg(F.sum("mass").alias("p_best"), F.first("mean").alias("mean"))
    return out.crossJoin(F.broadcast(best)).select("variant", "p_best", F.greatest(F.lit(0.0), F.col("best") - F.col("mean")).alias("expected_loss"))  # one row


def sizing(df: DataFrame, segment: str, hit: Column, metric: str, pre: str, day: str, mdes: Sequence[float], alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Per segment and effect: n per group for a rate (arcsine h), days at measured traffic, detectable d now, CUPED saving."""
    z = tl.normal_quantile(1 - alpha / 2) + tl.normal_quantile(power)
    g = df.groupBy(segment).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("rate"), (F.corr(metric, pre) ** 2).alias("saving"), (F.count("*") / (F.datediff(F.max(day), F.min(day)) + 1)).alias("daily"))
    grid = df.sparkSession.createDataFrame([(float(m),) for m in mdes], "mde double")
    g = g.crossJoin(grid)  # segments x a short list
    h = 2 * F.asin(F.sqrt(F.least(F.lit(1.0), F.col("rate") * (1 + F.col("mde"))))) - 2 * F.asin(F.sqrt("rate"))
    g = g.withColumn("n_per_group", F.ceil(F.try_divide(F.lit(2 * z * z), h * h)))
    g = g.withColumns({"days": F.ceil(2 * F.col("n_per_group") / F.col("daily")), "detectable_d": z * F.sqrt(4.0 / F.col("n"))})
    return g.withColumn("verdict", F.when(F.col("days") <= 28, "viable").when(F.col("days") <= 56, "marginal").otherwise("not viable"))


def accumulation(df: DataFrame, day: str, required: int, window: int = 7) -> DataFrame:
    """Units so far against the required number, and days left at the trailing mean."""
    d = df.groupBy(F.col(day).cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day")  # days, already aggregated
    d = d.withColumns({"total": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "pace": F.avg("n").over(w.rowsBetween(-(window - 1), 0))})
    return d.select("day", "total", "pace", F.when(F.col("total") >= required, 0).otherwise(F.ceil((required - F.col("total")) / F.col("pace"))).cast("long").alias("days_left"))


def guardrail(change: Column, warn: float, stop: float) -> Column:
    """GREEN, YELLOW or RED of a harmful relative change."""
    return F.when(change >= stop, "RED").when(change >= warn, "YELLOW").otherwise("GREEN")
