"""Segments compared with each other, and treatment effects inside segments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import tails as tl

from .ordering import cumulated, quantiles
from .statistics import by_segment

NORMAL = -2 * math.log(0.05)  # a Jarque-Bera statistic above this has p below 0.05


def segment_summary(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """One row a segment: n, mean, median, sd, and whether it is too small or too far from normal for a t test."""
    x = df.where(F.col(segment).isNotNull() & F.col(metric).isNotNull()).select(F.col(segment).alias("segment"), F.col(metric).cast("double").alias("x"))
    g = x.groupBy("segment").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"), F.skewness("x").alias("s"), F.kurtosis("x").alias("k"))
    jb = F.col("n") / 6.0 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    middle = quantiles(x, {"x": F.col("x")}, {"median": 0.5}, ["segment"]).select(F.col("segment").alias("m_segment"), "median")
    g = g.withColumn("ranks_needed", (F.col("n") < 30) | F.coalesce(jb > NORMAL, F.lit(True)))
    return g.join(middle, F.col("segment") == F.col("m_segment")).select("segment", "n", "mean", "median", "sd", "ranks_needed")


def compare_segments(df: DataFrame, segment: str, metric: str, test: str = "auto", tails: bool = True) -> DataFrame:
    """One row a pair of segments: Welch's t or Mann-Whitney's U, Cohen's d, p and its Bonferroni adjustment.

    auto takes ranks for all pairs if any segment has fewer than 30 rows or is not normal by its moments. Values are
    counted by segment first; ranks of a pair come from those counts.
    """
    x = df.where(F.col(segment).isNotNull() & F.col(metric).isNotNull()).select(F.col(segment).alias("segment"), F.col(metric).cast("double").alias("x"))
    g = segment_summary(df, segment, metric)
    rule = {"auto": F.max("ranks_needed"), "mann-whitney": F.lit(True), "t-test": F.lit(False)}[test]
    choice = g.agg(rule.alias("by_rank"))
    a, b = (g.select(*[F.col(c).alias(f"{c}_{s}") for c in ("segment", "n", "mean", "sd")]) for s in "ab")
    pairs = a.join(b, F.col("segment_a") < F.col("segment_b")).crossJoin(F.broadcast(choice))  # segments, not rows; choice is one row
    names = pairs.select(F.col("segment_a").alias("a"), F.col("segment_b").alias("b"))
    counts = x.groupBy("segment", "x").agg(F.count("*").alias("k"))
    sides = names.select("a", "b", F.explode(F.array("a", "b")).alias("s"))
    per = counts.join(sides, F.col("segment") == F.col("s")).groupBy("a", "b", "x").agg(F.sum(F.when(F.col("s") == F.col("a"), F.col("k")).otherwise(0)).alias("ka"), F.sum("k").alias("ties"))
    ranked = cumulated(per, ["a", "b"], "x", "ties").withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2)
    u = ranked.groupBy("a", "b").agg(F.sum(F.col("rank") * F.col("ka")).alias("r"), F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("tie"))
    rows = pairs.join(u, (F.col("segment_a") == F.col("a")) & (F.col("segment_b") == F.col("b")))
    na, nb, n = F.col("n_a"), F.col("n_b"), F.col("n_a") + F.col("n_b")
    va, vb = F.col("sd_a") ** 2 / na, F.col("sd_b") ** 2 / nb
    rows = rows.withColumn("u", F.col("r") - na * (na + 1) / 2)
    off = F.col("u") - na * nb / 2
    sd = F.sqrt(na * nb / 12.0 * ((n + 1) - F.col("tie") / (n * (n - 1.0))))
    pooled = F.sqrt(((na - 1) * F.col("sd_a") ** 2 + (nb - 1) * F.col("sd_b") ** 2) / F.greatest(n - 2, F.lit(1)))
    rows = rows.select(
        "a", "b", F.when(F.col("by_rank"), "mann-whitney").otherwise("welch-t").alias("test_used"),
        F.when(F.col("by_rank"), F.col("u")).otherwise(F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(va + vb))).alias("stat"),
        F.coalesce(F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd), F.lit(0.0)).alias("z"),
        F.try_divide((va + vb) ** 2, va * va / (na - 1) + vb * vb / (nb - 1)).alias("df"),
        F.coalesce(F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled), F.lit(0.0)).alias("effect_size"),
    )
    if not tails:
        return rows
    p = F.when(F.col("test_used") == "welch-t", tl.p_t("stat", "df")).otherwise(tl.p_normal("z"))
    rows = rows.withColumn("p", p).withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p") * F.count("*").over(Window.partitionBy())))  # pairs of segments
    return rows.withColumn("significant", F.col("p_adjusted") < 0.05)


def segment_effects(df: DataFrame, group: str, segments: Sequence[str], metric: str, a, b, tails: bool = True) -> DataFrame:
    """Effect of b over a in every value of every segment column, with its error, whether it turns round the overall
    effect, and per column the heterogeneity statistic (weighted squares around the pooled effect) as test of interaction."""
    y, side = F.col(metric).cast("double"), F.when(F.col(group) == F.lit(b), 1).when(F.col(group) == F.lit(a), 0)
    data = df.select(*segments, side.alias("_t"), y.alias("_y")).where("_t IS NOT NULL AND _y IS NOT NULL")
    arms = [f(F.when(F.col("_t") == t, F.col("_y"))).alias(f"{name}{t}") for t in (0, 1) for name, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    overall = data.agg(*arms).select((F.col("m1") - F.col("m0")).alias("overall"))
    g = by_segment(data, segments, ["_t", "_y"]).where("value IS NOT NULL").groupBy("dim", "value").agg(*arms)
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    g = g.select("dim", "value", "n0", "n1", (F.col("m1") - F.col("m0")).alias("effect"), F.sqrt(s0 + s1).alias("se"), F.try_divide((s0 + s1) ** 2, s0 * s0 / (F.col("n0") - 1) + s1 * s1 / (F.col("n1") - 1)).alias("df"))
    g = g.crossJoin(F.broadcast(overall)).withColumn("reversal", F.signum("effect") * F.signum("overall") < 0).withColumn("t", F.try_divide("effect", "se"))  # one row
    line, w = Window.partitionBy("dim"), F.try_divide(F.lit(1.0), F.col("se") ** 2)  # segments, not rows
    g = g.withColumn("w", w)
    g = g.withColumn("pooled", F.try_divide(F.sum(F.col("w") * F.col("effect")).over(line), F.sum("w").over(line)))
    g = g.withColumns({"q": F.sum(F.col("w") * (F.col("effect") - F.col("pooled")) ** 2).over(line), "q_df": F.count("w").over(line) - 1})
    g = g.select("dim", "value", "n0", "n1", "effect", "se", "df", "t", "overall", "reversal", "q", "q_df")
    return g.withColumns({"p": tl.p_t("t", "df"), "p_interaction": tl.p_chi2("q", F.col("q_df").cast("double"))}) if tails else g
