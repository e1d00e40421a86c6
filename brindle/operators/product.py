"""Product analytics: RFM, concentration, cohorts, funnels, change and root-cause decomposition."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import tails as tl

from .ordering import dealt, one_row, quantiles, scanned
from .profiling import spine


def cut_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: for each column the edges of 5, 4, 3 or 2 quantile bins, the most whose edges are all distinct; null if none are.

    All columns are counted and ordered together.
    """
    levels = {q: [i / q for i in range(q + 1)] for q in (5, 4, 3, 2)}
    at = {f"q{q}_{i}": x for q, xs in levels.items() for i, x in enumerate(xs)}
    rows = quantiles(df, {c: F.col(c) for c in columns}, at).select("column", *[F.array(*[f"q{q}_{i}" for i in range(q + 1)]).alias(f"q{q}") for q in levels])
    pick = F.lit(None).cast("array<double>")
    for q in (2, 3, 4, 5):
        pick = F.when(F.size(F.array_distinct(f"q{q}")) == q + 1, F.col(f"q{q}")).otherwise(pick)
    return rows.agg(*[F.max(F.when(F.col("column") == c, pick)).alias(c) for c in columns])  # one row, also without values


def quantile_scores(df: DataFrame, scores: dict[str, tuple[str, bool]]) -> DataFrame:
    """df with scores name -> (column, reversed): 1 to q by quantile bin, 5 downwards if reversed; a constant column scores 3."""
    cuts = cut_points(df, list(dict.fromkeys(c for c, _ in scores.values())))
    cuts = cuts.select(*[F.col(c).alias(f"_cut_{c}") for c in cuts.columns])
    out = {}
    for name, (column, down) in scores.items():
        edges = F.col(f"_cut_{column}")
        below = F.transform(F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0))), partial(lambda value, e: (e < value).cast("int"), F.col(column)))
        above = F.aggregate(below, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
        out[name] = F.when(edges.isNull(), 3).otherwise(5 - above if down else above + 1).cast("int")
    return df.crossJoin(F.broadcast(cuts)).withColumns(out).drop(*cuts.columns)  # one row


def rfm(df: DataFrame, customer: str, day: str, revenue: str, as_of: str) -> DataFrame:
    """Recency, frequency, monetary value, their scores and a segment per customer."""
    per = df.where(F.col(customer).isNotNull()).groupBy(customer).agg(F.datediff(F.lit(as_of).cast("date"), F.max(F.col(day).cast("date"))).alias("recency"), F.count("*").alias("frequency"), F.sum(revenue).alias("monetary"))
    per = quantile_scores(per, {"r": ("recency", True), "f": ("frequency", False), "m": ("monetary", False)})
    seg = F.when((F.col("r") >= 4) & (F.col("f") >= 4) & (F.col("m") >= 4), "Champions").when(F.col("f") >= 4, "Loyal").when((F.col("r") <= 2) & (F.col("f") >= 3), "At Risk").when((F.col("r") <= 2) & (F.col("f") <= 2), "Lost").otherwise("Other")
    return per.withColumn("segment", seg)


def ranked_sums(df: DataFrame, value: str, tie: str, descending: bool = False) -> DataFrame:
    """rank and running sum of a global order without one task: range partitions, then offsets of the partitions before.

    Rows with equal order keys stay in one partition, as (value, tie) is the range key.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(tie)]
    parts = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = Window.partitionBy("_p").orderBy(*order)
    rows = parts.withColumns({"rank": F.row_number().over(local).cast("long"), "running": F.sum(value).over(local.rowsBetween(Window.unboundedPreceding, 0))})
    sums = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(value).alias("_s"))  # one row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"))
    return rows.join(sums, "_p").withColumns({"rank": F.col("rank") + F.col("_n0"), "running": F.col("running") + F.col("_s0")}).drop("_p", "_n0", "_s0")


def concentration(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Gini, shares of the top 10, 20 and 50 percent of entities, and the percent of entities that hold 80 percent."""
    per = df.groupBy(entity).agg(F.sum(value).alias("v")).where("v > 0")
    rows = ranked_sums(per, "v", entity, True)
    total = per.agg(F.count("*").alias("n"), F.sum("v").alias("t"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    tops = [F.max(F.when(F.col("rank") == F.ceil(F.col("n") * p), F.col("running") / F.col("t"))).alias(f"top{int(100 * p)}") for p in (0.1, 0.2, 0.5)]
    gini = (F.sum((F.col("n") + 1 - 2 * F.col("rank")) * F.col("v")) / (F.max("n") * F.max("t"))).alias("gini")
    pareto = (100.0 * F.min(F.when(F.col("running") >= 0.8 * F.col("t"), F.col("rank"))) / F.max("n")).alias("pareto_pct")
    return rows.agg(F.max("n").alias("n"), gini, *tops, pareto)


def lorenz(df: DataFrame, value: str, entity: str, points: int = 10) -> DataFrame:
    """(point, entities, share): what share of all value the lowest point / points of the entities hold."""
    per = df.groupBy(entity).agg(F.sum(value).alias("v")).where("v > 0")
    rows = ranked_sums(per, "v", entity).crossJoin(F.broadcast(per.agg(F.count("*").alias("n"), F.sum("v").alias("t"))))  # one row
    at = F.explode(F.sequence(F.lit(1), F.lit(points))).alias("point")
    grid = per.agg(F.count("*").alias("n")).select(at, "n").withColumn("rank", F.ceil(F.col("n") * F.col("point") / points)).where("n > 0").drop("n")
    return rows.join(F.broadcast(grid), "rank").select("point", F.col("rank").alias("entities"), (F.col("running") / F.col("t")).alias("share"))


def segment_pairs(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Pairs of segments: difference of means, Welch t and degrees of freedom, Cohen's d."""
    g = df.where(F.col(metric).isNotNull()).groupBy(segment).agg(F.count("*").alias("n"), F.avg(metric).alias("m"), F.var_samp(metric).alias("v"), F.percentile(metric, 0.5).alias("md"))
    a, b = (g.select(*[F.col(c).alias(f"{c}_{x}") for c in (segment, "n", "m", "v", "md")]) for x in "ab")
    p = a.join(b, F.col(f"{segment}_a") < F.col(f"{segment}_b"))  # segments, not rows
    sa, sb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    return p.select(F.col(f"{segment}_a").alias("a"), F.col(f"{segment}_b").alias("b"), (F.col("m_b") - F.col("m_a")).alias("difference"), F.try_divide(F.col("m_a") - F.col("m_b"), F.sqrt(sa + sb)).alias("t"), F.try_divide((sa + sb) ** 2, sa * sa / (F.col("n_a") - 1) + sb * sb / (F.col("n_b") - 1)).alias("df"), F.try_divide(F.col("m_b") - F.col("m_a"), pooled).alias("d"))


def control_chart(series: DataFrame, order: str, value: str, sigma: float = 3.0) -> DataFrame:
    """Limits of a whole series and Western Electric rules 1 to 4 (full windows only)."""
    stats = series.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    rows = series.crossJoin(F.broadcast(stats)).withColumn("z", F.coalesce(F.try_divide(F.col(value) - F.col("mean"), F.col("sd")), F.lit(0.0)))  # one row
    w = Window.orderBy(order)  # an aggregated series
    n = F.row_number().over(w)
    def count(c: Column, k: int) -> Column:
        return F.when(n >= k, F.sum(c.cast("int")).over(w.rowsBetween(-(k - 1), 0)))

    z = F.col("z")
    both = lambda f: [f(z), f(-z)]
    rules = {
        "rule1": F.abs(z) > sigma,
        "rule2": reduce(lambda a, b: a | b, [F.coalesce(count(x > 2, 3) >= 2, F.lit(False)) for x in both(lambda x: x)]),
        "rule3": reduce(lambda a, b: a | b, [F.coalesce(count(x > 1, 5) >= 4, F.lit(False)) for x in both(lambda x: x)]),
        "rule4": reduce(lambda a, b: a | b, [F.coalesce(count(x > 0, 8) >= 8, F.lit(False)) for x in both(lambda x: x)]),
    }
    return rows.withColumns({"ucl": F.col("mean") + sigma * F.col("sd"), "lcl": F.col("mean") - sigma * F.col("sd"), **rules})


def trailing_chart(series: DataFrame, order: str, value: str, window: int = 20, sigma: float = 3.0) -> DataFrame:
    """Limits of each point from the window of points before it (null until that is full), and whether it lies beyond them."""
    w = Window.orderBy(order).rowsBetween(-window, -1)  # an aggregated series
    full = F.count(value).over(w) == window
    rows = series.select(order, value, F.when(full, F.avg(value).over(w)).alias("mean"), F.when(full, F.stddev_samp(value).over(w)).alias("sd"))
    rows = rows.withColumns({"lcl": F.col("mean") - sigma * F.col("sd"), "ucl": F.col("mean") + sigma * F.col("sd")}).drop("sd")
    return rows.withColumn("outside", F.coalesce((F.col(value) < F.col("lcl")) | (F.col(value) > F.col("ucl")), F.lit(False)))


def cohorts(df: DataFrame, user: str, day: str, unit: str = "month", small: int = 50) -> DataFrame:
    """(cohort, offset, users, size, rate, small): distinct users active so many periods after their first.

    Offsets that the data do not reach yet are absent (not zero); observable ones without users are zero.
    """
    e = df.where(F.col(user).isNotNull()).select(F.col(user).alias("u"), F.date_trunc(unit, day).cast("date").alias("p")).distinct()
    first = e.groupBy("u").agg(F.min("p").alias("cohort"))
    between = {"month": F.months_between("p", "cohort").cast("int"), "week": (F.datediff("p", "cohort") / 7).cast("int"), "day": F.datediff("p", "cohort")}[unit]
    cells = e.join(first, "u").groupBy("cohort", between.alias("offset")).agg(F.count("*").alias("users"))
    size = first.groupBy("cohort").agg(F.count("*").alias("size"))
    last = e.agg(F.max("p").alias("p"))
    grid = size.crossJoin(F.broadcast(last)).withColumn("offset", F.explode(F.sequence(F.lit(0), between))).drop("p")  # one row
    out = grid.join(cells, ["cohort", "offset"], "left").withColumn("users", F.coalesce("users", F.lit(0)))
    return out.select("cohort", "offset", "users", "size", F.try_divide("users", "size").alias("rate"), (F.col("size") < small).alias("small"))


def retention_curve(cells: DataFrame, confidence: float | None = None, mature: int = 0) -> DataFrame:
    """Mean rate per offset with its standard deviation and number of cohorts.

    With a confidence, low and high of its t interval within 0 and 1; only cohorts observed for mature periods count.
    """
    if mature:
        old = cells.groupBy("cohort").agg(F.max("offset").alias("m")).where(F.col("m") >= mature).select("cohort")
        cells = cells.join(old, "cohort", "left_semi")
    g = cells.groupBy("offset").agg(F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sd"), F.count("*").alias("n_cohorts"))
    if confidence is None:
        return g
    half = tl.q_t(F.lit((1 + confidence) / 2), F.when(F.col("n_cohorts") > 1, F.col("n_cohorts") - 1).cast("double")) * F.col("sd") / F.sqrt("n_cohorts")
    known = half.isNotNull()
    return g.withColumns({"low": F.when(known, F.greatest(F.lit(0.0), F.col("mean") - half)), "high": F.when(known, F.least(F.lit(1.0), F.col("mean") + half))})


def cohort_trend(cells: DataFrame) -> DataFrame:
    """Slope of the rate over cohorts per offset, and how many cohorts lie beyond two standard deviations."""
    w = Window.partitionBy("offset")
    rows = cells.withColumns({"x": F.dense_rank().over(w.orderBy("cohort")).cast("double"), "m": F.avg("rate").over(w), "sd": F.stddev_samp("rate").over(w)})
    return rows.groupBy("offset").agg(F.regr_slope("rate", "x").alias("slope"), F.count_if(F.abs(F.col("rate") - F.col("m")) > 2 * F.col("sd")).alias("n_outliers"))


def cohort_ltv(df: DataFrame, user: str, day: str, revenue: str, unit: str = "month") -> DataFrame:
    """Cumulative revenue per starting user by offset."""
    e = df.where(F.col(user).isNotNull()).select(F.col(user).alias("u"), F.date_trunc(unit, day).cast("date").alias("p"), F.col(revenue).alias("r"))
    first = e.groupBy("u").agg(F.min("p").alias("cohort"))
    size = first.groupBy("cohort").agg(F.count("*").alias("size"))
    cells = e.join(first, "u").groupBy("cohort", F.months_between("p", "cohort").cast("int").alias("offset")).agg(F.sum("r").alias("r"))
    w = Window.partitionBy("cohort").orderBy("offset")
    return cells.join(size, "cohort").select("cohort", "offset", (F.sum("r").over(w) / F.col("size")).alias("ltv"))


def ltv_maturity(ltv: DataFrame, share: float = 0.8) -> DataFrame:
    """First offset at which a cohort has a share of its last cumulative value."""
    last = ltv.withColumn("final", F.max_by("ltv", "offset").over(Window.partitionBy("cohort")))
    return last.groupBy("cohort").agg(F.min(F.when(F.col("ltv") >= share * F.col("final"), F.col("offset"))).alias("mature_at"))


def cohort_benchmark(cells: DataFrame, oldest: int = 3, points: float = 0.05) -> DataFrame:
    """Rates against the mean of the oldest cohorts per offset; deviations of more than so many points."""
    rows = cells.withColumn("k", F.dense_rank().over(Window.orderBy("cohort")))  # cohort cells
    base = rows.where(F.col("k") <= oldest).groupBy("offset").agg(F.avg("rate").alias("benchmark"))
    return rows.where(F.col("k") > oldest).join(base, "offset").select("cohort", "offset", "rate", "benchmark").where(F.abs(F.col("rate") - F.col("benchmark")) > points)


def cohort_checks(cells: DataFrame) -> DataFrame:
    """Small cohorts, rises of retention, and the spread of cohort sizes."""
    w = Window.partitionBy("cohort").orderBy("offset")
    rows = cells.withColumn("up", (F.col("rate") > F.lag("rate").over(w)).cast("int"))
    return rows.agg(F.count_distinct(F.when(F.col("small"), F.col("cohort"))).alias("n_small"), F.coalesce(F.sum("up"), F.lit(0)).alias("n_rises"), F.try_divide(F.max("size"), F.min("size")).alias("size_ratio"), F.count_distinct("cohort").alias("n_cohorts"))


def cohort_gaps(cells: DataFrame, unit: str = "month") -> DataFrame:
    """(kind, cohort, offset): periods between the first and the last cohort without one, and offsets of a cohort at which nobody
    was active though someone was later."""
    have = cells.select("cohort").distinct()
    missing = spine(have.agg(F.min("cohort").alias("lo"), F.max("cohort").alias("hi")), unit).withColumnRenamed("day", "cohort").join(have, "cohort", "left_anti")
    later = F.sum("users").over(Window.partitionBy("cohort").orderBy("offset").rowsBetween(1, Window.unboundedFollowing))  # a row an offset
    silent = cells.withColumn("later", later).where("users = 0 AND later > 0")
    return missing.select(F.lit("cohort").alias("kind"), "cohort", F.lit(None).cast("int").alias("offset")).unionAll(silent.select(F.lit("offset").alias("kind"), "cohort", F.col("offset").cast("int").alias("offset")))


def funnel(df: DataFrame, user: str, at: str, kind: str, steps: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Users per step in order of time, step and overall rate, median seconds from the step before; by segments of the rows."""
    keys = [*by, "u"]
    e = df.where(F.col(user).isNotNull() & F.col(kind).isin(list(steps))).select(*by, F.col(user).alias("u"), F.col(at).alias("t"), F.col(kind).alias("k"))
    done = e.where(F.col("k") == steps[0]).groupBy(*keys).agg(F.min("t").alias("t0"))
    for i, step in enumerate(steps[1:], 1):
        nxt = e.where(F.col("k") == step).select(*keys, "t").join(done.select(*keys, F.col(f"t{i - 1}").alias("p")), keys).where("t >= p").groupBy(*keys).agg(F.min("t").alias(f"t{i}"))
        done = done.join(nxt, keys, "left")
    secs = lambda i: F.percentile((F.unix_micros(F.col(f"t{i}").cast("timestamp")) - F.unix_micros(F.col(f"t{i - 1}").cast("timestamp"))) / 1e6, 0.5)
    row = done.groupBy(*by).agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(len(steps))], *[secs(i).alias(f"s{i}") for i in range(1, len(steps))])
    cells = [F.struct(F.lit(i).alias("step"), F.lit(s).alias("name"), F.col(f"n{i}").alias("users"), (F.col(f"n{i - 1}") if i else F.col("n0")).alias("before"), F.col("n0").alias("start"), (F.col(f"s{i}") if i else F.lit(None).cast("double")).alias("median_seconds")) for i, s in enumerate(steps)]
    out = row.select(*by, F.explode(F.array(*cells)).alias("x")).select(*by, "x.*")
    return out.select(*by, "step", "name", "users", F.try_divide("users", "before").alias("step_rate"), F.try_divide("users", "start").alias("overall_rate"), (F.col("before") - F.col("users")).alias("drop"), "median_seconds")


def largest_drops(steps: DataFrame) -> DataFrame:
    """The step of a funnel that loses most users, and the one that loses the greatest share."""
    later = steps.where("step > 0").withColumn("lost", 1 - F.col("step_rate"))
    return later.agg(F.max_by("name", F.struct("drop", -F.col("step"))).alias("most_users"), F.max("drop").alias("users_lost"), F.max_by("name", F.struct("lost", -F.col("step"))).alias("most_share"), F.max("lost").alias("share_lost"))


def drivers(df: DataFrame, target: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Columns by the strength of their correlation with a target."""
    wide = df.agg(*[F.corr(target, c).alias(c) for c in columns])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("x")).select("x.*")
    return rows.orderBy(F.desc(F.abs("r")), "column").limit(k)


def high_low(df: DataFrame, metric: str, attributes: Sequence[str]) -> DataFrame:
    """Means of attributes above and at or below the median of a metric."""
    cut = one_row(df, {metric: F.col(metric)}, {"cut": 0.5}).toDF("_cut")
    rows = df.crossJoin(F.broadcast(cut)).withColumn("_high", F.col(metric) > F.col("_cut"))  # one row
    wide = rows.agg(*[F.avg(F.when(F.col("_high"), F.col(a))).alias(f"{a}_h") for a in attributes], *[F.avg(F.when(~F.col("_high"), F.col(a))).alias(f"{a}_l") for a in attributes])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"{a}_h").alias("high"), F.col(f"{a}_l").alias("low")) for a in attributes])).alias("x")).select("x.*")


def feature_importance(df: DataFrame, target: str, columns: Sequence[str], seed: int = 7) -> DataFrame:
    """Importances of a random forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    data = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="skip").transform(df.dropna(subset=[target, *columns])).select("_x", F.col(target).alias("_y"))
    model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=10, maxDepth=4, seed=seed).fit(data)
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray(), strict=True)], "column string, importance double")


def period_change(df: DataFrame, day: str, unit: str, value: Column) -> DataFrame:
    """A measure per calendar period (empty ones are zero) with its change; a previous zero is "new"."""
    g = df.groupBy(F.date_trunc(unit, day).cast("date").alias("day")).agg(value.alias("v"))
    full = spine(g.agg(F.min("day").alias("lo"), F.max("day").alias("hi")), unit).join(g, "day", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    p = F.lag("v").over(Window.orderBy("day"))
    full = full.withColumn("previous", p)
    return full.select("day", "v", "previous", F.try_divide(F.col("v") - F.col("previous"), F.abs("previous")).alias("change"), F.when((F.col("previous") == 0) & (F.col("v") != 0), "new").otherwise("known").alias("kind"))


def comparisons(df: DataFrame, day: str, unit: str, num: Column, den: Column | None = None) -> DataFrame:
    """(day, value, previous, year_ago, change, change_of_year): a measure a month or quarter against the period before and the
    same one a year before.

    A rate is the sum of num over that of den within the period, so rates are re-aggregated and never averaged. Periods
    without rows have no value and still take their place.
    """
    back = {"month": 12, "quarter": 4}[unit]
    g = df.groupBy(F.date_trunc(unit, day).cast("date").alias("day")).agg((F.sum(num) if den is None else F.try_divide(F.sum(num), F.sum(den))).alias("value"))
    full = spine(g.agg(F.min("day").alias("lo"), F.max("day").alias("hi")), unit).join(g, "day", "left")
    w = Window.orderBy("day")  # an aggregated series
    full = full.withColumns({"previous": F.lag("value").over(w), "year_ago": F.lag("value", back).over(w)})
    change = lambda c: F.try_divide(F.col("value") - F.col(c), F.abs(c))
    return full.select("day", "value", "previous", "year_ago", change("previous").alias("change"), change("year_ago").alias("change_of_year"))


def rolling(series: DataFrame, order: str, value: str, k: int) -> DataFrame:
    w = Window.orderBy(order)  # an aggregated series
    return series.select(order, value, F.avg(value).over(w.rowsBetween(-(k - 1), 0)).alias("rolling"), F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))


def granularity(df: DataFrame, day: str) -> DataFrame:
    span = df.agg(F.datediff(F.max(day), F.min(day)).alias("days"))
    return span.withColumn("unit", F.when(F.col("days") < 90, "day").when(F.col("days") <= 365, "week").when(F.col("days") <= 3 * 365, "month").otherwise("quarter"))


def change_anomalies(series: DataFrame, order: str, value: str) -> DataFrame:
    """Changes of more than twice the mean absolute change."""
    rows = series.withColumn("change", F.col(value) - F.lag(value).over(Window.orderBy(order)))  # an aggregated series
    rows = rows.withColumn("usual", F.avg(F.abs("change")).over(Window.partitionBy()))
    return rows.where(F.abs("change") > 2 * F.col("usual"))


def structural_break(series: DataFrame, order: str, value: str) -> DataFrame:
    """Mean, variance and slope of the first and second half of a series."""
    w = Window.orderBy(order)  # an aggregated series
    rows = series.withColumns({"half": F.ntile(2).over(w), "x": F.row_number().over(w).cast("double")})
    return rows.groupBy("half").agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.regr_slope(value, "x").alias("slope"))


def divergence(df: DataFrame, segment: str, day: str, metric: str) -> DataFrame:
    """Slope of daily means by segment, and whether it goes against the majority."""
    d = df.groupBy(segment, F.col(day).cast("date").alias("day")).agg(F.avg(metric).alias("v"))
    s = d.groupBy(segment).agg(F.regr_slope("v", F.unix_date("day").cast("double")).alias("slope"))
    return s.withColumn("against", F.signum("slope") != F.signum(F.sum(F.signum("slope")).over(Window.partitionBy())))


def contributions(df: DataFrame, dims: Sequence[str], value: str, is_now: Column) -> DataFrame:
    """Excess of the anomaly period over the baseline by dimension value, and its share of all excess."""
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in dims])
    rows = df.select(is_now.alias("now"), F.col(value).alias("v"), F.explode(cells).alias("x"))
    g = rows.groupBy("x.dim", "x.value").agg(F.coalesce(F.sum(F.when(F.col("now"), F.col("v"))), F.lit(0.0)).alias("now"), F.coalesce(F.sum(F.when(~F.col("now"), F.col("v"))), F.lit(0.0)).alias("before"))
    g = g.withColumn("excess", F.col("now") - F.col("before"))
    return g.withColumn("share", F.try_divide("excess", F.sum("excess").over(Window.partitionBy("dim"))))


def explained(shares: DataFrame) -> DataFrame:
    """Dimensions by how much their first (over half: HIGH) or first two values (over 70 percent: MEDIUM) explain."""
    w = Window.partitionBy("dim").orderBy(F.desc("share"), "value")
    top = shares.withColumn("k", F.row_number().over(w)).where("k <= 2").groupBy("dim").agg(F.max_by("value", -F.col("k")).alias("top_value"), F.max(F.when(F.col("k") == 1, F.col("share"))).alias("top1"), F.sum("share").alias("top2"))
    return top.withColumn("power", F.when(F.col("top1") > 0.5, "HIGH").when(F.col("top2") > 0.7, "MEDIUM").otherwise("LOW"))


def root_cause(df: DataFrame, dims: Sequence[str], value: str, is_now: Column, depth: int = 7, least: float = 0.1) -> DataFrame:
    """Path of isolated values: at each level the value with the greatest share, until little is left or no dimension."""
    path, rest, left = [], list(dims), 1.0
    while rest and len(path) < depth and left >= least:
        row = explained(contributions(df, rest, value, is_now)).orderBy(F.desc("top1"), "dim").first()  # one row a dimension
        if row is None or row["top1"] is None:
            break
        left = left * float(row["top1"])
        path.append((len(path) + 1, row["dim"], row["top_value"], float(row["top1"]), row["power"]))
        df = df.where(F.col(row["dim"]).cast("string") == row["top_value"])
        rest.remove(row["dim"])
    return df.sparkSession.createDataFrame(path, "level int, dim string, value string, share double, power string")


def excess(series: DataFrame, order: str, value: str, split: str) -> DataFrame:
    """Rows from the split on against the baseline before it: expected mean, excess and z."""
    base = series.where(F.col(order) < F.lit(split).cast("date")).agg(F.avg(value).alias("expected"), F.stddev_samp(value).alias("sd"))
    rows = series.where(F.col(order) >= F.lit(split).cast("date")).crossJoin(F.broadcast(base))  # one row
    return rows.select(order, value, "expected", (F.col(value) - F.col("expected")).alias("excess"), F.try_divide(F.col(value) - F.col("expected"), F.col("sd")).alias("z"))


def anomaly_period(series: DataFrame, day: str, value: str, by: Sequence[str] = (), drift: float = 0.5) -> DataFrame:
    """(by, direction, first_day, last_day, n_days, score, actual, expected, excess, excess_pct) of the most anomalous run of days.

    A day scores how many standard deviations it lies above its segment's mean less ``drift`` (for drops: below it), so a run
    grows while days stay off on one side, and the run with the greatest sum is the anomaly; of equal sums the one that
    ends first, begun earliest. The sum of a run is that of all days up to its end less the least before it: two running
    states over days sorted once, however many the segments are. Days without a value are left out; a segment whose
    days are all equal, or none of which is off by more than drift, has no row.
    """
    names, by = dict(zip(own := [f"_k{i}" for i in range(len(by))], by, strict=True)), own  # no clash with columns of the caller
    rows = series.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for k, c in names.items()], F.col(day).alias("day"), F.col(value).cast("double").alias("v"))
    base = rows.groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd")).where("sd > 0")
    keys = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]
    z = rows.alias("r").join(base.alias("b"), reduce(lambda p, q: p & q, keys, F.lit(True))).select(*[f"r.{k}" for k in by], "day", "v", "mean", ((F.col("v") - F.col("mean")) / F.col("sd")).alias("z"))
    z = z.withColumn("direction", F.explode(F.array(F.lit("above"), F.lit("below"))))
    z = z.withColumn("score", F.when(F.col("direction") == "above", F.col("z")).otherwise(-F.col("z")) - drift).drop("z")
    line = [*by, "direction"]
    parts = scanned(dealt(z, line, ["day"]), line, ["day"], {"s": ("sum", F.col("score")), "sv": ("sum", F.col("v")), "n": ("sum", F.lit(1).cast("long"))})
    start = F.struct(F.round(F.col("s") - F.col("score"), 6).alias("s"), F.col("day").alias("day"), (F.col("sv") - F.col("v")).alias("sv"), (F.col("n") - 1).alias("n"))
    runs = scanned(parts, line, ["day"], {"begin": ("min", start)})
    runs = runs.select(*by, "direction", F.col("begin.day").alias("first_day"), F.col("day").alias("last_day"), (F.col("n") - F.col("begin.n")).alias("n_days"), F.round(F.col("s") - F.col("begin.s"), 6).alias("score"), (F.col("sv") - F.col("begin.sv")).alias("actual"), "mean")
    best = runs.groupBy(*by).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in by]), F.struct("score", -F.unix_date(F.col("last_day").cast("date")), F.when(F.col("direction") == "above", 1).otherwise(0))).alias("x"))
    out = best.select(*[F.col(k).alias(c) for k, c in names.items()], "x.*").where("score > 0").withColumn("expected", F.col("mean") * F.col("n_days")).drop("mean")
    return out.withColumn("excess", F.col("actual") - F.col("expected")).withColumn("excess_pct", 100 * F.try_divide(F.col("excess"), F.abs("expected")))


def opportunity(df: DataFrame, affected: Column, value: str, improvement: float, factors: Sequence[float] = (0.5, 0.75, 1.0, 1.25, 1.5)) -> DataFrame:
    """Affected rows x improvement x mean value over a grid of factors."""
    base = df.agg(F.count_if(affected).alias("n"), F.avg(F.when(affected, F.col(value))).alias("unit"))
    grid = df.sparkSession.createDataFrame([(float(f),) for f in factors], "factor double")
    return base.crossJoin(grid).withColumn("size", F.col("n") * improvement * F.col("unit") * F.col("factor"))  # one row x a short list


def mix_rate(df: DataFrame, segment: str, hit: Column, is_now: Column) -> DataFrame:
    """Change of a rate between two periods split into rate, mix and interaction effects by segment."""
    g = df.groupBy(segment).agg(*[F.count_if(is_now == F.lit(x)).alias(f"n{i}") for i, x in enumerate((False, True))], *[F.count_if(hit & (is_now == F.lit(x))).alias(f"h{i}") for i, x in enumerate((False, True))])
    all_ = Window.partitionBy()
    for i in (0, 1):
        g = g.withColumns({f"s{i}": F.col(f"n{i}") / F.sum(f"n{i}").over(all_), f"r{i}": F.coalesce(F.try_divide(f"h{i}", f"n{i}"), F.lit(0.0))})
    return g.select(segment, (F.col("s0") * (F.col("r1") - F.col("r0"))).alias("rate_effect"), ((F.col("s1") - F.col("s0")) * F.col("r0")).alias("mix_effect"), ((F.col("s1") - F.col("s0")) * (F.col("r1") - F.col("r0"))).alias("interaction"))


def nps(df: DataFrame, segment: str, score: Column) -> DataFrame:
    return df.groupBy(segment).agg(F.count("*").alias("n"), (100.0 * F.try_divide(F.count_if(score >= 9) - F.count_if(score <= 6), F.count(score))).alias("nps"))


def new_returning(df: DataFrame, user: str, day: str) -> DataFrame:
    """Distinct purchasers a month who are new or were seen before, over the full history."""
    e = df.where(F.col(user).isNotNull()).select(F.col(user).alias("u"), F.date_trunc("month", day).cast("date").alias("month")).distinct()
    e = e.withColumn("first", F.min("month").over(Window.partitionBy("u")))
    return e.groupBy("month").agg(F.count_if(F.col("month") == F.col("first")).alias("n_new"), F.count_if(F.col("month") > F.col("first")).alias("n_returning"))
