"""Data validation: every check is a DataFrame of result rows.

Result rows are (check, column, n_bad, n, rate, status). All scalar checks of a
table compile into one aggregate; checks over keys, joins or order are jobs of
their own. Statuses: PASS, WARNING, SEVERE, BLOCKER (validators) and PASS, WARN,
FAIL (checks), as the operators' definitions have them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import one_row, running
from .profiling import family, islands, spine, unpivot


def band(rate: Column, *steps: tuple[float, str], strict: bool = True) -> Column:
    """The first status whose bound the rate exceeds (or reaches, if not strict), else PASS."""
    out = F.lit("PASS")
    for bound, status in reversed(steps):
        out = F.when(rate > bound if strict else rate >= bound, status).otherwise(out)
    return out


def rule_checks(df: DataFrame, rules: dict[str, Column], blocker: float = 0.05) -> DataFrame:
    """One pass over all row rules {name: condition that a bad row meets}; over blocker BLOCKER, any WARNING."""
    per = {name: {"n_bad": F.count_if(F.coalesce(bad, F.lit(False))), "n": F.count("*")} for name, bad in rules.items()}
    out = unpivot(df, per).withColumnRenamed("column", "check")
    rate = F.coalesce(F.try_divide(F.col("n_bad"), F.col("n")), F.lit(0.0))
    return out.withColumn("rate", rate).withColumn("status", band(F.col("rate"), (blocker, "BLOCKER"), (0, "WARNING")))


def schema_check(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Missing columns BLOCKER, other type families WARNING, extra columns listed."""
    have = {f.name: f.dataType for f in df.schema}
    rows = [(f.name, "missing", "BLOCKER") if f.name not in have else (f.name, "type", "WARNING") if family(have[f.name]) != family(f.dataType) else (f.name, "ok", "PASS") for f in expected]
    rows += [(c, "extra", "PASS") for c in have if c not in expected.names]
    return df.sparkSession.createDataFrame(rows, "column string, finding string, status string")


def primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    null = df.agg(F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).alias("n_null"), F.count("*").alias("n"))
    dup = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n_dup_keys"), F.coalesce(F.sum("count"), F.lit(0)).alias("n_dup_rows"))
    return null.crossJoin(dup).withColumn("status", F.when((F.col("n_null") > 0) | (F.col("n_dup_keys") > 0), "BLOCKER").otherwise("PASS"))  # one row each


def duplicate_keys(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k most repeated keys, with deterministic ties."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), *keys).limit(k)


def completeness(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    out = unpivot(df, {c: {"n_null": F.count_if(F.col(c).isNull()), "n": F.count("*")} for c in columns})
    rate = F.coalesce(F.try_divide("n_null", "n"), F.lit(0.0))
    status = F.when(F.col("rate") > 0.5, "BLOCKER").when(F.col("rate") > 0.2, "SEVERE").when(F.col("rate") >= 0.05, "WARNING").otherwise("PASS")
    return out.withColumn("rate", rate).withColumn("status", status).withColumn("passed", 1 - F.col("rate") >= threshold)


def null_bands(df: DataFrame, columns: Sequence[str], warn: float = 0.05, fail: float = 0.5) -> DataFrame:
    out = unpivot(df, {c: {"n_null": F.count_if(F.col(c).isNull()), "n": F.count("*")} for c in columns})
    return out.withColumn("rate", F.coalesce(F.try_divide("n_null", "n"), F.lit(0.0))).withColumn("status", band(F.col("rate"), (fail, "FAIL"), (warn, "WARN")))


def date_range(df: DataFrame, day: str, first: str, last: str, max_gap: int = 1) -> DataFrame:
    """Days outside the expected range, and gaps of more than max_gap days between days present."""
    d = df.where(F.col(day).isNotNull()).select(F.col(day).cast("date").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.orderBy("day")))  # distinct days only
    return d.withColumn("gap", gap).agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count_if((F.col("day") < F.lit(first).cast("date")) | (F.col("day") > F.lit(last).cast("date"))).alias("n_outside"), F.count_if(F.col("gap") > max_gap).alias("n_gaps"), F.max("gap").alias("longest_gap"))


def row_count(df: DataFrame, low: int, high: int | None = None) -> DataFrame:
    out = df.agg(F.count("*").alias("n"))
    return out.withColumn("status", F.when((F.col("n") < low) | (F.col("n") > high if high is not None else F.lit(False)), "BLOCKER").otherwise("PASS"))


def referential(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent; nulls are ignored, but the rate is over all child rows."""
    orphans = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")
    out = orphans.agg(F.count("*").alias("n_orphans"), F.count_distinct(key).alias("n_orphan_keys")).crossJoin(child.agg(F.count("*").alias("n")))  # one row each
    return out.withColumn("rate", F.coalesce(F.try_divide("n_orphans", "n"), F.lit(0.0))).withColumn("status", band(F.col("rate"), (0.05, "BLOCKER"), (0, "WARNING")))


def totals_agree(detail: DataFrame, summary: DataFrame, metric: str, tolerance: float = 0.01) -> DataFrame:
    out = detail.agg(F.sum(metric).alias("detail")).crossJoin(summary.agg(F.sum(metric).alias("summary")))  # one row each
    gap = F.try_divide(F.abs(F.col("detail") - F.col("summary")), F.abs("summary"))
    return out.withColumn("status", F.when(gap > tolerance, "BLOCKER").otherwise("PASS"))


def percentages(df: DataFrame, pct: str, group: str, expected: float = 100.0, tolerance: float = 0.5) -> DataFrame:
    """Groups whose percentages do not sum to the expected total: how many, and the worst."""
    g = df.groupBy(F.col(group).alias("g")).agg(F.sum(pct).alias("total")).withColumn("off", F.abs(F.col("total") - expected))
    out = g.agg(F.count("*").alias("n"), F.count_if(F.col("off") > tolerance).alias("n_bad"), F.max("off").alias("worst"), F.max_by("g", F.struct("off", "g")).alias("worst_group"))
    return out.withColumn("status", F.when(F.col("worst") <= tolerance, "PASS").when(F.col("worst") <= 2 * tolerance, "WARN").otherwise("FAIL"))


def ratio_bounds(df: DataFrame, num: str, den: str, low: float, high: float) -> DataFrame:
    r = F.try_divide(F.col(num), F.col(den))
    out = df.agg(F.count_if(F.col(den) == 0).alias("n_zero_den"), F.count_if(r.isNotNull() & ~r.between(low, high)).alias("n_bad"), F.count(r).alias("n"))
    return out.withColumn("status", F.when(F.col("n_bad") > 0, "BLOCKER").otherwise("PASS"))


def column_bounds(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0, slack: float = 1e-9) -> DataFrame:
    c = F.col(column)
    out = df.agg(F.count(c).alias("n"), F.count_if(c < low - slack).alias("n_low"), F.count_if(c > high + slack).alias("n_high"), F.min(c).alias("min"), F.max(c).alias("max"))
    return out.withColumn("status", F.when(F.col("n_low") + F.col("n_high") > 0, "FAIL").otherwise("PASS"))


def group_balance(df: DataFrame, group: str, least: int = 10, ratio: float = 100.0) -> DataFrame:
    g = df.groupBy(group).agg(F.count("*").alias("n"))
    out = g.agg(F.count("*").alias("n_groups"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count_if(F.col("n") < least).alias("n_small"))
    out = out.withColumn("ratio", F.try_divide("largest", "smallest"))
    return out.withColumn("status", F.when((F.col("n_small") > 0) | (F.col("ratio") > ratio), "WARNING").otherwise("PASS"))


def future_dates(df: DataFrame, day: str, as_of: str) -> DataFrame:
    out = df.agg(F.count_if(F.col(day).cast("date") > F.lit(as_of).cast("date")).alias("n_future"), F.count(day).alias("n"))
    return out.withColumn("status", F.when(F.col("n_future") > 0, "BLOCKER").otherwise("PASS"))


def segment_exhaustive(df: DataFrame, segment: str, metric: str) -> DataFrame:
    """Null segments, or a total of named segments more than 1 percent off the whole, block."""
    out = df.agg(F.count_if(F.col(segment).isNull()).alias("n_null"), F.sum(metric).alias("total"), F.sum(F.when(F.col(segment).isNotNull(), F.col(metric))).alias("in_segments"))
    gap = F.coalesce(F.try_divide(F.abs(F.col("total") - F.col("in_segments")), F.abs("total")), F.lit(0.0))
    return out.withColumn("gap", gap).withColumn("status", F.when((F.col("n_null") > 0) | (F.col("gap") > 0.01), "BLOCKER").otherwise("PASS"))


def date_consistency(df: DataFrame, day: str, metric: str) -> DataFrame:
    """Missing, duplicated and (inside the range) zero or null days; over 10 percent or any duplicate blocks."""
    d = df.groupBy(F.col(day).cast("date").alias("day")).agg(F.count("*").alias("c"), F.sum(metric).alias("v")).where("day IS NOT NULL")
    span = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count_if(F.col("c") > 1).alias("n_duplicate"))
    full = spine(span).join(d, "day", "left").crossJoin(F.broadcast(span))  # span is one row
    out = full.agg(F.count("*").alias("n_expected"), F.count_if(F.col("c").isNull()).alias("n_missing"), F.max("n_duplicate").alias("n_duplicate"), F.count_if(F.col("c").isNotNull() & (F.col("day") > F.col("lo")) & (F.col("day") < F.col("hi")) & (F.coalesce("v", F.lit(0)) == 0)).alias("n_zero"))
    rate = F.try_divide(F.col("n_missing") + F.col("n_duplicate") + F.col("n_zero"), F.col("n_expected"))
    return out.withColumn("rate", rate).withColumn("status", F.when((F.col("rate") > 0.1) | (F.col("n_duplicate") > 0), "BLOCKER").when(F.col("rate") > 0, "WARNING").otherwise("PASS"))


def identities(df: DataFrame, rules: dict[str, tuple[str, str]], tolerance: float = 0.05) -> DataFrame:
    """Declared identities (left and right as SQL text) checked on every row: rows off by more than the tolerance."""
    per = {}
    for name, (left, right) in rules.items():
        l, r = F.expr(left), F.expr(right)
        gap = F.try_divide(F.abs(l - r), F.abs(r))
        per[name] = {"n_bad": F.count_if(gap > tolerance), "n": F.count("*"), "worst": F.max(gap)}
    return unpivot(df, per).withColumn("status", F.when(F.col("n_bad") > 0, "FAIL").otherwise("PASS"))


def graded(observed: Column, stated: Column, tolerance: float) -> Column:
    """PASS within the tolerance, WARN up to ten times it, else FAIL (also when it cannot be computed)."""
    gap = F.when(stated == 0, F.abs(observed)).otherwise(F.try_divide(F.abs(observed - stated), F.abs(stated)))
    return F.when(gap <= tolerance, "PASS").when(gap <= 10 * tolerance, "WARN").otherwise("FAIL")


def parts_to_whole(parts: DataFrame, totals: DataFrame, key: str, part: str, total: str, tolerance: float = 0.01) -> DataFrame:
    p = parts.groupBy(F.col(key).alias("_k")).agg(F.sum(part).alias("parts"))
    both = totals.select(F.col(key), F.col(total).alias("total")).join(p, F.col(key) == F.col("_k"), "left").drop("_k")
    return both.withColumn("status", graded(F.coalesce("parts", F.lit(0)), F.col("total"), tolerance))


def ratio_recompute(df: DataFrame, num: str, den: str, stated: str, tolerance: float = 0.001) -> DataFrame:
    ratio = F.try_divide(F.col(num), F.col(den))
    return df.withColumn("status", F.when(ratio.isNull(), "FAIL").otherwise(graded(ratio, F.col(stated), tolerance)))


def claim_bounds(claims: DataFrame) -> DataFrame:
    """Claims (claim_id, kind, value, denominator, day, as_of) against the bounds of their kind."""
    bad = F.when(F.col("kind") == "money", F.col("value") < 0).when(F.col("kind") == "percent", ~F.col("value").between(0, 100)).when(F.col("kind") == "ratio", F.col("denominator") == 0).when(F.col("kind") == "date", F.col("day") > F.col("as_of"))
    return claims.withColumn("status", F.when(F.coalesce(bad, F.lit(False)), "FAIL").otherwise("PASS"))


def cardinality(df: DataFrame, column: str, low: int, high: int) -> DataFrame:
    out = df.agg(F.count_distinct(column).alias("n_unique"))
    return out.withColumn("status", F.when(F.col("n_unique").between(low, high), "PASS").otherwise("WARNING"))


def rates(df: DataFrame, num: str, den: str, low: float, high: float) -> DataFrame:
    r = F.try_divide(F.col(num), F.col(den))
    g = df.agg(F.count_if(F.col(den) == 0).alias("n_zero_den"), F.count_if(r.isNotNull() & ~r.between(low, high)).alias("n_outside"), F.avg(r).alias("mean"), F.min(r).alias("min"), F.max(r).alias("max"))
    return g.crossJoin(one_row(df, {"rate": r}, {"median": 0.5}).toDF("median")).select("n_zero_den", "n_outside", "mean", "median", "min", "max")  # one row each


def change_check(series: DataFrame, order: str, value: str, limit: float, lag: int = 1) -> DataFrame:
    """Change against the value lag rows before: over the limit BLOCKER, over half WARNING; from zero counts as infinite."""
    before = F.lag(value, lag).over(Window.orderBy(order))  # an aggregated series
    out = series.withColumn("previous", before).where("previous IS NOT NULL")
    change = F.when((F.col("previous") == 0) & (F.col(value) != 0), F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide(F.abs(F.col(value) - F.col("previous")), F.abs("previous")), F.lit(0.0)))
    return out.withColumn("change", change).withColumn("status", band(F.col("change"), (limit, "BLOCKER"), (limit / 2, "WARNING")))


def outliers(df: DataFrame, column: str, method: str = "iqr", width: float | None = None) -> DataFrame:
    """Values beyond quartiles + width x IQR (1.5) or beyond width standard deviations (3)."""
    c = F.col(column).cast("double")
    if method == "iqr":
        w = 1.5 if width is None else width
        q = one_row(df, {"c": c}, {"q1": 0.25, "q3": 0.75})
        q = q.select((F.col("c_q1") - w * (F.col("c_q3") - F.col("c_q1"))).alias("lo"), (F.col("c_q3") + w * (F.col("c_q3") - F.col("c_q1"))).alias("hi"))
    else:
        w = 3.0 if width is None else width
        q = df.agg((F.avg(c) - w * F.stddev_samp(c)).alias("lo"), (F.avg(c) + w * F.stddev_samp(c)).alias("hi"))
    out = df.crossJoin(F.broadcast(q)).agg(F.count(c).alias("n"), F.count_if((c < F.col("lo")) | (c > F.col("hi"))).alias("n_outliers"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))  # bounds are one row
    rate = F.try_divide("n_outliers", "n")
    return out.withColumn("status", F.when(F.col("n") < 4, "PASS").when(rate < 0.05, "PASS").when(rate < 0.15, "WARN").otherwise("FAIL"))


def sanity(df: DataFrame, column: str, rate_column: bool = False, skew_limit: float = 3.0) -> DataFrame:
    c = F.col(column).cast("double")
    n = F.count(c).cast("double")
    out = df.agg(F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.count_if(~c.between(0, 1)).alias("n_outside"))
    out = one_row(df, {"c": c}, {"p1": 0.01, "p99": 0.99}).toDF("p1", "p99").crossJoin(out)  # one row each
    return out.withColumn("status", F.when((F.abs("skew") > skew_limit) | (F.lit(rate_column) & (F.col("n_outside") > 0)), "WARN").otherwise("PASS"))


def freshness(df: DataFrame, day: str, as_of: str) -> DataFrame:
    """Cadence from the middle gap between days, staleness by cadence; data over 90 days old is historical."""
    d = df.where(F.col(day).isNotNull()).select(F.col(day).cast("date").alias("day")).distinct()
    gaps = d.select("day", F.datediff("day", F.lag("day").over(Window.orderBy("day"))).alias("gap"))
    ranked = gaps.where("gap IS NOT NULL").withColumn("r", F.row_number().over(Window.orderBy("gap"))).crossJoin(F.broadcast(gaps.agg(F.count("gap").alias("m"))))  # one row
    middle = ranked.agg(F.max(F.when(F.col("r") == F.expr("m div 2") + 1, F.col("gap"))).alias("middle_gap"))
    out = d.agg(F.max("day").alias("last")).crossJoin(middle).withColumn("age", F.datediff(F.lit(as_of).cast("date"), F.col("last")))  # one row each
    cadence = F.when(F.col("middle_gap") <= 1.5, "daily").when(F.col("middle_gap") <= 8, "weekly").otherwise("other")
    out = out.withColumn("cadence", cadence)
    stale = F.when(F.col("cadence") == "daily", F.col("age") > 2).when(F.col("cadence") == "weekly", F.col("age") > 10).otherwise(False)
    return out.withColumn("status", F.when(F.col("age") > 90, "historical").when(stale, "stale").otherwise("fresh"))


def coverage(df: DataFrame, day: str, unit: str = "day", max_gap: int | None = None) -> DataFrame:
    """Periods present of those expected; complete PASS, 95 percent WARN, else FAIL; more than max_gap missing in a row FAIL."""
    d = df.where(F.col(day).isNotNull()).select(F.date_trunc(unit, day).cast("date").alias("day")).distinct()
    span = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    out = spine(span, unit).join(d.withColumn("have", F.lit(1)), "day", "left").agg(F.count("*").alias("n_expected"), F.count("have").alias("n_present"))
    out = out.withColumn("coverage", F.try_divide("n_present", "n_expected"))
    status = F.when(F.col("n_present") == F.col("n_expected"), "PASS").when(F.col("coverage") >= 0.95, "WARN").otherwise("FAIL")
    if max_gap is None:
        return out.withColumn("status", status)
    longest = coverage_gaps(df, day, unit).agg(F.coalesce(F.max("n"), F.lit(0)).alias("longest_gap"))
    return out.crossJoin(longest).withColumn("status", F.when(F.col("longest_gap") > max_gap, "FAIL").otherwise(status))  # one row each


def coverage_gaps(df: DataFrame, day: str, unit: str = "day") -> DataFrame:
    """(first, last, n) of every run of missing periods."""
    d = df.where(F.col(day).isNotNull()).select(F.date_trunc(unit, day).cast("date").alias("day")).distinct()
    missing = spine(d.agg(F.min("day").alias("lo"), F.max("day").alias("hi")), unit).join(d, "day", "left_anti")
    return islands(missing, unit)


def dominance(df: DataFrame, columns: Sequence[str], share: float = 0.5) -> DataFrame:
    """Columns of which one value holds more than a share of all rows."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counts = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = counts.groupBy("column").agg(F.max_by("value", F.struct("n", "value")).alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return out.withColumn("dominant", F.col("n") > share * F.col("total"))


def monotonic(df: DataFrame, order: str, value: str, strict: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Steps that go down (or stay, if strict) in the order of a column, and the first of them; rows of equal order by value."""
    rows = df.select(*by, F.col(order).alias("at"), F.col(value).alias("v"))
    steps = running(rows, by, ["at", "v"], {"p": ("lag", F.col("v"))}).where("p IS NOT NULL")
    bad = F.col("v") <= F.col("p") if strict else F.col("v") < F.col("p")
    return steps.groupBy(*by).agg(F.count_if(bad).alias("n_bad"), F.min(F.when(bad, F.col("at"))).alias("first_bad"), F.count("*").alias("n_steps"))


def rolling_z(series: DataFrame, order: str, value: str, window: int, most: float) -> DataFrame:
    """Rows whose z-score against the previous full window (this row excluded) exceeds a bound."""
    w = Window.orderBy(order).rowsBetween(-window, -1)  # an aggregated series
    rows = series.withColumns({"k": F.count(value).over(w), "m": F.avg(value).over(w), "sd": F.stddev_samp(value).over(w)})
    rows = rows.where((F.col("k") == window) & (F.col("sd") > 0)).withColumn("z", (F.col(value) - F.col("m")) / F.col("sd"))
    return rows.where(F.abs("z") > most).select(order, value, "z")


def continuity(series: DataFrame, order: str, value: str, jump: float = 0.5) -> DataFrame:
    """Relative jumps above a bound; one or two WARNING, more BLOCKER."""
    rows = series.withColumn("p", F.lag(value).over(Window.orderBy(order)))  # an aggregated series
    out = rows.agg(F.count_if(F.try_divide(F.abs(F.col(value) - F.col("p")), F.abs("p")) > jump).alias("n_breaks"))
    return out.withColumn("status", F.when(F.col("n_breaks") == 0, "PASS").when(F.col("n_breaks") <= 2, "WARNING").otherwise("BLOCKER"))


def simpson(df: DataFrame, metric: str, segments: Sequence[str], group: str) -> DataFrame:
    """For each segment column: does the overall order of the two largest groups turn round inside segments?

    One pass over (segment column, value, group) cells; a reversal is a majority of
    segments (with both groups) against the overall order.
    """
    sizes = df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n")).where("g IS NOT NULL")
    two = sizes.orderBy(F.desc("n"), "g").limit(2).agg(F.min("g").alias("ga"), F.max("g").alias("gb"))
    cells = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("value")) for c in segments])
    rows = df.where(F.col(metric).isNotNull()).crossJoin(F.broadcast(two)).where((F.col(group) == F.col("ga")) | (F.col(group) == F.col("gb")))  # one row
    rows = rows.select((F.col(group) == F.col("ga")).alias("is_a"), F.col(metric).cast("double").alias("m"), F.explode(cells).alias("x")).where("x.value IS NOT NULL")
    per = rows.groupBy("x.dim", "x.value").agg(F.sum(F.when(F.col("is_a"), F.col("m"))).alias("sa"), F.count_if("is_a").alias("na"), F.sum(F.when(~F.col("is_a"), F.col("m"))).alias("sb"), F.count_if(~F.col("is_a")).alias("nb"))
    d = F.try_divide("sa", "na") - F.try_divide("sb", "nb")
    out = per.withColumn("d", d).groupBy("dim").agg((F.sum("sa") / F.sum("na") - F.sum("sb") / F.sum("nb")).alias("overall"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    back, along = F.when(F.col("overall") > 0, F.col("down")).otherwise(F.col("up")), F.when(F.col("overall") > 0, F.col("up")).otherwise(F.col("down"))
    out = out.select("dim", "overall", back.alias("n_reversed"), along.alias("n_agree"))
    ratio = F.try_divide("n_reversed", F.col("n_reversed") + F.col("n_agree"))
    return out.withColumns({"paradox": F.col("n_reversed") > F.col("n_agree"), "severity": F.when(ratio > 0.5, "BLOCKER").when(ratio > 0.25, "WARNING").otherwise("PASS")})


def split_at_median(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """df with a group 'high' (above the exact median of a numeric column) or 'low' under ``name``; null stays null."""
    cut = one_row(df, {"c": F.col(column)}, {"median": 0.5}).toDF("_median")
    side = F.when(F.col(column) > F.col("_median"), "high").when(F.col(column) <= F.col("_median"), "low")
    return df.crossJoin(F.broadcast(cut)).withColumn(name or f"{column}_half", side).drop("_median")  # one row


def suggest_segments(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Columns of 2 to 50 values by the variation of their group sizes, weighed down by how many values they have."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*").where("v IS NOT NULL")
    sizes = rows.groupBy("column", "v").agg(F.count("*").alias("n"))
    out = sizes.groupBy("column").agg(F.count("*").alias("n_values"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("cv")).where(F.col("n_values").between(2, 50))
    return out.withColumn("score", F.col("cv") / (1 + F.col("n_values") / 50)).orderBy(F.desc("score"), "column").limit(k)


#: factor -> points: six of 15, two of 10, one of 5
FACTORS = {"completeness": 15, "uniqueness": 15, "referential": 15, "ranges": 15, "consistency": 15, "freshness": 15, "volume": 10, "stability": 10, "documentation": 5}
CREDIT = {"PASS": 1.0, "WARNING": 0.6, "SEVERE": 0.3, "BLOCKER": 0.0}


def scorecard(results: DataFrame, layers: int = 4) -> DataFrame:
    """(table, score, grade) from rows (table, layer, factor, status): the worst status of a factor counts.

    Normalised to the factors that were scored; at best C when a layer is missing.
    """
    credit = F.lit(1.0)
    for s, v in CREDIT.items():
        credit = F.when(F.col("status") == s, v).otherwise(credit)
    points = F.lit(0.0)
    for f, p in FACTORS.items():
        points = F.when(F.col("factor") == f, float(p)).otherwise(points)
    per = results.groupBy("table", "factor").agg(F.min(credit).alias("credit"))
    seen = results.groupBy("table").agg(F.count_distinct("layer").alias("n_layers"))
    out = per.withColumn("points", points).groupBy("table").agg((100 * F.try_divide(F.sum(F.col("credit") * F.col("points")), F.sum("points"))).alias("score")).join(seen, "table")
    grade = F.when(F.col("score") >= 85, "A").when(F.col("score") >= 70, "B").when(F.col("score") >= 55, "C").when(F.col("score") >= 40, "D").otherwise("F")
    capped = (F.col("n_layers") < layers) & F.col("score").__ge__(70)
    return out.withColumn("grade", F.when(capped, "C").otherwise(grade))


def reproducible(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs of one result by row count and order-free checksum."""
    def digest(df: DataFrame, p: str) -> DataFrame:
        h = F.xxhash64(*df.columns)
        return df.agg(F.count("*").alias(f"n_{p}"), F.bit_xor(h).alias(f"x_{p}"), F.sum(h.cast("decimal(38,0)")).alias(f"s_{p}"))

    both = digest(a, "a").crossJoin(digest(b, "b"))  # one row each
    return both.select("n_a", "n_b", F.when(F.col("n_a") != F.col("n_b"), "different").when(F.col("x_a").eqNullSafe(F.col("x_b")) & F.col("s_a").eqNullSafe(F.col("s_b")), "identical").otherwise("values_differ").alias("verdict"))
