"""Table and column profiles: one aggregate pass a table, one row a column."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import cumulated, quantile_columns, stored, value_counts


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "numeric"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "string" if isinstance(kind, T.StringType) else "other"


def unpivot(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregate over df, then one row a column: {column: {field: aggregate}} with equal fields."""
    wide = df.agg(*[e.alias(f"{c}__{k}") for c, es in per_column.items() for k, e in es.items()])
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in es]) for c, es in per_column.items()]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def columns_profile(df: DataFrame) -> DataFrame:
    """Type, nulls, distinct values, numeric moments or string lengths of every column.

    A mean is cut to twelve digits before six, so one that ends in a 5 goes up whatever noise the order of its sum left.
    """
    out = {}
    for f in df.schema:
        c, num, text = F.col(f.name), isinstance(f.dataType, T.NumericType), isinstance(f.dataType, T.StringType)
        n = c.cast("double") if num else F.lit(None).cast("double")
        size = F.length(c).cast("double") if text else F.lit(None).cast("double")
        out[f.name] = {
            "type": F.first(F.lit(f.dataType.simpleString())), "n_null": F.count_if(c.isNull()), "null_pct": F.round(100.0 * F.try_divide(F.count_if(c.isNull()), F.count("*")), 6),
            "min": F.min(n), "max": F.max(n), "mean": F.round(F.round(F.avg(n), 12), 6), "sd": F.round(F.stddev_samp(n), 6),
            "min_length": F.min(size), "max_length": F.max(size), "mean_length": F.round(F.avg(size), 6),
        }
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("v")) for f in df.schema])
    rows = df.select(F.explode(cells).alias("x")).select("x.column", "x.v").where("v IS NOT NULL")
    same = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(7), "v"))  # 128 bits of a value are shuffled, not the value
    unique = rows.groupBy("column", same.alias("v")).count().groupBy("column").agg(F.count("*").alias("n_unique"))
    profile = unpivot(df, out).join(F.broadcast(unique), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))  # a row a column
    return profile.select("column", "type", "n_null", "null_pct", "n_unique", "min", "max", "mean", "sd", "min_length", "max_length", "mean_length")


def sample_values(df: DataFrame, k: int = 5, spread: int = 256) -> DataFrame:
    """(column, values): the k least distinct values of each column as text, so a rerun shows the same.

    Values are counted once and cut to k in so many parts by hash before the k of a column meet.
    """
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").cast("string").alias("v")) for f in df.schema])
    rows = df.select(F.explode(cells).alias("x")).select("x.column", "x.v").where("v IS NOT NULL").distinct()
    part = F.pmod(F.xxhash64("v"), F.lit(spread))
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("column", part).orderBy("v"))).where(F.col("k") <= k)
    return few.groupBy("column").agg(F.slice(F.sort_array(F.collect_list("v")), 1, k).alias("values"))  # of k x spread at most


def date_span(df: DataFrame, name: str) -> DataFrame:
    """Rows, date columns and the range of all of them."""
    days = [f.name for f in df.schema if family(f.dataType) == "datetime"]
    low = F.least(*[F.min(c) for c in days]) if len(days) > 1 else F.min(days[0]) if days else F.lit(None)
    high = F.greatest(*[F.max(c) for c in days]) if len(days) > 1 else F.max(days[0]) if days else F.lit(None)
    return df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"), F.lit(len(days)).alias("n_date_columns"), low.cast("date").alias("first_day"), high.cast("date").alias("last_day"))


def source_profile(tables: dict[str, DataFrame]) -> DataFrame:
    if not tables:
        raise ValueError("no tables")
    out = None
    for name, df in tables.items():
        part = columns_profile(df).select(F.lit(name).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments (bias-corrected skew and kurtosis), exact percentiles, IQR outliers, shape and a transform hint."""
    per = {}
    for name in columns:
        c = F.col(name).cast("double")
        n = F.count(c).cast("double")
        per[name] = {
            "n": F.count(c), "mean": F.avg(c), "sd": F.stddev_samp(c), "min": F.min(c), "max": F.max(c),
            "skew": F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2)),
            "kurtosis": F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6)),
        }
    counts = cumulated(value_counts(df, {c: F.col(c) for c in columns}), ["column"])
    at = {f"p{p}": p / 100 for p in (1, 5, 25, 50, 75, 95, 99)}
    ordered = stored(counts.groupBy("column").agg(F.count("*").alias("n_unique"), *quantile_columns(at)), "quantiles")  # a row a column
    stats = unpivot(df, per).join(F.broadcast(ordered), "column", "left").withColumn("iqr", F.col("p75") - F.col("p25"))
    stats = stats.withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    out = counts.join(F.broadcast(ordered.select("column", "p25", "p75", (F.col("p75") - F.col("p25")).alias("iqr"))), "column")
    out = out.where((F.col("v") < F.col("p25") - 1.5 * F.col("iqr")) | (F.col("v") > F.col("p75") + 1.5 * F.col("iqr"))).groupBy("column").agg(F.sum("n").alias("n_outliers"))
    stats = stats.join(out, "column", "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)))
    shape = F.when((F.abs("skew") < 0.5) & (F.col("kurtosis") < -1), "uniform").when(F.col("kurtosis") > 3, "heavy_tailed").when(F.col("skew") > 1, "right_skewed").when(F.col("skew") < -1, "left_skewed").otherwise("normal")
    hint = F.when((F.col("skew") > 1) & (F.col("min") > 0), "log").when((F.col("skew") > 1) & (F.col("min") >= 0), "sqrt").otherwise("none")
    return stats.withColumns({"shape": shape, "transform": hint})


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, n) of equal-width bins between the least and greatest value, empty bins included."""
    c = F.col(column).cast("double")
    edges = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    at = F.least(F.lit(bins), F.greatest(F.lit(1), F.floor(F.coalesce(F.try_divide(c - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0)) * bins).cast("int") + 1))
    counts = df.where(c.isNotNull()).crossJoin(F.broadcast(edges)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # edges is one row
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def peaks(hist: DataFrame) -> DataFrame:
    """Bins of a histogram (a few dozen rows) that stand above both neighbours; edge bins count."""
    w = Window.orderBy("bin")
    left, right = F.coalesce(F.lag("n").over(w), F.lit(-1)), F.coalesce(F.lead("n").over(w), F.lit(-1))
    return hist.withColumns({"l": left, "r": right}).where((F.col("n") > F.col("l")) & (F.col("n") > F.col("r"))).select("bin", "n")


def two_peaks(hist: DataFrame, valley: float = 0.6) -> DataFrame:
    """Whether a smoothed histogram has two peaks with a valley below a share of the lower one."""
    w = Window.orderBy("bin")
    smooth = hist.select("bin", F.avg("n").over(w.rowsBetween(-1, 1)).alias("n"))
    top = Window.orderBy(F.desc("n"), "bin")
    best = peaks(smooth).withColumn("rank", F.row_number().over(top)).where("rank <= 2").agg(F.count("*").alias("n_peaks"), F.min("bin").alias("a"), F.max("bin").alias("b"), F.min("n").alias("lower"))
    low = smooth.crossJoin(F.broadcast(best)).where((F.col("bin") > F.col("a")) & (F.col("bin") < F.col("b"))).agg(F.min("n").alias("valley"))  # one row
    return best.crossJoin(low).select("n_peaks", F.coalesce((F.col("n_peaks") == 2) & (F.col("valley") < valley * F.col("lower")), F.lit(False)).alias("bimodal"))


def shape_class(df: DataFrame, column: str) -> DataFrame:
    """(column, skew, kurtosis, n_unique, shape) with the class bimodal: two peaks in a smoothed histogram of at most 50 bins, if
    there are more than ten values and neither the uniform nor the heavy-tailed rule applies."""
    row = distributions(df, [column]).select("column", "skew", "kurtosis", "n_unique", "shape")
    bins = row.first()["n_unique"]  # one row
    if not bins or bins <= 10:
        return row
    peaked = two_peaks(histogram(df, column, min(50, bins))).select("bimodal")
    return row.crossJoin(peaked).withColumn("shape", F.when(F.col("bimodal") & ~F.col("shape").isin("uniform", "heavy_tailed"), "bimodal").otherwise(F.col("shape"))).drop("bimodal")  # one row each


def daily(df: DataFrame, day: str, metric: str) -> DataFrame:
    return df.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("day")).agg(F.avg(metric).alias("value"))


def spine(span: DataFrame, unit: str = "day") -> DataFrame:
    """Every period from lo to hi of a one-row frame."""
    return span.select(F.explode(F.sequence(F.col("lo"), F.col("hi"), F.expr("interval 3 months" if unit == "quarter" else f"interval 1 {unit}"))).alias("day"))


def temporal(df: DataFrame, day: str, unit: str = "day") -> DataFrame:
    """Range, expected and present periods, coverage, missing periods and the longest gap."""
    d = df.where(F.col(day).isNotNull()).select(F.date_trunc(unit, day).cast("date").alias("day")).distinct()
    span = d.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("*").alias("present"))
    missing = spine(span, unit).join(d, "day", "left_anti")
    gaps = islands(missing, unit).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing"), F.count("*").alias("n_gaps"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_gap"))
    return span.crossJoin(gaps).withColumn("coverage", F.try_divide("present", F.col("present") + F.col("missing")))  # one row each


def islands(days: DataFrame, unit: str = "day") -> DataFrame:
    """Runs of consecutive periods: (first, last, n)."""
    step = F.expr(f"timestampadd({unit}, -CAST(row_number() OVER (ORDER BY day) AS INT), day)")
    return days.select("day", step.alias("g")).groupBy("g").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n")).drop("g")


def pattern(df: DataFrame, day: str, metric: str, fmt: str) -> DataFrame:
    """Means by weekday (EEEE) or month name (MMMM)."""
    return df.groupBy(F.date_format(day, fmt).alias("period")).agg(F.round(F.avg(metric), 6).alias("mean"), F.count("*").alias("n"))


def trend(df: DataFrame, day: str, metric: str) -> DataFrame:
    """up, down, flat or volatile from the regression of daily means on their position (days, not rows)."""
    d = daily(df, day, metric)
    d = d.withColumn("x", (F.row_number().over(Window.orderBy("day")) - 1).cast("double"))
    fit = d.agg(F.count("*").alias("n"), F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("icept"), F.avg("value").alias("mean"))
    rest = d.crossJoin(F.broadcast(fit)).agg(F.stddev_pop(F.col("value") - F.col("icept") - F.col("slope") * F.col("x")).alias("resid"))  # fit is one row
    out = fit.crossJoin(rest).withColumns({"relative": F.try_divide("slope", F.abs("mean")), "cv": F.try_divide("resid", F.abs("mean"))})
    label = F.when(F.col("n") < 5, "unknown").when(F.col("cv") > 0.5, "volatile").when(F.col("relative") > 0.01, "up").when(F.col("relative") < -0.01, "down").otherwise("flat")
    return out.select("n", "relative", "cv", label.alias("trend"))


def seasonality(df: DataFrame, day: str, metric: str) -> DataFrame:
    """Whether month means vary by more than a fifth (three months at least)."""
    m = df.groupBy(F.month(day).alias("m")).agg(F.avg(metric).alias("v"))
    out = m.agg(F.count("*").alias("n_months"), F.try_divide(F.stddev_pop("v"), F.avg("v")).alias("cv"))
    return out.withColumn("seasonal", (F.col("n_months") >= 3) & (F.col("cv") > 0.2))


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.5) -> DataFrame:
    """Pairs with |r| of at least the threshold, with a strength band; all pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("r")) for a, b in pairs])).alias("x")).select("x.*")
    r = F.abs("r")
    return rows.where(r >= least).withColumn("strength", F.when(r >= 0.9, "very strong").when(r >= 0.7, "strong").otherwise("moderate"))


def completeness(df: DataFrame) -> DataFrame:
    """Nulls, zeros, blanks, constancy and a band for every column."""
    per = {}
    for f in df.schema:
        c = F.col(f.name)
        zero = F.count_if(c == 0) if isinstance(f.dataType, T.NumericType) else F.count_if(F.lit(False))
        blank = F.count_if(F.trim(c) == "") if isinstance(f.dataType, T.StringType) else F.count_if(F.lit(False))
        per[f.name] = {"n": F.count("*"), "n_null": F.count_if(c.isNull()), "n_zero": zero, "n_blank": blank, "constant": F.count_distinct(c) <= 1}
    out = unpivot(df, per)
    share = F.coalesce(F.try_divide(F.col("n_null"), F.col("n")), F.lit(0.0))
    return out.withColumn("band", F.when(share == 0, "complete").when(share < 0.05, "minor").when(share < 0.5, "major").otherwise("critical"))


def anomalies(df: DataFrame, day: str, metrics: Sequence[str], window: int = 14, threshold: float = 0.3) -> DataFrame:
    """Days whose metric is off its trailing mean (current day included) by more than a share of it."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = df.select(F.col(day).cast("date").alias("day"), F.explode(cells).alias("x")).groupBy("day", "x.metric").agg(F.sum("x.value").alias("value"))
    w = Window.partitionBy("metric").orderBy("day").rowsBetween(-(window - 1), 0)
    rows = rows.withColumns({"mean": F.when(F.count("value").over(w) >= 3, F.avg("value").over(w)), "sd": F.when(F.count("value").over(w) >= 3, F.stddev_samp("value").over(w))})
    rows = rows.where("mean <> 0").withColumn("deviation", (F.col("value") - F.col("mean")) / F.abs("mean"))
    return rows.where(F.abs("deviation") > threshold)


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, type, n_rows) of live tables."""
    out = None
    for name, df in tables.items():
        cols = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type")) for f in df.schema])
        part = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), F.explode(cols).alias("c"), "n_rows").select("table", "c.column", "c.type", "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or of another type; only what was removed is breaking."""
    a = old.select(F.col("table").alias("t0"), F.col("column").alias("c0"), F.col("type").alias("old_type"))
    b = new.select(F.col("table").alias("t1"), F.col("column").alias("c1"), F.col("type").alias("new_type"))
    both = a.join(b, (a["t0"] == b["t1"]) & (a["c0"] == b["c1"]), "full_outer")
    change = F.when(F.col("t0").isNull(), "added").when(F.col("t1").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type_changed").otherwise("same")
    out = both.select(F.coalesce("t0", "t1").alias("table"), F.coalesce("c0", "c1").alias("column"), "old_type", "new_type", change.alias("change"))
    return out.where("change <> 'same'").withColumn("breaking", F.col("change") == "removed")


def row_change(old: DataFrame, new: DataFrame) -> DataFrame:
    a, b = old.groupBy("table").agg(F.max("n_rows").alias("old_rows")), new.groupBy("table").agg(F.max("n_rows").alias("new_rows"))
    return a.join(b, "table", "full_outer").withColumn("change_pct", F.try_divide(100.0 * (F.col("new_rows") - F.col("old_rows")), F.col("old_rows")))


def schema_checksum(df: DataFrame) -> str:
    """First 16 hex digits of the SHA-256 of the sorted name:type list."""
    text = ",".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def drift(spark: SparkSession, tables: dict[str, DataFrame], stored: dict[str, str]) -> DataFrame:
    """(table, stored, live, quarantined): definitions whose live checksum differs from the stored one."""
    live = spark.createDataFrame([(t, schema_checksum(df)) for t, df in tables.items()], "table string, live string")
    known = spark.createDataFrame(list(stored.items()), "table string, stored string")
    return known.join(live, "table", "left").withColumn("quarantined", ~F.col("stored").eqNullSafe(F.col("live")))
