"""Forecasting many series at once: rows (series, t, value), never one window over all series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(df: DataFrame, series: str, day: str, value: str) -> DataFrame:
    """(series, day, value) on a daily calendar, last value carried forward; nothing before the first value."""
    rows = df.where(F.col(value).isNotNull()).groupBy(F.col(series).alias("series"), F.col(day).cast("date").alias("day")).agg(F.avg(value).alias("v"))
    grid = rows.groupBy("series").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("series", F.explode(F.sequence("lo", "hi")).alias("day"))
    w = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(rows, ["series", "day"], "left").select("series", "day", F.last("v", ignorenulls=True).over(w).alias("value"))


def numbered(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("day")
    return df.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("series"))})


def naive(df: DataFrame, periods: int, method: str = "last", window: int = 7, season: int = 7) -> DataFrame:
    """(series, h, forecast) for 1..periods: last, mean of the last window, drift or seasonal."""
    rows = numbered(df)
    last = F.max_by("value", "i")
    horizon = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h")
    if method == "seasonal":
        tail = rows.where(F.col("i") >= F.col("n") - season).select("series", (F.col("i") - F.col("n") + season).alias("pos"), "value", "n")
        if_short = F.assert_true(F.col("n") >= season, F.lit("the season is longer than the history"))
        heads = tail.groupBy("series").agg(F.max("n").alias("n")).where(if_short.isNull()).select("series", horizon)
        return heads.withColumn("pos", (F.col("h") - 1) % season).join(tail, ["series", "pos"]).select("series", "h", F.col("value").alias("forecast"))
    if method == "mean":
        g = rows.where(F.col("i") >= F.col("n") - window).groupBy("series").agg(F.avg("value").alias("f"))
        return g.select("series", horizon, F.col("f").alias("forecast"))
    g = rows.groupBy("series").agg(last.alias("l"), F.min_by("value", "i").alias("first"), F.max("n").alias("n")).select("series", "l", "first", "n", horizon)
    slope = F.coalesce(F.try_divide(F.col("l") - F.col("first"), F.col("n") - 1), F.lit(0.0)) if method == "drift" else F.lit(0.0)
    return g.select("series", "h", (F.col("l") + slope * F.col("h")).alias("forecast"))


def autocorrelation(df: DataFrame, max_lag: int | None = None) -> DataFrame:
    """(series, lag, acf): mean of lagged products over n - lag terms by population variance, up to min(365, n / 2)."""
    w = Window.partitionBy("series")
    rows = numbered(df).withColumns({"d": F.col("value") - F.avg("value").over(w), "var": F.var_pop("value").over(w)})
    most = F.least(F.lit(365 if max_lag is None else max_lag), F.expr("n div 2")).cast("int")
    left = rows.select("series", "i", "d", "var", "n", F.explode(F.sequence(F.lit(1), F.greatest(most, F.lit(1)))).alias("lag")).where(F.col("lag") <= most)
    right = rows.select("series", (F.col("i")).alias("j"), F.col("d").alias("e"))
    both = left.withColumn("j", F.col("i") + F.col("lag")).join(right, ["series", "j"])
    return both.groupBy("series", "lag").agg(F.try_divide(F.sum(F.col("d") * F.col("e")) / (F.max("n") - F.max("lag")), F.max("var")).alias("acf"), F.max("n").alias("n"))


def acf_peaks(acf: DataFrame) -> DataFrame:
    """Lags above both neighbours and above 2 / sqrt(n); the last lag may be a peak."""
    w = Window.partitionBy("series").orderBy("lag")
    rows = acf.withColumns({"l": F.lag("acf").over(w), "r": F.lead("acf").over(w)})
    return rows.where((F.col("acf") > F.coalesce("l", F.lit(1.0))) & (F.col("acf") > F.coalesce("r", F.lit(-2.0))) & (F.col("acf") > 2 / F.sqrt("n"))).select("series", "lag", "acf")


def ordered(df: DataFrame) -> DataFrame:
    """One row a series with its values in order."""
    return df.groupBy("series").agg(F.transform(F.sort_array(F.collect_list(F.struct("day", "value"))), lambda x: x["value"].cast("double")).alias("y"))


def simple(df: DataFrame, alpha: float) -> DataFrame:
    """Level of simple exponential smoothing after the last value."""
    fold = F.aggregate(F.slice("y", 2, F.greatest(F.size("y") - 1, F.lit(0))), F.get("y", F.lit(0)), lambda s, y: alpha * y + (1 - alpha) * s)
    return ordered(df).select("series", fold.alias("level"))


def holt(df: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Level and trend of Holt's method after the last value."""
    zero = F.struct(F.get("y", F.lit(0)).alias("l"), F.coalesce(F.get("y", F.lit(1)) - F.get("y", F.lit(0)), F.lit(0.0)).alias("b"))

    def step(s: Column, y: Column) -> Column:
        level = alpha * y + (1 - alpha) * (s["l"] + s["b"])
        return F.struct(level.alias("l"), (beta * (level - s["l"]) + (1 - beta) * s["b"]).alias("b"))

    fold = F.aggregate(F.slice("y", 2, F.greatest(F.size("y") - 1, F.lit(0))), zero, step)
    return ordered(df).select("series", fold.alias("s")).select("series", F.col("s.l").alias("level"), F.col("s.b").alias("trend"))


def smooth_one(y: np.ndarray, alpha: float, beta: float | None, gamma: float, season: int | None) -> tuple[np.ndarray, float, float, np.ndarray]:
    """One-step-ahead predictions and final state of additive smoothing of one series."""
    level, trend = y[0], (y[1] - y[0] if beta is not None and len(y) > 1 else 0.0)
    seasonal = np.zeros(season or 1)
    if season:
        level, seasonal = y[:season].mean(), y[:season] - y[:season].mean()
        trend = (y[season : 2 * season].mean() - level) / season if beta is not None and len(y) >= 2 * season else 0.0
    ahead = np.zeros(len(y))
    for t, v in enumerate(y):
        s = seasonal[t % len(seasonal)] if season else 0.0
        ahead[t] = level + trend + s
        if t == 0 and not season:
            ahead[t] = v
            continue
        new = alpha * (v - s) + (1 - alpha) * (level + trend)
        if beta is not None:
            trend = beta * (new - level) + (1 - beta) * trend
        level = new
        if season:
            seasonal[t % season] = gamma * (v - level) + (1 - gamma) * s
    return ahead, level, trend, seasonal


def holt_winters(df: DataFrame, periods: int, season: int, alphas: Sequence[float] = tuple(i / 100 for i in range(1, 100)), beta: float = 0.1, gamma: float = 0.1) -> DataFrame:
    """(series, alpha, mse, mae, h, forecast): alpha of the grid (0.01 to 0.99) with the least one-step-ahead error; one series a call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("day")["value"].to_numpy(float)
        use = season if len(y) >= 2 * season else None
        fits = [(float(np.mean((y - (fit := smooth_one(y, a, beta, gamma, use))[0]) ** 2)), a, fit) for a in alphas]
        mse, alpha, (ahead, level, trend, seasonal) = min(fits, key=lambda x: (x[0], x[1]))
        h = np.arange(1, periods + 1)
        f = level + trend * h + (seasonal[(len(y) + h - 1) % len(seasonal)] if use else 0.0)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "alpha": alpha, "mse": mse, "mae": float(np.mean(np.abs(y - ahead))), "h": h, "forecast": f})

    return df.groupBy("series").applyInPandas(run, f"series {df.schema['series'].dataType.simpleString()}, alpha double, mse double, mae double, h int, forecast double")


def simple_fitted(df: DataFrame, alpha: float) -> DataFrame:
    """(series, day, value, fitted, residual) of simple smoothing: each value against the level before it, the first against itself."""
    one = lambda x, level: F.struct(x["day"].alias("day"), x["value"].cast("double").alias("value"), level.alias("fitted"))
    rows = df.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("day", "value"))).alias("y"))  # a series of days
    first = F.get("y", F.lit(0))
    start = F.struct(first["value"].cast("double").alias("level"), F.array(one(first, first["value"].cast("double"))).alias("out"))
    fold = F.aggregate(F.slice("y", 2, F.greatest(F.size("y") - 1, F.lit(0))), start, lambda s, x: F.struct((alpha * x["value"].cast("double") + (1 - alpha) * s["level"]).alias("level"), F.concat(s["out"], F.array(one(x, s["level"]))).alias("out")))
    out = rows.select("series", F.explode(fold["out"]).alias("x")).select("series", "x.*")
    return out.withColumn("residual", F.col("value") - F.col("fitted"))


def holt_winters_fitted(df: DataFrame, season: int, alpha: float, beta: float | None = 0.1, gamma: float = 0.1) -> DataFrame:
    """(series, day, value, fitted, residual) of additive smoothing with given weights; one series a call."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        y = pdf["value"].to_numpy(float)
        ahead = smooth_one(y, alpha, beta, gamma, season if len(y) >= 2 * season else None)[0]
        return pd.DataFrame({"series": pdf["series"], "day": pdf["day"], "value": y, "fitted": ahead, "residual": y - ahead})

    return df.groupBy("series").applyInPandas(run, f"series {df.schema['series'].dataType.simpleString()}, day {df.schema['day'].dataType.simpleString()}, value double, fitted double, residual double")
