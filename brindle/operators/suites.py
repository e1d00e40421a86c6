"""Suites of checks that run from a configuration: rows (check, ok, status, n, n_bad, detail), one a check.

A check hands in aggregates and a verdict over them, and a suite compiles them: all checks of single rows become one aggregate
and so one scan, and all checks of groups (keys, days, segments, distinct values) become one exploded pass over the columns
that they name, grouped once by (check, key) and summed up in one row. So a table is read at most twice, whatever the number
of checks. Only checks against another table and the order of single rows are jobs of their own.

``n`` is what a check looked at (rows, columns, groups, days), ``n_bad`` what it found wrong in them; ``detail`` holds all its
figures as JSON. A configuration names only what applies; one that names nothing gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import validation as va

GOOD = ("PASS", "WARNING", "WARN")
ORDER = ("BLOCKER", "FAIL", "SEVERE", "WARNING", "WARN", "PASS")
RESULT = "check string, ok boolean, status string, n long, n_bad long, detail string"


@dataclass
class Rows:
    """A check of single rows: named aggregates over the table, and over their names the figures n and n_bad and the status."""

    name: str
    figures: dict[str, Column]
    n: str
    n_bad: str
    status: Callable[[Callable[[str], Column]], Column] | None = None  # else FAIL if n_bad is not 0


@dataclass
class Groups:
    """A check of groups: a key and a value for each row; figures over the groups (key, n, total) where ``at`` holds."""

    name: str
    key: Column
    figures: Callable[[Column], dict[str, Column]]
    n: str
    n_bad: str
    status: Callable[[Callable[[str], Column]], Column]
    value: Column | None = None
    days: Callable[[Column], dict[str, Column]] | None = None  # further figures from the array of (key, total) in order


def result(name: str, n: Column, n_bad: Column, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("check"), status.isin(*GOOD).alias("ok"), status.alias("status"), n.cast("long").alias("n"), n_bad.cast("long").alias("n_bad"), detail.alias("detail"))


def results(wide: DataFrame, checks: Sequence[Rows | Groups], names: Sequence[Sequence[str]]) -> DataFrame:
    """One row a check from the one row of all figures."""
    out = []
    for i, (check, fields) in enumerate(zip(checks, names, strict=True)):
        at = lambda field, i=i: F.col(f"c{i}_{field}")
        figures = lambda text, fields=fields, i=i: F.expr(reduce(lambda t, f: t.replace(f"{{{f}}}", f"c{i}_{f}"), fields, text))
        bad = figures(check.n_bad)
        status = check.status(at) if check.status else F.when(bad > 0, "FAIL").otherwise("PASS")
        out.append(result(check.name, figures(check.n), bad, status, F.to_json(F.struct(*[at(f).alias(f) for f in fields]))))
    return wide.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def by_rows(df: DataFrame, checks: Sequence[Rows], beside: Sequence[DataFrame] = ()) -> list[DataFrame]:
    """All checks of single rows in one aggregate; frames beside are of one row, with figures of another table."""
    if not checks:
        return []
    wide = df.agg(*[e.alias(f"c{i}_{f}") for i, c in enumerate(checks) for f, e in c.figures.items()])
    for other in beside:
        wide = wide.crossJoin(F.broadcast(other))  # one row each
    return [results(wide, checks, [list(c.figures) for c in checks])]


def by_groups(df: DataFrame, checks: Sequence[Groups]) -> list[DataFrame]:
    """All checks of groups in one pass: rows go out once for each check, are counted and summed by (check, key) map-side first."""
    if not checks:
        return []
    cells = [F.struct(F.lit(i).alias("slot"), c.key.cast("string").alias("key"), (F.lit(None) if c.value is None else c.value).cast("double").alias("x")) for i, c in enumerate(checks)]
    groups = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.slot", "c.key").agg(F.count("*").alias("n"), F.sum("c.x").alias("total"))
    figures, days = [], {}
    for i, c in enumerate(checks):
        at = F.col("slot") == i
        figures += [e.alias(f"c{i}_{f}") for f, e in c.figures(at).items()]
        if c.days:  # bounded by the calendar
            figures.append(F.sort_array(F.collect_list(F.when(at & F.col("key").isNotNull(), F.struct("key", "total")))).alias(f"c{i}_days"))
            days |= {f"c{i}_{f}": e for f, e in c.days(F.col(f"c{i}_days")).items()}
    names = [[*c.figures(F.lit(True)), *(c.days(F.array()) if c.days else ())] for c in checks]
    return [results(groups.agg(*figures).withColumns(days) if days else groups.agg(*figures), checks, names)]


def apart(check: str, df: DataFrame, n: str, n_bad: str) -> DataFrame:
    """Result row of a check that is a job of its own; the worst of its rows stands for it, an unknown status for none."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    rows = df.select(F.when(place > 0, place).alias("rank"), "status", F.to_json(F.struct("*")).alias("detail"), F.expr(n).cast("long").alias("n"), F.expr(n_bad).cast("long").alias("n_bad"))
    worst = rows.agg(F.min(F.when(F.col("rank").isNotNull(), F.struct("rank", "detail", "status"))).alias("x"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_bad"), F.lit(0)).alias("n_bad"))
    return worst.select(result(check, F.col("n"), F.col("n_bad"), F.coalesce("x.status", F.lit("PASS")), F.col("x.detail")).alias("r")).select("r.*")


def together(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else df.sparkSession.createDataFrame([], RESULT)


def verdict(rows: DataFrame) -> DataFrame:
    """One row: checks run, passed and failed, and whether all is well."""
    return rows.agg(F.count("*").alias("checks_run"), F.count_if("ok").alias("checks_passed"), F.count_if(~F.col("ok")).alias("checks_failed"), F.coalesce(F.bool_and("ok"), F.lit(True)).alias("overall_ok"))


def rate_of(bad: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(bad, n), F.lit(0.0))


def row_rule(name: str, bad: Column, blocker: float = 0.05) -> Rows:
    """Rows that meet a condition: over blocker BLOCKER, any WARNING."""
    figures = {"n_bad": F.count_if(F.coalesce(bad, F.lit(False))), "n": F.count("*")}
    return Rows(name, figures, "{n}", "{n_bad}", lambda at: va.band(rate_of(at("n_bad"), at("n")), (blocker, "BLOCKER"), (0, "WARNING")))


def worst_of(columns: Sequence[tuple[str, Column]]) -> tuple[dict[str, Column], str]:
    """Figures n and bad_<i> of several row conditions, and SQL of the greatest count."""
    figures = {"n": F.count("*")} | {f"bad_{i}": F.count_if(F.coalesce(bad, F.lit(False))) for i, (_, bad) in enumerate(columns)}
    names = [f"{{bad_{i}}}" for i in range(len(columns))]
    return figures, " + ".join(names) or "0"


def greatest(at: Callable[[str], Column], k: int) -> Column:
    most = F.greatest(*[at(f"bad_{i}") for i in range(k)]) if k > 1 else at("bad_0") if k else F.lit(0)
    return rate_of(most, at("n"))


def structural(df: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """Schema, keys, completeness, dates, references, domains and row counts.

    Keys: schema (StructType), primary_key, required (columns), dates {day, start, end, max_gap}, parent {df, child_key, key},
    domains {name: condition that a bad row meets}, rows (low, high). Without any: completeness of all columns and at
    least one row. Statuses are those of the single checks; a date gap is a WARNING, a date outside FAIL.
    """
    c = config or {}
    rows, groups, parts = [], [], []
    if "schema" in c:
        parts.append(apart("schema", va.schema_check(df, c["schema"]), "CASE WHEN finding <> 'extra' THEN 1 ELSE 0 END", "CASE WHEN finding IN ('missing', 'type') THEN 1 ELSE 0 END"))
    if "primary_key" in c:
        keys = c["primary_key"]
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        key = F.to_json(F.struct(*keys)) if len(keys) > 1 else F.col(keys[0])
        figures = lambda at: {"n": F.coalesce(F.sum(F.when(at, F.col("n"))), F.lit(0)), "n_null": F.coalesce(F.sum(F.when(at, F.col("total"))), F.lit(0.0)).cast("long"), "n_dup_keys": F.count_if(at & (F.col("n") > 1)), "n_dup_rows": F.coalesce(F.sum(F.when(at & (F.col("n") > 1), F.col("n"))), F.lit(0))}
        groups.append(Groups("primary_key", key, figures, "{n}", "{n_null} + {n_dup_rows}", lambda at: F.when((at("n_null") > 0) | (at("n_dup_keys") > 0), "BLOCKER").otherwise("PASS"), null.cast("int")))
    if "required" in c or not c:
        required = c.get("required", df.columns)
        figures, bad = worst_of([(k, F.col(k).isNull()) for k in required])
        rows.append(Rows("completeness", figures, "{n}", bad, lambda at: (lambda r: F.when(r > 0.5, "BLOCKER").when(r > 0.2, "SEVERE").when(r >= 0.05, "WARNING").otherwise("PASS"))(greatest(at, len(required)))))
    if "dates" in c:
        d = c["dates"]
        day = F.col("key").try_cast("date")  # keys of other checks are no days
        outside = reduce(lambda a, b: a | b, [t for k, t in (("start", day < F.lit(d.get("start")).cast("date")), ("end", day > F.lit(d.get("end")).cast("date"))) if d.get(k)], F.lit(False))
        figures = lambda at: {"n": F.count_if(at & day.isNotNull()), "n_outside": F.count_if(at & outside), "first": F.min(F.when(at, F.col("key"))), "last": F.max(F.when(at, F.col("key")))}
        gaps = lambda days: {"n_gaps": guarded(days, lambda a: F.size(F.filter(steps(a, lambda p, q: F.datediff(q["key"].cast("date"), p["key"].cast("date"))), lambda g: g > d.get("max_gap", 1))))}
        groups.append(Groups("date_range", F.col(d["day"]).cast("date"), figures, "{n}", "{n_outside} + {n_gaps}", lambda at: F.when(at("n_outside") > 0, "FAIL").when(at("n_gaps") > 0, "WARNING").otherwise("PASS"), days=gaps))
    if "parent" in c:
        p = c["parent"]
        parts.append(apart("referential_integrity", va.referential(df, p["df"], p["child_key"], p["key"]), "n", "n_orphans"))
    if "domains" in c:
        figures, bad = worst_of(list(c["domains"].items()))
        rows.append(Rows("value_domain", figures, "{n}", bad, lambda at: va.band(greatest(at, len(c["domains"])), (0.05, "BLOCKER"), (0, "WARNING"))))
    if "rows" in c or not c:
        low, high = c.get("rows", (1, None))
        fits = lambda at: (at("n") >= low) & (at("n") <= high if high is not None else F.lit(True))
        rows.append(Rows("row_count", {"n": F.count("*")}, "{n}", f"CASE WHEN {{n}} < {low}{f' OR {{n}} > {high}' if high is not None else ''} THEN 1 ELSE 0 END", lambda at: F.when(fits(at), "PASS").otherwise("BLOCKER")))
    return together(df, [*parts, *by_rows(df, rows), *by_groups(df, groups)])


def steps(days: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of every two neighbours of an array."""
    return F.transform(F.sequence(F.lit(1), F.size(days) - 1), lambda i: f(F.get(days, i - 1), F.get(days, i)))


def guarded(days: Column, f: Callable[[Column], Column]) -> Column:
    """A count over an array of at least two elements, else 0."""
    return F.when(F.size(days) > 1, f(days)).otherwise(0)


def changes(days: Column, limit: float) -> Column:
    """How many totals differ from the one before by more than a share of it; from zero any change does."""
    far = lambda p, q: F.when(p["total"] == 0, q["total"] != 0).otherwise(F.abs(q["total"] - p["total"]) > limit * F.abs(p["total"]))
    return guarded(days, lambda d: F.size(F.filter(steps(d, far), lambda x: x)))


def far_off(days: Column, window: int, most: float) -> Column:
    """How many totals lie more than so many sample deviations from the mean of the window of totals before them."""
    def z(i: Column) -> Column:
        seen = F.transform(F.slice(days, i - window + 1, window), lambda x: x["total"])
        mean = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / window
        sd = F.sqrt(F.aggregate(seen, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (window - 1))
        return (sd > 0) & (F.abs(F.get(days, i)["total"] - mean) > most * sd)

    return F.when(F.size(days) > window, F.size(F.filter(F.transform(F.sequence(F.lit(window), F.size(days) - 1), z), lambda x: x))).otherwise(0)


def series(name: str, day: str, metric: str, count: Callable[[Column], Column], status: Callable[[Column], Column]) -> Groups:
    """A check of daily sums in order."""
    figures = lambda at: {"n": F.count_if(at & F.col("key").isNotNull())}
    return Groups(name, F.when(F.col(metric).isNotNull(), F.col(day).cast("date")), figures, "{n}", "{n_breaks}", lambda at: status(at("n_breaks")), F.col(metric), lambda days: {"n_breaks": count(days)})


def logical(detail: DataFrame, config: dict[str, Any], summary: DataFrame | None = None) -> DataFrame:
    """Totals, percentages, monotonic columns, trends, ratios, future dates and group balance.

    Keys: metric (with summary) and tolerance, percentages {pct, group}, monotonic {order, value, strict}, trend {day, metric,
    window, max_z}, continuity {day, metric, jump}, ratio {num, den, low, high}, future {day, as_of}, balance (column).
    """
    rows, groups, beside, parts = [], [], [], []
    if "metric" in config and summary is not None:
        m, tolerance = config["metric"], config.get("tolerance", 0.01)
        beside.append(summary.agg(F.sum(m).alias("of_summary")))
        off = f"CASE WHEN abs(of_summary - {{total}}) > {float(tolerance)}D * abs(of_summary) THEN 1 ELSE 0 END"
        rows.append(Rows("aggregation_consistency", {"n": F.count("*"), "total": F.sum(m)}, "{n}", off, lambda at: F.when(F.abs(F.col("of_summary") - at("total")) > tolerance * F.abs("of_summary"), "BLOCKER").otherwise("PASS")))
    if "percentages" in config:
        p = {"expected": 100.0, "tolerance": 0.5} | config["percentages"]
        off = F.abs(F.col("total") - p["expected"])
        figures = lambda at: {"n": F.count_if(at), "n_off": F.count_if(at & (off > p["tolerance"])), "worst": F.max(F.when(at, off))}
        groups.append(Groups("percentages_sum", F.col(p["group"]), figures, "{n}", "{n_off}", lambda at: F.when(F.coalesce(at("worst"), F.lit(0.0)) <= p["tolerance"], "PASS").when(at("worst") <= 2 * p["tolerance"], "WARN").otherwise("FAIL"), F.col(p["pct"])))
    if "trend" in config:
        t = {"window": 3, "max_z": 3.0} | config["trend"]
        groups.append(series("trend_consistency", t["day"], t["metric"], lambda days: far_off(days, t["window"], t["max_z"]), lambda n: F.when(n > 0, "WARNING").otherwise("PASS")))
    if "continuity" in config:
        k = {"jump": 0.5} | config["continuity"]
        groups.append(series("trend_continuity", k["day"], k["metric"], lambda days: changes(days, k["jump"]), lambda n: F.when(n == 0, "PASS").when(n <= 2, "WARNING").otherwise("BLOCKER")))
    if "ratio" in config:
        r = config["ratio"]
        ratio = F.try_divide(F.col(r["num"]), F.col(r["den"]))
        figures = {"n": F.count(ratio), "n_outside": F.count_if(ratio.isNotNull() & ~ratio.between(r["low"], r["high"])), "n_zero_den": F.count_if(F.col(r["den"]) == 0)}
        rows.append(Rows("ratio_bounds", figures, "{n}", "{n_outside}", lambda at: F.when(at("n_outside") > 0, "BLOCKER").otherwise("PASS")))
    if "future" in config:
        f = config["future"]
        rows.append(Rows("no_future_dates", {"n": F.count(f["day"]), "n_future": F.count_if(F.col(f["day"]).cast("date") > F.lit(f["as_of"]).cast("date"))}, "{n}", "{n_future}", lambda at: F.when(at("n_future") > 0, "BLOCKER").otherwise("PASS")))
    if "balance" in config:
        n = F.col("n")
        figures = lambda at: {"n": F.count_if(at), "n_small": F.count_if(at & (n < 10)), "smallest": F.min(F.when(at, n)), "largest": F.max(F.when(at, n))}
        groups.append(Groups("group_balance", F.col(config["balance"]), figures, "{n}", "{n_small}", lambda at: F.when((at("n_small") > 0) | (at("largest") > 100 * at("smallest")), "WARNING").otherwise("PASS")))
    if "monotonic" in config:
        found = va.monotonic(detail, **config["monotonic"])
        parts.append(apart("monotonic", found.withColumn("status", F.when(F.col("n_bad") > 0, "FAIL").otherwise("PASS")), "n_steps", "n_bad"))
    return together(detail, [*by_rows(detail, rows, beside), *by_groups(detail, groups), *parts])


#: fixed values: the rules that apply when a table has columns of these very names
DEFAULT_RANGES = {
    "conversion_rate": (0, 1),
    "bounce_rate": (0, 1),
    "click_through_rate": (0, 1),
    "retention_rate": (0, 1),
    "churn_rate": (0, 1),
    "nps_score": (-100, 100),
}
DEFAULT_NO_NEGATIVE = ("revenue", "orders", "sessions", "users", "page_views", "transactions", "quantity")
DEFAULT_CARDINALITY = {"device": (2, 10), "country": (1, 300)}
DEFAULT_RELATIONSHIPS = [{"left": "aov * orders", "right": "revenue", "tolerance": 0.05}]


def default_rules(df: DataFrame) -> dict[str, Any]:
    """Rules for the columns of a table whose names are known exactly; numeric rules need numeric columns."""
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return {
        "ranges": {c: r for c, r in DEFAULT_RANGES.items() if c in numeric},
        "no_negative": [c for c in DEFAULT_NO_NEGATIVE if c in numeric],
        "cardinality": {c: r for c, r in DEFAULT_CARDINALITY.items() if c in df.columns},
    }


def business(df: DataFrame, rules: dict[str, Any] | None = None) -> DataFrame:
    """Ranges, negatives, segments, cardinality, identities of rows and of totals, and changes between periods.

    Keys: ranges {column: (low, high)}, no_negative (columns), segments {column: expected values}, cardinality {column:
    (low, high)}, identities {name: condition that a bad row meets}, temporal {day, metric, limit: percent of change},
    metrics {name: aggregate} with relationships [{left, right, tolerance}] over those names. Without rules: default_rules.
    """
    rules = default_rules(df) if rules is None else rules
    rows = [row_rule(f"range_{c}", ~F.col(c).between(low, high)) for c, (low, high) in rules.get("ranges", {}).items()]
    rows += [row_rule(f"negative_{c}", F.col(c) < 0) for c in rules.get("no_negative", ())]
    rows += [row_rule(name, bad) for name, bad in rules.get("identities", {}).items()]
    if metrics := rules.get("metrics"):
        for k, rule in enumerate(rules.get("relationships", DEFAULT_RELATIONSHIPS)):
            rows.append(relationship(f"relationship_{k + 1}", metrics, **rule))
    groups = []
    for column, expected in rules.get("segments", {}).items():
        seen = F.col("key").isin(*map(str, expected)) if expected else F.lit(False)
        figures = lambda at, seen=seen: {"n": F.count_if(at & F.col("key").isNotNull()), "n_unexpected": F.count_if(at & ~seen), "n_known": F.count_if(at & seen)}
        k = len(set(map(str, expected)))
        groups.append(Groups(f"segments_{column}", F.col(column), figures, "{n}", f"{{n_unexpected}} + {k} - {{n_known}}", lambda at, k=k: F.when(at("n_known") < k, "FAIL").when(at("n_unexpected") > 0, "WARN").otherwise("PASS")))
    for column, (low, high) in rules.get("cardinality", {}).items():
        figures = lambda at: {"n": F.count_if(at & F.col("key").isNotNull())}
        groups.append(Groups(f"cardinality_{column}", F.col(column), figures, "{n}", f"CASE WHEN {{n}} BETWEEN {low} AND {high} THEN 0 ELSE 1 END", lambda at, low=low, high=high: F.when(at("n").between(low, high), "PASS").otherwise("WARNING")))
    if "temporal" in rules:
        t = {"limit": 200.0} | rules["temporal"]
        groups.append(series("period_change", t["day"], t["metric"], lambda days: changes(days, t["limit"] / 100), lambda n: F.when(n > 0, "FAIL").otherwise("PASS")))
    return together(df, [*by_rows(df, rows), *by_groups(df, groups)])


def relationship(name: str, metrics: dict[str, Column], left: str, right: str, tolerance: float = 0.05) -> Rows:
    """Two SQL expressions over named totals agree within a share of the right one."""
    gap = f"abs(({left}) - ({right})) > {tolerance}D * abs({right})"
    named = re.sub(rf"\b({'|'.join(map(re.escape, metrics))})\b", r"{\1}", gap)
    return Rows(name, dict(metrics), "1", f"CASE WHEN {named} THEN 1 ELSE 0 END")
