"""Declared metrics over declared tables: dimensions, grain guards, joins, parameters.

A Metric is a set of declared names; anything undeclared is an error before a job
starts. Guards are DataFrames of (check, n) rows that a caller can look at or
enforce; nothing row-level is collected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = {"integer": int, "decimal": (Decimal, float, int), "string": str, "date": dt.date, "timestamp": dt.datetime, "boolean": bool}
COMPARE = {"=": "__eq__", ">": "__gt__", ">=": "__ge__", "<": "__lt__", "<=": "__le__", "<>": "__ne__"}


def bind(schema: Mapping[str, Mapping], supplied: Mapping[str, object]) -> dict[str, Column]:
    """Typed literals for exactly the declared parameters, checked against allowed, min and max."""
    if schema.keys() != supplied.keys():
        raise ValueError(f"parameters must be {sorted(schema)}, not {sorted(supplied)}")
    out = {}
    for name, rule in schema.items():
        v, kind = supplied[name], rule["type"]
        ok = isinstance(v, TYPES[kind]) and (kind == "boolean" or not isinstance(v, bool))
        if kind == "timestamp":
            ok = ok and v.tzinfo is None
        if kind == "date":
            ok = ok and not isinstance(v, dt.datetime)
        if kind == "decimal":
            ok = ok and Decimal(v).is_finite()
        if not ok or "allowed" in rule and v not in rule["allowed"] or "min" in rule and v < rule["min"] or "max" in rule and v > rule["max"]:
            raise ValueError(f"{name}: {v!r} is not allowed")
        out[name] = F.lit(v)
    return out


def predicate(conditions: Sequence[tuple[str, str, Column]]) -> Column:
    """(column, operator, literal) conditions, all of which must hold."""
    return reduce(lambda a, b: a & b, [getattr(F.col(c), COMPARE[op])(v) for c, op, v in conditions], F.lit(True))


def role_filter(conditions: Sequence[tuple[str, str, object]]) -> Column:
    """Conjunction of = and in conditions with unique, non-empty values."""
    parts = []
    for c, op, v in conditions:
        if op == "in":
            if not v or len(set(v)) != len(v):
                raise ValueError(f"{c}: values must be unique and not empty")
            parts.append(F.col(c).isin(list(v)))
        elif op == "=":
            parts.append(F.col(c) == F.lit(v))
        else:
            raise ValueError(op)
    return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Metric:
    """measure and denominator are aggregates as SQL text; dimensions and filters are declared by name."""

    measure: str
    dimensions: Mapping[str, str] = field(default_factory=dict)
    filters: Mapping[str, str] = field(default_factory=dict)
    denominator: str | None = None
    grain: tuple[str, ...] = ()
    bounds: tuple[float, float] = (0.0, 1.0)

    def _filtered(self, df: DataFrame, filters: Sequence[str]) -> DataFrame:
        for name in filters:
            df = df.where(self.filters[name]) if name in self.filters else _unknown("filter", name)
        return df

    def compile(self, df: DataFrame, group_by: Sequence[str] = (), filters: Sequence[str] = ()) -> DataFrame:
        """Dimensions and value, ordered by the dimensions."""
        dims = [F.expr(self.dimensions[d] if d in self.dimensions else _unknown("dimension", d)).alias(d) for d in group_by]
        out = self._filtered(df, filters).groupBy(*dims).agg(F.expr(self.measure).alias("value"), *([F.expr(self.denominator).alias("_den")] if self.denominator else []))
        if self.denominator:
            out = out.withColumn("value", F.try_divide("value", F.nullif("_den", F.lit(0)))).drop("_den")
        return out.orderBy(*group_by) if group_by else out

    def share(self, df: DataFrame, group_by: Sequence[str], filters: Sequence[str] = ()) -> DataFrame:
        """The measure of each group as a share of its total."""
        out = self.compile(df, group_by, filters)
        return out.withColumn("value", F.try_divide("value", F.sum("value").over(Window.partitionBy())))

    def fanout(self, df: DataFrame, filters: Sequence[str] = ()) -> DataFrame:
        """Rows, distinct grain keys and whether they are equal."""
        key = F.struct(*self.grain)
        return self._filtered(df, filters).agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).withColumn("ok", F.col("n_rows") == F.col("n_keys"))

    def out_of_bounds(self, result: DataFrame) -> DataFrame:
        low, high = self.bounds
        return result.where(F.col("value").isNotNull() & ~F.col("value").between(low, high))


def _unknown(kind: str, name: str):
    raise ValueError(f"unknown {kind}: {name}")


def multi_measure(df: DataFrame, dims: Sequence[str], measures: Mapping[str, str], ratios: Mapping[str, tuple[str, str, float]]) -> DataFrame:
    """Measures (sum, count, min, max of declared expressions) and ratios scale x num / nullif(den, 0)."""
    out = df.groupBy(*dims).agg(*[F.expr(e).alias(n) for n, e in measures.items()])
    return out.withColumns({n: scale * F.try_divide(F.col(a), F.col(b)) for n, (a, b, scale) in ratios.items()})


def grain_checks(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """(check, n): groups of rows with one grain, and rows with a null in it."""
    dup = df.groupBy(*grain).count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("duplicate_grain").alias("check"), "n")
    null = df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in grain])).agg(F.count("*").alias("n")).select(F.lit("null_grain").alias("check"), "n")
    return dup.unionAll(null)


def output_contract(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if df.columns != list(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    return df


def retention_contract(df: DataFrame) -> DataFrame:
    """Fails at run time unless 0 <= returning <= eligible."""
    ok = (F.col("returning") >= 0) & (F.col("returning") <= F.col("eligible"))
    return df.where(F.assert_true(ok, F.lit("returning must lie between 0 and eligible")).isNull())


def join_dimension(base: DataFrame, dim: DataFrame, on: Mapping[str, str], how: str = "left") -> DataFrame:
    """Many-to-one join; on maps base columns to the dimension's grain. Catalyst picks the strategy by size."""
    return base.join(dim, reduce(lambda a, b: a & b, [base[x] == dim[y] for x, y in on.items()]), how)


def path(relationships: Mapping[tuple[str, str], Mapping[str, str]], base: str, target: str) -> list[tuple[str, str]]:
    """The one directed path of relationships from base to target."""
    found, todo = [], [[base]]
    while todo:
        nodes = todo.pop()
        if nodes[-1] == target:
            found.append(nodes)
            continue
        todo += [[*nodes, b] for a, b in relationships if a == nodes[-1] and b not in nodes]
    if len(found) != 1:
        raise ValueError(f"{len(found)} paths from {base} to {target}")
    return list(zip(found[0], found[0][1:], strict=False))


def unmatched(base: DataFrame, dim: DataFrame, on: Mapping[str, str], policy: str = "keep") -> DataFrame:
    """How many base rows have no dimension row; policy reject fails at run time when there are any."""
    cond = reduce(lambda a, b: a & b, [base[x] == dim[y] for x, y in on.items()])
    out = base.join(dim, cond, "left_anti").agg(F.count("*").alias("n_unmatched"))
    if policy == "reject":
        out = out.where(F.assert_true(F.col("n_unmatched") == 0, F.lit("rows without a dimension row")).isNull())
    return out


def related_flag(left: DataFrame, right: DataFrame, keys: Mapping[str, str], name: str = "flag") -> DataFrame:
    """Every left row with 1 if a related right row exists, else 0. Null keys never match."""
    names = {y: f"_r_{y}" for y in keys.values()}
    found = right.select(*[F.col(y).alias(n) for y, n in names.items()]).dropna().distinct()
    cond = reduce(lambda a, b: a & b, [left[x] == found[names[y]] for x, y in keys.items()])
    return left.join(found, cond, "left").withColumn(name, F.when(found[next(iter(names.values()))].isNotNull(), 1).otherwise(0)).drop(*names.values())


def intervals(life: DataFrame, key: str, role: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """One [start, end) per entity from its start and end rows; no end row leaves it open."""
    rows = life.where(F.col(key).isNotNull()).groupBy(key)
    out = rows.agg(F.min(F.when(F.col(role) == start, F.col(at))).alias("start_at"), F.min(F.when(F.col(role) == end, F.col(at))).alias("end_at"))
    return out.where("start_at IS NOT NULL")


def interval_flag(facts: DataFrame, spans: DataFrame, key: str, at: str, name: str = "inside") -> DataFrame:
    """Facts with 1 if their time lies in their entity's [start, end). The entity is an equi key, so skew is AQE's."""
    s = spans.select(F.col(key).alias("_k"), "start_at", "end_at")
    hit = (F.col(at) >= F.col("start_at")) & (F.col("end_at").isNull() | (F.col(at) < F.col("end_at")))
    return facts.join(s, facts[key] == s["_k"], "left").withColumn(name, F.when(hit, 1).otherwise(0)).drop("_k", "start_at", "end_at")


def interval_checks(life: DataFrame, key: str, role: str, at: str, start: str = "start", end: str = "end") -> DataFrame:
    """(check, n): null ids, several starts or ends, ends without start, starts without end, inverted spans."""
    per = life.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if(F.col(role) == start).alias("s"), F.count_if(F.col(role) == end).alias("e"),
        F.min(F.when(F.col(role) == start, F.col(at))).alias("a"), F.min(F.when(F.col(role) == end, F.col(at))).alias("b"),
    )
    sums = per.agg(
        F.count_if(F.col("s") > 1).alias("many_starts"), F.count_if(F.col("e") > 1).alias("many_ends"), F.count_if(F.col("s") == 0).alias("unpaired_end"),
        F.count_if(F.col("e") == 0).alias("open_start"), F.count_if(F.col("b") < F.col("a")).alias("inverted"),
    )
    names = ["many_starts", "many_ends", "unpaired_end", "open_start", "inverted"]
    out = sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")
    return out.unionAll(life.agg(F.count_if(F.col(key).isNull()).alias("n")).select(F.lit("null_id").alias("check"), "n"))


def unpaired(starts: DataFrame, ends: DataFrame, key: str) -> DataFrame:
    """Keys that stand on one side only."""
    a, b = starts.select(F.col(key).alias("a")).distinct(), ends.select(F.col(key).alias("b")).distinct()
    both = a.join(b, a["a"] == b["b"], "full_outer").where("a IS NULL OR b IS NULL")
    return both.select(F.coalesce("a", "b").alias(key), F.when(F.col("b").isNull(), "start").otherwise("end").alias("only"))


def first_return(df: DataFrame, entity: str, day: str, cohort: tuple[str, str], back: tuple[str, str]) -> DataFrame:
    """eligible: entities whose first row falls in the cohort window; returning: those with a row in the return window."""
    if cohort[1] > back[0]:
        raise ValueError("the return window must follow the cohort window")
    inside = lambda c, w: (c >= F.lit(w[0]).cast("date")) & (c < F.lit(w[1]).cast("date"))
    d = F.col(day).cast("date")
    per = df.groupBy(entity).agg(F.min(d).alias("first"), F.max(F.when(inside(d, back), 1).otherwise(0)).alias("back"))
    per = per.where(inside(F.col("first"), cohort))
    return per.agg(F.count("*").alias("eligible"), F.coalesce(F.sum("back"), F.lit(0)).alias("returning")).withColumn("pct", F.try_divide(100.0 * F.col("returning"), F.col("eligible")))


def present(df: DataFrame, columns: Mapping[str, tuple[str, int | None]], order: Sequence[str] = ()) -> DataFrame:
    """Select, rename and round (0 to 12 digits); order by output names only."""
    if not set(order) <= columns.keys():
        raise ValueError("order by output names only")
    out = df.select(*[(F.col(c) if digits is None else F.round(c, digits)).alias(n) for n, (c, digits) in columns.items()])
    return out.orderBy(*order) if order else out


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, as often as they are missing."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))
