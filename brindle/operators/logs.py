"""Query logs, provenance and run comparison as joins of log tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, least_within
from .ordering import stored

from brindle.functions.scalars import within


def match_claims(entries: DataFrame, claims: DataFrame, relative: float = 0.001) -> DataFrame:
    """Claims (claim_id, value, cited: array of ids, bucket) with the query that supports them.

    Cited ids come first; claims without a hit are matched by value within the same
    bucket (an equality key that both logs carry, such as a day), first by id, in time linear in both logs.
    """
    ids = entries.select(F.col("query_id").alias("cited_id"), F.col("query_id").alias("hit"))
    cited = claims.select("claim_id", F.explode_outer("cited").alias("cited_id")).join(ids, "cited_id").groupBy("claim_id").agg(F.min("hit").alias("query_id")).withColumn("how", F.lit("cited"))
    rest = claims.join(cited, "claim_id", "left_anti")
    near = least_within(rest, entries, "claim_id", ["bucket"], "value", "query_id", relative).withColumn("how", F.lit("value"))
    return claims.select("claim_id").join(cited.unionByName(near), "claim_id", "left")


def coverage(matched: DataFrame, least: float = 0.8) -> DataFrame:
    out = matched.agg(F.count("*").alias("n"), F.count("query_id").alias("n_matched"))
    out = out.withColumn("coverage", F.try_divide("n_matched", "n"))
    return out.withColumn("status", F.when(F.col("coverage") >= least, "PASS").otherwise("FAIL"))


def reconcile(findings: DataFrame, entries: DataFrame) -> DataFrame:
    """Findings (claim_id, at, by, value, cited, bucket) with a cited, value-matched or latest earlier query of the same author."""
    first = match_claims(entries, findings).where("query_id IS NOT NULL")
    rest = findings.join(first, "claim_id", "left_anti").where("at IS NOT NULL AND by IS NOT NULL")
    latest = asof(rest.select("claim_id", "by", "at"), entries.where("by IS NOT NULL").select("by", "at", "query_id"), ["by"], "at", "query_id")
    latest = latest.where("query_id IS NOT NULL").select("claim_id", "query_id", F.lit("latest").alias("how"))
    return findings.select("claim_id").join(first.unionByName(latest), "claim_id", "left").withColumn("how", F.coalesce("how", F.lit("orphan")))


def unused(entries: DataFrame, reconciled: DataFrame) -> DataFrame:
    return entries.join(reconciled.select(F.col("query_id")).where("query_id IS NOT NULL").distinct(), "query_id", "left_anti")


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth) of everything upstream of the roots, breadth first, each once; edges are (id, parent).

    It ends when a level brings nothing new, which cycles do not prevent; each level is written to the shared folder.
    """
    edges = stored(edges.select("id", "parent").where("id IS NOT NULL AND parent IS NOT NULL"), "edges")
    seen = frontier = stored(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")), "lineage")
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, "id").select("root", F.col("parent").alias("id")).distinct()
        frontier = stored(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)), "lineage")
        seen = seen.unionAll(frontier)
    return seen


def miss_rate(log: DataFrame, at: str, kind: str, as_of: str, days: int) -> DataFrame:
    inside = (F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")) & (F.col(at) < F.lit(as_of).cast("timestamp_ntz"))
    return log.groupBy(kind).agg(F.count("*").alias("total"), F.count_if(inside).alias("recent"), (F.count_if(inside) / days).alias("per_day"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free: count, xor and sum of row hashes (xor alone cancels pairs of equal rows)."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))


def dataset_fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """SHA-256 over the row counts of the named tables in order of their names."""
    counts = None
    for name in sorted(tables):
        part = tables[name].agg(F.count("*").alias("n")).select(F.concat_ws("=", F.lit(name), F.col("n").cast("string")).alias("x"))
        counts = part if counts is None else counts.unionAll(part)
    return counts.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("x")), ";").cast("binary"), 256).alias("fingerprint"))  # one entry a table


def reliability(trials: DataFrame, question: str, value: str, absolute: float = 0.0, relative: float = 0.01) -> DataFrame:
    """Agreement of repeated runs of a question: modal share, share near the median, spread and a verdict."""
    counts = trials.where(F.col(value).isNotNull()).groupBy(question, value).agg(F.count("*").alias("c"))
    mode = counts.groupBy(question).agg(F.max("c").alias("modal"), F.count("*").alias("n_values"))
    med = trials.groupBy(question).agg(F.percentile(value, 0.5).alias("median"), F.count(value).alias("n"), F.stddev_pop(value).alias("sd"))
    near = trials.join(med.select(F.col(question), "median"), question).groupBy(question).agg(F.count_if(F.abs(F.col(value) - F.col("median")) <= F.greatest(F.lit(absolute), relative * F.abs("median"))).alias("n_near"))
    out = med.join(mode, question).join(near, question)
    out = out.withColumns({"exact_share": F.col("modal") / F.col("n"), "near_share": F.col("n_near") / F.col("n")})
    verdict = F.when(F.col("n") < 2, "unknown").when(F.col("n_values") == 1, "exactly_stable").when(F.col("near_share") == 1, "stable_within_tolerance").otherwise("variable")
    return out.select(question, "n", "median", "sd", "exact_share", "near_share", verdict.alias("verdict"))


def grade_numeric(results: DataFrame, references: DataFrame, key: str, absolute: float, relative: float) -> DataFrame:
    """Observed against expected or any alternative value."""
    j = results.join(references, key, "left")
    ok = within(F.col("observed"), F.col("expected"), absolute, relative) | F.exists(F.coalesce("alternatives", F.array().cast("array<double>")), lambda e: F.abs(F.col("observed") - e) <= F.greatest(F.lit(absolute), relative * F.abs(e)))
    return j.select(key, F.when(F.col("expected").isNull() | F.col("observed").isNull(), "unknown").when(ok, "pass").otherwise("fail").alias("grade"))


def grade_exact(results: DataFrame, references: DataFrame, key: str, case: bool = False) -> DataFrame:
    norm = (lambda c: F.trim(c)) if case else (lambda c: F.lower(F.trim(c)))
    j = results.join(references, key, "left")
    return j.select(key, F.when(norm(F.col("observed")) == norm(F.col("expected")), "pass").otherwise("fail").alias("grade"))


def grade_fields(column: str, required: Sequence[str], forbidden: Sequence[str]) -> Column:
    """Whether a JSON text has all required fields and none that is forbidden."""
    at = lambda f: F.get_json_object(column, f"$.{f}")
    ok = F.lit(True)
    for f in required:
        ok = ok & at(f).isNotNull()
    for f in forbidden:
        ok = ok & at(f).isNull()
    return F.when(ok, "pass").otherwise("fail")


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Per column, how many keyed rows differ; and rows on one side only."""
    values = [c for c in a.columns if c not in keys]
    left, right = a.select(*keys, *[F.col(c).alias(f"{c}__a") for c in values], F.lit(1).alias("_a")), b.select(*keys, *[F.col(c).alias(f"{c}__b") for c in values], F.lit(1).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    num = dict(a.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"{c}__a"), F.col(f"{c}__b")
        if num[c] in ("double", "float", "int", "bigint"):
            return ~F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(y)), x.isNull() & y.isNull())
        return ~x.eqNullSafe(y)

    paired = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    row = both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), *[F.count_if(paired & differs(c)).alias(c) for c in values])
    names = ["only_left", "only_right", *values]
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def alignment(labels: DataFrame, human: str, grader: str) -> DataFrame:
    """Confusion counts with the overall agreement."""
    g = labels.where(F.col(human).isNotNull() & F.col(grader).isNotNull()).groupBy(human, grader).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy()
    return g.withColumn("agreement", F.sum(F.when(F.col(human) == F.col(grader), F.col("n")).otherwise(0)).over(all_) / F.sum("n").over(all_))


def label_stability(rows: DataFrame, item: str, label: str) -> DataFrame:
    g = rows.groupBy(item).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).where("n > 1")
    return g.agg(F.count("*").alias("n_repeated"), F.count_if(F.col("k") > 1).alias("n_unstable"))


def compare_runs(a: DataFrame, b: DataFrame, case: str) -> DataFrame:
    """Two runs (case, passed, latency, cost) by case: completion, pass rate, median latency, known cost, changed cases."""
    x = a.select(F.col(case).alias("ca"), F.col("passed").alias("pa"), F.col("latency").alias("la"), F.col("cost").alias("ka"))
    y = b.select(F.col(case).alias("cb"), F.col("passed").alias("pb"), F.col("latency").alias("lb"), F.col("cost").alias("kb"))
    j = x.join(y, x["ca"] == y["cb"], "full_outer")
    return j.agg(
        F.count("ca").alias("n_a"), F.count("cb").alias("n_b"), F.avg(F.col("pa").cast("double")).alias("pass_a"), F.avg(F.col("pb").cast("double")).alias("pass_b"),
        F.percentile("la", 0.5).alias("latency_a"), F.percentile("lb", 0.5).alias("latency_b"), F.sum("ka").alias("cost_a"), F.sum("kb").alias("cost_b"),
        F.count_if(F.col("pa") != F.col("pb")).alias("n_changed"), F.count_if(F.col("ca").isNull() | F.col("cb").isNull()).alias("n_unpaired"),
    )
