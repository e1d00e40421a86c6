"""Causal inference on tables: saturated and linear models from grouped moments.

Robust variances follow HC1 with the normal reference distribution. Only k x k
matrices and cell tables reach the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import tails as tl

from .joins import asof
from .ordering import cumulated, dealt, running, scanned, stored


def did(df: DataFrame, outcome: str, treated: str, post: str, tails: bool = True) -> DataFrame:
    """2 x 2 difference in differences: difference of cell means, HC1 variance from the cells."""
    y = F.col(outcome).cast("double")
    cell = df.where(y.isNotNull()).groupBy(F.col(treated).cast("int").alias("t"), F.col(post).cast("int").alias("p")).agg(F.count("*").alias("n"), F.avg(y).alias("m"), (F.var_pop(y) * F.count("*")).alias("sse"))
    sign = F.when(F.col("t") == F.col("p"), 1).otherwise(-1)
    g = cell.agg(F.sum("n").alias("n"), F.sum(sign * F.col("m")).alias("effect"), F.sum(F.col("sse") / F.col("n") ** 2).alias("v0"))
    g = g.select("n", "effect", F.sqrt(F.col("v0") * F.col("n") / (F.col("n") - 4)).alias("se")).withColumn("z", F.try_divide("effect", "se"))
    return g.withColumn("p", tl.p_normal("z")) if tails else g


def event_study(df: DataFrame, outcome: str, treated: str, period: Column, reference: int = -1, tails: bool = True) -> DataFrame:
    """Difference in differences of every period against the reference period."""
    y = F.col(outcome).cast("double")
    cells = df.where(y.isNotNull()).groupBy(period.alias("period")).agg(*[x for v in (0, 1) for x in (F.avg(F.when(F.col(treated) == v, y)).alias(f"m{v}"), (F.var_pop(F.when(F.col(treated) == v, y)) / F.count(F.when(F.col(treated) == v, y))).alias(f"v{v}"))])
    cells = cells.select("period", (F.col("m1") - F.col("m0")).alias("gap"), (F.col("v1") + F.col("v0")).alias("var"))
    ref = cells.where(F.col("period") == reference).select(F.col("gap").alias("g0"), F.col("var").alias("v0"))
    out = cells.where(F.col("period") != reference).crossJoin(F.broadcast(ref))  # one row
    out = out.select("period", (F.col("gap") - F.col("g0")).alias("effect"), F.sqrt(F.col("var") + F.col("v0")).alias("se")).withColumn("z", F.try_divide("effect", "se"))
    return out.withColumn("p", tl.p_normal("z")) if tails else out


def parallel_trends(df: DataFrame, outcome: str, treated: str, time: str, before: float, alpha: float = 0.05, tails: bool = True) -> DataFrame:
    """Difference of pre-period slopes by arm with robust variances; over 0.10 PASS, over alpha WARNING."""
    rows = df.where((F.col(time) < before) & F.col(outcome).isNotNull()).select(F.col(treated).cast("int").alias("t"), F.col(time).cast("double").alias("x"), F.col(outcome).cast("double").alias("y"))
    fit = rows.groupBy("t").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), F.avg("x").alias("xm"), F.regr_sxx("y", "x").alias("sxx"), F.count("*").alias("n"))
    e = F.col("y") - F.col("a") - F.col("b") * F.col("x")
    meat = rows.join(F.broadcast(fit), "t").groupBy("t").agg(F.sum(((F.col("x") - F.col("xm")) * e) ** 2).alias("meat"))  # two rows
    arms = fit.join(meat, "t").agg(F.sum(F.when(F.col("t") == 1, F.col("b")).otherwise(-F.col("b"))).alias("difference"), F.sum(F.col("meat") / F.col("sxx") ** 2).alias("v"), F.sum("n").alias("n"))
    g = arms.select("n", "difference", F.sqrt(F.col("v") * F.col("n") / (F.col("n") - 4)).alias("se")).withColumn("z", F.try_divide("difference", "se"))
    if not tails:
        return g
    g = g.withColumn("p", tl.p_normal("z"))
    return g.withColumn("status", F.when(F.col("p") > 0.1, "PASS").when(F.col("p") > alpha, "WARNING").otherwise("FAIL"))


def support(df: DataFrame, score: str, treated: str, slack: float = 1e-9) -> DataFrame:
    """Region that both arms' scores cover, and the share of rows outside it by more than a relative slack (scores may be sums of doubles)."""
    t = F.col(treated) == 1
    span = df.agg(F.greatest(F.min(F.when(t, F.col(score))), F.min(F.when(~t, F.col(score)))).alias("low"), F.least(F.max(F.when(t, F.col(score))), F.max(F.when(~t, F.col(score)))).alias("high"))
    near = lambda c: slack * F.greatest(F.lit(1.0), F.abs(c))
    outside = (F.col(score) < F.col("low") - near("low")) | (F.col(score) > F.col("high") + near("high"))
    out = df.crossJoin(F.broadcast(span)).agg(F.max("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"), F.count_if(outside).alias("n_outside"))  # one row
    rate = F.try_divide("n_outside", "n")
    return out.withColumn("status", F.when(rate <= 0.05, "PASS").when(rate <= 0.2, "WARNING").otherwise("FAIL"))


def balance(df: DataFrame, covariates: Sequence[str], treated: str) -> DataFrame:
    """Absolute standardised mean difference and variance ratio of each covariate."""
    cells = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in covariates])
    rows = df.select((F.col(treated) == 1).alias("t"), F.explode(cells).alias("c")).select("t", "c.covariate", "c.x")
    g = rows.groupBy("covariate").agg(*[f(F.when(F.col("t") == F.lit(v), F.col("x"))).alias(f"{n}{int(v)}") for v in (False, True) for n, f in (("m", F.avg), ("v", F.var_samp))])
    g = g.select("covariate", F.abs(F.try_divide(F.col("m1") - F.col("m0"), F.sqrt((F.col("v1") + F.col("v0")) / 2))).alias("smd"), F.try_divide("v1", "v0").alias("variance_ratio"))
    return g.withColumn("balanced", F.col("smd") < 0.1)


def balance_change(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.select("covariate", F.col("smd").alias("before")), after.select("covariate", F.col("smd").alias("after"))
    return a.join(b, "covariate").withColumn("change", F.when(F.col("after") < F.col("before"), "improved").otherwise("worsened"))


def propensity(df: DataFrame, treated: str, covariates: Sequence[str]) -> DataFrame:
    """Rows with the logit of a fitted propensity score."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = VectorAssembler(inputCols=list(covariates), outputCol="_x").transform(df.dropna(subset=[treated, *covariates]))
    model = LogisticRegression(featuresCol="_x", labelCol=treated, predictionCol="_pr", probabilityCol="_pb", rawPredictionCol="_raw").fit(data.withColumn(treated, F.col(treated).cast("double")))
    return model.transform(data.withColumn(treated, F.col(treated).cast("double"))).withColumn("logit", vector_to_array("_raw")[1]).drop("_x", "_pr", "_pb", "_raw")


def neighbours(rows: DataFrame) -> DataFrame:
    """Rows (t, s, ...) of distinct scores with o: the nearest score of the other arm, the lower of two; null if there is none.

    All scores are sorted into ranges once; scans up and down carry the last score of each arm from range to range.
    """
    order = ["s", "t"]  # of equal scores the control comes first: it is below the treated one, which is above it
    parts = dealt(rows, [], order)
    for name, backwards in (("below", False), ("above", True)):
        other = {f"{name}_{arm}": ("last", F.when(F.col("t") == (arm == "t"), F.col("s"))) for arm in "tc"}
        parts = scanned(parts, [], order, other, backwards)
    low, high = (F.when(F.col("t"), F.col(f"{side}_c")).otherwise(F.col(f"{side}_t")) for side in ("below", "above"))
    out = parts.select(*rows.columns, low.alias("low"), high.alias("high"))
    return out.select(*rows.columns, F.expr("CASE WHEN high IS NULL OR s - low <= high - s THEN low ELSE high END").alias("o"))


def arms(scored: DataFrame, treated: str, key: str, score: str, caliper: float) -> tuple[DataFrame, float]:
    """(k, t, s) of the rows that have a score, stored, and the caliper in units of the score. Decimal scores stay exact."""
    s = F.col(score) if isinstance(scored.schema[score].dataType, T.DecimalType) else F.col(score).cast("double")
    rows = scored.where(F.col(score).isNotNull()).select(F.col(key).alias("k"), (F.col(treated) == 1).alias("t"), s.alias("s"))
    rows = stored(rows.where("t IS NOT NULL AND NOT isnan(s)"))
    sd = rows.agg(F.stddev_samp("s")).first()[0]
    return rows, caliper * sd if sd else caliper


def match(scored: DataFrame, treated: str, key: str, score: str = "logit", caliper: float = 0.2, replacement: bool = False, nearest_of: int | None = None) -> DataFrame:
    """(treated_key, control_key, distance) pairs within a caliper of so many standard deviations (so many units if all scores are equal).

    With replacement every treated row takes its nearest control: of two as near the lower score, of equal scores the
    smallest key. Differences of doubles carry noise in their last bits; decimal scores are compared exactly. Without it, pairs are mutually nearest scores in rounds until none is left, and rows of such scores pair
    off k-th with k-th by key. With nearest_of a treated row only takes one of its so many nearest controls, closest
    pairs first (``match_among``). Keys must be unique; rows without a score or arm take no part.
    """
    rows, width = arms(scored, treated, key, score, caliper)
    if replacement:
        first = rows.where("NOT t").groupBy(F.col("s").alias("o")).agg(F.min("k").alias("control_key"))
        near = neighbours(rows.select("t", "s").distinct()).where(F.col("t") & (F.abs(F.col("s") - F.col("o")) <= width))
        won = rows.where("t").select(F.col("k").alias("treated_key"), "s").join(near.select("s", "o"), "s").join(first, "o")
        return won.select("treated_key", "control_key", F.abs(F.col("s") - F.col("o")).cast("double").alias("distance"))
    if nearest_of is not None:
        return match_among(candidates(rows, nearest_of, width))
    return match_scores(rows, width)


SEGMENT = 200_000  # distinct scores that one task pairs off


def pair_off(arm: list, s: list, n: list, used: list, width: float, closed: bool) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Mutually nearest scores of a stretch in the order of (s, arm), closest first: deals (i, j, used of i, of j, m) and what stays open.

    Counts used are changed in place. Unless the stretch is closed, what lies beyond its ends is unknown: a score that could
    prefer something there to all that is left inside stays open, and so counts as unknown itself. Of two scores
    as near the lower one is preferred. Pairs that are each other's nearest stay so whatever pairs off elsewhere, so
    the deals are those of the whole line.
    """
    size, last = len(s), len(s) - 1
    before, after, alive, opened, deals = list(range(-1, last)), list(range(1, size + 1)), [True] * size, [], []
    heap = [(s[i + 1] - s[i], i, i + 1) for i in range(last) if arm[i] != arm[i + 1]]
    heapq.heapify(heap)
    ends, beyond = [0, last], [{True: s[0], False: s[0]}, {True: s[-1], False: s[-1]}]  # nearest that each arm can be beyond an end

    def watch_ends() -> None:
        if not closed and 0 <= ends[0] < size and alive[ends[0]]:
            i, j = ends
            heapq.heappush(heap, (s[i] - beyond[0][not arm[i]], -1, i))
            heapq.heappush(heap, (beyond[1][not arm[j]] - s[j], j, size))

    def remove(i: int) -> None:
        alive[i] = False
        low, high = before[i], after[i]
        if low >= 0:
            after[low] = high
        else:
            ends[0] = high
        if high < size:
            before[high] = low
        else:
            ends[1] = low
        if low >= 0 and high < size:
            if arm[low] != arm[high]:
                heapq.heappush(heap, (s[high] - s[low], low, high))
        else:
            watch_ends()

    watch_ends()
    while heap:
        distance, i, j = heapq.heappop(heap)
        if distance > width:
            break
        if i < 0 or j == size:
            side, at = (0, j) if i < 0 else (1, i)
            if alive[at] and ends[side] == at:
                opened.append(at)
                beyond[side][arm[at]] = s[at]
                remove(at)
        elif alive[i] and alive[j] and after[i] == j:
            m = min(n[i] - used[i], n[j] - used[j])
            deals.append((i, j, used[i], used[j], m))
            for at in (i, j):
                used[at] += m
                if used[at] == n[at]:
                    remove(at)
    return deals, opened


def pair_off_batches(width: float, closed: bool):
    def run(batches):
        rows = pd.concat([pd.DataFrame({"t": [], "s": [], "n": [], "used": []}, dtype=object), *(b.astype(object) for b in batches)]).sort_values(["s", "t"])
        if not len(rows):
            return
        arm, s, n, used = (rows[c].tolist() for c in ("t", "s", "n", "used"))
        deals, opened = pair_off(arm, s, n, used, width, closed)
        ordered = [(i, j, x, y, m) if arm[i] else (j, i, y, x, m) for i, j, x, y, m in deals]
        out = pd.DataFrame([(s[i], s[j], x, y, m) for i, j, x, y, m in ordered], columns=["st", "sc", "from_st", "from_sc", "m"], dtype=object)
        yield out.assign(t=None, s=None, n=None, used=None)
        yield pd.DataFrame([(arm[i], s[i], n[i], used[i]) for i in opened], columns=["t", "s", "n", "used"], dtype=object).assign(st=None, sc=None, from_st=None, from_sc=None, m=None)[["st", "sc", "from_st", "from_sc", "m", "t", "s", "n", "used"]]

    return run


def mutual_round(left: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """Deals of the scores that are each other's nearest now, and the scores left over that have one of the other arm within the width."""
    near = stored(neighbours(left).where(F.abs(F.col("s") - F.col("o")) <= width))
    a, b = (near.where(side).select(F.col("s").alias(x), F.col("o").alias(y), (F.col("n") - F.col("used")).alias(f"n_{x}"), F.col("used").alias(f"from_{x}")) for side, x, y in (("t", "st", "sc"), ("NOT t", "sc", "st")))
    won = stored(a.join(b, ["st", "sc"]).withColumn("m", F.least("n_st", "n_sc")).select("st", "sc", "from_st", "from_sc", "m"))
    taken = won.select(F.explode(F.array(F.struct(F.lit(True).alias("t"), F.col("st").alias("s"), "m"), F.struct(F.lit(False).alias("t"), F.col("sc").alias("s"), "m"))).alias("x")).select("x.*")
    rest = near.join(taken, ["t", "s"], "left").select("t", "s", "n", (F.col("used") + F.coalesce("m", F.lit(0))).alias("used"))
    return won, stored(rest.where("n > used"))


def match_scores(rows: DataFrame, width: float, segment: int = SEGMENT) -> DataFrame:
    """Mutually nearest scores pair off until none is left. Rounds see distinct scores and how many rows of each are left, so
    equal scores take one deal and no row moves; rows join by their place among equals at the end.

    The sorted scores are cut into stretches that tasks pair off (``pair_off``); what the cuts leave open goes on to the
    next round, with other cuts. While that is more than half of a round, a round over the whole line (``mutual_round``) follows.
    """
    left = stored(rows.groupBy("t", "s").agg(F.count("*").alias("n")).withColumn("used", F.lit(0).cast("long")))
    kind, size, deals = rows.schema["s"].dataType.simpleString(), left.count(), None
    while size:
        closed = size <= segment
        stretches = left.coalesce(1) if closed else left.repartitionByRange(math.ceil(size / segment) + 1, "s", "t")
        out = stored(stretches.mapInPandas(pair_off_batches(width, closed), f"st {kind}, sc {kind}, from_st long, from_sc long, m long, t boolean, s {kind}, n long, used long"))
        won, left = out.where("m IS NOT NULL").select("st", "sc", "from_st", "from_sc", "m"), out.where("m IS NULL").select("t", "s", "n", "used")
        deals = won if deals is None else deals.unionAll(won)
        size, was = left.count(), size
        if size > was / 2:
            won, left = mutual_round(left, width)
            deals, size = deals.unionAll(won), left.count()
    if deals is None:
        return rows.where("false").select(F.col("k").alias("treated_key"), F.col("k").alias("control_key"), F.col("s").cast("double").alias("distance"))
    placed = running(rows, ["t", "s"], ["k"], {"i": ("sum", F.lit(1).cast("long"))}).withColumn("i", F.col("i") - 1)
    deal = deals.select(F.col("st").alias("s"), F.col("from_st").alias("i"), F.struct("from_st", "sc", "from_sc", "m").alias("deal"))
    own = asof(placed.where("t").select("k", "s", "i"), deal, ["s"], "i", "deal").where(F.col("i") < F.col("deal.from_st") + F.col("deal.m"))
    own = own.select(F.col("k").alias("treated_key"), F.col("s").alias("ts"), F.col("deal.sc").alias("s"), (F.col("i") - F.col("deal.from_st") + F.col("deal.from_sc")).alias("i"))
    return own.join(placed.where("NOT t").select("s", "i", F.col("k").alias("control_key")), ["s", "i"]).select("treated_key", "control_key", F.abs(F.col("ts") - F.col("s")).cast("double").alias("distance"))


def candidates(rows: DataFrame, k: int, width: float) -> DataFrame:
    """(treated_key, control_key, distance): the k nearest controls of each treated row within the width, ties by key.

    They are among the k controls before and the k after it in the order of (score, key), which their ranks name: every
    treated row asks for 2 k ranks and meets each in one row.
    """
    order = ["s", "t", "k"]
    ranked = stored(running(rows, [], order, {"r": ("sum", (~F.col("t")).cast("long"))}), "ranked")
    near = F.explode(F.sequence(F.col("r") - k + 1, F.col("r") + k)).alias("r")
    asked = ranked.where("t").select(F.col("k").alias("treated_key"), F.col("s").alias("ts"), near)
    met = asked.join(ranked.where("NOT t").select("r", F.col("k").alias("control_key"), "s"), "r")
    met = met.withColumn("distance", F.abs(F.col("ts") - F.col("s"))).where(F.col("distance") <= width)
    best = met.groupBy("treated_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "control_key"))), 1, k).alias("best"))  # of 2 k at most
    return best.select("treated_key", F.explode("best").alias("x")).select("treated_key", "x.control_key", "x.distance")


def match_among(edges: DataFrame) -> DataFrame:
    """Greedy matching of candidate pairs, closest first (ties by keys): in rounds, a pair is won when it is the least of both."""
    left, pairs = stored(edges, "edges"), edges.where("false")
    rank = F.struct("distance", "treated_key", "control_key")
    while True:
        best = [left.groupBy(side).agg(F.min(rank).alias("x")).select("x.*") for side in ("treated_key", "control_key")]
        won = stored(best[0].join(best[1].select("treated_key", "control_key"), ["treated_key", "control_key"]).select(*edges.columns))
        if won.isEmpty():
            return pairs
        pairs = pairs.unionAll(won)
        left = stored(left.join(won.select("treated_key"), "treated_key", "left_anti").join(won.select("control_key"), "control_key", "left_anti").select(*edges.columns), "edges")


def att(pairs: DataFrame, outcomes: DataFrame, key: str, outcome: str, tails: bool = True) -> DataFrame:
    """Mean paired difference with its t."""
    o = lambda k, n: outcomes.select(F.col(key).alias(k), F.col(outcome).cast("double").alias(n))
    d = pairs.join(o("treated_key", "yt"), "treated_key").join(o("control_key", "yc"), "control_key")
    return paired(d, "yc", "yt", tails)


def paired(df: DataFrame, pre: str, post: str, tails: bool = True) -> DataFrame:
    d = F.col(post).cast("double") - F.col(pre).cast("double")
    g = df.agg(F.count(d).alias("n"), F.avg(d).alias("effect"), (F.stddev_samp(d) / F.sqrt(F.count(d))).alias("se")).withColumn("t", F.try_divide("effect", "se"))
    return g.withColumn("p", tl.p_t("t", (F.col("n") - 1).cast("double"))) if tails else g


def ols(df: DataFrame, outcome: str, terms: dict[str, Column], robust: bool = True, tails: bool = True) -> DataFrame:
    """Least squares with an intercept: X'X and X'y summed by Spark, k x k solved, second pass for the HC1 meat."""
    names = ["intercept", *terms]
    cols = [F.lit(1.0), *[c.cast("double") for c in terms.values()]]
    rows = df.select(F.col(outcome).cast("double").alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(cols)]).dropna()
    x, k = [F.col(f"_x{i}") for i in range(len(cols))], len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs], *[F.sum(x[i] * F.col("_y")).alias(f"t{i}") for i in range(k)]).first()

    def square(row, p: str) -> np.ndarray:
        m = np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = row[f"{p}{i}_{j}"]
        return m

    inv = np.linalg.pinv(square(sums, "s"))
    beta, n = inv @ np.array([sums[f"t{i}"] for i in range(k)]), sums["n"]
    e = F.col("_y") - reduce(lambda a, b: a + b, [float(b) * c for b, c in zip(beta, x, strict=True)])
    meat = rows.agg(F.sum(e * e).alias("sse"), *[F.sum(e * e * x[i] * x[j]).alias(f"m{i}_{j}") for i, j in pairs]).first()
    cov = inv @ square(meat, "m") @ inv * n / (n - k) if robust else inv * meat["sse"] / (n - k)
    rows_ = [(name, float(b), float(s), float(b / s) if s else None) for name, b, s in zip(names, beta, np.sqrt(np.diag(cov)), strict=True)]
    out = df.sparkSession.createDataFrame(rows_, "term string, estimate double, se double, z double")
    return out.withColumn("p", tl.p_normal("z")) if tails else out


def did_adjusted(df: DataFrame, outcome: str, treated: str, post: str, covariates: dict[str, Column], robust: bool = True, tails: bool = True) -> DataFrame:
    """Difference in differences with covariates: the terms of the regression, of which ``effect`` is that of treated x post."""
    t, p = F.col(treated).cast("double"), F.col(post).cast("double")
    return ols(df, outcome, {"treated": t, "post": p, "effect": t * p, **covariates}, robust, tails)


def dummies(df: DataFrame, column: str, most: int = 50) -> dict[str, Column]:
    """0/1 terms for all values but the first."""
    values = [r[0] for r in df.select(column).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return {f"{column}={v}": (F.col(column) == F.lit(v)).cast("int") for v in values[1:]}


def rosenbaum(pairs: DataFrame, treated: str, control: str, gammas: Sequence[float], tails: bool = True) -> DataFrame:
    """Bounds of the signed-rank test under hidden bias gamma."""
    d = pairs.select((F.col(treated) - F.col(control)).alias("d")).where("d <> 0")
    per = d.groupBy(F.abs("d").alias("a")).agg(F.count("*").alias("ties"), F.count_if(F.col("d") > 0).alias("up"))
    ranked = cumulated(per, [], "a", "ties").withColumn("rank", F.col("upto") - (F.col("ties") - 1) / 2)
    s = ranked.agg(F.sum(F.col("rank") * F.col("up")).alias("t"), F.sum(F.col("rank") * F.col("ties")).alias("s1"), F.sum(F.col("rank") ** 2 * F.col("ties")).alias("s2"))
    grid = pairs.sparkSession.createDataFrame([(float(g),) for g in gammas], "gamma double").withColumn("pr", F.col("gamma") / (1 + F.col("gamma")))
    out = s.crossJoin(grid)  # one row x a short list
    out = out.select("gamma", "t", ((F.col("t") - F.col("pr") * F.col("s1")) / F.sqrt(F.col("pr") * (1 - F.col("pr")) * F.col("s2"))).alias("z_upper"))
    return out.withColumn("p_upper", 1 - tl.phi("z_upper")) if tails else out


def confounds(df: DataFrame, day: str, split: str, columns: Sequence[str]) -> DataFrame:
    """Around a date: change of each numeric column's mean in standard deviations and of its null rate in points."""
    late = F.col(day).cast("date") >= F.lit(split).cast("date")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    rows = df.select(late.alias("late"), F.explode(cells).alias("c")).select("late", "c.column", "c.x")
    side = {"before": ~F.col("late"), "after": F.col("late")}
    nulls = {f"null_{n}": F.coalesce(F.try_divide(F.count_if(at & F.col("x").isNull()), F.count_if(at)), F.lit(0.0)) for n, at in side.items()}
    g = rows.groupBy("column").agg(*[F.avg(F.when(at, F.col("x"))).alias(n) for n, at in side.items()], F.stddev_samp("x").alias("sd"), *[c.alias(n) for n, c in nulls.items()])
    shift = F.try_divide(F.col("after") - F.col("before"), F.col("sd"))
    return g.withColumn("shift", shift).withColumn("flag", F.coalesce(F.abs("shift") > 0.1, F.lit(False)) | (F.abs(F.col("null_after") - F.col("null_before")) > 0.05))
