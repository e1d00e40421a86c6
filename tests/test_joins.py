"""Joins by order, running states and matching against plain versions."""

from __future__ import annotations

import math
import random
import statistics as plain

import pytest
from pyspark.sql import functions as F

from brindle.operators import causal, joins, logs, product, records, sets
from brindle.operators import statistics as st
from brindle.operators.ordering import dealt, running, scanned


def test_asof_takes_the_latest_row_of_a_hot_key(spark):
    rng = random.Random(1)
    who = lambda: "hot" if rng.random() < 0.8 else rng.choice(["a", "b", None])
    left = [(i, who(), rng.choice([None, *range(50)]), "x") for i in range(400)]
    right = [(who(), rng.choice([None, *range(50)]), rng.choice([None, *range(100)])) for _ in range(300)]
    a = spark.createDataFrame(left, "id int, by string, at int, hit string")  # a column that clashes
    b = spark.createDataFrame(right, "by string, at int, q int")
    got = {r["id"]: (r["q"], r["hit"]) for r in joins.asof(a, b, ["by"], "at", "q").collect()}
    want = {}
    for i, w, t, x in left:
        seen = [(u, q) for v, u, q in right if v == w and u is not None and q is not None and t is not None and u <= t]
        want[i] = (max(seen)[1] if seen else None, x)
    assert got == want
    assert joins.asof(a, b.limit(0), ["by"], "at", "q").where("q IS NOT NULL").isEmpty() and joins.asof(a.limit(0), b, ["by"], "at", "q").isEmpty()


@pytest.mark.parametrize("spread", [0.0, 0.0004, 0.5])
def test_tolerance_join_against_all_pairs(spark, spread):
    """Also with every value within the tolerance of every other, and values on the very edge of it."""
    rng = random.Random(7)
    value = lambda: rng.choice([None, 0.0, math.nan, math.inf]) if rng.random() < 0.1 else rng.choice([-1, 1]) * 1000.0 * (1 + spread * rng.random())
    left = [(i, rng.choice(["d", "d", "d", "e", None]), value()) for i in range(300)]
    right = [(i, rng.choice(["d", "d", "d", "e", None]), value()) for i in range(300)]
    edge = [v + s * 0.001 * abs(v) for _, _, v in left[:60] if v is not None and math.isfinite(v) for s in (-1, 1)]
    right += [(1000 + i, "d", x) for i, v in enumerate(edge) for x in (v, math.nextafter(v, 0), math.nextafter(v, 1e9))]
    a, b = spark.createDataFrame(left, "id int, day string, v double"), spark.createDataFrame(right, "hit int, day string, v double")
    got = {r["id"]: r["hit"] for r in joins.least_within(a, b, "id", ["day"], "v", "hit", 0.001).collect()}
    want = {}
    for i, d, v in left:
        near = [h for h, e, x in right if d is not None and d == e and v is not None and x is not None and math.isfinite(v) and math.isfinite(x) and abs(x - v) <= 0.001 * abs(v)]
        if near:
            want[i] = min(near)
    assert got == want


def test_tolerance_join_builds_no_pairs(spark):
    """A thousand claims and entries of one day and one value: no step has more than a few rows for each of them."""
    n = 1000
    a = spark.range(n).select("id", F.lit("d").alias("day"), (100 + F.col("id") * 1e-6).alias("v"))
    b = a.select(F.col("id").alias("hit"), "day", "v")
    got = joins.least_within(a, b, "id", ["day"], "v", "hit", 0.001)
    assert got.agg(F.count("*"), F.max("hit")).first() == (n, 0)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in text and "Join Cross" not in text


def test_findings_of_one_author_are_reconciled(spark):
    entries = spark.createDataFrame([(i, i * 10, "a" if i % 3 else "b", float(i), "d") for i in range(1, 40)], "query_id long, at int, by string, value double, bucket string")
    rows = [(1, 9, "a", 1e6, None, "d"), (2, 25, "a", 1e6, None, "d"), (3, 400, "b", 1e6, [77], "d"), (4, 400, "b", 1e6, [5, 77], "d"), (5, 5, "a", 12.0001, None, "d"), (6, 400, None, 1e6, None, "d"), (7, None, "a", None, None, None)]
    findings = spark.createDataFrame(rows, "claim_id long, at int, by string, value double, cited array<long>, bucket string")
    got = {r["claim_id"]: (r["query_id"], r["how"]) for r in logs.reconcile(findings, entries).collect()}
    assert got == {1: (None, "orphan"), 2: (2, "latest"), 3: (39, "latest"), 4: (5, "cited"), 5: (12, "value"), 6: (None, "orphan"), 7: (None, "orphan")}


@pytest.mark.parametrize("mean", [0.0, 1e8])
def test_running_moments_keep_the_variance(spark, mean):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 5 else "b", None if i % 11 == 0 else mean + rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, k string, x double")
    got = {r["i"]: r["m"] for r in running(df.repartition(7), ["k"], ["i"], {"m": ("moments", F.col("x"))}).collect()}
    seen = {"hot": [], "b": []}
    for i, k, x in rows:
        if x is not None:
            seen[k].append(x)
        m = got[i]
        assert m["n"] == len(seen[k])
        if m["n"] > 1:
            assert m["mean"] == pytest.approx(plain.fmean(seen[k]), rel=1e-12) and m["m2"] / (m["n"] - 1) == pytest.approx(plain.variance(seen[k]), rel=1e-6)


def test_confidence_sequence_at_a_large_mean(spark):
    rng = random.Random(5)
    xs = [1e8 + rng.random() for _ in range(300)]
    df = spark.createDataFrame([(i, "k", x) for i, x in enumerate(xs)], "i int, k string, x double")
    far = {r["i"]: r["high"] - r["low"] for r in st.confidence_sequence(df, "x", "k", ["i"]).where("n >= 2").collect()}
    near = {r["i"]: r["high"] - r["low"] for r in st.confidence_sequence(df.withColumn("x", F.col("x") - 1e8), "x", "k", ["i"]).where("n >= 2").collect()}
    assert all(far[i] == pytest.approx(near[i], rel=1e-5) and far[i] > 0.1 for i in far)


@pytest.mark.parametrize("backwards", [False, True])
def test_scans_in_both_directions(spark, backwards):
    rng = random.Random(6)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(20)])) for i in range(300)]
    df = dealt(spark.createDataFrame(rows, "i int, k string, x int").repartition(3), ["k"], ["i"])
    steps = {name: (name, F.col("x")) for name in ("sum", "max", "min", "last")}
    got = {r["i"]: tuple(r[c] for c in steps) for r in scanned(df, ["k"], ["i"], steps, backwards).collect()}
    state = {}
    for i, k, x in rows[::-1] if backwards else rows:
        own = state.setdefault(k, [])
        own += [] if x is None else [x]
        assert got[i] == ((sum(own), max(own), min(own), own[-1]) if own else (None,) * 4)


def sample_arms(spark, seed, n=160, values=None):
    rng = random.Random(seed)
    rows = [(i, int(rng.random() < 0.4), rng.choice(values) if values else rng.gauss(0, 1)) for i in range(n)] + [(1000, 1, None), (1001, 0, math.nan), (1002, None, 0.1)]
    return spark.createDataFrame(rows, "k int, t int, s double").repartition(5), [r for r in rows if r[1] is not None and r[2] is not None and not math.isnan(r[2])]


def width_of(rows):
    return 0.2 * (plain.stdev([s for _, _, s in rows]) or 5.0)


@pytest.mark.parametrize("values", [None, [0.0, 1.0, 1.1, 1.2, 5.0], [2.0]])
def test_matching_with_replacement(spark, values):
    df, rows = sample_arms(spark, 1, values=values)
    w = width_of(rows) if values != [2.0] else 0.2
    want = []
    for k, t, s in rows:
        near = [(abs(s - u), u, c) for c, v, u in rows if t and not v and abs(s - u) <= w]
        if near:
            want.append((k, min(near)[2], min(near)[0]))
    assert sorted(tuple(r) for r in causal.match(df, "t", "k", "s", replacement=True).collect()) == want


@pytest.mark.parametrize("values", [None, [0.0, 1.0, 1.1, 1.2, 5.0]])
def test_matching_without_replacement_takes_mutually_nearest_scores(spark, values):
    df, rows = sample_arms(spark, 2, values=values)
    w, left, want = width_of(rows), [list(r) for r in rows], []
    while True:
        arm = {v: {s: sorted(k for k, t, u in left if t == v and u == s) for _, t, s in left if t == v} for v in (0, 1)}
        near = lambda s, others: min(((abs(s - u), u) for u in others), default=(math.inf, 0))
        won = [(s, o) for s in arm[1] for d, o in [near(s, arm[0])] if d <= w and near(o, arm[1])[1] == s]
        if not won:
            break
        for s, o in won:
            want += [(a, b, abs(s - o)) for a, b in zip(arm[1][s], arm[0][o], strict=False)]
        gone = {k for p in want for k in p[:2]}
        left = [r for r in left if r[0] not in gone]
    assert sorted(tuple(r) for r in causal.match(df, "t", "k", "s").collect()) == sorted(want)


def test_matching_among_the_nearest(spark):
    df, rows = sample_arms(spark, 3)
    w, edges = width_of(rows), []
    controls = sorted((s, k) for k, t, s in rows if not t)
    for k, t, s in rows:
        if t:
            at = sum(u <= s for u, _ in controls)
            near = sorted((abs(s - u), c) for u, c in controls[max(0, at - 3) : at + 3] if abs(s - u) <= w)[:3]
            edges += [(d, k, c) for d, c in near]
    used, want = set(), []
    for d, a, b in sorted(edges):
        if a not in used and b - 10_000 not in used:
            used |= {a, b - 10_000}
            want.append((a, b, d))
    got = sorted(tuple(r) for r in causal.match(df, "t", "k", "s", nearest_of=3).collect())
    assert got == sorted(want) and len({r[1] for r in got}) == len(got)


def test_matching_of_a_hot_score_and_of_nothing(spark):
    """Ten thousand rows of one score pair off in one round."""
    df = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("t"), F.lit(1.0).alias("s"))
    got = causal.match(df, "t", "k", "s")
    assert got.agg(F.count("*"), F.count_distinct("control_key"), F.max("distance")).first() == (2500, 2500, 0.0)
    for how in ({}, {"replacement": True}, {"nearest_of": 2}):
        assert causal.match(df.where("t = 1"), "t", "k", "s", **how).isEmpty() and causal.match(df.limit(0), "t", "k", "s", **how).isEmpty()


def test_foreign_keys_of_a_source(spark):
    a = spark.createDataFrame([(1, 7, "x"), (2, 7, "y"), (3, 9, None), (4, None, "z")], "id int, team_id long, name string")
    b = spark.createDataFrame([(7, "x", 1), (8, "y", 2), (9, "z", 3)], "id int, name string, users_id int")
    c = spark.createDataFrame([("7", 1.5)], "team_id string, user double")
    got = {(r["from_table"], r["from_column"], r["to_table"], r["to_column"]): (r["confidence"], r["method"], r["one_to_one"]) for r in sets.foreign_keys({"users": a, "teams": b, "logs": c}).collect()}
    assert got == {("users", "team_id", "teams", "id"): (pytest.approx((0.8 + 1) / 2 + 0.1), "both", False), ("teams", "users_id", "users", "id"): (pytest.approx((0.8 + 1) / 2 + 0.1), "both", False)}
    assert sets.foreign_keys({"a": a.select("name")}).isEmpty() and sets.foreign_keys({"users": a.limit(0), "teams": b.limit(0)}).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_anomaly_period_against_all_runs(spark, seed):
    rng = random.Random(seed)
    rows = [(s, f"2024-{1 + d // 28:02}-{1 + d % 28:02}", rng.gauss(100, 5) + (s == "up") * 40 * (30 <= d < 37) - (s == "down") * 30 * (50 <= d < 60)) for s in ("up", "down", "calm", None) for d in range(84)]
    rows += [("flat", f"2024-01-{d:02}", 5.0) for d in range(1, 9)] + [("up", "2024-05-01", None)]
    df = spark.createDataFrame(rows, "s string, d string, v double").withColumn("d", F.col("d").cast("date"))
    got = {r["s"]: r for r in product.anomaly_period(df, "d", "v", ["s"]).collect()}
    want = {}
    for s in ("up", "down", "calm", None):
        days = [(d, v) for x, d, v in rows if x == s and v is not None]
        m, sd = plain.fmean(v for _, v in days), plain.stdev([v for _, v in days])
        runs = []
        for sign in (1, -1):
            for i in range(len(days)):
                total = 0.0
                for j in range(i, len(days)):
                    total += sign * (days[j][1] - m) / sd - 0.5
                    runs.append((total, days[i][0], days[j][0], sum(v for _, v in days[i : j + 1])))
        want[s] = max(runs)
    assert got.keys() == want.keys()
    for s, (score, first, last, actual) in want.items():
        r = got[s]
        assert (str(r["first_day"]), str(r["last_day"])) == (first, last) and r["score"] == pytest.approx(score, abs=1e-5) and r["actual"] == pytest.approx(actual)
    assert (str(got["up"]["first_day"]), got["up"]["n_days"], got["up"]["direction"]) == ("2024-02-03", 7, "above") and got["down"]["direction"] == "below"
    assert product.anomaly_period(df.where("s = 'calm'").drop("s"), "d", "v").count() == 1 and product.anomaly_period(df.limit(0), "d", "v").isEmpty()


@pytest.mark.parametrize("block", [7, 10_000])
def test_planted_typos_are_found_in_a_large_block(spark, block, monkeypatch):
    """Half of the records begin alike; every record has a copy with a typo, some at the front, and a third are exact copies."""
    monkeypatch.setattr(records, "BLOCK", block)
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    people = [(("common" if i % 2 else word(6)) + " " + word(8), word(10), str(rng.randrange(10**6))) for i in range(150)]
    typo = lambda s, k: s[:k] + "#" + s[k + 1 :]
    planted = {}
    for i, (a, b, c) in enumerate(people):
        x = (typo(a, rng.choice([0, len(a) - 1])), b, c) if i % 3 == 0 else (a, typo(b, rng.randrange(10)), c) if i % 3 == 1 else (a, b, typo(c, 0))
        planted["|".join((a, b, c))] = "|".join(x)
    rows = people + [tuple(x.split("|")) for x in planted.values()] + [people[0]] * 100 + [(None, None, None), (None, None, None)]
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"]) for r in records.near_records(spark.createDataFrame(rows, "a string, b string, c string"), ["a", "b", "c"], 0.93, 4).collect()}
    want = {tuple(sorted(p)) for p in planted.items()}
    assert want <= got.keys() and len(got) <= len(want) + 5
    first = "|".join(people[0])
    assert {n for p, n in got.items() if first in p} in ({(1, 101)}, {(101, 1)})
    assert records.near_records(spark.createDataFrame([], "a string, b string"), ["a", "b"]).isEmpty()


def test_volume_anomalies_count_missing_days(spark):
    rows = [f"2024-01-{d:02}" for d in range(1, 29) for _ in range(20 + d % 3) if d != 25] + [None]
    got = records.volume_anomalies(spark.createDataFrame([(r,) for r in rows], "d string"), "d", 10, 3.0).collect()
    assert [(str(r["day"]), r["n"]) for r in got] == [("2024-01-25", 0)]


def test_alias_tags_carry_no_text_with_a_word(spark, tmp_path):
    """A word took its whole text along, so one long text made rows of the square of its length."""
    long = " ".join(["the", "end", "of", "it"] * 20_000)
    spark.createDataFrame([(1, long)], "doc_id int, text string").write.parquet(f"{tmp_path}/texts")
    names = spark.createDataFrame([("the end", "te"), ("end of it the", "eoit"), ("it", "i")], "alias string, entity string")
    got = {r["entity"]: r["count"] for r in sets.alias_tags(spark.read.parquet(f"{tmp_path}/texts"), names).groupBy("entity").count().collect()}
    assert got == {"eoit": 19_999, "i": 1}


def test_distinct_counts_come_from_groups(spark):
    """The sketch travelled with every distinct value: an Expand and a sketch in each of its rows."""
    df = spark.range(5000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 1000).alias("v"))
    out = sets.count_distinct(df, "v")
    got = out.first()
    assert got["exact"] == 1000 and abs(got["approximate"] - 1000) <= 60
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_decimal_scores_are_matched_exactly(spark):
    """As doubles 8.3 is nearer to 8.5 than to 8.1, by the last bit, so the greater of two as near was taken."""
    rows = [(1, 1, "8.30"), (2, 0, "8.10"), (3, 0, "8.50"), (4, 0, "99.00")]
    df = spark.createDataFrame(rows, "k int, t int, s string").withColumn("s", F.col("s").cast("decimal(18,2)"))
    got = [tuple(r) for r in causal.match(df, "t", "k", "s", replacement=True).collect()]
    assert got == [(1, 2, pytest.approx(0.2))]


@pytest.mark.parametrize("seed", range(3))
def test_stretches_pair_off_as_the_whole_line_does(spark, seed):
    """Cut at any place, a stretch only deals what the whole line deals, and rounds over short stretches end with the same pairs."""
    rng = random.Random(seed)
    for size in (1, 2, 7, 60, 300):
        items = sorted({(rng.randrange(400 if seed else 40), rng.random() < 0.3 + 0.2 * seed) for _ in range(size)})
        arm, s, n = [a for _, a in items], [float(x) for x, _ in items], [rng.randrange(1, 4) for _ in items]
        whole, opened = causal.pair_off(arm, s, n, [0] * len(items), 6.0, True)
        assert not opened
        for low, high in ((0, len(items) // 2), (len(items) // 3, len(items)), (len(items) // 4, len(items) // 2)):
            if low < high:
                used = [0] * (high - low)
                deals, opened = causal.pair_off(arm[low:high], s[low:high], n[low:high], used, 6.0, False)
                assert {(i + low, j + low, *rest) for i, j, *rest in deals} <= set(whole)
                settled = {i + low for i in range(high - low)} - {i + low for i in opened}
                assert all(d in {(i + low, j + low, *rest) for i, j, *rest in deals} for d in whole if d[0] in settled or d[1] in settled)
    rows = spark.createDataFrame([(k, rng.random() < 0.5, float(rng.randrange(300))) for k in range(600)], "k int, t boolean, s double")
    short, long = (sorted(map(tuple, causal.match_scores(rows, 6.0, segment=most).collect())) for most in (40, 1000))
    assert short == long and len(short) > 200
