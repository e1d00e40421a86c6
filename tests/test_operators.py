"""Hand-counted answers, known effects and edge rows."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars, tails
from brindle.operators import causal, logs, ordering, product, suites, profiling, semantic, series, sets, statistics, validation
from brindle.sources import tables as src


def test_tails_against_published_values():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert tails.chi2_upper(3.841, 1) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_upper(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_upper(4.10, 2, 10) == pytest.approx(0.05, abs=1e-3)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.beta_regular(2, 3, 0.5) == pytest.approx(0.6875)
    assert tails.gamma_upper(1, 2.0) == pytest.approx(math.exp(-2))


def test_first_return_counts_by_hand(spark):
    rows = [(1, "2024-11-02"), (1, "2024-12-05"), (2, "2024-11-20"), (2, "2024-12-31"), (3, "2024-11-30"), (4, "2024-10-31"), (4, "2024-12-01"), (5, "2024-12-02"), (None, "2024-11-05")]
    df = spark.createDataFrame(rows, "u int, d string").withColumn("d", F.to_date("d")).where("u IS NOT NULL")
    got = semantic.first_return(df, "u", "d", ("2024-11-01", "2024-12-01"), ("2024-12-01", "2025-01-01")).first()
    assert (got["eligible"], got["returning"]) == (3, 2) and got["pct"] == pytest.approx(200 / 3)
    empty = semantic.first_return(df, "u", "d", ("2020-01-01", "2020-02-01"), ("2020-02-01", "2020-03-01")).first()
    assert (empty["eligible"], empty["returning"], empty["pct"]) == (0, 0, None)
    with pytest.raises(ValueError):
        semantic.first_return(df, "u", "d", ("2024-11-01", "2024-12-15"), ("2024-12-01", "2025-01-01"))


def test_related_flag_keeps_rows_and_never_matches_null(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (2,)], "k int")
    right = spark.createDataFrame([(2,), (2,), (None,)], "r int")
    got = semantic.related_flag(left, right, {"k": "r"}).collect()
    assert sorted((r["k"] or 0, r["flag"]) for r in got) == [(0, 0), (1, 0), (2, 1), (2, 1)]


def test_interval_is_half_open_to_the_microsecond(spark):
    t = lambda us: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)
    life = spark.createDataFrame([(1, "start", t(10)), (1, "end", t(20)), (2, "start", t(10))], "u int, role string, ts timestamp_ntz")
    facts = spark.createDataFrame([(1, t(9)), (1, t(10)), (1, t(19)), (1, t(20)), (2, t(10**9)), (3, t(10))], "u int, ts timestamp_ntz")
    got = semantic.interval_flag(facts, semantic.intervals(life, "u", "role", "ts"), "u", "ts").orderBy("u", "ts").collect()
    assert [r["inside"] for r in got] == [0, 1, 1, 0, 1, 0]


def test_parameters_are_typed():
    rules = {"n": {"type": "integer", "min": 1, "max": 5}}
    for bad in ({}, {"n": True}, {"n": 9}, {"n": "2"}, {"n": 2, "m": 1}):
        with pytest.raises(ValueError):
            semantic.bind(rules, bad)


def test_paths_must_be_unique():
    edges = {("a", "b"): {}, ("b", "c"): {}}
    assert semantic.path(edges, "a", "c") == [("a", "b"), ("b", "c")]
    with pytest.raises(ValueError):
        semantic.path(edges | {("a", "c"): {}}, "a", "c")


def test_simpsons_paradox_is_found(spark):
    cells = [("A", "x", 80, 100), ("A", "y", 20, 100), ("B", "x", 46, 60), ("B", "y", 3, 20)]
    rows = [(g, d, int(i < k)) for g, d, k, n in cells for i in range(n)]
    df = spark.createDataFrame(rows, "g string, d string, m int")
    got = validation.simpson(df, "m", ["d"], "g").first()
    assert got["overall"] == pytest.approx(0.5 - 0.6125) and got["n_reversed"] == 2 and got["paradox"]


@pytest.mark.parametrize(("a", "b", "status"), [(5023, 4977, "PASS"), (5200, 4800, "BLOCK")])
def test_srm(spark, a, b, status):
    df = spark.range(a + b).select((F.col("id") < a).cast("int").alias("v"))
    assert statistics.srm(df, "v", {0: 0.5, 1: 0.5}).first()["status"] == status


def test_adjusted_p_values(spark):
    t = statistics.adjust(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")).orderBy("test").collect()
    assert [round(r["holm"], 6) for r in t] == [0.03, 0.06, 0.06] and [round(r["bh"], 6) for r in t] == [0.03, 0.04, 0.04]


def test_number_parser(spark):
    df = spark.createDataFrame([("12%",), ("$1,200",), ("(3k)",), ("2.5 million",), ("x",), (None,)], "s string")
    v, u, s = scalars.parse_number(F.col("s"))
    got = df.select(v.alias("v"), u.alias("u"), s.alias("s")).collect()
    assert [r["v"] for r in got] == [pytest.approx(0.12), 1200.0, -3000.0, 2500000.0, None, None]
    assert [r["u"] for r in got][:4] == ["rate", "currency", "number", "number"]


def test_alias_tags_take_the_longest(spark):
    texts = spark.createDataFrame([(1, "New York City and new york"), (2, None), (3, "")], "doc_id int, text string")
    names = spark.createDataFrame([("new york", "ny"), ("new york city", "nyc"), ("york", "y")], "alias string, entity string")
    got = sorted((r["doc_id"], r["entity"], r["at"]) for r in sets.alias_tags(texts, names).collect())
    assert got == [(1, "ny", 4), (1, "nyc", 0)]


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_ranked_sums_do_not_depend_on_partitions(spark, parts):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7 + 1).cast("double").alias("v")).repartition(parts)
    got = product.ranked_sums(df, "v", "id").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and got[-1]["running"] == sum(i % 7 + 1 for i in range(1000))


def test_constant_and_single_customers_score_three(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5.0)], "c int, d date, r double")
    got = product.rfm(df, "c", "d", "r", "2024-02-01").first()
    assert (got["r"], got["f"], got["m"]) == (3, 3, 3)


def test_edge_frames(spark):
    empty = spark.createDataFrame([], "k int, v double, d date, s string")
    assert validation.completeness(empty, ["v"]).first()["status"] == "PASS"
    assert validation.outliers(empty, "v").first()["status"] == "PASS"
    assert validation.primary_key(empty, ["k"]).first()["status"] == "PASS"
    assert profiling.columns_profile(empty).count() == 4
    assert statistics.welch(empty.withColumn("g", F.lit(0)), "g", "v", 0, 1, tails=False).first()["t_a_minus_b"] is None
    tied = spark.createDataFrame([(i, 1.0, dt.date(2024, 1, 1), None) for i in range(5)], "k int, v double, d date, s string")
    assert profiling.two_peaks(profiling.histogram(tied, "v", 10)).first()["bimodal"] is False
    assert validation.ratio_bounds(tied.withColumn("z", F.lit(0.0)), "v", "z", 0, 1).first()["n_zero_den"] == 5
    assert product.concentration(tied, "v", "k").first()["gini"] == pytest.approx(0)
    assert statistics.mann_whitney(tied.withColumn("g", F.col("k") % 2), "g", "v", 0, 1, tails=False).first()["z"] in (None, 0.0)
    dates = spark.createDataFrame([(20240131,), (20240230,), (7,), (None,)], "n int")
    assert [r[0] for r in dates.select(scalars.parse_yyyymmdd(F.col("n"))).collect()] == [dt.date(2024, 1, 31), None, None, None]


def test_seasonal_forecast_needs_a_season(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "series string, day date, value double")
    with pytest.raises(Exception, match="longer than the history"):
        series.naive(df, 3, "seasonal").collect()


def test_lineage_stops_at_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id int, parent int")
    got = logs.ancestors(edges, spark.createDataFrame([(1,)], "id int")).collect()
    assert sorted((r["id"], r["depth"]) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_csv_folder_and_result_round_trip(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,x\n2,y\n")
    found = src.csv_tables(spark, str(tmp_path))
    assert found["one"].count() == 2 and spark.table("one").count() == 2
    with pytest.raises(FileNotFoundError):
        src.csv_tables(spark, str(tmp_path), ["two"])
    digest = src.write_result(found["one"], str(tmp_path / "out"), "parquet").first()
    assert digest["n_rows"] == 2 and src.result_digest(spark.read.parquet(str(tmp_path / "out"))).first() == digest
    with pytest.raises(ValueError):
        src.query(spark, "SELECT ?", 1, 2)
    src.append_log(found["one"], str(tmp_path / "log"))
    src.append_log(found["one"], str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_matching_pairs_off_ties_and_ends_without_candidates(spark):
    from brindle.operators import causal

    tied = [(i, i % 2, 0.0) for i in range(40)] + [(100 + i, 1, 5.0) for i in range(10)] + [(200 + i, 0, 5.1) for i in range(12)]
    pairs = causal.match(spark.createDataFrame(tied, "k long, t int, logit double"), "t", "k").collect()
    assert sorted(r["treated_key"] for r in pairs) == [i for i, t, _ in tied if t == 1] and len({r["control_key"] for r in pairs}) == 30
    assert sorted({round(r["distance"], 6) for r in pairs}) == [0.0, 0.1]


def test_best_variant_and_expected_loss(spark):
    rows = {r["variant"]: r for r in statistics.prob_best(spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 1.0)], "variant string, mean double, var double")).collect()}
    z = 1 / math.sqrt(2)
    phi, density = 0.5 * (1 + math.erf(z / math.sqrt(2))), math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    loss_b = math.sqrt(2) * (density - z * (1 - phi))
    assert rows["b"]["p_best"] == pytest.approx(phi, abs=1e-3) and rows["b"]["expected_loss"] == pytest.approx(loss_b, abs=1e-3)
    assert rows["a"]["expected_loss"] == pytest.approx(loss_b + 1, abs=1e-3)


def test_suites_find_what_is_wrong(spark):
    rows = [(1, 5.0, "a"), (2, -1.0, "b"), (2, 7.0, None), (3, None, "z")]
    df = spark.createDataFrame(rows, "k int, price double, kind string")
    got = {r["check"]: (r["ok"], r["n_bad"]) for r in suites.structural(df, {"primary_key": ["k"], "required": ["price"], "domains": {"kind": ~F.col("kind").isin("a", "b")}, "rows": (1, 3)}).collect()}
    assert got == {"primary_key": (False, 2), "completeness": (False, 1), "value_domain": (False, 1), "row_count": (False, 1)}
    assert suites.verdict(suites.structural(df.where("k = 1"))).first().asDict() == {"checks_run": 2, "checks_passed": 2, "checks_failed": 0, "overall_ok": True}


def test_default_rules_name_columns_exactly(spark):
    df = spark.createDataFrame([(5, -5.0, 0.5, -0.1, "x")], "quantity int, account_balance double, discount double, revenue double, users string")
    assert suites.default_rules(df) == {"ranges": {}, "no_negative": ["revenue", "quantity"], "cardinality": {}}
    assert {r["check"]: r["status"] for r in suites.business(df).collect()} == {"negative_revenue": "BLOCKER", "negative_quantity": "PASS"}


def test_suites_without_rules_give_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    for rows in (suites.business(df), suites.business(df, {}), suites.logical(df, {}), suites.logical(df, {"metric": "k"})):
        assert rows.count() == 0 and rows.columns == ["check", "ok", "status", "n", "n_bad", "detail"]
    assert suites.verdict(suites.logical(df, {})).first()["overall_ok"]


def test_suites_on_empty_tables(spark):
    df = spark.createDataFrame([], "k int, x double, day date")
    full = {"primary_key": ["k", "day"], "required": ["x"], "dates": {"day": "day", "start": "2024-01-01"}, "domains": {"x": F.col("x") < 0}, "rows": (0, 5)}
    assert all(r["ok"] and r["n_bad"] == 0 for r in suites.structural(df, full).collect())
    config = {"metric": "x", "percentages": {"pct": "x", "group": "k"}, "trend": {"day": "day", "metric": "x"}, "continuity": {"day": "day", "metric": "x"}, "monotonic": {"order": "day", "value": "x"}, "balance": "k"}
    assert all(r["ok"] for r in suites.logical(df, config, df).collect())
    rules = {"segments": {"k": []}, "cardinality": {"k": (0, 1)}, "temporal": {"day": "day", "metric": "x"}, "metrics": {"a": F.sum("x")}, "relationships": [{"left": "a", "right": "a"}]}
    assert all(r["ok"] for r in suites.business(df, rules).collect())


def test_a_suite_reads_its_table_at_most_twice(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("FileScan parquet")
    one = {"required": o.columns, "domains": {f"r{i}": F.col("o_totalprice") < i for i in range(9)}, "rows": (1, None)}
    both = one | {"primary_key": ["o_orderkey"], "dates": {"day": "o_orderdate", "max_gap": 3}}
    assert scans(suites.structural(o, one)) == 1 and scans(suites.structural(o, both)) == 2
    rules = {"ranges": {"o_totalprice": (0, 1)}, "segments": {"o_orderstatus": ["F"]}, "cardinality": {"o_orderpriority": (1, 2), "o_custkey": (1, 9)}, "temporal": {"day": "o_orderdate", "metric": "o_totalprice"}}
    assert scans(suites.business(o, rules)) == 2 and suites.business(o, rules).count() == 5


def test_series_checks_by_hand(spark):
    values = [10.0, 10.5, 9.5, 10.0, 40.0, 0.0, 5.0, 5.1]
    rows = [(f"2024-01-{i + 1:02}", v / 2, "x") for i, v in enumerate(values) for _ in range(2)] + [(None, 99.0, "x")]
    df = spark.createDataFrame(rows, "d string, v double, seg string").withColumn("day", F.col("d").cast("date"))
    got = {r["check"]: (r["n"], r["n_bad"], r["status"]) for r in suites.logical(df, {"trend": {"day": "day", "metric": "v", "window": 3, "max_z": 3.0}, "continuity": {"day": "day", "metric": "v"}}).collect()}
    assert got == {"trend_consistency": (8, 1, "WARNING"), "trend_continuity": (8, 3, "BLOCKER")}
    assert [(r["n_bad"], r["status"]) for r in suites.business(df, {"temporal": {"day": "day", "metric": "v", "limit": 200}}).collect()] == [(2, "FAIL")]


def test_order_statistics_with_ties_nulls_and_empty_frames(spark):
    rows = [(k, None if v % 7 == 0 else float(v % 5)) for k in ("x", "y", None) for v in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["lo"], r["mid"]) for r in ordering.quantiles(df, {"v": F.col("v")}, {"lo": 0.1, "mid": 0.5}, ["k"]).collect()}
    want = {r["k"]: tuple(r["q"]) for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    assert got == want
    assert ordering.one_row(df.limit(0), {"v": F.col("v")}, {"mid": 0.5}).collect() == [(None,)]


def test_questions_in_literals_are_no_placeholders(spark):
    assert src.query(spark, "SELECT 'why?' AS q, ? + 1 AS n -- really?", 2).first() == ("why?", 3)
    with pytest.raises(ValueError):
        src.query(spark, "SELECT '?'", 1)


def test_a_warehouse_table_is_read_in_ranges(spark):
    url = "jdbc:derby:memory:brindle;create=true"
    spark.range(100).selectExpr("id", "id * 2 AS twice").write.format("jdbc").options(url=url, dbtable="numbers").save()
    df = src.jdbc(spark, url, "numbers", "id", 0, 100, 4)
    assert df.rdd.getNumPartitions() == 4 and df.where("twice >= 100").count() == 50


def test_aliases_of_any_length_and_punctuation(spark):
    texts = spark.createDataFrame([(1, "The United States of America, and the U.S. too; united states."), (2, None), (3, "")], "doc_id int, text string")
    aliases = spark.createDataFrame([("United States of America", "us"), ("united-states", "us"), ("U.S.", "us"), ("", "none")], "alias string, entity string")
    got = sorted((r["at"], r["alias"]) for r in sets.alias_tags(texts, aliases).collect())
    assert got == [(1, "united states of america"), (7, "u s"), (10, "united states")]
    assert sets.alias_tags(texts, aliases.limit(0)).isEmpty()


def test_lineage_of_a_long_chain_with_a_cycle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(60, 0)], "id int, parent int")
    got = logs.ancestors(edges, spark.createDataFrame([(0,)], "id int")).collect()
    assert {(r["id"], r["depth"]) for r in got} == {(i, i) for i in range(61)}


def test_small_beta_posteriors_are_exact():
    assert tails.beta_better(1, 1, 1, 1) == pytest.approx(0.5, abs=1e-6)
    assert tails.beta_better(1, 2, 2, 1) == pytest.approx(5 / 6, abs=1e-4)


def test_retention_interval_and_gaps(spark):
    cells = spark.createDataFrame([(c, o, 0.1 * c / (o + 1)) for c in (1, 2, 3) for o in range(4 - c)], "cohort int, offset int, rate double")
    rows = {r["offset"]: r for r in product.retention_curve(cells, 0.95).collect()}
    assert rows[0]["low"] == 0.0 and rows[0]["high"] == pytest.approx(0.2 + 4.3027 * 0.1 / 3**0.5, abs=1e-3) and rows[2]["low"] is None
    assert {r["n_cohorts"] for r in product.retention_curve(cells, mature=2).collect()} == {1}
    days = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("2024-01-06",)], "d string").withColumn("d", F.to_date("d"))
    assert validation.coverage(days, "d", "day", max_gap=2).first()["status"] == "FAIL" and validation.coverage_gaps(days, "d").first()["n"] == 3


def test_numbers_in_phrases_with_hints(spark):
    rows = ["about 12 apples", "-3.5%", "4 percent of users", "up 2 percentage points", "EUR 1,200", "5 million users", "($1.5m)", "+7", "no number", None]
    df = spark.createDataFrame([(r,) for r in rows], "s string")

    def parsed(hint=None):
        v, u, _ = scalars.parse_number(F.col("s"), hint)
        return [(None if r["v"] is None else round(r["v"], 9), r["u"]) for r in df.select(v.alias("v"), u.alias("u")).collect()]

    want = [(12.0, "number"), (-0.035, "rate"), (0.04, "rate"), (0.02, "rate"), (1200.0, "currency"), (5e6, "number"), (-1.5e6, "currency"), (7.0, "number"), (None, None), (None, None)]
    assert parsed() == want
    assert parsed("percent")[0] == (0.12, "rate") and parsed("percent")[1] == (-0.035, "rate") and parsed("ratio")[0] == (12.0, "rate") and parsed("count")[0] == (12.0, "count")


def test_did_with_covariates_is_least_squares(spark):
    rng = np.random.default_rng(2)
    t, p, x = rng.integers(0, 2, 300), rng.integers(0, 2, 300), rng.normal(5, 2, 300)
    y = 1 + 0.5 * t + 2 * p + 3 * t * p + 0.7 * x + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(t, p, x, y, strict=True)], "t int, p int, x double, y double")
    got = {r["term"]: (r["estimate"], r["se"]) for r in causal.did_adjusted(df, "y", "t", "p", {"x": F.col("x")}, tails=False).collect()}
    m = np.column_stack([np.ones(300), t, p, t * p, x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    e, inv = y - m @ beta, np.linalg.inv(m.T @ m)
    se = np.sqrt(np.diag(inv @ (m.T * e**2) @ m @ inv * 300 / 295))
    for k, name in enumerate(["intercept", "treated", "post", "effect", "x"]):
        assert got[name] == (pytest.approx(beta[k], abs=1e-8), pytest.approx(se[k], abs=1e-8))


def test_null_rates_are_a_confound(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", 3.0), ("2024-02-01", None), ("2024-02-02", 2.0)], "d string, x double")
    r = causal.confounds(df, "d", "2024-01-15", ["x"]).first()
    assert (r["null_before"], r["null_after"], r["shift"], r["flag"]) == (0.0, 0.5, 0.0, True)


def test_few_valued_columns(spark):
    df = spark.createDataFrame([(i, i % 19, i % 20, "x", i % 2 == 0) for i in range(400)], "id int, a int, b int, c string, d boolean")
    assert statistics.few_valued(df) == ["a", "d"] and statistics.few_valued(df, ["b"], 20) == ["b"] and statistics.few_valued(df.select("c")) == []
    assert statistics.srm_by_segments(df.select("id", "d"), "d", {True: 1, False: 1}, tails=False).isEmpty()


def test_fitted_rows_agree_with_the_smoother(spark):
    y = [float((i * 7) % 11 + i % 7) for i in range(30)]
    df = spark.createDataFrame([("a", f"2024-01-{i + 1:02}", v) for i, v in enumerate(y)] + [("b", "2024-01-01", 4.0)], "series string, day string, value double")
    rows = series.holt_winters_fitted(df, 7, 0.3).orderBy("series", "day").collect()
    want = series.smooth_one(np.array(y), 0.3, 0.1, 0.1, 7)[0]
    assert [r["fitted"] for r in rows[:30]] == pytest.approx(want.tolist()) and rows[30]["residual"] == 0.0
    simple = series.simple_fitted(df, 0.3).orderBy("series", "day").collect()
    assert [r["fitted"] for r in simple[:30]] == pytest.approx(series.smooth_one(np.array(y), 0.3, None, 0.0, None)[0].tolist()) and len(simple) == 31
    best = series.holt_winters(df.where("series = 'a'"), 3, 7).first()
    errors = {a: float(np.mean((np.array(y) - series.smooth_one(np.array(y), a, 0.1, 0.1, 7)[0]) ** 2)) for a in (i / 100 for i in range(1, 100))}
    assert best["mse"] == pytest.approx(min(errors.values())) and best["alpha"] == pytest.approx(min(errors, key=errors.get))


def test_sample_values_and_shapes(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v), str(i % 7), None) for i, v in enumerate(np.concatenate([rng.normal(0, 1, 900), rng.normal(8, 1, 300)]))], "x double, s string, n int")
    assert {r["column"]: r["values"] for r in profiling.sample_values(df.select("s", "n")).collect()} == {"s": ["0", "1", "2", "3", "4"]}
    assert profiling.shape_class(df, "x").first()["shape"] == "bimodal"
    assert profiling.shape_class(df.where("x < 4"), "x").first()["shape"] == "normal"
    assert profiling.shape_class(df.limit(0), "x").count() <= 1


def test_intermediate_tables_are_released(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "i int, x double")
    assert ordering.one_row(df, {"x": F.col("x")}, {"mid": 0.5}).first()[0] == 2.0
    assert ordering.release(spark) >= 1 and ordering.release(spark) == 0


def test_means_on_a_tie_do_not_depend_on_the_noise_of_the_sum(spark):
    """The exact mean is 0.0498955, the sum of doubles in this order gives a little less, which was rounded down."""
    rng = random.Random(0)
    values = [rng.randrange(11) / 100 for _ in range(20_000)]
    assert sum(round(100 * v) for v in values) == 99791
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert profiling.columns_profile(df).first()["mean"] == 0.049896
