"""Streams against their batch forms: order, late rows, timers without events, batches that come again."""

from __future__ import annotations

import math
import random
import time
import uuid
from unittest import mock

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.streaming import sinks, stateful

TEST = T.StructType().add("k", "string").add("n", "long").add("log_e", "double").add("n_seen", "long").add("log_e_seen", "double")


def log_e(values, null_mean):
    s1 = s2 = out = 0.0
    for v in values:
        d = v - null_mean
        out += math.log(max(1e-10, 1 + (max(-0.5, min(0.5, s1 / s2)) if s2 > 0 else 0.0) * d))
        s1, s2 = s1 + d, s2 + d * d
    return out


def test_ordered_test_with_late_rows_equals_the_batch_form(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "b"]), 1_700_000_000 + 60 * rng.randrange(600), rng.gauss(1.1, 1) if i % 13 else None) for i in range(240)]
    part = {i: min(2, (t - 1_700_000_000) // 12_000 + (i % 7 == 0)) for i, _, t, _ in rows}  # some come a part late, within the delay
    rows += [(900, "a", 1_699_000_000, 50.0)]  # too late, in the last part
    df = spark.createDataFrame([(*r, part.get(r[0], 2)) for r in rows], "id long, k string, t long, v double, part int").withColumn("ts", F.timestamp_seconds("t"))
    root = sinks.stream_root(spark, uuid.uuid4().hex)
    build = lambda s: stateful.ordered_test(s, "k", "ts", "id", "v", 1.0, "4 hours")
    sinks.replay(df, F.col("part"), 3, root, build, sinks.epochs_into(f"{root}/out"), "update")
    got = {r["k"]: r for r in sinks.latest(spark, f"{root}/out", TEST, ["k"]).collect()}
    mark = max(r[2] for r in rows) - 4 * 3600
    for k in ("a", "b"):
        seen = sorted((t, i, v) for i, x, t, v in rows if x == k and v is not None and i != 900)
        final = [v for t, _, v in seen if t <= mark]
        assert (got[k]["n_seen"], got[k]["n"]) == (len(seen), len(final))
        assert got[k]["log_e_seen"] == pytest.approx(log_e([v for _, _, v in seen], 1.0)) and got[k]["log_e"] == pytest.approx(log_e(final, 1.0))


def test_a_key_turns_stale_without_new_events(spark):
    now = int(time.time())
    df = spark.createDataFrame([("x", now - s) for s in range(4)], "k string, t long").withColumn("ts", F.timestamp_seconds("t"))
    root = sinks.stream_root(spark, uuid.uuid4().hex)
    df.write.parquet(f"{root}/in")
    stream = stateful.freshness_watch(spark.readStream.schema(df.schema).parquet(f"{root}/in"), "k", "ts", every_ms=500, period_s=1)
    seen = []

    def put(batch, epoch):
        seen.extend((r["status"], r["last"], r["cadence"]) for r in batch.collect())  # a row a key

    with stateful.rocksdb(spark):
        q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(processingTime="1 second").start()
    end = time.monotonic() + 90
    while time.monotonic() < end and len(seen) < 3 and q.isActive:
        q.awaitTermination(0.3)
    assert q.exception() is None
    q.stop()
    assert len(seen) >= 3 and seen[-1] == ("stale", now, "daily")  # judged again by timers, and no second row ever came


def test_split_sinks_take_a_batch_again(spark):
    hour = lambda h: 1_700_000_000 + 3600 * h
    first = [(1, hour(10), 5.0), (2, hour(0), -1.0), (3, None, 5.0)]
    second = [(4, hour(11), 5.0), (5, hour(3), 5.0), (6, hour(4), -1.0), (7, hour(6), -1.0), (8, None, None)]
    schema = "id int, t long, v double"
    frame = lambda rows: spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("t"))
    root = sinks.stream_root(spark, uuid.uuid4().hex)
    put = sinks.split_sinks(root, {"low": F.col("v") < 0}, "ts", "5 hours")
    put(frame(first), 0)
    put(frame(second), 1)
    rows = lambda: sorted((r["id"], r["kind"], r["broken"], r["epoch"]) for r in sinks.split_rows(spark, root, frame(first).schema).collect())
    want = [(1, "passed", [], 0), (2, "diverted", ["low"], 0), (3, "passed", [], 0), (4, "passed", [], 1), (5, "late", [], 1), (6, "late", ["low"], 1), (7, "diverted", ["low"], 1), (8, "passed", [], 1)]
    assert rows() == want
    put(frame(second), 1)  # the same batch after a failure: the same watermark, no row twice
    put(frame([]), 2)
    assert rows() == want
    assert sinks.split_rows(spark, root, frame(first).schema, "late").count() == 2


class Held(dict):
    """A map or value state of one key."""

    containsKey, removeKey, exists = dict.__contains__, dict.pop, dict.__len__  # noqa: N815

    def getValue(self, key):  # noqa: N802
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))

    def get(self):
        return self["value"]

    def update(self, value):
        self["value"] = value


def test_waiting_rows_are_read_one_span_at_once():
    """All rows that wait were one list of tuples in Python, which grew with the input."""
    rng = random.Random(1)
    rows = [(1_700_000_000_000_000 + rng.randrange(30 * 86_400) * 1_000_000, i, rng.gauss(1.1, 1)) for i in range(40_000)]
    states, most = {}, []
    handle = mock.Mock(listTimers=lambda: [], getValueState=lambda n, s: states.setdefault(n, Held()), getMapState=lambda n, *s: states.setdefault(n, Held()))
    test = stateful.OrderedTest(1.0)
    test.HELD = 7_000
    test.init(handle)
    span = test._span
    test._span = lambda *a: (most.append(len(out := span(*a))), out)[1]
    frames = [pd.DataFrame(rows[i : i + 5_000], columns=["us", "id", "value"]) for i in range(0, 40_000, 5_000)]
    mark = 1_700_000_000_000 + 10 * 86_400_000 + 1234
    got = next(test.handleInputRows(("a",), iter(frames), mock.Mock(getCurrentWatermarkInMs=lambda: mark))).iloc[0]
    rows.sort()
    final = [v for us, _, v in rows if us <= mark * 1000]
    assert (got["n"], got["n_seen"]) == (len(final), len(rows)) and max(most) < 200
    assert got["log_e"] == pytest.approx(log_e(final, 1.0)) and got["log_e_seen"] == pytest.approx(log_e([v for *_, v in rows], 1.0))
    again = next(test.handleExpiredTimer(("a",), mock.Mock(getCurrentWatermarkInMs=lambda: mark + 10**12), None)).iloc[0]
    assert again["n"] == len(rows) and again["log_e"] == pytest.approx(got["log_e_seen"]) and not states["waiting"] and not states["spans"]
