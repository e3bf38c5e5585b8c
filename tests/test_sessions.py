import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftnet.operators.sessions import close_bitmap, runs_of_chunks, sessionize

S = "h string, ts timestamp, event_id string, t bigint, key string, n bigint, slot bigint"


def brute(rows, gap):
    ids = {}
    for k, t, i in rows:
        if k is not None and t is not None:
            ids.setdefault((k, i if i is not None else object()), t)
    by = {}
    for (k, _), t in ids.items():
        by.setdefault(k, []).append(t)
    out = []
    for k, ts in by.items():
        ts.sort()
        start = prev = ts[0]
        n = 0
        for t in ts:
            if t - prev > gap:
                out.append((k, start, prev, n))
                start, n = t, 0
            prev, n = t, n + 1
        out.append((k, start, prev, n))
    return sorted(out)


def run(spark, rows, gap, res):
    df = spark.createDataFrame([(k, None, i, t, "x", 1, 2) for k, t, i in rows], S).withColumn("ts", F.timestamp_micros("t"))
    got = sessionize(df, F.col("h"), gap_us=gap, resolution_us=res)
    return sorted((r.key, r.start_us, r.end_us, r.n_events) for r in got.collect())


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        t = rnd.randrange(-10_000, 10_000)
        for i in range(rnd.randrange(1, 60)):
            t += rnd.choice([0, 1, 49, 50, 51, 99, 100, 101, 102, 500, 7_000, 300_000])
            rows.append((f"{k:x}" * (1 + k % 3), t, f"e{k}-{i}"))
    rows += rnd.sample(rows, 100)  # delivered again
    for res in (1, 7, 10, 50, 100, 1000):
        assert run(spark, rows, 100, res) == brute(rows, 100)


def test_edges(spark):
    assert run(spark, [], 100, 10) == []
    assert run(spark, [(None, 5, "a"), ("k", None, "b")], 100, 10) == []
    # a gap of exactly the limit stays together, one more splits; equal times and null ids count
    assert run(spark, [("k", 0, "a"), ("k", 100, "b"), ("k", 201, "c")], 100, 10) == [("k", 0, 100, 2), ("k", 201, 201, 1)]
    assert run(spark, [("k", 0, None), ("k", 0, None), ("k", 1, "x"), ("k", 1, "x")], 0, 10) == [("k", 0, 0, 2), ("k", 1, 1, 1)]
    assert run(spark, [("", 0, "a"), ("AB", 0, "b"), ("ab", 0, "c"), ("00ab", 1, "d")], 10, 10) == [("", 0, 0, 1), ("00ab", 1, 1, 1), ("AB", 0, 0, 1), ("ab", 0, 0, 1)]


def test_one_hot_key(spark):
    ids = spark.range(200_000)
    df = ids.select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 977))).alias("h"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.col("id").cast("string").alias("event_id"))
    got = {r.key: r.n_events for r in sessionize(df, F.col("h"), gap_us=3000, resolution_us=1000).where("key = 'hot'").collect()}
    assert got == {"hot": 66_667}


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 500), min_size=1, max_size=80), st.integers(1, 140))
def test_closing(slots, reach):
    x = np.zeros((1, 12), dtype=np.uint64)
    for s in slots:
        x[0, s // 64] |= np.uint64(1) << np.uint64(s % 64)
    y = close_bitmap(x, reach)
    got = {i for i in range(12 * 64) if y[0, i // 64] >> np.uint64(i % 64) & np.uint64(1)}
    want, ordered = set(slots), sorted(slots)
    for a, b in zip(ordered, ordered[1:]):
        if b - a <= reach:
            want |= set(range(a, b))
    assert got == want


def test_runs_are_trimmed():
    z = np.array([0, 0, 0, 1])
    c, lo, hi, n = runs_of_chunks(z, np.array([9, 3, 500, 0]), np.array([95, 31, 5000, 7]), np.array([99, 35, 5001, 8]), np.array([2, 1, 3, 4]), 6)
    assert list(zip(c.tolist(), lo.tolist(), hi.tolist(), n.tolist())) == [(0, 31, 99, 3), (0, 5000, 5001, 3), (1, 7, 8, 4)]
