"""Operators on events: nearest time, runs, frequent values, distinct counts."""

import os
import random
import uuid
from math import inf

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftnet.llm import distinct, frequent
from siftnet.llm import runs as runs_of
from siftnet.llm.nearest import nearest_in_time
from siftnet.llm.runs import Frontier, _by_groups, _open_pieces, collapse_runs, segment, whole_costs

L, R = "fw_id bigint, t bigint, k string, event_id string, b string", "event_id string, t bigint, k string, fw_id string, rid string, lid string, d bigint"


def near(spark, left, right, tol):
    a = spark.createDataFrame([(i, t, k, "x", "y") for i, t, k in left], L)
    b = spark.createDataFrame([(i, t, k, "x", "y", "z", 1) for i, t, k in right], R)
    return sorted((r.fw_id, r.event_id) for r in nearest_in_time(a, b, "fw_id", "event_id", F.col("k"), F.col("k"), "t", "t", tol).collect())


def brute_near(left, right, tol):
    out = {}
    for i, t, k in left:
        c = [(abs(u - t), u, e) for e, u, q in right if None not in (i, t, k, e, u) and q == k and abs(u - t) <= tol]
        if c:
            out[i] = min(c)[2]
    return sorted(out.items())


def test_nearest(spark):
    rnd = random.Random(2)
    right = [(f"e{i:03d}", rnd.choice([rnd.randrange(-3000, 3000), 500]), rnd.choice(["hot", "hot", "a", "b", None])) for i in range(400)]
    left = [(i, rnd.randrange(-3200, 3200), rnd.choice(["hot", "hot", "a", "b", "c", None])) for i in range(300)]
    for tol in (0, 1, 7, 100):
        assert near(spark, left + left[:50], right + right[:50], tol) == brute_near(left, right, tol)


def test_nearest_edges(spark):
    assert near(spark, [], [("e", 1, "k")], 5) == near(spark, [(1, 1, "k")], [], 5) == []
    assert near(spark, [(1, 10, "k")], [("b", 4, "k"), ("a", 16, "k")], 6) == [(1, "b")]  # as near: the earlier one
    assert near(spark, [(1, 10, "k")], [("b", 10, "k"), ("a", 10, "k")], 0) == [(1, "a")]  # as early: the smaller id
    assert near(spark, [(1, 10, "k")], [("b", 17, "k"), ("c", None, "k"), (None, 10, "k"), ("d", 10, None)], 6) == []
    with pytest.raises(ValueError):
        near(spark, [(1, 1, "k")], [], -1)


def cost(kinds, starts, penalty, mismatch):
    total = -penalty
    for a, b in zip(starts, [*starts[1:], len(kinds)]):
        part = kinds[a:b]
        odd = len(part) - max(part.count(x) for x in part)
        total += penalty + (odd * mismatch if odd else 0)
    return total


def test_segment_is_optimal():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randrange(1, 10)
        kinds = [rnd.randrange(3) for _ in range(n)]
        penalty, mismatch = rnd.choice([(1.0, 0.4), (1.0, 1.5), (2.0, 0.7), (1.0, inf)])
        got = segment(kinds, [False] + [True] * (n - 1), penalty, mismatch)
        best = min(cost(kinds, [0] + [i for i in range(1, n) if m >> i & 1], penalty, mismatch) for m in range(0, 1 << n, 2))
        assert abs(cost(kinds, got, penalty, mismatch) - best) < 1e-9


E_ = "h string, event_id string, t bigint, kind string, k string, chunk bigint, n bigint"


def brute_runs(rows, gap, least):
    by = {}
    for h, i, t, k in set(rows):
        if None not in (h, i, t, k):
            by.setdefault(h, []).append((t, i, k))
    out = []
    for h, xs in by.items():
        run = []
        for x in [*sorted(xs), None]:
            if run and (x is None or x[2] != run[-1][2] or x[0] - run[-1][0] > gap):
                if len(run) >= least:
                    out.append((h, run[0][1], run[-1][1], len(run), run[-1][0] - run[0][0]))
                run = []
            if x:
                run.append(x)
    return sorted(out)


def runs(spark, rows, gap, least, chunk):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], E_)
    got = collapse_runs(df, F.col("h"), F.col("kind"), "t", "event_id", gap, least=least, chunk_us=chunk, key_name="h")
    return sorted((r.h, r.first_event_id, r.last_event_id, r.n_events, r.duration_us) for r in got.collect())


def test_runs(spark):
    rnd = random.Random(6)
    rows = []
    for h in ("hot", "ab", "c"):
        t = 0
        for i in range(600 if h == "hot" else 40):
            t += rnd.choice([0, 1, 5, 5, 10, 11, 40])
            rows.append((h, f"{h}{i:04d}", t, rnd.choice("aaaab")))
    rows += rnd.sample(rows, 60) + [(None, "z", 1, "a"), ("c", None, 1, "a"), ("c", "y", None, "a"), ("c", "w", 1, None)]
    for least, chunk in ((1, 50), (3, 50), (3, 7), (2, 10**6)):
        assert runs(spark, rows, 10, least, chunk) == brute_runs(rows, 10, least)
    assert runs(spark, [], 10, 1, 50) == []

def plain_segment(kinds, near, penalty, mismatch):
    """Every start tried for every end; of equally good ones the earliest."""
    n = len(kinds)
    penalty, mismatch = whole_costs(penalty, mismatch)
    cost = [-penalty] + [0.0] * n
    begin = [0] * n
    starts = []  # start, cost up to it, count by kind, most frequent count, events
    for i in range(n):
        if not near[i]:
            starts = []
        starts.append([i, cost[i], {}, 0, 0])
        best, at, kind = inf, i, kinds[i]
        for s in starts:
            counts = s[2]
            c = counts[kind] = counts.get(kind, 0) + 1
            if c > s[3]:
                s[3] = c
            s[4] += 1
            odd = s[4] - s[3]
            w = s[1] + odd * mismatch if odd else s[1]
            if w + penalty < best:
                best, at = w + penalty, s[0]
        cost[i + 1], begin[i] = best, at
    out, i = [], n - 1
    while i >= 0:
        out.append(begin[i])
        i = begin[i] - 1
    return out[::-1]


def test_pruning_changes_nothing():
    rnd = random.Random(11)
    for _ in range(600):
        n = rnd.randrange(1, 60)
        kinds, stay = [0], rnd.random()
        while len(kinds) < n:
            kinds.append(kinds[-1] if rnd.random() < stay else rnd.randrange(rnd.choice([2, 4, 50])))
        near = [False] + [rnd.random() < 0.9 for _ in range(n - 1)]
        for costs in ((1.0, 0.4), (1.0, 1.5), (2.0, 0.7), (3.0, 0.1), (1.0, inf)):
            assert segment(kinds, near, *costs) == plain_segment(kinds, near, *costs)


def tolerant_by_hand(rows, gap, penalty, mismatch):
    """The whole sequence of each entity divided at once."""
    by = {}
    for h, i, t, k in set(rows):
        by.setdefault(h, []).append((t, i, k))
    out = []
    for h, xs in by.items():
        xs.sort()
        codes = {k: n for n, k in enumerate(sorted({x[2] for x in xs}))}
        near = [False] + [b[0] - a[0] <= gap for a, b in zip(xs, xs[1:])]
        begin = plain_segment([codes[x[2]] for x in xs], near, penalty, mismatch)
        for a, b in zip(begin, [*begin[1:], len(xs)]):
            out.append((h, xs[a][1], xs[b - 1][1], b - a, xs[b - 1][0] - xs[a][0]))
    return sorted(out)


@pytest.mark.parametrize("kinds,step", [("aaaaaaaab", [0, 1, 5, 40]), ("ab", [0, 1, 2]), ("aaabbbc", [1, 2, 3, 11])])
def test_tolerant_runs_whatever_the_chunks(spark, kinds, step):
    rnd = random.Random(len(kinds))
    rows = []
    for h, n in (("hot", 500), ("few", 30), ("one", 1)):
        t, kind = 0, "a"
        for i in range(n):
            t += rnd.choice(step)
            kind = kind if rnd.random() < 0.4 else rnd.choice(kinds)
            rows.append((h, f"{h}{i:04d}", t, kind))
    rows += rnd.sample(rows, 40)
    for penalty, mismatch in ((1.0, 0.4), (1.0, 1.5), (2.0, 0.3)):
        want = tolerant_by_hand(rows, 10, penalty, mismatch)
        for chunk in (3, 60, 10**6):
            df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], E_)
            got = collapse_runs(df, F.col("h"), F.col("kind"), "t", "event_id", 10, penalty, mismatch, chunk_us=chunk, key_name="h")
            assert sorted((r.h, r.first_event_id, r.last_event_id, r.n_events, r.duration_us) for r in got.collect()) == want


def test_runs_of_one_kind_whatever_the_chunks(spark):
    """Where an unlike event costs more than two boundaries, or just as much, chunks change nothing either."""
    rnd = random.Random(21)
    rows = []
    for h, n in (("hot", 400), ("few", 30), ("one", 1)):
        t, kind = 0, "a"
        for i in range(n):
            t += rnd.choice([0, 0, 1, 5, 11])
            kind = kind if rnd.random() < 0.6 else rnd.choice("ab")
            rows.append((h, f"{h}{i:04d}", t, kind))
    rows += rnd.sample(rows, 40)
    for penalty, mismatch in ((1.0, 3.0), (0.1, 0.21), (1.0, 2.0), (1.0, inf)):
        want = tolerant_by_hand(rows, 10, penalty, mismatch)
        assert mismatch == 2 * penalty or want == brute_runs(rows, 10, 1)
        for chunk in (3, 60, 10**6):
            df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], E_)
            got = collapse_runs(df, F.col("h"), F.col("kind"), "t", "event_id", 10, penalty, mismatch, chunk_us=chunk, key_name="h")
            assert sorted((r.h, r.first_event_id, r.last_event_id, r.n_events, r.duration_us) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["p7_found", "p7_runs"])
def test_runs_come_by_the_dynamic_programming(spark, data, tmp_path, monkeypatch, name):
    """Every event is weighed at a finite cost; no run is found beside that."""
    seen = str(tmp_path)

    def spy(kinds, near, penalty, mismatch):
        with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
            f.write(f"{len(kinds)} {penalty} {mismatch}")
        return segment(kinds, near, penalty, mismatch)

    monkeypatch.setattr(runs_of, "segment", spy)
    runs_of.QUERIES[name](spark, data).collect()
    calls = [open(os.path.join(seen, x)).read().split() for x in os.listdir(seen)]
    assert calls and all(2 * float(p) < float(m) < inf for _, p, m in calls)
    monkeypatch.undo()
    events = sum(r.n_events for r in runs_of.p7_runs(spark, data).select("n_events").collect())
    weighed = sum(int(n) for n, _, _ in calls)
    assert weighed >= events and weighed % events == 0  # the plan may divide the same shuffled rows for inner and for outer runs


def test_long_pieces_are_settled_as_they_come():
    """A sequence without any sure cut is divided with few rows held, as if at once."""
    rnd = random.Random(3)
    kinds = [rnd.choice("abc") if i % 7 else "a" for i in range(3000)]
    want = plain_segment([ord(k) for k in kinds], [False] + [True] * 2999, 1.0, 0.6)
    f, got, most = Frontier(1.0, 0.6), [], 0
    for lo in range(0, 3000, 50):
        f.push(kinds[lo : lo + 50], [lo > 0] + [True] * 49)
        got += f.settled()[:-1]
        most = max(most, f.size - f.base)
    assert got + f.finish() == want and most < 1500


@pytest.mark.parametrize("patience", [10, 37, 10_000])
def test_open_pieces_of_any_length(patience):
    """Long pieces are divided as they stream by, short ones together, all as if each were divided at once."""
    rnd = random.Random(12)
    rows, want = [], []
    for seg, n in enumerate([3, 200, 1, 45, 500, 2, 2, 38]):
        t, kinds, near = 0, [], []
        for i in range(n):
            gap = rnd.choice([1, 2, 2, 3, 20 if seg % 2 else 3])
            t += gap
            kinds.append(rnd.choice("aab" if seg % 3 else "abcdefgh"))
            near.append(i > 0 and gap <= 10)
            rows.append((b"k", seg, t, f"{seg}.{i:04d}".encode(), kinds[-1], seg in (1, 4) and i < 2, seg == 4 and i >= n - 2))
        begin = plain_segment([ord(k) for k in kinds], near, 1.0, 0.4)
        ends = [*begin[1:], n]
        want += [(f"{seg}.{a:04d}", f"{seg}.{b - 1:04d}", b - a, seg in (1, 4) and a == 0, seg == 4 and b == n) for a, b in zip(begin, ends)]
    schema = pa.schema([("k", pa.binary()), ("seg", pa.int64()), ("t", pa.int64()), ("id", pa.binary()), ("kind", pa.string()), ("goes_on", pa.bool_()), ("open_end", pa.bool_())])
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    got = pa.Table.from_batches(list(_open_pieces(10, 1.0, 0.4, patience)(iter(table.to_batches(max_chunksize=16)))))
    assert sorted(zip(*([x.decode() if isinstance(x, bytes) else x for x in got.column(c).to_pylist()] for c in ("id", "last_id", "n", "goes_on", "open_end")))) == sorted(want)


def test_groups_come_in_parts():
    """A group of more rows than may be held is divided between times only."""
    rows = [("hot", i // 3, f"{i:04d}") for i in range(100)] + [("b", 1, "x"), ("c", 2, "y")]
    t = pa.table({"k": [r[0] for r in rows], "t": pa.array([r[1] for r in rows], pa.int64()), "id": [r[2] for r in rows]})
    parts = list(_by_groups(lambda ts: iter([pa.concat_tables(ts)]), ["k"], 20)(iter(t.to_batches(max_chunksize=7))))
    assert pa.concat_tables(parts).equals(t) and max(p.num_rows for p in parts) < 40
    ends = [(p.column("k")[-1].as_py(), p.column("t")[-1].as_py()) for p in parts]
    assert len(set(ends)) == len(ends)


def test_code():
    h = np.array([random.Random(i).getrandbits(64) for i in range(200)], dtype=np.uint64)
    for x, s in zip(h.tolist(), frequent.symbols_of(h)):
        assert frequent.decode_symbols(s.tolist()) == x
        rnd = random.Random(x)
        for w in range(2):
            for i in rnd.sample(range(12), rnd.choice([1, 2])):
                s[w * 12 + i] ^= rnd.randrange(1, 16)
        assert frequent.decode_symbols(s.tolist()) == x


def test_frequent(spark):
    n = 60_000
    v = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "fifty").when(F.col("id") % 199 == 2, "rare").otherwise(F.concat(F.lit("v"), F.col("id")))
    df = spark.range(n).select(v.alias("v"), F.col("id").cast("string").alias("i"), F.lit(1).alias("n"), F.lit("x").alias("id"), F.lit(0).alias("h"))
    df = df.unionByName(df.where("v = 'rare'")).unionByName(df.where("v = 'fifty'").limit(7))  # delivered again
    exact = {r.v: r.c for r in df.dropDuplicates(["i"]).groupBy("v").agg(F.count("*").alias("c")).collect()}
    for share in ("0.01", "0.006", "0.003"):
        got = {r.value: r.n_rows for r in frequent.frequent_values(df, F.col("v"), share, "i").collect()}
        assert got == {k: c for k, c in exact.items() if c >= float(share) * n}
    tied = spark.createDataFrame([("a",), ("b",), (None,), ("",)], "v string")
    assert sorted(r.value for r in frequent.frequent_values(tied, F.col("v"), "0.3").collect()) == ["", "a", "b"]
    assert frequent.frequent_values(tied.where("v = 'none'"), F.col("v"), "0.3").count() == 0
    with pytest.raises(ValueError):
        frequent.frequent_values(tied, F.col("v"), "0")


def test_frequent_that_repeats(spark):
    """More repetitions than the slack allows for make it look for less."""
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id") % 1500).alias("v"), F.col("id").cast("string").alias("i"))
    heavy = spark.range(40).select(F.lit("h").alias("v"), F.concat(F.lit("h"), "id").alias("i"))
    noise = spark.range(20_000).select(F.lit("loud").alias("v"), F.lit("same").alias("i"))
    got = frequent.frequent_values(df.unionByName(heavy).unionByName(noise), F.col("v"), "0.01", "i").collect()
    assert [(r.value, r.n_rows, r.n_total) for r in got] == [("h", 40, 3041)]


def test_small_shares_in_bounded_memory(spark):
    """Shares that would need gigabytes of counters are found by way of heavy groups, none of them missed."""
    n = 200_000
    v = F.when(F.col("id") % 1000 == 0, F.concat(F.lit("t"), F.col("id") % 7000)).when(F.col("id") % 4001 == 1, "rare").otherwise(F.concat(F.lit("v"), F.col("id")))
    df = spark.range(n).select(v.alias("v"), F.col("id").cast("string").alias("i"))
    df = df.unionByName(df.where("v = 'rare'")).unionByName(spark.range(5).select(F.lit(None).cast("string").alias("v"), F.col("id").cast("string").alias("i")))
    exact = {r.v: r.c for r in df.dropDuplicates(["i"]).where("v is not null").groupBy("v").agg(F.count("*").alias("c")).collect()}
    for share, dense in (("0.0001", 12), ("0.00025", 12), ("0.0001", 7)):
        got = {r.value: r.n_rows for r in frequent.frequent_values(df, F.col("v"), share, "i", dense_bits=dense).collect()}
        assert got == {k: c for k, c in exact.items() if c >= float(share) * n} and got
    # what a share of one in a million needs: bitmaps in tasks and driver, the dense counters would be 2 x 2^23 x 384 x 8 bytes
    bits = min(23, frequent.SIEVE_BITS)
    assert 2 * (1 << bits) // 8 < 200e6 < 2 * (1 << bits) * 384 * 8
    assert frequent.frequent_values(df.where("v = 'none'"), F.col("v"), "0.000001").count() == 0


def test_groups_are_decoded_or_counted():
    rnd = random.Random(8)
    h = np.array([rnd.getrandbits(64) for _ in range(60)], dtype=np.uint64)
    for n in (np.r_[500, np.full(59, 3)], np.full(60, 10), np.r_[90, 90, 80, np.full(57, 2)], np.arange(60)):
        for least in (10, 50, 1000):
            assert sorted(frequent.decode_group(h, n.astype(np.int64), least)) == sorted(h[n >= least].tolist())


def test_groups_that_stay_heavy_are_counted():
    counts = np.zeros((2, 128, frequent.POSITIONS, frequent.SYMBOLS), dtype=np.int64)
    same = np.array([7, 7 | 1 << 40, 7 | 1 << 50], dtype=np.uint64)  # one group in every repetition
    frequent.count_symbols(np.repeat(same, [50, 40, 30]), 2, 7, counts)
    assert counts[0, 7, 0].sum() == 120 and counts[1, 0, 0].sum() == 120
    found = frequent.decode_counts(counts, 7, 20)
    assert 7 in found


EV = "id binary, domain string, source_hash string, day_utc string, network_segment string"


def test_distinct(spark):
    m = distinct.REGISTERS
    rows = spark.range(30_000).select(F.col("id").cast("string").cast("binary").alias("id"), F.concat(F.lit("d"), F.col("id") % 5000).alias("domain"), F.concat(F.lit("s"), F.col("id") % 40).alias("source_hash"), F.when(F.col("id") % 3 == 0, "2024-01-01").otherwise("2024-01-02").alias("day_utc"), F.lit("default").alias("network_segment"))
    got = {(r.measure, r.day_utc, r.network_segment): r for r in distinct.distinct_counts(rows.unionByName(rows.limit(500)), 1e-6).collect()}
    assert len(got) == 12
    for measure, want in (("domain", 5000), ("source_hash", 40)):
        r = got[measure, "ALL", "ALL"]
        assert r.n_events == 30_000 and r.low <= want <= r.high and abs(r.estimate / want - 1) < 6 / (m - 2) ** 0.5
    assert got["domain", "2024-01-01", "ALL"].n_events == 10_000
    assert distinct.distinct_counts(spark.createDataFrame([], EV)).count() == 0


def test_sketches_are_unbiased():
    m, n = 64, 300
    est = []
    for k in range(150):
        h = np.random.default_rng(k).integers(0, 2**64, n, dtype=np.uint64)
        est.append((m - 1) / distinct.least_exponentials(h, np.array([0]), m).sum())
    assert abs(np.mean(est) / n - 1) < 4 / (m - 2) ** 0.5 / 150**0.5
    h = np.random.default_rng(1).integers(0, 2**64, 9000, dtype=np.uint64)
    whole = distinct.least_exponentials(h, np.array([0]), m)[0]
    parts = distinct.least_exponentials(h, np.array([0, 10, 8000]), m)
    assert np.array_equal(whole, parts.min(axis=0))


def test_limits():
    assert abs(distinct.gamma_quantile(1, 1 - np.exp(-2)) - 2) < 1e-9
    lo, hi = distinct.gamma_quantile(256, 0.025), distinct.gamma_quantile(256, 0.975)
    x = np.random.default_rng(0).gamma(256, size=200_000)
    assert abs(((x > lo) & (x < hi)).mean() - 0.95) < 0.003
