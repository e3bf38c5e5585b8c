"""State that people change, networks, identities, designed scores: small cases with nulls, ties and empty tables."""

import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from siftnet.functions.net import cidr, network
from siftnet.operators import identity as I
from siftnet.operators import management as M
from siftnet.operators import rules, scoring

EV = "event_id string, acknowledged boolean, ack_reason string, x int"


def test_acknowledging(spark):
    ev = spark.createDataFrame([("a", None, None, 1), ("b", True, "old", 2), ("c", False, None, 3), (None, None, None, 4)], EV)
    marks = spark.createDataFrame([("a", "seen"), ("a", "again"), ("a", None), ("b", None), ("z", "x"), (None, "y")], "event_id string, reason string")
    got = sorted((r.x, r.event_id, r.acknowledged, r.ack_reason) for r in M.acknowledge(ev, marks).collect())
    assert got == [(1, "a", True, "again"), (2, "b", False, None), (3, "c", False, None), (4, None, False, None)]
    assert M.acknowledge(ev.limit(0), marks).count() == 0 and M.acknowledge(ev, marks.limit(0)).count() == 4


def test_corrections_hold(spark):
    from siftnet.operators.devices import upsert_devices

    s = "device string, hostname string, vendor string, ip string, first_us bigint, last_us bigint, device_type string, confidence double, locked boolean"
    known = spark.createDataFrame([("m", "h", None, "1", 5, 6, "tv", 0.8, None), ("n", None, None, "2", 5, 6, None, None, False)], s)
    fixed = M.correct_identity(known, spark.createDataFrame([("m", "camera"), ("m", None), ("q", "x"), (None, "y")], "device string, device_type string"))
    assert {r.device: (r.device_type, r.confidence, r.locked) for r in fixed.collect()} == {"m": ("camera", 1.0, True), "n": (None, None, False)}
    scan = spark.createDataFrame([("m", "k", "V", "1", 7, 8, "pc", 1.0, False)], s).drop("locked")
    assert {r.device: (r.device_type, r.hostname) for r in upsert_devices(fixed, scan).collect()}["m"] == ("camera", "k")


def test_passive_merge(spark):
    s = "device string, hostname string, vendor string, ports array<int>, first_us bigint, last_us bigint, device_type string, confidence double, locked boolean"
    a = spark.createDataFrame([("m", None, "V", [80], 5, 6, "tv", 0.5, False), ("n", "h", None, None, 5, 6, "pc", 0.2, True), ("o", None, None, [1], 1, 2, None, None, None)], s)
    b = spark.createDataFrame([("m", "k", "W", [22], 4, 9, "nas", 0.6, False), ("n", "z", None, [22], 7, 9, "nas", 0.9, False), ("p", None, None, None, 3, 3, "tv", 0.1, False), ("o", None, None, None, 3, 3, "tv", None, False)], s)
    got = {r.device: (r.hostname, r.vendor, r.ports, r.first_us, r.last_us, r.device_type, r.confidence) for r in M.merge_passive(a, b).collect()}
    assert got == {"m": ("k", "V", [80], 4, 9, "nas", 0.6), "n": ("h", None, [22], 5, 9, "pc", 0.2), "p": (None, None, None, 3, 3, "tv", 0.1), "o": (None, None, [1], 1, 3, None, None)}


def test_rules_change(spark):
    s = "rule_id string, category string, name string, built_in boolean, enabled boolean"
    r = spark.createDataFrame([("a", "c", "n", True, True), ("b", "c", "m", None, True)], s)
    assert {x.rule_id for x in M.delete_rule(M.delete_rule(r, "a"), "b").collect()} == {"a"}
    assert {x.rule_id: x.enabled for x in M.set_enabled(r, "b", False).collect()} == {"a": True, "b": False}
    assert M.add_rule(r, r).count() == 2 and M.seed(r.limit(0), r).count() == 2 and M.seed(r.limit(1), r).count() == 1


NETS = ["10.1.2.9/22", "192.168.1.0/24", "10.0.0.0/8", "1.2.3.4", "1.2.3.4/32", "0.0.0.0/0", "10.1.2.9/255.255.252.0", "2001:db8::1/33", "2001:db8::/64", "fe80::1/128", "::/0", "10.0.0.0/33", "10.0.0.0/255.0.255.0", "x/8", "10.0.0.0/-1", "10.0.0.0/8/9", "", None]


def test_networks(spark):
    got = {r.n: r.w for r in spark.createDataFrame([(n,) for n in NETS], "n string").select("n", network("n").alias("w")).collect()}
    for n in NETS:
        try:
            want = ipaddress.ip_network(n, strict=False) if n else None
        except ValueError:
            want = None
        if want is None:
            assert got[n] is None, n
        else:
            assert ipaddress.ip_network(got[n]) == want, n


def test_addresses_in_networks(spark):
    rnd = random.Random(6)
    nets = [f"{rnd.choice(['10', '172', '192'])}.{rnd.randrange(4)}.{rnd.randrange(256)}.0/{rnd.randrange(7, 33)}" for _ in range(40)] + ["2001:db8::/45", "2001:db8:8::/47", None, "bad"]
    ips = [f"{rnd.choice(['10', '172', '192', '8'])}.{rnd.randrange(4)}.{rnd.randrange(256)}.{rnd.randrange(256)}" for _ in range(200)] + [f"2001:db8:{rnd.randrange(16):x}::{i}" for i in range(20)] + ["::ffff:10.1.1.1", "name", "", None]
    real = [ipaddress.ip_network(n, strict=False) for n in nets if n not in (None, "bad")]

    def inside(a):
        try:
            x = ipaddress.ip_address(a)
        except ValueError:
            return False
        x = getattr(x, "ipv4_mapped", None) or x
        return any(x.version == n.version and x in n for n in real)

    got = M.in_networks(spark.createDataFrame([(i,) for i in ips + ips[:9]], "a string"), "a", spark.createDataFrame([(n,) for n in nets], "c string"), "c")
    assert sorted(r.a for r in got.collect()) == sorted({i for i in ips if i and inside(i)})
    none = spark.createDataFrame([], "c string")
    assert M.in_networks(got, "a", none, "c").count() == 0 and M.in_networks(got.limit(0), "a", spark.createDataFrame([("10.0.0.0/8",)], "c string"), "c").count() == 0
    assert spark.createDataFrame([("10.0.0.0/8",)], "c string").select(cidr("c").alias("n")).first().n.hi == "0affffff"


def test_fused_identity(spark):
    d = spark.createDataFrame([("1", "b8:27:eb:00:00:01", "iPhone-7", None), ("2", "B827EB000002", None, "V"), ("3", None, " ps5-x ", "W"), ("4", None, "nothing", "X"), ("5", None, None, None)], "device string, mac string, hostname string, vendor string")
    p = spark.createDataFrame([("b8-27-eb", "Pi", "computer"), ("b8:27:EB:99", "Pi", "computer"), (None, "none", None)], "prefix string, vendor string, device_type string")
    got = {r.device: (r.device_type, r.vendor, r.os_family, r.model, r.confidence) for r in I.fuse(d, p).collect()}
    assert got == {"1": ("phone", "Pi", "iOS", None, 0.9), "2": ("computer", "Pi", None, None, 0.2), "3": ("game_console", "Sony", None, "PlayStation 5", 0.8), "4": (None, "X", None, None, 0.1), "5": (None, None, None, None, 0.0)}
    v = {r.v: r.x for r in spark.createDataFrame([("Nest Labs",), ("GOOGLE inc",), ("Acme",), (None,)], "v string").select("v", I.infer_from_vendor(F.col("v")).alias("x")).collect()}
    assert (v["Nest Labs"].vendor, v["Nest Labs"].device_type) == ("Google", "iot_generic") and v["GOOGLE inc"].device_type is None and v["Acme"].vendor == "acme" and v[None] is None


def test_profiles(spark):
    d = spark.createDataFrame([("1", "V", None, [1, None]), ("2", None, "H", None), ("3", "x", "y", [])], "device string, vendor string, hostname string, ports array<int>")
    p = spark.createDataFrame([("a", ["v"], None, None, "tv", 0.5), ("b", None, None, [1], "pc", 0.5), ("c", None, ["h", None], None, "nas", 0.1)], "profile_id string, vendors array<string>, hostnames array<string>, ports array<int>, device_type string, confidence double")
    assert {r.device: (r.profile_id, r.device_type) for r in I.match_profiles(d, p).collect()} == {"1": ("a", "tv"), "2": ("c", "nas")}
    assert I.match_profiles(d, p.limit(0)).count() == 0 and I.match_profiles(d.limit(0), p).count() == 0


def test_batches_and_polls(spark):
    ev = spark.createDataFrame([(f"{i:02d}", i % 7) for i in range(25)] + [("late", 100)], "event_id string, t_us bigint")
    rows = sorted((r.b_us, r.batch_no, r.event_id, r.t_us) for r in M.in_batches(ev, 4, 10).collect())
    assert [sum(r[:2] == (0, k) for r in rows) for k in range(8)] == [4, 4, 4, 4, 4, 4, 1, 0] and rows[-1][:3] == (100, 0, "late")
    assert [r[2] for r in rows[:4]] == ["00", "07", "14", "21"]
    polled = M.poll_latest(ev, "t_us", "event_id", 5, 6)
    assert sorted(r.event_id for r in polled.collect()) == ["06", "13", "20", "late"] and M.poll_latest(ev.limit(0), "t_us", "event_id", 5).count() == 0
    day = 86_400_000_000
    old = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0), (None, 5 * day), ("a", 9 * day), ("b", None)], "kind string, t_us bigint")
    assert sorted(str(r.kind) for r in M.retained_by_kind(old, "kind", {"a": 2, "b": 30}, 10 * day, 6).collect()) == ["None", "a", "b"]


def test_many_suppressions_as_few(spark):
    """A table of rules too large for one expression is joined, with the same result."""
    rnd = random.Random(7)
    pick = lambda xs: rnd.choice([*xs, None])
    table = [(f"r{i:03d}", pick("ab") or None, pick(["1", "2"]), rnd.sample(["x", "y", "z"], rnd.choice([0, 0, 1, 2])), rnd.random() < 0.8, rnd.randrange(50)) for i in range(30)]
    ev = [(f"e{i}", pick("abc"), pick(["1", "2", "3"]), rnd.sample(["x", "y", "z", "w"], rnd.randrange(4)) if rnd.random() < 0.8 else None) for i in range(150)]
    e = spark.createDataFrame(ev, "event_id string, domain string, source_ip string, tags array<string>")
    for some in (table, [r for r in table if r[1] or r[2] or r[3]], []):
        r = spark.createDataFrame(some, rules._SUP)
        few = {x.event_id: x.rule_id for x in rules.suppressed_by(e, r).collect()}
        most, rules.LITERAL_RULES = rules.LITERAL_RULES, -1 if not some else 0
        try:
            assert {x.event_id: x.rule_id for x in rules.suppressed_by(e, r).collect()} == few
        finally:
            rules.LITERAL_RULES = most
    with pytest.raises(ValueError):
        rules.allowed(spark.range(3000).select(F.col("id").cast("string").alias("rule_id"), F.lit("*").alias("r_domain"), F.lit(None).cast("string").alias("r_ip"), F.lit(None).cast("string").alias("r_tag"), F.lit(True).alias("enabled")))


def test_designed_scores(spark):
    f = scoring.pair_frequencies(spark.createDataFrame([("aab",), ("ab",), ("é",), ("a_b",), (None,)], "l string"), "l")
    assert f == {"aa": 1 / 3, "ab": 2 / 3}
    p = scoring.design_parts(F.col("l"), F.lit("xyz"), {"ab": 0.04, "bc": 0.04}, ["abc"])
    got = {r.l: r for r in spark.createDataFrame([("abc",), ("xq",), ("qqqq",), ("__",)], "l string").select("l", *(c.alias(k) for k, c in p.items())).collect()}
    assert got["abc"].words == 0 and got["abc"].pairs == 0 and got["qqqq"].pairs == 1 and got["qqqq"].words == 1 and got["xq"].words == 0.5 and got["xq"].suffix == 0.8
    s = spark.createDataFrame([(0.5, None, 0.4, 0.0), (None, None, None, None), (0.9, 0.95, 0.9, 0.31)], "d double, b double, t double, r double")
    t = [r.t for r in s.select(scoring.threat({"dga": F.col("d"), "beacon": F.col("b"), "tunnel": F.col("t"), "reputation": F.col("r")}).alias("t")).collect()]
    assert [(round(x.score, 9), x.primary, x.level, x.tags) for x in t] == [(0.6, "dga", "warning", ["dga_candidate", "dns_tunnel"]), (0.0, None, "none", []), (1.0, "beacon", "critical", ["dga_candidate", "beaconing", "dns_tunnel", "known_bad"])]


def test_beacon_design(spark):
    from siftnet.operators.series import beacon_design

    g = spark.createDataFrame([("s", "d", 60.0)] * 50 + [("s", "e", x) for x in (1.0, 2.0, 4.0, 900.0)] + [("s", "f", x) for x in (10.0, 20.0, 30.0, 40.0, 50.0)], "source_hash string, domain string, gap_s double")
    got = {r.domain: r.score for r in beacon_design(g, ["source_hash", "domain"]).collect()}
    import math

    assert set(got) == {"d", "f"} and abs(got["d"] - (0.3 + 0.3 + 0.2 + 0.2 * 50 / 360)) < 1e-9
    assert abs(got["f"] - (0.3 + 0.3 * (1 - 10 / 30) + 0.2 * math.log2(5) / math.log2(50) + 0.2 * 150 / 3600 / 6)) < 1e-9


def test_filters_reach_the_scan(spark, data):
    """Conditions on stored columns are pushed into the scan, before redelivered rows are dropped."""
    from siftnet.plans import catalog

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def plan(name):
        return catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()

    for name, parts in {"events_filter_page": ["EqualTo(event_type,dns_query)", "GreaterThanOrEqual(anomaly_score,0.3)"], "top_blocked": ["IsNotNull(domain)", "EqualTo(blocked,true)"], "reports_15min": ["IsNotNull(domain)", "GreaterThan(anomaly_score,0.1)"], "timeline_24h": ["GreaterThanOrEqual(ts,"], "events_of_segment": ["EqualTo(event_type,anomaly)"]}.items():
        text = plan(name)
        pushed = text[text.index("PushedFilters") :]
        assert all(p in pushed.split("ReadSchema")[0] for p in parts), (name, pushed[:300])
    assert "received_at" not in plan("stats_totals")


def test_bodies_from_outside(spark):
    """Bodies that no part of this library wrote."""
    from siftnet.sources.feeds import parse_ioc_feed
    from siftnet.sources.ingest import parse_ingest, parse_sensor_batches
    from siftnet.sources.logs import parse_eve, parse_scan_xml

    t = lambda name, *xs: spark.createDataFrame([(x,) for x in xs], f"{name} string")
    bad = bytes([0x7B, 0xFF, 0xFE]).decode("latin-1")
    rows = parse_ingest(t("body", '{"event_id": "1", "anomaly_score": "high", "tags": "x", "blocked": "yes"}', '{"event_id": "2", "event_id": "3"}', '[{"event_id": "4"}, null, [], [7], [8, {"event_id": "5"}]]', bad, '{"event_id": "6"', "[[1.5]]", "null", "17")).collect()
    assert {r.event_id for r in rows} >= {"4", "5"} and len(rows) <= 5 and all(r.anomaly_score is None and r.tags is None for r in rows)
    assert parse_sensor_batches(t("body", '{"queries": null}', '{"queries": {"domain": "d"}}', '{"queries": [null, 5, {"domain": "d", "client_ip": 7, "timestamp": "x"}]}')).count() <= 1
    assert [(r.src_ip, r.severity, r.anomaly_score) for r in parse_eve(t("line", '{"event_type": "alert", "alert": {"severity": 9}}', '{"event_type": "ALERT"}', '{"event_type": "alert", "src_ip": "1.1.1.1"}')).collect()] == [("unknown", 9, 0.25), ("1.1.1.1", 4, 0.25)]
    assert parse_scan_xml(t("body", "<nmaprun><host><status state='up'/><address addr='1.1.1.1' addrtype='ipv4'/>", "<a/>", "", '<nmaprun><host><status state="up"/><address addr="1.1.1.1" addrtype="ipv4"/><ports/></host></nmaprun>')).count() >= 1
    feed = json.dumps({"data": [{"ioc": "1.1.1.1:80", "ioc_type": "ip:port", "first_seen": s} for s in ("2024-01-02 03:04:05 UTC", "2024-01-02 03:04:05", "2024-01-02T03:04:05+01:00", "yesterday", None)]})
    assert [r.first_us for r in parse_ioc_feed(t("body", feed)).collect()] == [1704164645000000, 1704164645000000, 1704161045000000, None, None]


def test_whole_tables_of_nested_records(spark):
    """Every branch of any depth comes back with its place, from JSON and from Arrow alike."""
    from siftnet.operators.shred import ITSELF, Branch, array_tables, json_tables

    rnd = random.Random(8)
    inner = Branch("c", "cs", True, ("v",), (Branch("n", "ns", True, (ITSELF,), scalar=ITSELF),))
    tree = Branch("b", "bs", True, ("x", "y"), (inner,))
    data, want = [], {"b": set(), "c": set(), "n": set()}
    for i in range(60):
        bs = None if rnd.random() < 0.1 else []
        for j in range(rnd.randrange(4) if bs is not None else 0):
            if rnd.random() < 0.15:
                bs.append(None)
                continue
            b = {"x": f"x{i}{j}", "y": None, "cs": []}
            want["b"].add((i, j, b["x"]))
            for k in range(rnd.randrange(4)):
                c = {"v": f"{k}", "ns": [rnd.choice(["p", None, "q"]) for _ in range(rnd.randrange(3))]}
                want["c"].add((i, j, k, c["v"]))
                want["n"] |= {(i, j, k, m, v) for m, v in enumerate(c["ns"]) if v is not None}
                b["cs"].append(c)
            bs.append(b)
        data.append((i, bs))
    df = spark.createDataFrame(data, "id bigint, bs array<struct<x: string, y: string, cs: array<struct<v: string, ns: array<string>>>>>")
    arrow = array_tables(df.unionByName(df), "id", "bs", tree)
    texts = spark.createDataFrame([(i, json.dumps({"bs": bs})) for i, bs in data] + [(99, "broken"), (None, "{}")], "id bigint, body string")
    js = json_tables(texts, "id", "body", Branch("rec", "", True, ("missing",), (tree,)))
    for name, cols in {"b": ["parent_id", "b_pos", "x"], "c": ["parent_id", "b_pos", "c_pos", "v"], "n": ["parent_id", "b_pos", "c_pos", "n_pos", "n"]}.items():
        assert {tuple(r) for r in arrow.table(name).select(cols).where(f"{cols[-1]} is not null").collect()} == want[name]
        assert {tuple(r) for r in js.table(name).select(cols).where(f"{cols[-1]} is not null").collect()} == want[name]
    assert js.table("rec").count() == 60 and array_tables(df.limit(0), "id", "bs", tree).table("n").count() == 0


def test_skew_and_spread(spark):
    """Order statistics by chunks of value are those of the sorted values."""
    import statistics

    from siftnet.operators.series import skew_and_spread

    rnd = random.Random(9)
    values = {k: [rnd.choice([60.0, 60.0, rnd.random() * 900, 0.0]) for _ in range(n)] for k, n in (("a", 200), ("b", 11), ("c", 9))}
    got = {r.domain: r for r in skew_and_spread(spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "domain string, gap_s double")).collect()}
    assert set(got) == {"a", "b"}
    for k, r in got.items():
        q1, q2, q3 = statistics.quantiles(values[k], n=4, method="inclusive")
        assert r.n == len(values[k]) and abs(r.bowley - ((q3 + q1 - 2 * q2) / (q3 - q1) if q3 > q1 else 0)) < 1e-9 and abs(r.mad - sorted(abs(x - q2) for x in values[k])[r.n // 2]) < 1e-9


def test_packing_is_one_to_one(spark):
    from siftnet.tables import pack_hex, unpack_hex

    ids = ["", "a", "ab", "AB", "abc", "0" * 64, "g" * 64, "123e4567-e89b-12d3-a456-426614174000", "123E4567-e89b-12d3-a456-426614174000", "123e4567-e89b-12d3-a456-42661417400", "é", " ab", "ab\n", "abc\n", "\u00000", None]
    got = spark.createDataFrame([(i,) for i in ids], "i string").select("i", pack_hex("i").alias("p")).select("i", "p", unpack_hex("p").alias("u")).collect()
    assert all(r.u == r.i for r in got) and len({bytes(r.p) for r in got if r.p is not None}) == len(ids) - 1
