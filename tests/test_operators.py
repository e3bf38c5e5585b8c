import json
import random

from pyspark.sql import functions as F

from siftnet.operators.devices import inventory, insert_ignore, register_sensors, retained, upsert_devices, upsert_latest
from siftnet.operators.query import EventQuery, timeline, validate
from siftnet.operators import series
from siftnet.operators.rules import SUPPRESSIONS, _SUP, echo_dedup, group_near, suppressed_by
from siftnet.sources.feeds import host_of, parse_ja3_feed, write_page
from siftnet.sources.ingest import parse_ingest, parse_pihole, parse_sensor_batches
from siftnet.sources.logs import parse_dnsmasq, parse_filterlog, parse_syslog, txt_fields

EV = "event_id string, t_us bigint, event_type string, source_hash string, source_ip string, domain string, query_type string, anomaly_score double, tags array<string>, network_segment string"


def ev(spark, rows):
    base = {"event_id": None, "t_us": 0, "event_type": "dns_query", "source_hash": "s", "source_ip": "10.0.0.5", "domain": "d", "query_type": "A", "anomaly_score": 0.0, "tags": [], "network_segment": "default"}
    return spark.createDataFrame([tuple((base | r)[k.split()[0]] for k in EV.split(", ")) for r in rows], EV)


def test_pages(spark):
    e = ev(spark, [{"event_id": f"e{i:02d}", "t_us": i // 2, "anomaly_score": i / 10} for i in range(10)])
    ids = lambda q: [r.event_id for r in q.rows(e).collect()]
    assert ids(EventQuery(limit=3)) == ["e08", "e09", "e06"] and ids(EventQuery(limit=3, page=4)) == ["e01"]
    assert ids(EventQuery(sort="nonsense", order="asc", limit=2)) == ["e00", "e01"]
    assert len(ids(EventQuery(min_score=0.5))) == 5 and len(ids(EventQuery(from_us=1, to_us=2))) == 4
    assert EventQuery(limit=999).rows(ev(spark, [{"event_id": str(i)} for i in range(600)])).count() == 500
    assert EventQuery(min_score=0.5).total(e).first().total == 5 and EventQuery().rows(ev(spark, [])).count() == 0


def test_tags(spark):
    e = ev(spark, [{"event_id": "1", "tags": ["dga_candidate", "known_bad"]}, {"event_id": "2", "tags": ["known_bad"]}, {"event_id": "3", "tags": ["dgaXcandidate"]}, {"event_id": "4", "tags": None}])
    assert e.where(EventQuery(tags=["known_bad"]).predicate()).count() == 2 and e.where(EventQuery(tags=["known_bad", "dga_candidate"]).predicate()).count() == 1
    assert e.where(EventQuery(tags=["DGA_candidate"], tag_patterns=True).predicate()).count() == 2


def test_validation(spark):
    r = validate(ev(spark, [{"event_type": "x"}, {"anomaly_score": 7.0, "source_hash": None, "tags": None, "t_us": None}, {"network_segment": "lab"}, {"event_type": None}]), 99).collect()
    assert [x.reason for x in r] == ["event_type", None, "segment", "event_type"]
    assert (r[1].anomaly_score, r[1].source_hash, r[1].tags, r[1].t_us) == (1.0, "unknown", [], 99) and r[1].event_id


def test_timeline_is_whole(spark):
    t = timeline(ev(spark, []).withColumn("blocked", F.lit(False)), 10**15).collect()
    assert len(t) == 24 and all(r.n == 0 for r in t)


def test_rules(spark):
    rules = spark.createDataFrame(SUPPRESSIONS + [("all", None, None, [], True, 0)], _SUP)
    e = ev(spark, [{"event_id": "1", "domain": "api.dasordio.test"}, {"event_id": "2", "source_ip": "10.21.0.10", "tags": ["known_bad", "x"]}, {"event_id": "3", "source_ip": "10.21.0.10"}, {"event_id": "4", "tags": None}])
    assert {r.event_id: r.rule_id for r in suppressed_by(e, rules).collect()} == {"1": "r1", "2": "r2", "3": "all", "4": "all"}


def test_near_groups(spark):
    rnd = random.Random(1)
    rows = [{"event_id": str(i), "domain": rnd.choice("ab"), "t_us": rnd.randrange(2000)} for i in range(300)]
    got = sorted((r.k, r.lead_us, r.n) for r in group_near(ev(spark, rows), F.col("domain"), 100).collect())
    want = []
    for d in "ab":
        left = sorted((r["t_us"] for r in rows if r["domain"] == d), reverse=True)
        while left:
            n = sum(left[0] - t < 100 for t in left)
            want.append((d, left[0], n))
            left = left[n:]
    assert got == sorted(want)


def test_echoes(spark):
    e = ev(spark, [
        {"event_id": "1", "t_us": 0}, {"event_id": "2", "t_us": 1_000_000, "source_ip": "10.0.0.1"}, {"event_id": "3", "t_us": 10_000_000, "source_ip": "10.0.0.1"}, {"event_id": "4", "t_us": 11_000_000, "source_ip": "10.0.0.254"},
        {"event_id": "5", "domain": "x", "t_us": 0}, {"event_id": "6", "domain": "x", "t_us": 5_000_000}, {"event_id": "7", "domain": "y", "query_type": None}, {"event_id": "8", "domain": "y", "query_type": None}, {"event_id": "9", "domain": None},
    ])
    assert sorted((r.event_id, r.n) for r in echo_dedup(e).collect()) == [("1", 2), ("3", 2), ("5", 1), ("6", 1), ("8", 2)]


def test_writes(spark):
    t = spark.createDataFrame([("a", 1, "x")], "k string, v int, o string")
    b = spark.createDataFrame([("a", 2, "y"), ("b", 1, "p"), ("b", 2, "q")], "k string, v int, o string")
    assert [tuple(r) for r in insert_ignore(t, b, "k", "v").select("k", "v", "o").collect()] == [("b", 1, "p")]
    assert sorted(tuple(r) for r in upsert_latest(t, b, ["k"], "v").collect()) == [("a", 2, "y"), ("b", 2, "q")]
    days = spark.createDataFrame([(0,), (86_400_000_000 * 95,), (86_400_000_000 * 100,)], "t_us bigint")
    assert retained(days, None, 86_400_000_000 * 100).count() == 2 and retained(days, 3, 86_400_000_000 * 100).count() == 1


def test_devices(spark):
    s = "device string, hostname string, vendor string, ip string, first_us bigint, last_us bigint, device_type string, confidence double, locked boolean"
    a = spark.createDataFrame([("m", "h", None, "1", 5, 6, "tv", 0.8, False), ("n", "h", None, "1", 5, 6, "tv", 0.1, True)], s)
    b = spark.createDataFrame([("m", None, "V", "2", 7, 9, "pc", 0.5, False), ("n", "k", "V", "2", 7, 9, "pc", 0.9, False), ("o", None, None, "3", 1, 1, None, 0.0, False)], s).drop("locked")
    got = {r.device: (r.hostname, r.vendor, r.ip, r.first_us, r.last_us, r.device_type, r.locked) for r in upsert_devices(a, b).collect()}
    assert got == {"m": ("h", "V", "2", 5, 9, "tv", False), "n": ("k", "V", "2", 5, 9, "tv", True), "o": (None, None, "3", 1, 1, None, False)}
    h = spark.createDataFrame([(1, "x", "default", 1, 0, "1.1.1.1", None, "a", None, [1], "up"), (2, "x", "default", 2, 0, "1.1.1.1", None, None, "V", None, "up"), (3, "x", "iot", 2, 0, None, None, None, None, None, "up")], "report_id bigint, sensor_id string, segment string, t_us bigint, pos int, ip string, mac string, hostname string, vendor string, ports array<int>, status string")
    assert [(r.device, r.hostname, r.vendor, r.first_us) for r in inventory(h).collect()] == [("1.1.1.1@default", "a", "V", 1)]


def test_sensors(spark):
    s = "sensor_id string, hostname string, is_primary boolean, first_us bigint, last_us bigint"
    t = spark.createDataFrame([("a", "x", True, 1, 2), ("b", "y", False, 1, 2)], s)
    b = spark.createDataFrame([("b", "z", True, 5, 6)], s)
    assert sorted((r.sensor_id, r.hostname, r.is_primary, r.first_us) for r in register_sensors(t, b).collect()) == [("a", "x", False, 1), ("b", "z", True, 1)]


def texts(spark, name, xs):
    return spark.createDataFrame([(x,) for x in xs], f"{name} string")


def test_ingest(spark):
    o = {"event_id": "1", "event_type": "dns_query", "anomaly_score": 0.5, "tags": ["a"]}
    got = parse_ingest(texts(spark, "body", [json.dumps(o), json.dumps([o, 5, "x", o]), json.dumps([[1.5, o], [2]]), "junk", "", None, "[", "{"]))
    assert got.count() == 4 and {r.event_id for r in got.collect()} == {"1"}
    b = json.dumps({"sensor_id": "s", "queries": [{"timestamp": 7, "domain": "d", "query_type": "unknown", "client_ip": "1"}, {"domain": "", "client_ip": "1"}, {"domain": "d"}]})
    assert [(r.t_us, r.query_type, r.blocked) for r in parse_sensor_batches(texts(spark, "body", [b, "x", None])).collect()] == [(7_000_000, None, False)]
    p = json.dumps({"data": [[1, "A", "d", "c", 4, 0, 0, 0, "t", ""], [1, "A"], ["x", "A", "d", "c", "y", 0, 0, 0, "", ""]]})
    assert sorted((r.t_us, r.blocked, r.resolved_ip) for r in parse_pihole(texts(spark, "body", [p])).collect()) == [(0, False, None), (1_000_000, True, "t")]


def test_lines(spark):
    assert [tuple(r) for r in parse_syslog(texts(spark, "line", ["<34>Oct 11 22:14:15 host su[7]: a b", "<1>Oct  1 22:14:15 h su: m", "x", None])).collect()] == [(34, "Oct 11 22:14:15", "host", "su", 7, "a b"), (1, "Oct  1 22:14:15", "h", "su", None, "m")]
    assert [r.domain for r in parse_dnsmasq(texts(spark, "line", ["Oct 11 22:14:15 dnsmasq[1]: query[A] a.b from 1.1.1.1", "Oct 11 dnsmasq[1]: query[A] c.d from 1.1.1.1", "no"])).collect()] == ["a.b", "c.d"]
    v6 = "5,,,9,em0,match,block,in,6,0,0,64,udp,17,40,fe80::1,ff02::1,5353,5354,20"
    assert [(r.proto, r.src_ip, r.dst_port) for r in parse_filterlog(texts(spark, "line", [v6, "1,2"])).collect()] == [("udp", "fe80::1", 5354)]
    m = texts(spark, "x", ["a"]).select(txt_fields(F.array(F.lit("k=1"), F.lit("k=2=3"), F.lit("z"))).alias("m")).first().m
    assert m == {"k": "2=3", "z": ""}


def test_feeds(spark):
    u = texts(spark, "u", ["http://A.com:80/x", "a.com?x", "//b", "ftp://c.d#f", ""]).select(host_of(F.col("u")).alias("h"))
    assert [r.h for r in u.collect()] == ["a.com", "a.com", None, "c.d", None]
    assert parse_ja3_feed(texts(spark, "line", ["x," + "a" * 32 + ",C&C"]), column=1, reason=2).first().tags == ["malicious_tls", "c2"]


def test_sinks(spark, tmp_path):
    e = ev(spark, [{"event_id": "1", "domain": 'a"b,c', "tags": ["x", "y"]}, {"event_id": "2", "domain": None}])
    for form in ("json", "csv", "hosts"):
        write_page(e, str(tmp_path / form), form)
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert back.where("event_id = '1'").first().domain == 'a"b,c' and back.where("event_id = '1'").first().tags == "x;y"
    assert spark.read.json(str(tmp_path / "json")).count() == 2 and [r.value for r in spark.read.text(str(tmp_path / "hosts")).collect()] == ['0.0.0.0 a"b,c']


def test_emerging(spark):
    """More than 100 old or first-seen spikes take no place of a spike of now."""
    h, now = series.HOUR, 100 * series.HOUR + 1
    at = lambda d, k, n, nodes=2: (d, k * h, n, nodes)
    old = [at(f"o{i}", k, n) for i in range(120) for k, n in ((50, 1), (60, 900))] + [at(f"f{i}", 99, 900) for i in range(120)]
    rows = [at("now", 97, 1), at("now", 99, 5), at("one", 97, 1), at("one", 99, 5, 1), at("flat", 97, 2), at("flat", 99, 6), at("far", 40, 1), at("far", 99, 9)]
    got = series.emerging(spark.createDataFrame(old + rows, "domain string, h_us bigint, n bigint, nodes bigint"), now).collect()
    assert [tuple(r) for r in got] == [("now", 99 * h, 5, 5.0)]


def test_batch_limits(spark):
    """The surveyed limits, on either side, and small batches too."""
    from siftnet.operators.community import validated

    batches = {"r": [(501, 0.0, "d")], "k": [(500, 0.0, "d")], "f": [(101, 0.6, "d")], "g": [(100, 0.6, "d")], "p": [(6, 0.6, "pop")], "q": [(5, 0.6, "pop"), (3, 0.5, "pop")], "b": [(101, 0.6, "pop")]}
    e = ev(spark, [{"event_id": f"{s}{i}", "source_hash": s, "anomaly_score": a, "domain": d} for s, parts in batches.items() for n, a, d in parts for i in range(n)])
    got = {r.source_hash: (r.n, r.verdict, r.factor) for r in validated(e, texts(spark, "domain", ["pop"])).collect()}
    assert got == {"r": (501, "rejected", 0.0), "k": (500, "accepted", 1.0), "f": (101, "flagged", 0.9), "g": (100, "accepted", 1.0), "p": (6, "popular", 0.7), "q": (8, "accepted", 1.0), "b": (101, "flagged", 0.63)}


def test_hot_keys_in_chunks(spark):
    """Order within keys is the same whether a key is one task's or divided into chunks of time."""
    from siftnet.operators.ordered import numbered, with_previous

    rnd = random.Random(4)
    rows = [(k, rnd.randrange(500), f"{i:03d}") for k, n in (("hot", 150), ("b", 9), (None, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t_us bigint, id string")
    want, last, count = {}, {}, {}
    for k, t, i in sorted(rows, key=lambda r: r[1:]):
        count[k] = count.get(k, 0) + 1
        want[k, i], last[k] = (last.get(k), count[k]), t
    for most, chunk in ((10**6, 50), (20, 50), (0, 7), (0, 1)):
        got = {(r.k, r.id): r.prev and r.prev.t_us for r in with_previous(df, ["k"], ["t_us", "id"], ["t_us"], chunk, most).collect()}
        assert got == {x: v[0] for x, v in want.items()}
        assert {(r.k, r.id): r.rn for r in numbered(df, ["k"], ["t_us", "id"], chunk, most=most).collect()} == {x: v[1] for x, v in want.items()}


def test_order_statistics(spark):
    import statistics

    from siftnet.operators.ordered import order_statistics, quantile, quantile_ranks

    rnd = random.Random(5)
    values = {"a": [rnd.choice([0.0, -3.5, 60.0, 60.0, rnd.random(), 1e-12, rnd.random() * 1e6, -rnd.random() * 50]) for _ in range(300)], "b": [1.0], "c": [2.0, 2.0]}
    df = spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs] + [("a", None), (None, 1.0)], "k string, x double")
    qs = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    got = {r.k: [r.n, r.q1, r.q2, r.q3] for r in order_statistics(df, "k", "x", quantile_ranks(qs)).select("k", "n", *(quantile(k, q).alias(k) for k, q in qs.items())).collect()}
    for k, xs in values.items():
        want = statistics.quantiles(xs, n=4, method="inclusive") if len(xs) > 1 else xs * 3
        assert got[k][0] == len(xs) and all(abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(got[k][1:], want))
    assert order_statistics(df, "k", "x", {"m": F.expr("n div 2")}, 2).count() == 2
