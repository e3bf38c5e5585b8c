import hashlib
import hmac
import ipaddress

import pytest
from pyspark.sql import functions as F

from siftnet.functions import domain as D
from siftnet.functions.crypto import hmac_sha256
from siftnet.functions.net import ip_hex, is_private
from siftnet.operators.detect import beacons, composite, rebindings, suffix_match

BENIGN = "google.com amazon.co.uk reddit.com stackoverflow.com en.wikipedia.org mail.google.com docs.github.com news.ycombinator.com".split()
MACHINE = "asdfjklqwerty.com xn3kd9fj2mz8p.net kj3hf8s2m4n7q.org qxzjkvbwnmpl.evil.com r7t2x9k4m1n8.biz".split()
LABELS = {"google.com": "google", "sub.domain.com": "domain", "verylongsub.d.com": "verylongsub", "test.co.uk": "test", "a.b.c.example.com": "example", "xkjf8m2nq4.co.uk": "xkjf8m2nq4", "localhost": "localhost"}


def col(spark, names, expr):
    df = spark.createDataFrame([(n,) for n in names], "d string").select("d", expr(F.col("d")).alias("v"))
    return {r.d: r.v for r in df.collect()}


def test_machine_made(spark):
    v = col(spark, BENIGN + MACHINE + ["go.dev", "t.co", "x.com", "ab.cd"], D.dga)
    assert all(v[n].score < D.DGA_THRESHOLD for n in BENIGN)
    assert all(v[n].score >= 0.2 for n in MACHINE) and sum(v[n].score >= D.DGA_THRESHOLD for n in MACHINE) >= 2
    assert all(v[n].score == 0 for n in ("go.dev", "t.co", "x.com", "ab.cd"))
    assert {n: x.label for n, x in col(spark, LABELS, D.dga).items()} == LABELS


def test_entropy(spark):
    assert col(spark, ["aaaa", "abab", ""], D.entropy) == {"aaaa": 0.0, "abab": 1.0, "": 0.0}


def test_tunnels(spark):
    yes = ["4e6f7468696e67746f736565686572650a.data.evil.com", "agvsbg8gd29ybgqgdghpcybpcybhihrlc3q=.tunnel.bad.xyz"]
    no = "www.google.com api.github.com mail.yahoo.com cdn.cloudflare.net s3.amazonaws.com google.com evil.net".split()
    v = col(spark, yes + no + ["x" * 52 + ".a.com", "a.b.c.d.e.tunnel.evil.com"], D.tunnel)
    assert all(round(v[n].score, 9) >= D.TUNNEL_THRESHOLD for n in yes) and "hex_encoded" in v[yes[0]].signals
    assert all(v[n].score < D.TUNNEL_THRESHOLD for n in no) and v["google.com"].score == 0
    assert "very_long_label" in v["x" * 52 + ".a.com"].signals and "deep_subdomain" in v["a.b.c.d.e.tunnel.evil.com"].signals


def test_private_reverse(spark):
    v = col(spark, ["1.0.0.10.in-addr.arpa", "1.2.168.192.in-addr.arpa", "1.1.31.172.in-addr.arpa", "1.1.32.172.in-addr.arpa", "8.8.8.8.in-addr.arpa", "x.10.in-addr.arpa", "a.com", None], D.is_private_reverse)
    assert [k for k, x in v.items() if x] == ["1.0.0.10.in-addr.arpa", "1.2.168.192.in-addr.arpa", "1.1.31.172.in-addr.arpa"]


ADDRESSES = ["1.2.3.4", " 198.18.213.221 ", "::ffff:1.2.3.4", "::FFFF:102:304", "2001:0db8:0094:0000:0000:0000:016d:0005", "2001:db8:94::16d:5", "::", "::1", "1::", "1:2:3:4:5:6:7::", "[2001:db8::1]", "fe80::1%eth0", "1.2.3", "256.1.1.1", "12345::", "1:::2", "1:2:3:4:5:6:7:8:9", "g::1", "", "alias.example", None]


def test_addresses(spark):
    for a, h in col(spark, ADDRESSES, ip_hex).items():
        try:
            x = ipaddress.ip_address(a.strip().strip("[]").split("%")[0])
            x = x.ipv4_mapped or x if x.version == 6 else x
            assert h == x.packed.hex(), a
        except (ValueError, AttributeError):
            assert h is None, a
    p = col(spark, ["10.1.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "169.254.9.9", "fd00::1", "::1", "::", "8.8.8.8", "name", None], is_private)
    assert sorted(str(k) for k, x in p.items() if x) == ["10.1.1.1", "169.254.9.9", "172.16.0.1", "192.168.1.1", "fd00::1"]


def test_hmac(spark):
    for key in ("salt", "k" * 100):
        assert col(spark, ["10.0.0.1", ""], lambda c, key=key: hmac_sha256(c, key)) == {x: hmac.new(key.encode(), x.encode(), hashlib.sha256).hexdigest() for x in ("10.0.0.1", "")}


def series(spark, seconds, key="s"):
    return spark.createDataFrame([(key, "d", int(t * 1e6), f"e{i:03d}") for i, t in enumerate(seconds)], "source_hash string, domain string, t_us bigint, event_id string")


def test_beacons(spark):
    last = beacons(series(spark, [60 * i for i in range(10)])).orderBy("event_id").collect()[-1]
    assert last.beacon == 1.0 and last.samples == 10 and last.cv == 0
    assert all(r.beacon == 0 for r in beacons(series(spark, [0, 3, 47, 120, 122, 500, 510, 900, 1800, 1805])).collect())
    assert all(r.cv is None for r in beacons(series(spark, [0, 60, 120])).collect())
    assert beacons(series(spark, [0.1 * i for i in range(40)])).where("cv is not null").count() == 0
    assert max(r.samples for r in beacons(series(spark, [60 * i for i in range(50)])).collect()) == 32


def test_beacons_of_hot_keys(spark):
    """A key in chunks of time has the same scores as in one piece."""
    import random

    rnd = random.Random(2)
    rows = [(k, "d", int(i * 6e7 + rnd.randrange(10**7)), f"{k}{i:03d}") for k, n in (("s", 200), ("t", 5)) for i in range(n)] + [("s", "d", 6 * 10**7, f"tie{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "source_hash string, domain string, t_us bigint, event_id string")
    get = lambda **x: sorted((r.event_id, r.samples, r.mean_s and round(r.mean_s, 6), r.cv and round(r.cv, 6), round(r.beacon, 6)) for r in beacons(df, **x).collect())
    whole = get()
    assert any(r[3] for r in whole) and all(get(most=10, chunk_us=c) == whole for c in (6 * 10**7, 10**9, 10**12))


def test_rebinding(spark):
    rows = [("a", 1, "1", "8.8.8.8"), ("a", 2, "2", "9.9.9.9"), ("a", 3, "3", "10.0.0.1"), ("a", 4, "4", "10.0.0.2"), ("b", 1, "5", "10.0.0.1"), ("b", 2, "6", "8.8.8.8"), ("b", 3, "7", "10.0.0.1"), ("c", 1, "8", "8.8.8.8"), ("d", 1, "9", "alias.x"), ("d", 2, "10", "192.168.0.1"), (None, 1, "11", "10.0.0.1")]
    got = rebindings(spark.createDataFrame(rows, "domain string, t_us bigint, event_id string, resolved_ip string")).collect()
    assert sorted((r.domain, r.event_id, r.public_ip) for r in got) == [("a", "3", "9.9.9.9"), ("d", "10", "alias.x")]


def test_composite(spark):
    df = spark.createDataFrame([([0.5, 0.7], 0.1), ([0.95, 0.9, 0.6], 0.0), ([0.3], 0.2), ([], 0.4), ([0.35], 0.9)], "s array<double>, o double").select(composite(F.col("s"), F.col("o")).alias("v"))
    assert [round(r.v, 9) for r in df.collect()] == [0.75, 1.0, 0.3, 0.4, 0.9]


def test_suffixes(spark):
    names = spark.createDataFrame([("dns.google",), ("a.dns.google",), ("xdns.google",), ("b.a.x",), (None,)], "d string")
    table = spark.createDataFrame([("dns.google", "G"), ("a.x", "long"), ("x", "short")], "s string, v string")
    assert {r.d: r.v for r in suffix_match(names, "d", table, "s", "v").collect()} == {"dns.google": "G", "a.dns.google": "G", "xdns.google": None, "b.a.x": "long", None: None}


@pytest.mark.parametrize("p,value,hit", [("*.apple.com", "www.apple.com", True), ("*.apple.com", "apple.com", False), ("a.b", "axb", False), ("A*", "abc", True), ("a(b", "a(b", True), ("*", "", True)])
def test_globs(spark, p, value, hit):
    from siftnet.operators.rules import glob_regex

    df = spark.createDataFrame([(p, value)], "p string, v string").select(F.regexp_like("v", glob_regex(F.col("p"))).alias("h"))
    assert df.first().h is hit


def test_six_tunnel_signals(spark):
    """Names over all time don't add up to a rate; NULL boosts; names of tools are known."""
    from siftnet.operators.scoring import tunnel_six

    hour = 3_600_000_000
    tool = "0123456789abcdef0123.ab.t.example"
    rows = [(f"n{i}.slow.example", i * hour, "A") for i in range(60)] + [(f"n{i}.fast.example", i, "A") for i in range(300)] + [("a.null.example", 0, "null"), (tool, 0, "A"), ("w" * 31 + ".t2.example", 0, "A"), ("0123456789abcdefx.slow2.example", 0, "A")]
    got = {r.domain: (r.score, r.tool, r.tool_score) for r in tunnel_six(spark.createDataFrame(rows, "domain string, t_us bigint, query_type string")).collect()}
    assert len(got) == 364
    near = lambda name, want: abs(got[name][0] - want) < 1e-4
    label = lambda size: 0.2 * size / 100 + 0.05 / 6
    assert near("n1.slow.example", label(2) + 0.2 / 300) and near("n1.fast.example", label(2) + 0.2) and near("a.null.example", label(1) + 0.2 + 0.2 / 300 + 0.3)
    assert got[tool][1:] == ("iodine", 0.95) and got["w" * 31 + ".t2.example"][1:] == ("dns2tcp", 0.9) and got["n1.slow.example"][1:] == (None, None)
