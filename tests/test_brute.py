"""Queries that SQL cannot express against slow versions of them, written apart, over the test tables."""

import datetime as D
import json
import re
from decimal import Decimal
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from siftnet.operators import series, shred, timestamps

EPOCH = D.datetime(1970, 1, 1)
MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}


def local(zone, w, abbr=None):
    z, found = ZoneInfo(zone), set()
    for fold in (0, 1):
        x = w.replace(tzinfo=z, fold=fold)
        u = x.astimezone(D.timezone.utc)
        if u.astimezone(z).replace(tzinfo=None) == w and (abbr is None or x.tzname() == abbr):
            found.add(u.replace(tzinfo=None))
    return found.pop() if len(found) == 1 else None


def micros(u):
    return None if u is None else (u - EPOCH) // D.timedelta(microseconds=1) or None


def shifted(w, sign, hours, minutes):
    return micros(w - (1 if sign == "+" else -1) * D.timedelta(hours=int(hours), minutes=int(minutes or 0)))


def moment(s, zone, order, received):
    if s is None:
        return None
    s = s.strip().strip('"').strip()
    try:
        if re.fullmatch(r"\d+(\.\d+)?([eE]\+?\d+)?", s):
            v = Decimal(s)
            factor = next((f for lim, f in ((10**11, 10**6), (10**14, 10**3), (10**17, 1)) if v < lim), None)
            return (int(v * factor) if factor else int(v) // 1000) or None
        if m := re.fullmatch(r"(\d{4})-?(\d\d)-?(\d\d)(?:[T ](\d\d):?(\d\d)(?::?(\d\d))?(?:[.,](\d+))?)?\s?(.*)", s):
            y, mo, d, h, mi, se, fr, z = m.groups()
            w = D.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(se or 0), int(((fr or "") + "000000")[:6]))
            if w.year <= 1:
                return None
            if z in ("Z", "z", "UTC", "GMT"):
                return micros(w)
            if not z:
                return micros(local(zone, w))
            if k := re.fullmatch(r"([+-])(\d\d):?(\d\d)?(\[.*\])?", z):
                return shifted(w, k[1], k[2], k[3])
            return micros(local(zone, w, z)) if re.fullmatch("[A-Z]{3,5}", z) else None
        if m := re.fullmatch(r"(\d\d?)[/.](\d\d?)[/.](\d{4}|\d\d) (\d\d):(\d\d):(\d\d)(?: (AM|PM))?", s):
            a, b, y, h = (int(m[i]) for i in range(1, 5))
            h = h % 12 + (12 if m[7] == "PM" else 0) if m[7] else h
            d, mo = (a, b) if order == "dmy" else (b, a)
            return micros(local(zone, D.datetime(y + 2000 * (y < 100), mo, d, h, int(m[5]), int(m[6]))))
        if m := re.fullmatch(r"(\w{3}) ([ \d]\d) (\d\d):(\d\d):(\d\d)", s):
            now = received.astimezone(ZoneInfo(zone)).replace(tzinfo=None)
            for y in range(now.year, now.year - 9, -1):
                try:
                    w = D.datetime(y, MONTHS[m[1]], int(m[2]), int(m[3]), int(m[4]), int(m[5]))
                except ValueError:
                    continue
                if w <= now:
                    return micros(local(zone, w))
        if m := re.fullmatch(r"\w{3}, (\d\d?) (\w{3}) (\d{4}) (\d\d):(\d\d):(\d\d) ([+-])(\d\d)(\d\d)", s):
            return shifted(D.datetime(int(m[3]), MONTHS[m[2]], int(m[1]), int(m[4]), int(m[5]), int(m[6])), m[7], m[8], m[9])
    except (ValueError, KeyError):
        pass
    return None


class Num(str):
    pass


def refuse(_):
    raise ValueError


def records(body):
    try:
        o = json.loads(body, parse_constant=refuse, parse_int=Num, parse_float=Num)
    except (ValueError, TypeError):
        return []
    low = {k.lower(): v for k, v in o.items()}
    return [{k.lower(): v for k, v in r.items()} if isinstance(r, dict) else {} for r in low["data"]] if "data" in low else [low]


def children(body):
    read = lambda v: json.loads(v) if type(v) is str else v
    for at, r in enumerate(records(body)):
        for child, path, leaf in (("answer", "answer", "value"), ("original_answer", "original_answer", "value"), ("rule", "rules", "text")):
            v = read(r.get(path))
            for i, x in enumerate([v] if isinstance(v, dict) else v or []):
                if x is not None:
                    yield at, child, i, -1, str(x) if isinstance(x, str) else str({k.lower(): y for k, y in x.items()}.get(leaf) or "")
        for child in ("question", "client_info"):
            v = read(r.get(child))
            if isinstance(v, dict):
                yield at, child, 0, -1, {k.lower(): y for k, y in v.items()}.get("name") or ""


def test_moments(spark, data, duck):
    sensors = {r[0]: r[1:] for r in duck.sql("select sensor_id, tz_name, date_order from sensors").fetchall()}
    want = {("dns_queries", i, 0, moment(x, *sensors[s], r)) for i, s, r, x in duck.sql("select query_id, sensor_id, min(received_at), any_value(ts_raw) from dns_queries group by 1, 2").fetchall()}
    for i, s, r, b in duck.sql("select rec_id, sensor_id, min(received_at), any_value(body) from adguard_log group by 1, 2").fetchall():
        want |= {("adguard_log", i, k, moment(x["time"], *sensors[s], r)) for k, x in enumerate(records(b)) if isinstance(x.get("time"), str)}
    want |= {("feodo_entries", i, 0, moment(x, "UTC", "dmy", None)) for i, x in duck.sql("select entry_id, any_value(first_seen) from feodo_entries group by 1").fetchall()}
    assert {tuple(r) for r in timestamps.p2_found(spark, data).collect()} == {w for w in want if w[3] is not None}


def test_children(spark, data, duck):
    want = {("adguard_log", i, *c) for i, b in duck.sql("select rec_id, any_value(body) from adguard_log group by 1").fetchall() for c in children(b)}
    assert {tuple(r) for r in shred.p5_found(spark, data).collect() if r.src == "adguard_log"} == want


def test_spectrum():
    step = lambda b, n: series._snr(("d",), pd.DataFrame({"b": b, "n": n})).iloc[0]
    assert step(np.arange(0, 500, 10), np.ones(50, dtype=int)).score > 0.5
    assert step([7], [3]).snr == 0 and step([1, 2, 3], [4, 4, 4]).snr == 0


def test_sketch_is_near(spark, data):
    a = {r.parent: r.subdomains for r in series.subdomains(spark, data).collect()}
    b = {r.parent: r.subdomains for r in series.subdomains_sketch(spark, data).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) <= max(1, 0.1 * a[k]) for k in a)


def test_partial_states_merge(spark, data):
    from siftnet.operators.community import merged, partials
    from siftnet.plans.base import events

    ev = events(spark, data)
    whole = {r.domain: (r.n, r.blocked) for r in ev.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).collect()}
    assert {r.domain: (r.n, r.blocked) for r in merged(partials(ev, 3_600_000_000), "domain").select("domain", "n", "blocked").collect()} == whole


def test_adguard_events(spark, data, duck):
    from siftnet.sources.ingest import BLOCKED_REASONS, src_adguard

    read = lambda v: json.loads(v) if type(v) is str else v
    want = set()
    for i, b in duck.sql("select rec_id, any_value(body) from adguard_log group by 1").fetchall():
        for at, r in enumerate(records(b)):
            kids = {}
            for _, child, pos, _, item in (c for c in children(b) if c[0] == at and c[1] in ("answer", "question")):
                kids.setdefault(child, item)
            reason, client = (r.get(k) if isinstance(r.get(k), (str, Num)) else None for k in ("reason", "client"))
            if kids or reason is not None or client is not None:
                want.add((i, at, kids.get("question"), kids.get("answer"), reason in BLOCKED_REASONS, client))
    got = {(r.parent_id, r.rec_pos, r.domain, r.resolved_ip, r.blocked, r.source_ip) for r in src_adguard(spark, data).collect()}
    assert got == want
    assert read("[1]") == [1]


def test_enriched_events(spark, data):
    """Scores, tags and descriptions of events agree with the queries of their parts."""
    from siftnet.functions.domain import DGA_THRESHOLD, is_private_reverse
    from siftnet.operators import detect
    from siftnet.plans.base import events

    rows = {r.event_id: r for r in detect.enriched_events(spark, data).collect()}
    named = {r.event_id: (r.domain, r.p, set(r.tags or [])) for r in events(spark, data).select("event_id", "domain", "tags", is_private_reverse(F.col("domain")).alias("p")).collect()}
    assert rows.keys() == named.keys()
    dga = {r.event_id for r in detect.dga_scores(spark, data).collect() if r.score >= DGA_THRESHOLD and not named[r.event_id][1]}
    assert {i for i, r in rows.items() if "dga_candidate" in (r.tags or "").split(";") and "dga_candidate" not in named[i][2]} == {i for i in dga if "dga_candidate" not in named[i][2]}
    reb = {r.event_id for r in detect.rebinding_alerts(spark, data).collect()}
    assert {i for i, r in rows.items() if r.description and "Answer went from" in r.description} == reb
    known = {r.event_id for r in detect.intel_join(spark, data).collect()}
    assert all("known_bad" in r.tags for i, r in rows.items() if i in known)
    sample = tuple("." + d for d in detect.SAMPLE_PROVIDERS)
    for r in detect.composite_enrich(spark, data).collect():
        d = named[r.event_id][0]
        if d is None or not ("." + d).endswith(sample):
            assert abs(r.score - rows[r.event_id].score) < 1e-5
