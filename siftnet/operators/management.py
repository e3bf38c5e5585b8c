"""State that people change (acknowledgements, corrections, rules), lists as they are shown, batches, and retention by kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions.net import cidr, ip_hex, network
from siftnet.operators.detect import PUBLIC_RESOLVERS, rows, sql_rows
from siftnet.operators.devices import INVENTORY, inventory, retained
from siftnet.operators.ordered import numbered
from siftnet.operators.query import EventQuery
from siftnet.operators.rules import _ALW, _ALW_HIT, _ALW_SQL, _SUP, _SUP_HIT, _SUP_SQL, allowed, suppressed_by
from siftnet.plans.base import EV, FW, HOSTS, Registry, deliveries, events, firewall, hosts, now_us
from siftnet.plans.fixtures import ALLOWED, MANAGED, SAMPLE_RESOLVERS, SUPPRESSIONS
from siftnet.sources.feeds import csv_line, page_json
from siftnet.tables import load

R = Registry()
HOUR, DAY = 3_600_000_000, 86_400_000_000


# --- changes of state ------------------------------------------------------------------------------------------------------------------------


def acknowledge(ev: DataFrame, marks: DataFrame) -> DataFrame:
    """Events after acknowledgements: ``marks`` has ``event_id`` and ``reason``; a null reason takes an acknowledgement back. Of several marks of an event the one with a reason holds, of those the first in order; marks of unknown events change nothing."""
    m = marks.where("event_id is not null").groupBy("event_id").agg(F.min("reason").alias("__reason"), F.lit(True).alias("__marked"))
    j = ev.join(m, "event_id", "left")
    return j.withColumns({"acknowledged": F.when(F.col("__marked"), F.col("__reason").isNotNull()).otherwise(F.coalesce("acknowledged", F.lit(False))), "ack_reason": F.when(F.col("__marked"), F.col("__reason")).otherwise(F.col("ack_reason"))}).drop("__reason", "__marked")


def correct_identity(devices: DataFrame, corrections: DataFrame) -> DataFrame:
    """Devices after corrections by hand (``device``, ``device_type``): what was corrected is certain and ``locked``, so that no scan replaces it (see ``upsert_devices``). Null types and unknown devices change nothing."""
    c = corrections.where("device is not null and device_type is not null").groupBy("device").agg(F.max("device_type").alias("__type"))
    j = devices.join(c, "device", "left")
    by_hand = F.col("__type").isNotNull()
    return j.withColumns({"device_type": F.coalesce("__type", "device_type"), "confidence": F.when(by_hand, 1.0).otherwise(F.col("confidence")), "locked": by_hand | F.coalesce("locked", F.lit(False))}).drop("__type")


def merge_passive(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Devices after passive discovery: ports stay those of the last active scan, an identity is replaced only by a surer one and never if it is locked, blank fields are filled."""
    j = known.alias("a").join(seen.alias("b"), "device", "full_outer")
    fill = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
    surer = ~F.coalesce("a.locked", F.lit(False)) & (F.coalesce("b.confidence", F.lit(-1.0)) > F.coalesce("a.confidence", F.lit(-1.0)))
    return j.select("device", fill("hostname"), fill("vendor"), fill("ports"), F.least("a.first_us", "b.first_us").alias("first_us"), F.greatest("a.last_us", "b.last_us").alias("last_us"), F.when(surer, F.col("b.device_type")).otherwise(F.col("a.device_type")).alias("device_type"), F.when(surer, F.col("b.confidence")).otherwise(F.col("a.confidence")).alias("confidence"), F.coalesce("a.locked", F.lit(False)).alias("locked"))


def set_enabled(rules: DataFrame, rule_id: str, enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("rule_id") == rule_id, F.lit(enabled)).otherwise(F.col("enabled")))


def delete_rule(rules: DataFrame, rule_id: str) -> DataFrame:
    """The rules without one; those that are built in stay."""
    return rules.where((F.col("rule_id") != rule_id) | F.coalesce("built_in", F.lit(False)))


def add_rule(rules: DataFrame, rule: DataFrame) -> DataFrame:
    """The rules with a new one; an id that is there already is refused by leaving the old rule as it is."""
    return rules.unionByName(rule.join(rules.select("rule_id"), "rule_id", "left_anti"))


def seed(rules: DataFrame, defaults: DataFrame) -> DataFrame:
    """The defaults if there is no rule at all, else the rules."""
    return defaults if rules.isEmpty() else rules


@R.query(f"""with {EV} select case when anomaly_score > 0.7 then true when network_segment = 'guest' then false else coalesce(acknowledged, false) end as acknowledged,
 coalesce(case when anomaly_score > 0.7 then 'reviewed' when network_segment = 'guest' then null else ack_reason end, '') as reason, count(*) as n from ev group by 1, 2""")
def ack_changes(spark, sf_dir: str) -> DataFrame:
    """Events by acknowledgement after those with high scores were reviewed and those of guests taken back (DML-06)."""
    marks = deliveries(spark, sf_dir, "anomaly_score > 0.7 or network_segment = 'guest'").select("event_id", F.when(F.col("anomaly_score") > 0.7, "reviewed").alias("reason"))
    e = acknowledge(events(spark, sf_dir).select("event_id", "acknowledged", "ack_reason"), marks)
    return e.groupBy("acknowledged", F.coalesce("ack_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


_MANAGED = "rule_id string, category string, name string, built_in boolean, enabled boolean"
_NEW_RULES = [("w1", "cdn", "again", False, True), ("w9", "cdn", "added", False, True)]


@R.query(f"""with r as (select * from {sql_rows(MANAGED, 'rule_id, category, name, built_in, enabled')}), u as (select rule_id, category, name, built_in, case when rule_id = 'w4' then true else enabled end as enabled from r where rule_id <> 'w2' union all select 'w9', 'cdn', 'added', false, true)
 select *, row_number() over (order by category, name) as pos from u""")
def rule_changes(spark, sf_dir: str) -> DataFrame:
    """The list of rules, by category and name, after one was switched on, two deleted (one of them built in) and two added (one of them there already) (DML-06, ORD-03)."""
    new = spark.createDataFrame(_NEW_RULES, _MANAGED)
    r = seed(spark.createDataFrame([], _MANAGED), spark.createDataFrame(MANAGED, _MANAGED))
    r = add_rule(delete_rule(delete_rule(set_enabled(r, "w4", True), "w1"), "w2"), new)
    return r.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("category", "name")))


# --- lists ---------------------------------------------------------------------------------------------------------------------------------


@R.query(f"with {HOSTS}, {INVENTORY} select device, last_us from inv order by last_us desc, device limit 50")
def device_page(spark, sf_dir: str) -> DataFrame:
    """The first page of devices, the latest seen first (ORD-03)."""
    return inventory(hosts(spark, sf_dir)).select("device", "last_us").orderBy(F.desc("last_us"), "device").limit(50)


@R.query("select sensor_id, is_primary, epoch_us(last_seen) as last_us, row_number() over (order by is_primary desc, last_seen desc, sensor_id) as pos from sensors")
def sensor_list(spark, sf_dir: str) -> DataFrame:
    """Sensors, the primary one first, then the latest seen; a table of fixed size (ORD-03)."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("is_primary"), F.desc("last_seen"), "sensor_id")
    return load(spark, sf_dir, "sensors").select("sensor_id", "is_primary", F.unix_micros("last_seen").alias("last_us"), F.row_number().over(w).alias("pos"))


def work_list(sensors: DataFrame, targets: DataFrame) -> DataFrame:
    """Networks to scan, each once with its greatest priority: primary sensors' first, then enabled targets, then other sensors'."""
    s = sensors.select("cidr", F.when(F.col("is_primary"), 0).otherwise(2).alias("p"))
    t = targets.where("enabled").select("cidr", F.lit(1).alias("p"))
    return s.unionByName(t).where("cidr is not null").groupBy("cidr").agg(F.min("p").alias("priority"))


@R.query("""with t as (select distinct cidr from device_reports where coalesce(nullif(segment, ''), 'default') <> 'guest'), u as (select cidr, case when is_primary then 0 else 2 end as p from sensors union all select cidr, 1 from t) select cidr, min(p) as priority from u where cidr is not null group by cidr""")
def enabled_work(spark, sf_dir: str) -> DataFrame:
    """The work list where targets in guest networks are switched off (FLT-10)."""
    t = load(spark, sf_dir, "device_reports").select("cidr", (F.coalesce(F.nullif("segment", F.lit("")), F.lit("default")) != "guest").alias("enabled"))
    return work_list(load(spark, sf_dir, "sensors"), t)


@R.query(f"""with {EV}, {_SUP_SQL}, {_ALW_SQL}, v as (select * from ev e where not exists (select 1 from alw a where {_ALW_HIT})), x as (select e.event_id, e.acknowledged, count(s.rule_id) as hits from v e left join sup s on {_SUP_HIT} group by all)
 select case when acknowledged then 'acknowledged' when hits > 0 then 'suppressed' else 'active' end as state, count(*) as n from x group by 1""")
def triage(spark, sf_dir: str) -> DataFrame:
    """What is left after the allow list, divided into visible, acknowledged and suppressed events (FLT-15)."""
    left = events(spark, sf_dir, ~allowed(spark.createDataFrame(ALLOWED, _ALW)))
    e = suppressed_by(left.select("event_id", "domain", "source_ip", "tags", "acknowledged"), spark.createDataFrame(SUPPRESSIONS, _SUP))
    return e.groupBy(F.when(F.col("acknowledged"), "acknowledged").when(F.col("rule_id").isNotNull(), "suppressed").otherwise("active").alias("state")).agg(F.count("*").alias("n"))


@R.query(f"with {EV} select event_id, t_us, source_ip from ev where network_segment = 'iot' and event_type = 'anomaly' and anomaly_score >= 0.3")
def events_of_segment(spark, sf_dir: str) -> DataFrame:
    """Threats of a kind in one segment (FLT-16)."""
    return EventQuery(event_type="anomaly", min_score=0.3, segment="iot").events(spark, sf_dir).select("event_id", "t_us", "source_ip")


@R.query(f"""with {EV}, {HOSTS}, d as (select max(ip) as ip from hosts join (select distinct source_ip from ev where anomaly_score > 0.5) e on hosts.ip = e.source_ip) select event_id, domain, anomaly_score from ev, d where source_ip = d.ip and anomaly_score >= 0.5""")
def device_threats(spark, sf_dir: str) -> DataFrame:
    """Threats of one device, here that with the greatest address of those that have any (FLT-16)."""
    seen = deliveries(spark, sf_dir, "anomaly_score > 0.5").select(F.col("source_ip").alias("ip")).distinct()
    ip = hosts(spark, sf_dir).join(seen, "ip").agg(F.max("ip")).first()[0]
    return EventQuery(source_ip=ip or "", min_score=0.5).events(spark, sf_dir).select("event_id", "domain", "anomaly_score")


# --- networks --------------------------------------------------------------------------------------------------------------------------------


def in_networks(addresses: DataFrame, ip: str, networks: DataFrame, net: str) -> DataFrame:
    """The distinct values of ``ip`` that lie in a network of the column ``net``, in any notation, IPv4 and IPv6.

    A network's least and greatest address have the same beginning, in whole
    hexadecimal digits; addresses meet networks by equal beginnings of the lengths
    that occur (33 at most), and the ends settle it.
    """
    n = networks.select(cidr(net).alias("n")).where("n is not null").select(F.col("n.lo").alias("lo"), F.col("n.hi").alias("hi"), F.floor(F.col("n.bits") / 4).cast("int").alias("digits")).distinct()
    n = n.withColumn("beginning", F.substr("lo", F.lit(1), F.col("digits")))
    lengths = sorted(r.digits for r in n.select("digits").distinct().collect())  # 33 numbers at most
    a = addresses.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("h", ip_hex(ip)).where("h is not null")
    a = a.withColumn("digits", F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"))).withColumn("beginning", F.substr("h", F.lit(1), F.col("digits")))
    return a.join(n, ["digits", "beginning"]).where("length(h) = length(lo) and h between lo and hi").select(ip).distinct()


def local_resolvers_of(addresses: DataFrame, ip: str, known: DataFrame, networks: DataFrame, net: str) -> DataFrame:
    """Distinct addresses with ``local``: whether each is listed in ``known`` (column ``ip``) or lies in one of the networks."""
    a = addresses.select(ip).where(F.col(ip).isNotNull()).distinct()
    listed = known.select(F.col("ip").alias(ip)).unionByName(in_networks(addresses, ip, networks, net)).distinct().withColumn("__local", F.lit(True))
    return a.join(listed, ip, "left").select(ip, F.coalesce("__local", F.lit(False)).alias("local"))


_INT4 = "(split_part({0}, '.', 1)::bigint * 16777216 + split_part({0}, '.', 2)::bigint * 65536 + split_part({0}, '.', 3)::bigint * 256 + split_part({0}, '.', 4)::bigint)"


@R.query(rf"""with a as (select distinct server_ip as ip from dns_queries where server_ip is not null), n as (select distinct split_part(cidr, '/', 1) as net, split_part(cidr, '/', 2)::int as bits from sensors where regexp_full_match(cidr, '[0-9.]+/[0-9]+')),
 i as (select a.ip from a join n on regexp_full_match(a.ip, '[0-9]+(\.[0-9]+){{3}}') and {_INT4.format("(case when regexp_full_match(a.ip, '[0-9]+(\\.[0-9]+){3}') then a.ip else '0.0.0.0' end)").replace(chr(92) * 2, chr(92))} >> (32 - bits) = {_INT4.format('net')} >> (32 - bits))
 select ip as server_ip, ip in ('10.20.0.1', '9.9.9.9') or ip in (select ip from i) as local from a""")
def local_resolvers(spark, sf_dir: str) -> DataFrame:
    """Which servers that were asked are local: listed, or in a sensor's network (FLT-21)."""
    known = spark.createDataFrame([("10.20.0.1",), ("9.9.9.9",)], "ip string")
    return local_resolvers_of(load(spark, sf_dir, "dns_queries"), "server_ip", known, load(spark, sf_dir, "sensors"), "cidr")


@R.query("""with c as (select distinct cidr from device_reports where cidr is not null union select distinct cidr from sensors where cidr is not null)
 select cidr, split_part(cidr, '/', 1) || '/' || split_part(cidr, '/', 2) as network from c""")
def networks(spark, sf_dir: str) -> DataFrame:
    """Networks in one notation, host bits cleared (SCA-25)."""
    both = load(spark, sf_dir, "device_reports").select("cidr").unionByName(load(spark, sf_dir, "sensors").select("cidr")).where("cidr is not null").distinct()
    # a host with some bits set stands for its network
    inside = F.regexp_replace("cidr", r"\.0/", ".9/")
    return both.select("cidr", network(inside).alias("network"))


# --- sinks -----------------------------------------------------------------------------------------------------------------------------------


@R.query(f"with {EV}, m as (select * from ev where event_type = 'anomaly'), p as (select * from m order by t_us desc nulls last, event_id limit 50) select (select count(*) from m) as total, 1 as page, 50 as page_limit, (select count(*) from p) as n, (select min(event_id) from p) as least_id")
def page_document(spark, sf_dir: str) -> DataFrame:
    """A page as one JSON document, read again (SNK-02)."""
    q = EventQuery(event_type="anomaly")
    ev = q.events(spark, sf_dir)
    doc = page_json(q.rows(ev).select("event_id", "t_us", "tags"), ev.count(), q.page, q.limit)
    d = doc.select(F.from_json("body", "events array<struct<event_id: string, t_us: bigint, tags: array<string>>>, total bigint, page int, `limit` int").alias("d"))
    return d.select("d.total", "d.page", F.col("d.limit").alias("page_limit"), F.size("d.events").cast("bigint").alias("n"), F.array_min(F.transform("d.events", lambda e: e["event_id"])).alias("least_id"))


@R.query(f"""with {HOSTS}, {INVENTORY}, pr as (select device, arg_max(coalesce(ports, []), (t_us, report_id, pos)) as ports from k group by device)
 select device, '"' || device || '","' || replace(coalesce(hostname, ''), '"', '""') || '","' || replace(coalesce(vendor, ''), '"', '""') || '","' || coalesce(nullif(ip, ''), '') || '","' || array_to_string(list_filter(ports, lambda x: x is not null), ';') || '"' as line from inv join pr using (device)""")
def device_csv(spark, sf_dir: str) -> DataFrame:
    """Devices as lines with every field in quotes, quotes doubled (SNK-04)."""
    inv = inventory(hosts(spark, sf_dir))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    ports = F.array_join(F.transform("ports", lambda p: p.cast("string")), ";")
    return inv.select("device", F.concat_ws(",", *(quoted(c) for c in (F.col("device"), F.col("hostname"), F.col("vendor"), F.col("ip"), ports))).alias("line"))


# --- batches and retention -------------------------------------------------------------------------------------------------------------------


def in_batches(ev: DataFrame, size: int, width_us: int, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``b_us`` and ``batch_no``: batches of at most ``size`` events within a time window, in the order of time and id, so that a batch is full or its window over."""
    window = F.col("t_us") - F.pmod("t_us", F.lit(width_us))
    c = counted.withColumn("b_us", window) if counted is not None else None
    n = numbered(ev.withColumn("b_us", window), ["b_us"], ["t_us", "event_id"], max(1, width_us // 60), counted=c)
    return n.withColumn("batch_no", F.expr(f"(rn - 1) div {size}L")).drop("rn")


_BATCHES = "with {EV}, x as (select t_us - t_us % {width} as b_us, (row_number() over (partition by t_us - t_us % {width} order by t_us, event_id) - 1) // {size} as batch_no, event_id from ev) select b_us, batch_no, count(*) as n, min(event_id) as least_id from x group by 1, 2"


def _batches(spark, sf_dir: str, size: int, width_us: int) -> DataFrame:
    b = in_batches(events(spark, sf_dir).select("event_id", "t_us"), size, width_us, deliveries(spark, sf_dir).select("t_us"))
    return b.groupBy("b_us", "batch_no").agg(F.count("*").alias("n"), F.min("event_id").alias("least_id"))


@R.query(_BATCHES.replace("{EV}", EV).replace("{width}", "900000000").replace("{size}", "1000"))
def telemetry_batches(spark, sf_dir: str) -> DataFrame:
    """Events in batches of 15 minutes and at most 1000 (SRC-25)."""
    return _batches(spark, sf_dir, 1000, 900_000_000)


@R.query(_BATCHES.replace("{EV}", EV).replace("{width}", "10000000").replace("{size}", "100"))
def size_time_batches(spark, sf_dir: str) -> DataFrame:
    """Events in batches of 10 seconds and at most 100 (STR-06)."""
    return _batches(spark, sf_dir, 100, 10_000_000)


#: Days that rows of each kind are kept.
TIERS = {"dns_query": 30, "nmap_discovery": 90, "firewall_log": 180, "anomaly": 365}


def retained_by_kind(df: DataFrame, kind: str, days: dict[str, int], as_of_us: int, other: int = 90) -> DataFrame:
    """Rows not older than the days of their kind; for kinds without any, ``other``."""
    ttl = F.coalesce(F.create_map(*(F.lit(x) for kv in days.items() for x in kv))[F.col(kind)], F.lit(other)).cast("bigint")
    return df.where(F.col("t_us") >= F.lit(as_of_us) - ttl * DAY)


@R.query(f"with {EV}, m as (select max(t_us) as now from ev) select event_type, count(*) as n from ev, m where t_us >= now - case event_type when 'dns_query' then 30 when 'nmap_discovery' then 90 when 'firewall_log' then 180 when 'anomaly' then 365 else 90 end * 86400000000::bigint group by 1")
def tiered_retention(spark, sf_dir: str) -> DataFrame:
    """Events left by retention with a time for each kind (STR-13)."""
    return retained_by_kind(events(spark, sf_dir), "event_type", TIERS, now_us(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query(f"with {EV}, m as (select max(t_us) as now from ev) select count(*) as left_over, min(t_us) as oldest_us from ev, m where t_us >= now - 90 * 86400000000::bigint")
def retention_90d(spark, sf_dir: str) -> DataFrame:
    """What the retention of 90 days leaves, as surveyed (DML-07)."""
    now = now_us(spark, sf_dir)
    return retained(events(spark, sf_dir, from_us=now - 90 * DAY), None, now).agg(F.count("*").alias("left_over"), F.min("t_us").alias("oldest_us"))


# --- polls, flows, nodes -----------------------------------------------------------------------------------------------------------------------


def poll_latest(df: DataFrame, t: str, tie: str, watermark_us: int, limit: int = 100) -> DataFrame:
    """What a poll of an interface that gives the ``limit`` latest records adds: those after the watermark. The next watermark is their greatest time; an empty poll leaves it."""
    return df.orderBy(F.desc(t), tie).limit(limit).where(F.col(t) > watermark_us)


@R.query(f"with {EV}, a as (select event_id, t_us from ev where dns_source = 'adguard' order by t_us desc, event_id limit 100), m as (select max(t_us) - 600000000 as mark from a) select event_id, t_us from a, m where t_us > mark")
def latest_poll(spark, sf_dir: str) -> DataFrame:
    """The latest 100 records after a watermark ten minutes before the last one (SRC-07)."""
    a = events(spark, sf_dir, "dns_source = 'adguard'").select("event_id", "t_us")
    mark = deliveries(spark, sf_dir, "dns_source = 'adguard'").agg(F.max("t_us")).first()[0] or 0
    return poll_latest(a, "t_us", "event_id", mark - 600_000_000)


@R.query(f"""with {FW}, l as (select unnest({[*(k for k in PUBLIC_RESOLVERS if ':' not in k), *SAMPLE_RESOLVERS]}) as ip), f as (select fw_id, t_us, trim(src_ip) as src_ip, trim(dst_ip) as dst_ip from fw where dst_port in (443, 853) and src_ip is not null and trim(dst_ip) in (select ip from l)),
 x as (select *, row_number() over (partition by src_ip, dst_ip order by t_us, fw_id) as rn from f) select fw_id, src_ip, dst_ip, rn from x where rn % 10 = 0""")
def encrypted_flows(spark, sf_dir: str) -> DataFrame:
    """Every tenth flow of a source to the ports of encrypted DNS at a listed address (STR-05)."""
    listed = [*(k for k in PUBLIC_RESOLVERS if ":" not in k), *SAMPLE_RESOLVERS]
    f = firewall(spark, sf_dir, F.col("dst_port").isin(443, 853) & F.col("src_ip").isNotNull() & F.trim("dst_ip").isin(listed)).select("fw_id", "t_us", F.trim("src_ip").alias("src_ip"), F.trim("dst_ip").alias("dst_ip"))
    return numbered(f, ["src_ip", "dst_ip"], ["t_us", "fw_id"]).where("rn % 10 = 0").select("fw_id", "src_ip", "dst_ip", F.col("rn").cast("bigint").alias("rn"))


def with_registry(reports: DataFrame, registry: DataFrame, key: str = "source_hash") -> DataFrame:
    """Reports with what the registry knows of their node (``network``, null for unknown nodes); one entry of a node counts, the first in order."""
    r = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("network").alias("network"))
    return reports.join(r, key, "left")


@R.query(f"""with {EV}, g as (select source_hash, geo, count(*) as c from ev where geo is not null and source_hash is not null group by 1, 2), rg as (select source_hash, arg_max(geo, (c, geo)) as network from g group by 1)
 select domain, count(distinct e.source_hash) as nodes, count(distinct network) as networks from ev e left join rg using (source_hash) where domain is not null group by domain""")
def node_networks(spark, sf_dir: str) -> DataFrame:
    """In how many networks a name's nodes are, by a registry of nodes, here each node's most frequent network (JOI-12). Nodes and names are brought together once per pair."""
    ev = events(spark, sf_dir, "source_hash is not null")
    g = ev.where("geo is not null").groupBy("source_hash", "geo").agg(F.count("*").alias("c"))
    registry = g.groupBy("source_hash").agg(F.max(F.struct("c", "geo"))["geo"].alias("network"))
    pairs = ev.where("domain is not null").select("source_hash", "domain").distinct()
    return with_registry(pairs, registry).groupBy("domain").agg(F.count("*").alias("nodes"), F.countDistinct("network").alias("networks"))


QUERIES, SQL = R.QUERIES, R.SQL
