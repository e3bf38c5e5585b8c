"""Devices: merging of reports, identity, fingerprints, and writes that keep what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.operators.detect import INDICATORS, indicators, rows, sql_rows
from siftnet.plans.base import EV, HOSTS, Registry, events, hosts, last_time, now_us
from siftnet.plans.fixtures import HOSTNAME_RULES, VENDOR_PREFIXES, VENDOR_TYPES
from siftnet.tables import load

R = Registry()
DAY = 86_400_000_000


def first_known(value: str, order: list[str]) -> Column:
    """The first value in an order that isn't null, as an aggregate that needs no sort."""
    return F.min(F.when(F.col(value).isNotNull(), F.struct(*order, value)))[value]


@R.query(f"""with {HOSTS}, k as (select *, coalesce(mac, ip) as k from hosts where coalesce(mac, ip) is not null)
 select k, arg_min(ip, (t_us, report_id, pos)) filter (ip is not null) as ip, arg_min(hostname, (t_us, report_id, pos)) filter (hostname is not null) as hostname, arg_min(vendor, (t_us, report_id, pos)) filter (vendor is not null) as vendor, min(t_us) as first_us, max(t_us) as last_us, count(*) as n from k group by k""")
def host_merge(spark, sf_dir: str) -> DataFrame:
    """One row per device, by hardware address or else address, with the first known value of each field."""
    h = hosts(spark, sf_dir).withColumn("k", F.coalesce("mac", "ip")).where("k is not null")
    order = ["t_us", "report_id", "pos"]
    return h.groupBy("k").agg(first_known("ip", order).alias("ip"), first_known("hostname", order).alias("hostname"), first_known("vendor", order).alias("vendor"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count("*").alias("n"))


def inventory(h: DataFrame) -> DataFrame:
    """Devices as they stand after all reports in order: identity is the hardware address, or address and segment of those without."""
    k = h.withColumn("device", F.coalesce("mac", F.concat_ws("@", "ip", "segment"))).where("mac is not null or ip is not null")
    order = ["t_us", "report_id", "pos"]
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(*order, c)))[c]
    last = F.max(F.struct(*order, "ip", "ports", "segment"))
    return k.groupBy("device").agg(F.max("mac").alias("mac"), newest("hostname").alias("hostname"), newest("vendor").alias("vendor"), last.alias("l"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us")).select("device", "mac", "hostname", "vendor", F.col("l.ip").alias("ip"), F.col("l.ports").alias("ports"), F.col("l.segment").alias("segment"), "first_us", "last_us")


INVENTORY = """k as (select *, coalesce(mac, concat_ws('@', ip, segment)) as device from hosts where mac is not null or ip is not null),
 inv as (select device, max(mac) as mac, arg_max(hostname, (t_us, report_id, pos)) filter (hostname is not null) as hostname, arg_max(vendor, (t_us, report_id, pos)) filter (vendor is not null) as vendor,
  arg_max(coalesce(ip, ''), (t_us, report_id, pos)) as ip, arg_max(segment, (t_us, report_id, pos)) as segment, min(t_us) as first_us, max(t_us) as last_us from k group by device)"""


@R.query(f"with {HOSTS}, {INVENTORY} select device, mac, hostname, vendor, nullif(ip, '') as ip, segment, first_us, last_us from inv")
def device_inventory(spark, sf_dir: str) -> DataFrame:
    return inventory(hosts(spark, sf_dir)).select("device", "mac", "hostname", "vendor", "ip", "segment", "first_us", "last_us")


@R.query(f"with {HOSTS}, {INVENTORY}, m as (select max(t_us) as now from hosts) select device, first_us from inv, m where first_us > now - 86400000000")
def new_devices(spark, sf_dir: str) -> DataFrame:
    h = hosts(spark, sf_dir)
    return inventory(h).where(F.col("first_us") > last_time(h) - DAY).select("device", "first_us")


@R.query(f"""with {EV}, {HOSTS}, d as (select ip, arg_max(coalesce(hostname, ''), (t_us, report_id, pos)) as hostname, arg_max(coalesce(mac, ''), (t_us, report_id, pos)) as mac from hosts where ip is not null group by ip)
 select event_id, hostname, mac from ev join d on ev.source_ip = d.ip""")
def event_devices(spark, sf_dir: str) -> DataFrame:
    """Events with the device that had their address last."""
    h = hosts(spark, sf_dir).where("ip is not null")
    latest = h.groupBy("ip").agg(F.max(F.struct("t_us", "report_id", "pos", F.coalesce("hostname", F.lit("")).alias("hostname"), F.coalesce("mac", F.lit("")).alias("mac"))).alias("d"))
    return events(spark, sf_dir).select("event_id", "source_ip").join(latest.select(F.col("ip").alias("source_ip"), "d.hostname", "d.mac"), "source_ip").select("event_id", "hostname", "mac")


def upsert_devices(known: DataFrame, seen: DataFrame) -> DataFrame:
    """The table after a scan: first times stay, blank fields never overwrite known ones, address, ports and segment are replaced, and an identity that was corrected by hand (``locked``) or is more confident stays."""
    j = known.alias("a").join(seen.alias("b"), "device", "full_outer")
    both = lambda c: F.coalesce(f"b.{c}", f"a.{c}").alias(c)
    kept = F.coalesce("a.locked", F.lit(False)) | (F.coalesce("b.confidence", F.lit(-1.0)) < F.coalesce("a.confidence", F.lit(0.0)))
    pick = lambda c: F.when(kept, F.coalesce(f"a.{c}", f"b.{c}")).otherwise(F.coalesce(f"b.{c}", f"a.{c}")).alias(c)
    return j.select("device", both("hostname"), both("vendor"), both("ip"), F.least("a.first_us", "b.first_us").alias("first_us"), F.greatest("a.last_us", "b.last_us").alias("last_us"), pick("device_type"), F.greatest("a.confidence", "b.confidence").alias("confidence"), F.coalesce("a.locked", F.lit(False)).alias("locked"))


def _half(h: DataFrame, early: bool) -> DataFrame:
    part = h.where((F.col("report_id") % 2 == 0) if early else (F.col("report_id") % 2 == 1))
    inv = inventory(part)
    mark = F.ascii(F.right("device", F.lit(1))) * 7 + F.ascii(F.right("device", F.lit(2)))
    conf = F.pmod(mark, F.lit(100 if early else 90)) / 100.0
    return inv.select("device", "hostname", "vendor", "ip", "first_us", "last_us", F.lit("scan-a" if early else "scan-b").alias("device_type"), conf.alias("confidence"), (F.pmod(mark, F.lit(7)) == 0).alias("locked"))


def _half_sql(name: str, parity: int, mod: int) -> str:
    mark = "(ascii(right(device, 1)) * 7 + ascii(right(device, 2)))"
    return f"""{name}_k as (select *, coalesce(mac, concat_ws('@', ip, segment)) as device from hosts where (mac is not null or ip is not null) and report_id % 2 = {parity}),
 {name} as (select device, arg_max(hostname, (t_us, report_id, pos)) filter (hostname is not null) as hostname, arg_max(vendor, (t_us, report_id, pos)) filter (vendor is not null) as vendor, nullif(arg_max(coalesce(ip, ''), (t_us, report_id, pos)), '') as ip, min(t_us) as first_us, max(t_us) as last_us,
  'scan-{name}' as device_type, {mark} % {mod} / 100.0::double as confidence, {mark} % 7 = 0 as locked from {name}_k group by device)"""


@R.query(f"""with {HOSTS}, {_half_sql('a', 0, 100)}, {_half_sql('b', 1, 90)}
 select device, coalesce(b.hostname, a.hostname) as hostname, coalesce(b.vendor, a.vendor) as vendor, coalesce(b.ip, a.ip) as ip, least(a.first_us, b.first_us) as first_us, greatest(a.last_us, b.last_us) as last_us,
  case when coalesce(a.locked, false) or coalesce(b.confidence, -1) < coalesce(a.confidence, 0) then coalesce(a.device_type, b.device_type) else coalesce(b.device_type, a.device_type) end as device_type, greatest(a.confidence, b.confidence) as confidence, coalesce(a.locked, false) as locked from a full join b using (device)""")
def device_upsert(spark, sf_dir: str) -> DataFrame:
    """Half of the reports as the table, the other half as a scan."""
    h = hosts(spark, sf_dir)
    return upsert_devices(_half(h, True), _half(h, False).drop("locked"))


@R.query(f"""with {HOSTS}, {INVENTORY}, rl as (select * from {sql_rows(HOSTNAME_RULES, 'ord, pattern, device_type, confidence')}), m as (select device, arg_min(device_type, ord) as device_type, arg_min(confidence, ord)::double as confidence from inv join rl on regexp_matches(hostname, pattern, 'i') group by device),
 v as (select * from {sql_rows(VENDOR_TYPES, 'vendor, v_type')}), x as (select device, m.device_type as h_type, m.confidence as h_conf, v.v_type from inv left join m using (device) left join v using (vendor))
 select device, coalesce(h_type, v_type) as device_type, round(case when h_conf is not null then least(1.0, h_conf + case when v_type = h_type then 0.15 else 0 end) when v_type is not null then 0.15 else 0.1 end, 6) as confidence from x where h_type is not null or v_type is not null""")
def fingerprints(spark, sf_dir: str) -> DataFrame:
    """Device types by the first host name rule that fits, or else by vendor; agreement adds confidence."""
    inv = inventory(hosts(spark, sf_dir))
    rules = rows(inv, HOSTNAME_RULES, "ord int, pattern string, h_type string, h_conf double")
    by_name = inv.join(rules, F.regexp_like("hostname", F.concat(F.lit("(?i)"), "pattern"))).groupBy("device").agg(F.min(F.struct("ord", "h_type", "h_conf")).alias("r")).select("device", "r.h_type", "r.h_conf")
    x = inv.select("device", "vendor").join(by_name, "device", "left").join(rows(inv, VENDOR_TYPES, "vendor string, v_type string"), "vendor", "left")
    conf = F.when(F.col("h_conf").isNotNull(), F.least(F.lit(1.0), F.col("h_conf") + F.when(F.col("v_type") == F.col("h_type"), 0.15).otherwise(0.0))).when(F.col("v_type").isNotNull(), 0.15).otherwise(0.1)
    return x.where("h_type is not null or v_type is not null").select("device", F.coalesce("h_type", "v_type").alias("device_type"), F.round(conf, 6).alias("confidence"))


@R.query(f"with {HOSTS}, p as (select * from {sql_rows(VENDOR_PREFIXES, 'prefix, oui_vendor')}), h as (select distinct mac from hosts where mac is not null) select mac, oui_vendor from h join p on mac[:4] = prefix")
def oui_vendors(spark, sf_dir: str) -> DataFrame:
    """Vendors by the beginning of the hardware address, both in one notation."""
    h = hosts(spark, sf_dir).where("mac is not null").select("mac").distinct()
    return h.join(rows(h, VENDOR_PREFIXES, "prefix string, oui_vendor string"), F.substring("mac", 1, 4) == F.col("prefix")).select("mac", "oui_vendor")


# --- writes ------------------------------------------------------------------------------------------------------------------------------


def insert_ignore(table: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a batch that are new: the first of each key, and only keys the table doesn't have."""
    w = Window.partitionBy(key).orderBy(order)
    return batch.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn").join(table.select(key), key, "left_anti")


@R.query("""with t as (select distinct event_id from dns_events where epoch_us(received_at) % 3 = 0), b as (select event_id, epoch_us(received_at) as r, row_number() over (partition by event_id order by epoch_us(received_at)) as rn from dns_events where epoch_us(received_at) % 3 <> 0)
 select event_id, r from b where rn = 1 and event_id not in (select event_id from t)""")
def insert_ignore_events(spark, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "dns_events").select("event_id", F.unix_micros("received_at").alias("r"))
    return insert_ignore(ev.where("r % 3 = 0"), ev.where("r % 3 <> 0"), "event_id", "r")


def upsert_latest(table: DataFrame, batch: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert or replace: of each key the row with the greatest version, of equals that of the batch."""
    both = table.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    rest = [c for c in table.columns if c not in (*keys, version)]
    return both.groupBy(*keys).agg(F.max(F.struct(version, "__b", *rest)).alias("r")).select(*keys, f"r.{version}", *[f"r.{c}" for c in rest])


@R.query(f"""with {EV}, {INDICATORS}, b as (select indicator, source, last_us + 3600000000 as last_us, 0.5::double as confidence from ind where length(indicator) % 2 = 0), u as (select indicator, source, last_us, confidence, 0 as b from ind union all select *, 1 from b)
 select indicator, source, max(last_us) as last_us, arg_max(confidence, (last_us, b)) as confidence from u group by indicator, source""")
def indicator_upsert(spark, sf_dir: str) -> DataFrame:
    ind = indicators(spark, sf_dir).select("indicator", "source", "last_us", "confidence")
    batch = ind.where(F.length("indicator") % 2 == 0).withColumns({"last_us": F.col("last_us") + 3_600_000_000, "confidence": F.lit(0.5)})
    return upsert_latest(ind, batch, ["indicator", "source"], "last_us")


@R.query(f"with {EV}, m as (select max(t_us) as now from ev) select count(*) filter (t_us < now - 86400000000) as deleted, count(*) filter (t_us >= now - 86400000000) as left_over from ev, m")
def retention(spark, sf_dir: str) -> DataFrame:
    """Rows that a retention of one day deletes and leaves."""
    ev = events(spark, sf_dir)
    cut = now_us(spark, sf_dir) - DAY
    return ev.agg(F.count_if(F.col("t_us") < cut).alias("deleted"), F.count_if(F.col("t_us") >= cut).alias("left_over"))


def retained(df: DataFrame, days: int | None, as_of_us: int) -> DataFrame:
    """Rows not older than ``days``; anything but a positive number of days means 90."""
    return df.where(F.col("t_us") >= as_of_us - (days if days and days >= 1 else 90) * DAY)


@R.query(f"with {EV}, {INDICATORS}, m as (select max(t_us) as now from ev) select indicator, source from ind, m where last_us + ttl_hours * 3600000000::bigint >= now")
def indicator_purge(spark, sf_dir: str) -> DataFrame:
    """Indicators within their time to live."""
    return indicators(spark, sf_dir).where(F.col("last_us") + F.col("ttl_hours").cast("bigint") * 3_600_000_000 >= now_us(spark, sf_dir)).select("indicator", "source")


@R.query(f"""with {EV}, {INDICATORS}, m as (select max(t_us) as now from ev), a as (select source, (now - last_us) / 3600000000.0::double as age, ttl_hours, confidence from ind, m)
 select source, count(*) as n, count(*) filter (age <= ttl_hours) as fresh, count(*) filter (age > 2 * ttl_hours) as expired, round(avg(case when age <= ttl_hours then confidence else greatest(0.1::double, 1 - 0.9::double * (age - ttl_hours) / ttl_hours) * confidence end), 6) as mean from a group by source""")
def feed_freshness(spark, sf_dir: str) -> DataFrame:
    """Freshness of each source, with confidence that decays to a tenth within another time to live."""
    now = now_us(spark, sf_dir)
    a = indicators(spark, sf_dir).withColumn("age", (F.lit(now) - F.col("last_us")) / 3_600_000_000.0)
    conf = F.when(F.col("age") <= F.col("ttl_hours"), F.col("confidence")).otherwise(F.greatest(F.lit(0.1), 1 - 0.9 * (F.col("age") - F.col("ttl_hours")) / F.col("ttl_hours")) * F.col("confidence"))
    return a.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("age") <= F.col("ttl_hours")).alias("fresh"), F.count_if(F.col("age") > 2 * F.col("ttl_hours")).alias("expired"), F.round(F.avg(conf), 6).alias("mean"))


_FEEDS = [("c2feed", "ok"), ("listA", "ok"), ("listB", "error"), ("listC", "ok")]


@R.query(f"with {EV}, {INDICATORS}, f as (select * from {sql_rows(_FEEDS, 'source, state')}) select f.source, f.state, count(i.indicator) as n, count(*) filter (i.confidence >= 0.9) as sure from f left join ind i using (source) group by all")
def feed_health(spark, sf_dir: str) -> DataFrame:
    """State of all feeds, also of those without indicators."""
    ind = indicators(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("sure"))
    return rows(ind, _FEEDS, "source string, state string").join(ind, "source", "left").na.fill(0)


@R.query(f"""with {EV}, {INDICATORS}, a as (select indicator, source, confidence from ind where length(indicator) % 3 <> 0), b as (select indicator, source, case when length(indicator) % 5 = 0 then 0.4::double else confidence end as confidence from ind where length(indicator) % 4 <> 0)
 select coalesce(a.indicator, b.indicator) as indicator, coalesce(a.source, b.source) as source, case when a.indicator is null then 'added' when b.indicator is null then 'removed' else 'updated' end as change from a full join b on a.indicator = b.indicator and a.source = b.source where a.indicator is null or b.indicator is null or a.confidence <> b.confidence""")
def feed_diff(spark, sf_dir: str) -> DataFrame:
    """What a newer snapshot of a feed adds, removes and updates."""
    ind = indicators(spark, sf_dir).select("indicator", "source", "confidence")
    a = ind.where(F.length("indicator") % 3 != 0)
    b = ind.where(F.length("indicator") % 4 != 0).withColumn("confidence", F.when(F.length("indicator") % 5 == 0, 0.4).otherwise(F.col("confidence"))).withColumnRenamed("confidence", "newer")
    j = a.join(b, ["indicator", "source"], "full_outer").where("confidence is null or newer is null or confidence <> newer")
    return j.select("indicator", "source", F.when(F.col("confidence").isNull(), "added").when(F.col("newer").isNull(), "removed").otherwise("updated").alias("change"))


@R.query("""with s as (select sensor_id, cidr, is_primary from sensors), t as (select distinct cidr from device_reports where cidr is not null), u as (select cidr, 0 as p, sensor_id from s where is_primary union all select cidr, 1, null from t union all select cidr, 2, sensor_id from s where not is_primary)
 select cidr, min(p) as priority from u where cidr is not null group by cidr""")
def scan_work(spark, sf_dir: str) -> DataFrame:
    """Networks to scan, each once, of the source with the greatest priority."""
    s = load(spark, sf_dir, "sensors").select("cidr", F.when(F.col("is_primary"), 0).otherwise(2).alias("p"))
    t = load(spark, sf_dir, "device_reports").select("cidr", F.lit(1).alias("p"))
    return s.unionByName(t).where("cidr is not null").groupBy("cidr").agg(F.min("p").alias("priority"))


@R.query("""select sensor_id, hostname, is_primary, epoch_us(last_seen) as last_us from sensors where status = 'online'""")
def online_sensors(spark, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "sensors").where("status = 'online'").select("sensor_id", "hostname", "is_primary", F.unix_micros("last_seen").alias("last_us"))


def register_sensors(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The sensors after a registration: first times stay, the latest data hold, and exactly the latest primary of the batch (else the old one) is primary."""
    both = table.withColumn("__b", F.lit(0)).unionByName(batch.withColumn("__b", F.lit(1)))
    last = both.groupBy("sensor_id").agg(F.min("first_us").alias("first_us"), F.max(F.struct("__b", "last_us", "hostname", "is_primary")).alias("r")).select("sensor_id", "first_us", "r.last_us", "r.hostname", "r.is_primary", "r.__b")
    top = last.where("is_primary").agg(F.max(F.struct("__b", "last_us", "sensor_id"))["sensor_id"].alias("__top"))
    return last.join(F.broadcast(top), F.col("sensor_id") == F.col("__top"), "left").select("sensor_id", "hostname", "first_us", "last_us", F.col("__top").isNotNull().alias("is_primary"))


@R.query("""with t as (select sensor_id, hostname, is_primary, epoch_us(first_seen) as first_us, epoch_us(last_seen) as last_us from sensors), b as (select sensor_id, hostname || '-new' as hostname, ends_with(sensor_id, 'arm64') as is_primary, first_us + 1 as first_us, last_us + 1000000 as last_us from t where length(sensor_id) % 2 = 0),
 u as (select *, 0 as b from t union all select *, 1 from b), l as (select sensor_id, min(first_us) as first_us, arg_max(hostname, (b, last_us)) as hostname, arg_max(is_primary, (b, last_us)) as is_primary, max(b) as b, arg_max(last_us, (b, last_us)) as last_us from u group by sensor_id),
 p as (select arg_max(sensor_id, (b, last_us, sensor_id)) as top from l where is_primary) select sensor_id, hostname, first_us, last_us, coalesce(sensor_id = top, false) as is_primary from l, p""")
def sensor_upsert(spark, sf_dir: str) -> DataFrame:
    t = load(spark, sf_dir, "sensors").select("sensor_id", "hostname", "is_primary", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))
    b = t.where(F.length("sensor_id") % 2 == 0).select("sensor_id", F.concat("hostname", F.lit("-new")).alias("hostname"), F.endswith("sensor_id", F.lit("arm64")).alias("is_primary"), (F.col("first_us") + 1).alias("first_us"), (F.col("last_us") + 1_000_000).alias("last_us"))
    return register_sensors(t, b)


@R.query(f"with {EV}, v as (select domain, source_hash, event_type, t_us - t_us % 3600000000 as h_us, t_us as version, event_id from ev where domain is not null) select domain, source_hash, event_type, h_us, max(version) as version, arg_max(event_id, (version, event_id)) as event_id from v group by all")
def version_dedupe(spark, sf_dir: str) -> DataFrame:
    """The latest version of each name, source, type and hour."""
    ev = events(spark, sf_dir, named=True)
    h = (F.col("t_us") - F.pmod("t_us", F.lit(3_600_000_000))).alias("h_us")
    return ev.groupBy("domain", "source_hash", "event_type", h).agg(F.max(F.struct("t_us", "event_id")).alias("v")).select("domain", "source_hash", "event_type", "h_us", F.col("v.t_us").alias("version"), F.col("v.event_id").alias("event_id"))


QUERIES, SQL = R.QUERIES, R.SQL
