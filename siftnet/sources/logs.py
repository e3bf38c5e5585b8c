"""Lines and documents of other systems: system logs, packet filter logs, alerts, controllers, network scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.plans.base import EV, FW, HOSTS, Registry, events, firewall, hosts
from siftnet.tables import load

R = Registry()

SYSLOG = r"^<(\d+)>(\S+ +\S+ \S+) (\S+) ([^ :\[]+)(?:\[(\d+)\])?: (.+)$"
DNSMASQ = r"^(\S+ +\S+(?: \S+)?) dnsmasq\[(\d+)\]: (query|reply|forwarded|cached|gravity blocked)\[([A-Z]+)\] (\S+) from (\S+)$"


def parse_syslog(df: DataFrame, line: str = "line") -> DataFrame:
    """Priority, time as written, host, program, process and message; lines of another form are left out."""
    part = lambda i: F.regexp_extract(line, SYSLOG, i)
    return df.where(F.col(line).rlike(SYSLOG)).select(part(1).cast("int").alias("pri"), part(2).alias("written"), part(3).alias("host"), part(4).alias("ident"), F.nullif(part(5), F.lit("")).cast("int").alias("pid"), part(6).alias("message"))


def parse_dnsmasq(df: DataFrame, line: str = "line") -> DataFrame:
    """Questions in a resolver's log; times of two or three words are both read."""
    part = lambda i: F.regexp_extract(line, DNSMASQ, i)
    return df.where(F.col(line).rlike(DNSMASQ)).select(part(1).alias("written"), part(3).alias("action"), part(4).alias("query_type"), part(5).alias("domain"), part(6).alias("client"), part(3).rlike("block|gravity").alias("blocked"))


def parse_filterlog(df: DataFrame, line: str = "line") -> DataFrame:
    """Records of a packet filter: common fields, then those of the IP version, then those of the protocol. Short lines are left out."""
    f = F.split(line, ",", -1)
    at = lambda i: F.get(f, i if isinstance(i, Column) else F.lit(i))
    v4 = at(8) == "4"
    base = F.when(v4, 20).otherwise(17)
    proto = F.lower(F.when(v4, at(16)).otherwise(at(12)))
    ports = proto.isin("tcp", "udp")
    port = lambda k: F.when(ports, at(base + k).try_cast("int"))
    r = df.where((F.size(f) >= 17) & at(8).isin("4", "6"))
    return r.select(
        at(3).alias("tracker"), at(4).alias("iface"), at(5).alias("reason"), at(6).alias("action"), at(7).alias("direction"), at(8).cast("int").alias("ip_version"), proto.alias("proto"), F.when(v4, at(17)).otherwise(at(14)).try_cast("int").alias("length"),
        F.when(v4, at(18)).otherwise(at(15)).alias("src_ip"), F.when(v4, at(19)).otherwise(at(16)).alias("dst_ip"), port(0).alias("src_port"), port(1).alias("dst_port"), F.when(proto == "tcp", F.nullif(at(base + 3), F.lit(""))).alias("flags"),
    )


EVE = "timestamp string, event_type string, src_ip string, src_port int, dest_ip string, dest_port int, proto string, alert struct<action: string, signature_id: bigint, signature: string, category: string, severity: int, metadata: struct<mitre_technique_id: array<string>>>, dns struct<query: array<struct<rrname: string>>>, http struct<hostname: string>"


def parse_eve(df: DataFrame, line: str = "line") -> DataFrame:
    """Alerts of an intrusion detection system; other records are left out."""
    e = df.select(F.from_json(line, EVE).alias("e")).select("e.*").where("event_type = 'alert'")
    severity = F.coalesce("alert.severity", F.lit(4))
    score = F.when(severity == 1, 1.0).when(severity == 2, 0.75).when(severity == 3, 0.5).otherwise(0.25)
    return e.select(
        F.lit("ids_alert").alias("event_type"), "timestamp", F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"), "src_port", "dest_ip", "dest_port", "proto", F.coalesce(F.get("dns.query", F.lit(0))["rrname"], F.col("http.hostname")).alias("domain"),
        F.coalesce(F.col("alert.action") == "blocked", F.lit(False)).alias("blocked"), score.alias("anomaly_score"), F.array_compact(F.array(F.lit("ids"), F.col("alert.category"))).alias("tags"), "alert.signature_id", "alert.signature", severity.alias("severity"), F.get("alert.metadata.mitre_technique_id", F.lit(0)).alias("mitre"),
    )


_CONTROLLER = "data array<struct<timestamp: double, proto: string, srcip: string, srcport: double, dstip: string, dstport: double, msg: string, app: string, alarm: string>>"


def parse_controller(df: DataFrame, body: str = "body") -> DataFrame:
    """Firewall records of a network controller: detections with both addresses, and alarms about firewall or threats. Polls overlap, so that equal records count once."""
    d = df.select(F.explode(F.from_json(body, _CONTROLLER)["data"]).alias("d")).select("d.*")
    alarm = F.col("alarm").rlike("firewall|threat")
    d = d.where(F.coalesce(alarm, F.lit(False)) | (F.col("alarm").isNull() & (F.col("srcip") != "") & (F.col("dstip") != "")))
    return d.select(F.col("timestamp").cast("bigint").alias("s"), F.when(alarm, "alert").otherwise("block").alias("action"), "proto", F.col("srcip").alias("src_ip"), F.col("srcport").cast("int").alias("src_port"), F.col("dstip").alias("dst_ip"), F.col("dstport").cast("int").alias("dst_port"), F.coalesce("alarm", "msg").alias("rule_name"), "app").distinct()


_SCAN = "array<struct<status: struct<_state: string>, address: array<struct<_addr: string, _addrtype: string, _vendor: string>>, hostnames: struct<hostname: array<struct<_name: string>>>, ports: struct<port: array<struct<_portid: int, state: struct<_state: string>>>>>>"


def parse_scan_xml(df: DataFrame, body: str = "body", *keep: str) -> DataFrame:
    """Hosts of a network scan that are up and have an address: hardware address in capitals, first name that isn't empty, open ports in order."""
    h = df.select(*keep, F.explode(F.from_xml(F.col(body), f"struct<host: {_SCAN}>")["host"]).alias("h")).where("h.status._state = 'up'")
    addr = lambda kinds, f: F.get(F.transform(F.filter("h.address", lambda a: a["_addrtype"].isin(*kinds)), lambda a: a[f]), F.lit(0))
    names = F.filter(F.transform("h.hostnames.hostname", lambda n: n["_name"]), lambda n: n != "")
    ports = F.transform(F.filter("h.ports.port", lambda p: p["state"]["_state"] == "open"), lambda p: p["_portid"])
    return h.select(*keep, addr(("ipv4", "ipv6"), "_addr").alias("ip"), F.upper(addr(("mac",), "_addr")).alias("mac"), F.nullif(addr(("mac",), "_vendor"), F.lit("")).alias("vendor"), F.get(names, F.lit(0)).alias("hostname"), F.coalesce(ports, F.array().cast("array<int>")).alias("ports")).where("ip is not null")


def txt_fields(fields: Column) -> Column:
    """``k=v`` texts as a map; a key that repeats has its last value, a text without ``=`` an empty one."""
    pairs = F.transform(fields, lambda f: F.struct(F.regexp_extract(f, "^([^=]*)", 1).alias("k"), F.regexp_extract(f, "^[^=]*=(?s)(.*)$", 1).alias("v")))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: ~F.exists(F.slice(pairs, p["i"] + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))


# --- queries -----------------------------------------------------------------------------------------------------------------------------


@R.query(f"with {FW} select 134 as pri, strftime(make_timestamp(t_us), '%b %d %H:%M:%S') as written, coalesce(iface, 'none') as host, 'filterlog' as ident, cast(fw_id % 1000 as int) as pid, fw_action || ' ' || proto || ' ' || coalesce(raw_log, 'none') as message from fw where proto is not null and fw_action is not null")
def src_syslog(spark, sf_dir: str) -> DataFrame:
    """System log lines made of firewall records, beside broken ones."""
    f = firewall(spark, sf_dir).where("proto is not null and fw_action is not null")
    good = F.concat(F.lit("<134>"), F.date_format(F.timestamp_micros("t_us"), "MMM dd HH:mm:ss"), F.lit(" "), F.coalesce("iface", F.lit("none")), F.lit(" filterlog["), (F.col("fw_id") % 1000).cast("string"), F.lit("]: "), "fw_action", F.lit(" "), "proto", F.lit(" "), F.coalesce("raw_log", F.lit("none")))
    return parse_syslog(f.select(F.explode(F.array(good, F.concat(F.lit("no priority "), "proto"))).alias("line")))


@R.query(f"with {EV} select strftime(make_timestamp(t_us), '%b %d %H:%M:%S') as written, query_type, domain, source_ip as client, blocked from ev where dns_source = 'pihole' and domain is not null and not contains(domain, ' ') and query_type is not null and source_ip is not null")
def src_dnsmasq(spark, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("dns_source = 'pihole' and domain is not null and not contains(domain, ' ') and query_type is not null and source_ip is not null")
    line = F.concat(F.date_format(F.timestamp_micros("t_us"), "MMM dd HH:mm:ss"), F.lit(" dnsmasq[77]: "), F.when(F.col("blocked"), "gravity blocked").otherwise("query"), F.lit("["), "query_type", F.lit("] "), "domain", F.lit(" from "), "source_ip")
    return parse_dnsmasq(e.select(line.alias("line"))).select("written", "query_type", "domain", "client", "blocked")


@R.query(f"with {FW} select cast(fw_id as varchar) as tracker, iface, lower(fw_action) as action, direction, case when contains(src_ip, ':') then 6 else 4 end as ip_version, lower(proto) as proto, src_ip, dst_ip, case when lower(proto) in ('tcp', 'udp') then src_port end as src_port, case when lower(proto) in ('tcp', 'udp') then dst_port end as dst_port from fw where src_ip is not null and dst_ip is not null and proto is not null and iface is not null and fw_action is not null and direction is not null and src_port is not null and dst_port is not null")
def src_filterlog(spark, sf_dir: str) -> DataFrame:
    f = firewall(spark, sf_dir).where("src_ip is not null and dst_ip is not null and proto is not null and iface is not null and fw_action is not null and direction is not null and src_port is not null and dst_port is not null")
    proto = F.lower("proto")
    tail = F.when(proto == "tcp", F.concat_ws(",", "src_port", "dst_port", F.lit("0"), F.lit("S"), F.lit("1"), F.lit("0"), F.lit("64"), F.lit(""), F.lit(""))).when(proto == "udp", F.concat_ws(",", "src_port", "dst_port", F.lit("8"))).otherwise(F.lit("request,1"))
    head = F.concat_ws(",", F.lit("5"), F.lit(""), F.lit(""), "fw_id", "iface", F.lit("match"), F.lower("fw_action"), "direction")
    six = F.concat_ws(",", head, F.lit("6,0x00,0x1,64"), proto, F.lit("6,40"), "src_ip", "dst_ip", tail)
    four = F.concat_ws(",", head, F.lit("4,0x0,,64,1,0,DF,6"), proto, F.lit("60"), "src_ip", "dst_ip", tail)
    lines = f.select(F.explode(F.array(F.when(F.col("src_ip").contains(":"), six).otherwise(four), F.lit("5,,,short"))).alias("line"))
    return parse_filterlog(lines).select("tracker", "iface", "action", "direction", "ip_version", "proto", "src_ip", "dst_ip", "src_port", "dst_port")


@R.query(f"with {FW} select src_ip, dst_ip as dest_ip, rule_name as signature, cast(fw_id % 5 as int) as severity, case fw_id % 5 when 1 then 1.0 when 2 then 0.75 when 3 then 0.5 else 0.25 end::double as anomaly_score, lower(fw_action) = 'block' as blocked from fw where src_ip is not null")
def src_eve(spark, sf_dir: str) -> DataFrame:
    f = firewall(spark, sf_dir).where("src_ip is not null")
    alert = F.struct(F.when(F.lower("fw_action") == "block", "blocked").otherwise("allowed").alias("action"), F.col("fw_id").alias("signature_id"), F.col("rule_name").alias("signature"), F.lit("misc").alias("category"), (F.col("fw_id") % 5).cast("int").alias("severity"))
    good = F.to_json(F.struct(F.lit("alert").alias("event_type"), "src_ip", "src_port", F.col("dst_ip").alias("dest_ip"), F.col("dst_port").alias("dest_port"), "proto", alert.alias("alert")))
    lines = f.select(F.explode(F.array(good, F.lit('{"event_type": "flow"}'), F.lit("{broken"))).alias("line"))
    return parse_eve(lines).select("src_ip", "dest_ip", "signature", "severity", "anomaly_score", "blocked")


@R.query(f"with {FW} select distinct t_us // 1000000 as s, 'block' as action, proto, src_ip, dst_ip, rule_name from fw where src_ip is not null and dst_ip is not null union select distinct t_us // 1000000, 'alert', null, null, null, 'firewall ' || rule_name from fw where rule_name is not null")
def src_controller(spark, sf_dir: str) -> DataFrame:
    """Polls of a controller in which every record comes twice."""
    f = firewall(spark, sf_dir)
    s = F.expr("t_us div 1000000").alias("timestamp")
    ips = F.to_json(F.struct(F.array(F.struct(s, "proto", F.col("src_ip").alias("srcip"), F.col("dst_ip").alias("dstip"), F.col("rule_name").alias("msg"))).alias("data")))
    alarm = F.to_json(F.struct(F.array(F.struct(s, F.concat(F.lit("firewall "), "rule_name").alias("alarm")), F.struct(s, F.lit("disk").alias("alarm"))).alias("data")))
    body = f.select(F.explode(F.array(ips, ips, alarm)).alias("body"))
    return parse_controller(body).select("s", "action", "proto", "src_ip", "dst_ip", "rule_name")


@R.query(f"with {HOSTS} select report_id, pos, ip, mac, vendor, hostname, coalesce(array_to_string(list_filter(ports, lambda x: x is not null), ','), '') as ports from hosts where ip is not null and status = 'up'")
def src_scan_xml(spark, sf_dir: str) -> DataFrame:
    """Scan documents made of the device reports, with closed ports and hosts that are down."""
    h = hosts(spark, sf_dir)
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    port = F.array_join(F.transform(F.filter(F.coalesce("ports", F.array().cast("array<int>")), lambda p: p.isNotNull()), lambda p: F.concat(F.lit('<port portid="'), p.cast("string"), F.lit('"><state state="open"/></port>'))), "")
    addr = lambda c, kind: F.when(F.col(c).isNotNull(), F.concat(F.lit('<address addr="'), F.lower(F.col(c)), F.lit(f'" addrtype="{kind}"'), F.lit(' vendor="') if kind == "mac" else F.lit(""), esc(F.col("vendor")) if kind == "mac" else F.lit(""), F.lit('"/>') if kind == "mac" else F.lit("/>"))).otherwise("")
    host = F.concat(F.lit('<host><status state="'), F.coalesce("status", F.lit("unknown")), F.lit('"/>'), addr("ip", "ipv4"), addr("mac", "mac"), F.lit('<hostnames><hostname name=""/><hostname name="'), esc(F.col("hostname")), F.lit('"/></hostnames><ports>'), port, F.lit('<port portid="9"><state state="closed"/></port></ports></host>'))
    docs = h.select("report_id", "pos", F.concat(F.lit("<nmaprun>"), host, F.lit("</nmaprun>")).alias("body"))
    x = parse_scan_xml(docs, "body", "report_id", "pos")
    known = h.select("report_id", "pos", F.col("vendor").alias("v"))
    return x.join(known, ["report_id", "pos"]).select("report_id", "pos", "ip", "mac", F.col("v").alias("vendor"), "hostname", F.array_join("ports", ",").alias("ports"))


@R.query("with s as (select sensor_id, os, arch, version from sensors) select sensor_id, os, arch, version from s")
def src_txt_records(spark, sf_dir: str) -> DataFrame:
    """Service records of sensors as ``k=v`` texts and back."""
    s = load(spark, sf_dir, "sensors").select("sensor_id", F.array(F.lit("os=old"), F.concat(F.lit("os="), "os"), F.concat(F.lit("arch="), "arch"), F.concat(F.lit("version="), "version"), F.lit("flag")).alias("f"))
    m = txt_fields(F.col("f"))
    return s.select("sensor_id", m["os"].alias("os"), m["arch"].alias("arch"), m["version"].alias("version"))


QUERIES, SQL = R.QUERIES, R.SQL
