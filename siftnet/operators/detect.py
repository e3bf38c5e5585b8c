"""Detections on single events and on the history of a key, and their composite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions import crypto
from siftnet.functions import domain as D
from siftnet.functions.net import ip_hex, is_private, private_hex, python_hex
from siftnet.operators.ordered import MOST_ROWS, in_chunks
from siftnet.plans.base import EV, Registry, deliveries, events, now_us, stored_rows
from siftnet.plans.fixtures import SAMPLE_PROVIDERS, SAMPLE_RESOLVERS
from siftnet.session import materialize
from siftnet.tables import load, pack_hex, unpack_hex

R = Registry()

# Addresses of public resolvers and names of encrypted-DNS providers.
PUBLIC_RESOLVERS = {
    "8.8.8.8": "Google", "8.8.4.4": "Google", "2001:4860:4860::8888": "Google", "2001:4860:4860::8844": "Google",
    "1.1.1.1": "Cloudflare", "1.0.0.1": "Cloudflare", "2606:4700:4700::1111": "Cloudflare", "2606:4700:4700::1001": "Cloudflare", "2606:4700:4700::64": "Cloudflare",
    "9.9.9.9": "Quad9", "149.112.112.112": "Quad9", "2620:fe::fe": "Quad9", "208.67.222.222": "OpenDNS", "208.67.220.220": "OpenDNS", "208.67.222.220": "OpenDNS",
    "45.90.28.0": "NextDNS", "45.90.30.0": "NextDNS", "94.140.14.14": "AdGuard", "94.140.15.15": "AdGuard", "2a10:50c0::ad1:ff": "AdGuard", "64.6.64.6": "Verisign", "64.6.65.6": "Verisign",
}
ENCRYPTED_DNS = {
    "dns.google": "Google", "dns.google.com": "Google", "cloudflare-dns.com": "Cloudflare", "1dot1dot1dot1.cloudflare-dns.com": "Cloudflare", "one.one.one.one": "Cloudflare",
    "dns.quad9.net": "Quad9", "doh.opendns.com": "OpenDNS", "dns.nextdns.io": "NextDNS", "dns.adguard.com": "AdGuard", "unfiltered.adguard.com": "AdGuard",
}


def rows(df: DataFrame, values: list[tuple], schema: str) -> DataFrame:
    """A small fixed table."""
    return df.sparkSession.createDataFrame(values, schema)


def sql_rows(values: list[tuple], columns: str) -> str:
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else "[" + ", ".join(lit(x) for x in v) + "]::varchar[]"
    return "(values " + ", ".join("(" + ", ".join(map(lit, v)) + ")" for v in values) + f") as t({columns})"


# --- names -------------------------------------------------------------------------------------------------------------------------------


@R.query(f"with {EV}, l as (select event_id, domain, {D.label_sql('domain')} as label from ev where domain is not null), s as (select *, {D.entropy_sql('label')} as h, {D.bigram_sql('label')} as b from l) select event_id, label, round(h, 6) as entropy, round(b, 6) as bigram, round(case when strlen(label) < 4 then 0 else 0.6::double * case when strlen(label) < 6 or h < 3.0 then 0 when h > 4.2 then 1 else (h - 3.0::double) / 1.2::double end + 0.4::double * b end, 6) as score from s")
def dga_scores(spark, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir, named=True).select("event_id", D.dga(F.col("domain")).alias("d"))
    return d.select("event_id", "d.label", F.round("d.entropy", 6).alias("entropy"), F.round("d.bigram", 6).alias("bigram"), F.round("d.score", 6).alias("score"))


@R.query(f"with {EV} select event_id, round({D.tunnel_sql('domain')}, 6) as score, round({D.tunnel_sql('domain')}, 6) >= 0.6 as is_tunnel from ev where domain is not null")
def tunnel_scores(spark, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir, named=True).select("event_id", F.round(D.tunnel(F.col("domain"))["score"], 6).alias("score"))
    return d.withColumn("is_tunnel", F.col("score") >= D.TUNNEL_THRESHOLD)


@R.query(f"with {EV}, s as (select unnest({D.tunnel_signals_sql('domain')}) as signal from ev where domain is not null) select signal, count(*) as n from s group by signal")
def tunnel_signals(spark, sf_dir: str) -> DataFrame:
    """How often each signal of a tunnel occurs."""
    d = events(spark, sf_dir, named=True).select(F.explode(D.tunnel(F.col("domain"))["signals"]).alias("signal"))
    return d.groupBy("signal").agg(F.count("*").alias("n"))


_REVERSED = r"regexp_extract(n, '^([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.in-addr\.arpa$', %d)"


@R.query(rf"""with {EV}, r as (select event_id, case when regexp_full_match(source_ip, '[0-9]+(\.[0-9]+){{3}}') then split_part(source_ip, '.', 4) || '.' || split_part(source_ip, '.', 3) || '.' || split_part(source_ip, '.', 2) || '.' || split_part(source_ip, '.', 1) || '.in-addr.arpa' else domain end as n from ev)
select event_id, n as name, coalesce({_REVERSED % 4} = '10' or ({_REVERSED % 4} = '172' and try_cast({_REVERSED % 3} as int) between 16 and 31) or ({_REVERSED % 4} = '192' and {_REVERSED % 3} = '168') or ({_REVERSED % 4} = '169' and {_REVERSED % 3} = '254'), false) as private from r where n is not null""")
def private_reverse(spark, sf_dir: str) -> DataFrame:
    """Reverse names of the sources, or else the names asked for, and which are private."""
    ip = F.split("source_ip", r"\.")
    name = F.when(F.col("source_ip").rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.concat_ws(".", F.reverse(ip), F.lit("in-addr.arpa"))).otherwise(F.col("domain"))
    return events(spark, sf_dir).select("event_id", name.alias("name")).where("name is not null").withColumn("private", D.is_private_reverse(F.col("name")))


@R.query(f"with {EV} select event_id, {crypto.hmac_sql('source_ip', 'siftnet-salt')} as source_hmac, sha256(source_ip) as ip_sha from ev where source_ip is not null")
def source_hmac(spark, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir, "source_ip is not null")
    return ev.select("event_id", crypto.hmac_sha256(F.col("source_ip"), "siftnet-salt").alias("source_hmac"), F.sha2("source_ip", 256).alias("ip_sha"))


@R.query(rf"""with {EV}, a as (select event_id, trim(resolved_ip) as ip from ev where resolved_ip is not null)
select event_id, case when regexp_full_match(ip, '[0-9]+(\.[0-9]+){{3}}') then regexp_matches(ip, '^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')
 when regexp_full_match(lower(ip), '::ffff:[0-9]+(\.[0-9]+){{3}}') then regexp_matches(ip[8:], '^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')
 when contains(ip, ':') then regexp_matches(lower(ip), '^f[cd]') else false end as private, regexp_matches(ip, '^[0-9]+\.[0-9]+\.[0-9]+\.(1|254)$') as gateway from a""")
def address_classes(spark, sf_dir: str) -> DataFrame:
    from siftnet.functions.net import is_gateway

    ev = events(spark, sf_dir, "resolved_ip is not null")
    return ev.select("event_id", is_private("resolved_ip").alias("private"), is_gateway(F.trim("resolved_ip")).alias("gateway"))


# --- beacons -----------------------------------------------------------------------------------------------------------------------------

WINDOW, LEAST_SAMPLES, CV_THRESHOLD = 32, 6, 0.15


def beacon_score(cv: Column) -> Column:
    return F.when(cv < 0.05, 1.0).when(cv < CV_THRESHOLD, 0.5 + 0.5 * (CV_THRESHOLD - cv) / (CV_THRESHOLD - 0.05)).when(cv < 0.30, 0.1 + 0.4 * (0.30 - cv) / (0.30 - CV_THRESHOLD)).otherwise(0.0)


def beacons(ev: DataFrame, chunk_us: int = 86_400_000_000, most: int = MOST_ROWS, counted: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """Adds ``samples``, ``mean_s``, ``cv`` and ``beacon`` of the last 32 events of a source and name, as of every event in the order of time and id.

    A key of more than ``most`` events is divided into chunks of time (``counted`` and
    ``at_most`` as for ``in_chunks``). Of each chunk the last 31 times go on: those
    of the up to 31 chunks before (each has one event at least) are all that a chunk's
    first events need beside their own.
    """
    key = ["source_hash", "domain", "__chunk"]
    e, some = in_chunks(ev, key[:2], "t_us", chunk_us, most, counted, at_most)
    both = e.withColumn("__own", F.lit(True))
    if some:
        newest = Window.partitionBy(*key).orderBy(F.desc("t_us"), F.desc("event_id"))
        tails = e.where("__chunk <> 0").select(*key, "t_us", F.row_number().over(newest).alias("__r")).where(f"__r < {WINDOW}").groupBy(*key).agg(F.sort_array(F.collect_list("t_us")).alias("ts"))
        before = F.flatten(F.collect_list("ts").over(Window.partitionBy(*key[:2]).orderBy("__chunk").rowsBetween(-(WINDOW - 1), -1)))
        halo = tails.select(*key, before.alias("ts")).select(*key, F.explode(F.slice("ts", F.greatest(F.size("ts") - (WINDOW - 2), F.lit(1)), WINDOW - 1)).alias("t_us"))
        both = both.unionByName(halo.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy("t_us", "__own", "event_id")
    both = both.withColumn("__gap", (F.col("t_us") - F.lag("t_us").over(w)) / 1e6)
    gaps = w.rowsBetween(-(WINDOW - 2), 0)
    both = both.withColumns({"samples": F.count("*").over(w.rowsBetween(-(WINDOW - 1), 0)), "mean_s": F.avg("__gap").over(gaps), "__sd": F.stddev_pop("__gap").over(gaps)}).where("__own")
    cv = F.when((F.col("samples") >= LEAST_SAMPLES) & (F.col("mean_s") >= 1.0), F.round(F.col("__sd") / F.col("mean_s"), 9))
    out = both.withColumn("cv", cv)
    return out.withColumn("beacon", F.when(F.col("cv").isNotNull(), beacon_score(F.col("cv"))).otherwise(0.0)).drop("__chunk", "__own", "__gap", "__sd")


_BEACON_SQL = f"""{EV}, g as (select event_id, source_hash, domain, t_us, (t_us - lag(t_us) over w) / 1e6::double as gap_s, row_number() over w as rn from ev where domain is not null and source_hash is not null window w as (partition by source_hash, domain order by t_us, event_id)),
 st as (select *, least(rn, 32) as samples, avg(gap_s) over v as mean_s, stddev_pop(gap_s) over v as sd_s from g window v as (partition by source_hash, domain order by t_us, event_id rows between 30 preceding and current row)),
 cvs as (select *, case when samples >= 6 and mean_s >= 1.0 then round(sd_s / mean_s, 9) end as cv from st)"""


@R.query(f"with {_BEACON_SQL} select event_id, samples, round(cv, 6) as cv, round(case when cv is null then 0 when cv < 0.05 then 1.0::double when cv < 0.15 then 0.5::double + 0.5::double * (0.15::double - cv) / (0.15::double - 0.05::double) when cv < 0.30 then 0.1::double + 0.4::double * (0.30::double - cv) / (0.30::double - 0.15::double) else 0 end, 5) as score from cvs where cv < 0.3 or samples < 6")
def beacon_scores(spark, sf_dir: str) -> DataFrame:
    slim = lambda e: e.select(pack_hex("event_id").alias("event_id"), pack_hex("source_hash").alias("source_hash"), "domain", "t_us")
    b = beacons(slim(events(spark, sf_dir, "source_hash is not null", named=True)), counted=slim(deliveries(spark, sf_dir, "source_hash is not null", named=True)), at_most=stored_rows(spark, sf_dir))
    return b.where("cv < 0.3 or samples < 6").select(unpack_hex("event_id").alias("event_id"), "samples", F.round("cv", 6).alias("cv"), F.round("beacon", 5).alias("score"))


# --- rebinding ---------------------------------------------------------------------------------------------------------------------------


def rebindings(ev: DataFrame) -> DataFrame:
    """For each name, its first answer that is private, if the answers before it were public: ``domain``, ``event_id``, ``private_ip``, ``public_ip``.

    ``ip_h``, if the events have it, is their answer as ``ip_hex`` gives it.
    Aggregates instead of ordered windows: a name of any size costs its partial sums.
    """
    private = private_hex(F.col("ip_h")) if "ip_h" in ev.columns else is_private("resolved_ip")
    a = ev.where("domain is not null and resolved_ip is not null").select("domain", "t_us", "event_id", F.col("resolved_ip").alias("ip"), private.alias("private"))
    first = a.where("private").groupBy("domain").agg(F.min(F.struct("t_us", "event_id", "ip")).alias("first"))
    before = a.where("not private").join(first, "domain").where(F.struct("t_us", "event_id") < F.struct("first.t_us", "first.event_id"))
    last = before.groupBy("domain").agg(F.max(F.struct("t_us", "event_id", "ip")).alias("last"), F.first("first").alias("first"))
    return last.select("domain", F.col("first.event_id").alias("event_id"), F.col("first.ip").alias("private_ip"), F.col("last.ip").alias("public_ip"))


_PRIVATE = r"""(case when regexp_full_match(trim(resolved_ip), '[0-9]+(\.[0-9]+){3}') then regexp_matches(trim(resolved_ip), '^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')
 when regexp_full_match(lower(trim(resolved_ip)), '::ffff:[0-9]+(\.[0-9]+){3}') then regexp_matches(trim(resolved_ip)[8:], '^(10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)')
 when contains(resolved_ip, ':') then regexp_matches(lower(trim(resolved_ip)), '^f[cd]') else false end)"""
_REBIND_SQL = EV + f""", a as (select domain, t_us, event_id, resolved_ip as ip, {_PRIVATE} as private from ev where domain is not null and resolved_ip is not null),
 b as (select *, last_value(case when not private then ip end ignore nulls) over (partition by domain order by t_us, event_id rows between unbounded preceding and 1 preceding) as public_ip,
   count(*) filter (private) over (partition by domain order by t_us, event_id rows between unbounded preceding and 1 preceding) as seen from a),
 rb as (select domain, event_id, ip as private_ip, public_ip from b where private and seen = 0 and public_ip is not null)"""


@R.query(f"with {_REBIND_SQL} select * from rb")
def rebinding_alerts(spark, sf_dir: str) -> DataFrame:
    return rebindings(events(spark, sf_dir, "resolved_ip is not null", named=True))


# --- bypass of the resolver --------------------------------------------------------------------------------------------------------------

def suffix_match(df: DataFrame, name: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Adds ``value`` of the longest entry of ``table`` that is the name or a parent of it: every distinct name with its parents, joined by equality."""
    names = df.where(F.col(name).isNotNull()).select(F.col(name).alias("__n")).distinct()
    up = names.select("__n", F.posexplode(D.parent_suffixes(F.col("__n"))).alias("__i", "__p")).join(table.select(F.col(key).alias("__p"), F.col(value).alias("__v")), "__p")
    best = up.groupBy("__n").agg(F.min(F.struct("__i", "__v"))["__v"].alias(value))
    return df.join(best, F.col(name) == F.col("__n"), "left").drop("__n")


@R.query(f"""with {EV}, p as (select * from {sql_rows([*ENCRYPTED_DNS.items(), *SAMPLE_PROVIDERS.items()], 'suffix, provider')}),
 m as (select e.event_id, p.provider, row_number() over (partition by e.event_id order by length(p.suffix) desc) as rn from ev e join p on e.domain = p.suffix or ends_with(e.domain, '.' || p.suffix))
 select event_id, provider from m where rn = 1""")
def bypass_names(spark, sf_dir: str) -> DataFrame:
    """Questions for names of encrypted-DNS providers."""
    ev = events(spark, sf_dir, named=True).select("event_id", "domain")
    return suffix_match(ev, "domain", rows(ev, [*ENCRYPTED_DNS.items(), *SAMPLE_PROVIDERS.items()], "suffix string, provider string"), "suffix", "provider").where("provider is not null").select("event_id", "provider")


@R.query(f"with {EV}, p as (select * from {sql_rows([(k, v) for k, v in PUBLIC_RESOLVERS.items() if ':' not in k] + [(k, 'Sample') for k in SAMPLE_RESOLVERS], 'ip, provider')}) select event_id, provider from ev join p on regexp_replace(lower(trim(resolved_ip)), '^::ffff:', '') = p.ip")
def bypass_resolvers(spark, sf_dir: str) -> DataFrame:
    """Answers that are addresses of public resolvers."""
    ev = events(spark, sf_dir, "resolved_ip is not null").select("event_id", ip_hex("resolved_ip").alias("h"))
    known = rows(ev, [*PUBLIC_RESOLVERS.items(), *((k, "Sample") for k in SAMPLE_RESOLVERS)], "ip string, provider string")
    return ev.join(known.select(ip_hex("ip").alias("h"), "provider"), "h").select("event_id", "provider")


# --- indicators --------------------------------------------------------------------------------------------------------------------------


def indicators(spark, sf_dir: str) -> DataFrame:
    """Indicators of three sources: addresses of the feed and names of events that were tagged as bad."""
    f = load(spark, sf_dir, "feodo_entries").where("ip_address is not null")
    ips = f.groupBy(F.lower(F.trim("ip_address")).alias("indicator")).agg(F.max("malware").alias("malware"), F.max(F.col("last_online").try_cast("date").cast("timestamp")).alias("seen"))
    ips = ips.select("indicator", F.lit("ipv4").alias("type"), F.lit("c2feed").alias("source"), F.lit(0.95).alias("confidence"), F.lit(72).alias("ttl_hours"), F.coalesce(F.unix_micros("seen"), F.lit(0)).alias("last_us"), F.coalesce(F.lower("malware"), F.lit("")).alias("family"))
    bad = events(spark, sf_dir, "array_contains(tags, 'known_bad')", named=True).groupBy("domain").agg(F.max("t_us").alias("last_us"), F.count("*").alias("n"))
    name = lambda source, conf, ttl, least: bad.where(F.col("n") >= least).select(F.col("domain").alias("indicator"), F.lit("domain").alias("type"), F.lit(source).alias("source"), F.lit(conf).alias("confidence"), F.lit(ttl).alias("ttl_hours"), "last_us", F.lit("").alias("family"))
    return ips.unionByName(name("listA", 0.85, 168, 1)).unionByName(name("listB", 0.9, 48, 3))


INDICATORS = """ind as (select lower(trim(ip_address)) as indicator, 'ipv4' as type, 'c2feed' as source, 0.95::double as confidence, 72 as ttl_hours, coalesce(epoch_us(max(try_cast(last_online as date))::timestamp), 0) as last_us, coalesce(lower(max(malware)), '') as family from feodo_entries where ip_address is not null group by 1
 union all select domain, 'domain', 'listA', 0.85::double, 168, max(t_us), '' from ev where domain is not null and list_contains(tags, 'known_bad') group by domain
 union all select domain, 'domain', 'listB', 0.9::double, 48, max(t_us), '' from ev where domain is not null and list_contains(tags, 'known_bad') group by domain having count(*) >= 3)"""


def best_indicator(ind: DataFrame) -> DataFrame:
    """The most confident entry of each indicator, of equals the source that sorts first."""
    return ind.groupBy("indicator").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source", "confidence", "ttl_hours", "last_us", "type", "family")).alias("b")).select("indicator", "b.source", "b.confidence", "b.ttl_hours", "b.last_us", "b.type", "b.family")


def effective(confidence: Column, last_us: Column, ttl_hours: Column, as_of: int) -> Column:
    """Confidence halves once an indicator is older than its time to live."""
    return F.when(F.lit(as_of) - last_us > ttl_hours.cast("bigint") * 3_600_000_000, confidence * 0.5).otherwise(confidence)


@R.query(f"with {EV}, {INDICATORS}, r as (select *, row_number() over (partition by indicator order by confidence desc, source) as rn from ind) select indicator, source, confidence, ttl_hours from r where rn = 1")
def intel_best(spark, sf_dir: str) -> DataFrame:
    return best_indicator(indicators(spark, sf_dir)).select("indicator", "source", "confidence", "ttl_hours")


@R.query(f"with {EV}, {INDICATORS} select source, count(*) as n from ind group by source")
def intel_per_source(spark, sf_dir: str) -> DataFrame:
    return indicators(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


_INTEL_SQL = f"""{EV}, {INDICATORS}, best as (select * from (select *, row_number() over (partition by indicator order by confidence desc, source) as rn from ind) where rn = 1),
 m as (select max(t_us) as as_of from ev),
 eff as (select indicator, source, case when m.as_of - last_us > ttl_hours * 3600000000::bigint then confidence * 0.5::double else confidence end as confidence from best, m)"""


@R.query(f"with {_INTEL_SQL} select e.event_id, d.source as domain_source, round(d.confidence, 6) as domain_confidence, i.source as ip_source, round(i.confidence, 6) as ip_confidence from ev e left join eff d on e.domain = d.indicator left join eff i on lower(trim(e.resolved_ip)) = i.indicator where d.source is not null or i.source is not null")
def intel_join(spark, sf_dir: str) -> DataFrame:
    """Events whose name or answer is an indicator. The indicators are gathered and written once; an event without either key is no candidate for any join."""
    best = materialize(best_indicator(indicators(spark, sf_dir)).withColumn("c", effective(F.col("confidence"), F.col("last_us"), F.col("ttl_hours"), now_us(spark, sf_dir))), "indicators")
    ev = events(spark, sf_dir, "domain is not null or resolved_ip is not null").select("event_id", "domain", F.lower(F.trim("resolved_ip")).alias("ip"))
    side = lambda key, p: best.select(F.col("indicator").alias(key), F.col("source").alias(f"{p}_source"), F.round("c", 6).alias(f"{p}_confidence"))
    return ev.join(side("domain", "domain"), "domain", "left").join(side("ip", "ip"), "ip", "left").where("domain_source is not null or ip_source is not null").select("event_id", "domain_source", "domain_confidence", "ip_source", "ip_confidence")


# --- composite ---------------------------------------------------------------------------------------------------------------------------


def composite(scores: Column, old: Column) -> Column:
    """The greatest score, and 0.05 for each further one above 0.3; never below ``old``."""
    s = F.array_compact(scores)
    boost = 0.05 * F.greatest(F.size(F.filter(s, lambda x: x > 0.3)) - 1, F.lit(0))
    return let_size(s, F.greatest(old, F.least(F.lit(1.0), F.array_max(s) + boost)), old)


def let_size(s: Column, some: Column, none: Column) -> Column:
    return F.when(F.size(s) > 0, some).otherwise(none)


def enrich(ev: DataFrame, ind: DataFrame, as_of: int, providers: list[tuple[str, str]] | None = None) -> DataFrame:
    """All detections of every event, joined to one score, tags, a description and metadata: ``event_id``, ``score``, ``new_tags``, ``description``, ``detections``.
    Events without a column ``tags`` have none before.

    The events are written once, each address in its canonical form. What depends on
    the name alone (its scores, indicator, provider and rebinding) is found once per
    distinct name and joined by name; events without a name take no part in that.
    """
    d = F.col("domain")
    e = materialize(ev.select(pack_hex("event_id").alias("event_id"), "t_us", pack_hex("source_hash").alias("source_hash"), "domain", "resolved_ip", ip_hex("resolved_ip").alias("ip_h"), "query_type", "anomaly_score", (F.col("tags") if "tags" in ev.columns else F.lit(None).cast("array<string>")).alias("tags")), "events")
    best = materialize(best_indicator(ind).withColumn("c", effective(F.col("confidence"), F.col("last_us"), F.col("ttl_hours"), as_of)), "indicators")
    names = e.where(d.isNotNull()).select("domain").distinct().withColumn("named", ~D.is_private_reverse(d))
    names = names.withColumns({"dga": F.when(F.col("named"), D.dga(d)), "tun": F.when(F.col("named"), D.tunnel(d))})
    names = suffix_match(names, "domain", rows(ev, providers or list(ENCRYPTED_DNS.items()), "suffix string, provider string"), "suffix", "provider")
    names = names.join(best.select(F.col("indicator").alias("domain"), F.col("c").alias("d_conf"), F.col("source").alias("d_source"), F.col("family").alias("d_family")), "domain", "left")
    names = names.join(rebindings(e).select("domain", F.col("event_id").alias("reb_id"), "private_ip", "public_ip"), "domain", "left")
    # the answers that are indicators are few and written once; the planner joins them by their measured size
    answer = F.lower(F.trim("resolved_ip"))
    bad = materialize(e.where("resolved_ip is not null").select(answer.alias("__ip")).distinct().join(best.select(F.col("indicator").alias("__ip"), F.col("c").alias("i_conf")), "__ip"), "answers")
    e = e.join(bad, answer == F.col("__ip"), "left").drop("__ip")
    e = e.withColumn("resolver", F.create_map(*(F.lit(x) for k, v in PUBLIC_RESOLVERS.items() for x in (python_hex(k), v)))[F.col("ip_h")]).drop("resolved_ip", "ip_h")
    timed = beacons(e.where("domain is not null and source_hash is not null"), at_most=e.count()).unionByName(e.where("domain is not null and source_hash is null"), allowMissingColumns=True)
    e = timed.join(names, "domain").unionByName(e.where(d.isNull()), allowMissingColumns=True)
    lone = F.col("reb_id") == F.col("event_id")
    e = e.withColumns({c: F.when(lone, F.col(c)) for c in ("private_ip", "public_ip")} | {c: F.when(F.col("named") & (F.col("beacon") > 0), F.col(c)) for c in ("beacon", "cv", "mean_s", "samples")})
    above = lambda c: F.when(c > 0.3, c)
    txt = F.when(F.upper("query_type").isin("TXT", "NULL") & (F.col("tun.score") > 0.2), 0.3)
    bypass = F.when(F.col("resolver").isNotNull() & d.isNotNull(), 0.6).when(F.col("provider").isNotNull(), 0.5)
    scores = F.array(above(F.col("dga.score")), above(F.col("tun.score")), txt, above(F.col("beacon")), F.when(F.col("public_ip").isNotNull(), 0.4), bypass, F.col("d_conf"))
    is_dga, is_tunnel, is_beacon = F.col("dga.score") >= D.DGA_THRESHOLD, F.round("tun.score", 9) >= D.TUNNEL_THRESHOLD, F.col("cv") < CV_THRESHOLD
    tag = lambda c, name: F.when(c, F.lit(name))
    tags = F.array_compact(F.array(tag(is_dga, "dga_candidate"), tag(is_tunnel, "dns_tunnel"), tag(is_beacon, "beaconing"), tag(F.col("public_ip").isNotNull(), "dns_rebinding"), tag(bypass.isNotNull(), "dns_bypass"), tag(F.col("d_conf").isNotNull() | F.col("i_conf").isNotNull(), "known_bad")))
    said = F.concat_ws(" ",
        F.when(is_dga, F.format_string("Label %s looks machine-made (%.1f bits).", F.col("dga.label"), F.col("dga.entropy"))),
        F.when(is_tunnel, F.concat(F.lit("Name may carry data: "), F.array_join("tun.signals", ", "), F.lit("."))),
        F.when(is_beacon, F.format_string("Asked for every %.0f s.", F.col("mean_s"))),
        F.when(F.col("public_ip").isNotNull(), F.concat(F.lit("Answer went from "), F.col("public_ip"), F.lit(" to "), F.col("private_ip"), F.lit("."))),
        F.when(bypass.isNotNull(), F.concat(F.lit("Goes around the resolver to "), F.coalesce("resolver", "provider"), F.lit("."))),
        F.when(F.col("d_conf").isNotNull(), F.format_string("On list %s.", F.col("d_source"))),
    )
    meta = F.to_json(F.struct(
        F.when(is_dga, F.struct("dga.label", F.round("dga.score", 4).alias("score"))).alias("dga"), F.when(is_tunnel, F.struct(F.round("tun.score", 4).alias("score"), "tun.signals")).alias("tunnel"),
        F.when(is_beacon, F.struct(F.round("beacon", 4).alias("score"), "samples")).alias("beacon"), F.when(F.col("public_ip").isNotNull(), F.struct("public_ip", "private_ip")).alias("rebinding"),
        F.when(bypass.isNotNull(), F.struct(F.coalesce("resolver", "provider").alias("provider"))).alias("bypass"), F.when(F.col("d_conf").isNotNull(), F.struct(F.col("d_source").alias("source"))).alias("threat_db"),
    ))
    total = composite(scores, F.col("anomaly_score"))
    total = F.greatest(total, F.coalesce("i_conf", F.lit(0.0)))
    return e.select(unpack_hex("event_id").alias("event_id"), *(c.alias(k) for k, c in {"score": total, "new_tags": F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), tags)), "description": F.nullif(said, F.lit("")), "detections": F.nullif(meta, F.lit("{}"))}.items()))


def _composite_sql() -> str:
    lab, ent, big = D.label_sql("domain"), D.entropy_sql("label"), D.bigram_sql("label")
    rows_res = sql_rows([(k, v) for k, v in PUBLIC_RESOLVERS.items() if ":" not in k], "ip, provider")
    rows_enc = sql_rows([*ENCRYPTED_DNS.items(), *SAMPLE_PROVIDERS.items()], "suffix, provider")
    return f"""with {_INTEL_SQL}, {_REBIND_SQL[len(EV) + 2:]}, {_BEACON_SQL[len(EV) + 2:]},
 bs as (select event_id, case when cv < 0.05 then 1.0::double when cv < 0.15 then 0.5::double + 0.5::double * (0.15::double - cv) / (0.15::double - 0.05::double) when cv < 0.30 then 0.1::double + 0.4::double * (0.30::double - cv) / (0.30::double - 0.15::double) else 0 end as beacon from cvs where cv < 0.3),
 l as (select event_id, case when domain is null then null else {lab} end as label, case when domain is null then null else {D.tunnel_sql('domain')} end as tun from ev),
 h as (select *, case when label is null then null else {ent} end as h, case when label is null then null else {big} end as b from l),
 dg as (select *, case when label is null then null when strlen(label) < 4 then 0 else 0.6::double * case when strlen(label) < 6 or h < 3.0 then 0 when h > 4.2 then 1 else (h - 3.0::double) / 1.2::double end + 0.4::double * b end as dga from h),
 res as (select * from {rows_res}), enc as (select * from {rows_enc}),
 hit as (select distinct e.event_id from ev e join enc on e.domain = enc.suffix or ends_with(e.domain, '.' || enc.suffix)),
 s as (select e.event_id, e.anomaly_score, i.confidence as i_conf, list_filter([case when dg.dga > 0.3 then dg.dga end, case when dg.tun > 0.3 then dg.tun end, case when upper(e.query_type) in ('TXT', 'NULL') and dg.tun > 0.2 then 0.3::double end,
   case when bs.beacon > 0.3 then bs.beacon end, case when rb.event_id is not null then 0.4::double end, case when res.ip is not null and e.domain is not null then 0.6::double when hit.event_id is not null then 0.5::double end, d.confidence], lambda x: x is not null) as xs
  from ev e left join dg using (event_id) left join bs using (event_id) left join rb using (event_id) left join res on trim(e.resolved_ip) = res.ip left join hit using (event_id) left join eff d on e.domain = d.indicator left join eff i on lower(trim(e.resolved_ip)) = i.indicator)
 select event_id, round(greatest(case when len(xs) > 0 then greatest(anomaly_score, least(1.0::double, list_max(xs) + 0.05::double * greatest(len(list_filter(xs, lambda x: x > 0.3)) - 1, 0))) else anomaly_score end, coalesce(i_conf, 0)), 5) as score from s"""


@R.query(_composite_sql())
def composite_enrich(spark, sf_dir: str) -> DataFrame:
    """The composite score of every event."""
    e = enrich(events(spark, sf_dir).drop("tags"), indicators(spark, sf_dir), now_us(spark, sf_dir), [*ENCRYPTED_DNS.items(), *SAMPLE_PROVIDERS.items()])
    return e.select("event_id", F.round("score", 5).alias("score"))


@R.query()
def enriched_events(spark, sf_dir: str) -> DataFrame:
    """Every event with its score, tags, description and metadata."""
    return enrich(events(spark, sf_dir), indicators(spark, sf_dir), now_us(spark, sf_dir)).select("event_id", "score", F.array_join("new_tags", ";").alias("tags"), "description", "detections")


QUERIES, SQL = R.QUERIES, R.SQL
