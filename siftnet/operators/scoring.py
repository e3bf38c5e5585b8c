"""Later designs of scores: names by four parts, names and question mix for tunnels, devices by five signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions import domain as D
from siftnet.operators.detect import _BEACON_SQL, _INTEL_SQL, beacons, best_indicator, effective, indicators, rows, sql_rows
from siftnet.operators.devices import INVENTORY, inventory
from siftnet.plans.base import EV, HOSTS, Registry, deliveries, events, hosts, now_us, stored_rows
from siftnet.plans.fixtures import HOSTNAME_RULES, OPTION_LISTS, SERVICES, VENDOR_PREFIXES
from siftnet.session import materialize
from siftnet.tables import pack_hex

R = Registry()

# Our own small tables, to be replaced by fuller ones.
WORDS = "api app auth cdn cloud data edge image img log logs mail media net ntp page push server static store sync time update web ads".split()
TLD_RISK = {"test": 0.2, "invalid": 0.9, "example": 0.1, "xyz": 0.8, "top": 0.8, "tk": 0.9}


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def word_ratio(s: Column, words: list[str]) -> Column:
    """The share of a text that words cover, read from the left, the longest word first."""
    pattern = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    found = F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.length(s) == 0, 0.0).otherwise(F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)) / F.length(s))


def tld_risk(domain: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in TLD_RISK.items() for x in kv))[F.substring_index(domain, ".", -1)], F.lit(0.3))


def dga_v2(domain: Column) -> Column:
    label = D.effective_label(domain)
    return 0.30 * clamp((D.entropy(label) - 2.5) / 2) + 0.30 * D.bigram_score(label) + 0.25 * (1 - word_ratio(label, WORDS)) + 0.15 * tld_risk(domain)


_PATTERN = "|".join(sorted(WORDS, key=lambda w: (-len(w), w)))
_RISK = "case string_split(domain, '.')[-1] " + " ".join(f"when '{k}' then {v}::double" for k, v in TLD_RISK.items()) + " else 0.3::double end"


@R.query(f"""with {EV}, l as (select domain, {D.label_sql('domain')} as label from (select distinct domain from ev where domain is not null))
 select domain, round(0.30::double * least(1, greatest(0, ({D.entropy_sql('label')} - 2.5::double) / 2)) + 0.30::double * {D.bigram_sql('label')} + 0.25::double * (1 - case when length(label) = 0 then 0 else coalesce(list_sum(list_transform(regexp_extract_all(label, '{_PATTERN}'), lambda w: length(w))), 0) / length(label) end) + 0.15::double * {_RISK}, 5) as score from l""")
def dga_scores_v2(spark, sf_dir: str) -> DataFrame:
    """Scores of distinct names by entropy, pairs, words and suffix."""
    d = events(spark, sf_dir, named=True).select("domain").distinct()
    return d.select("domain", F.round(dga_v2(F.col("domain")), 5).alias("score"))


@R.query(f"""with {EV}, e as (select domain, array_to_string(string_split(domain, '.')[-2:], '.') as parent, upper(query_type) as q from ev where domain is not null),
 p as (select parent, count(distinct domain) as names, count(*) as n, count(*) filter (q in ('TXT', 'NULL', 'ANY')) as odd from e group by parent), t as (select distinct e.domain, e.parent, {D.tunnel_sql('e.domain')} as s from e)
 select t.domain, round(least(1, 0.5::double * s + 0.25::double * least(1, names / 50.0::double) + 0.25::double * odd / n), 5) as score from t join p using (parent)""")
def tunnel_scores_v2(spark, sf_dir: str) -> DataFrame:
    """Scores of distinct names that also weigh how many names their parent has, and its question types."""
    e = events(spark, sf_dir, named=True).select("domain", F.array_join(F.slice(F.split("domain", r"\."), -2, 2), ".").alias("parent"), F.upper("query_type").alias("q"))
    p = e.groupBy("parent").agg(F.countDistinct("domain").alias("names"), F.count("*").alias("n"), F.count_if(F.col("q").isin("TXT", "NULL", "ANY")).alias("odd"))
    t = e.select("domain", "parent").distinct().join(p, "parent")
    return t.select("domain", F.round(clamp(0.5 * D.tunnel(F.col("domain"))["score"] + 0.25 * F.least(F.lit(1.0), F.col("names") / 50.0) + 0.25 * F.col("odd") / F.col("n")), 5).alias("score"))


# What the names of known tunnel tools look like, the first that matches.
TOOLS = [("iodine", r"^[a-v0-9]{20,}\.[a-v0-9]*\.", 0.95), ("dnscat2", r"^[0-9a-f]{16,}\.[0-9a-f]*\.", 0.95), ("dns2tcp", r"^[A-Za-z0-9+/]{30,}={0,2}\.", 0.90)]
WINDOW_MINUTES = 60


def signature(domain: Column, of: int) -> Column:
    """The tool (0) or score (2) of the first signature that a name matches."""
    c = F.lit(None)
    for tool in reversed(TOOLS):
        c = F.when(domain.rlike(tool[1]), tool[of]).otherwise(c)
    return c


def tunnel_six(ev: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Scores of distinct names: the greatest of their windows, of six signals (length, entropy and labels of the sub-domain, question types and new names a minute of the parent, encoding) and a boost for NULL and ANY; and the signatures of tools."""
    q, step = F.upper("query_type"), minutes * 60_000_000
    k = ev.where("domain is not null").groupBy("domain", (F.col("t_us") - F.pmod("t_us", F.lit(step))).alias("w_us")).agg(F.count("*").alias("n"), F.count_if(q.isin("TXT", "NULL", "ANY")).alias("odd"), F.max(F.when(q.isin("NULL", "ANY"), 0.3).otherwise(0.0)).alias("boost"))
    k = k.withColumn("parent", F.array_join(F.slice(F.split("domain", r"\."), -2, 2), "."))
    w = k.groupBy("parent", "w_us").agg(F.count("*").alias("names"), (F.sum("odd") / F.sum("n")).alias("types"))
    x = k.join(w, ["parent", "w_us"]).groupBy("domain").agg(F.max(0.20 * F.col("types") + 0.20 * clamp(F.col("names") / (minutes * 5.0)) + F.col("boost")).alias("traffic"))
    p = F.split("domain", r"\.")
    x = x.withColumn("labels", F.greatest(F.size(p) - 2, F.lit(0))).withColumn("sub", F.array_join(F.slice(p, F.lit(1), F.col("labels")), ".")).withColumn("size", F.octet_length("sub"))
    # the characters of base64 include those of base32 and hexadecimal, so that its share is the greatest
    encoding = F.when(F.col("size") < 10, 0.0).otherwise(F.regexp_count("sub", F.lit("[A-Za-z0-9_=-]")) / F.col("size") * clamp(F.col("size") / 50.0))
    score = 0.20 * clamp(F.col("size") / 100.0) + 0.15 * clamp((D.entropy(F.col("sub")) - 2.5) / 2) + 0.05 * clamp(F.col("labels") / 6.0) + F.col("traffic") + 0.20 * encoding
    return x.select("domain", F.round(clamp(score), 7).alias("score"), signature(F.col("domain"), 0).alias("tool"), signature(F.col("domain"), 2).alias("tool_score"))


def _signature_sql(of: int) -> str:
    return "case " + " ".join(f"when regexp_matches(domain, '{t[1]}') then {f'{t[of]}::double' if of else repr(t[of])}" for t in TOOLS) + " end"


@R.query(f"""with {EV}, k as (select domain, array_to_string(string_split(domain, '.')[-2:], '.') as parent, t_us - t_us % 3600000000 as w_us, count(*) as n, count(*) filter (upper(query_type) in ('TXT', 'NULL', 'ANY')) as odd, max(case when upper(query_type) in ('NULL', 'ANY') then 0.3::double else 0 end) as boost from ev where domain is not null group by 1, 2, 3),
 w as (select parent, w_us, count(*) as names, sum(odd) / sum(n) as types from k group by parent, w_us), x as (select domain, max(0.20::double * types + 0.20::double * least(1, names / 300.0::double) + boost) as traffic from k join w using (parent, w_us) group by domain),
 s as (select domain, traffic, greatest(len(string_split(domain, '.')) - 2, 0) as labels, array_to_string(string_split(domain, '.')[1:greatest(len(string_split(domain, '.')) - 2, 0)], '.') as sub from x)
 select domain, round(least(1, 0.20::double * least(1, strlen(sub) / 100.0::double) + 0.15::double * least(1, greatest(0, ({D.entropy_sql('sub')} - 2.5::double) / 2)) + 0.05::double * least(1, labels / 6.0::double) + traffic
  + 0.20::double * case when strlen(sub) < 10 then 0 else length(regexp_replace(sub, '[^A-Za-z0-9_=-]', '', 'g')) / strlen(sub) * least(1, strlen(sub) / 50.0::double) end), 7) as score, {_signature_sql(0)} as tool, {_signature_sql(2)} as tool_score from s""")
def tunnel_composite(spark, sf_dir: str) -> DataFrame:
    """The six signals in hourly windows, with signatures, as surveyed (SCA-28)."""
    return tunnel_six(events(spark, sf_dir))


# Risks of suffixes as designed; all others have 0.05.
DESIGN_RISK = {
    "tk": 0.95, "ga": 0.95, "cf": 0.95, "ml": 0.95, "gq": 0.95, "xyz": 0.80, "top": 0.80, "club": 0.75, "work": 0.75, "buzz": 0.80, "surf": 0.80, "icu": 0.80, "pw": 0.85, "ws": 0.70,
    "info": 0.55, "biz": 0.55, "online": 0.55, "site": 0.55, "live": 0.50, "click": 0.60, "link": 0.55, "space": 0.50, "cc": 0.30, "co": 0.25, "me": 0.20, "io": 0.15, "ru": 0.35, "cn": 0.35,
}
PAIR_FLOOR = 1e-10


def pair_frequencies(labels: DataFrame, label: str) -> dict[str, float]:
    """How often each pair of letters, digits and hyphens occurs in a corpus of labels, as a share of all; at most 37 x 37 numbers."""
    pairs = labels.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(label) - 1), lambda i: F.substring(F.col(label), i, F.lit(2)))).alias("p"))
    got = pairs.where("length(p) = 2").where(F.col("p").rlike("^[a-z0-9-]{2}$")).groupBy("p").agg(F.count("*").alias("n")).collect()
    total = sum(r.n for r in got)
    return {r.p: r.n / total for r in got}


def design_parts(label: Column, suffix: Column, frequencies: dict[str, float], words: list[str]) -> dict[str, Column]:
    """The four parts of the designed score of a label: entropy, pairs (the geometric mean of their frequencies), words (what they don't cover) and suffix."""
    table = F.create_map(*(F.lit(x) for kv in frequencies.items() for x in kv)) if frequencies else F.create_map().cast("map<string,double>")

    def pairs(s: Column) -> Column:
        p = F.filter(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))), lambda x: x.rlike("^[a-z0-9-]{2}$"))
        logs = F.transform(p, lambda x: F.log10(F.greatest(F.coalesce(table[x], F.lit(0.0)), F.lit(PAIR_FLOOR))))
        return F.when(F.size(logs) == 0, 1.0).otherwise(clamp(1 - (F.aggregate(F.array_sort(logs), F.lit(0.0), lambda a, x: a + x) / F.size(logs) + 4) / 2.5))

    short = F.length(label) < 3
    risk = F.coalesce(F.create_map(*(F.lit(x) for kv in DESIGN_RISK.items() for x in kv))[suffix], F.lit(0.05))
    return {"entropy": clamp((D.entropy(label) - 2.5) / 2), "pairs": F.when(short, 0.0).otherwise(pairs(label)), "words": F.when(short, 0.5).otherwise(1 - word_ratio(label, words)), "suffix": risk}


@R.query(f"""with {EV}, n as (select domain, count(*) as c from ev where domain is not null group by domain), l as (select domain, c, {D.label_sql('domain')} as label from n), top as (select label from l order by c desc, domain limit 1000),
 pr as (select substring(label, i, 2) as p from (select label, unnest(range(1, length(label))) as i from top) x), fr as (select p, count(*) / sum(count(*)) over () as f from pr where regexp_full_match(p, '[a-z0-9-]{{2}}') group by p),
 lp as (select label, substring(label, i, 2) as p from (select label, unnest(range(1, length(label))) as i from (select distinct label from l)) x), g as (select label, avg(log10(greatest(coalesce(f, 0), 1e-10))) as m from lp left join fr using (p) where regexp_full_match(p, '[a-z0-9-]{{2}}') group by label),
 s as (select domain, label, least(1, greatest(0, ({D.entropy_sql('label')} - 2.5::double) / 2)) as e, case when length(label) < 3 then 0 when m is null then 1 else least(1, greatest(0, 1 - (m + 4) / 2.5::double)) end as b,
  case when length(label) < 3 then 0.5::double else 1 - coalesce(list_sum(list_transform(regexp_extract_all(label, '{_PATTERN}'), lambda w: length(w))), 0) / length(label) end as w, case string_split(domain, '.')[-1] {" ".join(f"when '{k}' then {v}::double" for k, v in DESIGN_RISK.items())} else 0.05::double end as t from l left join g using (label))
 select domain, round(least(1, 0.30::double * e + 0.30::double * b + 0.25::double * w + 0.15::double * t), 7) as score from s""")
def dga_design(spark, sf_dir: str) -> DataFrame:
    """Scores of distinct names as designed (SCA-26); the reference frequencies are those of the 1000 most frequent names, the words a small list."""
    n = events(spark, sf_dir, named=True).groupBy("domain").agg(F.count("*").alias("c")).withColumn("label", D.effective_label(F.col("domain")))
    n = materialize(n, "names")
    freq = pair_frequencies(n.orderBy(F.desc("c"), "domain").limit(1000), "label")
    p = design_parts(F.col("label"), F.substring_index("domain", ".", -1), freq, WORDS)
    return n.select("domain", F.round(clamp(0.30 * p["entropy"] + 0.30 * p["pairs"] + 0.25 * p["words"] + 0.15 * p["suffix"]), 7).alias("score"))


SIGNALS = (("dga", "dga_candidate"), ("beacon", "beaconing"), ("tunnel", "dns_tunnel"), ("reputation", "known_bad"))
LEVELS = ((0.85, "critical"), (0.70, "high"), (0.50, "warning"), (0.30, "info"))


def threat(scores: dict[str, Column]) -> Column:
    """Struct of the composite as designed: the greatest of four signals, and 0.10 for each further one above 0.3; with the primary signal, the tags and the level."""
    of = {k: F.coalesce(scores[k], F.lit(0.0)) for k, _ in SIGNALS}
    top = F.greatest(*of.values())
    strong = sum((F.when(c > 0.3, 1).otherwise(0) for c in of.values()), F.lit(0))
    total = clamp(top + 0.10 * F.greatest(strong - 1, F.lit(0)))
    primary, level = F.lit(None).cast("string"), F.lit("none")
    for k, _ in reversed(SIGNALS):
        primary = F.when((of[k] == top) & (top > 0), k).otherwise(primary)
    for least, name in reversed(LEVELS):
        level = F.when(F.round(total, 9) >= least, name).otherwise(level)
    return F.struct(total.alias("score"), primary.alias("primary"), F.array_compact(F.array(*(F.when(of[k] > 0.3, tag) for k, tag in SIGNALS))).alias("tags"), level.alias("level"))


@R.query(f"""with {_INTEL_SQL}, {_BEACON_SQL[len(EV) + 2:]}, b as (select domain, max(case when cv < 0.05 then 1.0::double when cv < 0.15 then 0.5::double + 0.5::double * (0.15::double - cv) / (0.15::double - 0.05::double) when cv < 0.30 then 0.1::double + 0.4::double * (0.30::double - cv) / (0.30::double - 0.15::double) else 0 end) as beacon from cvs group by domain),
 l as (select domain, {D.label_sql('domain')} as label, {D.tunnel_sql('domain')} as tun from (select distinct domain from ev where domain is not null)),
 h as (select *, {D.entropy_sql('label')} as h, {D.bigram_sql('label')} as bg from l), d as (select domain, tun, case when strlen(label) < 4 then 0 else 0.6::double * case when strlen(label) < 6 or h < 3.0 then 0 when h > 4.2 then 1 else (h - 3.0::double) / 1.2::double end + 0.4::double * bg end as dga from h),
 x as (select d.domain, [d.dga, coalesce(b.beacon, 0), d.tun, coalesce(e.confidence, 0)] as xs from d left join b using (domain) left join eff e on d.domain = e.indicator)
 select domain, round(least(1, list_max(xs) + 0.10::double * greatest(len(list_filter(xs, lambda v: v > 0.3)) - 1, 0)), 5) as score from x""")
def composite_design(spark, sf_dir: str) -> DataFrame:
    """The composite of distinct names as designed (SCA-29), of machine-made labels, tunnels, indicators and the greatest beacon of any source."""
    slim = lambda e: e.select(pack_hex("event_id").alias("event_id"), pack_hex("source_hash").alias("source_hash"), "domain", "t_us")
    b = beacons(slim(events(spark, sf_dir, "source_hash is not null", named=True)), counted=slim(deliveries(spark, sf_dir, "source_hash is not null", named=True)), at_most=stored_rows(spark, sf_dir))
    b = b.groupBy("domain").agg(F.max("beacon").alias("beacon"))
    best = best_indicator(indicators(spark, sf_dir)).select(F.col("indicator").alias("domain"), effective(F.col("confidence"), F.col("last_us"), F.col("ttl_hours"), now_us(spark, sf_dir)).alias("reputation"))
    n = deliveries(spark, sf_dir, named=True).select("domain").distinct().join(b, "domain", "left").join(best, "domain", "left")
    t = threat({"dga": D.dga(F.col("domain"))["score"], "beacon": F.col("beacon"), "tunnel": D.tunnel(F.col("domain"))["score"], "reputation": F.col("reputation")})
    return n.select("domain", F.round(t["score"], 5).alias("score"))


_SERV = sql_rows(SERVICES, "port, s_type")
_OPTS = sql_rows(OPTION_LISTS, "opts, o_type, o_conf")
_RULES = sql_rows(HOSTNAME_RULES, "ord, pattern, h_type, h_conf")
_OUI = sql_rows(VENDOR_PREFIXES, "prefix, oui_vendor")


@R.query(f"""with {HOSTS}, {INVENTORY}, pr as (select device, list_sort(list_distinct(list_filter(coalesce(arg_max(coalesce(ports, []), (t_us, report_id, pos)), []), lambda x: x is not null))) as ports from k group by device),
 h as (select device, arg_min(h_type, ord) as h_type, max(h_conf)::double as h_conf from inv join {_RULES} on regexp_matches(hostname, pattern, 'i') group by device),
 o as (select device, o_type, o_conf::double as o_conf from pr join {_OPTS} on array_to_string(ports, ',') = opts),
 s as (select device, count(*) as hits, max(s_type) as s_type from (select device, unnest(ports) as port from pr) x join {_SERV} on x.port = t.port group by device),
 u as (select device from inv join {_OUI} on inv.mac[:4] = prefix)
 select inv.device, coalesce(s_type, o_type, h_type) as device_type, round(least(1, greatest(case when u.device is not null then 0.2 else 0 end, coalesce(h_conf, 0), coalesce(o_conf, 0)) + case when vendor is not null then 0.1 else 0 end + 0.15::double * coalesce(hits, 0)), 6) as confidence,
  concat_ws(',', case when u.device is not null then 'oui' end, case when h_type is not null then 'hostname' end, case when o_type is not null then 'options' end, case when vendor is not null then 'vendor' end, case when s_type is not null then 'services' end) as signals
 from inv left join h using (device) left join o using (device) left join s using (device) left join u using (device)""")
def device_match(spark, sf_dir: str) -> DataFrame:
    """Devices by five signals; sorted lists of open ports stand for option lists, ports for services, the reported vendor for the vendor class."""
    ports = F.array_sort(F.array_distinct(F.filter(F.coalesce("ports", F.array().cast("array<int>")), lambda x: x.isNotNull())))
    inv = inventory(hosts(spark, sf_dir)).withColumn("ports", ports)
    dev = inv.select("device", "mac", "hostname", F.array_join("ports", ",").alias("options"), F.col("vendor").alias("vendor_class"), F.col("ports").cast("array<string>").alias("services"))
    table = lambda values, schema: rows(inv, values, schema)
    services = table(SERVICES, "service int, s_type string").withColumn("service", F.col("service").cast("string"))
    return five_signals(dev, table(VENDOR_PREFIXES, "prefix string, oui_vendor string"), HOSTNAME_RULES, table(OPTION_LISTS, "options string, o_type string, o_conf double"), services, 4)


def five_signals(dev: DataFrame, prefixes: DataFrame, patterns: list[tuple], options: DataFrame, services: DataFrame, digits: int = 6) -> DataFrame:
    """``device``, ``device_type``, ``confidence``, ``signals`` of devices with ``mac``, ``hostname``, ``options`` (the option list as text), ``vendor_class`` and ``services``.

    A known hardware prefix is worth 0.2, a host name pattern and an option list their
    own confidence, the greatest of which counts; a vendor class adds 0.1 and each
    known service 0.15, up to 1. Later signals name the type. ``patterns`` are (order,
    expression, type, confidence), the first that matches names the type.
    """
    in_order = sorted(patterns)
    fits = lambda p: F.col("hostname").rlike("(?i)" + p[1])
    of_name = F.coalesce(*(F.when(fits(p), F.lit(p[2])) for p in in_order), F.lit(None).cast("string"))
    sure = F.greatest(F.lit(0.0), *(F.when(fits(p), F.lit(float(p[3]))) for p in in_order))
    kinds = services.groupBy("service").agg(F.max("s_type").alias("s_type"))
    s = dev.select("device", F.explode(F.array_distinct("services")).alias("service")).join(kinds, "service").groupBy("device").agg(F.count("*").alias("hits"), F.max("s_type").alias("s_type"))
    once = lambda df, key: df.dropDuplicates([key])
    x = dev.withColumn("prefix", F.substring("mac", 1, digits)).withColumns({"h_type": of_name, "h_conf": sure})
    x = x.join(once(options, "options"), "options", "left").join(once(prefixes, "prefix"), "prefix", "left").join(s, "device", "left")
    base = F.greatest(F.when(F.col("oui_vendor").isNotNull(), 0.2).otherwise(0.0), F.col("h_conf"), F.coalesce("o_conf", F.lit(0.0)))
    conf = F.least(F.lit(1.0), base + F.when(F.col("vendor_class").isNotNull(), 0.1).otherwise(0.0) + 0.15 * F.coalesce("hits", F.lit(0)))
    tag = lambda c, n: F.when(F.col(c).isNotNull(), F.lit(n))
    return x.select("device", F.coalesce("s_type", "o_type", "h_type").alias("device_type"), F.round(conf, 6).alias("confidence"), F.concat_ws(",", tag("oui_vendor", "oui"), tag("h_type", "hostname"), tag("o_type", "options"), tag("vendor_class", "vendor"), tag("s_type", "services")).alias("signals"))


QUERIES, SQL = R.QUERIES, R.SQL
