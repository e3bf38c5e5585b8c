"""What a device is: hardware prefixes, host name patterns, vendors, and profiles of known values.

Tables of prefixes and profiles are inputs; the patterns and vendors are defaults
that any list of the same form replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.operators.detect import rows, sql_rows
from siftnet.operators.devices import INVENTORY, inventory
from siftnet.plans.base import HOSTS, Registry, hosts
from siftnet.plans.fixtures import PROFILES

R = Registry()

# Host name patterns in the order in which they are tried, with device type, vendor, system, model and confidence.
HOSTNAME_PATTERNS = [
    ("^iPhone", "phone", "Apple", "iOS", "", 0.7), ("^iPad", "tablet", "Apple", "iPadOS", "", 0.7), ("^MacBook", "computer", "Apple", "macOS", "", 0.7), ("^iMac", "computer", "Apple", "macOS", "", 0.7), ("^Mac.*", "computer", "Apple", "macOS", "", 0.6),
    ("^Galaxy", "phone", "Samsung", "Android", "", 0.7), ("^SM-", "phone", "Samsung", "Android", "", 0.6), ("^Pixel", "phone", "Google", "Android", "", 0.7), ("^Nest-", "thermostat", "Google Nest", "", "", 0.6), ("^Google-Home", "smart_speaker", "Google", "", "", 0.7),
    ("^Chromecast", "media_player", "Google", "", "", 0.7), ("^DESKTOP-", "computer", "Microsoft", "Windows", "", 0.7), ("^WIN-", "computer", "Microsoft", "Windows", "", 0.6), ("^LAPTOP-", "computer", "Microsoft", "Windows", "", 0.7), ("^raspberrypi", "computer", "Raspberry Pi Foundation", "Linux", "", 0.8),
    ("^Ring-", "camera", "Ring", "", "", 0.7), ("^LIFX", "smart_light", "LIFX", "", "", 0.7), ("^Amazon-", "smart_speaker", "Amazon", "", "", 0.6), ("^Echo-", "smart_speaker", "Amazon", "", "", 0.7), ("^Fire", "media_player", "Amazon", "", "", 0.6),
    ("^HP", "printer", "HP", "", "", 0.6), ("^HPCOLOR", "printer", "HP", "", "", 0.7), ("^EPSON", "printer", "Epson", "", "", 0.7), ("^Brother", "printer", "Brother", "", "", 0.7), ("^BRN", "printer", "Brother", "", "", 0.6), ("^Xerox", "printer", "Xerox", "", "", 0.6),
    ("^UniFi", "access_point", "Ubiquiti", "", "", 0.7), ("^UAP-", "access_point", "Ubiquiti", "", "", 0.7), ("^PS5", "game_console", "Sony", "", "PlayStation 5", 0.8), ("^PS4", "game_console", "Sony", "", "PlayStation 4", 0.8), ("^PSVita", "game_console", "Sony", "", "PS Vita", 0.7),
    ("^Xbox", "game_console", "Microsoft", "", "", 0.7), ("^Nintendo", "game_console", "Nintendo", "", "", 0.6), ("^Switch", "game_console", "Nintendo", "", "Nintendo Switch", 0.7), ("^LGwebOS", "smart_tv", "LG", "webOS", "", 0.7), ("^LG.*TV", "smart_tv", "LG", "", "", 0.6),
    ("^Samsung.*TV", "smart_tv", "Samsung", "", "", 0.6), ("^Roku", "smart_tv", "Roku", "", "", 0.7), ("^TP-Link", "iot_generic", "TP-Link", "", "", 0.5), ("^Tapo", "iot_generic", "TP-Link Tapo", "", "", 0.6), ("^Sonos", "smart_speaker", "Sonos", "", "", 0.7), ("^Bose", "smart_speaker", "Bose", "", "", 0.6),
    ("^Denon", "smart_speaker", "Denon", "", "", 0.5), ("^Yamaha", "smart_speaker", "Yamaha", "", "", 0.5), ("^Logitech", "iot_generic", "Logitech", "", "", 0.5), ("^Meross", "iot_generic", "Meross", "", "", 0.6), ("^August", "iot_generic", "August", "", "", 0.6), ("^Yale", "iot_generic", "Yale", "", "", 0.6),
    ("^Schlage", "iot_generic", "Schlage", "", "", 0.6), ("^WiZ", "smart_light", "WiZ", "", "", 0.7), ("^Innr", "smart_light", "Innr", "", "", 0.6), ("^Eve", "iot_generic", "Eve Systems", "", "", 0.6), ("^SmartThings", "iot_generic", "SmartThings", "", "", 0.6), ("^Arlo", "camera", "Arlo (Netgear)", "", "", 0.7),
    ("^Blink", "camera", "Blink (Amazon)", "", "", 0.7), ("^Wyze", "camera", "Wyze", "", "", 0.6), ("^Reolink", "camera", "Reolink", "", "", 0.6), ("^Foscam", "camera", "Foscam", "", "", 0.6), ("^Hikvision", "camera", "Hikvision", "", "", 0.6), ("^Dahua", "camera", "Dahua", "", "", 0.6),
    ("^Axis", "camera", "Axis Communications", "", "", 0.6), ("^D-Link.*Cam", "camera", "D-Link", "", "", 0.6), ("^GoPro", "camera", "GoPro", "", "", 0.7),
]
# Parts of vendors' names, in the order in which they are tried, with the name and device type that they stand for, and the confidence of all.
VENDOR_PARTS = [("apple", "Apple", None), ("nest", "Google", "iot_generic"), ("google", "Google", None), ("amazon", "Amazon", "smart_speaker"), ("samsung", "Samsung", None), ("philips", "Philips", "smart_light"), ("tp-link", "TP-Link", "iot_generic"), ("tapo", "TP-Link", "iot_generic"), ("ubiquiti", "Ubiquiti", "access_point")]
VENDOR_CONFIDENCE, PREFIX_CONFIDENCE, KNOWN_CONFIDENCE = 0.15, 0.2, 0.1


def match_hostname(name: Column, patterns: list[tuple] = HOSTNAME_PATTERNS) -> Column:
    """Struct of the first pattern that a host name matches, in any letter case; null if none does."""
    blank = lambda v: F.lit(v or None).cast("string")
    of = lambda p: F.struct(F.lit(p[1]).alias("device_type"), blank(p[2]).alias("vendor"), blank(p[3]).alias("os_family"), blank(p[4]).alias("model"), F.lit(p[5]).alias("confidence"))
    return F.coalesce(*(F.when(F.trim(name).rlike("(?i)" + p[0]), of(p)) for p in patterns))


def infer_from_vendor(vendor: Column) -> Column:
    """Struct of vendor and device type that a vendor's name suggests; other names stay, in lower case."""
    v = F.lower(vendor)
    of = lambda name, kind: F.struct(name.alias("vendor"), F.lit(kind).cast("string").alias("device_type"), F.lit(VENDOR_CONFIDENCE).alias("confidence"))
    return F.when(vendor.isNotNull(), F.coalesce(*(F.when(v.contains(part), of(F.lit(name), kind)) for part, name, kind in VENDOR_PARTS), of(v, None)))


def with_prefix(devices: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Adds ``p_vendor`` and ``p_type`` by the first six hexadecimal digits of ``mac``; the table's ``prefix`` may be in any notation."""
    p = prefixes.select(F.substring(F.upper(F.regexp_replace("prefix", "[^0-9A-Fa-f]", "")), 1, 6).alias("__p"), F.col("vendor").alias("p_vendor"), F.nullif("device_type", F.lit("")).alias("p_type"))
    p = p.groupBy("__p").agg(F.min(F.struct("p_vendor", "p_type")).alias("x")).select("__p", "x.*", F.lit(True).alias("p_known"))
    return devices.withColumn("__p", F.substring(F.upper(F.regexp_replace("mac", "[^0-9A-Fa-f]", "")), 1, 6)).join(p, "__p", "left").drop("__p")


def fuse(devices: DataFrame, prefixes: DataFrame, patterns: list[tuple] = HOSTNAME_PATTERNS) -> DataFrame:
    """``device``, ``device_type``, ``vendor``, ``os_family``, ``model``, ``confidence``: the prefix names the vendor, a surer host name the type, and both together are as sure as their sum; of what is still missing the reported vendor is taken."""
    d = with_prefix(devices, prefixes).withColumn("h", match_hostname(F.col("hostname"), patterns))
    known, named = F.coalesce("p_known", F.lit(False)), F.col("h").isNotNull()
    base = F.when(known, PREFIX_CONFIDENCE).otherwise(0.0)
    wins = named & ((F.col("h.confidence") > base) | ((F.col("h.confidence") == base) & F.col("p_type").isNull()))
    kind = F.when(wins, F.col("h.device_type")).otherwise(F.col("p_type"))
    sure = F.when(known & named & (F.col("h.device_type") == kind), F.least(F.lit(1.0), base + F.col("h.confidence"))).when(named & (F.col("h.confidence") >= base), F.col("h.confidence")).otherwise(base)
    vendor = F.coalesce("p_vendor", "h.vendor")
    last = F.when(vendor.isNull() & F.col("vendor").isNotNull(), F.greatest(sure, F.lit(KNOWN_CONFIDENCE))).otherwise(sure)
    return d.select("device", kind.alias("device_type"), F.coalesce(vendor, "vendor").alias("vendor"), "h.os_family", "h.model", F.round(last, 6).alias("confidence"))


def match_profiles(devices: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each device with the surest profile that has one of its values: ``device``, ``profile_id``, ``device_type``, ``confidence``. Profiles list known ``vendors``, ``hostnames`` and ``ports``; the lists meet by equality."""
    text = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x.cast("string")))
    marked = lambda mark, v: F.transform(v, lambda x: F.concat(F.lit(mark), x))
    each = lambda df, own, *pairs: df.select(*own, F.explode(F.concat(*(marked(*p) for p in pairs))).alias("v")).where("v is not null").distinct()
    p = each(profiles, ["profile_id", "device_type", "confidence"], ("v:", text(F.col("vendors"))), ("h:", text(F.col("hostnames"))), ("p:", text(F.col("ports").cast("array<string>"))))
    d = each(devices, ["device"], ("v:", text(F.array("vendor"))), ("h:", text(F.array("hostname"))), ("p:", text(F.col("ports").cast("array<string>"))))
    return d.join(p, "v").groupBy("device").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "profile_id", "device_type", "confidence")).alias("b")).select("device", "b.profile_id", "b.device_type", "b.confidence")


def _own_prefixes(h: DataFrame) -> DataFrame:
    """A table of prefixes from the reports themselves: the vendor that sorts first for each."""
    return h.where("mac is not null and vendor is not null").groupBy(F.substring("mac", 1, 6).alias("prefix")).agg(F.min("vendor").alias("vendor")).withColumn("device_type", F.lit(None).cast("string"))


_PATTERNS_SQL = sql_rows([(i, *p) for i, p in enumerate(HOSTNAME_PATTERNS)], "ord, pattern, device_type, vendor, os_family, model, confidence")


@R.query(f"""with {HOSTS}, {INVENTORY}, px as (select mac[:6] as prefix, min(vendor) as p_vendor from hosts where mac is not null and vendor is not null group by 1),
 hm as (select device, arg_min(t.device_type, ord) as h_type, nullif(arg_min(t.vendor, ord), '') as h_vendor, nullif(arg_min(t.os_family, ord), '') as os_family, nullif(arg_min(t.model, ord), '') as model, arg_min(t.confidence, ord)::double as h_conf from inv join {_PATTERNS_SQL} on regexp_matches(trim(hostname), pattern, 'i') group by device)
 select inv.device, h_type as device_type, coalesce(p_vendor, h_vendor, inv.vendor) as vendor, os_family, model,
  round(case when h_conf is not null and p_vendor is not null then least(1, 0.2::double + h_conf) when h_conf is not null then h_conf when p_vendor is not null then 0.2::double when inv.vendor is not null then 0.1::double else 0 end, 6) as confidence
 from inv left join px on inv.mac[:6] = px.prefix left join hm using (device)""")
def fingerprint_fused(spark, sf_dir: str) -> DataFrame:
    """Every device by prefix, host name and vendor, as surveyed (SCA-16, 17, 18); the prefixes are those of the reports."""
    h = hosts(spark, sf_dir)
    return fuse(inventory(h), _own_prefixes(h))


@R.query(f"with {HOSTS}, v as (select distinct vendor as reported from hosts where vendor is not null) select reported, case " + " ".join(f"when contains(lower(reported), '{p}') then '{n}'" for p, n, _ in VENDOR_PARTS) + " else lower(reported) end as vendor, case " + " ".join(f"when contains(lower(reported), '{p}') then {repr(k) if k else 'null'}" for p, _, k in VENDOR_PARTS) + " end as device_type from v")
def vendor_types(spark, sf_dir: str) -> DataFrame:
    """What reported vendors suggest (SCA-19)."""
    v = hosts(spark, sf_dir).where("vendor is not null").select(F.col("vendor").alias("reported")).distinct().withColumn("x", infer_from_vendor(F.col("reported")))
    return v.select("reported", "x.vendor", "x.device_type")


@R.query(f"""with {HOSTS}, {INVENTORY}, pr as (select device, arg_max(coalesce(ports, []), (t_us, report_id, pos)) as ports from k group by device), d as (select inv.device, 'v:' || lower(vendor) as v from inv union select device, 'h:' || lower(hostname) from inv union select device, 'p:' || unnest(ports) from pr),
 pf as (select * from {sql_rows(PROFILES, 'profile_id, vendors, hostnames, ports, device_type, confidence')}), p as (select profile_id, device_type, confidence, 'v:' || lower(unnest(vendors)) as v from pf union select profile_id, device_type, confidence, 'h:' || lower(unnest(hostnames)) from pf union select profile_id, device_type, confidence, 'p:' || unnest(ports) from pf)
 select device, arg_min(profile_id, (-confidence, profile_id)) as profile_id, arg_min(device_type, (-confidence, profile_id)) as device_type, max(confidence)::double as confidence from d join p using (v) group by device""")
def profile_matches(spark, sf_dir: str) -> DataFrame:
    """Devices by profiles of known values (JOI-15)."""
    inv = inventory(hosts(spark, sf_dir))
    return match_profiles(inv, rows(inv, PROFILES, "profile_id string, vendors array<string>, hostnames array<string>, ports array<int>, device_type string, confidence double"))


QUERIES, SQL = R.QUERIES, R.SQL
