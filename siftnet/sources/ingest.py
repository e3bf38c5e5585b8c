"""Records as they are delivered: JSON bodies of collectors, sensors and resolvers. Each function takes a table of texts and returns typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions.crypto import hmac_sha256, hmac_sql
from siftnet.operators.shred import ADGUARD_LEAVES, Leaf, json_children
from siftnet.plans.base import EV, Registry, events
from siftnet.tables import load

R = Registry()

EVENT_JSON = "event_id string, timestamp string, event_type string, source_hash string, source_ip string, domain string, query_type string, resolved_ip string, blocked boolean, anomaly_score double, tags array<string>, network_segment string"
DNS_JSON = "sensor_id string, queries array<struct<timestamp: bigint, domain: string, query_type: string, client_ip: string, response_ip: string, server_ip: string, blocked: boolean, source: string>>"
SALT = "siftnet-salt"
# Question types that keep their name; reasons and status codes that mean blocked.
QUERY_TYPES = ("A", "AAAA", "CNAME", "MX", "TXT", "SRV", "SOA", "NS", "PTR", "SPF")
BLOCKED_REASONS = ("FilteredBlackList", "FilteredSafeBrowsing", "FilteredParental", "FilteredSafeSearch", "FilteredBlockedService")
BLOCKED_STATUS = (1, 4, 5, 6)


def objects_of(body: Column) -> Column:
    """The JSON texts of the objects in a body: itself, the elements of an array, or the second element of each [time, record] pair. Elements that are neither are left out; an unreadable body gives null."""
    listed = F.from_json(body, "array<string>")
    each = F.transform(listed, lambda x: F.when(F.ltrim(x).startswith("{"), x).when(F.ltrim(x).startswith("["), F.get(F.from_json(x, "array<string>"), F.lit(1))))
    return F.when(F.ltrim(body).startswith("{"), F.when(F.try_parse_json(body).isNotNull(), F.array(body))).when(F.ltrim(body).startswith("["), F.filter(each, lambda x: x.isNotNull() & F.ltrim(x).startswith("{")))


def parse_ingest(df: DataFrame, body: str = "body") -> DataFrame:
    """Events of ingest bodies, one row each; unreadable bodies give none."""
    return df.select(F.explode(objects_of(F.col(body))).alias("o")).select(F.from_json("o", EVENT_JSON).alias("e")).select("e.*")


def normalise_qtype(c: Column) -> Column:
    return F.when(F.upper(c) == "UNKNOWN", None).otherwise(F.upper(c))


def parse_sensor_batches(df: DataFrame, body: str = "body", salt: str = SALT) -> DataFrame:
    """Events of sensor batches; questions without name or client are dropped, the client's keyed hash is the source."""
    q = df.select(F.from_json(body, DNS_JSON).alias("b")).select("b.sensor_id", F.explode("b.queries").alias("q")).where("q.domain <> '' and q.client_ip <> ''")
    return q.select("sensor_id", (F.col("q.timestamp") * 1_000_000).alias("t_us"), F.lit("dns_query").alias("event_type"), hmac_sha256(F.col("q.client_ip"), salt).alias("source_hash"), F.col("q.client_ip").alias("source_ip"), "q.domain", normalise_qtype(F.col("q.query_type")).alias("query_type"), F.col("q.response_ip").alias("resolved_ip"), F.coalesce("q.blocked", F.lit(False)).alias("blocked"), F.lit("default").alias("network_segment"), F.col("q.source").alias("dns_source"))


def parse_pihole(df: DataFrame, body: str = "body", salt: str = SALT) -> DataFrame:
    """Events of a resolver's positional rows: short rows are skipped, cells of a wrong type are empty, the alias target stands for the answer."""
    row = df.select(F.explode(F.from_json(F.get_json_object(body, "$.data"), "array<array<string>>")).alias("r")).where(F.size("r") >= 10)
    at = lambda i: F.get("r", F.lit(i))
    r = row.select(F.coalesce(at(0).try_cast("bigint"), F.lit(0)).alias("s"), at(1).alias("query_type"), at(2).alias("domain"), at(3).alias("client"), at(4).try_cast("int").alias("status"), at(8).alias("target")).where("domain <> '' and client <> ''")
    return r.select((F.col("s") * 1_000_000).alias("t_us"), hmac_sha256(F.col("client"), salt).alias("source_hash"), F.col("client").alias("source_ip"), "domain", normalise_qtype(F.col("query_type")).alias("query_type"), F.nullif("target", F.lit("")).alias("resolved_ip"), F.coalesce(F.col("status").isin(*BLOCKED_STATUS), F.lit(False)).alias("blocked"))


def adguard_events(df: DataFrame) -> DataFrame:
    """One event per record of the log bodies: the question, the first answer, and whether the reason means blocked. Built from the shredded children."""
    kids = json_children(df, "rec_id", "body", [*ADGUARD_LEAVES[:1], ADGUARD_LEAVES[3], Leaf("reason", "reason", None, False), Leaf("client", "client", None, False)], order="received_at")
    first = lambda child: F.min(F.when(F.col("child") == child, F.struct("item_pos", "item")))["item"]
    return kids.groupBy("parent_id", "rec_pos").agg(first("question").alias("domain"), first("answer").alias("resolved_ip"), F.coalesce(first("reason").isin(*BLOCKED_REASONS), F.lit(False)).alias("blocked"), first("client").alias("source_ip"))


def after_watermark(df: DataFrame, t: str, watermark_us: int) -> tuple[DataFrame, Column]:
    """Rows after the high-water mark, and the next mark as an aggregate: the greatest time seen, never the clock, so that late rows of an empty poll aren't lost."""
    return df.where(F.col(t) > watermark_us), F.greatest(F.coalesce(F.max(t), F.lit(watermark_us)), F.lit(watermark_us))


def strip_personal(ev: DataFrame, salt: str = SALT) -> DataFrame:
    """Events as they may leave a site: no address, no vendor, no free text; the source is hashed again with a key."""
    return ev.select("event_id", "t_us", "event_type", hmac_sha256(F.col("source_hash"), salt).alias("node_hash"), "domain", "query_type", "blocked", "anomaly_score", "geo")


# --- queries: bodies are made of the tables and read again -------------------------------------------------------------------------------


def _bodies(spark, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    o = F.to_json(F.struct("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "event_type", "source_hash", "source_ip", "domain", "query_type", "resolved_ip", "blocked", "anomaly_score", "tags", "network_segment"))
    kind = F.pmod(F.crc32("event_id"), F.lit(4))
    return ev.select(F.when(kind == 0, o).when(kind == 1, F.concat(F.lit("["), o, F.lit(", 17]"))).when(kind == 2, F.concat(F.lit("[[1.5, "), o, F.lit("]]"))).otherwise(F.concat(F.lit(" [ "), o, F.lit(" ]"))).alias("body"))


@R.query(f"with {EV} select event_id, strftime(ts at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%fZ') as timestamp, event_type, source_ip, domain, blocked, anomaly_score, array_to_string(tags, ';') as tags from ev")
def src_ingest(spark, sf_dir: str) -> DataFrame:
    """Ingest bodies of all three forms."""
    return parse_ingest(_bodies(spark, sf_dir)).select("event_id", "timestamp", "event_type", "source_ip", "domain", "blocked", "anomaly_score", F.array_join("tags", ";").alias("tags"))


@R.query(f"with q as (select distinct query_id, sensor_id, epoch_us(received_at) // 1000000 as s, domain, query_type, client_ip, response_ip, blocked, source from dns_queries) select sensor_id, s * 1000000 as t_us, {hmac_sql('client_ip', SALT)} as source_hash, domain, case when upper(query_type) = 'UNKNOWN' then null else upper(query_type) end as query_type, blocked, source as dns_source from q where domain <> '' and client_ip <> ''")
def src_sensor_batches(spark, sf_dir: str) -> DataFrame:
    """Sensor batches of at most 100 questions."""
    q = load(spark, sf_dir, "dns_queries").dropDuplicates(["query_id"]).withColumn("b", F.expr("query_id div 100"))
    item = F.struct(F.expr("unix_micros(received_at) div 1000000").alias("timestamp"), "domain", "query_type", "client_ip", "response_ip", "server_ip", "blocked", "source")
    batches = q.groupBy("sensor_id", "b").agg(F.collect_list(item).alias("queries")).select(F.to_json(F.struct("sensor_id", "queries")).alias("body"))
    return parse_sensor_batches(batches).select("sensor_id", "t_us", "source_hash", "domain", "query_type", "blocked", "dns_source")


@R.query(f"with {EV} select (t_us // 1000000) * 1000000 as t_us, {hmac_sql('source_ip', SALT)} as source_hash, domain, case when upper(query_type) = 'UNKNOWN' then null else upper(query_type) end as query_type, resolved_ip, blocked from ev where dns_source = 'pihole' and domain is not null and source_ip <> ''")
def src_pihole(spark, sf_dir: str) -> DataFrame:
    """Positional rows of a resolver, beside short ones."""
    e = events(spark, sf_dir).where("dns_source = 'pihole' and domain is not null and source_ip <> ''")
    cell = lambda c: F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}).substr(F.lit(6), F.length(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})) - 6)
    row = F.concat(F.lit("["), F.concat_ws(",", F.expr("string(t_us div 1000000)"), cell(F.col("query_type")), cell(F.col("domain")), cell(F.col("source_ip")), F.when(F.col("blocked"), "1").otherwise("2"), F.lit("0"), F.lit("0"), F.lit("12"), cell(F.coalesce("resolved_ip", F.lit(""))), F.lit('""')), F.lit("]"))
    body = e.select(F.concat(F.lit('{"data": ['), row, F.lit(', ["short"], [1, 2]]}')).alias("body"))
    return parse_pihole(body).select("t_us", "source_hash", "domain", "query_type", "resolved_ip", "blocked")


@R.query()
def src_adguard(spark, sf_dir: str) -> DataFrame:
    return adguard_events(load(spark, sf_dir, "adguard_log"))


@R.query(f"with {EV} select event_id, t_us, event_type, {hmac_sql('source_hash', SALT)} as node_hash, domain, query_type, blocked, anomaly_score, geo from ev")
def src_strip_personal(spark, sf_dir: str) -> DataFrame:
    return strip_personal(events(spark, sf_dir))


@R.query("with q as (select distinct query_id, epoch_us(received_at) as t from dns_queries), m as (select (min(t) + max(t)) // 2 as mark from q) select count(*) as fresh, max(t) as next_mark from q, m where t > mark")
def src_watermark(spark, sf_dir: str) -> DataFrame:
    """Rows after a high-water mark in the middle of the table."""
    q = load(spark, sf_dir, "dns_queries").select("query_id", F.unix_micros("received_at").alias("t")).distinct()
    lo, hi = q.agg(F.min("t"), F.max("t")).first()
    fresh, mark = after_watermark(q, "t", ((lo or 0) + (hi or 0)) // 2)
    return fresh.agg(F.count("*").alias("fresh"), mark.alias("next_mark"))


QUERIES, SQL = R.QUERIES, R.SQL
