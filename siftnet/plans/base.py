"""What the query modules share: the registry and the cleaned tables, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftnet.tables import domain_key, load, segment_key

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with the SQL of those that have one."""

    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.QUERIES[f.__name__] = f
            if sql is not None:
                self.SQL[f.__name__] = sql
            return f

        return add


def deliveries(spark: SparkSession, sf_dir: str, where: Column | str | None = None, named: bool = False, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """The events as they were delivered, some more than once, in canonical spelling.

    ``named``: only events with a domain; ``from_us``, ``to_us``: only those times,
    ends included. Conditions reach the scan where they are about columns as they
    are stored.
    """
    raw = load(spark, sf_dir, "dns_events").drop("received_at")
    if named:
        raw = raw.where("domain is not null")
    if from_us is not None:
        raw = raw.where(F.col("ts") >= F.timestamp_micros(F.lit(from_us)))
    if to_us is not None:
        raw = raw.where(F.col("ts") <= F.timestamp_micros(F.lit(to_us)))
    ev = raw.withColumns({"t_us": F.unix_micros("ts"), "source_hash": F.lower("source_hash"), "domain": domain_key("domain"), "network_segment": segment_key("network_segment")})
    if named:
        ev = ev.where("domain is not null")
    return ev if where is None else ev.where(where)


def events(spark: SparkSession, sf_dir: str, where: Column | str | None = None, named: bool = False, from_us: int | None = None, to_us: int | None = None) -> DataFrame:
    """Every event of ``deliveries`` once; only the columns that a query uses are shuffled.

    Redelivered rows repeat their content (a precondition: of rows that differed any
    one would stay), so that conditions hold for all rows of an event or for none
    and are applied before redelivered rows are dropped.
    """
    return deliveries(spark, sf_dir, where, named, from_us, to_us).dropDuplicates(["event_id"])


#: The same as a CTE, to be followed by a query or further CTEs.
EV = r"""ev as (select * exclude (rn, received_at) replace (lower(source_hash) as source_hash, coalesce(nullif(network_segment, ''), 'default') as network_segment,
  nullif(regexp_replace(lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')), '\.$', ''), '') as domain), epoch_us(ts) as t_us
  from (select *, row_number() over (partition by event_id order by received_at) as rn from dns_events) where rn = 1)"""


def firewall(spark: SparkSession, sf_dir: str, where: Column | str | None = None) -> DataFrame:
    """Every firewall record once; conditions come first, as in ``events``."""
    fw = load(spark, sf_dir, "firewall_events").drop("polled_at").withColumn("t_us", F.unix_micros("ts"))
    return (fw if where is None else fw.where(where)).dropDuplicates(["fw_id"])


FW = "fw as (select * exclude (rn, polled_at), epoch_us(ts) as t_us from (select *, row_number() over (partition by fw_id order by polled_at) as rn from firewall_events) where rn = 1)"


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every host of every device report, once per report."""
    r = load(spark, sf_dir, "device_reports").dropDuplicates(["report_id"])
    h = r.select("report_id", "sensor_id", segment_key("segment").alias("segment"), F.unix_micros("scan_time").alias("t_us"), F.posexplode("hosts").alias("pos", "h")).where("h is not null")
    mac = F.upper(F.regexp_replace("h.mac_address", "[^0-9A-Fa-f]", ""))
    norm = lambda c: F.nullif(F.trim(c), F.lit(""))
    return h.select("report_id", "sensor_id", "segment", "t_us", "pos", norm("h.ip_address").alias("ip"), F.nullif(mac, F.lit("")).alias("mac"), norm("h.hostname").alias("hostname"), norm("h.vendor").alias("vendor"), F.col("h.open_ports").alias("ports"), F.col("h.status").alias("status"))


HOSTS = """reps as (select report_id, any_value(sensor_id) as sensor_id, any_value(coalesce(nullif(segment, ''), 'default')) as segment, any_value(epoch_us(scan_time)) as t_us, any_value(hosts) as hosts from device_reports group by report_id),
hx as (select report_id, sensor_id, segment, t_us, unnest(range(len(hosts))) as pos, hosts from reps where len(hosts) > 0),
hosts as (select report_id, sensor_id, segment, t_us, pos, nullif(trim(hosts[pos + 1].ip_address), '') as ip, nullif(upper(regexp_replace(hosts[pos + 1].mac_address, '[^0-9A-Fa-f]', '', 'g')), '') as mac,
  nullif(trim(hosts[pos + 1].hostname), '') as hostname, nullif(trim(hosts[pos + 1].vendor), '') as vendor, hosts[pos + 1].open_ports as ports, hosts[pos + 1].status as status from hx where hosts[pos + 1] is not null)"""


def last_time(df: DataFrame, column: str = "t_us") -> int:
    """The latest time in a table, which stands for now; one number comes to the driver."""
    return df.agg(F.max(column)).first()[0] or 0


def now_us(spark: SparkSession, sf_dir: str, table: str = "dns_events", column: str = "ts") -> int:
    """The latest time of a stored table, from that column alone: redelivered rows cannot change it."""
    return last_time(load(spark, sf_dir, table).select(F.unix_micros(column).alias("t_us")))


def stored_rows(spark: SparkSession, sf_dir: str, table: str = "dns_events") -> int:
    """The rows of a stored table, from its files' metadata: no key has more."""
    return load(spark, sf_dir, table).count()
