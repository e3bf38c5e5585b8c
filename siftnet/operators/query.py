"""Filtering, validating, paging and counting of events."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.plans.base import EV, FW, Registry, events, firewall, now_us
from siftnet.tables import load

R = Registry()
SORTS = ("ts", "event_type", "anomaly_score", "source_hash", "domain")
# The event types that are accepted.
EVENT_TYPES = ("dns_query", "nmap_discovery", "firewall_log", "anomaly", "encrypted_dns")
HOUR, DAY = 3_600_000_000, 86_400_000_000


@dataclass
class EventQuery:
    """A filter whose parts all hold, an order and a page. Parts that are absent filter nothing; times are inclusive at both ends."""

    from_us: int | None = None
    to_us: int | None = None
    event_type: str | None = None
    source_hash: str | None = None
    domain: str | None = None
    segment: str | None = None
    source_ip: str | None = None
    min_score: float | None = None
    tags: list[str] = field(default_factory=list)
    tag_patterns: bool = False  #: tags as case-insensitive patterns over the list's JSON text
    sort: str = "ts"
    order: str = "desc"
    page: int = 1
    limit: int = 50

    def predicate(self) -> Column:
        eq = [F.col(k) == v for k, v in (("event_type", self.event_type), ("source_hash", self.source_hash), ("domain", self.domain), ("network_segment", self.segment), ("source_ip", self.source_ip)) if v is not None]
        rng = [c for c in ((F.col("t_us") >= self.from_us) if self.from_us is not None else None, (F.col("t_us") <= self.to_us) if self.to_us is not None else None, (F.col("anomaly_score") >= self.min_score) if self.min_score is not None else None) if c is not None]
        tags = [F.to_json("tags").ilike(f'%"{t}"%') if self.tag_patterns else F.array_contains("tags", t) for t in self.tags]
        return reduce(lambda a, b: a & b, [*eq, *rng, *tags], F.lit(True))

    def events(self, spark, sf_dir: str) -> DataFrame:
        """The events that the filter leaves; it is applied before anything is shuffled."""
        return events(spark, sf_dir, self.predicate(), self.domain is not None, self.from_us, self.to_us)

    def rows(self, ev: DataFrame) -> DataFrame:
        key = self.sort if self.sort in SORTS else "ts"
        key = "t_us" if key == "ts" else key
        size = 50 if self.limit < 1 else min(self.limit, 500)
        by = F.col(key).asc_nulls_first() if self.order == "asc" else F.col(key).desc_nulls_last()
        return ev.where(self.predicate()).orderBy(by, F.col("event_id").asc()).offset((max(self.page, 1) - 1) * size).limit(size)

    def total(self, ev: DataFrame) -> DataFrame:
        return ev.where(self.predicate()).agg(F.count("*").alias("total"))


_SHOWN = ["event_id", "t_us", "event_type", "domain", "anomaly_score"]


@R.query(f"with {EV} select event_id, t_us, event_type, domain, anomaly_score from ev where event_type = 'dns_query' and anomaly_score >= 0.3 order by anomaly_score desc nulls last, event_id limit 50 offset 100")
def events_filter_page(spark, sf_dir: str) -> DataFrame:
    q = EventQuery(event_type="dns_query", min_score=0.3, sort="anomaly_score", page=3)
    return q.rows(q.events(spark, sf_dir)).select(_SHOWN)


@R.query(f"with {EV}, m as (select max(t_us) as now from ev) select count(*) as total from ev, m where t_us between now - 86400000000 and now and anomaly_score >= 0.1")
def events_total(spark, sf_dir: str) -> DataFrame:
    now = now_us(spark, sf_dir)
    q = EventQuery(from_us=now - DAY, to_us=now, min_score=0.1)
    return q.total(q.events(spark, sf_dir))


@R.query(f"with {EV} select event_id, t_us, event_type, domain, anomaly_score from ev order by domain asc nulls first, event_id limit 500")
def events_sorted_asc(spark, sf_dir: str) -> DataFrame:
    return EventQuery(sort="domain", order="asc", limit=999).rows(events(spark, sf_dir)).select(_SHOWN)


@R.query(f"with {EV} select event_id from ev where list_has_all(tags, ['known_bad'])")
def events_tag_all(spark, sf_dir: str) -> DataFrame:
    return EventQuery(tags=["known_bad"]).events(spark, sf_dir).select("event_id")


@R.query(f"with {EV} select event_id from ev where to_json(tags)::varchar ilike '%\"DGA_candidate\"%'")
def events_tag_pattern(spark, sf_dir: str) -> DataFrame:
    return EventQuery(tags=["DGA_candidate"], tag_patterns=True).events(spark, sf_dir).select("event_id")


@R.query(f"""with {EV}, m as (select source_hash as s, domain as d from ev where domain is not null group by all order by count(*) desc, s, d limit 1)
 select event_id, t_us from ev, m where source_hash = s and domain = d""")
def events_of_source_and_name(spark, sf_dir: str) -> DataFrame:
    top = events(spark, sf_dir, named=True).groupBy("source_hash", "domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_hash", "domain").first()
    q = EventQuery(source_hash=top.source_hash, domain=top.domain) if top else EventQuery(source_hash="")
    return q.events(spark, sf_dir).select("event_id", "t_us")


def validate(raw: DataFrame, now_us: int) -> DataFrame:
    """Adds ``reason`` (null for accepted rows) and the defaults of missing values: id, time, source, score within [0, 1], tags, segment."""
    reason = F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), "event_type").when(~F.col("network_segment").isin("default", "iot", "guest"), "segment")
    return raw.withColumn("reason", reason).withColumns({
        "event_id": F.coalesce("event_id", F.sha2(F.concat_ws("|", "event_type", "t_us", "source_ip", "domain"), 256)), "t_us": F.coalesce("t_us", F.lit(now_us)), "source_hash": F.coalesce("source_hash", F.lit("unknown")),
        "anomaly_score": F.when(F.col("anomaly_score").isNull() | (F.col("anomaly_score") < 0), 0.0).when(F.col("anomaly_score") > 1, 1.0).otherwise(F.col("anomaly_score")), "tags": F.coalesce("tags", F.array().cast("array<string>")),
    })


@R.query(f"""with {EV}, r as (select *, case when event_type = 'nmap_discovery' and device_vendor = 'Oluvo' then 'bogus' else event_type end as et, anomaly_score * 1.2::double - 0.05::double as sc, case when network_segment = 'iot' and geo = 'AA' then 'lab' else network_segment end as seg from ev)
 select case when et not in ('dns_query', 'nmap_discovery', 'firewall_log', 'anomaly', 'encrypted_dns') then 'event_type' when seg not in ('default', 'iot', 'guest') then 'segment' end as reason, count(*) as n, round(sum(case when sc < 0 then 0 when sc > 1 then 1 else sc end), 4) as score from r group by 1""")
def events_validated(spark, sf_dir: str) -> DataFrame:
    """Rows by the reason of their rejection, some of them spoilt on purpose."""
    ev = events(spark, sf_dir)
    spoilt = ev.withColumns({
        "event_type": F.when((F.col("event_type") == "nmap_discovery") & (F.col("device_vendor") == "Oluvo"), "bogus").otherwise(F.col("event_type")), "anomaly_score": F.col("anomaly_score") * 1.2 - 0.05,
        "network_segment": F.when((F.col("network_segment") == "iot") & (F.col("geo") == "AA"), "lab").otherwise(F.col("network_segment")),
    })
    return validate(spoilt, 0).groupBy("reason").agg(F.count("*").alias("n"), F.round(F.sum("anomaly_score"), 4).alias("score"))


@R.query(f"with {EV} select case when anomaly_score > 0.7 then 'critical' when anomaly_score >= 0.3 then 'warning' else 'info' end as severity, count(*) as n from ev group by 1")
def severity_bands(spark, sf_dir: str) -> DataFrame:
    band = F.when(F.col("anomaly_score") > 0.7, "critical").when(F.col("anomaly_score") >= 0.3, "warning").otherwise("info")
    return events(spark, sf_dir).groupBy(band.alias("severity")).agg(F.count("*").alias("n"))


@R.query(f"with {EV}, m as (select max(t_us) as now from ev) select count(*) as total, count(*) filter (anomaly_score > 0.5) as threats, count(*) filter (t_us >= now - 86400000000) as last_day, count(*) filter (blocked) as blocked from ev, m")
def stats_totals(spark, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.agg(F.count("*").alias("total"), F.count_if(F.col("anomaly_score") > 0.5).alias("threats"), F.count_if(F.col("t_us") >= now_us(spark, sf_dir) - DAY).alias("last_day"), F.count_if("blocked").alias("blocked"))


@R.query(f"with {EV} select event_type, count(*) as n from ev group by event_type")
def count_by_type(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))


@R.query(f"with {EV} select domain, count(*) as n from ev where domain is not null group by domain order by n desc, domain limit 10")
def top_domains(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, named=True).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)


@R.query(f"with {EV} select domain, count(*) as n from ev where domain is not null and blocked group by domain order by n desc, domain limit 10")
def top_blocked(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, "blocked", named=True).groupBy("domain").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(10)


def timeline(ev: DataFrame, as_of: int, step_us: int = HOUR, steps: int = 24) -> DataFrame:
    """Counts of the last ``steps`` full or begun steps, none missing."""
    last = as_of - as_of % step_us
    grid = ev.sparkSession.range(steps).select((F.lit(last) - F.col("id") * step_us).alias("b_us"))
    n = ev.where((F.col("t_us") > last - steps * step_us) & (F.col("t_us") <= as_of)).groupBy((F.col("t_us") - F.pmod("t_us", F.lit(step_us))).alias("b_us")).agg(F.count("*").alias("n"), F.count_if(F.col("anomaly_score") > 0.5).alias("threats"), F.count_if("blocked").alias("blocked"))
    return grid.join(n, "b_us", "left").na.fill(0)


@R.query(f"""with {EV}, m as (select max(t_us) as now from ev), g as (select now - now % 3600000000 - i * 3600000000 as b_us from m, range(24) t(i)), c as (select t_us - t_us % 3600000000 as b_us, count(*) as n, count(*) filter (anomaly_score > 0.5) as threats, count(*) filter (blocked) as blocked from ev group by 1)
 select strftime(make_timestamp(g.b_us), '%Y-%m-%dT%H:00:00Z') as hour, coalesce(n, 0) as n, coalesce(threats, 0) as threats, coalesce(blocked, 0) as blocked from g left join c using (b_us)""")
def timeline_24h(spark, sf_dir: str) -> DataFrame:
    now = now_us(spark, sf_dir)
    t = timeline(events(spark, sf_dir, from_us=now - DAY), now)
    return t.select(F.date_format(F.timestamp_micros("b_us"), "yyyy-MM-dd'T'HH':00:00Z'").alias("hour"), "n", "threats", "blocked")


@R.query(f"with {EV}, m as (select max(t_us) as now from ev), g as (select now - now % 300000000 - i * 300000000 as b_us from m, range(576) t(i)), c as (select t_us - t_us % 300000000 as b_us, count(*) as n from ev group by 1) select g.b_us, coalesce(n, 0) as n from g left join c using (b_us)")
def series_5min(spark, sf_dir: str) -> DataFrame:
    """Counts of the last 48 hours by five minutes, none missing."""
    now = now_us(spark, sf_dir)
    return timeline(events(spark, sf_dir, from_us=now - 2 * DAY), now, 300_000_000, 576).select("b_us", "n")


@R.query("""select 'dns_events' as t, count(*) as n from dns_events union all select 'firewall_events', count(*) from firewall_events union all select 'sensors', count(*) from sensors union all select 'device_reports', count(*) from device_reports""")
def table_counts(spark, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, t).agg(F.lit(t).alias("t"), F.count("*").alias("n")) for t in ("dns_events", "firewall_events", "sensors", "device_reports")]
    return reduce(DataFrame.unionByName, parts)


@R.query(f"with {EV} select network_segment, count(*) as n, count(*) filter (blocked) as blocked, count(distinct source_hash) as sources, round(count(*) / max(count(*)) over (), 6) as bar from ev group by network_segment")
def segment_counts(spark, sf_dir: str) -> DataFrame:
    """Events by segment, and the length of each segment's bar against the longest."""
    g = events(spark, sf_dir).groupBy("network_segment").agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), F.countDistinct("source_hash").alias("sources"))
    return g.withColumn("bar", F.round(F.greatest(F.col("n") / F.max("n").over(Window.partitionBy()), F.lit(0.05)), 6))


@R.query(f"with {EV} select distinct domain, source_ip from ev where anomaly_score > 0.7 and domain is not null")
def bulk_pairs(spark, sf_dir: str) -> DataFrame:
    """Distinct pairs of name and source that a bulk rule would be made of."""
    return events(spark, sf_dir, "anomaly_score > 0.7", named=True).select("domain", "source_ip").dropDuplicates()


@R.query(f"with {EV} select event_type, list_aggregate(list(dns_source order by dns_source), 'string_agg', ',') as sources, sum(n)::bigint as n from (select event_type, dns_source, count(*) as n from ev where dns_source is not null group by all) group by event_type")
def sources_by_type(spark, sf_dir: str) -> DataFrame:
    """A map per event type as a text."""
    g = events(spark, sf_dir, "dns_source is not null").groupBy("event_type", "dns_source").agg(F.count("*").alias("n"))
    return g.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("dns_source")), ",").alias("sources"), F.sum("n").alias("n"))


def time_ago(t_us: Column, as_of: int) -> Column:
    """An age in words."""
    s = F.floor((F.lit(as_of) - t_us) / 1_000_000)
    return F.when(s < 60, "just now").when(s < 3600, F.concat(F.floor(s / 60), F.lit("m ago"))).when(s < 86400, F.concat(F.floor(s / 3600), F.lit("h ago"))).otherwise(F.concat(F.floor(s / 86400), F.lit("d ago")))


@R.query(f"with {EV}, m as (select max(t_us) as now from ev), a as (select (now - t_us) // 1000000 as s from ev, m) select case when s < 60 then 'just now' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' else s // 86400 || 'd ago' end as ago, count(*) as n from a group by 1")
def ages(spark, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.groupBy(time_ago(F.col("t_us"), now_us(spark, sf_dir)).alias("ago")).agg(F.count("*").alias("n"))


@R.query(f"with {FW}, m as (select max(t_us) as now from fw), w as (select src_ip, t_us - t_us % 60000000 as minute_us, count(*) as n from fw where src_ip is not null group by all) select src_ip, minute_us, n, greatest(n - 5, 0) as refused from w where n > 2")
def rate_limit(spark, sf_dir: str) -> DataFrame:
    """Requests of an address in each minute, and how many of them exceed five."""
    w = firewall(spark, sf_dir, "src_ip is not null").groupBy("src_ip", (F.col("t_us") - F.pmod("t_us", F.lit(60_000_000))).alias("minute_us")).agg(F.count("*").alias("n"))
    return w.where("n > 2").withColumn("refused", F.greatest(F.col("n") - 5, F.lit(0)))


@R.query(f"with {EV} select event_id, t_us, anomaly_score from ev order by t_us desc, event_id limit 100")
def recent_activity(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "t_us", "anomaly_score").orderBy(F.desc("t_us"), "event_id").limit(100)


@R.query(f"""with {EV}, {FW}, u as (select event_type as kind, count(*) as n from ev group by 1 union all select 'fw_' || lower(fw_action), count(*) from fw group by 1) select * from u""")
def union_sources(spark, sf_dir: str) -> DataFrame:
    """Events of all sources as one table: firewall records become events with tags, description and the record as metadata."""
    both = events(spark, sf_dir).select("event_type").unionByName(firewall_as_events(firewall(spark, sf_dir)).withColumn("event_type", F.concat(F.lit("fw_"), F.lower("fw_action"))), allowMissingColumns=True)
    return both.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


def firewall_as_events(fw: DataFrame) -> DataFrame:
    """Firewall records as events: tags, a description, and the record itself as metadata."""
    stopped = F.lower("fw_action").isin("block", "drop", "reject")
    return fw.select(
        F.concat(F.lit("fw-"), "fw_id").alias("event_id"), "t_us", F.lit("firewall_log").alias("event_type"), "fw_action", F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("resolved_ip"),
        F.when(stopped, F.array(F.lit("firewall"), F.lit("blocked"))).otherwise(F.array(F.lit("firewall"))).alias("tags"),
        F.concat_ws(" ", F.upper("fw_action"), "proto", F.concat_ws(":", "src_ip", "src_port"), F.lit("->"), F.concat_ws(":", "dst_ip", "dst_port"), "rule_name").alias("threat_desc"),
        F.to_json(F.struct(*[c for c in fw.columns if c not in ("ts", "t_us")])).alias("metadata"),
    )


@R.query(f"""with {FW} select 'fw-' || fw_id as event_id, t_us, case when lower(fw_action) in ('block', 'drop', 'reject') then 'firewall;blocked' else 'firewall' end as tags,
 concat_ws(' ', upper(fw_action), proto, concat_ws(':', src_ip, src_port), '->', concat_ws(':', dst_ip, dst_port), rule_name) as threat_desc from fw""")
def firewall_events_view(spark, sf_dir: str) -> DataFrame:
    return firewall_as_events(firewall(spark, sf_dir)).select("event_id", "t_us", F.array_join("tags", ";").alias("tags"), "threat_desc")


QUERIES, SQL = R.QUERIES, R.SQL
