"""Rules that suppress or allow events, disposition, grouping of near duplicates, echoes of a gateway."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions.net import is_gateway
from siftnet.operators.detect import rows, sql_rows
from siftnet.plans.base import EV, Registry, events
from siftnet.plans.fixtures import ALLOWED, SUPPRESSIONS

R = Registry()

_SUP = "rule_id string, r_domain string, r_ip string, r_tags array<string>, active boolean, created int"
_ALW = "rule_id string, r_domain string, r_ip string, r_tag string, enabled boolean"


def glob_regex(pattern: Column) -> Column:
    """A glob in a column as a regular expression, for patterns that aren't constant; ``*`` matches anything, ``?`` stays a quantifier, everything else is literal, letter case doesn't count."""
    literal = F.regexp_replace(pattern, r"([.+^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?is)^"), F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("$"))


def sql_glob(p: str) -> str:
    """A glob as a regular expression: ``*`` matches anything, ``?`` stays a quantifier, everything else is literal; letter case shall not count."""
    return "^" + re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", p).replace("*", ".*") + "$"


#: Up to so many rules are evaluated as one expression over each event, without any join.
LITERAL_RULES = 200


def _few(rules: DataFrame, most: int) -> list | None:
    """The rules of a table, or ``None`` if there are more than ``most``."""
    got = rules.limit(most + 1).collect()
    return got if len(got) <= most else None


def _suppresses(r) -> Column:
    hit = F.lit(True)
    if r.r_domain:
        hit &= F.col("domain") == r.r_domain
    if r.r_ip:
        hit &= F.col("source_ip") == r.r_ip
    for t in r.r_tags or []:
        hit &= F.array_contains("tags", t)
    return F.coalesce(hit, F.lit(False))


def suppressed_by(ev: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule_id`` of the newest active rule all of whose criteria hold; a rule without criteria holds always.

    Few rules are one expression. More are joined by equality: those with a name by
    it, others with an address by that, others by their first tag; the newest
    without any criterion is a constant.
    """
    active = rules.where("active").select("rule_id", F.nullif("r_domain", F.lit("")).alias("r_domain"), F.nullif("r_ip", F.lit("")).alias("r_ip"), F.coalesce("r_tags", F.array().cast("array<string>")).alias("r_tags"), "created")
    few = _few(active, LITERAL_RULES)
    if few is not None:
        newest = sorted(few, key=lambda r: (r.created, r.rule_id), reverse=True)
        return ev.withColumn("rule_id", F.coalesce(*(F.when(_suppresses(r), F.lit(r.rule_id)) for r in newest), F.lit(None).cast("string")))
    always = active.where("r_domain is null and r_ip is null and size(r_tags) = 0").agg(F.max(F.struct("created", "rule_id")).alias("r")).first().r
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    left = ev.select("event_id", "domain", "source_ip", tags.alias("tags"))
    holds = lambda j: j.where("(r_ip is null or source_ip = r_ip) and size(array_except(r_tags, tags)) = 0").select("event_id", "created", "rule_id")
    by_name = holds(left.join(active.where("r_domain is not null"), F.col("domain") == F.col("r_domain")))
    by_ip = holds(left.join(active.where("r_domain is null and r_ip is not null"), F.col("source_ip") == F.col("r_ip")))
    by_tag = holds(left.withColumn("t", F.explode(F.array_distinct("tags"))).join(active.where("r_domain is null and r_ip is null and size(r_tags) > 0").withColumn("t", F.col("r_tags")[0]), "t"))
    best = by_name.unionByName(by_ip).unionByName(by_tag).groupBy("event_id").agg(F.max(F.struct("created", "rule_id")).alias("best"))
    known = F.struct(F.lit(always.created).alias("created"), F.lit(always.rule_id).alias("rule_id")) if always else F.lit(None).cast("struct<created: int, rule_id: string>")
    return ev.join(best, "event_id", "left").withColumn("rule_id", F.greatest("best", known)["rule_id"]).drop("best")


#: Allow rules are globs, which no equality join finds: a larger table than this is refused.
MOST_ALLOWED = 2000


def allowed(rules: DataFrame) -> Column:
    """Whether an allow rule holds for an event: all enabled rules as one condition, each pattern compiled once."""
    few = _few(rules.where("enabled"), MOST_ALLOWED)
    if few is None:
        raise ValueError(f"allow rules must be a table of at most {MOST_ALLOWED}")

    def holds(r) -> Column:
        hit = F.lit(True)
        for pattern, value in ((r.r_domain, "domain"), (r.r_ip, "source_ip")):
            if pattern is not None:
                hit &= (F.coalesce(F.col(value), F.lit("")) != "") & F.col(value).rlike("(?is)" + sql_glob(pattern))
        if r.r_tag is not None:
            hit &= F.array_contains("tags", r.r_tag)
        return F.coalesce(hit, F.lit(False))

    return reduce(lambda a, b: a | b, (holds(r) for r in few), F.lit(False))


_SUP_SQL = f"sup as (select * from {sql_rows(SUPPRESSIONS, 'rule_id, r_domain, r_ip, r_tags, active, created')})"
_SUP_HIT = "s.active and (coalesce(s.r_domain, '') = '' or e.domain = s.r_domain) and (coalesce(s.r_ip, '') = '' or e.source_ip = s.r_ip) and list_has_all(coalesce(e.tags, []), s.r_tags)"
_ALW_SQL = f"alw as (select * from {sql_rows([(i, sql_glob(d) if d else None, sql_glob(p) if p else None, t, e) for i, d, p, t, e in ALLOWED], 'rule_id, r_domain, r_ip, r_tag, enabled')})"
_ALW_HIT = "a.enabled and (a.r_domain is null or coalesce(regexp_matches(e.domain, a.r_domain, 'i'), false)) and (a.r_ip is null or coalesce(regexp_matches(e.source_ip, a.r_ip, 'i'), false)) and (a.r_tag is null or list_contains(e.tags, a.r_tag))"


@R.query(f"with {EV}, {_SUP_SQL} select event_id from ev e where not exists (select 1 from sup s where {_SUP_HIT})")
def suppress_anti(spark, sf_dir: str) -> DataFrame:
    """Events that no rule suppresses."""
    ev = events(spark, sf_dir)
    return suppressed_by(ev.select("event_id", "domain", "source_ip", "tags"), rows(ev, SUPPRESSIONS, _SUP)).where("rule_id is null").select("event_id")


@R.query(f"with {EV}, {_ALW_SQL} select event_id from ev e where not exists (select 1 from alw a where {_ALW_HIT})")
def allow_anti(spark, sf_dir: str) -> DataFrame:
    """Events that no rule allows."""
    return events(spark, sf_dir, ~allowed(spark.createDataFrame(ALLOWED, _ALW))).select("event_id")


@R.query(f"with {EV}, {_ALW_SQL} select count(*) as hidden from ev e where exists (select 1 from alw a where {_ALW_HIT})")
def allow_hits(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir, allowed(spark.createDataFrame(ALLOWED, _ALW))).agg(F.count("*").alias("hidden"))


@R.query(f"with {EV}, {_SUP_SQL}, x as (select e.event_id, e.acknowledged, e.ack_reason, arg_max(s.rule_id, s.created) as rule_id from ev e left join sup s on {_SUP_HIT} group by all) select case when acknowledged then 'acknowledged' when rule_id is not null then 'suppressed' else 'active' end as state, coalesce(case when acknowledged then ack_reason else rule_id end, '') as why, count(*) as n from x group by all")
def disposition(spark, sf_dir: str) -> DataFrame:
    """Events by state and its reason; an acknowledgement comes before a rule."""
    ev = events(spark, sf_dir)
    e = suppressed_by(ev.select("event_id", "domain", "source_ip", "tags", "acknowledged", "ack_reason"), rows(ev, SUPPRESSIONS, _SUP))
    state = F.when(F.col("acknowledged"), "acknowledged").when(F.col("rule_id").isNotNull(), "suppressed").otherwise("active")
    return e.groupBy(state.alias("state"), F.coalesce(F.when(F.col("acknowledged"), F.col("ack_reason")).otherwise(F.col("rule_id")), F.lit("")).alias("why")).agg(F.count("*").alias("n"))


_MEMBERS = "k string, t_us bigint, event_id string, lead_us bigint, lead_id string"


def _anchored(width_us: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, lead_id = None, 0, None
        for b in batches:
            keys, us, ids = b.column("k").to_pylist(), np.asarray(b.column("t_us")).tolist(), b.column("event_id").to_pylist()
            leads, lead_ids = [], []
            for k, t, i in zip(keys, us, ids):
                if k != key or lead - t >= width_us:
                    key, lead, lead_id = k, t, i
                leads.append(lead)
                lead_ids.append(lead_id)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leads, pa.int64()), pa.array(lead_ids, pa.string())], names=[c.split()[0] for c in _MEMBERS.split(", ")])

    return work


def group_members(ev: DataFrame, key: Column, width_us: int = 300_000_000) -> DataFrame:
    """Every event with the lead of its group: events with the same key less than ``width_us`` before the lead, which is the latest.

    A group is anchored at its lead, so that it is no session, and where one begins
    depends on all before. The ordered rows stream through, and only the lead is held;
    a hot key is one task that costs time and no memory.
    """
    slim = ev.select(key.alias("k"), "t_us", "event_id").where("k is not null and t_us is not null")
    return slim.repartition("k").sortWithinPartitions("k", F.desc("t_us"), "event_id").mapInArrow(_anchored(width_us), _MEMBERS)


def group_near(ev: DataFrame, key: Column, width_us: int = 300_000_000) -> DataFrame:
    """The groups of ``group_members``: ``k``, ``lead_us``, ``last_us``, ``lead_id``, ``n``."""
    return group_members(ev, key, width_us).groupBy("k", "lead_us", "lead_id").agg(F.min("t_us").alias("last_us"), F.count("*").alias("n")).select("k", "lead_us", "last_us", "lead_id", "n")


def near_key() -> Column:
    """What near duplicates have in common: name, address and set of tags."""
    return F.to_json(F.struct("domain", "source_ip", F.array_sort("tags").alias("tags")))


#: Leads are found one after the other, each from the one before.
_NEAR_SQL = f"""with recursive {EV}, e as (select concat_ws('|', coalesce(domain, '~'), coalesce(source_ip, '~'), coalesce(array_to_string(list_sort(tags), ','), '~')) as k, t_us, event_id from ev where t_us is not null),
 ld as (select k, max(t_us) as lead_us from e group by k union all select e.k, max(e.t_us) from ld join e on e.k = ld.k and e.t_us <= ld.lead_us - 300000000 group by e.k, ld.lead_us),
 w as (select k, lead_us from ld), m as (select w.k, w.lead_us, e.t_us, e.event_id, min(case when e.t_us = w.lead_us then e.event_id end) over (partition by w.k, w.lead_us) as lead_id from w join e on e.k = w.k and e.t_us <= w.lead_us and e.t_us > w.lead_us - 300000000)"""


@R.query(_NEAR_SQL + " select lead_us, min(t_us) as last_us, lead_id, count(*) as n from m group by lead_us, lead_id, k")
def near_dup_groups(spark, sf_dir: str) -> DataFrame:
    """Groups of near duplicates, each named by its lead."""
    return group_near(events(spark, sf_dir), near_key()).drop("k")


@R.query(_NEAR_SQL + " select event_id, lead_id, lead_us from m")
def near_dup_members(spark, sf_dir: str) -> DataFrame:
    """Every event with the lead of its group of near duplicates (AGG-10)."""
    return group_members(events(spark, sf_dir), near_key()).select("event_id", "lead_id", "lead_us")


@R.query(_NEAR_SQL + " select lead_id, lead_us, count(*) as n from m group by lead_us, lead_id, k order by lead_us desc, lead_id limit 30")
def near_dup_page(spark, sf_dir: str) -> DataFrame:
    """The first 30 groups, the latest first (ORD-07)."""
    return group_near(events(spark, sf_dir), near_key()).orderBy(F.desc("lead_us"), "lead_id").limit(30).select("lead_id", "lead_us", "n")


def echo_dedup(ev: DataFrame, batch_us: int = 10_000_000, within_us: int = 2_000_000) -> DataFrame:
    """One event for each question that a gateway repeats.

    Events of a batch with the same name and type that all lie within ``within_us``
    become one: the last that isn't from a gateway, else the first, tagged as such.
    Aggregated, not ordered, so that no batch is ever held.
    """
    key = ["batch", "domain", "query_type"]
    e = ev.where("domain is not null and t_us is not null").withColumn("batch", F.expr(f"t_us - pmod(t_us, {batch_us}L)")).withColumn("gw", is_gateway("source_ip"))
    g = e.groupBy(*key).agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"), F.count("*").alias("n"), F.max(F.when(~F.col("gw"), F.struct("t_us", "event_id"))).alias("device"), F.min(F.struct("t_us", "event_id")).alias("first"))
    folded = g.where((F.col("n") > 1) & (F.col("b") - F.col("a") <= within_us)).select(F.coalesce("device", "first")["event_id"].alias("event_id"), *key, "n")
    k = folded.select(*[F.col(c).alias(f"k_{c}") for c in key], F.col("event_id").alias("kept_id"), "n")
    same = (F.col("batch") == F.col("k_batch")) & (F.col("domain") == F.col("k_domain")) & F.col("query_type").eqNullSafe(F.col("k_query_type"))
    return e.join(k, same, "left").where("kept_id is null or kept_id = event_id").select("event_id", F.coalesce("n", F.lit(1)).alias("n"), F.col("kept_id").isNotNull().alias("deduplicated"))


@R.query(rf"""with {EV}, e as (select event_id, t_us, t_us - t_us % 10000000 as batch, domain, query_type, coalesce(regexp_full_match(source_ip, '[0-9]+\.[0-9]+\.[0-9]+\.(1|254)'), false) as gw from ev where domain is not null),
 w as (select *, min(t_us) over p as a, max(t_us) over p as b, count(*) over p as c, row_number() over (partition by batch, domain, query_type order by gw, case when gw then t_us else -t_us end, case when gw then event_id end, event_id desc) as rn from e window p as (partition by batch, domain, query_type))
 select event_id, case when c > 1 and b - a <= 2000000 then c else 1 end as n, c > 1 and b - a <= 2000000 as deduplicated from w where not (c > 1 and b - a <= 2000000) or rn = 1""")
def echo_dedup_events(spark, sf_dir: str) -> DataFrame:
    return echo_dedup(events(spark, sf_dir).select("event_id", "t_us", "domain", "query_type", "source_ip"))


QUERIES, SQL = R.QUERIES, R.SQL
