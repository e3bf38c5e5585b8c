"""Analytics over many reporting nodes: volumes and reputation of names, trust in nodes, validation of batches, feeds.

The nodes are the sources of the events here, their networks are ``geo``; known
bad and popular names stand for the ground truth and the popularity list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions import domain as D
from siftnet.operators.ordered import numbered
from siftnet.operators.series import hour_of
from siftnet.plans.base import EV, FW, Registry, events, firewall, stored_rows
from siftnet.plans.fixtures import ALLOWED_DOMAINS, FAMILIES
from siftnet.session import materialize
from siftnet.sources.logs import parse_eve
from siftnet.tables import load

R = Registry()
HOUR, DAY = 3_600_000_000, 86_400_000_000


def partials(ev: DataFrame, step_us: int) -> DataFrame:
    """Partial states of a name and time step that can be merged: sums, counts, greatest values, sketches and the set of tags."""
    e = ev.where("domain is not null")
    return e.groupBy("domain", hour_of("t_us", step_us).alias("b_us")).agg(
        F.count("*").alias("n"), F.sum("anomaly_score").alias("score_sum"), F.max("anomaly_score").alias("score_max"), F.min("anomaly_score").alias("score_min"), F.count_if("blocked").alias("blocked"),
        F.hll_sketch_agg("source_hash").alias("nodes"), F.hll_sketch_agg(F.coalesce("geo", F.lit("?"))).alias("nets"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"),
    )


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Partial states of coarser groups."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("score_sum").alias("score_sum"), F.max("score_max").alias("score_max"), F.min("score_min").alias("score_min"), F.sum("blocked").alias("blocked"),
        F.hll_union_agg("nodes").alias("nodes"), F.hll_union_agg("nets").alias("nets"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"),
    )


@R.query(f"""with {EV}, e as (select *, t_us - t_us % 3600000000 as h_us from ev where domain is not null), t as (select domain, h_us, string_agg(distinct tag, ';' order by tag) as tags from (select domain, h_us, unnest(tags) as tag from e) group by 1, 2)
 select e.domain, e.h_us, count(*) as n, count(distinct source_hash) as nodes, count(distinct geo) as nets, round(avg(anomaly_score), 9) as mean, max(anomaly_score) as top, count(*) filter (blocked) as blocked, coalesce(any_value(t.tags), '') as tags from e left join t on e.domain = t.domain and e.h_us = t.h_us group by e.domain, e.h_us""")
def reputation_hourly(spark, sf_dir: str) -> DataFrame:
    """Hourly reports of names, counted exactly."""
    e = events(spark, sf_dir, named=True)
    return e.groupBy("domain", hour_of().alias("h_us")).agg(
        F.count("*").alias("n"), F.countDistinct("source_hash").alias("nodes"), F.countDistinct("geo").alias("nets"), F.round(F.avg("anomaly_score"), 9).alias("mean"), F.max("anomaly_score").alias("top"), F.count_if("blocked").alias("blocked"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), ";").alias("tags"),
    )


@R.query(f"""with {EV}, t as (select domain, t_us - t_us % 86400000000 as d_us, count(distinct tag) as n_tags from (select domain, t_us, unnest(tags) as tag from ev where domain is not null) group by 1, 2),
 g as (select domain, t_us - t_us % 86400000000 as d_us, count(*) as n, round(sum(anomaly_score) / count(*), 6) as mean, max(anomaly_score) as score_max, count(*) filter (blocked) as blocked from ev where domain is not null group by 1, 2)
 select g.domain, g.d_us, n, mean, score_max, blocked, coalesce(n_tags, 0)::int as n_tags, true as near from g left join t on g.domain = t.domain and g.d_us = t.d_us""")
def reputation_near(spark, sf_dir: str) -> DataFrame:
    """The days of ``reputation_merged``, and whether its counts of nodes are within a twentieth (or one) of the exact ones."""
    exact = events(spark, sf_dir, named=True).groupBy("domain", hour_of("t_us", DAY).alias("d_us")).agg(F.countDistinct("source_hash").alias("exact"))
    near = F.abs(F.col("nodes") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return reputation_merged(spark, sf_dir).join(exact, ["domain", "d_us"]).select("domain", "d_us", "n", "mean", "score_max", "blocked", "n_tags", near.alias("near"))


@R.query()
def reputation_merged(spark, sf_dir: str) -> DataFrame:
    """The same by day, from hourly partial states with sketches."""
    m = merged(partials(events(spark, sf_dir), HOUR).withColumn("d_us", hour_of("b_us", DAY)), "domain", "d_us")
    return m.select("domain", "d_us", "n", F.hll_sketch_estimate("nodes").alias("nodes"), F.hll_sketch_estimate("nets").alias("nets"), F.round(F.col("score_sum") / F.col("n"), 6).alias("mean"), "score_max", "blocked", F.size("tags").alias("n_tags"))


def ranked_reputation(ev: DataFrame, mean: float = 0.5, nodes: int = 3, most: int = 50) -> DataFrame:
    """Names that several nodes report with a mean score of ``mean`` at least, the most and surest first."""
    g = ev.groupBy("domain").agg(F.countDistinct("source_hash").alias("nodes"), F.avg("anomaly_score").alias("m")).where((F.col("nodes") >= nodes) & (F.col("m") >= mean))
    return g.select("domain", "nodes", F.round("m", 9).alias("mean"), F.round(F.col("m") * F.log(F.col("nodes") + 1), 6).alias("rank")).orderBy(F.desc("rank"), "domain").limit(most)


_RANKED = """with {EV}, g as (select domain, count(distinct source_hash) as nodes, avg(anomaly_score) as mean, count(*) as n from ev where domain is not null group by domain having count(distinct source_hash) >= 3 and avg(anomaly_score) >= {mean})
 select domain, nodes, round(mean, 9) as mean, round(mean * ln(nodes + 1), 6) as rank from g order by rank desc, domain limit 50"""


@R.query(_RANKED.replace("{EV}", EV).replace("{mean}", "0.15"))
def top_reputation(spark, sf_dir: str) -> DataFrame:
    """Names that several nodes report, with a low limit that these tables reach."""
    return ranked_reputation(events(spark, sf_dir, named=True), 0.15)


@R.query(_RANKED.replace("{EV}", EV).replace("{mean}", "0.5"))
def worst_reputation(spark, sf_dir: str) -> DataFrame:
    """The same with the limit as surveyed (AGG-18)."""
    return ranked_reputation(events(spark, sf_dir, named=True))


@R.query(f"with {EV} select domain, t_us - t_us % 900000000 as b_us, count(*) as n, min(anomaly_score) as low, max(anomaly_score) as high, round(avg(anomaly_score), 9) as mean, count(distinct source_hash) as nodes from ev where domain is not null and anomaly_score > 0.1 group by 1, 2")
def reports_15min(spark, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir, "anomaly_score > 0.1", named=True)
    return e.groupBy("domain", hour_of("t_us", 900_000_000).alias("b_us")).agg(F.count("*").alias("n"), F.min("anomaly_score").alias("low"), F.max("anomaly_score").alias("high"), F.round(F.avg("anomaly_score"), 9).alias("mean"), F.countDistinct("source_hash").alias("nodes"))


@R.query(f"with {EV} select source_hash, t_us - t_us % 86400000000 as d_us, count(*) as n, count(distinct domain) as names, count(*) filter (anomaly_score > 0.5) as threats, round(avg(anomaly_score), 9) as mean from ev group by 1, 2")
def node_daily(spark, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("source_hash", hour_of("t_us", DAY).alias("d_us"))
    return g.agg(F.count("*").alias("n"), F.countDistinct("domain").alias("names"), F.count_if(F.col("anomaly_score") > 0.5).alias("threats"), F.round(F.avg("anomaly_score"), 9).alias("mean"))


@R.query(f"with {EV} select domain, sum(n)::bigint as n, max(n) as peak, count(*) as hours from (select domain, t_us - t_us % 3600000000 as h_us, count(*) as n from ev where domain is not null group by 1, 2) group by domain")
def volume_rollup(spark, sf_dir: str) -> DataFrame:
    """Volumes of names from their hourly sums."""
    h = events(spark, sf_dir, named=True).groupBy("domain", hour_of().alias("h_us")).agg(F.count("*").alias("n"))
    return h.groupBy("domain").agg(F.sum("n").alias("n"), F.max("n").alias("peak"), F.count("*").alias("hours"))


@R.query(f"with {EV} select event_type, count(*) as n, round(avg(anomaly_score), 9) as mean, max(anomaly_score) as top from ev group by event_type")
def detection_types(spark, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("anomaly_score"), 9).alias("mean"), F.max("anomaly_score").alias("top"))


@R.query(f"with {FW} select t_us - t_us % 86400000000 as d_us, proto, fw_action, count(*) as n, count(distinct src_ip) as sources, count(distinct rule_name) as rules from fw group by 1, 2, 3")
def ids_daily(spark, sf_dir: str) -> DataFrame:
    """Alerts by day, category and severity with distinct sources and signatures."""
    return firewall(spark, sf_dir).groupBy(hour_of("t_us", DAY).alias("d_us"), "proto", "fw_action").agg(F.count("*").alias("n"), F.countDistinct("src_ip").alias("sources"), F.countDistinct("rule_name").alias("rules"))


def alerts_daily(alerts: DataFrame) -> DataFrame:
    """Alerts of an intrusion detection system (as ``parse_eve`` gives them) by day, category and severity: count, distinct sources, distinct signatures."""
    day = F.date_format(F.try_to_timestamp("timestamp"), "yyyy-MM-dd")
    return alerts.groupBy(day.alias("day"), F.coalesce(F.get("tags", F.lit(1)), F.lit("")).alias("category"), "severity").agg(F.count("*").alias("n"), F.countDistinct("src_ip").alias("sources"), F.countDistinct("signature").alias("signatures"))


@R.query(f"with {FW} select strftime(make_timestamp(t_us), '%Y-%m-%d') as day, coalesce(proto, '') as category, cast(fw_id % 5 as int) as severity, count(*) as n, count(distinct src_ip) as sources, count(distinct rule_name) as signatures from fw where src_ip is not null group by 1, 2, 3")
def eve_daily(spark, sf_dir: str) -> DataFrame:
    """Daily sums of alert lines made of firewall records (AGG-24)."""
    alert = F.struct(F.col("rule_name").alias("signature"), F.col("proto").alias("category"), (F.col("fw_id") % 5).cast("int").alias("severity"))
    f = firewall(spark, sf_dir, "src_ip is not null")
    lines = f.select(F.to_json(F.struct(F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.lit("alert").alias("event_type"), "src_ip", alert.alias("alert"))).alias("line"))
    return alerts_daily(parse_eve(lines))


_SEVERITY = {"block": 1, "drop": 2, "reject": 3}


@R.query(f"with {FW}, s as (select src_ip, case lower(fw_action) when 'block' then 1 when 'drop' then 2 when 'reject' then 3 else 4 end as severity from fw where src_ip is not null) select src_ip, count(*) as n, min(severity) as worst from s where severity < 4 group by src_ip order by n desc, src_ip limit 20")
def ids_top_sources(spark, sf_dir: str) -> DataFrame:
    s = F.coalesce(F.create_map(*(F.lit(x) for kv in _SEVERITY.items() for x in kv))[F.lower("fw_action")], F.lit(4))
    f = firewall(spark, sf_dir, "src_ip is not null").withColumn("s", s).where("s < 4")
    return f.groupBy("src_ip").agg(F.count("*").alias("n"), F.min("s").alias("worst")).orderBy(F.desc("n"), "src_ip").limit(20)


@R.query(f"""with {EV}, d as (select domain, count(*) as n, count(distinct source_hash) as nodes from ev where domain is not null group by domain), f as (select *, {D.label_sql('domain')} as label, string_split(domain, '.') as p from d)
 select domain, n, nodes, length(domain) as chars, len(p) as labels, length(label) as label_chars, round({D.entropy_sql('label')}, 6) as entropy, round(length(regexp_replace(label, '[^0-9]', '', 'g')) / greatest(length(label), 1), 6) as digits from f""")
def domain_features(spark, sf_dir: str) -> DataFrame:
    """Features of distinct names; each is computed once per name."""
    d = events(spark, sf_dir, named=True).groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("source_hash").alias("nodes")).withColumn("label", D.effective_label(F.col("domain")))
    return d.select("domain", "n", "nodes", F.length("domain").alias("chars"), F.size(F.split("domain", r"\.")).alias("labels"), F.length("label").alias("label_chars"), F.round(D.entropy(F.col("label")), 6).alias("entropy"), F.round(F.regexp_count("label", F.lit("[0-9]")) / F.greatest(F.length("label"), F.lit(1)), 6).alias("digits"))


def sigmoid(c: Column, mid: float, steep: float) -> Column:
    return 1 / (1 + F.exp(-steep * (c - mid)))


_TRUTH = "truth as (select distinct domain from ev where list_contains(tags, 'known_bad') and domain is not null), popular as (select domain from ev where domain is not null group by domain order by count(*) desc, domain limit 100)"


def _truth(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = ev.where("domain is not null")
    return named.where(F.array_contains("tags", "known_bad")).select("domain").distinct(), named.groupBy("domain").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "domain").limit(100).select("domain")


REPORTED = 0.1


def activity(ev: DataFrame) -> DataFrame:
    """Sums by node, name, network and day, from which trust and reputation follow without the events: ``n``, ``reported`` and ``score_sum`` (of scores above 0.1), ``bad``, ``first_us``, ``last_us``."""
    over = F.col("anomaly_score") > REPORTED
    g = ev.groupBy("source_hash", "domain", "geo", hour_of("t_us", DAY).alias("d_us"))
    return g.agg(F.count("*").alias("n"), F.count_if(over).alias("reported"), F.sum(F.when(over, F.col("anomaly_score"))).alias("score_sum"), F.max(F.coalesce(F.array_contains("tags", "known_bad"), F.lit(False))).alias("bad"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def _truth_of(act: DataFrame) -> tuple[DataFrame, DataFrame]:
    named = act.where("domain is not null")
    return named.where("bad").select("domain").distinct(), named.groupBy("domain").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "domain").limit(100).select("domain")


def node_trust_of(act: DataFrame) -> DataFrame:
    """Trust of each node, from ``activity``: age, agreement with known truth, few reports on popular names, steady volume, weighted 0.25, 0.35, 0.15, 0.25."""
    truth, popular = _truth_of(act)
    rep = act.where("domain is not null and reported > 0").select("source_hash", "domain").distinct()
    marked = rep.join(truth.withColumn("bad", F.lit(1)), "domain", "left").join(popular.withColumn("pop", F.lit(1)), "domain", "left")
    agree = marked.groupBy("source_hash").agg(F.count("*").alias("names"), F.count("bad").alias("bad"), F.count(F.when(F.col("bad").isNull(), F.col("pop"))).alias("false"))
    by_day = act.groupBy("source_hash", "d_us").agg(F.sum("n").alias("n"), F.min("first_us").alias("a"), F.max("last_us").alias("b"))
    days = by_day.groupBy("source_hash").agg(((F.max("b") - F.min("a")) / DAY).alias("days"), F.coalesce(F.stddev_pop("n") / F.avg("n"), F.lit(0.0)).alias("cv"))
    j = days.join(agree, "source_hash", "left").na.fill(0)
    score = 0.25 * sigmoid(F.col("days"), 7.0, 0.3) + 0.35 * F.col("bad") / F.greatest(F.col("names"), F.lit(1)) + 0.15 * (1 - F.least(F.lit(1.0), 5 * F.col("false") / F.greatest(F.col("names"), F.lit(1)))) + 0.25 * (1 - F.least(F.lit(1.0), F.col("cv") / 2))
    return j.select("source_hash", score.alias("trust"), F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low").alias("tier"))


_TRUST = """rep as (select distinct source_hash, domain from ev where domain is not null and anomaly_score > 0.1),
 ag as (select source_hash, count(*) as names, count(t.domain) as bad, count(*) filter (t.domain is null and p.domain is not null) as fls from rep left join truth t using (domain) left join popular p using (domain) group by source_hash),
 age as (select source_hash, (max(t_us) - min(t_us)) / 86400000000.0::double as days from ev group by 1), dv as (select source_hash, coalesce(stddev_pop(n) / avg(n), 0) as cv from (select source_hash, t_us - t_us % 86400000000 as d, count(*) as n from ev group by 1, 2) group by 1),
 tr as (select age.source_hash, 0.25::double / (1 + exp(-0.3::double * (days - 7))) + 0.35::double * coalesce(bad, 0) / greatest(coalesce(names, 0), 1) + 0.15::double * (1 - least(1, 5 * coalesce(fls, 0) / greatest(coalesce(names, 0), 1))) + 0.25::double * (1 - least(1, cv / 2)) as trust from age join dv using (source_hash) left join ag using (source_hash))"""


@R.query(f"with {EV}, {_TRUTH}, {_TRUST} select source_hash, round(trust, 5) as trust, case when trust >= 0.7 then 'high' when trust >= 0.4 then 'medium' else 'low' end as tier from tr")
def node_trust(spark, sf_dir: str) -> DataFrame:
    return node_trust_of(materialize(activity(events(spark, sf_dir)), "activity")).withColumn("trust", F.round("trust", 5))


@R.query(f"""with {EV}, {_TRUTH}, {_TRUST}, r as (select domain, sum(trust * anomaly_score) / sum(trust) as s, count(distinct e.source_hash) as nodes, count(distinct geo) as nets, count(distinct t_us // 86400000000) as days from ev e join tr using (source_hash) where domain is not null and anomaly_score > 0.1 group by domain having count(distinct e.source_hash) >= 3 and count(distinct geo) >= 2)
 select domain, nodes, nets, round(least(0.40::double * s + 0.20::double * least(1, nodes / 20.0::double) + 0.25::double * least(1, nets / 5.0::double) + 0.15::double * least(1, days / 7.0::double), case when p.domain is not null then 0.1 else 1 end), 5) as reputation from r left join popular p using (domain)""")
def domain_reputation(spark, sf_dir: str) -> DataFrame:
    """Reputation of names that at least three nodes in two networks report, weighted by trust; popular names are capped. The events are read once, into ``activity``."""
    act = materialize(activity(events(spark, sf_dir)), "activity")
    _, popular = _truth_of(act)
    rep = act.where("domain is not null and reported > 0").join(node_trust_of(act).select("source_hash", "trust"), "source_hash")
    r = rep.groupBy("domain").agg((F.sum(F.col("trust") * F.col("score_sum")) / F.sum(F.col("trust") * F.col("reported"))).alias("s"), F.countDistinct("source_hash").alias("nodes"), F.countDistinct("geo").alias("nets"), F.countDistinct("d_us").alias("days")).where("nodes >= 3 and nets >= 2")
    part = lambda c, most: F.least(F.lit(1.0), F.col(c) / most)
    score = 0.40 * F.col("s") + 0.20 * part("nodes", 20.0) + 0.25 * part("nets", 5.0) + 0.15 * part("days", 7.0)
    j = r.join(popular.withColumn("p", F.lit(0.1)), "domain", "left")
    return j.select("domain", "nodes", "nets", F.round(F.least(score, F.coalesce("p", F.lit(1.0))), 5).alias("reputation"))


@R.query(f"""with {EV}, {_TRUTH}, b as (select source_hash, t_us - t_us % 3600000000 as h_us, count(*) as n, count(distinct case when p.domain is not null and anomaly_score > 0.1 then p.domain end) as pop from ev left join popular p using (domain) group by 1, 2)
 select source_hash, h_us, n, case when n > 50 then 'rejected' when n > 20 then 'flagged' when pop > 5 then 'popular' else 'accepted' end as verdict, case when n > 50 then 0 when n > 20 then 0.9 when pop > 5 then 0.7 else 1 end::double as factor from b where n > 10""")
def batch_validation(spark, sf_dir: str) -> DataFrame:
    """Hourly batches of more than 10 reports: more than 50 are refused, more than 20 lower the node's trust, as do reports on popular names. The surveyed limits are those of ``batch_verdicts``."""
    ev = events(spark, sf_dir)
    _, popular = _truth(ev)
    b = ev.join(popular.withColumn("p", F.lit(1)), "domain", "left").groupBy("source_hash", hour_of().alias("h_us")).agg(F.count("*").alias("n"), F.countDistinct(F.when((F.col("p") == 1) & (F.col("anomaly_score") > 0.1), F.col("domain"))).alias("pop")).where("n > 10")
    v = F.when(F.col("n") > 50, "rejected").when(F.col("n") > 20, "flagged").when(F.col("pop") > 5, "popular").otherwise("accepted")
    return b.select("source_hash", "h_us", "n", v.alias("verdict"), F.when(F.col("n") > 50, 0.0).when(F.col("n") > 20, 0.9).when(F.col("pop") > 5, 0.7).otherwise(1.0).alias("factor"))


def validated(ev: DataFrame, popular: DataFrame, most: int = 500, flags: int = 100, poisoned: int = 5) -> DataFrame:
    """Every hourly batch of nodes: more than ``most`` events are refused; more than ``flags`` flagged ones (score above 0.5), and more than ``poisoned`` flagged ones of popular names, lower the node's trust, both together if both hold."""
    bad = F.col("anomaly_score") > 0.5
    b = ev.join(popular.select("domain", F.lit(True).alias("p")), "domain", "left").groupBy("source_hash", hour_of().alias("h_us")).agg(F.count("*").alias("n"), F.count_if(bad).alias("flagged"), F.count_if(bad & F.col("p")).alias("pop"))
    over, many, pop = F.col("n") > most, F.col("flagged") > flags, F.col("pop") > poisoned
    factor = F.when(over, 0.0).otherwise(F.when(many, 0.9).otherwise(1.0) * F.when(pop, 0.7).otherwise(1.0))
    return b.select("source_hash", "h_us", "n", "flagged", "pop", F.when(over, "rejected").when(many, "flagged").when(pop, "popular").otherwise("accepted").alias("verdict"), F.round(factor, 6).alias("factor"))


@R.query(f"""with {EV}, {_TRUTH}, b as (select source_hash, t_us - t_us % 3600000000 as h_us, count(*) as n, count(*) filter (anomaly_score > 0.5) as flagged, count(*) filter (anomaly_score > 0.5 and p.domain is not null) as pop from ev left join popular p using (domain) group by 1, 2)
 select source_hash, h_us, n, flagged, pop, case when n > 500 then 'rejected' when flagged > 100 then 'flagged' when pop > 5 then 'popular' else 'accepted' end as verdict, round(case when n > 500 then 0 else case when flagged > 100 then 0.9::double else 1 end * case when pop > 5 then 0.7::double else 1 end end, 6) as factor from b""")
def batch_verdicts(spark, sf_dir: str) -> DataFrame:
    """Every batch by the limits as surveyed (SCA-33)."""
    ev = events(spark, sf_dir)
    return validated(ev, _truth(ev)[1])


@R.query(f"with {EV}, {_TRUTH} select count(distinct e.domain) as known_names, count(*) as reports from ev e join truth using (domain)")
def truth_overlap(spark, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.join(_truth(ev)[0], "domain").agg(F.countDistinct("domain").alias("known_names"), F.count("*").alias("reports"))


@R.query(f"with {EV}, {_TRUTH} select event_id from ev where domain is not null and domain not in (select domain from popular) and not ends_with(domain, '.example.net') and domain <> 'example.net'")
def allow_list(spark, sf_dir: str) -> DataFrame:
    """Events of names that are neither popular nor below an allowed domain."""
    ev = events(spark, sf_dir, named=True).select("event_id", "domain")
    _, popular = _truth(ev.withColumn("tags", F.lit(None).cast("array<string>")))
    below = reduce(lambda a, b: a | b, (F.col("domain").endswith("." + d) | (F.col("domain") == d) for d in ALLOWED_DOMAINS), F.lit(False))
    return ev.join(popular, "domain", "left_anti").where(~below).select("event_id")


def popularity(names: DataFrame, ranking: DataFrame, exact: int = 100_000, domains: int = 10_000, below: list[str] | None = None) -> DataFrame:
    """Distinct names with ``reason``: why a name is too popular to be a threat (``exact``: among the first names, ``registered``: below one of the first domains, ``network``: below a delivery network), or null. ``ranking`` has ``domain`` and ``rank``."""
    parent = F.array_join(F.slice(F.split("domain", r"\."), -2, 2), ".")
    n = names.select("domain").where("domain is not null").distinct().withColumn("parent", parent)
    first = ranking.where(F.col("rank") <= exact).select("domain").distinct().withColumn("__exact", F.lit(True))
    own = ranking.where(F.col("rank") <= domains).select(parent.alias("parent")).distinct().withColumn("__registered", F.lit(True))
    net = reduce(lambda a, b: a | b, ((F.col("domain") == d) | F.col("domain").endswith("." + d) for d in below or []), F.lit(False))
    reason = F.when(F.col("__exact"), "exact").when(F.col("__registered"), "registered").when(net, "network")
    return n.join(first, "domain", "left").join(own, "parent", "left").select("domain", reason.alias("reason"))


@R.query(f"""with {EV}, c as (select domain, count(*) as n from ev where domain is not null group by domain), r as (select domain, row_number() over (order by n desc, domain) as rank from c), p as (select domain, array_to_string(string_split(domain, '.')[-2:], '.') as parent from c)
 select domain, case when domain in (select domain from r where rank <= 100) then 'exact' when parent in (select array_to_string(string_split(domain, '.')[-2:], '.') from r where rank <= 3) then 'registered' when domain = 'example.net' or ends_with(domain, '.example.net') then 'network' end as reason from p""")
def popular_names(spark, sf_dir: str) -> DataFrame:
    """Names by the three tiers of popularity (FLT-24), with low limits; the ranking is the table's own."""
    top = materialize(events(spark, sf_dir, named=True).groupBy("domain").agg(F.count("*").alias("n")), "names")
    ranking = top.orderBy(F.desc("n"), "domain").limit(100).select("domain", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "domain")).alias("rank"))
    return popularity(top, ranking, 100, 3, ALLOWED_DOMAINS)


_ALERT = [(0.85, "critical"), (0.70, "high"), (0.50, "medium"), (0.30, "low")]


@R.query(f"with {EV} select case when anomaly_score >= 0.85 then 'critical' when anomaly_score >= 0.7 then 'high' when anomaly_score >= 0.5 then 'medium' when anomaly_score >= 0.3 then 'low' else 'none' end as band, count(*) as n from ev group by 1")
def alert_bands(spark, sf_dir: str) -> DataFrame:
    band = F.lit("none")
    for least, name in reversed(_ALERT):
        band = F.when(F.col("anomaly_score") >= least, name).otherwise(band)
    return events(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def hosts_line(c: Column) -> Column:
    """A line of a hosts file that blocks a name."""
    return F.concat(F.lit("0.0.0.0 "), c)


@R.query(f"with {EV}, {_TRUTH} select '0.0.0.0 ' || domain as line from truth")
def feed_hostfile(spark, sf_dir: str) -> DataFrame:
    return _truth(events(spark, sf_dir))[0].select(hosts_line(F.col("domain")).alias("line"))


@R.query(f"""with {EV}, x as (select source_hash, t_us, event_id, row_number() over (partition by source_hash, resolved_ip order by t_us, event_id) as rn, resolved_ip from ev where resolved_ip is not null) select source_hash, resolved_ip, event_id, rn from x where rn % 10 = 0""")
def every_tenth_flow(spark, sf_dir: str) -> DataFrame:
    """Every tenth event of a source and destination."""
    ev = events(spark, sf_dir, "resolved_ip is not null").select("source_hash", "resolved_ip", "event_id", "t_us")
    return numbered(ev, ["source_hash", "resolved_ip"], ["t_us", "event_id"], at_most=stored_rows(spark, sf_dir)).where("rn % 10 = 0").select("source_hash", "resolved_ip", "event_id", F.col("rn").cast("int").alias("rn"))


@R.query(f"""with {EV}, s as (select domain, array_to_string(string_split(domain, '.')[1:greatest(len(string_split(domain, '.')) - 2, 0)], '') as sub from (select distinct domain from ev where domain is not null))
 select domain, round(case when length(sub) = 0 then 0 else (length(regexp_replace(sub, '[^0-9a-f]', '', 'g')) / length(sub) + length(regexp_replace(sub, '[^0-9]', '', 'g')) / length(sub)) / 2 end, 6) as encoding from s""")
def encoding_scores(spark, sf_dir: str) -> DataFrame:
    """How much of a name's sub-domain looks encoded: its shares of hexadecimal characters and of digits."""
    p = F.split("domain", r"\.")
    s = events(spark, sf_dir, named=True).select("domain").distinct().withColumn("sub", F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 2, F.lit(0))), ""))
    share = lambda r: F.regexp_count("sub", F.lit(r)) / F.length("sub")
    return s.select("domain", F.round(F.when(F.length("sub") == 0, 0.0).otherwise((share("[0-9a-f]") + share("[0-9]")) / 2), 6).alias("encoding"))


def family_of(tags: Column, families: list[str]) -> Column:
    """The first tag that names a known malware family, in any letter case."""
    return F.lower(F.get(F.filter(tags, lambda t: F.lower(t).isin([f.lower() for f in families])), F.lit(0)))


@R.query("""select entry_id, case when lower(malware) in ('grelbot', 'tinnet', 'ombrel') then lower(malware) end as family from (select distinct entry_id, malware from feodo_entries)""")
def malware_family(spark, sf_dir: str) -> DataFrame:
    """The family of each entry of the feed."""
    f = load(spark, sf_dir, "feodo_entries").select("entry_id", F.array(F.lit("c2"), F.col("malware")).alias("tags")).distinct()
    return f.select("entry_id", family_of(F.col("tags"), FAMILIES).alias("family"))


QUERIES, SQL = R.QUERIES, R.SQL
