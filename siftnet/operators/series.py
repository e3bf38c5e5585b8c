"""Windows over ordered events: spikes, regularity, baselines, changes, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.operators.ordered import order_statistics, quantile, quantile_ranks, with_previous
from siftnet.plans.base import EV, HOSTS, Registry, deliveries, events, hosts, now_us, stored_rows
from siftnet.session import materialize
from siftnet.tables import pack_hex

R = Registry()
HOUR, DAY = 3_600_000_000, 86_400_000_000


def hour_of(c: str = "t_us", step: int = HOUR) -> Column:
    return F.col(c) - F.pmod(F.col(c), F.lit(step))


def hourly(ev: DataFrame) -> DataFrame:
    """Hourly volume of names; everything after this works on the sums."""
    return ev.where("domain is not null").groupBy("domain", hour_of().alias("h_us")).agg(F.count("*").alias("n"), F.countDistinct("source_hash").alias("nodes"), F.sum("anomaly_score").alias("score_sum"), F.max("anomaly_score").alias("score_max"), F.count_if("blocked").alias("blocked"))


HOURLY = "hr as (select domain, t_us - t_us % 3600000000 as h_us, count(*) as n, count(distinct source_hash) as nodes, sum(anomaly_score) as score_sum, max(anomaly_score) as score_max, count(*) filter (blocked) as blocked from ev where domain is not null group by 1, 2)"


@R.query(f"""with {EV}, {HOURLY}, w as (select *, avg(n) over (partition by domain order by h_us rows between 24 preceding and 1 preceding) as mean from hr)
 select domain, h_us, n, round(n / greatest(coalesce(mean, 0), 1), 6) as spike from w where nodes >= 2 and n / greatest(coalesce(mean, 0), 1) > 3 order by spike desc, n desc, domain, h_us limit 100""")
def spike_trailing(spark, sf_dir: str) -> DataFrame:
    """Hours of all time in which a name is asked for more than three times its mean over the 24 rows before, where none counts as 1; the top 100. Those of now are ``spike_emerging``."""
    w = Window.partitionBy("domain").orderBy("h_us").rowsBetween(-24, -1)
    s = hourly(events(spark, sf_dir, named=True)).withColumn("spike", F.round(F.col("n") / F.greatest(F.coalesce(F.avg("n").over(w), F.lit(0.0)), F.lit(1.0)), 6))
    return s.where("nodes >= 2 and spike > 3").orderBy(F.desc("spike"), F.desc("n"), "domain", "h_us").limit(100).select("domain", "h_us", "n", "spike")


def emerging(hours: DataFrame, now: int) -> DataFrame:
    """Names of the last two hours with more than three times their mean over the 24 rows before within 48 hours; first seen ones have no mean and are none. The top 100."""
    w = Window.partitionBy("domain").orderBy("h_us").rowsBetween(-24, -1)
    s = hours.where(F.col("h_us") >= now - 2 * DAY).withColumn("mean", F.avg("n").over(w)).where((F.col("h_us") >= now - 2 * HOUR) & (F.col("mean") > 0))
    s = s.withColumn("spike", F.round(F.col("n") / F.greatest("mean", F.lit(1.0)), 6))
    return s.where("nodes >= 2 and spike > 3").orderBy(F.desc("spike"), F.desc("n"), "domain", "h_us").limit(100).select("domain", "h_us", "n", "spike")


@R.query(f"""with {EV}, {HOURLY}, m as (select max(t_us) as now from ev), w as (select hr.*, now, avg(n) over (partition by domain order by h_us rows between 24 preceding and 1 preceding) as mean from hr, m where h_us >= now - 172800000000)
 select domain, h_us, n, round(n / greatest(mean, 1), 6) as spike from w where h_us >= now - 7200000000 and mean > 0 and nodes >= 2 and n / greatest(mean, 1) > 3 order by spike desc, n desc, domain, h_us limit 100""")
def spike_emerging(spark, sf_dir: str) -> DataFrame:
    """The spikes of the last two hours, as surveyed (WIN-03)."""
    now = now_us(spark, sf_dir)
    return emerging(hourly(events(spark, sf_dir, named=True, from_us=now - now % HOUR - 2 * DAY)), now)


def standing_out(ev: DataFrame, now: int, ratio: float = 5.0, least: int = 10) -> DataFrame:
    """Names whose last six hours have more than ``ratio`` times a 28th of the week before, and ``least`` events; the top 500."""
    c = ev.groupBy("domain").agg(F.count_if(F.col("t_us") >= now - 6 * HOUR).alias("recent"), (F.count_if(F.col("t_us") < now - 6 * HOUR) / 28.0).alias("base"))
    c = c.withColumn("ratio", F.round(F.col("recent") / F.greatest(F.col("base"), F.lit(1.0)), 6))
    return c.where((F.col("recent") >= least) & (F.col("ratio") > ratio)).orderBy(F.desc("ratio"), "domain").limit(500).select("domain", "recent", F.round("base", 6).alias("base"), "ratio")


_STANDING = """with {EV}, m as (select max(t_us) as now from ev), c as (select domain, count(*) filter (t_us >= now - 21600000000) as recent, count(*) filter (t_us >= now - 604800000000 and t_us < now - 21600000000) / 28.0::double as base from ev, m where domain is not null group by domain)
 select domain, recent, round(base, 6) as base, round(recent / greatest(base, 1), 6) as ratio from c where recent >= {least} and recent / greatest(base, 1) > {ratio} order by ratio desc, domain limit 500"""


@R.query(_STANDING.replace("{EV}", EV).replace("{least}", "5").replace("{ratio}", "2"))
def spike_6h_7d(spark, sf_dir: str) -> DataFrame:
    """Names whose last six hours stand out, with low limits that these tables reach."""
    now = now_us(spark, sf_dir)
    return standing_out(events(spark, sf_dir, named=True, from_us=now - 7 * DAY), now, 2.0, 5)


@R.query(_STANDING.replace("{EV}", EV).replace("{least}", "10").replace("{ratio}", "5"))
def spike_week(spark, sf_dir: str) -> DataFrame:
    """The same with the limits as surveyed (AGG-22)."""
    now = now_us(spark, sf_dir)
    return standing_out(events(spark, sf_dir, named=True, from_us=now - 7 * DAY), now)


def gaps(spark, sf_dir: str, *keys: str, **which) -> DataFrame:
    """Seconds between neighbouring events with a domain of a key, written once."""
    slim = lambda e: e.select(*keys, "t_us", pack_hex("event_id").alias("event_id"))
    prev = with_previous(slim(events(spark, sf_dir, named=True, **which)), list(keys), ["t_us", "event_id"], ["t_us"], counted=slim(deliveries(spark, sf_dir, named=True, **which)), at_most=stored_rows(spark, sf_dir))
    return materialize(prev.select(*keys, ((F.col("t_us") - F.col("prev.t_us")) / 1e6).alias("gap_s")).where("gap_s is not null"), "gaps")


QUARTILES = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def beacon_design(g: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """Scores of keys by their intervals as designed: skewness, deviation from the median, number (full at 50) and duration (full at six hours) weighted 0.3, 0.3, 0.2, 0.2; only keys with ``least`` intervals."""
    q = order_statistics(g, keys, "gap_s", quantile_ranks(QUARTILES), least).select(*keys, "n", *(quantile(k, v).alias(k) for k, v in QUARTILES.items()))
    dev = g.join(q.select(*keys, "q2"), keys).select(*keys, F.abs(F.col("gap_s") - F.col("q2")).alias("dev"))
    mad = order_statistics(dev, keys, "dev", quantile_ranks({"m": 0.5})).select(*keys, quantile("m", 0.5).alias("mad"))
    span = g.groupBy(*keys).agg((F.sum("gap_s") / 3600).alias("span_h"))
    bowley = F.when(F.col("q3") > F.col("q1"), F.abs((F.col("q3") + F.col("q1") - 2 * F.col("q2")) / (F.col("q3") - F.col("q1")))).otherwise(0.0)
    part = lambda c: F.least(F.lit(1.0), c)
    score = 0.3 * (1 - bowley) + 0.3 * F.greatest(F.lit(0.0), 1 - F.col("mad") / 30.0) + 0.2 * part(F.log2("n") / F.log2(F.lit(50.0))) + 0.2 * part(F.col("span_h") / 6.0)
    return q.join(mad, keys).join(span, keys).select(*keys, "n", F.greatest(F.lit(0.0), part(score)).alias("score"))


def skew_and_spread(g: DataFrame, key: str = "domain", least: int = 10) -> DataFrame:
    """``key``, ``n``, ``bowley`` (skewness by quartiles) and ``mad`` (the upper median deviation from the median) of the intervals of each key: exact order statistics, in two passes over the counted intervals."""
    q = order_statistics(g, key, "gap_s", quantile_ranks(QUARTILES), least).select(key, *(quantile(k, v).alias(k) for k, v in QUARTILES.items()))
    dev = g.join(q.select(key, "q2"), key).select(key, F.abs(F.col("gap_s") - F.col("q2")).alias("dev"))
    mad = order_statistics(dev, key, "dev", {"mad": F.expr("n div 2")})
    b = F.when(F.col("q3") > F.col("q1"), (F.col("q3") + F.col("q1") - 2 * F.col("q2")) / (F.col("q3") - F.col("q1"))).otherwise(0.0)
    return q.join(mad, key).select(key, "n", b.alias("bowley"), "mad")


GAPS = "gp as (select domain, (t_us - lag(t_us) over (partition by domain order by t_us, event_id)) / 1e6::double as gap_s from ev where domain is not null)"


def regular(g: DataFrame, least: float = 5.0, samples: int = 20) -> DataFrame:
    """Keys whose intervals have a mean of more than ``least`` times their deviation, with more than ``samples`` of them."""
    r = g.groupBy("domain").agg(F.count("*").alias("n"), (F.avg("gap_s") / F.greatest(F.stddev_samp("gap_s"), F.lit(0.01))).alias("r"))
    return r.where((F.col("n") > samples) & (F.col("r") > least)).select("domain", "n", F.round("r", 5).alias("regularity"))


_REGULAR = "with {EV}, {GAPS} select domain, count(*) as n, round(avg(gap_s) / greatest(stddev_samp(gap_s), 0.01), 5) as regularity from gp where gap_s is not null group by domain having count(*) > 20 and avg(gap_s) / greatest(stddev_samp(gap_s), 0.01) > {least}"


@R.query(_REGULAR.replace("{EV}", EV).replace("{GAPS}", GAPS).replace("{least}", "0.9"))
def interval_regularity(spark, sf_dir: str) -> DataFrame:
    """Names that are asked for at regular intervals, by mean over deviation, with a low limit that these tables reach."""
    return regular(gaps(spark, sf_dir, "domain"), 0.9)


@R.query(_REGULAR.replace("{EV}", EV).replace("{GAPS}", GAPS).replace("{least}", "5"))
def regular_names(spark, sf_dir: str) -> DataFrame:
    """The same with the limit as surveyed (WIN-04)."""
    return regular(gaps(spark, sf_dir, "domain"))


@R.query(f"""with {EV}, {GAPS}, q as (select domain, count(*) as n, quantile_cont(gap_s, [0.25, 0.5, 0.75]) as q, list(gap_s) as xs from gp where gap_s is not null group by domain having count(*) >= 10),
 d as (select domain, n, q, list_sort(list_transform(xs, lambda x: abs(x - q[2]))) as dev from q)
 select domain, n, round(case when q[3] > q[1] then (q[3] + q[1] - 2 * q[2]) / (q[3] - q[1]) else 0 end, 5) as bowley, round(dev[len(dev) // 2 + 1], 5) as mad from d""")
def bowley_mad(spark, sf_dir: str) -> DataFrame:
    """Skewness by quartiles, and the median deviation from the median, of the intervals of a name."""
    x = skew_and_spread(gaps(spark, sf_dir, "domain"))
    return x.select("domain", "n", F.round("bowley", 5).alias("bowley"), F.round("mad", 5).alias("mad"))


def beacon_v2(bowley: Column, mad: Column, n: Column, span_h: Column) -> Column:
    """The later design of the beacon score: skewness, deviation, number and duration weighted 0.3, 0.3, 0.2, 0.2."""
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return 0.3 * (1 - clamp(F.abs(bowley))) + 0.3 * (1 - clamp(mad / 30.0)) + 0.2 * clamp(F.log10(n + 1) / 3.0) + 0.2 * clamp(span_h / 24.0)


@R.query(f"""with {EV}, {GAPS}, q as (select domain, count(*) as n, quantile_cont(gap_s, [0.25, 0.5, 0.75]) as q, list(gap_s) as xs, sum(gap_s) / 3600 as span_h from gp where gap_s is not null group by domain having count(*) >= 10),
 d as (select domain, n, q, span_h, list_sort(list_transform(xs, lambda x: abs(x - q[2]))) as dev from q)
 select domain, round(0.3::double * (1 - least(1, abs(case when q[3] > q[1] then (q[3] + q[1] - 2 * q[2]) / (q[3] - q[1]) else 0 end))) + 0.3::double * (1 - least(1, dev[len(dev) // 2 + 1] / 30.0::double)) + 0.2::double * least(1, log10(n + 1) / 3.0::double) + 0.2::double * least(1, span_h / 24.0::double), 5) as score from d""")
def beacon_scores_v2(spark, sf_dir: str) -> DataFrame:
    """The later design by name over all sources; ``beacon_pairs_v2`` has it as surveyed (SCA-27)."""
    g = gaps(spark, sf_dir, "domain")
    span = g.groupBy("domain").agg((F.sum("gap_s") / 3600).alias("span_h"))
    x = skew_and_spread(g).join(span, "domain")
    return x.select("domain", F.round(beacon_v2(F.col("bowley"), F.col("mad"), F.col("n"), F.col("span_h")), 5).alias("score"))


@R.query(f"""with {EV}, m as (select max(t_us) as now from ev), gp as (select source_hash, domain, (t_us - lag(t_us) over (partition by source_hash, domain order by t_us, event_id)) / 1e6::double as gap_s from ev, m where domain is not null and source_hash is not null and t_us >= now - 86400000000),
 q as (select source_hash, domain, count(*) as n, quantile_cont(gap_s, [0.25, 0.5, 0.75]) as q, list(gap_s) as xs, sum(gap_s) / 3600 as span_h from gp where gap_s is not null group by 1, 2 having count(*) >= 5),
 d as (select *, list_aggregate(list_transform(xs, lambda x: abs(x - q[2])), 'quantile_cont', 0.5) as mad from q)
 select source_hash, domain, n, round(least(1, 0.3::double * (1 - case when q[3] > q[1] then abs((q[3] + q[1] - 2 * q[2]) / (q[3] - q[1])) else 0 end) + 0.3::double * greatest(0, 1 - mad / 30.0::double) + 0.2::double * least(1, log2(n) / log2(50)) + 0.2::double * least(1, span_h / 6.0::double)), 5) as score from d""")
def beacon_pairs_v2(spark, sf_dir: str) -> DataFrame:
    """The later design by source and name over the last day, as surveyed (SCA-27); over all events of that day instead of the last 64."""
    g = gaps(spark, sf_dir, "source_hash", "domain", from_us=now_us(spark, sf_dir) - DAY, where="source_hash is not null")
    return beacon_design(g, ["source_hash", "domain"]).withColumn("score", F.round("score", 5))


@R.query(f"""with {EV}, {HOURLY}, m as (select max(t_us) - max(t_us) % 3600000000 as last from ev), top as (select domain from hr group by domain order by sum(n) desc, domain limit 20), g as (select domain, last - i * 3600000000 as h_us from top, m, range(24) t(i))
 select g.domain, string_agg(coalesce(n, 0)::varchar, ',' order by g.h_us) as line from g left join hr using (domain, h_us) group by g.domain""")
def sparklines(spark, sf_dir: str) -> DataFrame:
    """The last 24 hours of the 20 most frequent names as a line of counts."""
    now = now_us(spark, sf_dir)
    hr = hourly(events(spark, sf_dir, named=True))
    top = hr.groupBy("domain").agg(F.sum("n").alias("s")).orderBy(F.desc("s"), "domain").limit(20).select("domain")
    grid = top.select("domain", F.explode(F.sequence(F.lit(now - now % HOUR - 23 * HOUR), F.lit(now - now % HOUR), F.lit(HOUR))).alias("h_us"))
    full = grid.join(hr.select("domain", "h_us", "n"), ["domain", "h_us"], "left").na.fill(0)
    return full.groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("h_us", "n"))).alias("x")).select("domain", F.array_join(F.transform("x", lambda s: s["n"].cast("string")), ",").alias("line"))


@R.query(f"with {EV}, c as (select source_hash, count(*) as n from ev group by 1) select source_hash, n, round(percent_rank() over (order by n), 6) as pr from c")
def percentile_rank(spark, sf_dir: str) -> DataFrame:
    """The rank of every source by its events. Only one row per distinct count is ordered as a whole; sources get theirs by a join."""
    c = events(spark, sf_dir).groupBy("source_hash").agg(F.count("*").alias("n"))
    by = c.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by.withColumn("below", F.coalesce(F.sum("c").over(w), F.lit(0))).withColumn("total", F.sum("c").over(Window.partitionBy()))
    pr = ranks.select("n", F.round(F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0), 6).alias("pr"))
    return c.join(pr, "n").select("source_hash", "n", "pr")


@R.query(f"""with {EV}, d as (select source_hash, t_us - t_us % 86400000000 as d_us, count(*) as n, count(distinct (t_us % 86400000000) // 3600000000) as active_hours from ev group by 1, 2),
 w as (select *, avg(n) over b as mean, stddev_pop(n) over b as sd from d window b as (partition by source_hash order by d_us range between 604800000000 preceding and 86400000000 preceding))
 select source_hash, d_us, n, active_hours, round((n - mean) / greatest(sd, 1), 5) as deviation from w where mean is not null""")
def source_baseline(spark, sf_dir: str) -> DataFrame:
    """Every source's day against its own week before."""
    d = events(spark, sf_dir).groupBy("source_hash", hour_of("t_us", DAY).alias("d_us")).agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.pmod("t_us", F.lit(DAY)) / HOUR)).alias("active_hours"))
    w = Window.partitionBy("source_hash").orderBy("d_us").rangeBetween(-7 * DAY, -DAY)
    d = d.withColumns({"mean": F.avg("n").over(w), "sd": F.stddev_pop("n").over(w)}).where("mean is not null")
    return d.select("source_hash", "d_us", "n", "active_hours", F.round((F.col("n") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(1.0)), 5).alias("deviation"))


@R.query(f"""with {HOSTS}, p as (select ip, t_us, report_id, list_sort(list_distinct(list_filter(coalesce(ports, []), lambda x: x is not null))) as ports from (select *, row_number() over (partition by ip, report_id order by pos) as rn from hosts where ip is not null) where rn = 1),
 w as (select *, lag(ports) over (partition by ip order by t_us, report_id) as old from p)
 select ip, report_id, array_to_string(list_sort(list_filter(ports, lambda x: not list_contains(old, x))), ',') as opened, array_to_string(list_sort(list_filter(old, lambda x: not list_contains(ports, x))), ',') as closed from w where old is not null and old <> ports""")
def port_changes(spark, sf_dir: str) -> DataFrame:
    """Ports that the device at an address opened or closed since its scan before."""
    h = hosts(spark, sf_dir).where("ip is not null").groupBy("ip", "report_id", "t_us").agg(F.min(F.struct("pos", "ports"))["ports"].alias("ports"))
    h = h.withColumn("ports", F.array_sort(F.array_distinct(F.filter(F.coalesce("ports", F.array().cast("array<int>")), lambda x: x.isNotNull()))))
    h = with_previous(h, ["ip"], ["t_us", "report_id"], ["ports"], DAY).withColumn("old", F.col("prev.ports")).where("old is not null and old <> ports")
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return h.select("ip", "report_id", diff("ports", "old").alias("opened"), diff("old", "ports").alias("closed"))


@R.query(f"""with {EV}, d as (select distinct domain, array_to_string(string_split(domain, '.')[-2:], '.') as parent from ev where domain is not null and len(string_split(domain, '.')) > 2) select parent, count(*) as subdomains from d group by parent""")
def subdomains(spark, sf_dir: str) -> DataFrame:
    """Distinct names below each registered domain."""
    p = F.split("domain", r"\.")
    return events(spark, sf_dir, F.size(p) > 2, named=True).select("domain", F.array_join(F.slice(p, -2, 2), ".").alias("parent")).distinct().groupBy("parent").agg(F.count("*").alias("subdomains"))


@R.query(f"""with {EV}, d as (select distinct domain, array_to_string(string_split(domain, '.')[-2:], '.') as parent from ev where domain is not null and len(string_split(domain, '.')) > 2) select parent, true as near from d group by parent""")
def subdomains_near(spark, sf_dir: str) -> DataFrame:
    """Whether the sketches' counts are within a tenth (or one) of the exact ones, for every parent."""
    return subdomains(spark, sf_dir).join(subdomains_sketch(spark, sf_dir).withColumnRenamed("subdomains", "s"), "parent").select("parent", (F.abs(F.col("s") - F.col("subdomains")) <= F.greatest(F.lit(1.0), 0.1 * F.col("subdomains"))).alias("near"))


@R.query()
def subdomains_sketch(spark, sf_dir: str) -> DataFrame:
    """The same, counted by sketches of fixed size."""
    p = F.split("domain", r"\.")
    ev = events(spark, sf_dir, F.size(p) > 2, named=True)
    return ev.groupBy(F.array_join(F.slice(p, -2, 2), ".").alias("parent")).agg(F.approx_count_distinct("domain", 0.02).alias("subdomains"))


@R.query(f"""with {EV}, p as (select array_to_string(string_split(domain, '.')[-2:], '.') as parent, upper(query_type) as q from ev where domain is not null)
 select parent, count(*) as n, count(*) filter (q = 'A') as a, count(*) filter (q = 'AAAA') as aaaa, count(*) filter (q = 'TXT') as txt, round(count(*) filter (q in ('TXT', 'NULL', 'ANY')) / count(*), 6) as suspicious from p group by parent""")
def qtype_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of question types of every registered domain."""
    q = F.upper("query_type")
    g = events(spark, sf_dir, named=True).groupBy(F.array_join(F.slice(F.split("domain", r"\."), -2, 2), ".").alias("parent"))
    return g.agg(F.count("*").alias("n"), F.count_if(q == "A").alias("a"), F.count_if(q == "AAAA").alias("aaaa"), F.count_if(q == "TXT").alias("txt"), F.round(F.count_if(q.isin("TXT", "NULL", "ANY")) / F.count("*"), 6).alias("suspicious"))


SPECTRUM_STEPS = 577


def spectrum_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peak over mean of the spectrum of counts per step, of many names at once: names that span equally many steps are the rows of one matrix."""
    for batch in batches:
        lists = batch.column("x")
        items = lists.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        step, n = np.asarray(items.field("b")), np.asarray(items.field("n"))
        lo, hi = np.full(batch.num_rows, np.iinfo(np.int64).max), np.full(batch.num_rows, np.iinfo(np.int64).min)
        np.minimum.at(lo, owner, step)
        np.maximum.at(hi, owner, step)
        width, snr = hi - lo + 1, np.zeros(batch.num_rows)
        for size in np.unique(width[width >= 2]).tolist():
            members = np.flatnonzero(width == size)
            for at in range(0, len(members), 2048):
                part = members[at : at + 2048]
                row = np.full(batch.num_rows, -1)
                row[part] = np.arange(len(part))
                mine = np.flatnonzero(row[owner] >= 0)
                m = np.zeros((len(part), size))
                m[row[owner[mine]], step[mine] - lo[owner[mine]]] = n[mine]
                power = np.abs(np.fft.rfft(m - m.mean(axis=1, keepdims=True), axis=1)[:, 1:]) ** 2
                power[power < 1e-9] = 0.0  # what is left of a constant
                mean = power.mean(axis=1)
                snr[part] = np.where(mean > 0, power.max(axis=1) / np.where(mean > 0, mean, 1), 0.0)
        score = np.clip((snr - 2) / 8, 0, 1)
        yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array(np.round(snr, 6)), pa.array(np.round(score, 6))], names=["domain", "snr", "score"])


def _snr(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """One name's score from its steps (``b``) and counts (``n``)."""
    batch = pa.RecordBatch.from_pydict({"domain": [key[0]], "x": [[{"b": int(b), "n": int(n)} for b, n in zip(pdf["b"], pdf["n"])]]})
    return pa.Table.from_batches(spectrum_scores(iter([batch]))).to_pandas()


def spectrum(counts: DataFrame) -> DataFrame:
    """``domain``, ``snr``, ``score`` from ``domain``, ``b`` (step), ``n``; a name has ``SPECTRUM_STEPS`` rows at most, whatever the traffic."""
    lists = counts.groupBy("domain").agg(F.collect_list(F.struct("b", "n")).alias("x"))
    return lists.mapInArrow(spectrum_scores, "domain string, snr double, score double")


@R.query(f"""with {EV}, m as (select max(t_us) as now from ev), c as (select domain, t_us // 300000000 as b, count(*) as n from ev, m where domain is not null and t_us > now - 172800000000 group by 1, 2), l as (select domain, min(b) as lo, max(b) - min(b) + 1 as size from c group by domain),
 k as (select domain, lo, size, unnest(range(1, size // 2 + 1)) as k from l), f as (select k.domain, k.k, sum(n * cos(2 * pi() * k.k * (b - lo) / size)) as re, sum(n * sin(2 * pi() * k.k * (b - lo) / size)) as im from k join c on c.domain = k.domain group by k.domain, k.k),
 p as (select domain, case when re * re + im * im < 1e-9 then 0 else re * re + im * im end as power from f), s as (select domain, case when avg(power) > 0 then max(power) / avg(power) else 0 end as snr from p group by domain)
 select l.domain, round(coalesce(snr, 0), 6) as snr, round(least(1, greatest(0, (coalesce(snr, 0) - 2) / 8)), 6) as score from l left join s using (domain)""")
def fft_beacon(spark, sf_dir: str) -> DataFrame:
    """Periodicity of names by their spectrum over five-minute counts of the last 48 hours."""
    now = now_us(spark, sf_dir)
    b = events(spark, sf_dir, named=True, from_us=now - 2 * DAY + 1).groupBy("domain", F.expr("t_us div 300000000").alias("b")).agg(F.count("*").alias("n"))
    return spectrum(b)


QUERIES, SQL = R.QUERIES, R.SQL
