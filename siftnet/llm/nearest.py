"""Matching records of two tables by nearest time.

Both sides get time buckets as wide as the tolerance, so that partners are in
the same bucket of an entity or in adjacent ones. A left row goes into its own
bucket and the two beside it, right rows into their own only, and both meet in
cells (entity, bucket). In a cell a left row's only possible partners are the
right rows next to it in time, before and after; two ordered passes find them,
so that a cell costs its rows and never their pairs. What is further away than
the tolerance is dropped, and of the rest the least by (distance, time, id) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.functions.net import ip_hex
from siftnet.tables import load, micros


def nearest_in_time(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_key: Column, right_key: Column, left_ts: str = "ts", right_ts: str = "ts", tolerance_us: int = 120_000_000) -> DataFrame:
    """``left_id``, ``right_id``, ``left_us``, ``right_us``, ``distance_us`` of each left row that has a partner.

    The partner is the right row with the same key nearest in time, at most
    ``tolerance_us`` away (exactly that much still counts); at equal distance the
    earlier one, at equal times the smaller id. Repeated rows change nothing: a
    ``left_id`` has one row in the result, a right row may be the partner of any
    number of them. Rows with a null key, time or id match nothing; empty tables
    give an empty result; other columns, whatever their names, aren't looked at.

    A key with a third of all rows is spread over its time buckets. Only the left
    side, which should be the smaller one, is copied.
    """
    if tolerance_us < 0:
        raise ValueError("tolerance_us must not be negative")
    width = max(1, tolerance_us)
    bucket = F.expr(f"(t - pmod(t, {width}L)) div {width}L")
    r = right.select(right_key.alias("k"), micros(right, right_ts).alias("t"), F.col(f"`{right_id}`").alias("rid")).where("k is not null and t is not null and rid is not null")
    a = left.select(left_key.alias("k"), micros(left, left_ts).alias("t"), F.col(f"`{left_id}`").alias("lid")).where("k is not null and t is not null and lid is not null")
    kind = dict(left.dtypes)[left_id]
    cells = r.select("k", bucket.alias("b"), "t", "rid", F.lit(None).cast(kind).alias("lid")).unionByName(
        a.select("k", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"), "t", F.lit(None).cast(dict(right.dtypes)[right_id]).alias("rid"), "lid")
    )
    event = F.when(F.col("lid").isNull(), F.struct("t", "rid"))
    # right rows before left ones of the same time, and of equal times the smallest id last
    back = Window.partitionBy("k", "b").orderBy("t", F.col("lid").asc_nulls_first(), F.col("rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("k", "b").orderBy(F.col("t").desc(), F.col("lid").asc_nulls_first(), F.col("rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sides = cells.select("lid", "t", F.last(event, ignorenulls=True).over(back).alias("before"), F.last(event, ignorenulls=True).over(ahead).alias("after")).where("lid is not null")

    def pick(side: str) -> Column:
        d = F.abs(F.col(f"{side}.t") - F.col("t"))
        return F.when(d <= tolerance_us, F.struct(d.alias("d"), F.col(f"{side}.t").alias("rt"), F.col(f"{side}.rid").alias("rid")))

    best = sides.select("lid", "t", F.least(pick("before"), pick("after")).alias("p")).where("p is not null").groupBy("lid").agg(F.min(F.struct("p.d", "p.rt", "p.rid", "t")).alias("p"))
    return best.select(F.col("lid").alias(left_id), F.col("p.rid").alias(right_id), F.col("p.t").alias("left_us"), F.col("p.rt").alias("right_us"), F.col("p.d").alias("distance_us"))


def p1_nearest(spark, sf_dir: str) -> DataFrame:
    """The nearest resolution of every firewall record's address, with both times."""
    fw, ev = load(spark, sf_dir, "firewall_events"), load(spark, sf_dir, "dns_events")
    return nearest_in_time(fw, ev, "fw_id", "event_id", F.unhex(ip_hex("dst_ip")), F.unhex(ip_hex("resolved_ip")))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return p1_nearest(spark, sf_dir).select("fw_id", "event_id")


def _ip_sql(column: str) -> str:
    """An address in one notation, for the notations that the tables have."""
    v = rf"regexp_replace(lower({column}), '^\s+|\s+$', '', 'g')"
    part = lambda i: f"list_filter(string_split(split_part({v}, '::', {i}), ':'), lambda x: x <> '')"
    return rf"""case when regexp_full_match({v}, '[0-9]+(\.[0-9]+){{3}}') then {v}
      when regexp_full_match({v}, '::ffff:[0-9]+(\.[0-9]+){{3}}') then {v}[8:]
      when regexp_full_match({v}, '[0-9a-f:]+') and contains({v}, ':') then array_to_string(list_transform(
        case when contains({v}, '::') then list_concat(list_concat({part(1)}, list_transform(range(8 - len({part(1)}) - len({part(2)})), lambda x: '0')), {part(2)}) else string_split({v}, ':') end,
        lambda g: lpad(g, 4, '0')), ':') end"""


_NEAREST_SQL = f"""
with f as (select distinct fw_id, epoch_us(ts) as t, {_ip_sql('dst_ip')} as k from firewall_events),
e as (select distinct event_id, epoch_us(ts) as t, {_ip_sql('resolved_ip')} as k from dns_events),
m as (select f.fw_id, e.event_id, f.t as left_us, e.t as right_us, abs(e.t - f.t) as distance_us,
        row_number() over (partition by f.fw_id order by abs(e.t - f.t), e.t, e.event_id) as rn
      from f join e on f.k = e.k and e.t between f.t - 120000000 and f.t + 120000000)
select {{columns}} from m where rn = 1
"""

QUERIES = {"p1_found": p1_found, "p1_nearest": p1_nearest}
SQL = {"p1_found": _NEAREST_SQL.replace("{columns}", "fw_id, event_id"), "p1_nearest": _NEAREST_SQL.replace("{columns}", "fw_id, event_id, left_us, right_us, distance_us")}
