"""Distinct counts with a known error from partial results that can be merged.

An element's hash drives a Poisson process of rate ``registers``, each of whose
arrivals falls on a random register; to one register the first arrival is an
exponential variate, independent of those of the others. A register keeps the
least of all elements. A least of n independent ones is exponential with rate n,
so that the registers' sum is gamma distributed with scale 1/n: from it follow an
unbiased count and exact confidence limits. Registers of a union are the
elementwise minimum, so that days, segments and combinations of them are merged
from the same partial results, and elements that repeat change nothing. Arrivals
later than the greatest register change nothing either and are not drawn: n
elements cost about n + m log m draws instead of n m.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.session import materialize
from siftnet.tables import domain_key, load, pack_hex, segment_key

REGISTERS = 2048  # a power of two, 2048 at most: a draw has 53 bits for the time and the rest for the register
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def absorb(registers: np.ndarray, h: np.ndarray) -> None:
    """Lower ``registers`` (infinite where nothing came yet) to the least arrivals of distinct hashes ``h``."""
    m = len(registers)
    at, t, done = h.astype(np.uint64), np.zeros(len(h)), np.uint64(0)
    while len(at):
        # about as many arrivals at once as lie below the greatest register that is to be expected
        width = max(1, min(m * 16, int(m * (log(m) + 3) / len(at)) + 1))
        for lo in range(0, len(at), max(1, (1 << 20) // width)):
            part = slice(lo, lo + max(1, (1 << 20) // width))
            steps = (np.arange(1, width + 1, dtype=np.uint64) + done) * _STEP
            x = _mixed(_mixed(at[part])[:, None] + steps)
            gaps = np.log1p(-((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / -m
            # added one by one, so that an element's arrivals are the same however many are drawn at once
            when = np.cumsum(np.concatenate([t[part, None], gaps], axis=1), axis=1)[:, 1:]
            t[part] = when[:, -1]
            keep = when < registers.max()
            np.minimum.at(registers, (x[keep] & np.uint64(m - 1)).astype(np.int64), when[keep])
        done += np.uint64(width)
        go = t < registers.max()
        at, t = at[go], t[go]


@lru_cache(maxsize=64)
def gamma_quantile(shape: int, p: float) -> float:
    """Where the gamma distribution with this shape and scale 1 has probability ``p``, by bisection."""

    def below(x: float) -> float:
        if x < shape + 1:
            term = total = 1.0 / shape
            k = shape
            while term > total * 1e-16:
                k += 1
                term *= x / k
                total += term
            return total * exp(-x + shape * log(x) - lgamma(shape))
        b = x + 1 - shape
        c, d = 1e300, 1 / b
        f = d
        for i in range(1, 10_000):
            a = -i * (i - shape)
            b += 2
            d = 1 / (a * d + b)
            c = b + a / c
            f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return 1 - f * exp(-x + shape * log(x) - lgamma(shape))

    lo, hi = 1e-9, shape + 40 * sqrt(shape) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2


def least_exponentials(h: np.ndarray, first: np.ndarray, m: int) -> np.ndarray:
    """Registers of groups of hashes; ``first`` are the groups' starts."""
    out = np.full((len(first), m), np.inf)
    for registers, lo, hi in zip(out, first, [*first[1:], len(h)]):
        absorb(registers, h[lo:hi])
    return out


class Sketch:
    """Partial result of one group: its distinct hashes while they are few, else registers. ``data`` is either, in a form that ``Sketch.of`` reads: a list of hashes or registers in single precision."""

    def __init__(self, m: int) -> None:
        self.m, self.registers, self.held, self.size = m, None, [], 0

    def add(self, h: np.ndarray) -> None:
        self.held.append(h)
        self.size += len(h)
        if self.size > 4 * self.m:
            self.settle(self.m // 4)

    def settle(self, few: int) -> None:
        """More than ``few`` hashes go into the registers."""
        h = np.unique(np.concatenate(self.held)) if self.held else np.zeros(0, dtype=np.uint64)
        if self.registers is None and len(h) > few:
            self.registers = np.full(self.m, np.inf)
        if self.registers is not None:
            absorb(self.registers, h)
            h = h[:0]
        self.held, self.size = [h], len(h)

    def merge(self, data: bytes) -> None:
        if data[0]:
            r = np.frombuffer(data, dtype="<f4", offset=4).astype(np.float64)
            self.registers = r if self.registers is None else np.minimum(self.registers, r)
        else:
            self.add(np.frombuffer(data, dtype="<u8", offset=8))

    def data(self) -> bytes:
        self.settle(self.m // 4)
        if self.registers is None:
            return bytes(8) + self.held[0].astype("<u8").tobytes()
        return b"\1\0\0\0" + self.registers.astype("<f4").tobytes()

    def total(self) -> float:
        """The sum of the registers."""
        self.settle(0)
        return float(self.registers.astype("<f4").astype(np.float64).sum()) if self.registers is not None else float("inf")


def _emit(held: dict, keys: list[str], totals: bool) -> Iterator[pa.RecordBatch]:
    ks = list(held)
    for at in range(0, len(ks), 256):
        part = ks[at : at + 256]
        cols = [*(pa.array([k[i] for k in part], pa.string()) for i in range(len(keys))), pa.array([held[k].data() for k in part], pa.binary())]
        yield pa.RecordBatch.from_arrays([*cols, *([pa.array([held[k].total() for k in part], pa.float64())] if totals else [])], names=[*keys, "registers", *(["total"] if totals else [])])


def _registers(m: int, keys: list[str], values: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            code = np.zeros(b.num_rows, dtype=np.int64)
            names = []
            for k in keys:
                d = b.column(k).dictionary_encode()
                names.append(d.dictionary.to_pylist() + [None])
                code = code * len(names[-1]) + np.asarray(d.indices.fill_null(len(d.dictionary)))
            for v in values:
                column = b.column(v)
                there = np.flatnonzero(np.asarray(column.is_valid()))
                h = np.asarray(column.fill_null(0)).view(np.uint64)[there]
                order = np.lexsort((h, code[there]))
                c, h = code[there][order], h[order]
                new = np.r_[True, (c[1:] != c[:-1]) | (h[1:] != h[:-1])] if len(c) else np.zeros(0, dtype=bool)
                c, h = c[new], h[new]
                first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, dtype=np.int64)
                for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(c)]):
                    rest, key = int(c[lo]), []
                    for n in reversed(names):
                        rest, i = divmod(rest, len(n))
                        key.append(n[i])
                    key = (v, *key[::-1])
                    if key not in held:
                        held[key] = Sketch(m)
                    held[key].add(h[lo:hi])
            if len(held) > 8192:  # partial results may go out at any time
                yield from _emit(held, ["measure", *keys], False)
                held = {}
        yield from _emit(held, ["measure", *keys], False)

    return work


def _merge(m: int, keys: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for *key, r in zip(*(b.column(k).to_pylist() for k in [*keys, "registers"])):
                key = tuple(key)
                if key not in held:
                    held[key] = Sketch(m)
                held[key].merge(r)
        yield from _emit(held, keys, True)

    return work


def distinct_sketches(df: DataFrame, keys: list[str], values: list[str], registers: int = REGISTERS) -> DataFrame:
    """Partial results: ``measure`` (one of the columns ``values``), string ``keys`` and binary ``registers``. Null values are no elements. To be merged by ``merge_sketches``."""
    slim = df.select(*keys, *(F.when(F.col(v).isNotNull(), F.xxhash64(v)).alias(v) for v in values))
    return slim.mapInArrow(_registers(registers, keys, values), ", ".join(f"{k} string" for k in ["measure", *keys]) + ", registers binary")


def merge_sketches(sketches: DataFrame, keys: list[str], registers: int = REGISTERS) -> DataFrame:
    """One sketch per combination of ``keys``, with the registers' ``total``; sketches stream through, none but one per combination is held."""
    return sketches.select(*keys, "registers").repartition(*keys).mapInArrow(_merge(registers, keys), ", ".join(f"{k} string" for k in keys) + ", registers binary, total double")


def with_counts(sketches: DataFrame, error: float = 0.05, registers: int = REGISTERS) -> DataFrame:
    """Adds the unbiased ``estimate`` and limits ``low`` and ``high`` that hold with probability 1 - ``error``."""
    lo, hi = gamma_quantile(registers, error / 2), gamma_quantile(registers, 1 - error / 2)
    return sketches.withColumns({"estimate": F.lit(registers - 1.0) / F.col("total"), "low": F.lit(lo) / F.col("total"), "high": F.lit(hi) / F.col("total")})


ALL = "ALL"


def _cube(df: DataFrame, keys: list[str], *rest: str) -> DataFrame:
    """Every row once for each combination of grouped and not grouped ``keys``."""
    out = df
    for k in keys:
        out = out.withColumn(k, F.explode(F.array(F.col(k), F.lit(ALL))))
    return out.select(*rest, *keys)


def _events(spark, sf_dir: str) -> DataFrame:
    """Events with a domain and a time, with the values and groups that are counted."""
    ev = load(spark, sf_dir, "dns_events")
    return ev.select(
        pack_hex("event_id").alias("id"), domain_key("domain").alias("domain"), F.lower("source_hash").alias("source_hash"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day_utc"), segment_key("network_segment").alias("network_segment"),
    ).where("domain is not null and day_utc is not null")


GROUPS = ["day_utc", "network_segment"]


def _measures(ev: DataFrame) -> DataFrame:
    """One row per event and value that is counted."""
    return ev.select(*GROUPS, F.explode(F.create_map(F.lit("domain"), F.col("domain"), F.lit("source_hash"), F.col("source_hash"))).alias("measure", "value"))


def distinct_counts(ev: DataFrame, error: float = 0.05, registers: int = REGISTERS) -> DataFrame:
    """``measure``, day, segment, ``n_events``, ``estimate``, ``low``, ``high`` of every group, ``ALL`` for a column not grouped by.

    ``ev`` has ``id``, ``domain``, ``source_hash`` and the groups' columns, no null
    among domains and groups. Redelivered events count once in ``n_events`` (those
    with a null id each by themselves) and cannot change the distinct counts. An
    empty table gives an empty result. The relative standard error is 1 /
    sqrt(``registers`` - 2).
    """
    keys = ["measure", *GROUPS]
    base = merge_sketches(distinct_sketches(ev, GROUPS, ["domain", "source_hash"], registers), keys, registers)
    merged = merge_sketches(_cube(base, GROUPS, "measure", "registers"), keys, registers)
    once = ev.groupBy("id", *GROUPS).agg(F.count("*").alias("c")).groupBy(*GROUPS).agg(F.sum(F.expr("if(id is null, c, 1)")).alias("n"))
    n = _cube(once, GROUPS, "n").groupBy(*GROUPS).agg(F.sum("n").alias("n_events"))
    return with_counts(merged, error, registers).join(n, GROUPS).select(*keys, "n_events", "estimate", "low", "high")


def p6_counts(spark, sf_dir: str) -> DataFrame:
    """Distinct names and sources by day, segment, both and neither, with 95 % limits."""
    return distinct_counts(_events(spark, sf_dir))


#: Per cent of a group's events that its distinct values must make up at least, and events that it must have.
SHARES = {"domain": 70, "source_hash": 40}
LEAST_EVENTS = 100


def many_distinct(ev: DataFrame, shares: dict[str, int], least: int, error: float = 2e-9) -> DataFrame:
    """``measure``, day and segment of the groups of ``distinct_counts`` with ``least`` events at least, of which distinct values are ``shares`` per cent or more.

    The limits of the counts answer for every group whose share lies outside them.
    Only groups whose limits lie on either side of their share are counted exactly,
    and only their own events are looked at again, before anything is shuffled.
    """
    share = F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("measure")]
    counts = distinct_counts(ev, error).where((F.col("n_events") >= least) & (F.col("high") * 100 >= share * F.col("n_events")))
    counts = materialize(counts.withColumn("sure", F.col("low") * 100 >= share * F.col("n_events")).select("measure", *GROUPS, "n_events", "sure"), "groups")
    sure = counts.where("sure").select("measure", *GROUPS)
    open_groups = counts.where("not sure")
    if open_groups.isEmpty():
        return sure
    # the planner broadcasts the open groups by their measured size, or shuffles both sides
    mine = _cube(_measures(ev).where("value is not null"), GROUPS, "measure", "value").join(open_groups.select("measure", *GROUPS), ["measure", *GROUPS], "left_semi")
    exact = mine.withColumn("value", pack_hex("value")).distinct().groupBy("measure", *GROUPS).agg(F.count("*").alias("n_distinct"))
    settled = exact.join(open_groups, ["measure", *GROUPS]).where(F.col("n_distinct") * 100 >= share * F.col("n_events"))
    return sure.unionByName(settled.select("measure", *GROUPS))


def p6_found(spark, sf_dir: str) -> DataFrame:
    """Groups with many distinct values for their events, by limits that are wrong once in 10^9."""
    return many_distinct(_events(spark, sf_dir), SHARES, LEAST_EVENTS)


_FOUND_SQL = r"""
with ev as (select event_id, any_value(nullif(regexp_replace(lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')), '\.$', ''), '')) as domain, any_value(lower(source_hash)) as source_hash,
  any_value(strftime(ts at time zone 'UTC', '%Y-%m-%d')) as day_utc, any_value(coalesce(nullif(network_segment, ''), 'default')) as network_segment from dns_events group by event_id),
g as (select coalesce(day_utc, 'ALL') as day_utc, coalesce(network_segment, 'ALL') as network_segment, count(*) as n, count(distinct domain) as d, count(distinct source_hash) as s
  from ev where domain is not null group by grouping sets ((day_utc, network_segment), (day_utc), (network_segment), ()))
select 'domain' as measure, day_utc, network_segment from g where n >= 100 and d * 100 >= 70 * n
union all select 'source_hash', day_utc, network_segment from g where n >= 100 and s * 100 >= 40 * n
"""

QUERIES = {"p6_found": p6_found, "p6_counts": p6_counts}
SQL = {"p6_found": _FOUND_SQL}
