"""Grouping of activity into sessions.

Every event falls into a slot of ``resolution_us``; the slots that a key
occupies are a bitmap. A closing with an element of the gap's length, made of
doubling shifts, joins all slots that surely belong together; its runs,
trimmed to the first and last event in them, are partial sessions. Slots that
are just about a gap apart cannot be settled at the bitmap's resolution, nor
can runs in neighbouring chunks of a key: the exact ends of the runs settle
those, so that the result is exact to the microsecond at any resolution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.tables import load, micros, pack_hex, unpack_hex

WORDS = 16
CHUNK_SLOTS = WORDS * 64


def shift_up(x: np.ndarray, s: int) -> np.ndarray:
    """Bits of each row moved to later slots by ``s``; rows are little-endian words."""
    words, bits = divmod(s, 64)
    y = np.zeros_like(x)
    if words < x.shape[1]:
        y[:, words:] = x[:, : x.shape[1] - words]
    if bits:
        carry = np.zeros_like(y)
        carry[:, 1:] = y[:, :-1] >> np.uint64(64 - bits)
        y = (y << np.uint64(bits)) | carry
    return y


def shift_down(x: np.ndarray, s: int) -> np.ndarray:
    words, bits = divmod(s, 64)
    y = np.zeros_like(x)
    if words < x.shape[1]:
        y[:, : x.shape[1] - words] = x[:, words:]
    if bits:
        carry = np.zeros_like(y)
        carry[:, :-1] = y[:, 1:] << np.uint64(64 - bits)
        y = (y >> np.uint64(bits)) | carry
    return y


def close_bitmap(x: np.ndarray, reach: int) -> np.ndarray:
    """Morphological closing of each row: occupied slots at most ``reach`` apart become one run. Rows need ``reach`` empty slots at their end."""
    if reach <= 1:
        return x
    done, steps = 1, []
    while done < reach:
        steps.append(min(done, reach - done))
        done += steps[-1]
    for s in steps:
        x = x | shift_up(x, s)
    for s in steps:
        x = x & shift_down(x, s)
    return x


def runs_of_chunks(chunk: np.ndarray, slot: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """Partial sessions of many chunks at once.

    ``chunk`` numbers the rows of the bitmap (0, 1, ...), ``slot`` is the slot in
    it; a slot occurs once in a chunk. Returns the chunk, first time, last time
    and number of events of each run.
    """
    order = np.lexsort((slot, chunk))
    chunk, slot, lo, hi, n = (a[order] for a in (chunk, slot, lo, hi, n))
    pad = -(-reach // 64) + 1
    bits = np.zeros((int(chunk[-1]) + 1, WORDS + pad), dtype=np.uint64)
    np.bitwise_or.at(bits, (chunk, slot // 64), np.uint64(1) << (slot % 64).astype(np.uint64))
    closed = close_bitmap(bits, reach)
    starts = closed & ~shift_up(closed, 1) if reach else bits
    rank = np.cumsum(np.unpackbits(np.ascontiguousarray(starts[:, :WORDS]).view(np.uint8), axis=1, bitorder="little"), axis=1, dtype=np.int32)
    run = rank[chunk, slot]
    first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (run[1:] != run[:-1])])
    return chunk[first], np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first), np.add.reduceat(n, first)


def _close_batches(reach: int, chunk_us: int, resolution_us: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column("slots")
                items = lists.flatten()
                if not len(items):
                    continue
                owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                lo, hi, n = (np.asarray(items.field(k)) for k in ("lo", "hi", "n"))
                base = np.asarray(part.column("chunk"))[owner] * chunk_us
                c, lo, hi, n = runs_of_chunks(owner, (lo - base) // resolution_us, lo, hi, n, reach)
                yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(c)), pa.array(lo), pa.array(hi), pa.array(n)], names=["k", "lo", "hi", "n"])

    return work


def sessionize(events: DataFrame, key: Column, ts: str = "ts", event_id: str | None = "event_id", gap_us: int = 1_800_000_000, resolution_us: int = 60_000_000, key_name: str = "key") -> DataFrame:
    """Sessions of each key: ``key_name``, ``start_us``, ``end_us``, ``duration_us``, ``n_events``.

    A gap of more than ``gap_us`` between neighbouring events starts a session.
    Rows with the same ``event_id`` count once, redelivered rows repeating their time
    as well as their id (with ``None`` all rows count; a row with a null id counts by
    itself). Rows without key or time belong to
    no session. Equal times are a gap of 0, a lone event is a session of
    duration 0, an empty input gives an empty result; other columns are not
    looked at, whatever their names.

    Events are counted into slots where they are, and shuffled by key and slot,
    so that a key with a third of all events is spread over all its slots. After
    that only occupied slots move, and after the closing only runs do.
    """
    if gap_us < 0 or resolution_us <= 0:
        raise ValueError("gap_us must not be negative, resolution_us must be positive")
    res = max(1, min(resolution_us, gap_us // 2))
    reach = gap_us if res == 1 else gap_us // res - 1  # at the resolution of the times themselves slots are exact
    chunk_us = CHUNK_SLOTS * res
    t = micros(events, ts)
    rows = events.select(pack_hex(key).alias("k"), t.alias("t"), (pack_hex(F.col(f"`{event_id}`").cast("string")) if event_id else F.lit(None).cast("binary")).alias("id")).where("k is not null and t is not null")
    rows = rows.withColumn("slot", F.expr(f"(t - pmod(t, {res}L)) div {res}L"))
    if event_id:
        events = rows.repartition("k", "slot").groupBy("k", "slot", "id").agg(F.min("t").alias("lo"), F.expr("if(id is null, max(t), min(t))").alias("hi"), F.expr("if(id is null, count(*), 1)").alias("n"))
        slots = events.groupBy("k", "slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    else:
        slots = rows.groupBy("k", "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n"))
    slots = slots.withColumn("chunk", F.expr(f"(slot - pmod(slot, {CHUNK_SLOTS}L)) div {CHUNK_SLOTS}L"))
    chunks = slots.groupBy("k", "chunk").agg(F.collect_list(F.struct("lo", "hi", "n")).alias("slots"))
    runs = chunks.mapInArrow(_close_batches(reach, chunk_us, res), "k binary, lo bigint, hi bigint, n bigint")
    w = Window.partitionBy("k").orderBy("lo")
    new = (F.lag("hi").over(w).isNull() | (F.col("lo") - F.lag("hi").over(w) > gap_us)).cast("int")
    joined = runs.withColumn("new", new).withColumn("nr", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "nr").agg(F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n_events"))
    return joined.select(unpack_hex("k").alias(key_name), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")


def p3_sessions(spark, sf_dir: str) -> DataFrame:
    """Sessions of every source over all event types, with durations."""
    ev = load(spark, sf_dir, "dns_events")
    return sessionize(ev, F.lower("source_hash"), key_name="source_hash")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return p3_sessions(spark, sf_dir).select("source_hash", "start_us", "end_us", "n_events")


_SESSIONS_SQL = """
with ev as (select distinct lower(source_hash) as source_hash, epoch_us(ts) as t, event_id from dns_events where source_hash is not null and ts is not null),
one as (select source_hash, event_id, min(t) as t from ev group by source_hash, event_id),
steps as (select *, case when t - lag(t) over (partition by source_hash order by t, event_id) <= 1800000000 then 0 else 1 end as new from one),
nrs as (select *, sum(new) over (partition by source_hash order by t, event_id rows unbounded preceding) as nr from steps)
select source_hash, min(t) as start_us, max(t) as end_us, {duration}count(*) as n_events from nrs group by source_hash, nr
"""

QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions}
SQL = {"p3_found": _SESSIONS_SQL.format(duration=""), "p3_sessions": _SESSIONS_SQL.format(duration="max(t) - min(t) as duration_us, ")}
