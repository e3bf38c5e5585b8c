"""Timestamps of many formats, precisions and zones as UTC microseconds.

The characters of a whole Arrow column are mapped to classes (digit, letter,
rest as it is) by one table look-up on its bytes. The texts of a batch have few
distinct shapes; each shape is compiled to a parser once per process, and a
parser reads all texts of its shape together, at fixed byte positions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.functions.zones import Zones, ZoneTable, days_from_civil, installed_zones, offsets_at, wall_to_utc, zone_table
from siftnet.operators.shred import Leaf, first_delivery, positions, shred
from siftnet.tables import load

_CLASSES = np.arange(256, dtype=np.uint8)
_CLASSES[ord("0") : ord("9") + 1] = ord("9")
_CLASSES[ord("A") : ord("Z") + 1] = ord("A")
_CLASSES[ord("a") : ord("z") + 1] = ord("A")
_CLASSES[128:] = ord("?")

# English names of months and days as they are abbreviated.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
DAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")

_CLOCK = r"(?P<hour>99):(?P<minute>99)(?::(?P<second>99)(?:[.,](?P<fraction>9+))?)?"
_ZONE = r"(?: ?(?P<zulu>A)| ?(?P<sign>[+-])(?P<zh>99)(?::?(?P<zm>99))?(?:\[(?P<zone>[A/_+\-9]+)\])?| (?P<abbr>AA{1,4}))?"
#: Shapes of moments; a shape matches at most one.
SHAPES = (
    rf"(?P<year>9999)[-/](?P<month>99)[-/](?P<day>99)(?:(?P<t>[A ]){_CLOCK}{_ZONE})?",
    rf"(?P<year>9999)(?P<month>99)(?P<day>99)(?P<t>A)(?P<hour>99)(?P<minute>99)(?:(?P<second>99)(?:[.,](?P<fraction>9+))?)?{_ZONE}",
    rf"(?P<first>99?)(?P<sep>[/.-])(?P<other>99?)[/.-](?:(?P<year>9999)|(?P<yy>99))(?:,? {_CLOCK}(?: (?P<half>AA))?{_ZONE})?",
    rf"(?P<mon>AAA) (?P<day> 9|99?) {_CLOCK}{_ZONE}",
    rf"(?:(?P<weekday>AAA), )?(?P<day>99?)[ -](?P<mon>AAA)[ -](?P<year>9999) {_CLOCK}{_ZONE}",
    rf"(?P<weekday>AAA) (?P<mon>AAA) (?P<day> 9|99?) {_CLOCK}(?: (?P<abbr2>AA{{1,4}}))? (?P<year>9999)",
    r"(?P<whole>9+)(?:\.(?P<decimals>9+))?(?:(?P<e>A)(?P<esign>[+-])?(?P<exponent>99?))?",
)
_COMPILED = tuple(re.compile(s) for s in SHAPES)
_EDGE = " \t\r\n\"'"
#: Bare numbers below these are seconds, milliseconds and microseconds, others nanoseconds.
UNITS = ((100_000_000_000, 1_000_000), (100_000_000_000_000, 1_000), (100_000_000_000_000_000, 1))


@dataclass(frozen=True)
class Parser:
    spans: dict[str, tuple[int, int]]

    def has(self, name: str) -> bool:
        return name in self.spans


@lru_cache(maxsize=100_000)
def parser_of(shape: str) -> Parser | None:
    """The parser of a shape, or ``None`` where it is no moment. Blanks and quotes around it don't count."""
    lead = len(shape) - len(shape.lstrip(_EDGE))
    bare = shape.strip(_EDGE)
    for c in _COMPILED:
        m = c.fullmatch(bare)
        if m:
            return Parser({k: (a + lead, b + lead) for k in m.groupdict() if (a := m.start(k)) >= 0 and (b := m.end(k)) >= 0})
    return None


def shapes(texts: pa.Array) -> pa.Array:
    """The shapes of a column of texts, by one look-up on all its bytes."""
    texts = pa.concat_arrays([texts.cast(pa.string())])
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return pa.Array.from_buffers(pa.string(), len(texts), [texts.buffers()[0], offsets, pa.py_buffer(_CLASSES[raw].tobytes())], offset=texts.offset)


def _matrix(texts: pa.Array, width: int) -> np.ndarray:
    texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset :]
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[0] + len(texts) * width].reshape(len(texts), width)


def _numbers(m: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    digits = m[:, span[0] : span[1]].astype(np.int64) - 48
    return np.where(digits >= 0, digits, 0) @ (10 ** np.arange(digits.shape[1] - 1, -1, -1, dtype=np.int64))


def _names(m: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    part = np.ascontiguousarray(m[:, span[0] : span[1]])
    part = np.where((part >= 97) & (part <= 122), part - 32, part).astype(np.uint8)
    return np.char.decode(np.ascontiguousarray(part).view(f"S{part.shape[1]}").ravel(), "ascii")


def _index(names: np.ndarray, known: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(names), dtype=np.int64)
    for i, k in enumerate(known, 1):
        out[names == k] = i
    return out


@dataclass
class Context:
    """What the texts don't say: each row's zone, order of numeric dates and time of receipt (microseconds, with its validity)."""

    zone: np.ndarray
    order: np.ndarray
    received: np.ndarray
    has_received: np.ndarray

    def take(self, rows: np.ndarray) -> Context:
        return Context(self.zone[rows], self.order[rows], self.received[rows], self.has_received[rows])


def _local(zones: np.ndarray, wall: np.ndarray, abbr: np.ndarray | None, tables: Callable[[str | None], ZoneTable | None]) -> tuple[np.ndarray, np.ndarray]:
    utc, ok = np.zeros(len(wall), dtype=np.int64), np.zeros(len(wall), dtype=bool)
    for z in {*zones.tolist()}:
        t = tables(z)
        if t is not None:
            rows = np.flatnonzero(zones == z)
            utc[rows], ok[rows] = wall_to_utc(t, wall[rows], None if abbr is None else abbr[rows])
    return utc, ok


def _digits_to(m: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first ``width`` digits of each row, zeros where rows end sooner, and which of them fit in 19 digits."""
    d = np.zeros((len(m), max(width, 0)), dtype=np.uint64)
    d[:, : min(width, m.shape[1])] = m[:, : max(width, 0)]
    fits = ~(d[:, :-19] > 0).any(axis=1) if width > 19 else np.ones(len(m), dtype=bool)
    d = d[:, -19:]
    return d @ (np.uint64(10) ** np.arange(d.shape[1] - 1, -1, -1, dtype=np.uint64)), fits


def _unix_of(digits: np.ndarray, point: int) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of numbers whose point is after ``point`` digits: seconds, milli-, micro- or nanoseconds by their size, cut and not rounded."""
    if point < 0:
        digits, point = np.concatenate([np.zeros((len(digits), -point), dtype=digits.dtype), digits], axis=1), 0
    whole, ok = _digits_to(digits, point)
    out = (whole // np.uint64(1000)).astype(np.int64)
    for (limit, factor), places in zip(reversed(UNITS), (0, 3, 6)):
        # what the digits after the point add at this unit
        small, _ = _digits_to(digits[:, point:], places)
        out = np.where(whole < limit, np.where(whole < limit, whole, 0).astype(np.int64) * factor + small.astype(np.int64), out)
    return out, ok & (whole < np.uint64(9_000_000_000_000_000_000))


def _unix(p: Parser, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bare numbers, also with decimals and exponents; texts with one exponent are read together."""
    out, ok = np.zeros(len(m), dtype=np.int64), np.zeros(len(m), dtype=bool)
    whole, dec = p.spans["whole"], p.spans.get("decimals", (0, 0))
    if whole[1] - whole[0] > 19 or dec[1] - dec[0] > 18:
        return out, ok
    digits = np.concatenate([m[:, whole[0] : whole[1]], m[:, dec[0] : dec[1]]], axis=1) - np.uint8(48)
    if not p.has("e"):
        return _unix_of(digits, whole[1] - whole[0])
    power = _numbers(m, p.spans["exponent"])
    if p.has("esign"):
        power = np.where(m[:, p.spans["esign"][0]] == 45, -power, power)
    right = np.isin(m[:, p.spans["e"][0]], np.frombuffer(b"eE", dtype=np.uint8))
    for e in np.unique(power[right]).tolist():
        rows = np.flatnonzero(right & (power == e))
        out[rows], ok[rows] = _unix_of(digits[rows], whole[1] - whole[0] + e)
    return out, ok


def _moments(p: Parser, m: np.ndarray, ctx: Context, tables: Callable[[str | None], ZoneTable | None]) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of texts of one shape, and which of them are determined."""
    if p.has("whole"):
        us, ok = _unix(p, m)
        return us, ok & (us != 0)
    n = len(m)
    num = lambda name, absent=0: _numbers(m, p.spans[name]) if p.has(name) else np.full(n, absent, dtype=np.int64)
    ok = np.ones(n, dtype=bool)
    if p.has("t"):
        ok &= np.isin(m[:, p.spans["t"][0]], np.frombuffer(b"Tt ", dtype=np.uint8))
    if p.has("first"):
        a, b = num("first"), num("other")
        dmy = np.where(ctx.order == "mdy", False, True)
        known = (ctx.order == "dmy") | (ctx.order == "mdy")
        day, month = np.where(dmy, a, b), np.where(dmy, b, a)
        ok &= known | (a == b)
    else:
        day = num("day")
        month = _index(_names(m, p.spans["mon"]), MONTHS) if p.has("mon") else num("month")
    year = num("year") if p.has("year") else 2000 + num("yy") if p.has("yy") else None
    hour, minute, second = num("hour"), num("minute"), num("second")
    if p.has("half"):
        half = _names(m, p.spans["half"])
        ok &= (hour >= 1) & (hour <= 12) & np.isin(half, ["AM", "PM"])
        hour = hour % 12 + np.where(half == "PM", 12, 0)
    ok &= (month >= 1) & (month <= 12) & (day >= 1) & (hour <= 23) & (minute <= 59) & (second <= 59)
    clock = hour * 3600 + minute * 60 + second
    fraction = np.zeros(n, dtype=np.int64)
    if p.has("fraction"):
        a, b = p.spans["fraction"]
        fraction = _numbers(m, (a, min(b, a + 6))) * 10 ** max(0, 6 - (b - a))
    safe_month = np.where((month >= 1) & (month <= 12), month, 1)

    def wall_of(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = days_from_civil(y, safe_month, 1)
        length = days_from_civil(y + safe_month // 12, safe_month % 12 + 1, 1) - first
        return (first + day - 1) * 86400 + clock, day <= length

    if year is None:
        wall, fits = _latest_year(wall_of, fraction, ctx, tables)
    else:
        ok &= year > 1
        wall, fits = wall_of(year)
    ok &= fits
    if p.has("weekday"):
        ok &= _index(_names(m, p.spans["weekday"]), DAYS) == (wall // 86400 + 3) % 7 + 1
    if p.has("zulu"):
        ok &= np.isin(m[:, p.spans["zulu"][0]], np.frombuffer(b"Zz", dtype=np.uint8))
        utc = wall
    elif p.has("sign"):
        zh, zm = num("zh"), num("zm")
        ok &= (zh <= 18) & (zm <= 59)
        utc = wall - np.where(m[:, p.spans["sign"][0]] == 45, -1, 1) * (zh * 3600 + zm * 60)
        if p.has("zone"):
            a, b = p.spans["zone"]
            zones = np.array([bytes(r).decode() for r in m[:, a:b]], dtype=object)
            for z in {*zones.tolist()}:
                rows = np.flatnonzero(zones == z)
                t = tables(z)
                if t is not None:  # the offset must be one that the zone has then
                    ok[rows] &= t.offset[offsets_at(t, utc[rows])] == wall[rows] - utc[rows]
    elif p.has("abbr") or p.has("abbr2"):
        key = next(k for k in ("abbr", "abbr2") if p.has(k))
        names = _names(m, p.spans[key]).astype(object)
        plain = (names == "UTC") | (names == "GMT")
        utc, there = _local(ctx.zone, wall, names, tables)
        ok &= there | plain
        utc = np.where(plain, wall, utc)
    else:
        utc, there = _local(ctx.zone, wall, None, tables)
        ok &= there
    us = utc * 1_000_000 + fraction
    return us, ok & (us != 0) & (wall != 0)


def _latest_year(wall_of: Callable, fraction: np.ndarray, ctx: Context, tables: Callable[[str | None], ZoneTable | None]) -> tuple[np.ndarray, np.ndarray]:
    """Wall-clock seconds in the latest year that doesn't put them after the receipt on the same clock."""
    n = len(fraction)
    limit, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for z in {*ctx.zone.tolist()}:
        t = tables(z)
        if t is not None:
            rows = np.flatnonzero((ctx.zone == z) & ctx.has_received)
            s = ctx.received[rows] // 1_000_000
            limit[rows] = ctx.received[rows] + t.offset[offsets_at(t, s)] * 1_000_000
            ok[rows] = True
    year = np.asarray(limit // 1_000_000).astype("datetime64[s]").astype("datetime64[Y]").astype(np.int64) + 1970
    wall, found = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for back in range(9):  # a 29 February is at most eight years away
        w, fits = wall_of(year - back)
        new = ~found & fits & (w * 1_000_000 + fraction <= limit)
        wall = np.where(new, w, wall)
        found |= new
    return wall, found & ok


def utc_micros(texts: pa.Array, ctx: Context, tables: Callable[[str | None], ZoneTable | None] = zone_table) -> tuple[np.ndarray, np.ndarray]:
    """UTC microseconds of a column of texts, and which of them are determined."""
    texts = texts.cast(pa.string())
    us, ok = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    codes = pc.dictionary_encode(shapes(texts)) if len(texts) else None
    if codes is None:
        return us, ok
    index = np.asarray(pc.fill_null(codes.indices, -1))
    order = np.argsort(index, kind="stable")
    bounds = np.searchsorted(index[order], np.arange(len(codes.dictionary) + 1))
    for k, shape in enumerate(codes.dictionary.to_pylist()):
        p = parser_of(shape)
        if p is None:
            continue
        rows = order[bounds[k] : bounds[k + 1]]
        us[rows], ok[rows] = _moments(p, _matrix(texts.take(pa.array(rows)), len(shape)), ctx.take(rows), tables)
    return us, ok


def _context(batch: pa.RecordBatch) -> Context:
    received = batch.column("received_us")
    return Context(
        np.array(batch.column("zone").to_pylist(), dtype=object), np.array(batch.column("order").to_pylist(), dtype=object),
        np.asarray(pc.fill_null(received, 0)), np.asarray(received.is_valid()),
    )


def _normalise(zones: Zones):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, ok = utc_micros(batch.column("text"), _context(batch), zones)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(np.zeros(len(us), dtype=np.int64)), pa.array(us, mask=~ok)], names=["row_id", "rec_pos", "utc_us"])

    return work


def _normalise_json(leaf: Leaf, wrapper: str, zones: Zones):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shred(batch.column("text").to_pylist(), [leaf], wrapper)[leaf.child]
            rep, defn = np.asarray(s.rep, dtype=np.int8), np.asarray(s.defn, dtype=np.int8)
            row, rec, _ = positions(rep, defn)
            there = np.flatnonzero(defn >= 1)
            row, rec = row[there], rec[there]
            texts = pa.array([None if s.values[i] is None else str(s.values[i]) for i in there], pa.string())
            us, ok = utc_micros(texts, _context(batch).take(row), zones)
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(row)), pa.array(rec), pa.array(us, mask=~ok)], names=["row_id", "rec_pos", "utc_us"])

    return work


_OUT = "row_id bigint, rec_pos bigint, utc_us bigint"


def normalise_timestamps(df: DataFrame, row_id: str, text: str, zone: Column, order: Column, received: str | None = None, json_leaf: Leaf | None = None, wrapper: str = "data") -> DataFrame:
    """One row per moment: ``row_id``, ``rec_pos``, ``utc_us``, the last null where the moment is undetermined.

    ``zone`` and ``order`` give each row's IANA zone and order of numeric dates
    (``dmy`` or ``mdy``), ``received`` is needed for texts without a year. With
    ``json_leaf`` the texts are JSON bodies and the moments that field of their
    records. Null, empty, blank, very long and impossible texts are undetermined;
    so are local times where the zone is null or unknown, and zero values: the
    instant 0, and a wall clock at 1970-01-01 00:00, in whatever zone. Zone tables are
    the driver's, of one version for all tasks. Rows with the same
    ``row_id`` count once (the first received), those without one not at all.
    """
    df = df.withColumn("__zone", zone).withColumn("__order", order)
    own = first_delivery(df, row_id, received, text, "__zone", "__order")
    at = F.unix_micros(F.col(f"`{received}`").cast("timestamp")) if received else F.lit(None).cast("bigint")
    slim = own.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text"), F.col("__zone").alias("zone"), F.col("__order").alias("order"), at.alias("received_us"))
    zones = installed_zones()  # of the driver, for all tasks
    return slim.mapInArrow(_normalise_json(json_leaf, wrapper, zones) if json_leaf else _normalise(zones), _OUT)


TIME = Leaf("time", "time", None, False)


def with_sensors(df: DataFrame, sensors: DataFrame) -> DataFrame:
    """Each row's zone and date order. The join is left to the planner, which broadcasts by the measured size of ``sensors`` only."""
    s = sensors.groupBy("sensor_id").agg(F.min(F.struct("tz_name", "date_order")).alias("__sensor")).withColumnRenamed("sensor_id", "__sensor_id")
    return df.join(s, F.col("sensor_id") == F.col("__sensor_id"), "left")


def p2_moments(spark, sf_dir: str) -> DataFrame:
    """All moments of the three tables, undetermined ones as null."""
    sensors = load(spark, sf_dir, "sensors")
    zone, order = F.col("__sensor.tz_name"), F.col("__sensor.date_order")
    dns = normalise_timestamps(with_sensors(load(spark, sf_dir, "dns_queries"), sensors), "query_id", "ts_raw", zone, order, "received_at")
    adguard = normalise_timestamps(with_sensors(load(spark, sf_dir, "adguard_log"), sensors), "rec_id", "body", zone, order, "received_at", TIME)
    feodo = normalise_timestamps(load(spark, sf_dir, "feodo_entries"), "entry_id", "first_seen", F.lit("UTC"), F.lit("dmy"))
    parts = [d.withColumn("src", F.lit(n)) for d, n in ((dns, "dns_queries"), (adguard, "adguard_log"), (feodo, "feodo_entries"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("src", "row_id", "rec_pos", "utc_us")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return p2_moments(spark, sf_dir).where("utc_us is not null")


QUERIES = {"p2_found": p2_found, "p2_moments": p2_moments}
SQL: dict[str, str] = {}
