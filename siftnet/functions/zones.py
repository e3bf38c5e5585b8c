"""Versioned transition tables of time zones, and conversion by whole columns."""

from __future__ import annotations

import os
import pickle
import struct
import zlib
from dataclasses import dataclass
from functools import lru_cache
from zoneinfo import TZPATH, available_timezones

import numpy as np

#: Recurring rules are written out from 1970 for one cycle of the calendar beyond 2100, after which dates and days of the week come again.
LAST_YEAR = 2500
CYCLE = 146_097 * 86_400
FAR = 16_725_225_600  # 2500-01-01
_DAYS_BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


@dataclass(frozen=True)
class ZoneTable:
    """``utc`` are the seconds at which an offset begins (the first is minus infinity), ``offset`` its seconds east of UTC and ``abbr`` its name."""

    name: str
    version: str
    utc: np.ndarray
    offset: np.ndarray
    abbr: np.ndarray


def _find(name: str) -> bytes | None:
    if not name or name.startswith(("/", ".")) or ".." in name:
        return None
    for root in TZPATH:
        path = os.path.join(root, name)
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    try:
        from importlib import resources

        return resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


@lru_cache(maxsize=1)
def tz_version() -> str:
    """The version of the tables that are installed."""
    for root in TZPATH:
        try:
            with open(os.path.join(root, "tzdata.zi")) as f:
                return f.readline().split()[-1]
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of Gregorian dates."""
    y = np.asarray(y, dtype=np.int64) - (np.asarray(m) <= 2)
    era = np.floor_divide(y, 400)
    yoe = y - era * 400
    doy = (153 * ((np.asarray(m, dtype=np.int64) + 9) % 12) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _posix_rules(text: str) -> tuple[int, str, int, str, list[tuple[str, int]]] | None:
    """A footer as offset and name of standard and of summer time, and the two dates of change with their seconds."""
    import re

    name = r"(<[^>]+>|[A-Za-z]+)"
    span = r"([+-]?\d+(?::\d+){0,2})"
    m = re.fullmatch(rf"{name}{span}(?:{name}(?:{span})?,([^,/]+)(?:/{span})?,([^,/]+)(?:/{span})?)?", text)
    if not m:
        return None

    def secs(s: str) -> int:
        sign = -1 if s.startswith("-") else 1
        parts = [int(p) for p in s.lstrip("+-").split(":")]
        return sign * sum(p * u for p, u in zip(parts, (3600, 60, 1)))

    std = -secs(m[2])
    if not m[3]:
        return std, m[1].strip("<>"), std, "", []
    dst = -secs(m[4]) if m[4] else std + 3600
    return std, m[1].strip("<>"), dst, m[3].strip("<>"), [(m[5], secs(m[6]) if m[6] else 7200), (m[7], secs(m[8]) if m[8] else 7200)]


def _rule_day(rule: str, year: int) -> int:
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    jan1 = int(days_from_civil(year, 1, 1))
    if rule[0] == "M":
        month, week, day = map(int, rule[1:].split("."))
        first = int(days_from_civil(year, month, 1))
        d = first + (day - (first + 4) % 7) % 7 + 7 * (week - 1)
        end = int(days_from_civil(year + month // 12, month % 12 + 1, 1))
        return d if d < end else d - 7
    if rule[0] == "J":
        n = int(rule[1:])
        return jan1 + n - 1 + (1 if leap and n >= 60 else 0)
    return jan1 + int(rule)


def parse_tzif(data: bytes, name: str, version: str) -> ZoneTable:
    """The transitions of a compiled zone file, its footer's rule written out."""

    def header(at: int) -> tuple[int, ...]:
        return struct.unpack(">4s1s15x6l", data[at : at + 44])[2:]

    isut, isstd, leaps, times, types, chars = header(0)
    at = 44
    if data[4:5] >= b"2":
        at += times * 5 + types * 6 + chars + leaps * 8 + isstd + isut
        isut, isstd, leaps, times, types, chars = header(at)
        at += 44
        width, code = 8, "q"
    else:
        width, code = 4, "l"
    utc = list(struct.unpack(f">{times}{code}", data[at : at + times * width]))
    at += times * width
    idx = list(data[at : at + times])
    at += times
    infos = [struct.unpack(">lbB", data[at + 6 * i : at + 6 * i + 6]) for i in range(types)]
    at += 6 * types
    names = data[at : at + chars]
    at += chars + leaps * (width + 4) + isstd + isut
    label = lambda i: names[infos[i][2] : names.index(b"\0", infos[i][2])].decode()
    first = next((i for i, x in enumerate(infos) if not x[1]), 0)
    rows = [(-(2**62), infos[first][0], label(first)), *((t, infos[i][0], label(i)) for t, i in zip(utc, idx))]
    footer = data[at:].strip(b"\n").decode() if width == 8 else ""
    rules = _posix_rules(footer) if footer else None
    if rules and rules[4]:
        std, std_name, dst, dst_name, ((begin, begin_s), (end, end_s)) = rules
        last = rows[-1][0]
        more = []
        for year in range(1970, LAST_YEAR):
            more += [(_rule_day(begin, year) * 86400 + begin_s - std, dst, dst_name), (_rule_day(end, year) * 86400 + end_s - dst, std, std_name)]
        rows += [r for r in sorted(more) if last < r[0] < FAR]
    elif rules and not utc:
        rows = [(-(2**62), rules[0], rules[1])]
    return ZoneTable(name, version, np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=object))


def _of_utc(name: str) -> ZoneTable:
    return ZoneTable(name, tz_version(), np.array([-(2**62)], dtype=np.int64), np.array([0], dtype=np.int64), np.array(["UTC" if name.upper() != "GMT" else "GMT"], dtype=object))


@lru_cache(maxsize=1024)
def zone_table(name: str | None, version: str | None = None) -> ZoneTable | None:
    """The installed table of a zone, or ``None`` for one that isn't known. Another ``version`` than the one installed is refused."""
    if version is not None and version != tz_version():
        raise ValueError(f"zone tables of version {tz_version()} are installed, not {version}")
    if name is None:
        return None
    if name.upper() in ("UTC", "Z", "GMT", "ETC/UTC"):
        return _of_utc(name)
    data = _find(name)
    return parse_tzif(data, name, tz_version()) if data and data[:4] == b"TZif" else None


class Zones:
    """The tables of one version, as they are on the machine that made this: it goes with its tasks, so that all executors convert alike, whatever is installed there."""

    def __init__(self) -> None:
        files = {name: _find(name) for name in available_timezones()}
        self.version = tz_version()
        self.packed = zlib.compress(pickle.dumps({k: v for k, v in files.items() if v and v[:4] == b"TZif"}))

    def __call__(self, name: str | None) -> ZoneTable | None:
        if name is None:
            return None
        return _of_utc(name) if name.upper() in ("UTC", "Z", "GMT", "ETC/UTC") else _shipped(self.packed, self.version, name)


@lru_cache(maxsize=2)
def _files(packed: bytes) -> dict[str, bytes]:
    return pickle.loads(zlib.decompress(packed))


@lru_cache(maxsize=2048)
def _shipped(packed: bytes, version: str, name: str) -> ZoneTable | None:
    data = _files(packed).get(name)
    return parse_tzif(data, name, version) if data else None


@lru_cache(maxsize=1)
def installed_zones() -> Zones:
    return Zones()


def _within(seconds: np.ndarray) -> np.ndarray:
    """Times beyond the written rules, moved back by whole cycles of the calendar."""
    return np.where(seconds >= FAR, seconds - (seconds - FAR + CYCLE) // CYCLE * CYCLE, seconds)


def offsets_at(table: ZoneTable, utc_s: np.ndarray) -> np.ndarray:
    """Which of a table's offsets holds at UTC seconds."""
    return np.searchsorted(table.utc, _within(utc_s), side="right") - 1


def wall_to_utc(table: ZoneTable, wall_s: np.ndarray, abbr: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall-clock seconds, and whether they are determined.

    A time that the zone skips isn't, nor one that it has twice, unless ``abbr``
    names the offset. With ``abbr`` only offsets of that name count.
    """
    n = len(wall_s)
    ok = np.zeros(n, dtype=np.int8)
    utc = np.zeros(n, dtype=np.int64)
    guess = np.stack([offsets_at(table, wall_s - 93_600), offsets_at(table, wall_s), offsets_at(table, wall_s + 93_600)])
    seen = np.full((3, n), np.iinfo(np.int64).min)
    for k in range(3):
        u = wall_s - table.offset[guess[k]]
        at = offsets_at(table, u)
        fits = table.offset[at] == table.offset[guess[k]]
        if abbr is not None:
            fits &= table.abbr[at] == abbr
        fits &= ~(seen[:k] == u).any(axis=0)
        seen[k] = np.where(fits, u, seen[k])
        ok += fits
        utc = np.where(fits, u, utc)
    return utc, ok == 1
