import datetime as D
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pytest

from siftnet.functions.zones import tz_version, wall_to_utc, zone_table
from siftnet.operators.timestamps import Context, normalise_timestamps, parser_of, shapes, utc_micros

ZONES = ["America/New_York", "America/St_Johns", "Asia/Kathmandu", "Australia/Lord_Howe", "Europe/London", "Africa/Casablanca", "America/Sao_Paulo", "UTC"]
US = lambda *a: int((D.datetime(*a) - D.datetime(1970, 1, 1)) / D.timedelta(microseconds=1))


def one(text, zone="Europe/Berlin", order="dmy", received=US(2024, 3, 1, 12)):
    ctx = Context(np.array([zone], dtype=object), np.array([order], dtype=object), np.array([received or 0]), np.array([received is not None]))
    us, ok = utc_micros(pa.array([text], pa.string()), ctx)
    return int(us[0]) if ok[0] else None


@pytest.mark.parametrize("name", ZONES)
def test_tables_follow_the_library(name):
    t, z = zone_table(name), ZoneInfo(name)
    wall = np.arange(US(1975, 1, 1) // 10**6, US(2060, 1, 1) // 10**6, 86400 * 5 + 4321)
    edges = np.concatenate([t.utc[1:] + o + d for o in (0, 3600) for d in (-1, 0, 1, 1799, 1800, 3600)] or [np.zeros(0, dtype=np.int64)])
    wall = np.concatenate([wall, edges[(edges > wall[0]) & (edges < wall[-1])] + t.offset[-1]])
    utc, ok = wall_to_utc(t, wall)
    for w, u, k in zip(wall.tolist()[::7], utc.tolist()[::7], ok.tolist()[::7]):
        naive = D.datetime(1970, 1, 1) + D.timedelta(seconds=w)
        real = set()
        for fold in (0, 1):
            x = naive.replace(tzinfo=z, fold=fold).astimezone(D.timezone.utc)
            if x.astimezone(z).replace(tzinfo=None) == naive:
                real.add(int(x.timestamp()))
        assert k == (len(real) == 1)
        if k:
            assert real == {u}


def test_versions_are_refused():
    assert zone_table("UTC", tz_version()) is not None
    with pytest.raises(ValueError):
        zone_table("UTC", "1970a")
    assert zone_table("No/Where") is None and zone_table("../etc/passwd") is None


CASES = {
    "2024-02-29T10:00:00Z": US(2024, 2, 29, 10), "2024-02-29 10:00:00.1234569z": US(2024, 2, 29, 10, 0, 0, 123456), "2023-02-29T10:00:00Z": None, "2024-13-01T00:00:00Z": None, "2024-00-10T01:00:00Z": None,
    "2024-01-01T24:00:00Z": None, "2024-01-01T10:60:00Z": None, "20240102T030405+0530": US(2024, 1, 1, 21, 34, 5), "2024-07-01 12:00:00": US(2024, 7, 1, 10), "2024-03-31 02:30:00": None, "2024-10-27 02:30:00": None,
    "2024-10-27 02:30:00 CEST": US(2024, 10, 27, 0, 30), "2024-10-27 02:30:00 CET": US(2024, 10, 27, 1, 30), "2024-10-27T02:30:00+01:00[Europe/Berlin]": US(2024, 10, 27, 1, 30), "2024-07-01 12:00:00 EST": None,
    "03/04/2024 05:06:07 PM": US(2024, 4, 3, 15, 6, 7), "12/01/24 00:00:01": US(2024, 1, 11, 23, 0, 1), "13.12.2023 01:02:03": US(2023, 12, 13, 0, 2, 3), "03/04/2024 13:06:07 PM": None,
    "Feb 29 10:00:00": US(2024, 2, 29, 9), "Mar  2 10:00:00": US(2023, 3, 2, 9), "Mar  1 13:00:00": US(2024, 3, 1, 12), "Mar  1 13:00:01": US(2023, 3, 1, 12, 0, 1),
    "Fri, 12 May 2023 06:44:35 +0100": US(2023, 5, 12, 5, 44, 35), "Mon, 12 May 2023 06:44:35 +0100": None, "1700000000": US(2023, 11, 14, 22, 13, 20), "1700000000123": US(2023, 11, 14, 22, 13, 20, 123000),
    "1700000000123456": US(2023, 11, 14, 22, 13, 20, 123456), "1700000000123456789": US(2023, 11, 14, 22, 13, 20, 123456), "1.7e+09": US(2023, 11, 14, 22, 13, 20), "1700000000.5": US(2023, 11, 14, 22, 13, 20, 500000),
    "2024-01-05": US(2024, 1, 4, 23), '"2024-01-05T00:00:00Z"': US(2024, 1, 5), "  2024-01-05T00:00:00Z ": US(2024, 1, 5), "0": None, "1970-01-01T00:00:00Z": None, "0001-01-01T00:00:00Z": None, "": None, "   ": None, "now": None, "N/A": None,
    "2024-01-01T00:00:00A": None, "9" * 25: None, "x" * 100_000: None, "2024-01-01T00:00:00+25:00": None, "２０２４": None, None: None,
}


@pytest.mark.parametrize("text", CASES)
def test_formats(text):
    assert one(text) == CASES[text]


def test_numbers_with_points_and_exponents():
    """Against exact decimals, for every unit."""
    import random
    from decimal import Decimal

    rnd = random.Random(1)
    for _ in range(1500):
        whole = str(rnd.randrange(10 ** rnd.randrange(1, 20)))
        text = whole + (f".{rnd.randrange(10**9):09d}"[: rnd.randrange(2, 11)] if rnd.random() < 0.7 else "") + (rnd.choice(["e", "E"]) + rnd.choice(["", "+", "-"]) + str(rnd.randrange(0, 19)) if rnd.random() < 0.5 else "")
        v = Decimal(text)
        factor = next((f for lim, f in ((10**11, 10**6), (10**14, 10**3), (10**17, 1)) if v < lim), None)
        want = int(v * factor) if factor else int(v) // 1000
        got = one(text)
        assert got == (want or None) or (v >= 9 * 10**18 and got is None), text


def test_rules_go_on():
    """Rules hold after 2100, and after the years for which they are written out."""
    for y in (2101, 2399, 2499, 2500, 2501, 2893, 4000, 9998):
        for text, hours in ((f"{y}-01-15 12:00:00", 1), (f"{y}-07-15 12:00:00", 2)):
            assert one(text) == US(y, int(text[5:7]), 15, 12 - hours), text
    assert one("2600-07-15 12:00:00", zone="Asia/Kathmandu") == US(2600, 7, 15, 6, 15)


def test_tables_go_with_the_tasks():
    import pickle

    from siftnet.functions.zones import Zones

    z = pickle.loads(pickle.dumps(Zones()))
    assert z.version == tz_version() and z("No/Where") is None and z(None) is None
    for name in ("Europe/Berlin", "UTC"):
        assert np.array_equal(z(name).utc, zone_table(name).utc) and np.array_equal(z(name).offset, zone_table(name).offset)


def test_unknown_context():
    assert one("2024-07-01 12:00:00", zone=None) is None and one("2024-07-01 12:00:00", zone="No/Where") is None
    assert one("03/04/2024 05:06:07", order=None) is None and one("03/03/2024 05:06:07", zone="UTC", order=None) == US(2024, 3, 3, 5, 6, 7)
    assert one("Jan  1 00:00:00", received=None) is None
    assert one("2024-07-01T12:00:00Z", zone=None) == US(2024, 7, 1, 12)


def test_one_parser_a_shape():
    assert shapes(pa.array(["2024-01-02", None, "Ab9é"])).to_pylist() == ["9999-99-99", None, "AA9??"]
    assert parser_of("9999-99-99") is parser_of("9999-99-99") and parser_of("AAA") is None


def test_table(spark):
    from pyspark.sql import functions as F

    s = "id bigint, raw string, received timestamp, z string, zone string, text string"
    empty = spark.createDataFrame([], s)
    assert normalise_timestamps(empty, "id", "raw", F.col("z"), F.lit("dmy"), "received").count() == 0
    rows = [(1, "2024-01-01T00:00:00Z", None, None, "a", "b"), (1, "2024-01-01T00:00:00Z", None, None, "a", "b"), (2, None, None, "UTC", "", ""), (None, "2024-01-01T00:00:00Z", None, None, "", "")]
    got = normalise_timestamps(spark.createDataFrame(rows, s), "id", "raw", F.col("z"), F.lit("dmy"), "received").collect()
    assert sorted((r.row_id, r.rec_pos, r.utc_us) for r in got) == [(1, 0, US(2024, 1, 1)), (2, 0, None)]
