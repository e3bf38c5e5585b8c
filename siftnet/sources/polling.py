"""Polled HTTP interfaces as a streaming source: each poll asks for what is newer than the high-water mark.

The mark is the offset of the stream, so that it advances with what was read and
written and never with the clock; an empty poll leaves it where it is. A poll
reads pages until one is short, each from the last second of the one before,
and the offset holds what was read of the second of the mark, so that the rest
of that second is read when it comes. The interface must give the records from
``from`` on, itself included, the oldest first; a second that no response holds
is an error. What comes later for seconds before the mark isn't read.
"""

from __future__ import annotations

import hashlib
import json
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType


class PollingSource(DataSource):
    """``spark.readStream.format("siftnet_poll").option("url", ...)``.

    Options: ``url`` (asked with ``from`` and ``limit``), ``items`` (field of the
    response's array, ``data``), ``time`` (field of a record's Unix time in
    seconds), ``start`` (first mark), ``limit`` (records a page, 1000), ``token``
    (sent as a bearer token) and ``header.NAME`` (other headers).
    """

    @classmethod
    def name(cls) -> str:
        return "siftnet_poll"

    def schema(self) -> str:
        return "t bigint, body string"

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def _key(body: str) -> str:
    return hashlib.blake2b(body.encode(), digest_size=12).hexdigest()


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.url, self.items, self.time = options["url"], options.get("items", "data"), options.get("time", "timestamp")
        self.headers = {k[7:]: v for k, v in options.items() if k.lower().startswith("header.")} | ({"Authorization": f"Bearer {options['token']}"} if options.get("token") else {})
        self.start, self.limit = int(options.get("start", "0")), int(options.get("limit", "1000"))

    def initialOffset(self) -> dict:
        return {"mark": self.start}

    def _page(self, mark: int, limit: int) -> tuple[list[tuple[int, str]], int]:
        """A response's records in order of time, and how many it had at all."""
        query = urllib.parse.urlencode({"from": mark, "limit": limit})
        with urllib.request.urlopen(urllib.request.Request(f"{self.url}?{query}", headers=self.headers), timeout=10) as r:
            data = json.load(r).get(self.items) or []
        return sorted((int(x[self.time]), json.dumps(x, sort_keys=True)) for x in data if isinstance(x, dict) and x.get(self.time) is not None), len(data)

    def _fetch(self, start: dict, until: int | None = None) -> Iterator[tuple[int, str]]:
        """Everything from the offset on that it hasn't read, page after page, up to a short one or one beyond ``until``. Without ``seen`` the second of the mark counts as read."""
        mark, limit, newer = start["mark"], self.limit, False
        at, seen = mark, Counter(start["seen"]) if "seen" in start else None
        while True:
            rows, size = self._page(at, limit)
            left = Counter(seen)
            now: Counter = Counter()  # what the last second of the page has
            last = rows[-1][0] if rows else at
            for t, body in rows:
                if t < at or (t == mark and "seen" not in start):
                    continue
                key = _key(body)
                if t == last:
                    now[key] += 1
                if t == at and left[key] > 0:
                    left[key] -= 1
                else:
                    yield t, body
            if size < limit and last == at and newer:
                raise RuntimeError(f"{self.url}: second {at} has more records than a response holds ({size})")
            if size < limit or (until is not None and last > until):
                return
            if last > at:
                at, seen, limit, newer = last, now, self.limit, False
            else:  # a second with a page of records or more; if there are later ones, a longer page must reach them
                seen, limit, newer = (seen or Counter()) | now, limit * 2, self._page(at + 1, 1)[1] > 0

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = list(self._fetch(start))
        mark = max([start["mark"], *(t for t, _ in rows)])
        if mark == start["mark"] and "seen" not in start:
            return iter(rows), start
        seen = Counter(_key(body) for t, body in rows if t == mark)
        if mark == start["mark"]:
            seen += Counter(start["seen"])
        return iter(rows), {"mark": mark, "seen": dict(seen)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        left = Counter(end.get("seen"))
        if end["mark"] == start["mark"]:
            left -= Counter(start.get("seen"))
        out = []
        for t, body in self._fetch(start, end["mark"]):
            if t == end["mark"] and "seen" in end:
                if left[_key(body)] <= 0:
                    continue  # came later; the next batch has it
                left[_key(body)] -= 1
            if t <= end["mark"]:
                out.append((t, body))
        return iter(out)
