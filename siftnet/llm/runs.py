"""Runs of near-identical consecutive events as one entry each.

An entity's sequence is divided into runs so that the dissimilarity within runs
plus a penalty for each boundary is least. A run's dissimilarity is ``mismatch``
for every event that isn't like the run's most frequent kind; neighbours more
than ``max_gap_us`` apart are never in one run. The best division of a prefix is
found by dynamic programming over the start of its last run; starts that can never
be the best again are pruned, which leaves one or two at most times.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.session import materialize
from siftnet.tables import domain_key, load, micros, pack_hex, unpack_hex


def whole_costs(penalty: float, mismatch: float) -> tuple[float, float]:
    """Both costs as integers of the same ratio (as written in decimals), so that equal costs are equal however they add up; an infinite one stays."""
    if mismatch == inf:
        return penalty, mismatch
    p, m = Fraction(str(penalty)), Fraction(str(mismatch))
    return int(p * p.denominator * m.denominator), int(m * p.denominator * m.denominator)


class Frontier:
    """The dynamic programming over a sequence of any length, fed in parts.

    Held are the starts that may still be the best and where runs begin that aren't
    settled: once the best division and those before all open starts agree on what
    lies before, that is given out. A start is dropped once its cost has passed that
    of the prefix; and it is no start at all within a stretch of one kind, or if an
    earlier one is as cheap even when all that lies between them is odd: none of
    these can be the best again, nor the first of equally good ones.
    """

    def __init__(self, penalty: float, mismatch: float) -> None:
        self.penalty, self.mismatch = whole_costs(penalty, mismatch)
        self.cost, self.begin, self.starts, self.floor, self.base, self.size, self.kind = -self.penalty, [], [], inf, 0, 0, None

    def push(self, kinds: list, near: list[bool]) -> None:
        """Add events; ``near``: whether each may be in the run of the one before."""
        penalty, mismatch, finite = self.penalty, self.mismatch, self.mismatch < inf
        cost, starts, floor, before, i = self.cost, self.starts, self.floor, self.kind, self.size
        for kind, close in zip(kinds, near):
            if not close:
                starts, floor = [], inf
            if not starts or kind != before:
                level = cost - mismatch * i if finite else cost
                if not finite or level < floor:
                    starts.append([i, cost, {}, 0, 0])  # start, cost up to it, count by kind, most frequent count, events
                    floor = level if finite else floor
            before, best, at, within = kind, inf, i, []
            for s in starts:
                counts = s[2]
                c = counts[kind] = counts.get(kind, 0) + 1
                if c > s[3]:
                    s[3] = c
                s[4] += 1
                odd = s[4] - s[3]
                w = s[1] + odd * mismatch if odd else s[1]
                within.append(w)
                if w + penalty < best:
                    best, at = w + penalty, s[0]
            cost = best
            self.begin.append(at)
            i += 1
            if max(within) > best:
                starts = [s for s, w in zip(starts, within) if w <= best]
        self.cost, self.starts, self.floor, self.kind, self.size = cost, starts, floor, before, i

    def _trace(self, i: int) -> list[int]:
        out = []
        while i >= self.base:
            out.append(self.begin[i - self.base])
            i = out[-1] - 1
        return out[::-1]

    def settled(self) -> list[int]:
        """Starts of runs that no further event changes, and, last, where the first unsettled one begins; empty if there is none."""
        shared = []
        for x in zip(self._trace(self.size - 1), *(self._trace(s[0] - 1) for s in self.starts)):
            if any(y != x[0] for y in x):
                break
            shared.append(x[0])
        if len(shared) < 2:
            return []
        self.begin, self.base = self.begin[shared[-1] - self.base :], shared[-1]
        return shared

    def finish(self) -> list[int]:
        return self._trace(self.size - 1)


def segment(kinds: list[int], near: list[bool], penalty: float = 1.0, mismatch: float = inf) -> list[int]:
    """Starts of the runs of the best division of one sequence; ``near[i]``: event ``i`` may be in the run of the one before. Of equally good divisions the one with the longest runs, from the end."""
    f = Frontier(penalty, mismatch)
    f.push(kinds, near)
    return f.finish()


_RUN = "k binary, t0 bigint, t1 bigint, first_id binary, last_id binary, first_kind string, last_kind string, n bigint, first boolean, last boolean"


@dataclass
class Rows:
    """Events of chunks in order: redelivered rows are gone, equal times stand in the order of the ids' texts."""

    k: pa.Array
    id: pa.Array
    kind: pa.Array
    part: np.ndarray
    us: np.ndarray
    code: np.ndarray

    def begins(self) -> np.ndarray:
        """Where a chunk of an entity begins."""
        return np.r_[True, self.part[1:] != self.part[:-1]]

    def near(self, max_gap_us: int) -> np.ndarray:
        """Whether an event is near enough to the one before in its chunk."""
        return ~self.begins() & np.r_[False, self.us[1:] - self.us[:-1] <= max_gap_us]


def _codes(a: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray((a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).dictionary_encode().indices)


def _text_of_id(packed: bytes) -> bytes:
    """What ``unpack_hex`` makes of a packed id, as bytes."""
    body = packed[1:].hex()
    return packed[1:] if packed[:1] == b"\0" else (body if packed[:1] == b"\1" else f"{body[:8]}-{body[8:12]}-{body[12:16]}-{body[16:20]}-{body[20:]}").encode()


def _rows_of(tables: list[pa.Table], keys: list[str]) -> Rows:
    """Rows that come ordered by ``keys`` and time."""
    t = pa.concat_tables(tables).combine_chunks()
    us, part = np.asarray(t.column("t")), np.zeros(t.num_rows, dtype=np.int64)
    for k in keys:
        c = _codes(t.column(k))
        part = part * (int(c.max()) + 1) + c
    idx = _codes(t.column("id"))
    tied = np.r_[False, (part[1:] == part[:-1]) & (us[1:] == us[:-1])]
    order = np.arange(t.num_rows)
    if tied.any():
        # only rows that share their time with a neighbour are put in the order of their ids
        at = np.flatnonzero(tied | np.r_[tied[1:], False])
        group = np.cumsum(~tied)[at]
        texts = np.array([_text_of_id(x) for x in t.column("id").take(pa.array(at)).to_pylist()], dtype=object)
        rank = np.empty(len(at), dtype=np.int64)
        rank[np.argsort(texts, kind="stable")] = np.arange(len(at))
        order[at] = at[np.lexsort((rank, group))]
        same = np.r_[False, tied[1:] & (idx[order][1:] == idx[order][:-1])]
        order = order[~same]
    take = pa.array(order)
    kind = t.column("kind").combine_chunks().take(take)
    return Rows(t.column("k").combine_chunks().take(take), t.column("id").combine_chunks().take(take), kind, part[order], us[order], _codes(kind))


def _by_groups(finish: Callable[[list[pa.Table]], Iterator[pa.RecordBatch]], keys: list[str], most: int = 200_000):
    """Calls ``finish`` with rows of equal ``keys``, several groups at once, as they stream by in the order of time. A group of more than ``most`` rows comes in parts, none of which ends between equal times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            new = np.zeros(t.num_rows, dtype=bool)
            for c in (_codes(t.column(k)) for k in keys):
                new |= np.r_[False, c[1:] != c[:-1]]
            open_at = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if held and open_at == 0 and any(held[-1].column(k)[-1] != t.column(k)[0] for k in keys):
                yield from finish(held)
                held = []
            if open_at:
                yield from finish([*held, t.slice(0, open_at)])
                held = []
            held.append(t.slice(open_at))
            if sum(x.num_rows for x in held) > most:
                whole = pa.concat_tables(held)
                us = np.asarray(whole.column("t"))
                later = np.flatnonzero(us[1:] != us[:-1])
                if len(later):
                    yield from finish([whole.slice(0, int(later[-1]) + 1)])
                    whole = whole.slice(int(later[-1]) + 1)
                held = [whole]
        if held:
            yield from finish(held)

    return work


def _whole_chunks(max_gap_us: int, penalty: float, mismatch: float, least: int):
    """Runs of chunks that may be cut anywhere (an ``anchor_length`` of 1), every event of which goes through the dynamic programming."""

    def finish(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        r = _rows_of(tables, ["k", "chunk"])
        cut = r.begins()
        begin = np.array(segment(r.code.tolist(), r.near(max_gap_us).tolist(), penalty, mismatch), dtype=np.int64)
        end = np.r_[begin[1:], len(r.code)] - 1
        n = end - begin + 1
        first, last = cut[begin], np.r_[cut[1:], True][end]
        keep = np.flatnonzero((n >= least) | first | last)
        a, b = pa.array(begin[keep]), pa.array(end[keep])
        yield from pa.table(
            [r.k.take(a), pa.array(r.us[begin[keep]]), pa.array(r.us[end[keep]]), r.id.take(a), r.id.take(b), r.kind.take(a), r.kind.take(b), pa.array(n[keep]), pa.array(first[keep]), pa.array(last[keep])],
            names=["k", "t0", "t1", "first_id", "last_id", "first_kind", "last_kind", "n", "first", "last"],
        ).to_batches()

    return _by_groups(finish, ["k", "chunk"])


# --- runs that hold unlike events: pieces that can be divided on their own --------------------------------------------------------------------------------


def anchor_length(penalty: float, mismatch: float) -> int:
    """Of how many near neighbours of one kind on it is sure that one run holds them all and that their kind is its most frequent: otherwise a run of their own, at the cost of two boundaries at most, would be cheaper."""
    penalty, mismatch = whole_costs(penalty, mismatch)
    return int(2 * penalty // mismatch) + 1


def sure_cuts(code: np.ndarray, near: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Places at which sequences can be cut without changing their best divisions, in order, and whether a run goes on across each.

    An event that isn't ``near`` the one before is such a place, and no run goes on
    there. In the middle of a stretch of twice the anchor's length one run surely
    does, and each half alone still tells either side which kind that run is of.
    """
    gap = np.flatnonzero(~near)
    start = np.flatnonzero(~near | np.r_[True, code[1:] != code[:-1]])
    length = np.diff(np.r_[start, len(code)])
    long = length >= 2 * anchor
    middle = start[long] + length[long] // 2
    at = np.r_[gap, middle]
    goes_on = np.r_[np.zeros(len(gap), dtype=bool), np.ones(len(middle), dtype=bool)]
    order = np.argsort(at, kind="stable")
    return at[order], goes_on[order]


def divide(code: np.ndarray, begin: np.ndarray, end: np.ndarray, joined: np.ndarray, penalty: float, mismatch: float) -> np.ndarray:
    """Starts of the runs of pieces from ``begin`` to ``end``, whose events are near each other; a ``joined`` piece begins within a run. Only pieces with several kinds need the dynamic programming."""
    change = np.r_[0, np.cumsum(code[1:] != code[:-1])] if len(code) else np.zeros(0, dtype=np.int64)
    mixed = change[end - 1] > change[begin]
    out = [begin[~joined & ~mixed]]
    for i in np.flatnonzero(mixed).tolist():
        lo, hi = int(begin[i]), int(end[i])
        got = np.array(segment(code[lo:hi].tolist(), [False] + [True] * (hi - lo - 1), penalty, mismatch), dtype=np.int64) + lo
        out.append(got[1:] if joined[i] else got)
    return np.sort(np.concatenate(out))


_PIECE = "k binary, chunk bigint, t bigint, id binary, kind string, t1 bigint, last_id binary, n bigint, goes_on boolean, open_end boolean, cut boolean"


def _piece_table(r: Rows, chunk: np.ndarray, at: np.ndarray, end: np.ndarray | None, goes_on: np.ndarray, open_end: np.ndarray, cut: pa.Array | None) -> pa.Table:
    """Runs from ``at`` to ``end``, or, without ``end``, the rows ``at`` themselves."""
    m, a = len(at), pa.array(at)
    run = [pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())] if end is None else [pa.array(r.us[end]), r.id.take(pa.array(end)), pa.array(end - at + 1)]
    cols = [r.k.take(a), pa.array(chunk), pa.array(r.us[at]), r.id.take(a), r.kind.take(a), *run, pa.array(goes_on), pa.array(open_end), pa.nulls(m, pa.bool_()) if cut is None else cut]
    return pa.table(cols, names=[c.split()[0] for c in _PIECE.split(", ")])


def _pieces(max_gap_us: int, penalty: float, mismatch: float):
    """Of each chunk, what lies between its first and last sure cut as runs; rows before the first (``cut`` is false) and after the last (true), or all where there is none (null), as they are.

    ``goes_on``: the run goes on with the one before, or the rows begin within a run;
    ``open_end``: the run goes on with the one after, or the rows end within a run.
    """

    def finish(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        r = _rows_of(tables, ["k", "chunk"])
        begins = r.begins()
        starts, owner = np.flatnonzero(begins), np.cumsum(begins) - 1
        at, goes_on = sure_cuts(r.code, r.near(max_gap_us), anchor_length(penalty, mismatch))
        inner = ~begins[at]
        at, goes_on = at[inner], goes_on[inner]
        of, every = owner[at], np.arange(len(starts))
        lo, hi = np.searchsorted(of, every), np.searchsorted(of, every, side="right") - 1  # first and last cut of each chunk
        cut = hi >= lo
        at_lo, at_hi = np.where(cut, np.r_[at, 0][np.where(cut, lo, 0)], len(r.us)), np.where(cut, np.r_[at, 0][np.where(cut, hi, 0)], len(r.us))
        on_lo, on_hi = cut & np.r_[goes_on, False][np.where(cut, lo, 0)], cut & np.r_[goes_on, False][np.where(cut, hi, 0)]
        chunk = r.us[starts]
        row = np.arange(len(r.us))
        tail = cut[owner] & (row >= at_hi[owner])
        rows = np.flatnonzero(tail | (row < at_lo[owner]))
        c = owner[rows]
        flag = pa.array(tail[rows], mask=~cut[c])
        yield from _piece_table(r, chunk[c], rows, None, on_hi[c] & tail[rows], on_lo[c] & ~tail[rows], flag).to_batches()
        piece = np.flatnonzero(np.r_[of[1:] == of[:-1], False]) if len(of) else np.zeros(0, dtype=np.int64)
        if len(piece):
            first = np.r_[True, of[1:] != of[:-1]][piece]
            run = divide(r.code, at[piece], at[piece + 1], goes_on[piece] & ~first, penalty, mismatch)
            c = owner[run]
            last = np.r_[c[1:] != c[:-1], True]
            end = np.where(last, at_hi[c], np.r_[run[1:], 0]) - 1
            yield from _piece_table(r, chunk[c], run, end, (run == at_lo[c]) & on_lo[c], last & on_hi[c], None).to_batches()

    return _by_groups(finish, ["k", "chunk"])


def _slice(r: Rows, lo: int, hi: int) -> Rows:
    cut = lambda a: a.slice(lo, hi - lo)
    return Rows(cut(r.k), cut(r.id), cut(r.kind), r.part[lo:hi], r.us[lo:hi], r.code[lo:hi])


def _open_pieces(max_gap_us: int, penalty: float, mismatch: float, patience: int = 100_000):
    """Open pieces, whose rows come in the order of time, as runs. Pieces of up to ``patience`` rows are divided together; of a longer one only the unsettled rows are held."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rows, list[tuple], np.ndarray, np.ndarray, np.ndarray]]:
        def finish(tables: list[pa.Table]) -> Iterator:
            t = pa.concat_tables(tables).combine_chunks()
            r = _rows_of([t.select(["k", "seg", "t", "id", "kind"])], ["k", "seg"])
            first = np.flatnonzero(r.begins())
            names = list(zip(r.k.take(pa.array(first)).to_pylist(), t.column("seg").take(pa.array(first)).to_pylist()))
            some = lambda c: np.logical_or.reduceat(np.asarray(t.column(c)), first)
            yield r, names, first, some("goes_on"), some("open_end")

        yield from _by_groups(finish, ["k", "seg"], patience)(batches)

    def whole(r: Rows, first: np.ndarray, on: np.ndarray, open_: np.ndarray) -> pa.Table:
        """Pieces that are all here."""
        near = r.near(max_gap_us)
        at, goes_on = sure_cuts(r.code, near, anchor_length(penalty, mismatch))
        run = divide(r.code, at, np.r_[at[1:], len(r.us)], goes_on, penalty, mismatch)
        owner = np.searchsorted(first, run, side="right") - 1
        last = np.r_[owner[1:] != owner[:-1], True]
        return _piece_table(r, np.zeros(len(run), dtype=np.int64), run, np.r_[run[1:], len(r.us)] - 1, (run == first[owner]) & on[owner], last & open_[owner], None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Frontier | None = None
        held: Rows | None = None
        first_on, last_open = False, False

        def give(begin: list[int], end: int, base: int, on: bool, open_: bool) -> pa.Table:
            at = np.array(begin, dtype=np.int64) - base
            flag = lambda x, k: np.r_[np.zeros(len(at) - 1, dtype=bool), x][::k]
            return _piece_table(held, np.zeros(len(at), dtype=np.int64), at, np.r_[at[1:], end - base] - 1, flag(on, -1), flag(open_, 1), None)

        def add(mine: Rows) -> None:
            nonlocal held
            before = held.us[-1] if held is not None and len(held.us) else None
            close = np.r_[before is not None and mine.us[0] - before <= max_gap_us, mine.us[1:] - mine.us[:-1] <= max_gap_us]
            held = mine if held is None else Rows(*(pa.concat_arrays([x, y]) for x, y in ((held.k, mine.k), (held.id, mine.id), (held.kind, mine.kind))), np.r_[held.part, mine.part], np.r_[held.us, mine.us], np.r_[held.code, mine.code])
            f.push(mine.kind.to_pylist(), close.tolist())

        ahead = parts(batches)
        coming = next(ahead, None)
        while coming is not None:
            (r, names, first, on, open_), coming = coming, next(ahead, None)
            edges = np.r_[first, len(r.us)].tolist()
            lo, hi = 0, len(names)
            if f is not None:  # the first piece goes on with the one that is held
                add(_slice(r, edges[0], edges[1]))
                last_open, lo = last_open or bool(open_[0]), 1
            more = coming is not None and coming[1][0] == names[-1]
            if f is not None and not (more and hi == 1):
                yield from give(f.finish(), f.size, f.base, first_on, last_open).to_batches()
                f = held = None
            if more and f is None:
                hi -= 1
            if hi > lo:
                yield from whole(_slice(r, edges[lo], edges[hi]), first[lo:hi] - edges[lo], on[lo:hi], open_[lo:hi]).to_batches()
            if more and f is None:
                f, first_on, last_open = Frontier(penalty, mismatch), bool(on[-1]), bool(open_[-1])
                add(_slice(r, edges[-2], edges[-1]))
            if f is not None:
                base, done = f.base, f.settled()
                if done:
                    yield from give(done[:-1], done[-1], base, first_on, False).to_batches()
                    first_on, held = False, _slice(held, done[-1] - base, len(held.us))

    return work


def _tolerant(parts: DataFrame, max_gap_us: int, penalty: float, mismatch: float) -> DataFrame:
    """Runs of ordered chunks with any finite ``mismatch``: ``k``, ``t0``, ``t1``, ``first_id``, ``last_id``, ``kind``, ``n``."""
    pieces = materialize(parts.mapInArrow(_pieces(max_gap_us, penalty, mismatch), _PIECE), "pieces")
    # which open rows of neighbouring chunks are one piece: only one row per chunk is ordered here
    w = Window.partitionBy("k").orderBy("chunk")
    chunks = pieces.groupBy("k", "chunk").agg(F.max(F.coalesce("t1", "t")).alias("last"), F.max(F.col("cut").isNotNull()).alias("has_cut"))
    chunks = chunks.withColumn("apart", F.coalesce(F.col("chunk") - F.lag("last").over(w) > max_gap_us, F.lit(True)))
    mark = F.when(F.col("has_cut"), F.col("chunk") * 2 + 1).when(F.col("apart"), F.col("chunk") * 2)
    chunks = chunks.withColumn("mark", mark).withColumn("head", F.when(F.col("apart"), F.col("chunk") * 2).otherwise(F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))).select("k", "chunk", "head")
    rows = pieces.where("n is null").join(chunks, ["k", "chunk"]).withColumn("seg", F.when(F.col("cut"), F.col("chunk") * 2 + 1).otherwise(F.col("head")))
    rows = rows.select("k", "seg", "t", "id", "kind", "goes_on", "open_end").repartition("k", "seg").sortWithinPartitions("k", "seg", "t")
    runs = pieces.where("n is not null").unionByName(rows.mapInArrow(_open_pieces(max_gap_us, penalty, mismatch), _PIECE))
    runs = runs.select("k", F.col("t").alias("t0"), "t1", F.col("id").alias("first_id"), "last_id", "kind", "n", "goes_on", "open_end")
    alone = runs.where("not goes_on and not open_end").drop("goes_on", "open_end")
    order = Window.partitionBy("k").orderBy("t0", unpack_hex("first_id"))
    joined = runs.where("goes_on or open_end").withColumn("nr", F.sum((~F.col("goes_on")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first, last = F.min(F.struct("t0", unpack_hex("first_id").alias("x"), "first_id", "kind")), F.max(F.struct("t1", unpack_hex("last_id").alias("x"), "last_id"))
    joined = joined.groupBy("k", "nr").agg(first.alias("a"), last.alias("b"), F.sum("n").alias("n"))
    return alone.unionByName(joined.select("k", "a.t0", "b.t1", "a.first_id", "b.last_id", "a.kind", "n"))


def collapse_runs(events: DataFrame, key: Column, kind: Column, ts: str = "ts", event_id: str = "event_id", max_gap_us: int = 300_000_000, penalty: float = 1.0, mismatch: float = inf, least: int = 1, chunk_us: int = 3_600_000_000, key_name: str = "key") -> DataFrame:
    """One row per run of at least ``least`` events: ``key_name``, ``first_event_id``, ``last_event_id``, ``kind``, ``start_us``, ``end_us``, ``n_events``, ``duration_us``.

    Events are ordered by time and id; rows that repeat an id at its time count
    once. Events without key, kind, time or id are not part of any sequence. A
    run may hold single other events, where that costs less than boundaries; ``kind``
    is then that of its first event. Where ``mismatch`` is more than two boundaries,
    parting an event from a run unlike it is always cheaper: the best division has
    the longest stretches of one kind whose neighbours are at most ``max_gap_us``
    apart, and it is the only best one. An empty table gives an empty result.

    An entity's time is divided into chunks of ``chunk_us``, so that one with a
    third of all events is spread over its chunks; their length does not change the
    result. With a ``mismatch`` of more than two boundaries any place is one where no
    best division can differ: chunks are divided on their own, and their first and
    last runs joined to their neighbours. Otherwise a chunk is divided between such
    places (gaps, and long stretches of one kind); what is before the first and after
    the last of them is divided together with the neighbouring chunks.
    """
    if not (penalty > 0 and mismatch > 0):
        raise ValueError("penalty and mismatch must be positive")
    rows = events.select(pack_hex(key).alias("k"), micros(events, ts).alias("t"), pack_hex(F.col(f"`{event_id}`").cast("string")).alias("id"), kind.cast("string").alias("kind")).where("k is not null and t is not null and id is not null and kind is not null")
    rows = rows.withColumn("chunk", F.expr(f"(t - pmod(t, {chunk_us}L)) div {chunk_us}L")).select("k", "chunk", "t", "id", "kind")
    parts = rows.repartition("k", "chunk").sortWithinPartitions("k", "chunk", "t")
    shown = [unpack_hex("k").alias(key_name), unpack_hex("first_id").alias("first_event_id"), unpack_hex("last_id").alias("last_event_id"), "kind", F.col("t0").alias("start_us"), F.col("t1").alias("end_us"), F.col("n").alias("n_events"), (F.col("t1") - F.col("t0")).alias("duration_us")]
    if anchor_length(penalty, mismatch) > 1:
        return _tolerant(parts, max_gap_us, penalty, mismatch).where(F.col("n") >= least).select(*shown)
    runs = parts.mapInArrow(_whole_chunks(max_gap_us, penalty, mismatch, least), _RUN)
    w = Window.partitionBy("k").orderBy("t0", F.col("last").cast("int"), "t1")
    prev = lambda c: F.lag(c).over(w)
    inner = runs.where("not first and not last").select("k", "first_id", "last_id", F.col("first_kind").alias("kind"), "t0", "t1", "n")
    edges = runs.where("first or last").withColumn("new", F.when(F.col("first") & prev("last") & (prev("last_kind") == F.col("first_kind")) & (F.col("t0") - prev("t1") <= max_gap_us), 0).otherwise(1))
    edges = edges.withColumn("nr", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("k", "nr").agg(
        F.min(F.struct("t0", F.col("last").cast("int").alias("l"), F.col("first_id").alias("id"), "first_kind")).alias("a"), F.max(F.struct("t1", F.col("last").cast("int").alias("l"), F.col("last_id").alias("id"))).alias("b"), F.sum("n").alias("n"),
    )
    outer = edges.where(F.col("n") >= least).select("k", F.col("a.id").alias("first_id"), F.col("b.id").alias("last_id"), F.col("a.first_kind").alias("kind"), F.col("a.t0").alias("t0"), F.col("b.t1").alias("t1"), "n")
    return inner.unionByName(outer).select(*shown)


def digits_alike(c: Column) -> Column:
    """Names that differ in groups of digits only, as one."""
    return F.regexp_replace(c, "[0-9]+", "0")


#: What an event unlike its run costs in boundaries, where runs shall hold one kind only: more than the two that part it from the run.
UNLIKE = 3.0


def p7_runs(spark, sf_dir: str) -> DataFrame:
    """Every source's sequence of names with runs replaced by one entry."""
    ev = load(spark, sf_dir, "dns_events")
    return collapse_runs(ev, F.lower("source_hash"), digits_alike(domain_key("domain")), mismatch=UNLIKE, key_name="source_hash")


def p7_tolerant(spark, sf_dir: str) -> DataFrame:
    """The same where a run may hold single events unlike it: each costs 0.4 of a boundary."""
    ev = load(spark, sf_dir, "dns_events")
    return collapse_runs(ev, F.lower("source_hash"), digits_alike(domain_key("domain")), mismatch=0.4, key_name="source_hash")


def p7_found(spark, sf_dir: str) -> DataFrame:
    ev = load(spark, sf_dir, "dns_events")
    return collapse_runs(ev, F.lower("source_hash"), digits_alike(domain_key("domain")), mismatch=UNLIKE, least=3, key_name="source_hash").select("source_hash", "first_event_id", "last_event_id", "n_events", "duration_us")


_RUNS_SQL = r"""
with ev as (select distinct lower(source_hash) as source_hash, event_id, epoch_us(ts) as t,
  regexp_replace(nullif(regexp_replace(lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')), '\.$', ''), ''), '[0-9]+', '0', 'g') as kind from dns_events),
seq as (select *, lag(t) over w as pt, lag(kind) over w as pk from ev where kind is not null and source_hash is not null and t is not null window w as (partition by source_hash order by t, event_id)),
nrs as (select *, sum(case when kind = pk and t - pt <= 300000000 then 0 else 1 end) over (partition by source_hash order by t, event_id rows unbounded preceding) as nr from seq)
select source_hash, arg_min(event_id, (t, event_id)) as first_event_id, arg_max(event_id, (t, event_id)) as last_event_id, {columns}
from nrs group by source_hash, nr {having}
"""

QUERIES = {"p7_found": p7_found, "p7_runs": p7_runs, "p7_tolerant": p7_tolerant}
SQL = {
    "p7_found": _RUNS_SQL.format(columns="count(*) as n_events, max(t) - min(t) as duration_us", having="having count(*) >= 3"),
    "p7_runs": _RUNS_SQL.format(columns="any_value(kind) as kind, min(t) as start_us, max(t) as end_us, count(*) as n_events, max(t) - min(t) as duration_us", having=""),
}
