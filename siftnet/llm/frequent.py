"""The most frequent values of a column, in memory that doesn't grow with it.

Every value is hashed to 64 bits, written as 16 symbols of 4 bits and protected
by 8 more (two Reed-Solomon words over GF(16), each of which survives two wrong
symbols). Several times over, values are hashed to groups by other bits of the
hash, and a group counts, for each position, how often each symbol occurs there.
In a group with one frequent value its symbols stand out, and the word that they
make is decoded. Decoded values are taken out of the counts, which bares others
that shared their groups. All candidates are then counted exactly, in a second
pass; for shares so small that no task can hold the symbol counts of all groups,
heavy groups are found first and only their values' symbols counted, group by
group. A frequent value's groups hold at least its own count; where groups that
heavy remain once the candidates' exact counts are taken out, all values in
them are counted as well, so that none can be missed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.session import materialize
from siftnet.tables import domain_key, load, pack_hex

POSITIONS, SYMBOLS, DATA, PARITY = 24, 16, 8, 4
BLOCK = 128  # groups in one shuffled piece of the counts

_EXP = [1]
for _i in range(1, 30):
    _v = _EXP[-1] << 1
    _EXP.append(_v ^ 0b10011 if _v & 16 else _v)
_EXP = _EXP[:15] * 2
_LOG = {v: i for i, v in enumerate(_EXP[:15])}


def _mul(a: int, b: int) -> int:
    return _EXP[_LOG[a] + _LOG[b]] if a and b else 0


def _div(a: int, b: int) -> int:
    return _EXP[(_LOG[a] - _LOG[b]) % 15] if a else 0


def _generator() -> list[int]:
    g = [1]
    for r in range(PARITY):
        g = [(g[i] if i < len(g) else 0) ^ (_mul(g[i - 1], _EXP[r]) if i else 0) for i in range(len(g) + 1)]
    return g


_G = _generator()


def rs_parity(data: list[int]) -> list[int]:
    """The check symbols of a word, as the remainder of its polynomial."""
    rest = list(data) + [0] * PARITY
    for i in range(len(data)):
        if rest[i]:
            c = rest[i]
            for j, g in enumerate(_G):
                rest[i + j] ^= _mul(c, g)
    return rest[-PARITY:]


# the code is linear: the parity of a word is the sum of its symbols' parities
_PARITY_OF = np.zeros((DATA, SYMBOLS), dtype=np.uint16)
for _p in range(DATA):
    for _s in range(SYMBOLS):
        _word = [0] * DATA
        _word[_p] = _s
        _PARITY_OF[_p, _s] = sum(x << (4 * i) for i, x in enumerate(rs_parity(_word)))


def symbols_of(h: np.ndarray) -> np.ndarray:
    """The 24 symbols of each hash: 8 of data and 4 of parity, twice."""
    h = h.astype(np.uint64)
    out = np.empty((len(h), POSITIONS), dtype=np.uint8)
    for w in range(2):
        parity = np.zeros(len(h), dtype=np.uint16)
        for i in range(DATA):
            s = ((h >> np.uint64(4 * (w * DATA + i))) & np.uint64(15)).astype(np.uint8)
            out[:, w * 12 + i] = s
            parity ^= _PARITY_OF[i, s]
        for i in range(PARITY):
            out[:, w * 12 + DATA + i] = (parity >> np.uint16(4 * i)) & np.uint16(15)
    return out


def _correct(word: list[int]) -> list[int] | None:
    """A word of 12 symbols with up to two wrong ones put right; ``None`` where that can't be."""
    n = len(word)
    at = lambda i: n - 1 - i  # exponent of a position

    def syndromes(w: list[int]) -> list[int]:
        out = []
        for r in range(PARITY):
            s = 0
            for i, x in enumerate(w):
                if x:
                    s ^= _EXP[(_LOG[x] + r * at(i)) % 15]
            out.append(s)
        return out

    s = syndromes(word)
    if not any(s):
        return word
    fixed = list(word)
    det = _mul(s[0], s[2]) ^ _mul(s[1], s[1])
    if det == 0:  # one wrong symbol
        if not s[0] or not s[1]:
            return None
        x = _LOG[_div(s[1], s[0])]
        i = n - 1 - x
        if not 0 <= i < n:
            return None
        fixed[i] ^= s[0]
    else:  # two: the locator's roots are tried at every position
        l1 = _div(_mul(s[0], s[3]) ^ _mul(s[1], s[2]), det)
        l2 = _div(_mul(s[1], s[3]) ^ _mul(s[2], s[2]), det)
        roots = [i for i in range(n) if (1 ^ _mul(l1, _EXP[-at(i) % 15]) ^ _mul(l2, _EXP[-2 * at(i) % 15])) == 0]
        if len(roots) != 2:
            return None
        x1, x2 = (_EXP[at(i) % 15] for i in roots)
        e2 = _div(s[1] ^ _mul(s[0], x1), x1 ^ x2)
        fixed[roots[0]] ^= s[0] ^ e2
        fixed[roots[1]] ^= e2
    return fixed if not any(syndromes(fixed)) else None


def decode_symbols(symbols: list[int]) -> int | None:
    """The hash that 24 symbols stand for."""
    h = 0
    for w in range(2):
        part = _correct([int(x) for x in symbols[w * 12 : w * 12 + 12]])
        if part is None:
            return None
        for i in range(DATA):
            h |= part[i] << (4 * (w * DATA + i))
    return h


def group_of(h: int | np.ndarray, rep: int, bits: int):
    """The group of a hash in a repetition: its own bits of the hash."""
    if isinstance(h, np.ndarray):
        return ((h.astype(np.uint64) >> np.uint64(rep * bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (h >> (rep * bits)) & ((1 << bits) - 1)


def count_symbols(h: np.ndarray, reps: int, bits: int, into: np.ndarray) -> None:
    values, n = np.unique(h, return_counts=True)
    s = symbols_of(values)
    flat = into.reshape(reps, -1)
    column = np.arange(POSITIONS) * SYMBOLS
    for r in range(reps):
        cells = (group_of(values, r, bits)[:, None] * (POSITIONS * SYMBOLS) + column + s).ravel()
        flat[r] += np.bincount(cells, weights=np.repeat(n, POSITIONS), minlength=flat.shape[1]).astype(np.int64)


_PIECE = "piece int, counts binary"


def _sketch(reps: int, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((reps, 1 << bits, POSITIONS, SYMBOLS), dtype=np.int64)
        held: list[np.ndarray] = []
        seen = 0
        for b in batches:
            held.append(np.asarray(b.column(0)))
            seen += len(held[-1])
            if seen >= 1 << 18:
                count_symbols(np.concatenate(held), reps, bits, counts)
                held, seen = [], 0
        if seen:
            count_symbols(np.concatenate(held), reps, bits, counts)
        if counts.any():
            yield from _pieces(dict(enumerate(counts.reshape(-1, BLOCK, POSITIONS, SYMBOLS))))

    return work


def _pieces(pieces: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for k, c in pieces.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(c.astype("<i8").tobytes(), 1)], pa.binary())], names=["piece", "counts"])


def _add_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x = np.frombuffer(zlib.decompress(c), dtype="<i8").reshape(BLOCK, POSITIONS, SYMBOLS)
            total[k] = total[k] + x if k in total else x
    yield from _pieces(total)


def decode_counts(counts: np.ndarray, bits: int, threshold: int) -> dict[int, int]:
    """Candidates with estimated counts, from the symbol counts of all repetitions; decoded values are taken out until no group yields another."""
    rest, found = counts.copy(), {}
    reps = counts.shape[0]
    while True:
        new: dict[int, int] = {}
        for r in range(reps):
            for g in np.flatnonzero(rest[r, :, 0].sum(axis=1) >= threshold):
                h = decode_symbols(rest[r, g].argmax(axis=1).tolist())
                if h is not None and h not in found and group_of(h, r, bits) == g:
                    s = symbols_of(np.array([h], dtype=np.uint64))[0]
                    n = min(int(rest[q, group_of(h, q, bits), np.arange(POSITIONS), s].min()) for q in range(reps))
                    if n > 0:
                        new[h] = n
        if not new:
            return found
        for h, n in new.items():
            take_out(rest, h, n, bits)
        found |= new


def take_out(counts: np.ndarray, h: int, n: int, bits: int) -> None:
    s = symbols_of(np.array([h], dtype=np.uint64))[0]
    for r in range(counts.shape[0]):
        counts[r, group_of(h, r, bits), np.arange(POSITIONS), s] -= n


#: Up to so many bits of group number every task and the driver hold the symbol counts of all groups (25 MB for two repetitions).
DENSE_BITS = 12
#: Group numbers have no more bits; for smaller shares the sieve lets more values through, which costs time and no memory.
SIEVE_BITS = 24
PIECE_BITS = 16


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group numbers as bitmaps of 65 536 groups each."""
    held: dict[int, np.ndarray] = {}
    for b in batches:
        g = np.asarray(b.column(0))
        for piece in np.unique(g >> PIECE_BITS).tolist():
            bits = held.setdefault(piece, np.zeros(1 << PIECE_BITS, dtype=bool))
            bits[g[g >> PIECE_BITS == piece] & ((1 << PIECE_BITS) - 1)] = True
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())], names=["piece", "counts"])


def _heavy_groups(hashed: DataFrame, rep: int, bits: int, threshold: int) -> bytes:
    """A bitmap of the groups of a repetition with ``threshold`` rows at least, 2 MB for 24 bits."""
    g = F.shiftrightunsigned("h", rep * bits).bitwiseAND((1 << bits) - 1)
    heavy = hashed.groupBy(g.alias("g")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select("g")
    whole = np.zeros(1 << (max(bits, PIECE_BITS) - 3), dtype=np.uint8)
    size = 1 << (PIECE_BITS - 3)
    for row in heavy.mapInArrow(_bitmaps, _PIECE).toLocalIterator():
        x = np.frombuffer(bytes(row.counts), dtype=np.uint8)
        whole[row.piece * size : (row.piece + 1) * size] |= x
    return zlib.compress(whole.tobytes(), 1)


def _survivors(packed: list[bytes], bits: int):
    """Hashes whose groups are heavy in all repetitions, with how often they come, summed where they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = [np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in packed]
        for b in batches:
            h, n = np.unique(np.asarray(b.column(0)).view(np.uint64), return_counts=True)
            for r, m in enumerate(maps):
                g = group_of(h, r, bits)
                keep = (m[g >> 3] >> (g & 7).astype(np.uint8)) & 1 > 0
                h, n = h[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(group_of(h, 0, bits)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["g", "h", "n"])

    return work


def decode_group(h: np.ndarray, n: np.ndarray, threshold: int) -> list[int]:
    """The values of a group that come ``threshold`` times at least, by its symbol counts; where those cannot be decoded, by the counts themselves."""
    s = symbols_of(h)
    counts = np.zeros((POSITIONS, SYMBOLS), dtype=np.int64)
    np.add.at(counts, (np.arange(POSITIONS), s), n[:, None])
    left, found = dict(zip(h.tolist(), n.tolist())), []
    while counts[0].sum() >= threshold:
        x = decode_symbols(counts.argmax(axis=1).tolist())
        if x is None or x not in left:
            return found + [k for k, c in left.items() if c >= threshold]
        c = left.pop(x)
        if c >= threshold:
            found.append(x)
        counts[np.arange(POSITIONS), symbols_of(np.array([x], dtype=np.uint64))[0]] -= c
    return found


def _decode_groups(threshold: int):
    """``decode_group`` of groups whose rows come together; the last group of a batch waits for the next one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3

        def decode(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
            out = []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(g)]):
                out += decode_group(h[lo:hi].view(np.uint64), n[lo:hi], threshold)
            return pa.RecordBatch.from_arrays([pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["h"])

        for b in batches:
            rest = [np.r_[a, np.asarray(c)] for a, c in zip(rest, b.columns)]
            g = rest[0]
            at = int(np.searchsorted(g, g[-1])) if len(g) else 0
            yield decode(*(x[:at] for x in rest))
            rest = [x[at:] for x in rest]
        yield decode(*rest)

    return work


def _sieved(hashed: DataFrame, reps: int, bits: int, threshold: int) -> DataFrame:
    """The hashes that come ``threshold`` times at least, for shares so small that no task can hold counts of all groups: heavy groups first, then the symbols of the values in them, a few groups at a time."""
    maps = [_heavy_groups(hashed, r, bits, threshold) for r in range(reps)]
    some = hashed.select("h").mapInArrow(_survivors(maps, bits), "g bigint, h bigint, n bigint").groupBy("g", "h").agg(F.sum("n").alias("n"))
    return some.repartition("g").sortWithinPartitions("g").mapInArrow(_decode_groups(threshold), "h bigint")


def _counted(keyed: DataFrame, row_id: str | None) -> DataFrame:
    """Rows and rows without repetitions of each picked value ``c`` (null: all others)."""
    if not row_id:
        return keyed.groupBy("c").agg(F.count("*").alias("raw"), F.count("*").alias("n"))
    # ids without a value of their own are one each
    once = keyed.groupBy("id").agg(F.min("c").alias("c"), F.count("*").alias("raw")).withColumn("n", F.expr("if(id is null, raw, 1)"))
    nulls = keyed.where("id is null").groupBy("c").agg(F.count("*").alias("raw"), F.count("*").alias("n"))
    return once.where("id is not null").groupBy("c").agg(F.sum("raw").alias("raw"), F.sum("n").alias("n")).unionByName(nulls).groupBy("c").agg(F.sum("raw").alias("raw"), F.sum("n").alias("n"))


def frequent_values(df: DataFrame, value: Column, share: float | str, row_id: str | None = None, reps: int = 2, slack: float = 0.5, name: str = "value", dense_bits: int = DENSE_BITS) -> DataFrame:
    """``name``, ``n_rows`` and ``n_total`` of every value that makes up at least ``share`` of the rows with a value.

    Nulls are no values. Rows that repeat a ``row_id`` count once (rows with a null
    id each by themselves); without ``row_id`` every row counts. The counts are
    exact and the result complete; an empty table gives an empty result, and ties
    with the share are in it. Groups are 4 / (``share`` x ``slack``), rounded up to
    a power of two. Up to 2 ** ``dense_bits`` of them every task and the driver hold
    ``reps`` x groups x 384 counters; beyond, tasks hold a bitmap of the groups (4 MB)
    and the counters of one group, so that memory is bounded for any share. The first
    pass counts repeated rows as often as they come and therefore looks for ``slack``
    times the share; should more than 1 - ``slack`` of the rows be repetitions, it
    looks again for less.
    """
    want = Fraction(str(share))
    if not 0 < want <= 1:
        raise ValueError("share must be in (0, 1]")
    bits = max(7, min(64 // reps, ceil(log2(4 / (float(want) * slack)))))
    values = df.select(value.cast("string").alias("v"), *([pack_hex(F.col(f"`{row_id}`").cast("string")).alias("id")] if row_id else [])).where("v is not null")
    hashed = values.withColumn("h", F.xxhash64("v"))
    exact, n_total = _dense(hashed, want, slack, reps, bits, row_id) if bits <= dense_bits else _sparse(hashed, want, slack, reps, min(bits, SIEVE_BITS, 64 // reps), row_id)
    least = F.lit(want.numerator).cast("decimal(20,0)") * F.lit(n_total).cast("decimal(18,0)")
    return exact.where(F.col("c").isNotNull() & (F.col("n").cast("decimal(18,0)") * F.lit(want.denominator).cast("decimal(20,0)") >= least)).select(F.col("c").alias(name), F.col("n").alias("n_rows"), F.lit(n_total).cast("bigint").alias("n_total"))


def _sparse(hashed: DataFrame, want: Fraction, slack: float, reps: int, bits: int, row_id: str | None) -> tuple[DataFrame, int]:
    """Exact counts of candidates, of which there may be too many for a list in the driver: they are joined."""
    threshold = max(1, int(hashed.count() * float(want) * slack))
    while True:
        picked = materialize(_sieved(hashed, reps, bits, threshold).distinct().withColumn("__picked", F.lit(True)), "candidates")
        exact = materialize(_counted(hashed.join(picked, "h", "left").withColumn("c", F.when(F.col("__picked"), F.col("v"))), row_id), "frequent")
        n_total = exact.agg(F.sum("n")).first()[0] or 0
        if int(want * n_total) >= threshold or threshold == 1:
            return exact, n_total
        threshold = max(1, int(want * n_total * Fraction(9, 10)))


def _dense(hashed: DataFrame, want: Fraction, slack: float, reps: int, bits: int, row_id: str | None) -> tuple[DataFrame, int]:
    """Exact counts of the candidates that the symbol counts of all groups give."""
    pieces = hashed.select("h").mapInArrow(_sketch(reps, bits), _PIECE).repartition(min(32, (reps << bits) // BLOCK), "piece").mapInArrow(_add_pieces, _PIECE)
    counts = np.zeros(((reps << bits) // BLOCK, BLOCK, POSITIONS, SYMBOLS), dtype=np.int64)
    for row in pieces.collect():  # a fixed number of pieces, whatever the rows
        counts[row.piece] += np.frombuffer(zlib.decompress(bytes(row.counts)), dtype="<i8").reshape(BLOCK, POSITIONS, SYMBOLS)
    counts = counts.reshape(reps, 1 << bits, POSITIONS, SYMBOLS)
    n_raw = int(counts[0, :, 0].sum())
    threshold = max(1, int(n_raw * float(want) * slack))
    open_groups: list[list[int]] | None = None
    while True:
        found = decode_counts(counts, bits, threshold)
        signed = [h - (1 << 64) if h >> 63 else h for h in found]
        picked = F.col("h").isin(signed) if signed else F.lit(False)
        if open_groups and all(open_groups):
            inside = F.lit(True)
            for r, groups in enumerate(open_groups):
                inside &= F.shiftrightunsigned("h", r * bits).bitwiseAND((1 << bits) - 1).isin(groups)
            picked |= inside
        exact = materialize(_counted(hashed.withColumn("c", F.when(picked, F.col("v"))), row_id), "frequent")
        n_total = exact.agg(F.sum("n")).first()[0] or 0
        if int(want * n_total) < threshold and threshold > 1:
            threshold = max(1, int(want * n_total * Fraction(9, 10)))
            continue
        if open_groups is not None:
            return exact, n_total
        rest = counts.copy()
        for row in exact.where("c is not null").select(F.xxhash64("c").alias("h"), "raw").where(F.col("h").isin(signed) if signed else F.lit(False)).toLocalIterator():  # at most one row per decoded value
            take_out(rest, row.h & ((1 << 64) - 1), row.raw, bits)
        open_groups = [np.flatnonzero(rest[r, :, 0].sum(axis=1) >= threshold).tolist() for r in range(reps)]
        if not all(open_groups):
            return exact, n_total


def p4_frequent(spark, sf_dir: str) -> DataFrame:
    """Names that make up at least 0.4 % of the events with a name, with their counts."""
    return frequent_values(load(spark, sf_dir, "dns_events"), domain_key("domain"), "0.004", "event_id", name="domain")


def p4_found(spark, sf_dir: str) -> DataFrame:
    return p4_frequent(spark, sf_dir).select("domain")


_FREQUENT_SQL = r"""
with ev as (select event_id, any_value(nullif(regexp_replace(lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')), '\.$', ''), '')) as domain from dns_events group by event_id),
n as (select count(*) as n_total from ev where domain is not null)
select {columns} from ev, n where domain is not null group by domain, n_total having count(*) * 1000 >= 4 * n_total
"""

QUERIES = {"p4_found": p4_found, "p4_frequent": p4_frequent}
SQL = {"p4_found": _FREQUENT_SQL.format(columns="domain"), "p4_frequent": _FREQUENT_SQL.format(columns="domain, count(*) as n_rows, n_total")}
