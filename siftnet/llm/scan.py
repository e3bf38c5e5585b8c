"""Many texts as one array of code points, and where in them patterns can begin.

A regular expression that is tried at every character costs far more than its
few matches. Here whole columns of characters tell where a match can begin at
all (a number after a blank and a street word, two capitalised words, a sign
that stands for @); the expressions are then tried at these places only and
decide alone, so that what is found is the same as if they were tried everywhere.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

LETTER, WORD, DIGIT, CAPITAL, UPPER = 1, 2, 4, 8, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane its classes and its lower case (a single code point)."""
    flags, low = np.zeros(1 << 16, dtype=np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        flags[c] = _class(chr(c))
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    low[0x130], low[0x3C2] = ord("i"), 0x3C3  # dotted capital i and final sigma
    return flags, low


def _class(ch: str) -> int:
    alnum, digit = ch.isalnum(), ch.isdecimal()
    capital = "A" <= ch <= "Z" or "À" <= ch <= "Ö" or "Ø" <= ch <= "Þ" or ch in "ŒŠŽ"
    return (LETTER if alnum and not digit else 0) | (WORD if alnum or ch == "_" else 0) | (DIGIT if digit else 0) | (CAPITAL if capital else 0) | (UPPER if ch.isupper() else 0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    x = np.full(n + 1, base, dtype=np.uint64)
    x[0] = 1
    return np.cumprod(x)


class Hashes:
    """Hashes of any stretches of a text without letter case: a polynomial's partial sums, shifted to the stretch's beginning."""

    def __init__(self, points: np.ndarray) -> None:
        n, (_, low) = len(points), _tables()
        lowered = np.where(points < 1 << 16, low[np.minimum(points, 0xFFFF)], points).astype(np.uint64)
        self.sums = np.r_[np.uint64(0), np.cumsum((lowered + np.uint64(1)) * _powers(_BASE, n)[:n])]
        self.back = _powers(_BASE_INVERSE, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes of whole words, which may be in lower case already."""
    words = [w.replace("i̇", "i") for w in words]
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    return Hashes(_points("".join(words)))(np.r_[0, end[:-1]].astype(np.int64), end) if words else np.zeros(0, dtype=np.uint64)


class WordSet:
    """Words of which a few others may be taken for members."""

    def __init__(self, words: Iterable[str]) -> None:
        self.table = np.zeros(1 << 16, dtype=bool)
        self.table[(hash_words(sorted({w.lower() for w in words})) & np.uint64(0xFFFF)).astype(np.int64)] = True

    def has(self, h: np.ndarray) -> np.ndarray:
        return self.table[(h & np.uint64(0xFFFF)).astype(np.int64)]


def _near(x: np.ndarray, by: int, absent: int = 0) -> np.ndarray:
    """The element ``by`` places later (earlier, if negative) of each."""
    out = np.full_like(x, absent)
    if by > 0:
        out[:-by] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def _within(x: np.ndarray, width: int) -> np.ndarray:
    """How many of the ``width`` elements from each on are true."""
    total = np.r_[0, np.cumsum(x)]
    at = np.arange(len(x))
    return total[np.minimum(at + width, len(x))] - total[at]


class Page:
    """Texts with their words. Positions are those in all texts together; ``split`` gives them to their texts."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.first = np.r_[0, np.cumsum(size)]
        self.points = _points("\n".join(texts) + "\n") if texts else np.zeros(0, dtype=np.uint32)
        flags, _ = _tables()
        self.flags = flags[np.minimum(self.points, 0xFFFF)]
        high = np.flatnonzero(self.points >= 1 << 16)
        if len(high):
            values, at = np.unique(self.points[high], return_inverse=True)
            self.flags[high] = np.array([_class(chr(c)) for c in values], dtype=np.uint8)[at]
        letter = self.flags & LETTER > 0
        joint = self.is_in("'’-") & _near(letter, -1) & _near(letter, 1)
        inside = letter | joint
        self.start = np.flatnonzero(inside & ~_near(inside, -1))
        self.end = np.flatnonzero(inside & ~_near(inside, 1)) + 1
        self.hashes = Hashes(self.points)
        self.word_hash = self.hashes(self.start, self.end)

    def is_in(self, chars: str) -> np.ndarray:
        out = np.zeros(len(self.points), dtype=bool)
        for c in chars:
            out |= self.points == ord(c)
        return out

    def split(self, positions: np.ndarray) -> Iterator[list[int]]:
        """Of each text, its positions, counted from its beginning."""
        cut = np.searchsorted(positions, self.first)
        for k in range(len(self.texts)):
            yield (positions[cut[k] : cut[k + 1]] - self.first[k]).tolist()

    def signs(self) -> np.ndarray:
        """Where something may begin that stands for @."""
        p, nxt, after, prev = self.points, _near(self.points, 1), _near(self.points, 2), _near(self.points, -1)
        at = self.is_in("@＠") | ((p == ord("&")) & ((nxt == ord("#")) | (nxt == ord("c")))) | ((p == ord("%")) & (nxt == ord("4")) & (after == ord("0"))) | ((p == ord("\\")) & (nxt == ord("u")))
        a = (nxt == ord("a")) | (nxt == ord("A")) | (nxt == ord("ä"))
        t = (after == ord("t")) | (after == ord("T")) | (after == ord("r"))
        bracket = np.flatnonzero(self.is_in("[({<") & a & t)
        bracket = bracket - (prev[bracket] == ord(" "))
        spoken = np.flatnonzero((p == ord(" ")) & a & t & ((_near(self.points, 3) == ord(" ")) | (after == ord("r"))))
        return np.unique(np.r_[np.flatnonzero(at), bracket, spoken])

    def numbers(self) -> np.ndarray:
        """Where a telephone or identity number may begin."""
        digit, upper = self.flags & DIGIT > 0, (self.points >= 65) & (self.points <= 90)
        fresh = ~(_near(self.flags & WORD > 0, -1) | _near(self.is_in("@#/+.-:"), -1))
        serial = (_within(digit | upper, 8) == 8) & (_within(digit, 9) >= 1)
        start = ((digit | self.is_in("+(")) & ((_within(digit, 16) >= 4) | serial)) | (upper & (serial | (_within(digit, 15) >= 6)))
        return np.flatnonzero(start & fresh)

    def addresses(self, streets: WordSet, openers: WordSet, endings: list[str]) -> np.ndarray:
        """Where a street address may begin: at a number with one of ``streets`` among the next words, at a word before a number that ends in one of the three letters of ``endings``, or at one of ``openers``."""
        p, digit, word = self.points, self.flags & DIGIT > 0, self.flags & WORD > 0
        number = np.flatnonzero(digit & ~_near(word | self.is_in(".:/-"), -1) & (_within(digit, 5) < 5))
        w = np.searchsorted(self.start, number)
        known = np.r_[0, np.cumsum(streets.has(self.word_hash))]
        far = np.minimum(w + 6, len(self.start))
        close = np.r_[self.start, len(p) + 99][w] - number <= 12
        out = [number[close & (known[far] > known[np.minimum(w, far)])]]
        blank = np.flatnonzero(digit & (_near(p, -1) == ord(" ")))
        packed = lambda q: (p[q - 3].astype(np.uint64) << np.uint64(42)) | (p[q - 2].astype(np.uint64) << np.uint64(21)) | p[q - 1].astype(np.uint64)
        blank = blank[blank >= 4]
        of = np.array([ord(e[0]) << 42 | ord(e[1]) << 21 | ord(e[2]) for e in endings], dtype=np.uint64)
        ends = blank[np.isin(packed(blank - 1), of)] - 1
        part = word | self.is_in("'’.-")
        begins = part & ~_near(word | (p == ord("-")), -1)
        run_start = np.flatnonzero(part & ~_near(part, -1))
        first = run_start[np.maximum(np.searchsorted(run_start, ends, side="left") - 1, 0)] if len(run_start) else ends
        places = np.flatnonzero(begins)
        lo, hi = np.searchsorted(places, first), np.searchsorted(places, ends)
        out.append(np.concatenate([places[a:b] for a, b in zip(lo, hi)]) if len(ends) else ends)
        opener = self.start[openers.has(self.word_hash) & (self.flags[self.start] & CAPITAL > 0)]
        opener = opener[~_near(word | (p == ord("-")), -1)[opener]]
        follows = np.r_[0, np.cumsum(digit & (_near(p, -1) == ord(" ")))]
        out.append(opener[follows[np.minimum(opener + 160, len(p))] > follows[opener]])
        return np.unique(np.concatenate(out)).astype(np.int64)

    def capital_pairs(self, particles: WordSet) -> np.ndarray:
        """Where a capitalised word stands that another follows, perhaps after particles."""
        if len(self.start) < 2:
            return np.zeros(0, dtype=np.int64)
        capital = self.flags[self.start] & CAPITAL > 0
        second = capital | particles.has(self.word_hash)
        gap, p = self.start[1:] - self.end[:-1], self.points
        blank = np.isin(p[self.start[1:] - 1], [32, 160])
        beside = blank & ((gap == 1) | ((gap == 2) & (p[self.end[:-1]] == ord(","))))
        return self.start[:-1][capital[:-1] & second[1:] & beside]


def pages(ids: list, texts: list, size: int = 1_000_000) -> Iterator[tuple[list, Page]]:
    """Texts that aren't null or empty, about ``size`` characters at a time; a longer one by itself."""
    some, held, own = [], 0, []
    for i, t in zip(ids, texts):
        if not t:
            continue
        some.append(t)
        own.append(i)
        held += len(t)
        if held >= size:
            yield own, Page(some)
            some, held, own = [], 0, []
    if some:
        yield own, Page(some)
