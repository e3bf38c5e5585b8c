"""Personal information in free text: bootstrapped contextual extraction.

What can be recognised by its form alone (an email address, a number with a
country code, a listed name) is a seed. The words around seeds are patterns;
Spark counts over all texts how often each pattern stands beside seeds and how
often beside other candidates of the same form. Candidates beside patterns that
are mostly personal become instances themselves, and so raise other patterns,
for some rounds. Numbers and addresses of weaker forms are found that way
(is ``443 853 8080`` a telephone number or a list of ports?), and given and
family names that no list has. A last scan finds the names so learned wherever
they stand together, in any letter case.

Counting is over every text, and every text is read whole, twice: for candidates
of all forms and pairs of capitalised words, and for the names learned. Where a
candidate can begin is found by whole columns of characters (``scan``). Only
patterns and name parts move between tasks, summed where they are found. What the
last scan gets of the learned names is a bitmap; whatever it finds with it,
overlapping or not, is joined with the names themselves, and only then are the
leftmost chosen. A false hit of the bitmap so never takes a true name's place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftnet.llm.scan import UPPER, Page, WordSet, _mixed, hash_words, pages
from siftnet.session import materialize
from siftnet.tables import load

# Words of streets, by language and place (before or after the name), and abbreviations among them.
STREET_AFTER = "Street St Avenue Ave Road Rd Lane Ln Close Terrace Way Drive Dr Court Ct Place Pl Square Sq Crescent Row Hill Gardens Boulevard Blvd Parade Walk Mews Grove Quay".split()
STREET_SUFFIX = "straße strasse str. weg gasse platz allee ring damm ufer chaussee straat laan gracht".split()
STREET_FR = "rue avenue boulevard chemin impasse allée place quai route cours square passage sentier".split()
STREET_ES = "Calle C/ Avenida Avda. Avda Plaza Paseo Camino Ronda Travesía Callejón".split()
ABBREVIATED = "st ave rd ln dr ct pl sq blvd".split()
# Particles that begin family names of several words.
PARTICLES = "van de von der den del della di da la le ten ter".split()
# Names of telephone and identity numbers; a number after one is a seed too. The phrases around them are learned.
PHONE_WORDS = "tel phone mobile telefon teléfono téléphone".split()
ID_WORDS = "ssn dni nif nie passport pasaporte steuer-id steuernummer tax".split()
# The check letters of Spanish identity numbers, by the remainder of the number divided by 23.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

_B = r"[     ]"  # blanks within numbers
_AT = re.compile(r"@|＠|&#64;|&#x40;|&commat;|%40|\\u0040| ?[\[({<](?:at|AT|At|arroba|ät)[\])}>] ?| (?:AT|at|arroba) ")
_DOT = r"(?:\.| ?[\[({<](?:dot|DOT|Dot|punkt|punto|point)[\])}>] ?| (?:DOT|dot|punto|punkt) |&#46;|%2[eE])"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_HOST = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])")
_LOCAL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+'-]{0,62}[A-Za-z0-9_+-])?$")
_SPELLED_DOT = re.compile(r"dot|DOT|punkt|punto|point", re.I)

_GROUP = rf"(?:{_B}|[./-])"
_PHONES = (
    ("+", rf"\+\d{{1,3}}(?:{_GROUP}?\(0\){_GROUP}?|{_GROUP})?(?:\(\d{{1,4}}\){_GROUP}?)?\d{{1,5}}(?:{_GROUP}?\d{{2,8}}){{1,5}}"),
    ("00", rf"00[1-9]\d{{1,2}}{_GROUP}?(?:\(0\){_GROUP}?)?\d{{1,5}}(?:{_GROUP}\d{{2,8}}){{1,5}}"),
    ("(", rf"\(\d{{2,5}}\){_GROUP}?\d{{3,8}}(?:{_GROUP}\d{{2,6}}){{0,3}}"),
    ("nanp", rf"[2-9]\d{{2}}(?P<s>{_GROUP})\d{{3}}(?P=s)\d{{4}}"),
    ("0", rf"0[1-9]\d{{0,4}}(?:{_GROUP}\d{{2,8}}){{1,5}}"),
)
_IDS = (
    ("ssn-", r"\d{3}-\d{2}-\d{4}"),
    ("nino", rf"[A-Z]{{2}}{_B}?\d{{2}}{_B}?\d{{2}}{_B}?\d{{2}}{_B}?[A-D]"),
    ("dni", rf"\d{{8}}[-{_B[1:-1]}]?[A-Z]|[XYZ]-?\d{{7}}-?[A-Z]"),
    ("ssn", rf"\d{{3}}{_B}\d{{2}}{_B}\d{{4}}"),
    ("tax", rf"\d{{2}}{_B}\d{{3}}{_B}\d{{3}}{_B}\d{{3}}|\d{{11}}"),
    ("pass", r"(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{8,9}"),
)
STRONG = {"+", "00", "(", "ssn-", "nino", "dni!"}
_NUMBER = re.compile(
    r"(?<![\w@#/+.\-:])(?:" + "|".join(f"(?P<{kind}{i}>{p})" for kind, ps in (("id", _IDS[:2]), ("phone", _PHONES), ("id_", _IDS[2:])) for i, (_, p) in enumerate(ps)) + r")(?![\w@])(?![.:/-]\w)"
)
_FORM = {f"{kind}{i}": ("id_number" if kind.startswith("id") else "phone", name) for kind, ps in (("id", _IDS[:2]), ("phone", _PHONES), ("id_", _IDS[2:])) for i, (name, _) in enumerate(ps)}

_CAP = r"[A-ZÀ-ÖØ-ÞŒŠŽ][\w'’-]*"
_after = "|".join(sorted({*STREET_AFTER, *(w.upper() for w in STREET_AFTER)}, key=len, reverse=True))
_ADDRESS = re.compile(
    rf"(?<![\w.:/-])(?P<en>\d{{1,4}} ?(?:[A-Za-z]\b)? (?:{_CAP} ){{1,3}}?(?P<word>{_after})\b(?! (?:{_after})\b)(?P<stop>\.?))"
    rf"|(?<![\w.:/-])(?P<fr>\d{{1,4}}(?: ?(?:bis|ter|quater)\b)?,? (?:{'|'.join(STREET_FR)})\b(?: (?:de la|de l['’]|du|des|de|d['’]))? ?{_CAP}(?:[ -]{_CAP})*)"
    rf"|(?<![\w-])(?P<de>{_CAP}?(?:{'|'.join(re.escape(w) for w in STREET_SUFFIX)}|(?<= )(?:Straße|Strasse|Weg|Gasse|Platz|Allee|Ring)) \d{{1,4}}(?: ?[a-z]\b)?(?![\w:.-]\w))"
    rf"|(?<![\w-])(?P<es>(?:{'|'.join(re.escape(w) for w in STREET_ES)})(?: (?:de la|de las|de los|del|de))? {_CAP}(?: {_CAP})*,?(?: n\.?[º°o])? \d{{1,4}}(?: ?[a-zA-Z]\b)?(?![\w:.-]\w))"
    rf"|(?<![\w-])(?P<weak>(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter dem) {_CAP}(?: {_CAP})? \d{{1,4}}(?: ?[a-z]\b)?(?![\w:.-]\w))"
)

_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_PAIR = re.compile(rf"(?<![\w@/\\+])(?<![\w]['’.-])(?=(?P<a>(?=[A-ZÀ-ÖØ-ÞŒŠŽ]){_WORD})(?P<sep>,?[  ])(?P<b>(?:(?i:(?:{'|'.join(PARTICLES)}) ){{1,2}})?(?=[A-ZÀ-ÖØ-ÞŒŠŽ]){_WORD})(?![\w@]|[.-]\w))")
_TOKEN = re.compile(r"[\w@'’-]+|\n|[^\w\s]")
_NAME_TOKEN = re.compile(_WORD)

def _end_of_name(word: str) -> str:
    """A word without the possessive ending."""
    return re.sub(r"['’][sS]$", "", word)


def emails(text: str, signs: list[int]) -> list[tuple[int, int]]:
    """Spans of email addresses, also with their signs spelled out or escaped; ``signs`` are the places where one may stand."""
    out, after = [], 0
    for p in signs:
        m = _AT.match(text, p) if p >= after else None
        if not m:
            continue
        after = m.end()
        host = _HOST.match(text, m.end())
        if not host:
            continue
        if m[0] in (" at ", " AT ", " arroba ") and not _SPELLED_DOT.search(host[0]):
            continue
        local = _LOCAL.search(text, max(0, m.start() - 64), m.start())
        if local and (not out or local.start() >= out[-1][1]):
            out.append((local.start(), host.end()))
    return out


@lru_cache(maxsize=1 << 16)
def _forms(word: str) -> tuple[str, bool, bool]:
    """A word with its digits alike and in lower case; whether it begins with a capital; whether it may end a sentence."""
    return re.sub(r"\d+", "9", word.lower()), word[:1].isupper(), word in ".!?\n:"


def context(text: str, start: int, end: int, mails: list[tuple[int, int]]) -> tuple[str, str, str]:
    """The patterns around a span: two words before; five, where a capitalised word within a sentence is ``Aa``; and one before with two after. Digits are alike, an email address is ``@``."""
    before = text[max(0, start - 90) : start]
    for a, b in reversed(mails):
        if b <= start - 90:
            break
        if b <= start:
            lo = max(a - start + len(before), 0)
            before = f"{before[:lo]} @ {before[b - start + len(before):]}"
            break
    left = _TOKEN.findall(before)[-5:]
    right = _TOKEN.findall(text, end, end + 40)[:2]
    forms = [_forms(w) for w in left]
    low = [f[0] for f in forms]
    begins = lambda i: i == 0 or (forms[i - 1][2] and not (left[i - 1] == "." and i > 1 and len(left[i - 2]) == 1))
    shape = ["Aa" if f[1] and not begins(i) else f[0] for i, f in enumerate(forms)]
    return "L " + " ".join(low[-2:]), "S " + " ".join(shape), "M " + (low[-1] if low else "^") + " _ " + " ".join(_forms(w)[0] for w in right)


def _covered(spans: list[tuple[int, int]], size: int) -> np.ndarray:
    c = np.zeros(size + 1, dtype=bool)
    for a, b in spans:
        c[a:b] = True
    return c


def _matches(pattern: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """What ``finditer`` gives, if the pattern can match at ``places`` only."""
    after = 0
    for p in places:
        if p >= after:
            m = pattern.match(text, p)
            if m:
                after = m.end()
                yield m


def dni_valid(written: str) -> bool:
    """Whether the check letter of a Spanish identity number is right."""
    bare = re.sub(r"[^0-9A-Z]", "", written)
    return DNI_LETTERS[int(bare[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == bare[-1]


@lru_cache(maxsize=1)
def _street_words() -> tuple[WordSet, WordSet, list[str]]:
    endings = {w[-3:] for w in STREET_SUFFIX} | {w[-3:] for w in ("Straße", "Strasse", "Weg", "Gasse", "Platz", "Allee", "Ring")}
    return WordSet([*STREET_AFTER, *STREET_FR]), WordSet([*(re.match(r"\w+", w)[0] for w in STREET_ES), "Am", "An", "Auf", "Im", "In", "Zum", "Zur", "Unter", "Hinter"]), sorted(endings)


def places_of(page: Page) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Of each text, where email signs, street addresses and numbers may begin."""
    return zip(page.split(page.signs()), page.split(page.addresses(*_street_words())), page.split(page.numbers()))


def fixed_forms(text: str, places: tuple[list[int], list[int], list[int]] | None = None) -> tuple[list[tuple[str, int, int, str, str]], np.ndarray]:
    """Candidates by form, in order of precedence and without overlaps: kind, start, end, form, word of an abbreviated street; and which characters they cover. ``places`` is what ``places_of`` tells about the text."""
    signs, streets, digits_at = places or next(places_of(Page([text])))
    found: list[tuple[str, int, int, str, str]] = []
    mails = emails(text, signs)
    found += [("email", a, b, "email", "") for a, b in mails]
    cover = _covered(mails, len(text))
    for m in _matches(_ADDRESS, text, streets):
        a, b = m.span()
        if not cover[a:b].any():
            form, word = m.lastgroup, ""
            if m["en"]:
                form, word = "en", m["word"].lower() if m["word"].lower() in ABBREVIATED else ""
                if m["stop"] and (not word):
                    b -= 1
                    word = ""
                elif word:
                    # "." follows: the sentence's or the word's; settled by how the word is written within sentences
                    nxt = text[b : b + 2]
                    word += "|" + ("1" if m["stop"] else "0") + ("m" if re.match(r"[.,;:)]| [a-zà-ÿ]", nxt) else "e")
            elif m["weak"]:
                form = "weak"
            elif m["de"]:
                form = "de"
            elif m["fr"]:
                form = "fr"
            else:
                form = "es"
            found.append(("address", a, b, form, word))
            cover[a:b] = True
    for m in _matches(_NUMBER, text, digits_at):
        a, b = m.span()
        if not cover[a:b].any():
            kind, form = _FORM[m.lastgroup if m.lastgroup != "s" else next(k for k in _FORM if m[k])]
            digits = sum(ch.isdigit() for ch in m[0])
            if kind == "phone" and not 7 <= digits <= 16:
                continue
            if form == "dni" and dni_valid(m[0]):
                form = "dni!"
            found.append((kind, a, b, form, ""))
            cover[a:b] = True
    return found, cover


_SCAN = "doc_id bigint, digest binary, kind string, start_pos bigint, end_pos bigint, form string, word string, p1 string, p2 string, p3 string, n bigint"
_SCAN_TYPES = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64()]


def digest_of(text: str) -> bytes:
    """Texts of one id, if they differ, are kept apart by it."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _scan_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates by form with their patterns, and, as kind ``pair``, pairs of capitalised words (``form`` given, ``word`` family) with theirs, summed."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 11
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCAN_TYPES)], names=[x.split()[0] for x in _SCAN.split(", ")])

    edges: Counter = Counter()
    particles = WordSet(PARTICLES)
    for b in batches:
        for ids, page in pages(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = []
            for doc, text, places, starts in zip(ids, page.texts, places_of(page), page.split(page.capital_pairs(particles))):
                found, cover = fixed_forms(text, places)
                mails = [(s, e) for kind, s, e, _, _ in found if kind == "email"]
                digest = digest_of(text) if found else b""
                for kind, s, e, form, word in found:
                    ctx = (None, None, None) if kind == "email" else context(text, s, e, mails)
                    rows.append((doc, digest, kind, s, e, form, word, *ctx, 1))
                for p in starts:
                    m = _PAIR.match(text, p)
                    if not m:
                        continue
                    first, second = _end_of_name(m["a"]), _end_of_name(m["b"])
                    s, e = m.start(), m.end("b") - (len(m["b"]) - len(second))
                    if first != m["a"] or cover[s:e].any():
                        continue
                    pair = (second, first) if m["sep"][0] == "," else (first, second)
                    edges[(pair[0].lower(), pair[1].lower(), *context(text, s, e, mails))] += 1
            yield out(rows)
        if len(edges) > 200_000:  # sums may go out at any time
            yield out([(None, None, "pair", None, None, *k, n) for k, n in edges.items()])
            edges = Counter()
    yield out([(None, None, "pair", None, None, *k, n) for k, n in edges.items()])


# --- learned names as a bitmap ---------------------------------------------------------------------------------------------------------------

ROLES = {"g": np.uint64(0x5851F42D4C957F2D), "f": np.uint64(0x14057B7EF767814F)}
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30


def bitmap_size(words: int) -> int:
    """Bits of the bitmap: 32 per learned word, where two are set, so that one in 250 others is taken for one. Beyond 128 MB it grows no more, which makes candidates for the exact join, and nothing else."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (32 * words - 1).bit_length())) if words else LEAST_BITS


def _places_in(bits: int, role: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of hashed words, from independent halves."""
    x = _mixed(h ^ ROLES[role])
    return (x >> np.uint64(32)) & np.uint64(bits - 1), x & np.uint64(0xFFFFFFFF) & np.uint64(bits - 1)


class Bitmap:
    def __init__(self, packed: np.ndarray) -> None:
        self.packed, self.bits = packed, len(packed) * 8

    def has(self, role: str, h: np.ndarray) -> np.ndarray:
        a, b = _places_in(self.bits, role, h)
        bit = lambda x: (self.packed[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return bit(a) & bit(b)


_BITS_SCHEMA = "at int, bits int"


def _bits_of(size: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 8, dtype=np.uint8)
        for b in batches:
            role = np.array(b.column(0).to_pylist(), dtype=object)
            h = hash_words(b.column(1).to_pylist())
            for r in ROLES:
                for x in _places_in(size, r, h[role == r]):
                    np.bitwise_or.at(held, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7))).astype(np.uint8))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int32())], names=["at", "bits"])

    return work


_PERSONS = "doc_id bigint, digest binary, start_pos bigint, end_pos bigint, given string, family string, branch int, free boolean"
_PERSONS_TYPES = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_()]
_CHOSEN = "doc_id bigint, start_pos bigint, end_pos bigint"


GIVEN, FAMILY, PARTICLE, LETTER = 1, 2, 4, 8


class Lexicon:
    """What each written word may be in a name, looked up once per word: flags, its text in lower case, and how many characters of a possessive ending it has."""

    def __init__(self, given: Callable[[str], bool], family: Callable[[str], bool]) -> None:
        self.given, self.family, self.seen = given, family, {}

    def __call__(self, written: str) -> tuple[int, str, int]:
        known = self.seen.get(written)
        if known is None:
            bare = _end_of_name(written)
            low = bare.lower()
            flags = (GIVEN if self.given(low) else 0) | (FAMILY if self.family(low) else 0) | (PARTICLE if low in PARTICLES else 0) | (LETTER if len(written) == 1 and written.isupper() else 0)
            known = (flags, low, len(written) - len(bare))
            if len(self.seen) > 500_000:  # what is kept is bounded
                self.seen.clear()
            self.seen[written] = known
        return known


Token = tuple[int, int, int, str, int]


def _family_at(text: str, tokens: list[Token], k: int, known: Callable[[str], bool]) -> tuple[str, int, int] | None:
    """A family name that begins at token ``k``: its text, its end and the token after it."""
    parts: list[str] = []
    for j in range(k, min(len(tokens), k + 3)):
        _, e, flags, w, cut = tokens[j]
        if j > k and text[tokens[j - 1][1] : tokens[j][0]] not in (" ", "\u00a0"):
            return None
        parts.append(w)
        if not flags & PARTICLE or j == k + 2:
            there = flags & FAMILY if j == k else known(" ".join(parts))
            return (" ".join(parts), e - cut, j + 1) if there else None
    return None


def _names_at(text: str, tokens: list[Token], i: int, known: Callable[[str], bool]) -> list[tuple[int, int, str | None, str, int]]:
    """Names that may begin at token ``i``: start, end, given and family name, branch."""
    s, e0, flags, w, cut = tokens[i]
    n = len(tokens)
    gap = text[e0 : tokens[i + 1][0]] if i + 1 < n else ""
    hits = []
    if flags & LETTER and gap in (". ", ".\u00a0", "."):
        f = _family_at(text, tokens, i + 1, known)
        if f:
            hits.append((s, f[1], None, f[0], 0))
    if flags & GIVEN and not cut and gap in (" ", "\u00a0"):
        f = _family_at(text, tokens, i + 1, known)
        if f:
            hits.append((s, f[1], w, f[0], 1))
    if flags & (FAMILY | PARTICLE):
        f = _family_at(text, tokens, i, known)
        if f and f[2] < n:
            t = tokens[f[2]]
            if t[2] & GIVEN and text[f[1] : t[0]] in (" ", "\u00a0", ", ", ",\u00a0"):
                hits.append((s, t[1] - t[4], t[3], f[0], 2))
    return hits


def _stands_free(text: str, s: int, e: int) -> bool:
    before, more = text[s - 1 : s] if s else "", text[e : e + 2]
    if before and (before.isalnum() or before in "@/\\_+-" or (before in "'’" and s > 1 and text[s - 2].isalnum())):
        return False
    return not (more and (more[0].isalnum() or more[0] in "@_" or (more[0] in ".-" and more[1:2].islower())))


def persons(text: str, cover: np.ndarray, lexicon: Lexicon) -> list[tuple[int, int, str | None, str, int, bool]]:
    """Spans that may be names: initial and family name, given and family name, family and given name (``branch`` 0, 1, 2), and whether each stands free and outside ``cover``. All of them, also overlapping ones, by start and branch."""
    tokens = [(m.start(), m.end(), *lexicon(m[0])) for m in _NAME_TOKEN.finditer(text)]
    hits = [h for i, t in enumerate(tokens) if t[2] for h in _names_at(text, tokens, i, lexicon.family)]
    return [(*h, _stands_free(text, h[0], h[1]) and not cover[h[0] : h[1]].any()) for h in hits]


def persons_of(page: Page, bitmap: Bitmap, particles: WordSet) -> Iterator[list[tuple[int, int, str | None, str, int, bool]]]:
    """The same for all texts of a page, without regard to what other forms cover: whole columns of words tell where a name may begin."""
    start, end, p = page.start, page.end, page.points
    cut = np.where((end - start > 2) & np.isin(p[end - 1], [ord("s"), ord("S")]) & np.isin(p[np.maximum(end - 2, 0)], [ord("'"), ord("’")]), 2, 0)
    h = page.hashes(start, end - cut)
    letter = (end - start == 1) & (page.flags[start] & UPPER > 0)
    particle = particles.has(h)
    given, family = bitmap.has("g", h), bitmap.has("f", h)
    flags = given * GIVEN | family * FAMILY | particle * PARTICLE | letter * LETTER
    close = np.r_[start[1:] - end[:-1] <= 2, False]
    nxt = lambda x, k=1: np.r_[x[k:], np.zeros(min(k, len(x)), dtype=x.dtype)]
    opens = family | particle
    begins = (letter | given) & close & nxt(opens)
    begins |= opens & close & (nxt(given) | (particle & (nxt(given, 2) | nxt(given, 3))))
    at = np.flatnonzero(begins)
    bounds = np.searchsorted(start, page.first)
    family_of = lru_cache(maxsize=1 << 16)(lambda w: bool(bitmap.has("f", hash_words([w]))[0]))
    owner = np.searchsorted(bounds, at, side="right") - 1
    at_of = np.searchsorted(owner, np.arange(len(page.texts) + 1))
    for k, text in enumerate(page.texts):
        out, base, last = [], int(page.first[k]), int(bounds[k + 1])
        for i in at[at_of[k] : at_of[k + 1]].tolist():
            tokens = []
            for j in range(i, min(i + 5, last)):
                s, e, c = int(start[j]) - base, int(end[j]) - base, int(cut[j])
                w = text[s : e - c].lower()
                # what is a particle and what isn't is known exactly
                tokens.append((s, e, int(flags[j]) & ~PARTICLE | (PARTICLE if w in PARTICLES else 0), w, c))
            out += [(*x, _stands_free(text, x[0], x[1])) for x in _names_at(text, tokens, 0, family_of)]
        yield out


def leftmost(hits: Iterable[tuple]) -> Iterator[tuple]:
    """Of hits (key, start, end, free), ordered by key, start and branch, those that stand: leftmost first, at each start only the first branch, none that isn't free."""
    last, start, after = None, -1, 0
    for key, s, e, free in hits:
        if key != last:
            last, start, after = key, -1, 0
        if s < after or s == start:
            continue
        start = s
        if free:
            after = e
            yield key, s, e


_COVER = -1  #: the branch of spans that are taken already


def _leftmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names that stand, of the candidates and taken spans of texts that come one after the other; those of one text are held."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            doc, digest, s, e, branch, free = (c.to_pylist() for c in b.columns)
            yield from zip(zip(doc, digest), s, e, branch, free)

    def chosen() -> Iterator[tuple]:
        for key, own in groupby(rows(), key=lambda r: r[0]):
            own = list(own)
            taken = sorted((s, e) for _, s, e, branch, _ in own if branch == _COVER)
            begins = [s for s, _ in taken]

            def clear(s: int, e: int) -> bool:
                i = bisect_left(begins, e)  # noqa: B023
                return i == 0 or taken[i - 1][1] <= s  # noqa: B023

            yield from leftmost((key, s, e, free and clear(s, e)) for _, s, e, branch, free in own if branch != _COVER)

    found = chosen()
    while part := list(islice(found, 10_000)):
        cols = zip(*((doc, s, e) for (doc, _), s, e in part))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start_pos", "end_pos"])


def _scan_persons(packed: bytes):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, particles = Bitmap(np.frombuffer(zlib.decompress(packed), dtype=np.uint8)), WordSet(PARTICLES)
        for b in batches:
            for ids, page in pages(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for doc, text, hits in zip(ids, page.texts, persons_of(page, bitmap, particles)):
                    digest = digest_of(text) if hits else b""
                    rows += [(doc, digest, *h) for h in hits]
                cols = list(zip(*rows)) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PERSONS_TYPES)], names=[x.split()[0] for x in _PERSONS.split(", ")])

    return work


def _seed_word(before: Column, words: list[str]) -> Column:
    """Whether one of the given words stands right before a candidate, or with one other word in between."""
    pattern = "|".join(r"\b" + re.escape(w) + r"\b" for w in words)
    return F.lower(before).rlike(rf"(?:{pattern})(?:[^\w\n]+\w+)?[^\w\n]*(?:\n|$)")


def score_numbers(cand: DataFrame, rounds: int = 3, least: float = 0.2) -> DataFrame:
    """Candidates of numbers and addresses that are accepted, by the pattern graph.

    An instance is a kind and form with the patterns around it; a pattern is good for
    a kind if enough of what stands beside it is accepted already. The graph holds
    64-bit hashes; it is scored until nothing changes, ``rounds`` times at most.
    """
    strong = F.col("form").isin([*STRONG, "en", "de", "fr", "es"])
    words = F.concat_ws("\n", "p2", "p1")
    seeded = F.when(F.col("kind") == "phone", _seed_word(words, PHONE_WORDS)).when(F.col("kind") == "id_number", _seed_word(words, ID_WORDS)).otherwise(F.lit(False))
    c = cand.where("kind <> 'email'").withColumn("seed", strong | seeded).withColumns({f"h{k}": F.xxhash64(f"p{k}") for k in (1, 2, 3)})
    c = c.withColumn("i", F.xxhash64("kind", "form", "h1", "h2", "h3", "seed"))
    state = materialize(c.groupBy("i", "kind", "h1", "h2", "h3", F.col("seed").alias("ok")).agg(F.count("*").alias("n")), "instances")
    kinds = ("phone", "id_number", "address")
    known = state.where("ok").count()
    for _ in range(rounds):
        each = state.select("i", "kind", "n", "ok", F.explode(F.array("h1", "h2", "h3")).alias("p"))
        pos = [F.sum(F.when(F.col("ok") & (F.col("kind") == k), F.col("n")).otherwise(0)).alias(k) for k in kinds]
        fine = lambda k: F.when((F.col(k) >= 2) & (F.col(k) >= least * F.col("total")), F.lit(k))
        good = each.groupBy("p").agg(F.sum("n").alias("total"), *pos).select("p", F.array_compact(F.array(*(fine(k) for k in kinds))).alias("good")).where("size(good) > 0")
        more = each.where("not ok").join(good, "p").where("array_contains(good, kind)").select("i").distinct().withColumn("new", F.lit(True))
        state = materialize(state.join(more, "i", "left").withColumn("ok", F.col("ok") | F.coalesce("new", F.lit(False))).drop("new"), "instances")
        before, known = known, state.where("ok").count()
        if known == before:
            break
    return c.join(state.where("ok").select("i"), "i", "left_semi").drop("i", "seed", "h1", "h2", "h3")


def learn_names(edges: DataFrame, seeds: DataFrame, rounds: int = 4) -> DataFrame:
    """Given (``g``) and family names (``f``): ``seeds`` and those that patterns of seeds lead to; ``role``, ``word``.

    A pattern's confidence is the share of its pairs that have a known part in its
    place. A part is learned if it stands in confident patterns in at least half of
    its pairs, and the patterns together leave little doubt, more so beside a known
    partner. Words and patterns are 64-bit hashes here; it goes on until nothing more
    is learned, ``rounds`` times at most.
    """
    ids = edges.select(F.xxhash64("given").alias("g"), F.xxhash64("family").alias("f"), *(F.xxhash64(f"p{k}").alias(f"p{k}") for k in (1, 2, 3)), "n")
    ids = materialize(ids, "pairs")
    words = edges.select(F.explode(F.array(F.struct(F.lit("g").alias("role"), F.col("given").alias("word")), F.struct(F.lit("f").alias("role"), F.col("family").alias("word")))).alias("w")).select("w.*").distinct()
    known = materialize(seeds.distinct().select("role", F.xxhash64("word").alias("w")), "names")
    size = known.count()
    for _ in range(rounds):
        has = lambda role: known.where(F.col("role") == role).select(F.col("w").alias(role), F.lit(True).alias(f"k{role}"))  # noqa: B023, E731
        e = ids.join(has("g"), "g", "left").join(has("f"), "f", "left").na.fill(False, ["kg", "kf"])
        e = materialize(e, "pairs")
        either = F.col("kg") | F.col("kf")
        each = e.select(F.explode(F.array("p1", "p2", "p3")).alias("p"), "n", either.alias("k"), F.when(either, F.xxhash64("g", "f")).alias("pair"))
        pats = each.groupBy("p").agg((F.sum(F.when(F.col("k"), F.col("n")).otherwise(0)) / (F.sum("n") + 1)).alias("c"), (F.min("pair") != F.max("pair")).alias("several")).where("c >= 0.4 and several").select("p", "c")
        scored = e
        for k in ("p1", "p2", "p3"):
            scored = scored.join(pats.select(F.col("p").alias(k), F.col("c").alias(f"c{k}")), k, "left")
        scored = scored.withColumn("c", F.coalesce(F.greatest("cp1", "cp2", "cp3"), F.lit(0.0))).select("g", "f", "kg", "kf", "n", "c")
        parts = []
        for role, other in (("g", "kf"), ("f", "kg")):
            doubt = F.log1p(-F.least(F.lit(0.97), F.col("c") * F.when(F.col(other), 1.0).otherwise(0.7)))
            parts.append(scored.groupBy(F.col(role).alias("w")).agg((F.sum(F.col("n") * F.col("c")) / F.sum("n")).alias("mean"), (1 - F.exp(F.sum(doubt))).alias("sure")).where("mean >= 0.5 and sure >= 0.7").select(F.lit(role).alias("role"), "w"))
        known = materialize(known.unionByName(parts[0]).unionByName(parts[1]).distinct(), "names")
        before, size = size, known.count()
        if size == before:
            break
    learned = words.withColumn("w", F.xxhash64("word")).join(known, ["role", "w"], "left_semi").select("role", "word")
    return materialize(learned.unionByName(seeds.select("role", "word")).distinct(), "names")


def find_personal(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``kind``, ``start_pos``, ``end_pos`` of every email address, telephone and identity number, street address and person's name.

    Positions count Unicode code points from 0, the end is exclusive, and rows of
    a document don't overlap. ``names`` has ``name_text`` and ``name_part``
    (``given`` or ``family``). Null, empty and blank texts have no rows, documents
    without id are left out, repeated rows of a document (same id and text) change
    nothing, texts that repeat under other ids have rows each. Empty tables give an
    empty result; without names in the list persons can't be learned. Long texts
    are read whole.
    """
    slim = docs.where(F.col(f"`{text}`").isNotNull() & F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    scan = materialize(slim.mapInArrow(_scan_texts, _SCAN), "scan")
    cand = scan.where("kind <> 'pair'").drop("n")
    edges = materialize(scan.where("kind = 'pair'").groupBy(F.col("form").alias("given"), F.col("word").alias("family"), "p1", "p2", "p3").agg(F.sum("n").alias("n")), "pairs")
    seeds = names.where("name_text is not null and name_part in ('given', 'family')").select(F.when(F.col("name_part") == "given", "g").otherwise("f").alias("role"), F.lower(F.trim("name_text")).alias("word"))
    lexicon = learn_names(edges, seeds)
    bitmap = np.zeros(bitmap_size(lexicon.count()) // 8, dtype=np.uint8)
    for r in lexicon.mapInArrow(_bits_of(len(bitmap) * 8), _BITS_SCHEMA).groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():  # at most 128 MB of bits
        bitmap[r["at"]] = r["bits"]
    found = slim.mapInArrow(_scan_persons(zlib.compress(bitmap.tobytes(), 1)), _PERSONS)
    family = lexicon.where("role = 'f'").select(F.col("word").alias("family"))
    given = lexicon.where("role = 'g'").select(F.col("word").alias("given"))
    sure = found.join(family, "family", "left_semi")
    sure = sure.join(given.withColumn("listed", F.lit(True)), "given", "left").where("given is null or listed")
    taken = cand.select("doc_id", "digest", "start_pos", "end_pos", F.lit(_COVER).alias("branch"), F.lit(False).alias("free"))
    ranked = sure.select("doc_id", "digest", "start_pos", "end_pos", "branch", "free").unionByName(taken).repartition("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "start_pos", "branch")
    who = ranked.mapInArrow(_leftmost, _CHOSEN).select("doc_id", F.lit("person").alias("kind"), "start_pos", "end_pos")
    # the full stop after an abbreviated street word belongs to it if it is mostly written with one within sentences
    split = F.split("word", r"\|")
    stops = cand.where("word <> ''").select(F.get(split, F.lit(0)).alias("w"), F.get(split, F.lit(1)).alias("how")).groupBy("w").agg(F.count_if(F.col("how") == "1m").alias("dotted"), F.count_if(F.col("how") == "0m").alias("bare")).select("w", (F.col("dotted") >= F.col("bare")).alias("own"))
    nums = score_numbers(cand).withColumn("w", F.get(F.split("word", r"\|"), F.lit(0))).join(stops, "w", "left")
    cut = F.when((F.get(F.split("word", r"\|"), F.lit(1)) == "1e") & ~F.coalesce("own", F.lit(True)), 1).otherwise(0)
    nums = nums.select("doc_id", "kind", "start_pos", (F.col("end_pos") - cut).alias("end_pos"))
    mails = cand.where("kind = 'email'").select("doc_id", "kind", "start_pos", "end_pos")
    return mails.unionByName(nums).unionByName(who).distinct()


def _redact(t: pa.Table) -> pa.Table:
    out = []
    for doc, text, spans in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), t.column("spans").to_pylist()):
        if text is not None and spans:
            parts, at = [], 0
            for s in sorted(spans, key=lambda x: x["start_pos"]):
                parts += [text[at : s["start_pos"]], f"[{s['kind'].upper()}]"]
                at = s["end_pos"]
            text = "".join(parts) + text[at:]
        out.append((doc, text, len(spans or [])))
    a, b, c = zip(*out) if out else ([], [], [])
    return pa.table({"doc_id": pa.array(a, pa.int64()), "text": pa.array(b, pa.string()), "n_replaced": pa.array(c, pa.int64())})


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with its personal information replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[PERSON]``, the rest as it is; a document without any is unchanged."""
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "end_pos", "kind")).alias("spans"))
    both = docs.select("doc_id", "text").join(spans, "doc_id", "left")
    return both.mapInArrow(lambda bs: (x for b in bs for x in _redact(pa.Table.from_batches([b])).to_batches()), "doc_id bigint, text string, n_replaced bigint")


def p10_found(spark, sf_dir: str) -> DataFrame:
    return find_personal(load(spark, sf_dir, "documents"), load(spark, sf_dir, "name_list"))


def p10_redacted(spark, sf_dir: str) -> DataFrame:
    """The documents with placeholders for what was found."""
    return redact(load(spark, sf_dir, "documents"), p10_found(spark, sf_dir))


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
SQL: dict[str, str] = {}
