"""Operators on texts: packing, mixing, personal information."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siftnet.llm import pii
from siftnet.llm.mixing import Target, mix, tilted_schedule
from siftnet.llm.packing import first_fit_decreasing, pack
from siftnet.llm.tokens import TOKENIZER, token_sizes


def plain_first_fit(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                break
        else:
            room.append(capacity)
            i = len(room) - 1
        room[i] -= s
        out.append(i)
    return out


def test_first_fit():
    rnd = random.Random(1)
    for _ in range(300):
        c = rnd.randrange(1, 60)
        sizes = sorted((rnd.randrange(0, c + 1) for _ in range(rnd.randrange(0, 80))), reverse=True)
        assert first_fit_decreasing(sizes, c) == plain_first_fit(sizes, c)


def test_pack(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice([0, 1, 5, 30, 64, 65, 1000])) for i in range(400)]
    df = spark.createDataFrame(docs + docs[:40] + [(None, 7)], "doc_id bigint, n_tokens bigint")
    rows = pack(df, [("s", 64), ("l", 512)], group_items=150).collect()
    for spec, cap in (("s", 64), ("l", 512)):
        own = [r for r in rows if r.spec_name == spec]
        used, pieces = {}, {}
        for r in own:
            used[r.bin_group, r.bin_no] = used.get((r.bin_group, r.bin_no), 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append((r.token_start, r.n_tokens))
        assert max(used.values()) <= cap and len(pieces) == 400
        for i, n in docs:
            p = sorted(pieces[i])
            assert sum(x for _, x in p) == n and (len(p) == 1 or n > cap) and [s for s, _ in p] == [k * cap for k in range(len(p))]
        assert len(used) <= sum(n for _, n in docs) / cap * 1.25 + 4
    assert pack(df.where("doc_id < 0"), [("s", 64)]).count() == 0 and pack(df, []).count() == 0
    with pytest.raises(ValueError):
        pack(df, [("s", 0)])


def test_mix(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice(["big", " Big", "BIG"]) if i % 5 else rnd.choice(["sm-all", "Sm_all"]), rnd.randrange(1, 40)) for i in range(3000)] + [(None, "big", 3), (9000, None, 5), (9001, "big", 0), (9002, "other", 50)]
    df = spark.createDataFrame(docs + docs[:100], "doc_id bigint, source string, n_tokens bigint")
    targets = [Target("big", 0.4, 1), Target("small", 0.5, 3), Target("absent", 0.1, 9)]
    mixture, shares = mix(df, targets)
    rows = mixture.collect()
    assert [r.position for r in rows] == list(range(len(rows))) and all(a.at <= b.at for a, b in zip(rows, rows[1:])) and 0 <= rows[0].at and rows[-1].at <= 1
    used = {}
    for r in rows:
        used[r.doc_id, r.copy_no] = used.get((r.doc_id, r.copy_no), 0) + 1
    assert set(used.values()) == {1} and max(r.copy_no for r in rows if r.source == "big") == 0 and max(r.copy_no for r in rows if r.source == "small") == 2
    s = {r.source: r for r in shares.collect()}
    assert abs(s["big"].actual_share - 4 / 9) < 0.01 and abs(s["small"].actual_share - 5 / 9) < 0.01 and s["absent"].used_tokens == 0
    # the schedule gives the repeated source more of the end
    half = [sum(r.n_tokens for r in rows if r.source == "small" and (r.at > 0.5) == late) for late in (False, True)]
    assert half[1] > half[0] * 1.2
    big = mix(df, targets, total_tokens=10**7)[1].collect()
    assert {r.source: r.most_repeats for r in big} == {"big": 1, "small": 3, "absent": 0}
    empty, none = mix(df.where("doc_id < 0"), targets)
    assert empty.count() == 0 and {r.actual_share for r in none.collect()} == {None}


def test_schedule_keeps_shares():
    t = {"a": Target("a", 0.2, 1), "b": Target("b", 0.5, 4), "c": Target("c", 0.3, 2)}
    s = tilted_schedule(t)
    assert all(abs((k[0][1] + k[1][1]) / 2 - t[n].share) < 1e-12 for n, k in s.items()) and all(abs(sum(k[e][1] for k in s.values()) - 1) < 1e-12 for e in (0, 1))


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", 0), (2, None, 0), (3, "", 0), (4, "<|endoftext|>", 0), (5, "word " * 200_000, 0)], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_sizes(df, "text", ["doc_id"]).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 200_000


NAMES = [("Anna", "given"), ("Bela", "given"), ("Otto", "given"), ("Kranz", "family"), ("van Dorn", "family"), ("Miller-Ray", "family")]


def found(spark, texts, names=NAMES):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, kind string")
    rows = pii.find_personal(docs, spark.createDataFrame(names, "name_text string, name_part string")).collect()
    assert len({(r.doc_id, r.start_pos) for r in rows}) == len(rows)
    return {i: sorted((r.start_pos, r.kind, texts[i][r.start_pos : r.end_pos]) for r in rows if r.doc_id == i) for i in range(len(texts)) if any(r.doc_id == i for r in rows)}


def test_personal(spark):
    texts = [
        "é Ask Anna Kranz at a.kranz+x@mail.example.org.", "KRANZ, BELA; b. otto van dorn", "mail O. Miller-Ray or otto (at) x.example, otto AT x DOT example, otto&#64;x.example",
        "root@host has libresolv@1.2.3 and Anna alone", "call +44 20 7946 0507 or (303) 555-0152 or +1 303 555 0101", "SSN 981-21-9345, insurance number QQ 12 34 56 C, flow 123-45-67890-5",
        "at 12b Old Weir Street, floor 2; in der Salzstraße 93 b, und 3, rue des Aulnes, C/ Tejedores n.º 8, planta", "", "   ", None, "x" * 200_000,
    ]
    kinds = {i: [(k, v) for _, k, v in r] for i, r in found(spark, texts).items()}
    assert kinds == {
        0: [("person", "Anna Kranz"), ("email", "a.kranz+x@mail.example.org")], 1: [("person", "KRANZ, BELA"), ("person", "otto van dorn")],
        2: [("person", "O. Miller-Ray"), ("email", "otto (at) x.example"), ("email", "otto AT x DOT example"), ("email", "otto&#64;x.example")],
        4: [("phone", "+44 20 7946 0507"), ("phone", "(303) 555-0152"), ("phone", "+1 303 555 0101")], 5: [("id_number", "981-21-9345"), ("id_number", "QQ 12 34 56 C")],
        6: [("address", "12b Old Weir Street"), ("address", "Salzstraße 93 b"), ("address", "3, rue des Aulnes"), ("address", "C/ Tejedores n.º 8")],
    }


def test_learning(spark):
    """Contexts of known names and numbers lead to unknown ones, and not to what looks alike elsewhere."""
    known = [f"Thanks to {g} {f} for it. Reached on {p} today." for g in ("Anna", "Bela", "Otto") for f in ("Kranz", "van Dorn", "Miller-Ray") for p in ("+1 303 555 0101", "(303) 555-0152")]
    new = ["Thanks to Ruvek Tolm for it.", "Thanks to Ruvek Kranz for it.", "Thanks to Anna Tolm for it.", "Reached on 303 555 0177 today.", "It lists ports 443 853 8080 here. Main Street is long.", "lease of ruvek tolm"]
    got = found(spark, known + new)
    n = len(known)
    assert [v for _, _, v in got[n]] == ["Ruvek Tolm"] and [v for _, _, v in got[n + 3]] == ["303 555 0177"] and n + 4 not in got and [v for _, _, v in got[n + 5]] == ["ruvek tolm"]


def test_placeholders(spark):
    docs = spark.createDataFrame([(1, "Ask Anna Kranz, a@b.example 🙂."), (2, None), (3, "nothing")], "doc_id bigint, text string")
    names = spark.createDataFrame(NAMES, "name_text string, name_part string")
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.redact(docs, pii.find_personal(docs, names)).collect()}
    assert got == {1: ("Ask [PERSON], [EMAIL] 🙂.", 2), 2: (None, 0), 3: ("nothing", 0)}


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.find_personal(docs, spark.createDataFrame([], "name_text string, name_part string")).count() == 0
    one = spark.createDataFrame([(None, "a@b.example"), (1, "Anna Kranz")], "doc_id bigint, text string")
    assert pii.find_personal(one, spark.createDataFrame([], "name_text string, name_part string")).count() == 0


def letters(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(5))


def test_false_hits_take_no_name(spark):
    """With 20 000 family names the former bitmap also hit these words, and each took the given name beside it."""
    names = [(letters(i * 401), "family") for i in range(20_000)] + NAMES
    words = ["Dlaaa", "Gmbaa", "Ykdaa", "Qafaa", "Nymaa"]
    assert not {w.lower() for w in words} & {n for n, _ in names}
    got = found(spark, [f"{w} Anna Kranz" for w in words], names)
    assert {i: [v for _, _, v in r] for i, r in got.items()} == {i: ["Anna Kranz"] for i in range(len(words))}


def test_candidates_are_chosen_after_the_join():
    """Whatever a bitmap adds, the names are those that a scan with the exact lists finds."""
    rnd = random.Random(5)
    given, family = {"anna", "kranz", "bela"}, {"kranz", "bela", "dorn", "van dorn"}
    words = ["Anna", "Kranz", "Bela", "Dorn", "van", "Other", "Word", "B"]
    for _ in range(500):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", ", ", ". ", "'s ", "@"]) for _ in range(rnd.randrange(1, 12)))
        cover = pii.fixed_forms(text)[1]
        spans = []
        for g, f in ((given.__contains__, family.__contains__), (lambda w: True, lambda w: True)):
            hits = pii.persons(text, cover, pii.Lexicon(g, f))
            true = [(0, *h[:2], h[5]) for h in hits if h[3] in family and (h[2] is None or h[2] in given)]
            spans.append(list(pii.leftmost(true)))
        assert spans[0] == spans[1]


PIECES = ["12", "7b", "443 853 8080", "+44 20 7946 0507", "(303) 555-0152", "0199 005594", "C48W3H372", "96326731V", "QQ 12 34 56 C", "Old", "Weir", "Street", "St.", "st", "rue", "des", "Aulnes", "Salzstraße", "weg", "Am", "Ring", "C/", "Tejedores", "n.º", "8", "Anna", "ANNA", "d'", "O'Brien", "Smith-Ray's", "van", "de", "Berg", "é", "İpek", "ΑΣ", "🙂", "𝒳", "_", "@", "(at)", " at ", "DOT", ".", ",", ":", "/", "-", "\n", "  ", " ", "x", "2024-01-02", "1.2.3.4"]


def everywhere(text):
    """Candidates by form with the expressions tried at every character."""
    places = list(range(len(text)))
    return pii.fixed_forms(text, (places, places, places))[0]


def test_places_miss_no_candidate():
    from siftnet.llm.scan import Page, WordSet

    rnd = random.Random(9)
    texts = ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", " ", " ", ", "]) for _ in range(rnd.randrange(1, 40))) for _ in range(800)]
    page = Page(texts)
    pairs = page.split(page.capital_pairs(WordSet(pii.PARTICLES)))
    for text, places, starts in zip(texts, pii.places_of(page), pairs):
        assert pii.fixed_forms(text, places)[0] == everywhere(text), text
        assert [p for p in starts if pii._PAIR.match(text, p)] == [m.start() for m in pii._PAIR.finditer(text)], text


def test_names_are_found_by_columns_as_by_words():
    """With any bitmap, also one that says yes to everything, the candidates hold all that the exact lists give."""
    import numpy as np
    from siftnet.llm.scan import Page, WordSet, hash_words

    rnd = random.Random(10)
    given, family = {"anna", "berg", "i̇pek", "ασ"}, {"o'brien", "berg", "smith-ray", "van de berg", "de berg"}
    texts = ["".join(rnd.choice(PIECES) + rnd.choice([" ", " ", ", ", ". ", ""]) for _ in range(rnd.randrange(1, 30))) for _ in range(600)]
    exact = pii.Lexicon(given.__contains__, family.__contains__)
    want = [[h[:5] for h in pii.persons(t, np.zeros(len(t) + 1, dtype=bool), exact)] for t in texts]
    right = np.zeros(1 << 14, dtype=np.uint8)
    for role, words in (("g", given), ("f", family)):
        for x in pii._places_in(len(right) * 8, role, hash_words(sorted(words))):
            np.bitwise_or.at(right, (x >> np.uint64(3)).astype(np.int64), (1 << (x & np.uint64(7))).astype(np.uint8))
    for packed in (right, np.full(8, 255, dtype=np.uint8)):
        got = pii.persons_of(Page(texts), pii.Bitmap(packed), WordSet(pii.PARTICLES))
        for text, hits, w in zip(texts, got, want):
            true = [h[:5] for h in hits if h[3] in family and (h[2] is None or h[2] in given)]
            assert true == w, text


def test_taken_spans_keep_names_out(spark):
    """Of texts with one id that differ, each has its own spans."""
    docs = spark.createDataFrame([(1, "x Anna Kranz y"), (1, "at 3 Anna Kranz Street, Otto Kranz"), (2, "Bela Kranz, 4 Bela Kranz Road")], "doc_id bigint, text string")
    names = spark.createDataFrame(NAMES, "name_text string, name_part string")
    rows = sorted((r.doc_id, r.kind, r.start_pos, r.end_pos) for r in pii.find_personal(docs, names).collect())
    assert rows == [(1, "address", 3, 22), (1, "person", 2, 12), (1, "person", 24, 34), (2, "address", 12, 29), (2, "person", 0, 10)]
