import json
import random

import numpy as np

from siftnet.operators.shred import ADGUARD_LEAVES, array_children, json_children, parse_json, positions, shred


def rows(spark, bodies, schema="rec_id bigint, body string, item string, child string"):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in bodies], schema)
    return sorted(tuple(r) for r in json_children(df, "rec_id", "body", ADGUARD_LEAVES).collect())


def test_levels():
    s = shred(['{"data": [{"answer": [null, {"value": "a"}, {}]}, {"answer": []}, 5]}', "{}", "broken", None], ADGUARD_LEAVES)["answer"]
    assert (s.rep, s.defn, s.values) == ([0, 2, 2, 1, 1, 0, 0, 0], [2, 4, 3, 1, 1, 1, 0, 0], [None, "a", None, None, None, None, None, None])
    row, rec, item = positions(np.array(s.rep), np.array(s.defn))
    assert row.tolist() == [0, 0, 0, 0, 0, 1, 2, 3] and rec.tolist() == [0, 0, 0, 1, 2, 0, 0, 0] and item.tolist() == [0, 1, 2, 0, 0, 0, 0, 0]


def test_shapes(spark):
    assert rows(spark, [(1, json.dumps({"ANSWER": {"Value": "a"}, "rules": ["r", {"text": "s"}, None, {}], "question": json.dumps({"NAME": "q"}), "client_info": {}}))]) == [
        (1, 0, "answer", 0, -1, "a"), (1, 0, "client_info", 0, -1, ""), (1, 0, "question", 0, -1, "q"), (1, 0, "rule", 0, -1, "r"), (1, 0, "rule", 1, -1, "s"), (1, 0, "rule", 3, -1, ""),
    ]
    assert rows(spark, [(1, json.dumps({"answer": json.dumps([{"value": 5}, {"value": None}])}))]) == [(1, 0, "answer", 0, -1, "5"), (1, 0, "answer", 1, -1, "")]
    assert rows(spark, [(1, None), (2, ""), (3, "  "), (4, "{"), (5, "[]"), (6, '{"answer": NaN}'), (7, '{"data": []}'), (8, "5"), (9, '"x"'), (None, '{"answer": {}}'), (10, '{"answer": "nothing"}')]) == []
    assert rows(spark, [(1, '{"answer": {}}')] * 3) == [(1, 0, "answer", 0, -1, "")]
    assert rows(spark, []) == []
    long = "v" * 300_000
    assert rows(spark, [(1, json.dumps({"answer": [{"value": long}] * 3}))])[2] == (1, 0, "answer", 2, -1, long)
    assert parse_json("[" * 100_000)[0] is False


def test_numbers_stay_as_written(spark):
    assert rows(spark, [(1, '{"answer": {"value": 1.50e3}}')]) == [(1, 0, "answer", 0, -1, "1.50e3")]
    assert rows(spark, [(1, '{"answer": {"value": true}}')]) == [(1, 0, "answer", 0, -1, "true")]


def test_round_trip(spark):
    rnd = random.Random(5)
    bodies, want = [], []
    for i in range(200):
        recs = []
        for r in range(rnd.randrange(4)):
            items = [None if rnd.random() < 0.2 else {"value": f"{i}-{r}-{k}"} for k in range(rnd.randrange(4))]
            recs.append({"answer": items})
            want += [(i, r, "answer", k, -1, x["value"]) for k, x in enumerate(items) if x]
        bodies.append((i, json.dumps({"data": recs})))
    assert rows(spark, bodies) == sorted(want)


def test_arrays(spark):
    s = "id bigint, h array<struct<ip: string, p: array<int>>>, parent_id string"
    data = [(1, [("a", [1, None, 2]), None, (None, None), ("b", [])], "x"), (1, [("a", [1, None, 2]), None, (None, None), ("b", [])], "x"), (2, None, "x"), (3, [], "x"), (None, [("z", [9])], "x"), (4, [None], "x")]
    got = sorted(tuple(r) for r in array_children(spark.createDataFrame(data, s), "id", "h", "ip", "p").collect())
    assert got == [(1, 0, "host", 0, -1, "a"), (1, 0, "host", 2, -1, ""), (1, 0, "host", 3, -1, "b"), (1, 0, "open_port", 0, 0, "1"), (1, 0, "open_port", 0, 2, "2")]
    assert array_children(spark.createDataFrame([], s), "id", "h", "ip", "p").count() == 0
