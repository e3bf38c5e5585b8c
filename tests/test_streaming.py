import http.server
import json
import threading

from pyspark.sql import functions as F

from siftnet.operators.detect import beacons, rebindings
from siftnet.sources.polling import PollingSource
from siftnet.streaming import detectors as S
from siftnet.streaming.queries import run_available
from siftnet.streaming.tables import Snapshots, append_new, without_echoes

SCHEMA = "event_id string, t_us bigint, source_hash string, domain string, query_type string, resolved_ip string, anomaly_score double"


def source(spark, tmp_path, parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def rows(n, start=0, key="s"):
    return [(f"{i:04d}", i * 60_000_000, key, "d" if i % 2 else "e", "A", "10.0.0.1" if i % 7 == 6 else "8.8.8.8", 0.1) for i in range(start, start + n)]


def test_state_equals_batch(spark, tmp_path):
    data = rows(24)
    batch = spark.createDataFrame(data, SCHEMA)
    got = sorted((r.event_id, r.samples, r.cv) for r in run_available(spark, S.stream_beacons(source(spark, tmp_path, [data]), None)).collect())
    assert got == sorted((r.event_id, r.samples, r.cv) for r in beacons(batch).collect())
    got = sorted(tuple(r) for r in run_available(spark, S.stream_rebindings(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), None)).collect())
    assert got == sorted((r.domain, r.event_id, r.private_ip, r.public_ip) for r in rebindings(batch).collect())


def test_cooldown_and_counter(spark, tmp_path):
    src = source(spark, tmp_path, [rows(25)])
    assert sorted(r.event_id for r in run_available(spark, S.stream_cooldown(src, "source_hash", 600_000_000)).collect()) == ["0000", "0010", "0020"]
    assert sorted(r.n for r in run_available(spark, S.stream_every(src, "source_hash")).collect()) == [10, 20]


def test_echoes(spark, tmp_path):
    data = [(i, 10**12 + t, "s", "d", q, None, 0.0) for i, t, q in (("a", 0, "A"), ("b", 1_000_000, "A"), ("c", 0, "TXT"))]
    assert len(run_available(spark, without_echoes(source(spark, tmp_path, [data]))).collect()) == 2


def test_append_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "t")
    b = spark.createDataFrame(rows(5), SCHEMA)
    assert append_new(spark, path, b.unionByName(b)) == 5 and append_new(spark, path, b) == 0 and append_new(spark, path, spark.createDataFrame(rows(7), SCHEMA)) == 2
    assert spark.read.parquet(path).count() == 7
    (tmp_path / "s").mkdir()
    s = Snapshots(spark, str(tmp_path / "s"))
    assert s.read() is None
    s.replace(b)
    s.replace(s.read().where("event_id > '0002'"))
    assert s.read().count() == 2


def test_polling(spark):
    data = [{"timestamp": t, "v": t * 2} for t in (5, 6, 9)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": data}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(PollingSource)
        s = spark.readStream.format("siftnet_poll").option("url", f"http://127.0.0.1:{server.server_port}/q").option("start", "5").load()
        q = s.writeStream.format("memory").queryName("polled").start()
        q.processAllAvailable()
        q.stop()
        assert sorted(r.t for r in spark.sql("select t from polled").collect()) == [6, 9]
        assert spark.sql("select * from polled").select(F.get_json_object("body", "$.v").alias("v")).count() == 2
    finally:
        server.shutdown()


def test_polling_reads_bursts(monkeypatch):
    """Pages that end inside a second, records that come later for the second of the mark, equal records, and replays lose and double nothing."""
    from siftnet.sources.polling import _Reader

    data = [{"timestamp": t, "v": v} for t, v in [(5, 0), (6, 0), (6, 1), (6, 1), (7, 0), *((8, v) for v in range(9)), (9, 0)]]

    def page(mark, limit):
        rows = sorted((x["timestamp"], json.dumps(x, sort_keys=True)) for x in data if x["timestamp"] >= mark)[:limit]
        return rows, len(rows)

    r = _Reader({"url": "x", "start": "5", "limit": "3"})
    monkeypatch.setattr(r, "_page", page, raising=False)
    every = lambda: sorted((x["timestamp"], json.dumps(x, sort_keys=True)) for x in data if x["timestamp"] > 5)
    first = json.loads(json.dumps(r.initialOffset()))
    rows, mid = r.read(first)
    rows = list(rows)
    assert sorted(rows) == every()
    data += [{"timestamp": 9, "v": 1}, {"timestamp": 9, "v": 0}]
    more, end = r.read(mid)
    more = list(more)
    assert sorted(rows + more) == every() and len(more) == 2
    assert sorted(r.readBetweenOffsets(first, mid)) == sorted(rows) and sorted(r.readBetweenOffsets(mid, end)) == sorted(more)
    assert list(r.read(end)[0]) == [] and r.read(end)[1] == end
    monkeypatch.setattr(r, "_page", lambda mark, limit: page(mark, 3))
    try:
        list(r.read(first)[0])
        raise AssertionError("a second that no response holds")
    except RuntimeError:
        pass


def test_discoveries(spark, tmp_path):
    schema = "event_id string, t_us bigint, mac string, ip string"
    data = [("a", 0, "m", "1"), ("b", 29_000_000, "m", "2"), ("c", 30_000_000, "m", "1"), ("d", 1, None, "1"), ("e", 2, None, "1"), ("f", 2, None, None)]
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "in"))
    got = run_available(spark, S.stream_discoveries(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))))
    assert sorted(r.event_id for r in got.collect()) == ["a", "c", "d"]


def test_steps_in_parts_as_at_once():
    """Scores do not depend on how a key's events are divided into micro-batches."""
    import random

    import pandas as pd

    rnd = random.Random(3)
    t, xs = 0, []
    for i in range(150):
        t += rnd.choice([60_000_000, 60_000_000, 61_000_000, 90_000_000])
        xs.append((t, f"{i:03d}"))
    df = pd.DataFrame(xs, columns=["t_us", "event_id"])
    whole = S.beacon_step(("s", "d"), df, None)[0]
    for size in (1, 7, 31, 40):
        out, state = [], None
        for lo in range(0, len(df), size):
            rows, state = S.beacon_step(("s", "d"), df.iloc[lo : lo + size], state)
            out += rows
        assert [(r[0], r[1], r[2] and round(r[2], 8)) for r in out] == [(r[0], r[1], r[2] and round(r[2], 8)) for r in whole]
        out, state = [], None
        for lo in range(0, len(df), size):
            rows, state = S.every_step(10)(("s",), df.iloc[lo : lo + size], state)
            out += rows
        assert [r[2] for r in out] == list(range(10, 151, 10))


def test_tables_by_any_scheme(spark, tmp_path):
    """Existence is asked of the path's file system, and only the days of a batch are read."""
    b = spark.createDataFrame(rows(5), SCHEMA)
    for path in (str(tmp_path / "a"), f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        assert append_new(spark, path, b) == 5 and append_new(spark, path, b) == 0
        late = b.withColumn("t_us", F.col("t_us") + 86_400_000_000).withColumn("event_id", F.concat(F.lit("n"), "event_id"))
        assert append_new(spark, path, late.unionByName(b)) == 5 and append_new(spark, path, late.withColumn("t_us", F.lit(None).cast("bigint")).withColumn("event_id", F.lit("x"))) == 1
        assert spark.read.parquet(path).count() == 11 and {r.day for r in spark.read.parquet(path).select("day").distinct().collect()} == {"1970-01-01", "1970-01-02", "none"}
    s = Snapshots(spark, f"file://{tmp_path}/s")
    for n in (3, 4, 5):
        s.replace(spark.createDataFrame(rows(n), SCHEMA))
    s.clean()
    assert s.read().count() == 5 and len(list((tmp_path / "s").iterdir())) == 1


def test_polling_with_a_token(spark):
    seen = []

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.headers.get("Authorization"), self.headers.get("X-Site")))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"data": []}')

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = PollingSource({"url": f"http://127.0.0.1:{server.server_port}/", "token": "t0", "header.X-Site": "a"}).simpleStreamReader(None)
    reader.read(reader.initialOffset())
    server.shutdown()
    assert seen == [("Bearer t0", "a")]
