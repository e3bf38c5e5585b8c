"""Streaming forms of queries, run over the whole table as one available input.

The detectors with state for each key (``detectors``) are compared with their
batch forms in the tests.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftnet.operators.rules import R as rule_queries
from siftnet.plans.base import EV, Registry
from siftnet.session import shared_dir
from siftnet.streaming.tables import ingest_stream, window_reports
from siftnet.tables import domain_key, load, segment_key

R = Registry()


def event_stream(spark: SparkSession, sf_dir: str, late: str = "60 days") -> DataFrame:
    """The event table as a stream, every event once."""
    schema = load(spark, sf_dir, "dns_events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/dns_event[s].parquet")  # as a pattern it may be a file as well as a folder
    ev = raw.drop("received_at").withWatermark("ts", late).dropDuplicates(["event_id"])
    return ev.withColumns({"t_us": F.unix_micros("ts"), "source_hash": F.lower("source_hash"), "domain": domain_key("domain"), "network_segment": segment_key("network_segment")})


def run_available(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Everything a stream gives for the input there is, through files in the shared folder."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@R.query(f"with {EV}, m as (select max(t_us) // 1000 * 1000 as now from ev) select t_us - t_us % 900000000 as b_us, domain, count(*) as n, max(anomaly_score) as top from ev, m where domain is not null and t_us - t_us % 900000000 + 900000000 <= now - 600000000 group by 1, 2")
def stream_reports(spark, sf_dir: str) -> DataFrame:
    """Reports of windows that are final; those that still wait for late events aren't in it."""
    return run_available(spark, window_reports(event_stream(spark, sf_dir, "10 minutes"), late=None)).drop("nodes")


@R.query(f"with {EV}, e as ({rule_queries.SQL['echo_dedup_events']}) select count(*) as n from ev where domain is null or event_id in (select event_id from e)")
def stream_ingest(spark, sf_dir: str) -> DataFrame:
    """Rows of the table that a stream of the events fills, delivered twice."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    for k in range(2):
        ev = event_stream(spark, sf_dir).select("event_id", "t_us", "domain", "query_type", "source_ip", "anomaly_score")
        ingest_stream(ev, f"{base}/table", f"{base}/state{k}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/table").agg(F.count("*").alias("n"))


QUERIES, SQL = R.QUERIES, R.SQL
