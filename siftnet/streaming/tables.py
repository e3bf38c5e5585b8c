"""Streams into tables: ingest that ignores what is there, echoes, and aggregates over time windows.

Tables may be on any file system that Spark reads: whether one exists is asked of
the path's own Hadoop file system.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StringType, StructField, StructType

from siftnet.operators.devices import insert_ignore
from siftnet.operators.rules import echo_dedup
from siftnet.session import file_system

#: Up to so many days of a batch are looked up one by one, for more the whole table is.
MOST_DAYS = 1000


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def append_new(spark: SparkSession, path: str, batch: DataFrame, key: str = "event_id", order: str = "t_us", t: str = "t_us") -> int:
    """Append the rows of a batch whose keys the table at ``path`` doesn't have; how many.

    The table is divided by ``day``, the UTC day of ``t``. Redelivered rows repeat
    their time, so that only the days of the batch are read to find them.
    """
    day = F.coalesce(F.date_format(F.timestamp_micros(t), "yyyy-MM-dd"), F.lit("none"))
    b = batch.withColumn("day", day).persist()
    try:
        there = spark.createDataFrame([], b.schema)
        if _exists(spark, path):
            days = [r.day for r in b.select("day").distinct().limit(MOST_DAYS + 1).collect()]
            schema = StructType([*(f for f in b.schema if f.name != "day"), StructField("day", StringType())])
            there = spark.read.schema(schema).parquet(path)
            there = there.where(F.col("day").isin(days)) if len(days) <= MOST_DAYS else there
        new = insert_ignore(there, b, key, order).select(b.columns).persist()
        try:
            n = new.count()
            if n:
                new.write.mode("append").partitionBy("day").parquet(path)
            return n
        finally:
            new.unpersist()
    finally:
        b.unpersist()


def ingest_stream(ev: DataFrame, path: str, checkpoint: str, dedup_echoes: bool = True, seconds: int | None = None) -> DataStreamWriter:
    """A stream of events into a table. Each micro-batch is freed of a gateway's echoes and of events that the table has; a batch that is delivered again changes nothing.

    Batches are limited by size at the source (``maxFilesPerTrigger``, ``limit``) and
    by time with ``seconds``; what is over a limit waits, nothing is dropped.
    """

    def write(batch: DataFrame, _: int) -> None:
        if dedup_echoes:
            named = batch.where("domain is not null")
            kept = echo_dedup(named.select("event_id", "t_us", "domain", "query_type", "source_ip")).select("event_id")
            batch = batch.join(kept, "event_id", "left_semi").unionByName(batch.where("domain is null"))
        append_new(batch.sparkSession, path, batch)

    writer = ev.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer


def window_reports(ev: DataFrame, width: str = "15 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Reports of names by time window, final once no event of it is still awaited; ``late`` is ``None`` for a stream whose ``ts`` has a watermark."""
    e = ev.where("domain is not null")
    if late is not None:
        e = e.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "domain").agg(F.count("*").alias("n"), F.max("anomaly_score").alias("top"), F.approx_count_distinct("source_hash").alias("nodes")).select(F.unix_micros("window.start").alias("b_us"), "domain", "n", "top", "nodes")


def without_echoes(ev: DataFrame, within: str = "2 seconds") -> DataFrame:
    """The first of questions with the same name and type within a time, over batches."""
    return ev.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", within).dropDuplicatesWithinWatermark(["domain", "query_type"])


class Snapshots:
    """A table that is replaced as a whole, on any file system: each version is a folder of its own, numbered, and counts once Spark has marked it as complete."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[str]:
        """Names of the complete versions, the latest last."""
        fs, p = file_system(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n for n in names if n.startswith("v-") and _exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/{versions[-1]}") if versions else None

    def replace(self, df: DataFrame) -> None:
        """Write a new version; readers of the old one may go on, it stays until ``clean``."""
        versions = self._versions()
        number = int(versions[-1].split("-")[1]) + 1 if versions else 1
        df.write.parquet(f"{self.path}/v-{number:012d}-{uuid.uuid4().hex}")

    def clean(self, keep: int = 1) -> None:
        """Delete all but the latest versions."""
        fs, _ = file_system(self.spark, self.path)
        for name in self._versions()[:-keep]:
            fs.delete(file_system(self.spark, f"{self.path}/{name}")[1], True)
