"""Session settings, the shared folder and cutting of lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []


def local_session(app: str = "siftnet", cores: int | str = 8, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    own = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=own).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package known to the Python workers of all executors, once per application, wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_siftnet_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siftnet-code-")  # the driver's own copy, from which Spark serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "siftnet-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(root, f), os.path.join("siftnet", os.path.relpath(os.path.join(root, f), here)))
    sc.addPyFile(path)
    sc._siftnet_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on this machine alone (tests) a
    temporary folder is made; it goes when the process ends. On a cluster a folder
    that only one machine has would lose its files with it, so that is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not found:
        found = next((d for d in _OWN_DIRS if os.path.isdir(d)), None)
        if found is None:
            found = tempfile.mkdtemp(prefix="siftnet-")
            _OWN_DIRS.append(found)
            atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path, of any scheme; as the JVM's objects."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever file system, unless the session has gone already; local ones also then."""
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  at exit the JVM may be gone
        if urlparse(path).scheme in ("", "file"):
            shutil.rmtree(urlparse(path).path, ignore_errors=True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with files that outlive any executor, and keeps them
    columnar, so that later readers fetch only the columns they use.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)
