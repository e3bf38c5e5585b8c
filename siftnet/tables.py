"""Reading the tables, and the spellings under which values are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftnet.session import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_key(c: Column | str) -> Column:
    """A name without letter case, outer blanks and one final dot; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.btrim(c, F.lit(" \t\n\x0b\f\r")))
    return F.nullif(F.left(bare, F.length(bare) - F.endswith(bare, F.lit(".")).cast("int")), F.lit(""))


def segment_key(c: Column | str) -> Column:
    """Null and empty segments are ``default``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("default"))


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 UTC of a timestamp (with or without zone, the latter read as session time) or integer column."""
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("bigint")


def pack_hex(c: Column | str) -> Column:
    """Text as short binary: hexadecimal text (a digest, or a UUID with its dashes) at half its length, other text as it is. One to one; see ``unpack_hex``."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c)
    return (
        F.when((n == 36) & c.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.concat(F.unhex(F.lit("02")), F.unhex(F.replace(c, F.lit("-"), F.lit("")))))
        .when((n > 0) & (n % 2 == 0) & c.rlike(r"^[0-9a-f]++\z"), F.concat(F.unhex(F.lit("01")), F.unhex(c)))
        .when(c.isNotNull(), F.concat(F.unhex(F.lit("00")), c.cast("binary")))
    )


def unpack_hex(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    kind = F.hex(F.substring(c, 1, 1))
    body = F.lower(F.hex(F.substring(c, 2, 2147483647)))
    return (
        F.when(kind == "01", body)
        .when(kind == "02", F.concat_ws("-", F.substring(body, 1, 8), F.substring(body, 9, 4), F.substring(body, 13, 4), F.substring(body, 17, 4), F.substring(body, 21, 12)))
        .otherwise(F.substring(c, 2, 2147483647).cast("string"))
    )
