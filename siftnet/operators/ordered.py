"""Order within keys, hot ones in chunks of time or of value that are joined at their edges.

An ordered window over a key needs all its rows in one task. That is right for
keys of bounded size; the rows of larger ones, found by counting, are ordered
within chunks of time, and only one row per chunk (its sum, its last row) is
ordered within the key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.session import materialize

HOUR = 3_600_000_000
#: Rows of a key that one task may order.
MOST_ROWS = 1_000_000
HASHES = 8192


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"__e_{k}").eqNullSafe(F.col(k)) for k in keys))


def in_chunks(df: DataFrame, keys: list[str], t: str, chunk_us: int = HOUR, most: int = MOST_ROWS, counted: DataFrame | None = None, at_most: int | None = None) -> tuple[DataFrame, bool]:
    """Adds ``__chunk``: 0 for keys of at most ``most`` rows, chunks of time for others; and tells whether there are others.

    Rows are counted by a hash of their key first, which a few thousand counters do;
    only keys of hashes that are too frequent are counted themselves. ``counted`` may
    be rows that are cheaper to count than ``df``, such as ones with repetitions.
    ``at_most`` is a bound of the rows of the whole table, if known; within ``most``
    nothing needs counting. There are few hot keys, so that the planner broadcasts them by their measured
    size.
    """
    rows, cold = counted if counted is not None else df, df.withColumn("__chunk", F.lit(0).cast("bigint"))
    if at_most is not None and at_most <= most:
        return cold, False
    mark = F.pmod(F.xxhash64(*keys), F.lit(HASHES))
    heavy = [r.b for r in rows.groupBy(mark.alias("b")).agg(F.count("*").alias("__n")).where(F.col("__n") > most).collect()]  # at most HASHES numbers
    if not heavy:
        return cold, False
    hot = rows.where(mark.isin(heavy) if len(heavy) <= 1000 else F.lit(True)).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    hot = materialize(hot.select(*(F.col(k).alias(f"__e_{k}") for k in keys), F.lit(True).alias("__hot")), "hot")
    if hot.isEmpty():
        return cold, False
    chunk = F.when(F.col("__hot"), (F.col(t) - F.pmod(F.col(t), F.lit(chunk_us))) * 2 + 1).otherwise(F.lit(0))  # odd, so never 0
    return df.join(hot, _same(keys), "left").withColumn("__chunk", chunk).drop("__hot", *(f"__e_{k}" for k in keys)), True


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str], chunk_us: int = HOUR, most: int = MOST_ROWS, counted: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """Adds ``prev``, a struct of ``values`` of the row before within ``keys`` (null for the first), in the order of ``order``, whose first column is a time in microseconds."""
    at = [*keys, "__chunk"]
    e, some = in_chunks(df, keys, order[0], chunk_us, most, counted, at_most)
    own = F.lag(F.struct(*values)).over(Window.partitionBy(*at).orderBy(*order))
    if not some:
        return e.withColumn("prev", own).drop("__chunk")
    last = e.where("__chunk <> 0").groupBy(*at).agg(F.max(F.struct(*order, *(F.col(v).alias(f"v{i}") for i, v in enumerate(values)))).alias("l"))
    held = F.struct(*(F.col(f"l.v{i}").alias(v) for i, v in enumerate(values)))
    edges = last.select(*at, F.lag(held).over(Window.partitionBy(*keys).orderBy("__chunk")).alias("__edge"))
    edges = edges.select(*(F.col(k).alias(f"__e_{k}") for k in at), "__edge").where("__edge is not null")
    return e.withColumn("__own", own).join(edges, _same(at), "left").withColumn("prev", F.coalesce("__own", "__edge")).drop("__chunk", "__own", "__edge", *(f"__e_{k}" for k in at))


def numbered(df: DataFrame, keys: list[str], order: list[str], chunk_us: int = HOUR, name: str = "rn", most: int = MOST_ROWS, counted: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """Adds the 1-based number of each row within ``keys``, in the order of ``order``, whose first column is a time in microseconds."""
    at = [*keys, "__chunk"]
    e, some = in_chunks(df, keys, order[0], chunk_us, most, counted, at_most)
    own = F.row_number().over(Window.partitionBy(*at).orderBy(*order))
    if not some:
        return e.withColumn(name, own).drop("__chunk")
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    sums = e.where("__chunk <> 0").groupBy(*at).agg(F.count("*").alias("__n")).select(*at, before.alias("__before")).select(*(F.col(k).alias(f"__e_{k}") for k in at), "__before")
    return e.withColumn("__own", own).join(sums, _same(at), "left").withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).drop("__chunk", "__own", "__before", *(f"__e_{k}" for k in at))


def value_chunk(x: Column) -> Column:
    """Chunks of the doubles in the order of their values: eight per power of two, at most some thousand in all."""
    a = F.abs(x)
    e = F.floor(F.log2(F.greatest(a, F.lit(1e-9))) * 8).cast("int")
    return F.when(a < 1e-9, F.lit(0)).when(x > 0, e + 1000).otherwise(-(e + 1000))


def order_statistics(df: DataFrame, key: str | list[str], x: str, ranks: dict[str, Column], least: int = 1) -> DataFrame:
    """``key``, ``n`` and, for each of ``ranks`` (0-based, from the column ``n``), the value of a double column with that rank; only keys with ``least`` values.

    Counts by chunk of value tell in which chunk each rank is. Only the values of
    those chunks move; equal ones are counted before they do, and are ordered within
    one chunk, so that no key's values are ever held together. Null values don't
    count. ``df`` is read twice.
    """
    keys = [key] if isinstance(key, str) else key
    there = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in [*keys, x]))
    v = df.where(there).select(*keys, F.col(x).alias("x"), value_chunk(F.col(x)).alias("__chunk"))
    w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = v.groupBy(*keys, "__chunk").agg(F.count("*").alias("s")).select(*keys, "__chunk", "s", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("__before"), F.sum("s").over(Window.partitionBy(*keys)).alias("n"))
    inside = F.lit(False)
    for rank in ranks.values():
        inside |= (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("s"))
    needed = sums.where((F.col("n") >= least) & inside).drop("s")
    c = v.join(needed, [*keys, "__chunk"]).groupBy(*keys, "n", "__chunk", "__before", "x").agg(F.count("*").alias("c"))
    own = F.sum("c").over(Window.partitionBy(*keys, "__chunk").orderBy("x").rowsBetween(Window.unboundedPreceding, -1))
    r = c.withColumn("lo", F.col("__before") + F.coalesce(own, F.lit(0)))
    hit = lambda rank: F.max(F.when((F.col("lo") <= rank) & (rank < F.col("lo") + F.col("c")), F.col("x")))
    return r.groupBy(*keys, "n").agg(*(hit(rank).alias(name) for name, rank in ranks.items()))


def quantile_ranks(qs: dict[str, float]) -> dict[str, Column]:
    """The ranks between which quantiles lie: ``<name>_lo`` and ``<name>_hi``."""
    at = lambda q: (F.col("n") - 1) * F.lit(q)
    return {f"{k}_{side}": f(at(q)).cast("bigint") for k, q in qs.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}


def quantile(name: str, q: float) -> Column:
    """The interpolated quantile from the values of its two ranks."""
    at = (F.col("n") - 1) * F.lit(q)
    return F.col(f"{name}_lo") + (at - F.floor(at)) * (F.col(f"{name}_hi") - F.col(f"{name}_lo"))
