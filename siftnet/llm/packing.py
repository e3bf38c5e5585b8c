"""Filling containers of fixed capacity with items.

First-fit decreasing, with a tournament tree over the room left in the bins:
each inner node holds the most room below it, so that the first bin with enough
room is found by one descent. Items are dealt at random into groups of bounded
size that are packed independently, one task each; a group wastes at most what
its own last bins leave.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftnet.llm.tokens import TOKENIZER, token_sizes
from siftnet.session import materialize
from siftnet.tables import load


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every size; sizes must be in falling order and none above ``capacity``."""
    total = sum(sizes)
    # any two neighbouring bins of first-fit hold more than one capacity together
    most = min(len(sizes), 2 * total // capacity + 2)
    leaves = 1 << max(0, most - 1).bit_length()
    room = [capacity] * (2 * leaves)
    out = []
    for s in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < s:
                node += 1
        out.append(node - leaves)
        room[node] -= s
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            top = a if a >= b else b
            if room[node] == top:
                break
            room[node] = top
    return out


_PACKED = "spec_name string, capacity_tokens int, bin_group bigint, bin_no bigint, doc_id bigint, piece bigint, n_tokens bigint"


def _pack(t: pa.Table) -> pa.Table:
    t = t.combine_chunks()
    size, doc, piece = (np.asarray(t.column(k)) for k in ("n_tokens", "doc_id", "piece"))
    order = np.lexsort((piece, doc, -size))
    t = t.take(pa.array(order))
    bins = first_fit_decreasing(size[order].tolist(), t.column("capacity_tokens")[0].as_py())
    t = t.append_column("bin_no", pa.array(bins, pa.int64()))
    return t.select(["spec_name", "capacity_tokens", "bin_group", "bin_no", "doc_id", "piece", "n_tokens"])


def pack(sizes: DataFrame, specs: list[tuple[str, int]], group_items: int = 20_000, seed: int = 7) -> DataFrame:
    """A bin for every item under every spec (name, capacity): spec, capacity, ``bin_group``, ``bin_no`` in it, ``doc_id``, ``piece``, ``token_start``, ``n_tokens``.

    ``sizes`` has ``doc_id`` and ``n_tokens``; rows that repeat a ``doc_id`` count
    once, with their greatest size, rows without one are left out. A document is
    divided, into pieces of one capacity and a rest, only if it exceeds the
    capacity. Empty documents are items of size 0. Equal sizes go by ``doc_id`` and
    ``piece``; an empty table gives an empty result. ``specs`` come from a table of
    fixed size and must be positive. Groups have about ``group_items`` items
    whatever the number of documents; which group an item is in depends on its
    hash only.
    """
    if len(specs) > 1000 or any(c is None or c <= 0 for _, c in specs):
        raise ValueError("specs must be few, and their capacities positive")
    once = materialize(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "sizes")
    if not specs:
        return once.sparkSession.createDataFrame([], _PACKED + ", token_start bigint")
    each = F.array(*(F.struct(F.lit(n).alias("spec_name"), F.lit(c).cast("int").alias("capacity_tokens")) for n, c in specs))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("s.capacity_tokens"))).cast("bigint")
    items = once.select("doc_id", "n_tokens", F.explode(each).alias("s"))
    counts = {r["spec_name"]: r["n"] for r in items.groupBy("s.spec_name").agg(F.sum(pieces).alias("n")).collect()}  # one row per spec
    groups = F.create_map(*(F.lit(x) for n, _ in specs for x in (n, -(-counts.get(n, 1) // group_items))))
    items = items.select("s.*", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    items = items.withColumn("n_tokens", F.least(F.col("capacity_tokens").cast("bigint"), F.col("n_tokens") - F.col("piece") * F.col("capacity_tokens")))
    items = items.withColumn("bin_group", F.pmod(F.xxhash64("doc_id", "piece", F.lit(seed)), groups[F.col("spec_name")].cast("bigint")))
    packed = items.groupBy("spec_name", "capacity_tokens", "bin_group").applyInArrow(_pack, _PACKED)
    return packed.withColumn("token_start", F.col("piece") * F.col("capacity_tokens"))


def _specs(spark, sf_dir: str) -> list[tuple[str, int]]:
    return [(r.spec_name, r.capacity_tokens) for r in load(spark, sf_dir, "bin_specs").limit(1001).orderBy("spec_name").collect()]  # a table of fixed size; more is refused


def p8_bins(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """Every document's place in the containers of each capacity."""
    return pack(token_sizes(load(spark, sf_dir, "documents"), "text", ["doc_id"], path), _specs(spark, sf_dir))


def p8_fill(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """How full the containers are: bins, tokens, the least number of bins that could hold them, and the share of room used."""
    b = p8_bins(spark, sf_dir, path).groupBy("spec_name", "capacity_tokens", "bin_group", "bin_no").agg(F.sum("n_tokens").alias("used"))
    total = b.groupBy("spec_name", "capacity_tokens").agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"))
    return total.withColumns({"least_bins": F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), "fill": F.try_divide(F.col("n_tokens"), F.col("n_bins") * F.col("capacity_tokens"))})


def p8_check(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """What must hold of the containers: documents in each spec, containers above their capacity, documents divided that would have fitted, and tokens lost or added."""
    sizes = token_sizes(load(spark, sf_dir, "documents"), "text", ["doc_id"], path)
    b = materialize(pack(sizes, _specs(spark, sf_dir)), "packed")
    over = b.groupBy("spec_name", "capacity_tokens", "bin_group", "bin_no").agg(F.sum("n_tokens").alias("used")).groupBy("spec_name").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    docs = b.groupBy("spec_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("own"), F.count("*").alias("pieces"), F.countDistinct("piece").alias("kinds"))
    docs = docs.join(sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("whole")), "doc_id", "full_outer")
    wrong = (F.col("pieces") > 1) & (F.col("own") <= F.col("capacity_tokens")) | (F.col("pieces") != F.col("kinds"))
    return docs.groupBy("spec_name").agg(F.count("*").alias("n_docs"), F.count_if(wrong).alias("split_wrongly"), F.count_if(~F.col("own").eqNullSafe(F.col("whole"))).alias("changed")).join(over, "spec_name").select("spec_name", "n_docs", "overfull", "split_wrongly", "changed")


QUERIES = {"p8_bins": p8_bins, "p8_fill": p8_fill, "p8_check": p8_check}
SQL = {"p8_check": "select spec_name, (select count(distinct doc_id) from documents where doc_id is not null) as n_docs, 0::bigint as overfull, 0::bigint as split_wrongly, 0::bigint as changed from bin_specs"}
