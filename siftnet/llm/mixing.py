"""Mixing sources to target weights, as a curriculum that changes over time.

A schedule gives every source a weight at each time of the training, from 0 to
1; its integral is the source's demand for tokens up to then. A source's
documents stand in a random order, and a document that begins after so many of
its source's tokens is due when the demand reaches them: the inverse of the
integral is its training position. Repeated passes over a small source go on
where the one before ended. Sorting by position gives the mixture.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftnet.llm.tokens import TOKENIZER, token_sizes
from siftnet.session import materialize
from siftnet.tables import load

LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 4096, 1 << 20, 20_000


def buckets_for(rows: int) -> int:
    """Pieces into which each running sum is divided: a task orders some ``BUCKET_ROWS`` rows, and the sums of the pieces, which one task orders, stay few."""
    return max(LEAST_BUCKETS, min(MOST_BUCKETS, 1 << (rows // BUCKET_ROWS).bit_length()))


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


def source_key(c: Column) -> Column:
    """Spellings of a source that differ in case, blanks, hyphens and underscores only are one."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s_-]+", ""), F.lit(""))


def tilted_schedule(targets: dict[str, Target], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """Weights at the beginning and the end of the training, straight in between: sources that may be repeated often gain what the others lose, each keeps its share over all, and the weights add up to the shares at all times."""
    total = sum(t.share for t in targets.values()) or 1.0
    mean = sum(t.share * t.max_repeats for t in targets.values()) / total
    most = max((abs(t.max_repeats - mean) for t in targets.values()), default=0) or 1.0
    out = {}
    for k, t in targets.items():
        a = tilt * (t.max_repeats - mean) / most
        out[k] = [(0.0, t.share * (1 - a)), (1.0, t.share * (1 + a))]
    return out


def _integral(knots: list[tuple[float, float]]) -> list[float]:
    out = [0.0]
    for (a, u), (b, v) in zip(knots, knots[1:]):
        out.append(out[-1] + (b - a) * (u + v) / 2)
    return out


def _arrival(schedule: dict[str, list[tuple[float, float]]], source: Column, demand: Column) -> Column:
    """The time at which the integral of a source's weight reaches ``demand`` (as a part of the whole mixture)."""

    def of(knots: list[tuple[float, float]]) -> Column:
        sums = _integral(knots)
        out = F.lit(knots[-1][0])
        for i in range(len(knots) - 2, -1, -1):
            (a, u), (b, v) = knots[i], knots[i + 1]
            r, slope = F.greatest(demand - sums[i], F.lit(0.0)), (v - u) / (b - a)
            # the root of u d + slope d^2 / 2 = r in the form that is stable for small slopes
            d = F.try_divide(2 * r, u + F.sqrt(F.greatest(F.lit(u * u) + 2 * slope * r, F.lit(0.0))))
            out = F.when(demand <= sums[i + 1], F.lit(a) + F.least(F.coalesce(d, F.lit(0.0)), F.lit(b - a))).otherwise(out)
        return out

    case = F.lit(None).cast("double")
    for k, knots in schedule.items():
        case = F.when(source == k, of(knots)).otherwise(case)
    return case


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list[str], size: str, name: str) -> DataFrame:
    """Adds the sum of ``size`` over the rows before, in the order of ``bucket`` and ``order``, for each of ``keys``: whole buckets are summed first, so that no key is ever ordered in one task."""
    sums = df.groupBy(*keys, bucket).agg(F.sum(size).alias("__sum"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    own = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*keys, bucket]).withColumn(name, F.col("__before") + F.coalesce(F.sum(size).over(own), F.lit(0))).drop("__before")


def mix(sizes: DataFrame, targets: list[Target], total_tokens: int | None = None, schedule: dict[str, list[tuple[float, float]]] | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The mixture and the shares reached.

    ``sizes`` has ``doc_id``, ``source`` and ``n_tokens``. Without
    ``total_tokens`` the mixture is as large as it can be with every source that
    has any tokens at its target share and no document used more than its
    ``max_repeats`` times; targets of sources without tokens are divided among the
    others in proportion. With ``total_tokens`` a source that is too small for its
    demand contributes all it may, and the shares show it. A document belongs to
    the mixture if at least half of it is within its source's demand, so that a
    source misses its demand by half a document at most.

    Mixture: ``position`` (0, 1, ...), ``at`` (time in the training), ``doc_id``,
    ``source`` (as in the targets), ``copy_no``, ``n_tokens``, sorted by position.
    Shares: one row per target. Rows that repeat a ``doc_id`` count once, rows
    without id or with no tokens can't contribute and are left out, as are sources
    without target; empty tables give an empty mixture and shares of null.
    """
    spark = sizes.sparkSession
    if len(targets) > 10_000:
        raise ValueError("targets must be a table of fixed size")
    norm = lambda s: "".join(ch for ch in s.lower() if not ch.isspace() and ch not in "_-")
    wanted = {norm(t.source): t for t in targets if t.source and t.share and t.share > 0 and t.max_repeats and t.max_repeats > 0}
    names = F.create_map(*(F.lit(x) for k, t in wanted.items() for x in (k, t.source))) if wanted else F.create_map().cast("map<string,string>")
    once = sizes.where("doc_id is not null and n_tokens > 0").withColumn("k", source_key(F.col("source"))).where(F.col("k").isin(list(wanted)) if wanted else F.lit(False))
    once = materialize(once.groupBy("doc_id").agg(F.min(F.struct("k", "n_tokens")).alias("d")).select("doc_id", "d.k", "d.n_tokens"), "sized")
    held = once.groupBy("k").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()  # one row per target at most
    have, docs_of = {r.k: r.n for r in held}, {r.k: r.docs for r in held}
    there = {k: t for k, t in wanted.items() if have.get(k)}
    whole = sum(t.share for t in there.values())
    there = {k: Target(t.source, t.share / whole, t.max_repeats) for k, t in there.items()}
    total = total_tokens if total_tokens is not None else int(min((have[k] * t.max_repeats / t.share for k, t in there.items()), default=0))
    plan = schedule or tilted_schedule(there)
    plan = {k: plan[k] for k in there}
    out_schema = "position bigint, at double, doc_id bigint, source string, copy_no int, n_tokens bigint"
    if not there or not total:
        mixture = spark.createDataFrame([], out_schema)
    else:
        value = lambda f, kind: F.create_map(*(F.lit(x) for k, t in there.items() for x in (k, f(k, t))))[F.col("k")].cast(kind)
        demand = value(lambda k, t: t.share * total, "double")
        passes = value(lambda k, t: min(t.max_repeats, int(t.share * total // have[k]) + 1), "int")
        buckets = buckets_for(sum(docs_of.values()))
        docs = once.withColumn("o", F.xxhash64("doc_id", F.lit(seed))).withColumn("b", F.pmod(F.shiftright("o", 20), F.lit(buckets)))
        docs = running_before(docs, ["k"], "b", ["o", "doc_id"], "n_tokens", "before")
        copies = docs.withColumn("copy_no", F.explode(F.sequence(F.lit(0), passes - 1)))
        middle = F.col("before") + F.col("copy_no") * value(lambda k, t: have[k], "double") + F.col("n_tokens") / 2
        copies = copies.withColumn("m", middle).where(F.col("m") <= demand)
        copies = copies.withColumn("at", _arrival(plan, F.col("k"), F.col("m") / F.lit(float(total))))
        slots = buckets_for(sum(docs_of[k] * min(t.max_repeats, int(t.share * total // have[k]) + 1) for k, t in there.items()))
        copies = copies.select("at", "doc_id", names[F.col("k")].alias("source"), "copy_no", "n_tokens", F.least(F.lit(slots - 1), F.floor(F.col("at") * slots)).cast("int").alias("b"), F.lit(1).cast("bigint").alias("one"))
        mixture = running_before(copies, [], "b", ["at", "source", "copy_no", "doc_id"], "one", "position")
        mixture = mixture.select("position", "at", "doc_id", "source", "copy_no", "n_tokens").repartitionByRange("position").sortWithinPartitions("position")
    mixture = materialize(mixture, "mixture")
    used = mixture.groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), F.count("*").alias("n_copies"), (F.max("copy_no") + 1).alias("most_repeats"))
    rows = [(t.source, t.share, t.max_repeats, int(have.get(norm(t.source or ""), 0)), float(there[norm(t.source or "")].share) if norm(t.source or "") in there else 0.0) for t in targets]
    shares = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens bigint, planned_share double").join(used, "source", "left")
    shares = shares.na.fill(0, ["used_tokens", "n_copies", "most_repeats"]).join(mixture.agg(F.sum("n_tokens").alias("total_tokens")), how="left")
    return mixture, shares.withColumn("actual_share", F.try_divide(F.col("used_tokens"), F.col("total_tokens")))


def _targets(spark, sf_dir: str) -> list[Target]:
    rows = load(spark, sf_dir, "mix_targets").limit(10_001).orderBy("source").collect()  # a table of fixed size; more is refused
    return [Target(r.source, r.target_share, r.max_repeats) for r in rows]


def p9_mixture(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """The documents in training order, sources in their target shares."""
    return mix(token_sizes(load(spark, sf_dir, "documents"), "text", ["doc_id", "source"], path), _targets(spark, sf_dir))[0]


def p9_shares(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """The shares that the mixture reaches."""
    return mix(token_sizes(load(spark, sf_dir, "documents"), "text", ["doc_id", "source"], path), _targets(spark, sf_dir))[1]


def p9_check(spark, sf_dir: str, path: str = TOKENIZER) -> DataFrame:
    """What must hold of the mixture: positions left out, uses above the caps, uses that repeat, steps back in time, and sources whose tokens miss their share by more than half a document for each source."""
    targets = _targets(spark, sf_dir)
    mixture, shares = mix(token_sizes(load(spark, sf_dir, "documents"), "text", ["doc_id", "source"], path), targets)
    caps = spark.createDataFrame([(t.source, t.max_repeats) for t in targets if t.source], "source string, cap int")
    m = mixture.join(caps, "source", "left").withColumn("piece", F.expr("position div 10000"))
    whole = m.agg((F.max("position") + 1 - F.count("*")).alias("left_out"), F.count_if(F.col("copy_no") >= F.col("cap")).alias("over_cap"), F.max("n_tokens").alias("most"))
    twice = m.groupBy("doc_id", "copy_no").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("repeated"))
    # within pieces of 10 000 positions and, by their ends, between them
    back = F.lag("at").over(Window.partitionBy("piece").orderBy("position")) > F.col("at")
    ends = m.groupBy("piece").agg(F.min(F.struct("position", "at"))["at"].alias("a"), F.max(F.struct("position", "at"))["at"].alias("b"))
    inner = m.select(back.alias("back")).agg(F.count_if("back").alias("i"))
    outer = ends.select((F.lag("b").over(Window.orderBy("piece")) > F.col("a")).alias("back")).agg(F.count_if("back").alias("o"))
    off = shares.withColumn("__one", F.lit(1)).join(whole.select("most", F.lit(1).alias("__one")), "__one").agg(F.count_if(F.abs(F.col("used_tokens") - F.col("planned_share") * F.col("total_tokens")) > F.col("most") * len(targets) / 2).alias("off"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    j = one(whole)
    for part in (twice, inner, outer, off):
        j = j.join(one(part), "__one")
    return j.select(F.coalesce("left_out", F.lit(0)).alias("left_out"), "over_cap", "repeated", (F.col("i") + F.col("o")).alias("steps_back"), "off")


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_check": p9_check}
SQL = {"p9_check": "select 0::bigint as left_out, 0::bigint as over_cap, 0::bigint as repeated, 0::bigint as steps_back, 0::bigint as off"}
