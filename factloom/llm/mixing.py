"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash. A source whose target is t times its size takes floor(t) copies of
each document, and one more of those whose hash is under a threshold. The thresholds come from
histograms: sizes are summed by source and hash bucket, the bucket in which the running sum crosses the
budget is refined by the next bits, and no row is sorted. Thresholds nest: a larger budget takes a
superset. Each level reads the slim (source, size, hash) table once and shuffles at most 2^15 partial
sums a source and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if, cut, free, word_count

DIGIT_BITS = 15
LEVELS = 4  # 4 x 15 = the 60 bits of the hash
#: Up to so many sources, per-source tables are broadcast (about 100 bytes a source).
BROADCAST_SOURCES = 100_000
#: Sources that one task puts in order.
RANGE = 100_000


def hash60(doc_id: Column, text: Column) -> Column:
    """Uniform in [0, 2^60): the first 15 hex digits of an MD5 of the doc_id, or of the text where it is null."""
    key = F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(sizes: DataFrame, n: int) -> DataFrame:
    """`sizes` with the rank (from 0) of each source by code point, null last: sorted in ranges of about RANGE
    sources, whose numbers are added up on the driver."""
    order = [F.col("source").isNull(), F.col("source")]
    ranges = max(1, -(-n // RANGE))
    spread = sizes.repartitionByRange(ranges, *order) if ranges > 1 else sizes.repartition(1)
    place = F.monotonically_increasing_id()  # partition << 33 | row
    placed = cut(spread.sortWithinPartitions(*order).select("source", "source_size", F.shiftright(place, 33).cast("int").alias("p"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    offset = F.create_map(*_pairs(placed)) if ranges > 1 else None
    return placed.select("source", "source_size", (F.col("i") if offset is None else F.col("i") + offset[F.col("p")]).alias("rank"))


def _pairs(placed: DataFrame) -> list[Column]:
    """partition, rows before it, ... as literals."""
    out, before = [], 0
    for r in sorted(placed.groupBy("p").count().collect()):
        out += [F.lit(r["p"]), F.lit(before).cast("long")]
        before += r["count"]
    return out


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> + target: `share` of all sizes split by weight, no source above `most` times its size.

    Weights repeat over the sources in code-point order, null last. A level starts at the share of a unit of
    weight and rises while sources below it are held at their cap and the rest share what is left; sizes and
    weights are whole numbers, so sums of up to 2^53 are exact in any order. No window spans all sources.
    """
    sizes = cut(sizes)
    whole = sizes.agg(F.count("*").alias("n"), F.sum("source_size").alias("size")).first()
    if not whole["n"]:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    ws = F.array(*[F.lit(float(w)) for w in weights])
    ranked = _ranked(sizes, whole["n"]).select("source", "source_size", F.element_at(ws, (F.col("rank") % len(weights) + 1).cast("int")).alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    budget, level, held = whole["size"] * float(share), None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("cap") / F.col("w") <= F.lit(level)
        sums = ranked.agg(F.count_if(capped).alias("held"), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("cap"), F.sum(F.when(capped, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if sums["held"] == held or not sums["w"]:
            break
        level, held = (budget - sums["cap"]) / sums["w"], sums["held"]
    target = F.col("cap") if not sums["w"] else F.when(F.col("cap") / F.col("w") <= F.lit(level), F.col("cap")).otherwise(F.col("w") * F.lit(level))
    return ranked.select("source", "source_size", target.alias("target"))


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    name = free(left, "_s")[0]
    return left.join(right.withColumnRenamed("source", name), F.col("source").eqNullSafe(F.col(name))).drop(name)


def limits(slim: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """(source, source_size, target, base, limit), one row a source, and their number, from `slim` (source, size, hash).

    A document is taken `base` times, and once more if its hash is up to `limit`.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    state = cut(
        source_targets(sizes, weights, share, most)
        .withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.col("target") - F.col("base") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("before", F.lit(0).cast("long"))
        .withColumn("at", F.lit(0).cast("long"))
    )
    n_sources = state.count()
    for level in range(1, LEVELS + 1):
        shift = DIGIT_BITS * (LEVELS - level)
        above = slim.where(F.col("size") > 0)
        if level > 1:
            above = _same_source(above, broadcast_if(state.select("source", "prefix"), n_sources, BROADCAST_SOURCES)).where(F.shiftrightunsigned("hash", shift + DIGIT_BITS) == F.col("prefix"))
        histogram = above.groupBy("source", F.shiftrightunsigned("hash", shift).alias("bucket")).agg(F.sum("size").alias("mass"))
        running = histogram.withColumn("upto", F.sum("mass").over(Window.partitionBy("source").orderBy("bucket")))
        placed = _same_source(running, broadcast_if(state.select("source", "budget", "before"), n_sources, BROADCAST_SOURCES))
        crossing = placed.where(F.col("before") + F.col("upto") > F.col("budget")).groupBy("source").agg(F.min(F.struct("bucket", (F.col("before") + F.col("upto") - F.col("mass")).alias("below"), "mass")).alias("x"))
        crossing = crossing.select(F.col("source").alias("_s"), F.col("x.bucket").alias("_b"), F.col("x.below").alias("_below"), F.col("x.mass").alias("_m"))
        state = cut(
            state.join(crossing, F.col("source").eqNullSafe(F.col("_s")), "left").select(
                "source", "source_size", "target", "base", "budget",
                F.coalesce("_b", F.lit(-1)).cast("long").alias("prefix"), F.coalesce("_below", "before").alias("before"), F.coalesce("_m", F.lit(0)).cast("long").alias("at"),
            )
        )
    nearer = F.col("before") + F.col("at") - F.col("budget") < F.col("budget") - F.col("before")
    return state.select("source", "source_size", "target", "base", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("limit")), n_sources


def _slim(docs: DataFrame) -> DataFrame:
    return cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash")))


def _times(hash_: Column, base: Column, limit: Column, most: float) -> Column:
    """A text without words may have a hash below the limit of a source that is at its cap already."""
    return F.least(base + (hash_ <= limit).cast("long"), F.lit(math.ceil(most)).cast("long"))


def copies(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each document.

    `docs` needs doc_id, text, source; other columns are ignored. Returns doc_id, size, source_size, target, copies,
    hash, one row per input row.

    Null text has size 0; a null source is a source of its own; a null doc_id is hashed by its text;
    repeated rows have one hash and are taken or left together. The document on which a budget ends is taken
    if that brings the source nearer its target. No document is taken more than `most` times (rounded up). A
    source without words has no target and is not taken. An empty table gives an empty result.
    """
    slim = _slim(docs)
    found, n = limits(slim, weights=weights, share=share, most=most)
    mixed = _same_source(slim, broadcast_if(found, n, BROADCAST_SOURCES))
    return mixed.select("doc_id", "size", "source_size", "target", _times(F.col("hash"), F.col("base"), F.col("limit"), most).alias("copies"), "hash")


def mix(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it, with all their columns.

    The limits, one small row a source, go to the documents: whole texts are not shuffled (beyond
    BROADCAST_SOURCES sources Spark may join by shuffle).
    """
    found, n = limits(_slim(docs), weights=weights, share=share, most=most)
    source, base, limit, copy = free(docs, "_mix_source", "_mix_base", "_mix_limit", "_mix_copy")
    per_source = found.select(F.col("source").alias(source), F.col("base").alias(base), F.col("limit").alias(limit))
    joined = docs.join(broadcast_if(per_source, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col(source)))
    times = _times(hash60(F.col("doc_id"), F.col("text")), F.col(base), F.col(limit), most)
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, cap / w AS ratio,
        (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN w * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level) ELSE cap END AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
c AS (SELECT source, h, sum(size) AS mass, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d WHERE size > 0 GROUP BY source, h),
x AS (SELECT b.source, b.source_size, b.target, b.base, b.target - b.base * b.source_size AS budget,
        min(c.h) AS h, arg_min(c.upto - c.mass, c.h) AS below, arg_min(c.mass, c.h) AS mass
      FROM b LEFT JOIN c ON b.source IS NOT DISTINCT FROM c.source AND c.upto > b.target - b.base * b.source_size
      GROUP BY b.source, b.source_size, b.target, b.base),
y AS (SELECT *, CASE WHEN below + mass - budget < budget - below THEN h ELSE h - 1 END AS lim FROM x)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, y.source_size, y.target,
       CAST(d.size * (y.base + CASE WHEN d.h <= coalesce(y.lim, -2) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source
"""
