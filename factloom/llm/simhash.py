"""SimHash near-duplicates, linked through BK-trees.

Texts become 64-bit fingerprints; equal fingerprints are one class. Classes within the radius are found in
shards: the 64 bits are cut into blocks, and two fingerprints that differ in at most r bits agree on some
(blocks - r) of them, so every choice of that many blocks is a shard key and no link is lost. Each
shard builds a BK-tree (children keyed by their Hamming distance to the parent) and queries it with its
own members, following only edges within the radius. Trees travel with their shard by shuffle and are
not broadcast: all trees together grow with the data. A shard above CELL members is cut into chunks and
every pair of chunks is a cell of its own, so no task holds an unbounded group. A cell returns a spanning
forest of its links, at most one link a member, and components are joined from the forests.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, cut, free, small_batches
from .graph import components

CELL = 2048
LEAF = 16
#: Members of a cell that are looked up at a time.
QUERIES = 256
#: Up to so many oversized shards, their list is broadcast.
BROADCAST_SHARDS = 200_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Bits set in over half of the XXH64 (seed 42) of the word shingles, repeats included; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    counts = np.zeros(64, np.int64)
    step = 1 << 15
    for at in range(0, n, step):
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[at : at + step], ends[min(shingle, len(words)) - 1 + at : min(shingle, len(words)) - 1 + at + step], strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = 4, name: str = "fp") -> DataFrame:
    """doc_id and the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary()).to_pylist()
            values = np.array([fingerprint(t, shingle) if t else 0 for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(values)], names=["doc_id", name])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {name} long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints whose last axis holds their 64-bit words."""
    n = np.bitwise_count(a ^ b)
    return n[..., 0].astype(np.int16) if n.shape[-1] == 1 else n.sum(-1, dtype=np.int16)


class BKTree:
    """Children keyed by integer distance to the parent's pivot; small subtrees are leaves."""

    __slots__ = ("children", "leaf", "pivot")

    def __init__(self, x: np.ndarray, members: np.ndarray):
        self.children: dict[int, BKTree] = {}
        self.pivot, self.leaf = -1, members
        if len(members) <= LEAF:
            return
        self.pivot, rest, self.leaf = int(members[0]), members[1:], None
        d = distance(x[rest], x[self.pivot])
        for k in np.unique(d):
            self.children[int(k)] = BKTree(x, rest[d == k])

    def within(self, x: np.ndarray, queries: np.ndarray, radius: int, out: list) -> None:
        """Append (member, query) index arrays of all pairs within the radius."""
        if self.leaf is not None:
            d = distance(x[self.leaf][:, None], x[queries][None, :])
            i, j = np.nonzero(d <= radius)
            out.append((self.leaf[i], queries[j]))
            return
        d = distance(x[queries], x[self.pivot])
        near = queries[d <= radius]
        out.append((np.full(len(near), self.pivot), near))
        for k, child in self.children.items():
            chosen = queries[np.abs(d - k) <= radius]
            if len(chosen):
                child.within(x, chosen, radius, out)


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """`label` (least member of each component) after the links i - j."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]


def forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star of each component of the fingerprints (rows of words) of one cell: (member, least member) index arrays."""
    # equal fingerprints are one point of the tree, which would be as deep as they are many
    order = np.lexsort(x.T)
    new = np.concatenate([[True], (x[order][1:] != x[order][:-1]).any(1)])
    point = np.empty(len(x), np.int64)
    point[order] = np.cumsum(new) - 1
    points = x[order[new]]
    everyone = np.arange(len(points))
    tree, label = BKTree(points, everyone), everyone
    for at in range(0, len(points), QUERIES):  # the links of a block of queries at a time
        out: list = []
        tree.within(points, everyone[at : at + QUERIES], radius, out)
        label = merged(label, *(np.concatenate(p) for p in zip(*out, strict=True)))
    least = np.full(len(points), len(x))
    np.minimum.at(least, label[point], np.arange(len(x)))
    label = least[label[point]]
    moved = np.nonzero(label != np.arange(len(x)))[0]
    return moved, label[moved]


def shard_masks(n: int, radius: int) -> list[int]:
    """Masks of the blocks on which two fingerprints within the radius agree, for n fingerprints.

    With b blocks there are C(b, b - r) keys of about 64 (b - r) / b bits; b is the number that makes rows
    and expected comparisons fewest. Every choice finds every link.
    """

    def cost(b: int) -> float:
        return math.comb(b, radius) * (20 + n / 2 ** (64 * (b - radius) / b))

    b = min(range(radius + 1, radius + 5), key=cost)
    edges = [round(i * 64 / b) for i in range(b + 1)]
    blocks = [((1 << (e - s)) - 1) << s for s, e in itertools.pairwise(edges)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return [signed(sum(c)) for c in itertools.combinations(blocks, b - radius)]


def links(classes: DataFrame, n: int, radius: int, name: str = "fp") -> DataFrame:
    """Links (u, v) between the distinct fingerprints of `classes` that span all pairs within the radius."""
    masks = shard_masks(n, radius)
    keys = F.array(*[F.struct(F.lit(i).alias("mask"), F.col(name).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    rows = classes.select(F.col(name).alias("fp"), F.explode(keys).alias("k")).select("fp", "k.mask", "k.key")
    return shard_links(rows, "fp", ["fp"], ["mask", "key"], radius)


def into_cells(rows: DataFrame, ident: str, group: list[str], large: DataFrame, many: int) -> DataFrame:
    """`rows` with a column `cell`: groups of `large` (group, chunks; `many` rows) become pairs of chunks,
    each of which holds both chunks' members; other groups are a cell of their own."""
    if not many:
        return rows.withColumn("cell", F.lit(0))
    chunk = F.pmod(F.xxhash64(ident), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    cells = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(other, lambda o: F.least(chunk, o) * F.col("chunks") + F.greatest(chunk, o)))
    return rows.join(broadcast_if(large, many, BROADCAST_SHARDS), group, "left").select(*rows.columns, F.explode(cells).alias("cell"))


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal `by` columns, where equal rows follow one another, as one batch; runs of one row
    may be passed over."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        k = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by], axis=1)
        edges = np.concatenate([[0], np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1, [len(b)]])
        many = np.diff(edges) > 1
        many[[0, -1]] = True  # may go on in another batch
        for s, e in zip(edges[:-1][many].tolist(), edges[1:][many].tolist(), strict=True):
            now = tuple(k[s])
            if held and now != last:
                yield pa.concat_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.concat_batches(held)


def shard_links(rows: DataFrame, ident: str, words: list[str], shard: list[str], radius: int) -> DataFrame:
    """Links (u, v) of `ident` that span all pairs within the radius in each shard of `rows`.

    `words` names the 64-bit words of the fingerprint (long columns), `shard` the key (long columns). Rows
    of a shard must differ in `ident`.
    """
    kind = rows.schema[ident].dataType.simpleString()
    large = cut(rows.groupBy(*shard).count().where(F.col("count") > CELL).select(*shard, F.ceil(F.col("count") / CELL).cast("int").alias("chunks")))
    rows = into_cells(rows, ident, shard, large, large.count())
    by = [*shard, "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, n = [], [], 0
        for g in runs(batches, by):
            if len(g) > 1:
                x = np.stack([g.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
                a, b = forest(x, radius)
                us.append(g.column(ident).take(pa.array(a)))
                vs.append(g.column(ident).take(pa.array(b)))
                n += len(a)
            if n > 10_000:
                yield pa.record_batch([pa.concat_arrays(us), pa.concat_arrays(vs)], names=["u", "v"])
                us, vs, n = [], [], 0
        if n:
            yield pa.record_batch([pa.concat_arrays(us), pa.concat_arrays(vs)], names=["u", "v"])

    dealt = rows.repartition(*by).sortWithinPartitions(*by)
    return dealt.select(*dict.fromkeys([ident, *words, *by])).mapInArrow(run, f"u {kind}, v {kind}")


def classes(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the least doc_id reachable over links of at most `radius` bits.

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any other. Repeated rows
    are linked; a component without a non-null doc_id has a null component_id. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    prints = cut(with_fingerprint(docs, shingle))
    return prints.join(labelled(prints, radius), "fp").select("doc_id", "fp", "component_id")


def labelled(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fp, component, component_id) for every distinct fingerprint of `prints` (doc_id, fp)."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    n = distinct.count()
    groups = components(links(distinct, n, radius)) if n > 1 else distinct.select(F.col("fp").alias("node"), F.col("fp").alias("component")).limit(0)
    placed = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    return placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component", "component_id")


def dedup(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, with all columns of `docs`: that of the least doc_id (nulls last), then least fingerprint.

    Rows of one doc_id and fingerprint are copies: one of them stays.
    """
    mark_i, mark_n, mark_fp = on = free(docs, "_simhash_i", "_simhash_n", "_simhash_fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()
            values = np.array([fingerprint(t, shingle) if t else 0 for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values)], names=[*b.schema.names, mark_fp])

    small_batches(docs.sparkSession)
    prints = cut(with_fingerprint(docs, shingle))
    groups = labelled(prints, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("fp").alias("fp")))
    stays = cut(prints.select("doc_id", "fp").distinct().join(groups, "fp").groupBy("component").agg(first.alias("r")).select(F.coalesce("r.i", F.lit(0)).alias(mark_i), F.col("r.n").alias(mark_n), F.col("r.fp").alias(mark_fp)))
    schema = T.StructType([*docs.schema.fields, T.StructField(mark_fp, T.LongType())])
    marked = docs.mapInArrow(run, schema).withColumns({mark_i: F.coalesce("doc_id", F.lit(0)), mark_n: F.col("doc_id").isNull()})
    kept = marked.join(stays.hint("shuffle_hash"), on, "left_semi")
    repeated = prints.groupBy("doc_id", "fp").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(on) if repeated else kept).select(*[F.col(f"`{c}`") for c in docs.columns])
