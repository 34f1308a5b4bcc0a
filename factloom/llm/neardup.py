"""Near duplicates by word shingles: SimHash and BK-trees find candidates, exact similarity decides.

Texts of equal words (A-Z lower-cased) are one class. A class has a 256-bit SimHash of its distinct shingles and
MinHash bands. A band is a shard: its classes are searched by a BK-tree over their SimHashes, cut into cells where the
shard is large (see `simhash`). What the trees link are candidate groups. The texts of these groups alone are
brought together and compared by their whole shingle sets; a cell returns a spanning forest of the pairs that pass.

A pair of similarity 0.8 shares none of 20 bands of 3 with probability 6e-7, and exceeds 76 of 256 bits with 1e-8
(a few shingles: 3e-6); more similar pairs with less. Pairs that share a passage of a tenth of their shingles
are within 76 bits with probability 2e-6, so passages do not join groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import broadcast_if, cut, free, small_batches
from .decontam import shingle_hashes, word_hashes
from .graph import components
from .tokens import split_words, spread

BANDS, ROWS = 20, 3
WORDS = 4
#: Members and shingles of a chunk of a candidate group.
CHUNK, CHUNK_SHINGLES = 1024, 1_000_000
#: Holders of shingles that are counted at a time.
POSTINGS = 500_000
#: Up to so many members of candidate groups, their list is broadcast (about 60 bytes each).
BROADCAST_MEMBERS = 200_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_SEEDS = (np.arange(1, 1 + BANDS * ROWS + WORDS, dtype=np.uint64) * _ODD) ^ _MIX


def mixed(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    x = (h ^ seed) * _MIX
    x ^= x >> np.uint64(31)
    return x * _ODD


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct shingles of word hashes; fewer words than k are one shingle, no words none."""
    return np.unique(shingle_hashes(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> tuple[list[int], list[int]]:
    """SimHash words and band keys of a shingle set, as signed longs; a set of none has zeros."""
    if not len(s):
        return [0] * WORDS, [0] * BANDS
    counts = np.zeros((WORDS, 64), np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 1 << 12):
        x = mixed(s[at : at + (1 << 12)], _SEEDS[:, None])
        least = np.minimum(least, x[WORDS:].min(1))
        counts += np.unpackbits(x[:WORDS].view(np.uint8).reshape(WORDS, -1, 8), axis=2).sum(1, dtype=np.uint16)
    prints = np.packbits(2 * counts > len(s), axis=1).view(np.int64).ravel()
    keys = least.reshape(BANDS, ROWS)
    key = mixed(keys[:, 0], _ODD)
    for i in range(1, ROWS):
        key = mixed(key ^ keys[:, i], _ODD)
    return prints.tolist(), key.view(np.int64).tolist()


def _hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    words, counts = split_words(texts, lower=True)
    h = word_hashes(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return (h[s:e] for s, e in zip(at[:-1], at[1:], strict=True))


def _text_key() -> list:
    """128 bits of the text as it is, computed in the JVM."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("_k0"), F.xxhash64(F.lit(1), text).alias("_k1")]


def _class_id(h: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(h.tobytes())


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, _k0 and _k1 (the text), cid (128-bit class), n (distinct shingles), f0.. (SimHash), keys (bands) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, sizes, prints, keys = [], [], [], []
            seen: dict[bytes, tuple] = {}
            for h in _hashed(b.column(1)):
                cid = _class_id(h)
                if cid not in seen:
                    s = shingle_set(h, shingle)
                    seen[cid] = (len(s), *sketch(s))
                n, p, k = seen[cid]
                cids.append(cid)
                sizes.append(n)
                prints.append(p)
                keys.append(k)
            f = np.array(prints, np.int64).reshape(-1, WORDS).T
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in f), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "_k0", "_k1", "cid", "n", *(f"f{i}" for i in range(WORDS)), "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_text_key()).mapInArrow(run, f"doc_id {kind}, _k0 long, _k1 long, cid binary, n long, {', '.join(f'f{i} long' for i in range(WORDS))}, keys array<long>")


def exact_forest(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Pairs of indices that span all pairs of sets of at least this Jaccard similarity (two empty sets: 1)."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    ids, of = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(of, kind="stable")
    holders = owner[order]
    number = np.bincount(of, minlength=len(ids))
    first = np.cumsum(number) - number
    at = np.concatenate([[0], np.cumsum(sizes)])
    label, us, vs = np.arange(m), [], []
    for i in range(m):
        mine = of[at[i] : at[i + 1]]
        both = np.zeros(m, np.int64)
        for j in range(0, len(mine), max(1, POSTINGS // m)):
            both += np.bincount(holders[spread(first, number, mine[j : j + max(1, POSTINGS // m)])], minlength=m)
        total = sizes[i] + sizes - both
        near = np.nonzero((both >= similarity * total - 1e-9) & (label != label[i]))[0]
        for j in near.tolist():
            if label[j] != label[i]:
                us.append(i)
                vs.append(j)
                label[label == label[j]] = label[i]
        if len(us) == m - 1:
            break
    return us, vs


def _verified(docs: DataFrame, members: DataFrame, count: int, shingle: int, similarity: float) -> DataFrame:
    """Links (u, v) that span the similar pairs of each candidate group of `members` (id, group, n, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in simhash.runs(batches, by):
            if len(g) < 2:
                continue
            us, vs = exact_forest([shingle_set(h, shingle) for h in _hashed(g.column("text"))], similarity)
            ids = g.column("id")
            yield pa.record_batch([ids.take(pa.array(us, pa.int64())), ids.take(pa.array(vs, pa.int64()))], names=["u", "v"])

    by = ["group", "cell"]
    members = members.select("id", "group", "n", "key._k0", "key._k1")
    size = members.groupBy("group").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("s") / CHUNK_SHINGLES)).cast("int")
    large = cut(size.select("group", chunks.alias("chunks")).where("chunks > 1"))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), *_text_key())
    found = texts.join(broadcast_if(members.drop("n"), count, BROADCAST_MEMBERS), ["_k0", "_k1"]).groupBy("id").agg(*(F.first(c).alias(c) for c in ("group", "text")))
    rows = simhash.into_cells(found, "id", ["group"], large, large.count())
    return rows.repartition(*by).sortWithinPartitions(*by).select("id", "text", *by).mapInArrow(run, "u long, v long")


def _groups(docs: DataFrame, shingle: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, _k0, _k1, cid) of all rows, and (cid, component, component_id) of all classes."""
    small_batches(docs.sparkSession)
    prints = cut(_sketches(docs, shingle))
    words = [f"f{i}" for i in range(WORDS)]
    least = prints.groupBy("cid").agg(F.min("doc_id").alias("least"), F.min(F.struct("_k0", "_k1")).alias("key"), *(F.first(c).alias(c) for c in ("n", *words, "keys")))
    # classes get numbers, as links between longs are joined and aggregated in place
    distinct = cut(least.withColumn("id", F.monotonically_increasing_id()))
    shards = distinct.select("id", *words, F.posexplode("keys").alias("band", "key"))
    candidates = components(simhash.shard_links(shards, "id", words, ["band", "key"], radius))
    members = cut(candidates.join(distinct.select("id", "n", "key"), F.col("node") == F.col("id")).select("id", F.col("component").alias("group"), "n", "key"))
    count = members.count()
    found = components(_verified(docs, members, count, shingle, similarity)) if count else candidates
    placed = distinct.select("id", "cid", "least").join(found.withColumnRenamed("node", "id"), "id", "left").select("cid", "least", F.coalesce("component", "id").alias("component"))
    labelled = placed.join(placed.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    return prints.select("doc_id", "_k0", "_k1", "cid"), labelled.select("cid", "component", "component_id")


def classes(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 76) -> DataFrame:
    """doc_id and component_id, the least doc_id reachable over pairs of at least this Jaccard similarity.

    Similarity is that of the sets of word shingles. Texts of fewer words are one shingle. Null and empty texts, and
    texts of white space, are one class. Repeated rows are linked; a component without a non-null doc_id has a
    null component_id. Other columns are ignored.
    """
    prints, groups = _groups(docs, shingle, similarity, radius)
    return prints.join(groups, "cid").select("doc_id", "component_id")


def dedup(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 76) -> DataFrame:
    """One row of each component (see `classes`), with all columns of `docs`: that of the least doc_id (nulls last).

    Of rows with that doc_id and different texts, the one whose text hashes to less; of those with one text, any.
    """
    prints, groups = _groups(docs, shingle, similarity, radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), "_k0", "_k1"))
    chosen = prints.distinct().join(groups, "cid").groupBy("component").agg(first.alias("r"))
    names = free(docs, "_neardup_i", "_neardup_n", "_neardup_0", "_neardup_1")
    stays = cut(chosen.select(*(c.alias(k) for c, k in zip((F.coalesce("r.i", F.lit(0)), F.col("r.n"), F.col("r._k0"), F.col("r._k1")), names, strict=True))))
    marked = docs.withColumns(dict(zip(names, (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), *_text_key()), strict=True)))
    kept = marked.join(stays.hint("shuffle_hash"), names, "left_semi")
    repeated = prints.groupBy("doc_id", "_k0", "_k1").count().where("count > 1").limit(1).count()
    return (kept.dropDuplicates(names) if repeated else kept).select(*[F.col(f"`{c}`") for c in docs.columns])
