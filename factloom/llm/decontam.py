"""Benchmark decontamination by SimHash over item-sized windows, and exact weighted similarity.

For each length of a benchmark item, windows of that many words slide over every whole document. Windows whose
shingles cannot weigh enough to verify are passed over without loss. Each other window has a 64-bit SimHash of its
weighted shingles. Multi-index Hamming blocks find the items near it: fingerprints that differ in at most
`radius` bits agree on one of radius + 1 blocks, so every item within the radius is found. Exact weighted similarity
of word shingles decides on what they find.

Of 4,977 windows similar by 0.8 to 0.9 to items of 20 to 200 words, 19 bits were the most that differed; 16 bits
would lose 0.2 % and 12 bits 5 %. The radius is 22, so a loss is not excluded but was not seen. Unlike fingerprints
differ in 32 +- 4 bits; the bound on weights leaves few of them. Up to SCAN items of a length are compared
without blocks, with the same result.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .tokens import split_words, spread

#: A block of items that goes to every task: this many words at most.
BLOCK_WORDS = 2_000_000
#: Windows whose fingerprints are compared at a time.
WINDOWS = 1024
#: Items of one length that are compared with every window; more are found by blocks.
SCAN = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (fewer words: none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[i : i + n] * _ODD
    return out ^ (out >> np.uint64(31))


class Items:
    """The index over a block of benchmark items (item_id, words)."""

    def __init__(self, items: list[tuple[int, list[str]]], shingle: int, similarity: float, radius: int = 22):
        self.shingle, self.similarity, self.radius = shingle, similarity, radius
        self.ids = [i for i, _ in items]
        hashes = [word_hashes(w) for _, w in items]
        self.length = np.array([len(h) for h in hashes])
        own = [shingle_hashes(h, min(shingle, len(h))) for h in hashes]
        held = Counter(int(s) for o in own for s in set(o.tolist()))
        m = len(items)
        self.weight = {s: math.log1p(m / n) for s, n in held.items()}
        self.rest = math.log1p(m)  # of a shingle in no item
        self.bags = [Counter(o.tolist()) for o in own]
        self.mass = np.array([sum(self.weight[s] * c for s, c in b.items()) for b in self.bags])
        self.known = np.array(sorted(self.weight), dtype=np.uint64)
        # a bit table that tells most shingles of documents from those of items
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.known >> np.uint64(44)).astype(np.int64)] = True
        self.groups = {int(n): np.nonzero(self.length == n)[0] for n in np.unique(self.length)}
        self.least = {n: float(self.mass[g].min()) for n, g in self.groups.items()}
        # lengths of the items that hold a shingle
        self.lengths: dict[int, set[int]] = {}
        for i, o in enumerate(own):
            for x in set(o.tolist()):
                self.lengths.setdefault(x, set()).add(int(self.length[i]))
        self.prints = np.array([self.fingerprints(o, 1, len(o))[0] for o in own], np.uint64)
        edges = [round(b * 64 / (radius + 1)) for b in range(radius + 2)] if radius < 63 else list(range(65))
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in itertools.pairwise(edges)]
        # of each length and block, items in the order of their block, and their blocks
        self.index: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, g in self.groups.items():
            if len(g) > SCAN:
                parts = [(self.prints[g] >> at) & mask for at, mask in self.blocks]
                self.index[n] = [(g[by := np.argsort(x, kind="stable")], x[by]) for x in parts]

    def weights_of(self, s: np.ndarray) -> np.ndarray:
        return np.array([self.weight.get(x, self.rest) for x in s.tolist()])

    def fingerprints(self, s: np.ndarray, windows: int, per: int) -> np.ndarray:
        """SimHash of each window of `per` shingles: bits that more weight has than has not."""
        bits = np.unpackbits(s.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float64) * 2 - 1
        sums = np.concatenate([np.zeros((1, 64)), np.cumsum(bits * self.weights_of(s)[:, None], axis=0)])
        return np.packbits(sums[per : per + windows] - sums[:windows] > 1e-9, axis=1).view(">u8").ravel().astype(np.uint64)

    def near(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) places of all fingerprints of windows and of items of n words within the radius."""
        g = self.groups[n]
        if n not in self.index:
            w, i = np.nonzero(np.bitwise_count(prints[:, None] ^ self.prints[g][None, :]) <= self.radius)
            return w, g[i]
        pairs = []
        for (at, mask), (items, values) in zip(self.blocks, self.index[n], strict=True):
            wanted = (prints >> at) & mask
            lo, hi = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            w = np.repeat(np.arange(len(prints)), hi - lo)
            i = items[spread(lo, hi - lo, np.arange(len(prints)))]
            close = np.bitwise_count(prints[w] ^ self.prints[i]) <= self.radius
            pairs.append(w[close] * len(self.prints) + i[close])
        found = np.unique(np.concatenate(pairs))
        return found // len(self.prints), found % len(self.prints)

    def verify(self, bag: Counter, item: int) -> float:
        """Weighted Jaccard similarity of the shingle multisets."""
        both = total = 0.0
        for s in bag.keys() | self.bags[item].keys():
            a, b, w = bag.get(s, 0), self.bags[item].get(s, 0), self.weight.get(s, self.rest)
            both, total = both + w * min(a, b), total + w * max(a, b)
        return both / total if total else 0.0

    def hits(self, h: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of the best window of a document, the first among equals."""
        found: dict[int, tuple[float, int, int]] = {}
        # item length -> places and weights of the shingles that items of that length hold
        places: dict[int, list[tuple[int, float]]] = {}
        shingles = {k: shingle_hashes(h, k) for k in {min(self.shingle, n) for n in self.groups}}
        for k, s in shingles.items():
            for at in np.nonzero(self.table[(s >> np.uint64(44)).astype(np.int64)])[0].tolist():
                x = int(s[at])
                for n in self.lengths.get(x, ()):
                    if min(self.shingle, n) == k:
                        places.setdefault(n, []).append((at, self.weight[x]))
        for n, held in places.items():
            k = min(self.shingle, n)
            width = min(n, len(h))  # a document shorter than the item is one window
            per = width - k + 1  # shingles of a window
            first, weights = _reach([at for at, _ in held], [w for _, w in held], per, len(h) - width)
            passed = np.nonzero(weights >= self.similarity * self.least[n] - 1e-9)[0] + first
            # runs of windows that passed share the sums of their bits
            for run in np.split(passed, np.nonzero(np.diff(passed) > per)[0] + 1):
                for at in range(0, len(run), WINDOWS):
                    some = run[at : at + WINDOWS]
                    if len(some):
                        self._verify_near(found, shingles[k], some, n, per, width, weights[some - first])
        return found

    def _verify_near(self, found: dict, s: np.ndarray, some: np.ndarray, n: int, per: int, width: int, weights: np.ndarray) -> None:
        """Put the similar items of windows that begin at `some` into `found`."""
        low, high = int(some[0]), int(some[-1])
        prints = self.fingerprints(s[low : high + per], high - low + 1, per)[some - low]
        window, item = self.near(prints, n)
        heavy = weights[window] >= self.similarity * self.mass[item] - 1e-9
        bags: dict[int, Counter] = {}
        for w, i in sorted(zip(window[heavy].tolist(), item[heavy].tolist(), strict=True)):
            best = found.get(i, (0.0, 0, 0))[0]
            if weights[w] + 1e-9 < best * self.mass[i] or best == 1.0:  # cannot be better than the best so far
                continue
            at = int(some[w])
            if w not in bags:
                bags[w] = Counter(s[at : at + per].tolist())
            sim = self.verify(bags[w], i)
            if sim >= self.similarity - 1e-9 and sim > best:
                found[i] = (sim, at, width)


def _reach(at: list[int], weights: list[float], per: int, last: int) -> tuple[int, np.ndarray]:
    """(first window, weight in it and in each after it): windows of `per` places, the last begins at `last`.

    `at` ascends; windows before the first and after the last that hold a place are left out.
    """
    first, end = max(0, at[0] - per + 1), min(last, at[-1])
    worth = np.zeros(end - first + per)
    worth[np.array(at) - first] = weights
    sums = np.concatenate([[0.0], np.cumsum(worth)])
    return first, sums[per:] - sums[:-per]


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with a word, in blocks of bounded size; streamed, one block on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        words = [w.decode() for w in r["text"].encode().lower().split()]
        if words:
            block.append((r["item_id"], words))
            size += len(words)
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _run(index: Items, columns: int, text_at: int, id_at: int | None):
    """Arrow function: with id_at, rows of (doc_id, item_id, similarity, start, n_words); else the clean rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, counts = split_words(b.column(text_at), lower=True)
            h = word_hashes(words.dictionary.to_pylist())[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
            at = np.concatenate([[0], np.cumsum(counts)])
            found = [index.hits(h[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if id_at is None:
                yield b.filter(pa.array([not f for f in found], pa.bool_()))
                continue
            ids = b.column(id_at).to_pylist()
            rows = [(ids[r], index.ids[i], *x) for r, f in enumerate(found) for i, x in sorted(f.items())]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (b.column(id_at).type, pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "start", "n_words"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """(doc_id, item_id, similarity, start, n_words): the best window of each document for each item it holds.

    Words are lower-cased (A-Z) runs without ASCII white space; an item of fewer words than `shingle` is one
    shingle. A document of fewer words than an item is one window for it. Null and empty items match
    nothing, null and empty texts hold nothing. Repeated rows and
    repeated items each give their own rows. Any size of benchmark is searched, in blocks that fit a task.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, similarity double, start long, n_words long"
    small_batches(docs.sparkSession)
    out = None
    for block in _blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(_run(Items(block, shingle, similarity, radius), 2, 1, 0), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 22) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns."""
    small_batches(docs.sparkSession)
    for block in _blocks(benchmark):
        docs = docs.mapInArrow(_run(Items(block, shingle, similarity, radius), len(docs.columns), docs.columns.index("text"), None), docs.schema)
    return docs
