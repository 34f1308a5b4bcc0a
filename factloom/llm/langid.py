"""Language ID with a blended-spectrum string kernel.

Two texts are as alike as the share of character n-grams (n = 1, 2, 3) that both have: the presence kernel
|A & B| / sqrt(|A| |B|). Nyström landmarks turn it into features of bounded size, and one-versus-rest
kernel ridge regression gives a score for each language. A batch of texts is scored by one matrix product:
the presence of the landmarks' n-grams times a folded weight matrix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, free, small_batches
from .tokens import spread

#: N-grams of lower-case letters are hashed to so many places; two of a text share one with a chance of n / SPACE.
SPACE = 1 << 20
_BOUNDARY = 1  # all that is no letter; no letter has this code point
_ODD = np.uint64(0x9E3779B97F4A7C15)
_tables: list[np.ndarray] = []


def lower_letters() -> np.ndarray:
    """Of every code point, that of its lower-case letter, or _BOUNDARY; built once a process."""
    if not _tables:
        table = np.full(0x110000, _BOUNDARY, np.uint64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                table[c] = ord(ch.lower()[0])
        _tables.append(table)
    return _tables[0]


def grams(text: str) -> np.ndarray:
    """Places of the 1-, 2- and 3-grams of a whole text, with repeats; empty without letters."""
    a = lower_letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = a != _BOUNDARY
    if not letter.any():
        return np.zeros(0, np.uint32)
    edge = np.full(1, _BOUNDARY, np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary for a run of them
    a = np.concatenate([edge, a[keep], edge])
    pairs = (a[:-1] << np.uint64(21)) | a[1:]
    exact = np.concatenate([a, pairs, (pairs[:-1] << np.uint64(21)) | a[2:]])
    exact ^= exact >> np.uint64(29)
    return ((exact * _ODD) >> np.uint64(44)).astype(np.uint32)


#: Cells of the presence matrix of a batch.
CELLS = 4_000_000


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # places of the landmarks' n-grams
    weights: np.ndarray  # vocabulary x languages

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Predicted language, score in [0, 1] and number of n-grams; `und`, 0 and 0 for null texts and texts
        without letters. A batch is one product of the presence of n-grams with the weights."""
        names, tops, sizes = [], [np.zeros(0)], [np.zeros(0, np.int64)]
        step = max(1, CELLS // max(1, len(self.vocabulary)))
        for at in range(0, len(texts), step):
            some = self._batch(texts[at : at + step])
            names += some[0]
            tops.append(some[1])
            sizes.append(some[2])
        return names, np.concatenate(tops), np.concatenate(sizes)

    def _batch(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        rows = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        size = np.zeros(len(texts), np.int64)
        seen = np.zeros(SPACE, np.uint8)
        for i, t in enumerate(texts):
            g = grams(t) if t else ()
            if len(g):
                seen[g] = 1
                rows[i], size[i] = seen[self.vocabulary], np.count_nonzero(seen)
                seen[g] = 0
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), size
        scores = (rows @ self.weights) / np.sqrt(np.maximum(size, 1))[:, None]
        best = scores.argmax(1)
        top = np.where(size == 0, 0.0, np.clip((1 + scores.max(1)) / 2, 0, 1)).astype(np.float64)
        return [("und" if not n else self.languages[k]) for n, k in zip(size, best, strict=True)], top, size


def fit(texts: list[str], languages: list[str], *, landmarks: int = 64, most_landmarks: int = 1024, ridge: float = 1e-3) -> Model:
    """`landmarks` texts of each language, but `most_landmarks` of all, span the Nyström features."""
    kept = [(g, lang) for t, lang in zip(texts, languages, strict=True) if len(g := np.unique(grams(t)))]
    names = sorted({lang for _, lang in kept})
    if not names:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32))
    each = max(1, min(landmarks, most_landmarks // len(names)))
    chosen = [g for name in names for g in [g for g, lang in kept if lang == name][:each]]
    m = len(chosen)
    # postings: which landmarks hold an n-gram
    joined, owner = np.concatenate(chosen), np.repeat(np.arange(m), [len(g) for g in chosen])
    order = np.argsort(joined, kind="stable")
    vocabulary, number = np.unique(joined, return_counts=True)
    holders, first = owner[order], np.cumsum(number) - number
    root_size = np.sqrt([len(g) for g in chosen])

    def kernel(g: np.ndarray) -> np.ndarray:
        """|A & B| / sqrt(|A| |B|) with every landmark."""
        at = np.searchsorted(vocabulary, g)
        at = at[(at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == g)]
        return np.bincount(holders[spread(first, number, at)], minlength=m) / (math.sqrt(len(g)) * root_size)

    values, vectors = np.linalg.eigh(np.stack([kernel(g) for g in chosen]))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # K_mm^(-1/2) on its range
    features = np.stack([kernel(g) for g, _ in kept]) @ root
    target = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in kept])
    ridge_weights = np.linalg.solve(features.T @ features + ridge * len(kept) * np.eye(features.shape[1]), features.T @ target)
    of_mark = (root @ ridge_weights) / root_size[:, None]
    weights = np.add.reduceat(of_mark[holders], first, axis=0)
    return Model(names, vocabulary.astype(np.int64), weights.astype(np.float32))


def recognised(texts: list[str], languages: list[str], **how) -> np.ndarray:
    """The least score of a text in a learned language, by the power of two of its number of n-grams.

    A model of four fifths of the sample scores runs of 1, 2, 4, ... words and the whole of the other texts. Where
    the 0.5 % quantile of the scores of a size is no more than 0.5, the score of a text that no language's
    output speaks for, texts are too short to tell, and none go. For all sizes above, the limit lies midway between
    0.5 and the least of their quantiles.
    """
    held = set(range(0, len(texts), 5))
    model = fit([t for i, t in enumerate(texts) if i not in held], [x for i, x in enumerate(languages) if i not in held], **how)
    pieces = []
    for i in sorted(held):
        words = texts[i].split()
        pieces.append(texts[i])
        size = 1
        while size < len(words):
            pieces += [" ".join(words[a : a + size]) for a in (0, (len(words) - size) // 2, len(words) - size)]
            size *= 2
    _, scores, sizes = model.score(pieces)
    classes = size_class(sizes)
    lows = {c: float(np.quantile(some, 0.005)) for c in range(SIZES) if len(some := scores[(classes == c) & (sizes > 0)]) >= 20}
    told = [c for c, low in lows.items() if low > 0.5 and all(lows[d] > 0.5 for d in lows if d > c)]
    limits = np.zeros(SIZES)
    if told:
        limits[min(told) :] = (0.5 + min(lows[c] for c in told)) / 2
    elif not lows:
        limits[:] = 0.5
    return limits


SIZES = 21


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(sizes, 1)).astype(np.int64)


def sampled(docs: DataFrame, *, mod: int = 5, per_language: int = 300, most_docs: int = 4000, most_languages: int = 200, longest: int = 20_000) -> tuple[list[str], list[str]]:
    """(texts, languages) of labelled documents whose crc32(doc_id as text) mod `mod` is not 0.

    The sample is bounded by documented parameters: the `most_languages` languages with the most documents (all
    are counted, approximately where a doc_id repeats), of each up to `per_language` documents, but `most_docs` in all, of
    at most `longest` characters each. Documents are chosen by a hash of doc_id; equal rows are one. Rows with a
    null doc_id, text or lang are not learned from.
    """
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (bucket_of(F.col("doc_id"), mod) != 0) & (F.length("text") <= longest)).select("doc_id", "lang", "text")
    common = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not common:
        return [], []
    each = max(1, min(per_language, most_docs // len(common)))
    # a hash below a language's limit is that of about 2 * each of its documents
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    limit_of = F.create_map(*[F.lit(x) for r in common for x in (r["lang"], int(min(1.0, (2 * each + 30) / max(1, r["n"])) * (1 << 32)))])
    some = rows.where(low < limit_of[F.col("lang")])
    one = some.groupBy("lang", "doc_id", F.xxhash64("text").alias("t")).agg(F.min("text").alias("text"))
    ranked = one.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t"))).where(F.col("r") <= each)
    sample = ranked.select("doc_id", "lang", "text").collect()
    sample.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    # a fixed shuffle, so that landmarks do not follow doc_id
    order = np.random.default_rng(0).permutation(len(sample))
    return [sample[i]["text"] for i in order], [sample[i]["lang"] for i in order]


def learn(docs: DataFrame, *, mod: int = 5, sample: dict | None = None, **how) -> Model:
    """Fit on the sample of `sampled` (whose parameters `sample` holds)."""
    return fit(*sampled(docs, mod=mod, **(sample or {})), **how)


def predicted(docs: DataFrame, model: Model, least: np.ndarray | float = 0.0) -> tuple[DataFrame, str, str, str]:
    """All columns of `docs`, then the predicted language, its score, and whether that is `least` (of its size) or
    more; and the names of these columns."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    lang, score, known = free(docs, "_lang_pred", "_score", "_known")
    limits = np.broadcast_to(np.asarray(least, np.float64), SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                names, scores, sizes = model.score(part.column(at).to_pylist())
                enough = (sizes > 0) & (scores >= limits[size_class(sizes)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(enough)], names=[*part.schema.names, lang, score, known])

    schema = T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField(known, T.BooleanType())])
    return docs.mapInArrow(run, schema), lang, score, known


def identify(docs: DataFrame, *, mod: int = 5, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document (doc_id, text, lang); other columns are ignored.

    Null doc_ids are not held out and not learned from. Without labelled documents all are `und`.
    """
    model = learn(docs, mod=mod, **how)
    scored, lang, score, _ = predicted(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(bucket_of(F.col("doc_id"), mod) == 0, F.lit(False)).alias("held_out"), F.col(lang).alias("lang_pred"), F.col(score).alias("score"))


def keep_known(docs: DataFrame, *, least: float | None = None, sample: dict | None = None, **how) -> DataFrame:
    """The rows of `docs` whose language is recognised with a score of `least` or more (default: that of
    `recognised` for a text of its size), with all their columns. Texts without letters go."""
    seen = sampled(docs, **(sample or {}))
    if least is None:
        least = recognised(*seen, **how)
    scored, lang, _, known = predicted(docs, fit(*seen, **how), least)
    return scored.where((F.col(lang) != "und") & F.col(known)).select(*[F.col(f"`{c}`") for c in docs.columns])
