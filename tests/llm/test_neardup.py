"""Near duplicates by verified similarity against all pairs."""

import collections
import random

import numpy as np

from factloom.llm import neardup, simhash

FIELDS = ("doc_id", "text", "lang", "source", "n_chars")
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def groups_of(sets):
    group = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if group[i] < group[j] and similar(a, b):
                    group[j], changed = group[i], True
    return group


def odd_and_near(spark, odd_docs):
    rng = random.Random(5)
    rows = []
    for i in range(60):  # pairs from alike to unlike, some texts with a passage of others
        words = [f"v{rng.randrange(3000)}" for _ in range(rng.choice((6, 20, 90, 300)))]
        if i % 3 == 0:
            words[2:2] = [f"passage{j}" for j in range(60)]
        other = [w if rng.random() > (0.005, 0.01, 0.02, 0.03, 0.06)[i % 5] else "changed" for w in words]
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, "  ".join(other).upper())]
    # a chain of near copies whose ends are unlike, and a group of near copies
    rows += [(2000 + i, " ".join(f"c{j}" for j in range(10 * i, 10 * i + 150))) for i in range(15)]
    rows += [(3000 + i, " ".join(f"w{j}" if j != 7 * i else "changed" for j in range(300))) for i in range(40)]
    near = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], EMPTY)
    return odd_docs.select(*FIELDS).unionByName(near)


def test_classes_and_dedup_brute_force(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    monkeypatch.setattr(neardup, "CHUNK", 8)
    docs = odd_and_near(spark, odd_docs)
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    group = groups_of([s for _, s in rows])
    least = collections.defaultdict(list)
    for (d, _), g in zip(rows, group, strict=True):
        least[g].append(d)
    want = sorted((str(d), str(min((x for x in least[g] if x is not None), default=None))) for (d, _), g in zip(rows, group, strict=True))
    assert 20 < len(least) < len(rows) - 60
    assert sorted((str(r.doc_id), str(r.component_id)) for r in neardup.classes(docs).collect()) == want
    monkeypatch.setattr(neardup, "BROADCAST_MEMBERS", 0)
    monkeypatch.setattr(simhash, "BROADCAST_SHARDS", 0)
    kept = neardup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(min((x for x in m if x is not None), default=None)) for m in least.values())


def test_extra_columns_and_empty_tables(spark, odd_docs):
    kept = neardup.dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    assert neardup.dedup(odd_docs.limit(0)).count() == 0 and neardup.classes(odd_docs.limit(0)).count() == 0


def test_exact_forest_spans_all_similar_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 30, replace=False), rng.integers(0, 2**63, int(rng.integers(0, 6))).astype(np.uint64)])) for _ in range(60)] + [np.zeros(0, np.uint64)] * 2
    us, vs = neardup.exact_forest(sets, 0.8)
    group = groups_of([frozenset(s.tolist()) for s in sets])
    label = list(range(len(sets)))
    for u, v in zip(us, vs, strict=True):
        old, new = label[u], label[v]
        label = [new if x == old else x for x in label]
    assert len(set(zip(label, group, strict=True))) == len(set(label)) == len(set(group))


def test_bands_and_radius_find_similar_sets():
    rng = np.random.default_rng(4)
    for n in (5, 9, 25, 100, 1000):
        bands = far = 0
        for _ in range(200):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.unique(np.concatenate([a[: n - n // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64)]))
            (p, k), (q, m) = neardup.sketch(np.unique(a)), neardup.sketch(b)
            bands += not any(x == y for x, y in zip(k, m, strict=True))
            far += sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(p, q, strict=True)) > 76
        assert bands == far == 0


def test_many_equal_fingerprints_in_a_cell():
    x = np.full((2048, 4), 7, np.uint64)
    x[:1000] ^= np.random.default_rng(1).integers(0, 2**62, (1000, 4)).astype(np.uint64)
    moved, to = simhash.forest(x, 30)
    assert moved.tolist() == list(range(1001, 2048)) and set(to.tolist()) == {1000}
