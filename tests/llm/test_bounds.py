"""Bounds that hold with repeated rows, columns whose names clash, and texts without words."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, mixing, neardup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_score", "_lang_pred", "_mix_copy", "_mix_copies", "_mix_source", "_neardup_i", "_neardup_0", "_simhash_fp", "_simhash_i", "_s", "copies", "limit", "hash", "size", "component", "cid")


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["lo", "mi", "ra"] if i % 2 else ["krz", "wyk", "ost"], k=rng.randint(8, 30))), "aa" if i % 2 else "bb", "s", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1] + " lo", rows[i][2], None, 0) for i in range(5)] + [(300, None, None, None, None), (None, "krz wyk", "bb", "s", 0), (301, "", "aa", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        df = df.withColumn(c.strip("`"), F.lit("mine"))
    return df


@pytest.mark.parametrize("stage", [langid.keep_known, mixing.mix, neardup.dedup, simhash.dedup])
def test_columns_that_clash_stay_as_they_are(clashing, stage):
    out = stage(clashing)
    assert out.columns == clashing.columns
    rows = out.collect()
    assert len(rows) > 10 and all(r[c.strip("`")] == "mine" for r in rows for c in CLASHES)


def test_a_row_that_is_repeated_5000_times_is_one_of_the_sample(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(20)), ("aa", "bb")[i % 2], "s", 0) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS).union(spark.createDataFrame([rows[7]], DOCS).crossJoin(spark.range(5000)).drop("id"))
    texts, languages = langid.sampled(docs)
    assert len(texts) <= 600 and len(set(texts)) == len(texts) and languages.count("aa") <= 300 and languages.count("bb") > 250
    texts, languages = langid.sampled(docs, most_docs=50)
    assert len(texts) <= 50 and set(languages) == {"aa", "bb"}


def test_the_most_frequent_languages_are_counted_before_they_are_capped(spark):
    rows = [(i, f"text of number {i}", "zz" if i % 3 else f"l{i % 20:02d}", "s", 0) for i in range(3000)]
    _, languages = langid.sampled(spark.createDataFrame(rows, DOCS), per_language=5, most_languages=2)
    assert "zz" in languages and len(set(languages)) == 2 and len(languages) <= 10


def test_letters_of_other_scripts_are_told_apart():
    assert len(set(langid.grams("漢字").tolist())) > len(set(langid.grams("漢漢").tolist()))
    greek, cyrillic = set(langid.grams("αβγδεζηθικλμνξοπρστυφχψω").tolist()), set(langid.grams("абвгдежзиклмнопрстуфхцчш").tolist())
    assert len(greek & cyrillic) <= 2 and len(langid.grams("12 !?")) == 0
    assert sorted(langid.grams("ab, cd").tolist()) == sorted(langid.grams("AB -- CD").tolist())


def test_texts_without_words_are_not_taken_more_often_than_the_cap(spark):
    # one large source that cannot take its share, so the other's target is twice its size
    rows = [(i, "w " * 50 if i >= 400 else ("", None, " \n")[i % 3], "en", "small", 0) for i in range(500)] + [(1000 + i, "w " * 500, "en", "big", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.copies(docs, weights=(1, 50)).collect()
    assert max(r["copies"] for r in got) <= 2 and {r["copies"] for r in got if r.target == 2 * r.source_size} == {2}
    assert mixing.mix(docs, weights=(1, 50)).count() == sum(r["copies"] for r in got)
    assert all(n <= 2 for (n,) in mixing.mix(docs, weights=(1, 50)).groupBy("doc_id").count().select("count").collect())


def test_targets_do_not_depend_on_the_ranges_of_sources(spark, monkeypatch):
    rng = random.Random(3)
    sizes = [(f"s{i:03d}" if i % 7 else f"Ä{i}", rng.randrange(1, 10_000)) for i in range(150)] + [(None, 77), ("", 12), ("zero", 0)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s, _ in sizes if s is not None), key=lambda s: s.encode()) + [None])}
    # by definition: raise the level until the capped stay the same
    total, level, capped = sum(n for _, n in sizes) * 1.5, 0.0, set()
    while True:
        level = (total - sum(2 * n for s, n in sizes if s in capped)) / sum(weight[s] for s, _ in sizes if s not in capped)
        now = {s for s, n in sizes if 2 * n <= weight[s] * level}
        if now == capped:
            break
        capped = now
    want = {s: 2.0 * n if s in capped else weight[s] * level for s, n in sizes}
    for size in (100_000, 20):
        monkeypatch.setattr(mixing, "RANGE", size)
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(want)
    assert mixing.source_targets(df, share=3.0).agg(F.sum("target")).first()[0] == 2 * sum(n for _, n in sizes)
