"""Quality rules as a learned decision list.

Whole-text measures are computed with array functions inside each row (no shuffle). Sequential covering
then grows and prunes conjunctions of threshold tests from labelled statistics: each step reads one
histogram (fold, measure, bin, label) of bounded size, so all labelled rows count and only
measures x bins numbers reach the driver. The list is emitted as one ordered CASE expression. Only
DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words_of

SYMBOLS = "#*$%&|<>"
#: Measures on which rules may test, as ratios of the base measures.
MEASURES = ("symbol_ratio", "mean_word", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "n_words")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text, the first included."""
    n = F.size(words)
    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.greatest(n - 2, F.lit(0)))

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            m = F.size(s)
            twin = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get(s, i + 1)["h"] == x["h"])))
            at = F.sort_array(F.transform(twin, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
            step = lambda a, i: F.struct((i + 3).alias("end"), (a["sum"] + i + 3 - F.greatest(a["end"], i)).alias("sum"))
            return F.aggregate(at, start, step, lambda a: a["sum"])

        # most texts repeat no window: a hash set tells, and only the others are sorted
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(by_hash, count))

    return F.when(n < 3, F.lit(0)).otherwise(let(windows, covered))


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures of rules.

    Null and empty texts have no words and fail the base rules. Whole texts are measured.
    """
    text = F.coalesce("text", F.lit(""))
    kept = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]+", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeated(w).cast("long").alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    d = docs.select("doc_id", by_words.alias("w"), by_lines.alias("l"), kept("#*$%&|<>").cast("long").alias("n_symbols"), kept("A-Z").alias("upper"), kept("!?").alias("marks"), kept("0-9").alias("digits"), *carry)
    d = d.select("doc_id", "w.*", "l.*", "n_symbols", "upper", "marks", "digits", *carry)
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.struct(
            share("n_symbols", "word_chars").alias("symbol_ratio"), share("word_chars", "n_words").alias("mean_word"), share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
            share("n_repeat_words", "n_words").alias("repeat_ratio"), share("upper", "word_chars").alias("upper_ratio"), share("marks", "word_chars").alias("mark_ratio"),
            share("digits", "word_chars").alias("digit_ratio"), F.col("n_words").cast("double").alias("n_words"),
        ).alias("m"), *carry,
    )


@dataclass
class Rule:
    """Reject where every (measure, `>` or `<=`, threshold) holds."""

    tests: list[tuple[str, str, float]]
    caught: int = 0
    wrong: int = 0

    def column(self, of=lambda m: F.col("m")[m]) -> Column:
        out = F.lit(True)
        for m, op, t in self.tests:
            out = out & ((of(m) > t) if op == ">" else (of(m) <= t))
        return out


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        """Ordered CASE: the number of the first rule that fires (from 1), 0 if none."""
        out = F.lit(0)
        for i, r in reversed(list(enumerate(self.rules, 1))):
            out = F.when(r.column(), F.lit(i)).otherwise(out)
        return out


@dataclass
class Histogram:
    """(good, bad) rows by (fold, number of the measure) and bin."""

    table: dict

    def total(self, fold: int) -> tuple[int, int]:
        of = self.table.get((fold, 0), {}).values()
        return sum(v[0] for v in of), sum(v[1] for v in of)

    def tests(self, measures, cuts) -> Iterator[tuple]:
        """(FOIL gain, test, good, bad) of each test on the grow rows that catches bad ones and gains."""
        good, bad = self.total(0)
        for i, m in enumerate(measures):
            bins, below = self.table.get((0, i), {}), [0, 0]
            for c, threshold in enumerate(cuts[m]):
                for k in (0, 1):  # bins up to c hold the values up to the threshold
                    below[k] += bins.get(c, [0, 0])[k]
                for op, (g, b) in (("<=", below), (">", [good - below[0], bad - below[1]])):
                    gain = b * (math.log2((b + 1) / (b + g + 2)) - math.log2((bad + 1) / (bad + good + 2)))
                    if gain > 1e-6:
                        yield gain, (m, op, threshold), g, b

    def gains(self, measures, cuts) -> list[tuple]:
        return [t[:2] for t in self.tests(measures, cuts)]

    def seeds(self, measures, cuts, precision: float, failed: set) -> list[tuple]:
        """(gain, seed, test): for each measure and direction the most gainful test, and the most gainful precise one, of those that have not failed."""
        best: dict = {}
        for gain, test, g, b in self.tests(measures, cuts):
            for kind in ("any", "precise") if (b + 1) / (b + g + 2) >= precision else ("any",):
                seed = (*test[:2], kind)
                if failed.isdisjoint((seed, test)) and (seed not in best or gain > best[seed][0] + 1e-9):
                    best[seed] = (gain, seed, test)
        return list(best.values())


def learn(labelled: DataFrame, *, measures=MEASURES, bins: int = 32, precision: float = 0.9, least: float = 0.002, max_tests: int = 3) -> DecisionList:
    """A list of reject rules from `labelled` (m: struct of measures, bad: boolean, fold: 0 grow, 1 prune).

    Rules are grown on two thirds of the rows by FOIL gain and pruned on the rest; a rule stays if its
    smoothed precision on the prune rows is at least `precision` and it catches `least` of the bad rows.
    A rule that does not stay excludes its first test and its seed (measure, direction, and whether the threshold was
    the most gainful of all or of the precise ones), and covering goes on until no seed is left, so at most 4 x measures rules fail.
    Thresholds are quantiles (approx_percentile, relative error 1e-4) of each measure over the bad and
    over the good rows. Without bad or good rows the list is empty.
    """
    quantiles = [i / bins for i in range(1, bins)]
    per_label = labelled.groupBy("bad").agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("m")[m], quantiles, 10_000).alias(m) for m in measures]).collect()
    if {r["bad"] for r in per_label} != {True, False}:
        return DecisionList()
    cuts = {m: sorted({float(x) for r in per_label for x in r[m]}) for m in measures}
    enough = max(2, least * next(r["n"] for r in per_label if r["bad"]) / 3)

    def code(m: str) -> Column:
        """The number of cuts below the value: values up to the first cut have code 0."""
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[m]]), lambda c: F.col("m")[m] > c))

    codes = F.array(*[code(m) for m in measures])
    left = cut(labelled.select("bad", "fold", codes.alias("codes")))
    at = {m: i for i, m in enumerate(measures)}
    code_test = lambda t: (F.col("codes")[at[t[0]]] > cuts[t[0]].index(t[2])) if t[1] == ">" else (F.col("codes")[at[t[0]]] <= cuts[t[0]].index(t[2]))

    def counts(df: DataFrame) -> Histogram:
        """Numbers of (good, bad) rows by fold, and by fold, measure and bin."""
        out: dict = {}
        for r in df.select("bad", "fold", F.posexplode("codes").alias("m", "c")).groupBy("fold", "m", "c", "bad").count().collect():
            out.setdefault((r["fold"], r["m"]), {}).setdefault(r["c"], [0, 0])[int(r["bad"])] += r["count"]
        return Histogram(out)

    found: list[Rule] = []
    failed: set[tuple] = set()
    top = None
    while True:
        top = top or counts(left)
        seeds = top.seeds(measures, cuts, precision, failed)
        if not seeds:
            return DecisionList(found)
        _, seed, test = max(seeds, key=lambda s: round(s[0], 9))  # the first of equals
        tests, rows, trail = [test], left.where(code_test(test)), []
        while True:
            table = counts(rows)
            trail.append(table.total(1))
            good, bad = table.total(0)
            best = max(table.gains(measures, cuts), key=lambda g: round(g[0], 9), default=None)
            if not good or not bad or len(tests) == max_tests or best is None:
                break
            tests.append(best[1])
            rows = rows.where(code_test(best[1]))
        # prune: the shortest leading part with the best smoothed precision on rows that did not grow it
        scores = [(b + 1) / (b + g + 2) for g, b in trail]
        keep = max(range(len(scores)), key=lambda i: (round(scores[i], 3), -i))
        wrong, caught = trail[keep]
        if scores[keep] < precision or caught < enough:
            failed.update((seed, test))
            continue
        found.append(Rule(tests[: keep + 1], caught, wrong))
        fire = F.lit(True)
        for t in tests[: keep + 1]:
            fire = fire & code_test(t)
        left, top = left.where(~fire), None


def judge(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The measures of every document, base_failed, rule (number of the reject rule that fired, 0: none) and kept.

    `labels` (doc_id, quality: 0 is bad) covers some documents; null qualities and doc_ids are left out,
    several labels of one document count each. A document that fails the base rules is not kept,
    whatever the list says. With no labels, only the base rules reject.
    """
    rows = cut(measured(docs))
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    # rows that the base rules reject need no learned rule
    labelled = rows.where(~F.col("base_failed")).join(marks, "doc_id").select("m", "bad", F.when(F.crc32(F.concat(F.lit("fold:"), F.col("doc_id").cast("string")).cast("binary")) % 3 == 0, 1).otherwise(0).alias("fold"))
    rules = learn(cut(labelled), **how)
    return rows.withColumn("rule", rules.verdict()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
