"""The randomness battery against a second version in plain Python, and its power on planted tokens."""

import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import secrets

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {"hex": DIGITS + "abcdef", "hex_upper": DIGITS + "ABCDEF", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base62": DIGITS + UPPER + LOWER, "base64": UPPER + LOWER + DIGITS + "+/-_"}


def phi(z):
    return 0.5 * math.erfc(-max(-8, min(8, z)) / math.sqrt(2))


def battery(token):
    """(encoding, chi_p, runs_p, serial_p, text_p, uniform_p) by definition, with the exact normal distribution."""
    name = next(n for n, a in ALPHABETS.items() if set(token) <= set(a))
    abc, n = ALPHABETS[name], len(token)
    k = len(abc)
    chi = sum((token.count(c) - n / k) ** 2 / (n / k) for c in abc)
    z_chi = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    x = [abc.index(c) + 1 for c in token]
    side = [v > (k + 1) / 2 for v in x]
    above, below, runs = sum(side), n - sum(side), 1 + sum(a != b for a, b in zip(side, side[1:], strict=False))
    expect = 2 * above * below / n + 1
    z_runs = (runs - expect) / math.sqrt(max((expect - 1) * (expect - 2) / (n - 1), 1e-9)) if above * below else 8.0
    mean = sum(x) / n
    xx = sum((v - mean) ** 2 for v in x)
    r = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / xx if xx else 8.0 / math.sqrt(n)
    two = lambda z: 2 * (1 - phi(abs(z)))
    uniform = min(1.0, 3 * min(two(z_chi), two(z_runs), two(r * math.sqrt(n))))
    shift = (n - 1) * max(k * 0.07 - 1, 0.05)
    kind = lambda c: "d" if c in DIGITS else "u" if c in UPPER else "l" if c in LOWER else "s"
    switches = sum(kind(a) != kind(b) for a, b in zip(token, token[1:], strict=False))
    ps = (phi((chi - (k - 1) - shift) / math.sqrt(2 * (k - 1) + 4 * shift)), phi(((n - 1) * 0.25 + 0.5 - switches) / math.sqrt((n - 1) * 0.1875)), phi((abs(r) - 0.25) * math.sqrt(n)))
    a = -sum(math.log(max(p, 1e-300)) for p in ps)
    return name, *ps, min(1.0, math.exp(-a) * (1 + a + a * a / 2)), uniform


def tokens():
    rng = random.Random(11)
    out = [("".join(rng.choices(a, k=rng.randint(20, 100)))) for a in ALPHABETS.values() for _ in range(12)]
    out += ["internationalizationandlocalization", "getElementByIdAndClassNameOrNull", "path/to/some/file-name_with-parts", "A" * 25, "20240101123000000000", "abababababababababababab", "aaaaaaaaaaaabbbbbbbbbbbb"]
    return out


def test_the_battery_by_definition(spark):
    some = tokens()
    df = spark.createDataFrame([(t,) for t in some], "t string").select("t", secrets.battery(F.col("t")).alias("b")).select("t", "b.*")
    for r in df.collect():
        want = battery(r["t"])
        assert r["encoding"] == want[0] and r["n"] == len(r["t"])
        for name, w in zip(("chi_p", "runs_p", "serial_p", "uniform_p"), want[1:4] + want[5:], strict=True):
            assert r[name] == pytest.approx(w, abs=2e-3), (r["t"], name)
        # the approximation of the normal distribution is good to 2e-4; in the far tail to a factor
        assert math.log10(max(r["text_p"], 1e-30)) == pytest.approx(math.log10(max(want[4], 1e-30)), rel=0.4, abs=0.35), r["t"]


def test_the_rule_by_definition(spark):
    """Discoveries are those of Benjamini and Hochberg over bins of a tenth of log10 p, in each class of lengths."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices(["tion", "inter", "gesell", "schaft", "able", "ment", "ing", "ou"], k=6))[:40]
    texts = [rng.choice([t, word() + "zz" * 5]) for t in tokens() * 4]
    docs = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [x for x in r.spans if x.kind == "random"] for r in secrets.scan(docs).collect()}
    chances = {r["i"]: r["b"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", secrets.battery(F.col("t")).alias("b")).collect()}
    free = {i for i, t in enumerate(texts) if not (set(t) <= set(ALPHABETS["hex"]) and len(t) >= 24) and not any(len(p) >= 24 for p in __import__("re").findall("[0-9a-f]+", t))}
    place = lambda p: min(math.floor(-10 * math.log10(max(p, 1e-30))), 200)
    for cls in {len(texts[i]).bit_length() for i in free}:
        mine = [i for i in free if len(texts[i]).bit_length() == cls]
        bins = sorted({place(chances[i]["text_p"]) for i in mine})
        good = [b for b in bins if 10 ** (-b / 10) * len(mine) <= 0.01 * sum(place(chances[i]["text_p"]) >= b for i in mine)]
        for i in mine:
            want = bool(good) and place(chances[i]["text_p"]) >= min(good) and chances[i]["uniform_p"] >= 0.03
            assert bool(found[i]) == want, texts[i]


def test_random_tokens_of_each_encoding_are_found_among_text(spark):
    rng = random.Random(13)
    planted = [(name, "".join(rng.choices(abc, k=n))) for name, abc in ALPHABETS.items() if name != "hex" for n in (32, 40, 48, 64) for _ in range(10)]
    words = ["internationalization-and-localization", "donaudampfschifffahrtsgesellschaft", "getElementByIdAndClassName", "some/path/to/another/file-name", "THISISALLINCAPITALLETTERS", "snake_case_identifier_of_code", "how-to-read-a-book-in-2024"]
    rows = [(i, f"a {t} b") for i, (_, t) in enumerate(planted)] + [(1000 + i, f"a {rng.choice(words)} b") for i in range(200)]
    got = {r.doc_id: any(x.kind == "random" for x in r.spans) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = lambda name: sum(got[i] for i, (e, _) in enumerate(planted) if e == name) / 40
    assert share("base64") > 0.9 and share("base62") > 0.9 and share("base36") > 0.85 and share("base32") > 0.7 and share("hex_upper") > 0.5
    assert not any(v for i, v in got.items() if i >= 1000)
