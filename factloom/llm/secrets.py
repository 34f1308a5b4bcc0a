"""Secret scans: three fixed patterns and a randomness test battery, as array expressions.

Spans are code points, end exclusive. Candidates of the battery are long runs of token characters. Each
gets an inferred encoding (its smallest alphabet) and, against a uniform draw from that alphabet, a
chi-squared test of the symbol counts, a runs test about the middle of the alphabet and a test of the lag-1
serial correlation. A discovery is made against the null "text in this alphabet", by all three: under it,
chi-squared grows with the length as symbols coincide more often, neighbours are more often of one kind (digits,
capitals, small letters, signs), and their places in the alphabet are correlated. Each test gives the chance that text of this length
looks as random; Fisher's method combines them. The Benjamini-Hochberg rule holds the false discovery rate
of the combined chance in every length class by a histogram, without sorting; discoveries must also be consistent
with uniform draws in all three.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Fixed patterns, in the order in which ties at one start are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: (name, characters a candidate may have, alphabet in order); the first that fits is taken.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("hex_upper", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("base62", "^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    ("base64", "", UPPER + LOWER + DIGITS + "+/-_"),
)
#: Chance that two symbols of ordinary text are alike (letters of European languages: 0.065 to 0.08).
TEXT_COINCIDENCE = 0.07
#: Chance that neighbours in text differ in kind, and the size of the lag-1 correlation of the places of its symbols.
TEXT_SWITCH, TEXT_SERIAL = 0.25, 0.25
KIND_RUNS = r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"
#: Bins of -log10 p in the histogram, each a tenth wide.
P_BINS = 200


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end>> of the leftmost non-overlapping matches whose group has `least` characters or more.

    The gaps between matches come from split, the matches from regexp_extract_all; a running sum of
    lengths gives the places.
    """
    matched = F.struct(
        F.split(text, pattern).alias("gaps"),
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("hits"),
        F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1)).alias("parts"),
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def place(m: Column) -> Column:
        rows = F.arrays_zip(m["gaps"].alias("g"), m["hits"].alias("h"), m["parts"].alias("p"))
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["g"])
            end = start + F.length(x["h"])
            out = F.when(F.length(x["p"]) >= least, F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(a["out"])
            return F.struct(F.coalesce(end, start).alias("at"), out.alias("out"))

        return F.aggregate(F.slice(rows, 1, F.greatest(F.size(m["hits"]), F.lit(0))), first, step, lambda a: a["out"])

    return let(matched, place)


def normal_cdf(z: Column) -> Column:
    """Phi(z) by a logistic of a cubic: within 2e-4 of it, monotonic."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(-1.5976 * z - 0.07056 * z * z * z))


def fisher(*p: Column) -> Column:
    """Combined chance of independent p-values; the chi-squared tail of 2k degrees of freedom has a closed form."""
    half = -sum(F.log(F.greatest(x, F.lit(1e-300))) for x in p)
    series, term = F.lit(1.0), F.lit(1.0)
    for i in range(1, len(p)):
        term = term * half / i
        series = series + term
    return F.least(F.lit(1.0), F.exp(-half) * series)


def battery(token: Column) -> Column:
    """struct<encoding, n, chi_p, runs_p, serial_p, text_p, uniform_p> of a candidate of 20 characters or more.

    chi_p, runs_p, serial_p: the chance that text of this length in this alphabet looks as random to each test;
    text_p: all three by Fisher's method; uniform_p: the least p-value of the three tests of uniformity, times three.
    """
    n = F.length(token).cast("double")
    encoding, alphabet = F.lit(ENCODINGS[-1][0]), F.lit(ENCODINGS[-1][2])
    for name, allowed, letters in reversed(ENCODINGS[:-1]):
        fits = token.rlike(allowed)
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(letters)).otherwise(alphabet)

    def with_alphabet(s: Column) -> Column:
        k = F.length(s["alphabet"]).cast("double")
        squares = F.aggregate(F.split(s["alphabet"], ""), F.lit(0.0), lambda a, c: a + F.when(c == "", F.lit(0.0)).otherwise(F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0))))
        places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(s["alphabet"], c).cast("double"))

        def tests(t: Column) -> Column:
            x, chi = t["places"], t["squares"] * k / n - n
            # Wilson-Hilferty: (chi/df)^(1/3) is nearly normal
            df = k - 1
            z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
            middle = (k + 1) / 2
            above = F.aggregate(x, F.lit(0.0), lambda a, v: a + (v > middle).cast("double"))
            runs = F.aggregate(x, F.struct(F.lit(-1).alias("side"), F.lit(0.0).alias("n")), lambda a, v: F.struct((v > middle).cast("int").alias("side"), (a["n"] + (a["side"] != (v > middle).cast("int")).cast("double")).alias("n")), lambda a: a["n"])
            below = n - above
            expect = 2 * above * below / n + 1
            spread = F.sqrt(F.greatest((expect - 1) * (expect - 2) / (n - 1), F.lit(1e-9)))
            z_runs = F.when(above * below > 0, (runs - expect) / spread).otherwise(F.lit(8.0))
            mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / n
            pairs = F.aggregate(x, F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx")), lambda a, v: F.struct(v.alias("last"), (a["xy"] + F.coalesce((a["last"] - mean) * (v - mean), F.lit(0.0))).alias("xy"), (a["xx"] + (v - mean) * (v - mean)).alias("xx")))
            z_serial = let(pairs, lambda p: F.when(p["xx"] > 0, p["xy"] / p["xx"] * F.sqrt(n)).otherwise(F.lit(8.0)))
            # one value, used thrice
            return let(z_serial, lambda z: chances(chi, df, z_chi, z_runs, z))

        def chances(chi: Column, df: Column, z_chi: Column, z_runs: Column, z_serial: Column) -> Column:
            two_sided = lambda z: 2 * (1 - normal_cdf(F.abs(z)))
            uniform = F.least(F.lit(1.0), 3 * F.least(two_sided(z_chi), two_sided(z_runs), two_sided(z_serial)))
            shift = (n - 1) * F.greatest(k * F.lit(TEXT_COINCIDENCE) - 1, F.lit(0.05))
            chi_p = normal_cdf((chi - df - shift) / F.sqrt(2 * df + 4 * shift))
            switches = F.regexp_count(token, F.lit(KIND_RUNS)) - 1
            runs_p = normal_cdf(((n - 1) * TEXT_SWITCH + 0.5 - switches) / F.sqrt((n - 1) * TEXT_SWITCH * (1 - TEXT_SWITCH)))
            serial_p = normal_cdf(F.abs(z_serial) - F.sqrt(n) * TEXT_SERIAL)
            p = F.struct(chi_p.alias("chi"), runs_p.alias("runs"), serial_p.alias("serial"))
            return let(p, lambda p: F.struct(
                encoding.alias("encoding"), n.cast("int").alias("n"), p["chi"].alias("chi_p"), p["runs"].alias("runs_p"), p["serial"].alias("serial_p"),
                fisher(p["chi"], p["runs"], p["serial"]).alias("text_p"), uniform.alias("uniform_p"),
            ))

        return let(F.struct(squares.alias("squares"), places.alias("places")), tests)

    return let(F.struct(alphabet.alias("alphabet")), with_alphabet)


def scan(docs: DataFrame, *, rate: float = 0.01, uniform: float = 0.03) -> DataFrame:
    """doc_id and spans (array<struct<kind, start, end>> by start, then kind as listed), with n_assign, n_access, n_hex.

    rate: false discovery rate of `random` spans in each class of lengths (powers of two); uniform: the
    least uniform_p of a discovery. A random span that overlaps a pattern's span is left out. Null and
    empty texts have no spans; repeated rows are scanned alike; other columns are ignored. Running sums
    are quadratic in the number of matches of one text, not in its length.
    """
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")
    assign = F.when((F.instr(text, "=") > 0) | (F.instr(text, ":") > 0), F.when(text.rlike(ASSIGN), spans(text, ASSIGN, 1, 6))).otherwise(none)
    access = F.when(F.instr(text, "AKIA") > 0, spans(text, r"AKIA[A-Z0-9]{16,}", 0, 20))
    hexes = F.when(text.rlike("[0-9a-f]{24}"), spans(text, "[0-9a-f]{24,}", 0, 24))
    runs = F.when(text.rlike(CANDIDATE), spans(text, CANDIDATE, 0, 20))
    found = docs.select("doc_id", text.alias("text"), *[F.coalesce(c, none).alias(k) for k, c in zip(("assign", "access", "hex", "run"), (assign, access, hexes, runs), strict=True)])
    overlaps = lambda x: F.exists(F.concat("assign", "access", "hex"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    free = F.filter("run", lambda x: ~overlaps(x))
    tested = F.transform(free, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])).alias("t")))
    rows = cut(found.select("doc_id", "assign", "access", "hex", F.filter(tested, lambda x: x["t"]["encoding"].isNotNull()).alias("runs")))
    length_class = lambda n: F.floor(F.log2(n))
    p_bin = lambda p: F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-30)))), F.lit(P_BINS))
    # Benjamini-Hochberg by histogram: the largest p whose expected false share is within the rate
    histogram = rows.select(F.explode("runs.t").alias("t")).groupBy(length_class(F.col("t.n")).alias("class"), p_bin(F.col("t.text_p")).alias("bin")).count().collect()
    limits: dict[int, int] = {}
    for cls in {r["class"] for r in histogram}:
        bins = sorted(((r["bin"], r["count"]) for r in histogram if r["class"] == cls), reverse=True)
        total, so_far = sum(n for _, n in bins), 0
        for b, n in bins:
            so_far += n
            if math.pow(10, -b / 10) * total <= rate * so_far:
                limits[cls] = b
    of_class = F.create_map(*[F.lit(x) for cls, b in sorted(limits.items()) for x in (int(cls), int(b))]) if limits else None
    enough = (lambda t: F.coalesce(p_bin(t["text_p"]) >= of_class[length_class(t["n"]).cast("int")], F.lit(False))) if limits else (lambda t: F.lit(False))
    random = F.filter("runs", lambda x: enough(x["t"]) & (x["t"]["uniform_p"] >= uniform))
    parts = [_kind(F.col("assign"), 0), _kind(F.col("access"), 1), _kind(F.col("hex"), 2)]
    out = lambda xs: F.transform(F.sort_array(F.concat(*xs)), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["o"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(
        "doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"),
        out(parts).alias("base"), out([*parts, _kind(random, 3)]).alias("spans"),
    )


def _kind(spans_: Column, order: int) -> Column:
    return F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("o"), x["end"].alias("end")))


def joined(spans_: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
