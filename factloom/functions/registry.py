"""Static types and the builders of expressions and predicates.

A typed column is (Column, type); types are long, double, string, keyword, bool, time, binary, any and
ref:<table>. Where a value could make a row fail at run time, builders give null and say so, and the
compiler drops those rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..query import TIME_PARTS, QueryError

NUMERIC = ("long", "double")


@dataclass(frozen=True)
class Typed:
    column: Column
    type: str


def text_of(x: Typed) -> Column:
    """Text as the `%v` of the data model: 100.0 prints 100, times print with their zone."""
    c = x.column
    if x.type == "double":
        return double_text(c)
    if x.type == "time":
        fraction = F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", "")
        return F.concat(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), fraction, F.lit(" +0000 UTC"))
    if x.type.startswith("ref:"):
        return reference(x)
    if x.type == "any":
        return F.coalesce(c["s"], text_of(Typed(c["i"], "long")), text_of(Typed(c["d"], "double")), c["b"].cast("string"), text_of(Typed(c["ts"], "time")))
    return c.cast("string")


def double_text(c: Column) -> Column:
    """Shortest digits that read back, as 123.5, or as 1.5e+06 where the exponent is below -4 or above 5."""
    plain = F.abs(c).cast("string")  # 123.5, or 1.235E10 from 1e7 on and below 1e-3
    size = F.abs(c)
    scientific = plain.contains("E")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"E.*$", ""), r"\.", ""), r"0+$", "")
    exponent = F.when(scientific, F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")).otherwise(F.lit(6))
    tail = F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, 2, 40))).otherwise(F.lit(""))
    power = F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    power = F.when(F.abs(exponent) > 99, F.concat(F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")), F.abs(exponent).cast("string"))).otherwise(power)
    body = (
        F.when(scientific & (exponent == -4), F.concat(F.lit("0.000"), digits))
        .when(scientific | (size >= 1e6), F.concat(F.substring(digits, 1, 1), tail, power))
        .otherwise(F.regexp_replace(plain, r"\.0$", ""))
    )
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    infinite = F.when(c > 0, F.lit("+Inf")).otherwise(F.lit("-Inf"))
    return F.when(F.isnan(c), F.lit("NaN")).when(size == float("inf"), infinite).otherwise(F.concat(sign, body))


def reference(x: Typed) -> Column:
    """`table:key` of a ref; refs of the datom log are text already."""
    table = x.type.removeprefix("ref:")
    return x.column if not table else F.concat(F.lit(table + ":"), x.column.cast("string"))


def number(x: Typed) -> Typed:
    """Operand of arithmetic: text is parsed (a column of text as doubles, exact to 2^53), anything else that is
    no number is 0."""
    if x.type in NUMERIC:
        return x
    if x.type in ("string", "keyword"):
        return Typed(F.coalesce(x.column.try_cast("double"), F.lit(0.0)), "double")
    return Typed(F.lit(0).cast("long"), "long")


def _arithmetic(op: str) -> Callable[[list[Typed]], Typed]:
    def build(args: list[Typed]) -> Typed:
        a, b = map(number, args)
        if op == "/":
            return Typed(F.try_divide(a.column.cast("double"), b.column.cast("double")), "double")
        kind = "long" if a.type == b.type == "long" else "double"
        x, y = a.column.cast(kind if kind == "double" else "bigint"), b.column.cast(kind if kind == "double" else "bigint")
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], kind)

    return build


def _part(name: str) -> Callable[[list[Typed]], Typed]:
    part = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[name]

    def build(args: list[Typed]) -> Typed:
        if args[0].type != "time":  # rows with anything else fail and are dropped
            return Typed(F.lit(None).cast("long"), "long")
        return Typed(part(args[0].column).cast("long"), "long")

    return build


EXPRESSIONS: dict[str, Callable[[list[Typed]], Typed]] = {
    **{op: _arithmetic(op) for op in "+-*/"},
    **{p: _part(p) for p in TIME_PARTS},
    "str": lambda args: Typed(F.concat(*[F.coalesce(text_of(a), F.lit("<nil>")) for a in args]), "string"),
    "ground": lambda args: args[0],
    "identity": lambda args: args[0],
}


def compare(op: str, a: Typed, b: Typed) -> Column:
    """Comparison with the ordering across types: unlike types are unequal, and the left is less."""
    same = a.type == b.type or (a.type in NUMERIC and b.type in NUMERIC)
    x, y = a.column, b.column
    if "any" in (a.type, b.type):
        other = b if a.type == "any" else a
        if other.type != "any":
            slot = {"long": "d", "double": "d", "string": "s", "keyword": "s", "bool": "b", "time": "ts"}.get(other.type, "s")
            cell = lambda c: F.coalesce(c["d"], c["i"].cast("double")) if slot == "d" else c[slot]
            x, y = (cell(x), y) if a.type == "any" else (x, cell(y))
        else:
            x, y = text_of(a), text_of(b)
    elif not same:
        return F.lit(op in ("<", "<=", "!="))
    return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _text_test(test: Callable[[Column, Column], Column]) -> Callable[[list[Typed]], Column]:
    return lambda args: test(args[0].column, args[1].column) if all(a.type in ("string", "keyword") for a in args) else F.lit(False)


PREDICATES: dict[str, Callable[[list[Typed]], Column]] = {
    "str/starts-with?": _text_test(F.startswith),
    "str/ends-with?": _text_test(F.endswith),
    "str/contains?": _text_test(F.contains),
    "same-date?": lambda args: F.to_date(args[0].column) == F.to_date(args[1].column) if all(a.type == "time" for a in args) else F.lit(False),
}


class Registry:
    """Built-in functions and those that a user adds, for one database."""

    def __init__(self):
        self.expressions = dict(EXPRESSIONS)
        self.predicates = dict(PREDICATES)
        self.version = 0

    def register(self, name: str, build: Callable[..., Column], *, returns: str | None = None) -> None:
        """`build` takes one Column for each argument. With `returns` (a type) it is an expression, else a predicate.

        Any column function will do; a pandas UDF is called in Arrow batches.
        """
        self.version += 1
        if returns:
            self.expressions[name] = lambda args: Typed(build(*[a.column for a in args]), returns)
        else:
            self.predicates[name] = lambda args: build(*[a.column for a in args])

    def names(self) -> list[str]:
        return sorted({*self.expressions, *self.predicates, "=", "!=", "<", "<=", ">", ">=", "missing"})

    def expression(self, name: str, args: list[Typed]) -> Typed:
        if name not in self.expressions:
            raise QueryError(f"unknown function {name}; known: {', '.join(self.names())}")
        return self.expressions[name](args)

    def predicate(self, name: str, args: list[Typed]) -> Column:
        if name in ("=", "!=", "<", "<=", ">", ">="):
            out = F.lit(True)
            for a, b in zip(args, args[1:], strict=False):
                out = out & compare(name, a, b)
            return out
        if name not in self.predicates:
            raise QueryError(f"unknown predicate {name}; known: {', '.join(self.names())}")
        return self.predicates[name](args)
