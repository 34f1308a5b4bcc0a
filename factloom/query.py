"""Query AST, parser and formatter."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from . import edn
from .edn import EList, Keyword, Symbol


class QueryError(ValueError):
    """A query that cannot be parsed or planned."""


@dataclass(frozen=True)
class Var:
    name: str  # with its question mark

    @property
    def column(self) -> str:
        return self.name[1:].replace("-", "_")


@dataclass(frozen=True)
class Const:
    value: Any

    def __hash__(self) -> int:
        return hash((type(self.value), repr(self.value)))


@dataclass(frozen=True)
class Blank:
    pass


Term = Var | Const | Blank


@dataclass(frozen=True)
class Pattern:
    e: Term
    a: Term
    v: Term = Blank()
    tx: Term = Blank()

    def terms(self) -> tuple[Term, ...]:
        return (self.e, self.a, self.v, self.tx)


@dataclass(frozen=True)
class Predicate:
    op: str
    args: tuple[Term, ...]


@dataclass(frozen=True)
class Expression:
    fn: str
    args: tuple[Term, ...]
    out: Var


@dataclass(frozen=True)
class Subquery:
    query: Query
    args: tuple[Term | str, ...]  # "$" stands for the database
    binding: str  # tuple, relation or collection
    out: tuple[Var, ...]


@dataclass(frozen=True)
class Aggregate:
    fn: str
    var: Var
    where: Var | None = None  # only rows where this is true count

    @property
    def column(self) -> str:
        return f"{self.fn.replace('-', '_')}_{self.var.column}" + (f"_if_{self.where.column}" if self.where else "")


@dataclass(frozen=True)
class Input:
    kind: str  # database, scalar, collection, tuple or relation
    vars: tuple[Var, ...] = ()


@dataclass(frozen=True)
class Query:
    find: tuple[Var | Aggregate, ...]
    inputs: tuple[Input, ...] = (Input("database"),)
    where: tuple[Pattern | Predicate | Expression | Subquery, ...] = ()
    order_by: tuple[tuple[Var, bool], ...] = field(default=())  # (variable, descending)


AGGREGATES = ("sum", "count", "avg", "min", "max", "count-distinct")
COMPARISONS = ("=", "!=", "not=", "<", "<=", ">", ">=")
STRING_PREDICATES = ("str/starts-with?", "str/ends-with?", "str/contains?", "same-date?")
TIME_PARTS = ("year", "month", "day", "hour", "minute", "second")
SCALARS = ("+", "-", "*", "/", "str", *TIME_PARTS, "ground", "identity")


def _var(x: Any) -> bool:
    return isinstance(x, Symbol) and x.startswith("?") and len(x) > 1


def _term(x: Any) -> Term:
    if _var(x):
        return Var(str(x))
    if isinstance(x, Symbol):
        if x == "_":
            return Blank()
        raise QueryError(f"unexpected symbol {x}")
    if isinstance(x, edn.Char) or x is None or isinstance(x, (list, tuple, dict, frozenset, edn.Tagged)):
        raise QueryError(f"{edn.write(x)} cannot stand in a clause")
    return Const(x)


def _find(x: Any) -> Var | Aggregate:
    if _var(x):
        return Var(str(x))
    if isinstance(x, EList):
        conditional = len(x) == 4 and x[2] == Keyword(":if") and _var(x[3])
        if not (len(x) == 2 or conditional) or not _var(x[1]):
            raise QueryError(f"an aggregate takes one variable: {edn.write(x)}")
        if x[0] not in AGGREGATES:
            raise QueryError(f"unknown aggregate {x[0]}; known: {', '.join(AGGREGATES)}")
        return Aggregate(str(x[0]), Var(str(x[1])), Var(str(x[3])) if conditional else None)
    raise QueryError(f"cannot find {edn.write(x)}")


def _input(x: Any) -> Input:
    if x == Symbol("$"):
        return Input("database")
    if _var(x):
        return Input("scalar", (Var(str(x)),))
    if isinstance(x, list) and len(x) == 2 and _var(x[0]) and x[1] == Symbol("..."):
        return Input("collection", (Var(str(x[0])),))
    if isinstance(x, list) and x and isinstance(x[0], list) and x[0] and all(map(_var, x[0])):
        names = tuple(Var(str(v)) for v in x[0])
        if len(x) == 1:
            return Input("tuple", names)
        if len(x) == 2 and x[1] == Symbol("..."):
            return Input("relation", names)
    raise QueryError(f"bad input {edn.write(x)}")


def _binding(x: Any) -> tuple[str, tuple[Var, ...]]:
    if _var(x):
        return "collection", (Var(str(x)),)
    if isinstance(x, list) and x and isinstance(x[0], list) and x[0] and all(map(_var, x[0])):
        names = tuple(Var(str(v)) for v in x[0])
        if len(x) == 1:
            return "tuple", names
        if len(x) == 2 and x[1] == Symbol("..."):
            return "relation", names
    raise QueryError(f"bad binding {edn.write(x)}")


def _clause(x: Any) -> Pattern | Predicate | Expression | Subquery:
    if not isinstance(x, list) or not x:
        raise QueryError(f"a clause is a vector: {edn.write(x)}")
    if not isinstance(x[0], EList):
        if not 3 <= len(x) <= 4:
            raise QueryError(f"a pattern has 3 or 4 terms: {edn.write(x)}")
        return Pattern(*map(_term, x))
    form, rest = x[0], x[1:]
    if not form:
        raise QueryError("empty form")
    if form[0] == Symbol("q"):
        if len(form) < 2 or not isinstance(form[1], list) or len(rest) != 1:
            raise QueryError(f"bad subquery {edn.write(x)}")
        kind, out = _binding(rest[0])
        return Subquery(_query(form[1]), tuple("$" if a == Symbol("$") else _term(a) for a in form[2:]), kind, out)
    op, args = str(form[0]), tuple(_term(a) for a in form[1:])
    if rest:
        if len(rest) != 1 or not _var(rest[0]):
            raise QueryError(f"an expression binds one variable: {edn.write(x)}")
        counts = {"+": 2, "-": 2, "*": 2, "/": 2, "ground": 1, "identity": 1} | dict.fromkeys(TIME_PARTS, 1)
        if op in counts and len(args) != counts[op] or op == "str" and not args:
            raise QueryError(f"{op} takes {counts.get(op, 'some')} arguments: {edn.write(x)}")
        return Expression(op, args, Var(str(rest[0])))
    if op in COMPARISONS and (len(args) < 2 or op in ("!=", "not=") and len(args) != 2):
        raise QueryError(f"wrong number of arguments: {edn.write(x)}")
    if op in STRING_PREDICATES and len(args) != 2:
        raise QueryError(f"{op} takes 2 arguments")
    return Predicate("!=" if op == "not=" else op, args)


def _query(form: Any) -> Query:
    if not isinstance(form, list):
        raise QueryError("a query is a vector")
    parts: dict[str, list] = {}
    here = None
    for x in form:
        if isinstance(x, Keyword) and x in (":find", ":in", ":where", ":order-by") and (here is None or x not in parts):
            here = parts.setdefault(str(x), [])
        elif here is None or isinstance(x, Keyword):
            raise QueryError(f"unexpected {edn.write(x)} in a query")
        else:
            here.append(x)
    if not parts.get(":find"):
        raise QueryError("a query needs :find")
    if not parts.get(":where"):
        raise QueryError("a query needs :where")
    order: list[tuple[Var, bool]] = []
    by = parts.get(":order-by", [])
    for x in by[0] if len(by) == 1 and isinstance(by[0], list) else by:
        if _var(x):
            order.append((Var(str(x)), False))
        elif isinstance(x, list) and x and _var(x[0]) and x[1:] in ([], [Keyword(":asc")], [Keyword(":desc")]):
            order.append((Var(str(x[0])), x[1:] == [Keyword(":desc")]))
        else:
            raise QueryError(f"bad :order-by {edn.write(x)}")
    inputs = tuple(map(_input, parts[":in"])) if ":in" in parts else (Input("database"),)
    return Query(tuple(map(_find, parts[":find"])), inputs, tuple(map(_clause, parts[":where"])), tuple(order))


def parse(text: str) -> Query:
    try:
        return _query(edn.read(text))
    except edn.EdnError as e:
        raise QueryError(str(e)) from e


def parse_many(text: str) -> list[Query]:
    try:
        return [_query(f) for f in edn.read_all(text)]
    except edn.EdnError as e:
        raise QueryError(str(e)) from e


def variables(clauses) -> list[Var]:
    """Variables of clauses in order of appearance; of a subquery, its arguments and outputs."""
    seen: dict[Var, None] = {}
    for c in clauses:
        terms = c.terms() if isinstance(c, Pattern) else (*c.args, *((c.out,) if isinstance(c, Expression) else c.out if isinstance(c, Subquery) else ()))
        seen.update(dict.fromkeys(t for t in terms if isinstance(t, Var)))
    return list(seen)


def _text(t: Any) -> str:
    return t.name if isinstance(t, Var) else "_" if isinstance(t, Blank) else "$" if t == "$" and isinstance(t, str) else edn.write(t.value)


def _clause_text(c, indent: int) -> str:
    if isinstance(c, Pattern):
        terms = list(c.terms())
        if isinstance(terms[3], Blank):
            terms.pop()
        return "[" + " ".join(map(_text, terms)) + "]"
    if isinstance(c, Subquery):
        out = "[" + " ".join(v.name for v in c.out) + "]"
        bind = {"collection": c.out[0].name, "tuple": f"[{out}]", "relation": f"[{out} ...]"}[c.binding]
        return f"[(q {format_query(c.query, indent + 4)}{''.join(' ' + _text(a) for a in c.args)}) {bind}]"
    form = f"({c.op if isinstance(c, Predicate) else c.fn}{''.join(' ' + _text(a) for a in c.args)})"
    return f"[{form} {c.out.name}]" if isinstance(c, Expression) else f"[{form}]"


def format_query(q: Query, indent: int = 0) -> str:
    """EDN text that parses to `q`."""
    pad = "\n" + " " * (indent + 1)
    names = lambda vs: " ".join(v.name for v in vs)
    kinds = {"database": lambda i: "$", "scalar": lambda i: names(i.vars), "collection": lambda i: f"[{names(i.vars)} ...]", "tuple": lambda i: f"[[{names(i.vars)}]]", "relation": lambda i: f"[[{names(i.vars)}] ...]"}
    out = "[:find " + " ".join(f.name if isinstance(f, Var) else f"({f.fn} {f.var.name}{f' :if {f.where.name}' if f.where else ''})" for f in q.find)
    if q.inputs != (Input("database"),):
        out += pad + ":in " + " ".join(kinds[i.kind](i) for i in q.inputs)
    out += pad + ":where " + (pad + " " * 7).join(_clause_text(c, indent + 8) for c in q.where)
    if q.order_by:
        out += pad + ":order-by [" + " ".join(f"[{v.name} :desc]" if d else v.name for v, d in q.order_by) + "]"
    return out + "]"
