"""From a query to one lazy DataFrame.

Every intermediate relation is a set over its variables. `key` names variables that determine a row, so
`distinct` is emitted only where rows can repeat. Clauses run in order of what they need, never in order
of kind; groups that nothing links are an error and not a product.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import annotations as notes
from ..edn import Keyword
from ..functions.registry import Typed, reference, text_of
from ..query import Aggregate, Blank, Const, Expression, Pattern, Predicate, Query, QueryError, Subquery, Var, variables
from ..sources.datoms import Ref, tagged
from . import rewrite

#: Input collections up to this many rows are broadcast.
BROADCAST_INPUT = 10_000
#: Values of an input that become a filter on the scans that bind them.
PUSHED_VALUES = 1000


class CartesianProductError(QueryError):
    pass


@dataclass(frozen=True)
class Rel:
    df: DataFrame
    types: dict[Var, str]
    key: frozenset[Var]
    free: bool = False  # an input or an uncorrelated subquery: may be multiplied with the rest
    values: dict[Var, list] | None = None  # all values of an input's variables, if they are few

    def typed(self, v: Var) -> Typed:
        return Typed(F.col(v.column), self.types[v])


def literal(value: object) -> Typed:
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "long")
    if isinstance(value, float):
        return Typed(F.lit(value), "double")
    if isinstance(value, Keyword):
        return Typed(F.lit(str(value)), "keyword")
    if isinstance(value, Ref):
        return Typed(F.lit(str(value)), "ref:")
    if isinstance(value, str):
        return Typed(F.lit(value), "string")
    if isinstance(value, dt.datetime):
        if value.tzinfo:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        return Typed(F.lit(value.isoformat(" ")).cast("timestamp_ntz"), "time")
    if isinstance(value, (bytes, bytearray)):
        return Typed(F.lit(bytes(value)), "binary")
    raise QueryError(f"no literal of type {type(value).__name__}")


def equal(cell: Typed, other: Typed) -> Column:
    """Equality of a stored value and a constant or another variable's value."""
    if cell.type.startswith("ref:") and other.type in ("string", "keyword", "long"):
        return (reference(cell) == other.column) if other.type != "long" else (cell.column.cast("string") == other.column.cast("string"))
    if {cell.type, other.type} <= {"string", "keyword", "ref:"}:
        return cell.column == other.column
    if "any" in (cell.type, other.type) and cell.type != other.type:
        value, typed = (cell, other) if cell.type == "any" else (other, cell)
        if typed.type in ("long", "double"):
            return F.coalesce(value.column["i"].cast("double"), value.column["d"]) == typed.column
        return text_of(value) == text_of(typed)
    if cell.type != other.type and not {cell.type, other.type} <= {"long", "double"}:
        return F.lit(False)
    return cell.column == other.column


def member(cell: Typed, values: list) -> Column:
    """Whether a stored value is one of some literals; a plain IN where types allow, which scans understand."""
    kinds = {literal(x).type for x in values}
    if not values:
        return F.lit(False)
    if kinds <= {"long", "double"} and cell.type in ("long", "double") or kinds == {"string"} and cell.type in ("string", "keyword"):
        return cell.column.isin(values)
    test = F.lit(False)
    for x in values:
        test = test | equal(cell, literal(x))
    return test


def natural_join(a: Rel, b: Rel) -> Rel:
    """Inner join on all shared variables."""
    shared = [v for v in b.types if v in a.types]
    if not shared:
        return Rel(a.df.crossJoin(b.df), {**a.types, **b.types}, a.key | b.key, a.free and b.free)
    alike = [v for v in shared if a.types[v] == b.types[v] or {a.types[v], b.types[v]} <= {"long", "double"}]
    right, conditions, extra = b.df, [], []
    for v in shared:
        if v not in alike:
            right = right.withColumnRenamed(v.column, "__" + v.column)
            extra.append("__" + v.column)
            conditions.append(equal(a.typed(v), Typed(F.col("__" + v.column), b.types[v])))
    if alike:
        df = a.df.join(right, [v.column for v in alike], "inner")
        for c in conditions:
            df = df.where(c)
    else:
        test = conditions[0]
        for c in conditions[1:]:
            test = test & c
        df = a.df.join(right, test, "inner")
    common = frozenset(shared)
    key = a.key if b.key <= common else b.key if a.key <= common else a.key | b.key
    return Rel(df.drop(*extra), {**b.types, **a.types}, key, a.free and b.free)


class Compiler:
    """Compiles queries against a database (catalog, log, registry, as_of)."""

    def __init__(self, db, note: notes.Collector | None = None):
        self.db, self.note = db, note or notes.Collector()

    def _join(self, a: Rel, b: Rel) -> Rel:
        shared = [v.name for v in b.types if v in a.types]
        self.note.add(notes.JOIN if shared else notes.PRODUCT, variables=[v.name for v in {**a.types, **b.types}], on=" ".join(shared))
        return natural_join(a, b)

    # -- sources ---------------------------------------------------------------------------------

    def _table_of(self, p: Pattern) -> str | None:
        if not isinstance(p.a, Const):
            return None
        found = self.db.catalog.find(str(p.a.value)) if "/" in str(p.a.value) else None
        return found[0].name if found else None

    def _select(self, df: DataFrame, cells: dict[Var, Typed], tests: list[Column], key: frozenset[Var] | None) -> Rel:
        for t in tests:
            df = df.where(t)
        if not cells:  # only whether there is a row matters
            df = df.limit(1).select(F.lit(1).alias("__one"))
            return Rel(df, {}, frozenset(), free=True)
        df = df.select(*[x.column.alias(v.column) for v, x in cells.items()])
        if key is None:
            df, key = df.distinct(), frozenset(cells)
        return Rel(df, {v: x.type for v, x in cells.items()}, key)

    def _bind(self, term, cell: Typed, cells: dict[Var, Typed], consts: dict[Var, Typed], tests: list[Column]) -> None:
        if isinstance(term, Const):
            tests.append(equal(cell, literal(term.value)))
        elif isinstance(term, Var):
            if term in consts:
                tests.append(equal(cell, consts[term]))
            elif term in cells:
                tests.append(equal(cells[term], cell))
            else:
                cells[term] = cell

    def _scan(self, e, name: str, patterns: list[Pattern], consts: dict[Var, Typed], alone: set[Var]) -> Rel:
        """One scan for all patterns of one entity in one table."""
        table = self.db.catalog.tables[name]
        cells: dict[Var, Typed] = {}
        tests: list[Column] = []
        df = self.db.rows(table)
        rows_are_own = isinstance(e, Var) and e not in consts and e in alone and not table.key
        if isinstance(e, Blank):
            key = None
        elif rows_are_own:  # a row that nothing else refers to needs no id: it is there once
            cells[e], key = Typed(F.lit(1).cast("bigint"), f"ref:{name}"), None
        else:
            df, entity = table.identified(df)
            if isinstance(e, Var) and e not in consts:
                cells[e], key = entity, frozenset((e,))
            else:
                tests.append(table.entity_is(entity.column, e.value) if isinstance(e, Const) else equal(entity, consts[e]))
                key = frozenset()
        self.note.add(notes.SCAN, table=name, patterns=len(patterns), variables=[t.name for t in dict.fromkeys(t for p in patterns for t in p.terms() if isinstance(t, Var))])
        for p in patterns:
            cell = self.db.catalog.find(str(p.a.value))[1]
            tests.append(cell.column.isNotNull())
            self._bind(p.v, cell, cells, consts, tests)
            if not isinstance(p.tx, Blank):
                if not table.tx:
                    raise QueryError(f"table {name} has no transactions")
                self._bind(p.tx, self.db.table_tx(table), cells, consts, tests)
        rel = self._select(df, cells, tests, frozenset(cells) if rows_are_own else key)
        return replace(rel, key=frozenset((*cells, Var("?__row")))) if rows_are_own else rel

    def _log(self, p: Pattern, consts: dict[Var, Typed]) -> Rel:
        """One pattern over the datom log, or over all tables as datoms if there is no log."""
        attribute = str(p.a.value) if isinstance(p.a, Const) else consts[p.a] if p.a in consts else None
        df = self.db.datoms(attribute if isinstance(attribute, str) else None) if self.db.log else self._unpivoted(p, consts)
        self.note.add(notes.LOG, table="facts", variables=[t.name for t in p.terms() if isinstance(t, Var)])
        cells: dict[Var, Typed] = {}
        tests: list[Column] = []
        if isinstance(attribute, Typed):
            tests.append(F.col("a") == attribute.column)
            attribute = None
        elif attribute is not None:
            tests.append(F.col("a") == attribute)
        self._bind(p.e, Typed(F.col("e"), "ref:"), cells, consts, tests)
        if attribute is None and isinstance(p.a, Var) and p.a not in consts:
            cells[p.a] = Typed(F.col("a"), "keyword")
        value = self.db.log.value(attribute) if self.db.log and attribute else Typed(F.col("v"), "any")
        self._bind(p.v, value, cells, consts, tests)
        self._bind(p.tx, Typed(F.col("tx"), "long"), cells, consts, tests)
        return self._select(df, cells, tests, None)

    def _unpivoted(self, p: Pattern, consts: dict[Var, Typed]) -> DataFrame:
        """All facts of all opened tables; of one table if the entity is stated."""
        stated = p.e.value if isinstance(p.e, Const) else None
        names = [str(stated).split(":")[0]] if isinstance(stated, str) and ":" in stated else list(self.db.catalog.tables)
        out = None
        for name in names:
            table = self.db.catalog.tables[name]
            df, own = table.identified(self.db.rows(table))
            facts = F.array(*[F.struct(F.lit(f":{name}/{a}").alias("a"), tagged(table.attribute(a)).alias("v")) for a in table.attributes() if table.attribute(a).type != "opaque"])
            tx = self.db.table_tx(table).column if table.tx else F.lit(None).cast("bigint")
            entity = F.concat(F.lit(f"{name}:"), own.column.cast("string"))
            part = df.select(entity.alias("e"), tx.alias("tx"), F.explode(facts).alias("f")).select("e", "f.a", "f.v", "tx")
            part = part.where(F.coalesce(*[F.col(f"v.{s}").cast("string") for s in ("s", "i", "d", "b", "ts")], F.hex("v.bin")).isNotNull())
            out = part if out is None else out.unionByName(part)
        if out is None:
            raise QueryError("there are no facts")
        return out

    # -- clauses ---------------------------------------------------------------------------------

    def _value(self, term, rel: Rel | None, consts: dict[Var, Typed]) -> Typed:
        if isinstance(term, Const):
            return literal(term.value)
        if term in consts:
            return consts[term]
        return rel.typed(term)

    def _subquery(self, sq: Subquery, outer: Rel | None, consts: dict[Var, Typed]) -> Rel:
        """The decorrelated result over (argument variables, outputs), to be joined with the outer rows."""
        if sq.binding == "collection":
            raise NotImplementedError("a collection binding of a subquery is not supported")
        if len(sq.args) != len(sq.query.inputs):
            raise QueryError(f"the subquery takes {len(sq.query.inputs)} arguments, not {len(sq.args)}")
        if len(sq.out) != len(sq.query.find):
            raise QueryError(f"the binding has {len(sq.out)} variables for {len(sq.query.find)} columns")
        inner: dict[Var, Typed] = {}
        pairs: list[tuple[Var, Var]] = []
        for given, arg in zip(sq.query.inputs, sq.args, strict=True):
            if (given.kind == "database") != (arg == "$" and isinstance(arg, str)):
                raise QueryError("$ must stand for $")
            if given.kind == "database":
                continue
            if given.kind != "scalar" or isinstance(arg, Blank):
                raise QueryError("subquery arguments bind single variables")
            if isinstance(arg, Const) or arg in consts:
                inner[given.vars[0]] = self._value(arg, None, consts)
            else:
                pairs.append((given.vars[0], arg))
        bound = {t for c in sq.query.where if isinstance(c, Pattern) for t in (c.e, c.v)}
        starts: list[Rel] = []
        if pairs and not all(i in bound for i, _ in pairs):
            cols = [F.col(o.column).alias(i.column) for i, o in pairs]
            starts.append(Rel(outer.df.select(*cols).distinct(), {i: outer.types[o] for i, o in pairs}, frozenset(i for i, _ in pairs), free=True))
        keep = tuple(i for i, _ in pairs)
        df, types, key_types = self.run(sq.query, inner, starts, keep)
        single = sq.binding == "tuple"
        if single and not all(isinstance(f, Aggregate) for f in sq.query.find):
            # more than one row for one set of arguments is an error
            n = [F.count("*").alias("__n"), *[F.first(f"__f{i}").alias(f"__f{i}") for i in range(len(sq.out))]]
            df = (df.groupBy(*[i.column for i in keep]).agg(*n) if keep else df.agg(*n).where("__n > 0")).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("a tuple binding expects one result")).cast("boolean")).otherwise(F.lit(True))).drop("__n")
        tests, columns, result = [], {}, {}
        for (i, o), kind in zip(pairs, key_types, strict=True):
            if o in columns:
                tests.append(F.col(i.column) == columns[o])
            else:
                columns[o], result[o] = F.col(i.column), kind
        for n, v in enumerate(sq.out):
            if v in consts:
                tests.append(equal(Typed(F.col(f"__f{n}"), types[n]), consts[v]))
            elif v in columns:
                tests.append(equal(Typed(columns[v], result[v]), Typed(F.col(f"__f{n}"), types[n])))
            else:
                columns[v], result[v] = F.col(f"__f{n}"), types[n]
                tests.append(F.col(f"__f{n}").isNotNull())
        for t in tests:
            df = df.where(t)
        if not columns:
            df = df.limit(1).select(F.lit(1).alias("__one"))
        else:
            df = df.select(*[c.alias(v.column) for v, c in columns.items()])
        key = frozenset(o for _, o in pairs) if single else frozenset(result)
        if not pairs:
            df = F.broadcast(df) if single else df  # one row
        return Rel(df, result, key, free=not pairs)

    def run(self, q: Query, consts: dict[Var, Typed], starts: list[Rel], keep: tuple[Var, ...] = ()) -> tuple[DataFrame, list[str], list[str]]:
        """Columns: `keep` by name, then __f0, __f1, ... in the order of :find; and the types of both."""
        q = rewrite.merge_subqueries(q)
        consts = dict(consts)
        patterns = [c for c in q.where if isinstance(c, Pattern)]
        names: dict[str, Var] = {}
        for v in [*variables(q.where), *consts]:
            if names.setdefault(v.column, v) != v:
                raise QueryError(f"{v.name} and {names[v.column].name} would share a column")
        used: dict[Var, int] = {}
        groups = rewrite.entity_groups(patterns, self._table_of)
        for e, _, ps in groups:
            for v in {t for p in ps for t in p.terms() if isinstance(t, Var) and t != e} | ({e} if isinstance(e, Var) else set()):
                used[v] = used.get(v, 0) + 1
            for p in ps:  # an entity that is also a value of its own row is used
                for t in (p.v, p.tx):
                    if t == e and isinstance(e, Var):
                        used[e] = 9
        for c in q.where:
            if not isinstance(c, Pattern):
                for v in variables([c]):
                    used[v] = 9
        for f in q.find:
            if isinstance(f, Var) or f.fn != "count":
                used[f if isinstance(f, Var) else f.var] = 9
            if isinstance(f, Aggregate) and f.where:
                used[f.where] = 9
        for v in (*keep, *(v for v, _ in q.order_by), *(v for s in starts for v in s.types)):
            used[v] = 9
        alone = {v for v, n in used.items() if n == 1}
        rels: list[Rel] = list(starts)
        for e, table, ps in rewrite.ordered_patterns(groups):
            if table is not None:
                rels.append(self._scan(e, table, ps, consts, alone))
            else:
                rels += [self._log(p, consts) for p in ps]
        rels = self._pushed(starts, rels)
        rels = self._collapse(rels)
        todo: list = [c for c in q.where if not isinstance(c, Pattern)]
        for c in rewrite.time_ranges(q):
            todo.insert(0, c)
        while todo:
            done = self._step(todo, rels, consts)
            if done is None:
                missing = sorted({v.name for c in todo for v in variables([c])} - {v.name for r in rels for v in r.types} - {v.name for v in consts})
                raise QueryError(f"nothing binds {', '.join(missing)}" if missing else "these clauses cannot be ordered")
            todo.remove(done)
            rels[:] = self._collapse(rels)
        return self._find(q, rels, consts, keep)

    def _pushed(self, starts: list[Rel], rels: list[Rel]) -> list[Rel]:
        """Few input values become filters on what binds them; a collection that is bound needs no join then."""
        for s in starts:
            if s.values is None:
                continue
            bound = False
            for v, values in s.values.items():
                for i, r in enumerate(rels):
                    if r is not s and v in r.types and r.values is None:
                        rels[i] = replace(r, df=r.df.where(member(r.typed(v), values)))
                        bound = True
            if bound and len(s.types) == 1:
                rels = [r for r in rels if r is not s]
        return rels

    def _collapse(self, rels: list[Rel]) -> list[Rel]:
        """Natural joins until no two relations share a variable."""
        out: list[Rel] = []
        rest = list(rels)
        while rest:
            now = rest.pop(0)
            moved = True
            while moved:
                moved = False
                for i, r in enumerate(rest):
                    if set(r.types) & set(now.types):
                        now = self._join(now, rest.pop(i))
                        moved = True
                        break
            out.append(now)
        return out

    def _step(self, todo: list, rels: list[Rel], consts: dict[Var, Typed]):
        """Run one clause that can run; those over one relation first, then those that link several."""
        for linking in (False, True):
            for c in todo:
                if isinstance(c, Predicate) and c.op in ("ground", "missing"):
                    bound = [isinstance(t, Const) or t in consts or any(t in r.types for r in rels) for t in c.args]
                    others = any(isinstance(x, (Expression, Subquery)) for x in todo)
                    if others and not all(bound):
                        continue  # something may still bind it
                    holds = all(bound) if c.op == "ground" else not any(bound)
                    if not holds:
                        rels[:] = [replace(r, df=r.df.where(F.lit(False))) for r in rels]
                    return c
                need = [t for t in c.args if isinstance(t, Var) and t not in consts]
                unbound = [v for v in need if not any(v in r.types for r in rels)]
                if isinstance(c, Predicate) and c.op == "=" and len(unbound) == 1 and len(c.args) == 2:
                    # `=` with one unbound side binds it, if nothing else will
                    later = {v for x in todo if x is not c for v in ((x.out,) if isinstance(x, Expression) else x.out if isinstance(x, Subquery) else ())}
                    if unbound[0] not in later:
                        other = c.args[1] if c.args[0] == unbound[0] else c.args[0]
                        return self._assign(c, Expression("identity", (other,), unbound[0]), rels, consts) and c
                if unbound:
                    continue
                held = [r for r in rels if any(v in r.types for v in need)]
                if len(held) > 1 and not linking:
                    continue
                if isinstance(c, Subquery):
                    self._apply_subquery(c, held, rels, consts)
                elif isinstance(c, Expression):
                    self._assign(c, c, rels, consts)
                else:
                    self._filter(c, held, rels, consts)
                return c
        return None

    def _merged(self, held: list[Rel], rels: list[Rel]) -> Rel | None:
        """The relations that a clause links, as one; Catalyst makes an equi-join of the product where it can."""
        if not held:
            return None
        now = held[0]
        for r in held[1:]:
            now = self._join(now, r)
        rels[:] = [r for r in rels if not any(r is h for h in held)] + [now]
        return now

    def _replace(self, old: Rel, new: Rel, rels: list[Rel]) -> None:
        rels[:] = [new if r is old else r for r in rels]

    def _filter(self, c: Predicate, held: list[Rel], rels: list[Rel], consts: dict[Var, Typed]) -> None:
        rel = self._merged(held, rels)
        test = self.db.registry.predicate(c.op, [self._value(t, rel, consts) for t in c.args])
        for r in [rel] if rel else list(rels):
            self._replace(r, replace(r, df=r.df.where(test)), rels)

    def _assign(self, c, x: Expression, rels: list[Rel], consts: dict[Var, Typed]) -> bool:
        need = [t for t in x.args if isinstance(t, Var) and t not in consts]
        held = [r for r in rels if any(v in r.types for v in need)]
        if x.out in consts or any(x.out in r.types for r in rels):  # bound already: it must agree
            held += [r for r in rels if x.out in r.types and not any(r is h for h in held)]
            rel = self._merged(held, rels)
            made = self.db.registry.expression(x.fn, [self._value(t, rel, consts) for t in x.args])
            test = equal(self._value(x.out, rel, consts), made)
            for r in [rel] if rel else list(rels):
                self._replace(r, replace(r, df=r.df.where(test)), rels)
            return True
        if not need:
            made = self.db.registry.expression(x.fn, [self._value(t, None, consts) for t in x.args])
            consts[x.out] = made
            if x.fn not in ("ground", "identity", "str"):
                rels[:] = [replace(r, df=r.df.where(made.column.isNotNull())) for r in rels]
            return True
        rel = self._merged(held, rels)
        made = self.db.registry.expression(x.fn, [self._value(t, rel, consts) for t in x.args])
        df = rel.df.withColumn(x.out.column, made.column)
        if x.fn not in ("ground", "identity", "str"):
            df = df.where(F.col(x.out.column).isNotNull())
        self._replace(rel, Rel(df, {**rel.types, x.out: made.type}, rel.key, rel.free), rels)
        return True

    def _apply_subquery(self, c: Subquery, held: list[Rel], rels: list[Rel], consts: dict[Var, Typed]) -> None:
        outer = self._merged(held, rels)
        found = self._subquery(c, outer, consts)
        if outer is None:
            rels.append(found)
        else:
            self._replace(outer, self._join(outer, found), rels)

    # -- results ---------------------------------------------------------------------------------

    def _find(self, q: Query, rels: list[Rel], consts: dict[Var, Typed], keep: tuple[Var, ...]) -> tuple[DataFrame, list[str], list[str]]:
        for f in q.find:
            for v in (f,) if isinstance(f, Var) else (f.var, f.where) if f.where else (f.var,):
                if v not in consts and not any(v in r.types for r in rels):
                    raise QueryError(f"nothing binds {v.name} of :find")
        solid = [r for r in rels if not r.free]
        if len(solid) > 1:
            raise CartesianProductError("these groups share no variable and no clause links them: " + "; ".join(", ".join(v.name for v in r.types) for r in solid))
        rels = solid + [r for r in rels if r.free]
        rel = rels[0]
        for r in rels[1:]:
            rel = self._join(rel, r)
        kept = [self._value(v, rel, consts) for v in keep]
        cells = [self._value(f if isinstance(f, Var) else f.var, rel, consts) for f in q.find]
        named = [x.column.alias(v.column) for v, x in zip(keep, kept, strict=True)]
        types = [x.type for x in cells]
        if any(isinstance(f, Aggregate) for f in q.find):
            groups = [*named, *[x.column.alias(f"__f{i}") for i, (f, x) in enumerate(zip(q.find, cells, strict=True)) if isinstance(f, Var)]]
            aggregates = []
            some = F.lit(False)
            self.note.add(notes.AGGREGATION, functions=" ".join(f.column for f in q.find if isinstance(f, Aggregate)), groups=len(groups))
            for i, (f, x) in enumerate(zip(q.find, cells, strict=True)):
                if isinstance(f, Var):
                    continue
                if f.fn in ("sum", "avg") and x.type not in ("long", "double", "any"):
                    raise QueryError(f"{f.fn} of {f.var.name}, which is no number")
                if f.where:
                    flag = self._value(f.where, rel, consts)
                    flag = flag.column["b"] if flag.type == "any" else flag.column if flag.type == "bool" else F.lit(False)
                    x = Typed(F.when(flag, x.column), x.type)
                some = some | (F.count(x.column) > 0)
                value = x.column if x.type != "any" else F.coalesce(x.column["i"].cast("double"), x.column["d"])
                made = {
                    "count": lambda v=value, x=x: F.count(x.column),
                    "count-distinct": lambda v=value, x=x: F.count_distinct(x.column),
                    "sum": lambda v=value: F.sum(v.cast("double")),
                    "avg": lambda v=value: F.avg(v.cast("double")),
                    "min": lambda x=x: F.min(x.column),
                    "max": lambda x=x: F.max(x.column),
                }[f.fn]()
                aggregates.append(made.alias(f"__f{i}"))
                types[i] = {"count": "long", "count-distinct": "long", "sum": "double", "avg": "double"}.get(f.fn, x.type)
            # a global aggregate of nothing is no row
            df = rel.df.groupBy(*groups).agg(*aggregates) if groups else rel.df.agg(*aggregates, F.count(F.lit(1)).alias("__n")).where("__n > 0")
            if any(isinstance(f, Aggregate) and f.where for f in q.find):  # a group in which no condition held is no row
                tested = rel.df.groupBy(*groups).agg(*aggregates, some.alias("__some")) if groups else rel.df.agg(*aggregates, some.alias("__some"))
                df = tested.where("__some")
            df = df.select(*[v.column for v in keep], *[f"__f{i}" for i in range(len(q.find))])
        else:
            df = rel.df.select(*named, *[x.column.alias(f"__f{i}") for i, x in enumerate(cells)])
            shown = {f for f in q.find if isinstance(f, Var)} | set(keep)
            if not rel.key <= shown:
                df = df.distinct()
        return df, types, [x.type for x in kept]

    def compile(self, q: Query, inputs: tuple) -> DataFrame:
        """The result of a query with its inputs (those of :in but `$`, in order)."""
        wanted = [i for i in q.inputs if i.kind != "database"]
        if len(inputs) != len(wanted):
            raise QueryError(f"{'not enough' if len(inputs) < len(wanted) else 'too many'} inputs: {len(inputs)} for {len(wanted)}")
        consts: dict[Var, Typed] = {}
        starts: list[Rel] = []
        per_tuple: tuple[Var, ...] = ()
        for spec, given in zip(wanted, inputs, strict=True):
            if spec.kind == "scalar":
                consts[spec.vars[0]] = literal(given)
            elif spec.kind == "tuple":
                if len(given) != len(spec.vars):
                    raise QueryError(f"a tuple of {len(spec.vars)} is wanted, not of {len(given)}")
                consts |= {v: literal(x) for v, x in zip(spec.vars, given, strict=True)}
            else:
                starts.append(self._input(spec, given))
                if spec.kind == "relation" and any(isinstance(f, Aggregate) for f in q.find):
                    per_tuple += spec.vars
        for v, _ in q.order_by:
            if v not in q.find:
                raise QueryError(f":order-by names {v.name}, which :find does not")
        hidden = tuple(v for v in per_tuple if v not in q.find)
        df, types, _ = self.run(q, consts, starts, hidden)
        if q.order_by:
            at = {f: i for i, f in enumerate(q.find)}
            df = df.orderBy(*[F.col(f"__f{at[v]}").desc_nulls_last() if d else F.col(f"__f{at[v]}").asc_nulls_first() for v, d in q.order_by])
        out = [self._shown(Typed(F.col(f"__f{i}"), t)).alias(f.column) for i, (f, t) in enumerate(zip(q.find, types, strict=True))]
        result = df.select(*out)
        return result.distinct() if hidden and not q.order_by else result

    def _shown(self, x: Typed) -> Column:
        return reference(x) if x.type.startswith("ref:") else text_of(x) if x.type == "any" else x.column

    def _input(self, spec, given) -> Rel:
        if isinstance(given, DataFrame):
            if len(given.columns) != len(spec.vars):
                raise QueryError(f"a relation of {len(spec.vars)} columns is wanted")
            from ..sources.catalog import typed

            cells = [typed(given, c) for c in given.columns]
            df = given.select(*[x.column.alias(v.column) for v, x in zip(spec.vars, cells, strict=True)]).distinct()
            return Rel(df, {v: x.type for v, x in zip(spec.vars, cells, strict=True)}, frozenset(spec.vars), free=True)
        rows = [(x,) if spec.kind == "collection" else tuple(x) for x in given]
        if any(len(r) != len(spec.vars) for r in rows):
            raise QueryError(f"rows of {len(spec.vars)} values are wanted")
        kinds = [{literal(r[i]).type for r in rows} for i in range(len(spec.vars))]
        types = [next(iter(k)) if len(k) == 1 else "double" if k == {"long", "double"} else "string" for k in kinds]
        rows = list(dict.fromkeys(tuple(_plain(x, t) for x, t in zip(r, types, strict=True)) for r in rows))
        arrow = {"long": pa.int64(), "double": pa.float64(), "bool": pa.bool_(), "time": pa.timestamp("us"), "binary": pa.binary()}
        schema = pa.schema([(v.column, arrow.get(t, pa.string())) for v, t in zip(spec.vars, types, strict=True)])
        # an Arrow table becomes a local relation: no Python worker, no shuffle
        columns = list(zip(*rows, strict=True)) or [()] * len(spec.vars)
        df = self.db.spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
        values = {v: list(dict.fromkeys(r[i] for r in rows)) for i, v in enumerate(spec.vars)} if len(rows) <= PUSHED_VALUES else None
        return Rel(F.broadcast(df) if len(rows) <= BROADCAST_INPUT else df, dict(zip(spec.vars, types, strict=True)), frozenset(spec.vars), free=True, values=values)


def _plain(x: object, kind: str) -> object:
    """A Python value as Arrow wants it for a column of this type."""
    if kind == "double":
        return float(x)
    if kind == "time" and x.tzinfo:
        return x.astimezone(dt.UTC).replace(tzinfo=None)
    return str(x) if kind in ("string", "keyword") or kind.startswith("ref:") else x
