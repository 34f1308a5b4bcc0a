"""Relations as sets of rows over named columns; every method is lazy unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..query import AGGREGATES, Pattern, Var, parse


class Relation:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def _need(self, columns: list[str]) -> list[str]:
        if missing := [c for c in columns if c not in self.columns]:
            raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(self.columns)}")
        return columns

    # rows
    def project(self, *columns: str) -> Relation:
        if not columns:
            raise ValueError("project needs a column")
        return Relation(self.df.select(*self._need(list(columns))).distinct())

    def project_pattern(self, pattern: Pattern | str) -> Relation:
        """The columns that a pattern's variables name, in the pattern's order; none: no rows and no columns."""
        if isinstance(pattern, str):
            pattern = parse(f"[:find ?_ :where {pattern}]").where[0]
        wanted = dict.fromkeys(t.column for t in (pattern.e, pattern.a, pattern.v) if isinstance(t, Var) and t.column in self.columns)
        return self.project(*wanted) if wanted else Relation(self.df.limit(0).select())

    def filter(self, test: Column | str) -> Relation:
        return Relation(self.df.where(test))

    select = filter

    def compare(self, column: str, op: str, other: object) -> Relation:
        """`other` is a value, or a column as F.col."""
        c = F.col(self._need([column])[0])
        return Relation(self.df.where({"=": c == other, "!=": c != other, "<": c < other, "<=": c <= other, ">": c > other, ">=": c >= other}[op]))

    def chain(self, op: str, *columns: str) -> Relation:
        """Adjacent pairs all hold."""
        out = self
        for a, b in zip(columns, columns[1:], strict=False):
            out = out.compare(a, op, F.col(b))
        return out

    def evaluate(self, function: Callable[..., Column], columns: list[str], out: str) -> Relation:
        return Relation(self.df.withColumn(out, function(*[F.col(c) for c in self._need(columns)])))

    # joins
    def _common(self, other: Relation) -> list[str]:
        return [c for c in self.columns if c in other.columns]

    def join(self, other: Relation) -> Relation:
        """On all common columns; without any, the product."""
        on = self._common(other)
        return Relation(self.df.join(other.df, on, "inner") if on else self.df.crossJoin(other.df))

    def hash_join(self, other: Relation, columns: list[str]) -> Relation:
        """On `columns`; other common columns of `other` are left out. The result is a set."""
        twice = [c for c in self._common(other) if c not in columns]
        return Relation(self.df.join(other.df.drop(*twice), self._need(columns), "inner").distinct())

    def join_where(self, other: Relation, conditions: list[tuple[str, str, str]]) -> Relation:
        """(left column, operator, right column); column names must differ."""
        ops = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        tests = [getattr(self.df[a], ops[op])(other.df[b]) for a, op, b in conditions]
        return Relation(self.df.join(other.df, reduce(lambda a, b: a & b, tests), "inner"))

    def semi_join(self, other: Relation, columns: list[str]) -> Relation:
        return Relation(self.df.join(other.df, self._need(columns), "left_semi"))

    def anti_join(self, other: Relation, columns: list[str]) -> Relation:
        return Relation(self.df.join(other.df, self._need(columns), "left_anti"))

    def product(self, *others: Relation) -> Relation:
        return Relation(reduce(lambda a, b: a.crossJoin(b.df), others, self.df))

    # sets
    def distinct(self) -> Relation:
        return Relation(self.df.distinct())

    def concat(self, other: Relation) -> Relation:
        return Relation(self.df.unionByName(other.df))

    def union(self, other: Relation) -> Relation:
        if sorted(self.columns) != sorted(other.columns):
            raise ValueError("a union needs the same columns")
        return self.concat(other).distinct()

    # groups and order
    def aggregate(self, group: list[str], *aggregates: tuple[str, str]) -> Relation:
        """aggregates: (function, column) -> column `function_column`; a global aggregate of nothing has no row."""
        made = []
        for fn, c in aggregates:
            if fn not in AGGREGATES:
                raise ValueError(f"unknown aggregate {fn}")
            x = F.col(self._need([c])[0])
            value = {"sum": lambda x=x: F.sum(x.cast("double")), "avg": lambda x=x: F.avg(x.cast("double")), "count": lambda x=x: F.count(x), "min": lambda x=x: F.min(x), "max": lambda x=x: F.max(x), "count-distinct": lambda x=x: F.count_distinct(x)}[fn]()
            made.append(value.alias(f"{fn.replace('-', '_')}_{c}"))
        if group:
            return Relation(self.df.groupBy(*self._need(group)).agg(*made))
        return Relation(self.df.agg(*made, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n"))

    def aggregate_where(self, group: list[str], fn: str, column: str, where: Column, name: str) -> Relation:
        """A conditional aggregate: only rows where `where` is true count; a group without any is left out."""
        value = getattr(F, fn)(F.when(where, F.col(column)))
        n = F.count(F.when(where, F.col(column))).alias("__n")
        return Relation(self.df.groupBy(*group).agg(value.alias(name), n).where("__n > 0").drop("__n"))

    def sort(self, *by: str | tuple[str, bool]) -> Relation:
        """Columns, or (column, descending); nulls are least."""
        pairs = [(b, False) if isinstance(b, str) else b for b in by]
        self._need([c for c, _ in pairs])
        return Relation(self.df.orderBy(*[F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in pairs]))

    def sorted(self) -> Relation:
        return self.sort(*self.columns)

    # actions
    def materialize(self) -> Relation:
        return Relation(self.df.persist())

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def get(self, i: int) -> Row | None:
        rows = self.df.limit(i + 1).collect()
        return rows[i] if i < len(rows) else None

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    def table(self, limit: int = 1000) -> str:
        from ..fmt import markdown

        return markdown(self.df, limit)
