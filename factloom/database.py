"""The entry point: a database over tables and, if wanted, a datom log."""

from __future__ import annotations

import copy
import datetime as dt
from collections import OrderedDict
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from . import query as ast
from .annotations import COMPLETE, INVOKED, PARSED, PLANNED, Collector, Event
from .functions.registry import Registry, Typed
from .plans.compiler import Compiler
from .sources.catalog import Catalog, Table, star, typed
from .sources.datoms import DatomLog, Transaction

#: Plans that a database keeps.
PLANS = 200
_parsed = lru_cache(maxsize=1000)(ast.parse)


class Database:
    """`catalog`: tables as attributes; `path` or `log`: a datom log. Queries are EDN text or parsed."""

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, *, path: str | None = None, log: DatomLog | None = None, time_tx: bool = False):
        self.spark, self.catalog = spark, catalog or Catalog()
        self.log = log or (DatomLog(spark, path) if path or catalog is None else None)
        self.time_tx, self.tx, self.registry = time_tx, 0, Registry()
        self.collector: Collector | None = None
        self._plans: OrderedDict[tuple, DataFrame] = OrderedDict()
        self._plan_hits = self._plan_misses = 0

    @classmethod
    def over(cls, spark: SparkSession, folder: str) -> Database:
        return cls(spark, star(spark, folder))

    # -- queries

    def q(self, text: str | ast.Query, *inputs) -> DataFrame:
        """The lazy result. Plans over tables and logs in memory are kept (see `plan_cache`)."""
        note = self.collector or Collector()
        note.add(INVOKED, query=text if isinstance(text, str) else ast.format_query(text))
        with note.timed(PARSED):
            query = _parsed(text) if isinstance(text, str) else text
        key = None if self.log is not None and self.log.path else _plan_key(query, inputs, self.tx, self.registry.version, self.log.version if self.log else 0)
        if key in self._plans:
            self._plan_hits += 1
            self._plans.move_to_end(key)
            note.add(PLANNED, cached=True)
            return self._plans[key]
        self._plan_misses += 1
        with note.timed(PLANNED, cached=False) as data:
            out = Compiler(self, note).compile(query, inputs)
            data["variables"] = out.columns
        if key is not None:
            self._plans[key] = out
            while len(self._plans) > PLANS:
                self._plans.popitem(last=False)
        return out

    def many(self, text: str, *inputs) -> list[DataFrame]:
        """The results of several queries in one text; each gets the inputs."""
        return [self.q(query, *inputs) for query in ast.parse_many(text)]

    def run(self, text: str | ast.Query, *inputs) -> list[Row]:
        """The rows, on the driver; the collector learns their number and the time they took."""
        df = self.q(text, *inputs)
        with (self.collector or Collector()).timed(COMPLETE) as data:
            rows = df.collect()
            data["rows"] = len(rows)
        return rows

    def annotated(self, handler: Callable[[Event], None] | None = None) -> Database:
        """This database with a collector of events (`.collector.events`)."""
        out = copy.copy(self)
        out.collector = Collector(handler)
        return out

    def explain(self, text: str | ast.Query, *inputs, mode: str = "formatted") -> str:
        df = self.q(text, *inputs)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def register_function(self, name: str, build, *, returns: str | None = None) -> None:
        self.registry.register(name, build, returns=returns)

    def clear_plan_cache(self) -> None:
        _parsed.cache_clear()
        self._plans.clear()
        self._plan_hits = self._plan_misses = 0

    def plan_cache(self) -> dict[str, int]:
        return {"hits": self._plan_hits, "misses": self._plan_misses, "size": len(self._plans)}

    # -- time

    def as_of(self, tx: int | dt.datetime) -> Database:
        """The database as it was after transaction `tx` (0: now)."""
        out = copy.copy(self)
        out._plans = OrderedDict()
        if isinstance(tx, dt.datetime):
            zone = tx if tx.tzinfo else tx.replace(tzinfo=dt.UTC)
            tx = (zone - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
        out.tx = tx
        return out

    def table_tx(self, table: Table) -> Typed:
        x = typed(table.df, table.tx)
        return x if x.type == "long" else Typed(F.unix_micros(x.column.cast("timestamp")), "long")

    def rows(self, table: Table) -> DataFrame:
        if not self.tx or not table.tx:
            return table.df
        x = typed(table.df, table.tx)
        if x.type == "time":  # on the column itself, so that it is pushed down
            return table.df.where(x.column <= F.timestamp_micros(F.lit(self.tx)).cast("timestamp_ntz"))
        return table.df.where(x.column <= self.tx)

    # -- facts

    def transaction(self, at: dt.datetime | None = None) -> Transaction:
        if self.log is None:
            raise RuntimeError("this database has no datom log")
        return Transaction(self.log, self.time_tx, at)

    def datoms(self, attribute: str | None = None) -> DataFrame:
        return self.log.datoms(self.tx, attribute)

    def latest(self, attribute: str) -> DataFrame:
        """(e, v, tx): the last value of each entity."""
        rows = self.datoms(attribute).withColumn("v", self.log.value(attribute).column)
        return rows.groupBy("e").agg(F.max_by("v", F.struct("tx", "v")).alias("v"), F.max("tx").alias("tx"))

    def entity(self, e: str) -> DataFrame:
        return self.datoms().where(F.col("e") == e)

    def attribute(self, a: str) -> DataFrame:
        return self.datoms(a)

    def entity_attribute(self, e: str, a: str) -> DataFrame:
        return self.attribute(a).where(F.col("e") == e)

    def attribute_value(self, a: str, value) -> DataFrame:
        from .plans.compiler import equal, literal

        return self.attribute(a).where(equal(self.log.value(a), literal(value)))

    def get(self, e: str, a: str, value, tx: int) -> DataFrame:
        """The one fact, if it holds."""
        return self.attribute_value(a, value).where((F.col("e") == e) & (F.col("tx") == tx))

    def count(self, attribute: str | None = None) -> int:
        """Facts that hold, of one attribute or all."""
        return self.datoms(attribute).count()

    def time_range(self, start: int, end: int) -> DataFrame:
        """Facts of transactions in [start, end)."""
        return self.time_ranges([(start, end)])

    def time_ranges(self, ranges: list[tuple[int, int]], attribute: str | None = None) -> DataFrame:
        """Facts of transactions in any of the ranges [start, end). Ranges are joined where they overlap, so a
        fact comes once; they reach the scan as filters."""
        joined: list[list[int]] = []
        for start, end in sorted(ranges):
            if joined and start <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], end)
            else:
                joined.append([start, end])
        test = F.lit(False)
        for start, end in joined:
            test = test | ((F.col("tx") >= start) & (F.col("tx") < end))
        return self.datoms(attribute).where(test)

    def entity_time_range(self, e: str, start: int, end: int) -> DataFrame:
        return self.time_range(start, end).where(F.col("e") == e)

    def references(self, e: str) -> DataFrame:
        """Facts whose value is the entity."""
        return self.datoms().where((F.col("v.t") == 6) & (F.col("v.s") == e))

    def stats(self) -> DataFrame:
        """(attribute, facts, entities, transactions, first_tx, last_tx) of the facts that hold; entities and
        transactions are counted exactly."""
        return self.datoms().groupBy(F.col("a").alias("attribute")).agg(
            F.count("*").alias("facts"), F.count_distinct("e").alias("entities"), F.count_distinct("tx").alias("transactions"), F.min("tx").alias("first_tx"), F.max("tx").alias("last_tx")
        )


def _plan_key(query: ast.Query, inputs: tuple, *state) -> tuple | None:
    """What a plan depends on; None if an input cannot be a key."""

    def frozen(x):
        if isinstance(x, (list, tuple)):
            return (type(x).__name__, *map(frozen, x))
        return (type(x).__name__, x) if isinstance(x, (bool, int, float, str, bytes, dt.datetime)) else None

    made = tuple(map(frozen, inputs))
    return None if "None" in repr(made) and any(m is None or None in m for m in made) else (query, made, *state)
