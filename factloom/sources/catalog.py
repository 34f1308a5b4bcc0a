"""Tables as sets of facts: a row is an entity, a column an attribute `:table/column`."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.registry import Typed
from ..query import QueryError


def typed(df: DataFrame, name: str) -> Typed:
    """A column with its logical type; integers widen to bigint, floats to double."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return Typed(c.cast("bigint"), "long")
    if isinstance(kind, T.LongType):
        return Typed(c, "long")
    if isinstance(kind, T.FloatType):
        return Typed(c.cast("double"), "double")
    if isinstance(kind, (T.DoubleType, T.DecimalType)):
        return Typed(c if isinstance(kind, T.DoubleType) else c.cast("double"), "double")
    if isinstance(kind, T.BooleanType):
        return Typed(c, "bool")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Typed(c if not isinstance(kind, T.DateType) else c.cast("timestamp_ntz"), "time")
    if isinstance(kind, T.StringType):
        return Typed(c, "string")
    return Typed(c, "binary" if isinstance(kind, T.BinaryType) else "opaque")


@dataclass
class Table:
    """`key`: columns that identify a row; none: the row itself is the entity. `refs`: attribute -> (column,
    table it points to). `tx`: column that holds the transaction of a row."""

    name: str
    df: DataFrame
    key: tuple[str, ...] = ()
    prefix: str = ""
    refs: dict[str, tuple[str, str]] = field(default_factory=dict)
    tx: str | None = None

    def attributes(self) -> list[str]:
        return [c.removeprefix(self.prefix) for c in self.df.columns]

    def attribute(self, name: str) -> Typed | None:
        if name in self.refs:
            column, target = self.refs[name]
            return Typed(typed(self.df, column).column, f"ref:{target}")
        column = self.prefix + name
        return typed(self.df, column) if column in self.df.columns else None

    def entity(self) -> Typed:
        if len(self.key) == 1:
            return Typed(typed(self.df, self.key[0]).column, f"ref:{self.name}")
        if self.key:
            return Typed(F.concat_ws("/", *[F.col(k).cast("string") for k in self.key]), f"ref:{self.name}")
        raise QueryError(f"rows of {self.name} have no key: see identified")

    def identified(self, df: DataFrame) -> tuple[DataFrame, Typed]:
        """`df`, rows of this table, with a column for each row's entity.

        A row without a key is an entity of its own: its id is a hash of the row, and equal rows are numbered
        (`/2`, `/3`, ...). They are counted before they are numbered, so no task holds more than one of them
        at a time, however many there are.
        """
        if self.key:
            return df, self.entity()
        columns = [F.col(f"`{c}`") for c in df.columns]
        counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
        step = F.lit(1 << 16).cast("long")
        blocks = counted.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / step))))
        numbered = blocks.withColumn("__i", F.explode(F.sequence(F.col("__b") * step + 1, F.least("__n", (F.col("__b") + 1) * step))))
        own = F.sha1(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
        text = F.when(F.col("__i") == 1, own).otherwise(F.concat(own, F.lit("/"), F.col("__i").cast("string")))
        return numbered, Typed(text, f"ref:{self.name}")

    def entity_is(self, entity: Column, value: object) -> Column:
        """Test for a stated entity: `table:key`, or the key itself."""
        if isinstance(value, str) and value.startswith(self.name + ":"):
            value = value[len(self.name) + 1 :]
        return entity == F.lit(value) if not isinstance(value, str) or len(self.key) != 1 else entity.cast("string") == F.lit(value)


class Catalog:
    def __init__(self, tables: list[Table] = ()):
        self.tables = {t.name: t for t in tables}

    def add(self, table: Table) -> None:
        self.tables[table.name] = table

    def find(self, attribute: str) -> tuple[Table, Typed] | None:
        """The table and column of `:table/name`."""
        table, _, name = attribute.removeprefix(":").partition("/")
        if table not in self.tables:
            return None
        t = self.tables[table]
        if (x := t.attribute(name)) is None:
            raise QueryError(f"unknown attribute {attribute}; :{table} has {', '.join(sorted([*t.attributes(), *t.refs]))}")
        return t, x


#: Keys, prefixes and references of the star schema with an event stream.
_STAR = {
    "region": (("r_regionkey",), "r_", {}),
    "nation": (("n_nationkey",), "n_", {"region": ("n_regionkey", "region")}),
    "customer": (("c_custkey",), "c_", {"nation": ("c_nationkey", "nation")}),
    "supplier": (("s_suppkey",), "s_", {"nation": ("s_nationkey", "nation")}),
    "part": (("p_partkey",), "p_", {}),
    "orders": (("o_orderkey",), "o_", {"customer": ("o_custkey", "customer")}),
    "lineitem": ((), "l_", {"order": ("l_orderkey", "orders"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier")}),
    "events": (("event_id",), "", {}),
    "documents": (("doc_id",), "", {}),
    "embeddings": (("vec_id",), "", {}),
    "pages": (("page_id",), "", {}),
    "benchmark": (("item_id",), "", {}),
    "labels": (("doc_id",), "", {"document": ("doc_id", "documents")}),
    "conversations": (("conv_id", "turn"), "", {}),
}


#: Schemas of the files that were opened before.
_SCHEMAS: dict[str, T.StructType] = {}


def star(spark: SparkSession, folder: str) -> Catalog:
    """The catalog over the Parquet tables of a folder; files are opened when a query names their table."""

    class Lazy(dict):
        def __missing__(self, name: str) -> Table:
            key, prefix, refs = _STAR[name]
            path = f"{folder}/{name}.parquet"
            if path in _SCHEMAS:  # footers are read once a path
                df = spark.read.schema(_SCHEMAS[path]).parquet(path)
            else:
                df = spark.read.parquet(path)
                _SCHEMAS[path] = df.schema
            # rows of events are in the order of time: their transaction is the microsecond
            self[name] = Table(name, df, key, prefix, refs, tx="ts" if name == "events" else None)
            return self[name]

        def __contains__(self, name: object) -> bool:
            return name in _STAR or dict.__contains__(self, name)

    out = Catalog()
    out.tables = Lazy()
    return out
