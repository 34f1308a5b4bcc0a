"""The datom log: (e, a, v, tx) rows with a tagged value, transactions, and direct lookups."""

from __future__ import annotations

import datetime as dt
import hashlib
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..edn import Keyword
from ..functions.registry import Typed

VALUE = "struct<t:tinyint,s:string,i:bigint,d:double,b:boolean,ts:timestamp_ntz,bin:binary>"
SCHEMA = f"e string, a string, v {VALUE}, tx bigint, added boolean"
#: type -> (tag, field of the value)
TAGS = {"string": (0, "s"), "long": (1, "i"), "double": (2, "d"), "bool": (3, "b"), "time": (4, "ts"), "binary": (5, "bin"), "ref:": (6, "s"), "keyword": (7, "s")}
_BY_TAG = {tag: (kind, slot) for kind, (tag, slot) in TAGS.items()}


class Ref(str):
    """A value that names an entity."""

    __slots__ = ()


def type_of(value: Any) -> str:
    for kind, cls in (("bool", bool), ("long", int), ("double", float), ("ref:", Ref), ("keyword", Keyword), ("string", str), ("time", dt.datetime), ("binary", (bytes, bytearray))):
        if isinstance(value, cls):
            return kind
    raise TypeError(f"values of type {type(value).__name__} cannot be stored")


def cell(value: Any) -> tuple:
    """The tagged struct of a Python value; times with a zone are taken to UTC."""
    tag, slot = TAGS[type_of(value)]
    if isinstance(value, dt.datetime) and value.tzinfo:
        value = value.astimezone(dt.UTC).replace(tzinfo=None)
    if isinstance(value, str):
        value = str(value)
    return (tag, *(value if slot == s else None for s in ("s", "i", "d", "b", "ts", "bin")))


def tagged(x: Typed) -> Column:
    """A typed column as a tagged struct."""
    tag, slot = TAGS.get("ref:" if x.type.startswith("ref:") else x.type, TAGS["string"])
    value = x.column if x.type in TAGS else x.column.cast("string")
    if x.type.startswith("ref:") and x.type != "ref:":
        value = F.concat(F.lit(x.type[4:] + ":"), x.column.cast("string"))
    kinds = (("s", "string"), ("i", "bigint"), ("d", "double"), ("b", "boolean"), ("ts", "timestamp_ntz"), ("bin", "binary"))
    return F.struct(F.lit(tag).cast("tinyint").alias("t"), *[(value if s == slot else F.lit(None)).cast(k).alias(s) for s, k in kinds])


class DatomLog:
    """Facts in a Parquet dataset, or in memory.

    The dataset is partitioned by attribute, tag of the value and whether a row asserts. A pattern's attribute
    prunes partitions, and the folder names alone tell the type of each attribute and whether it has
    retractions: a query starts no job before it runs. Transaction ids are taken by creating a file that must
    not exist, so two writers never share one.

    A log over `df` (SCHEMA) may state `types` (attribute -> type) and `retracted` (attributes with
    retractions); what is not stated is looked up once, in one job.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, df: DataFrame | None = None, *, types: dict[str, str] | None = None, retracted: frozenset[str] | None = None):
        self.spark, self.path, self._df = spark, path, df
        self._rows: list[tuple] = []  # of transactions in memory
        self._written: DataFrame | None = None
        self._tags: dict[str, set[int]] | None = {} if df is None else None
        self._retracted: set[str] | None = set() if df is None else None
        if df is not None and types is not None:
            self._tags = {a: {TAGS[t][0]} if t in TAGS else {-1, -2} for a, t in types.items()}
            self._retracted = set(retracted or ())
        self.version = 0

    # -- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _folders(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []

    def _look(self) -> None:
        """Tags and retractions of each attribute, from folder names or, for a foreign `df`, by one job."""
        if self.path:
            tags: dict[str, set[int]] = {}
            gone: set[str] = set()
            for folder in self._folders(self.path):
                if not folder.startswith("attribute="):
                    continue
                a = unquote(folder.removeprefix("attribute="))
                for kind in self._folders(f"{self.path}/{folder}"):
                    tags.setdefault(a, set()).add(int(kind.removeprefix("kind=")))
                    if "asserts=false" in self._folders(f"{self.path}/{folder}/{kind}"):
                        gone.add(a)
            self._tags, self._retracted = tags, gone
        elif self._tags is None or self._retracted is None:
            seen = self._df.groupBy("a").agg(F.collect_set("v.t").alias("t"), F.bool_or(~F.col("added")).alias("gone")).collect()
            self._tags = {r["a"]: set(r["t"]) for r in seen}
            self._retracted = {r["a"] for r in seen if r["gone"]}
            for a, (tags, gone) in self._held().items():
                self._tags.setdefault(a, set()).update(tags)
                self._retracted |= {a} if gone else set()

    def _held(self) -> dict[str, tuple[set[int], bool]]:
        out: dict[str, tuple[set[int], bool]] = {}
        for _, a, v, _, added in self._rows:
            tags, gone = out.get(a, (set(), False))
            out[a] = (tags | {v[0]}, gone or not added)
        return out

    # -- reading

    def raw(self) -> DataFrame:
        """All rows as SCHEMA, retractions too."""
        if self.path:
            if not self._folders(self.path):
                return self.spark.createDataFrame([], SCHEMA)
            rows = self.spark.read.schema(f"{SCHEMA}, attribute string, kind int, asserts boolean").parquet(self.path)
            return rows.select("e", F.col("attribute").alias("a"), "v", "tx", F.col("asserts").alias("added"))
        if self._written is None and self._rows:
            self._written = self.spark.createDataFrame(self._rows, SCHEMA)
        parts = [df for df in (self._df, self._written) if df is not None]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMA)

    def datoms(self, as_of: int = 0, attribute: str | None = None) -> DataFrame:
        """(e, a, v, tx): what was asserted up to `as_of` (0: ever) and not retracted in a later transaction.

        A transaction's retractions come before its assertions. Only attributes that have retractions are
        shuffled; `attribute` names the one that is wanted, if it is known.
        """
        rows = self.raw()
        if attribute is not None:
            rows = rows.where(F.col("a") == attribute)
        if as_of:
            rows = rows.where(F.col("tx") <= as_of)
        self._look()
        wanted = sorted(self._retracted if attribute is None else self._retracted & {attribute})
        columns = ["e", "a", "v", "tx"]
        if not wanted:
            return rows.select(*columns)
        touched = F.col("a").isin(wanted)
        mine = rows.where(touched)
        gone = mine.where(~F.col("added")).groupBy("e", "a", "v").agg(F.max("tx").alias("gone"))
        kept = mine.where("added").join(gone, ["e", "a", "v"], "left").where(F.col("gone").isNull() | (F.col("tx") >= F.col("gone"))).select(*columns)
        return kept if attribute is not None else rows.where(~touched).select(*columns).unionByName(kept)

    def types(self) -> dict[str, str]:
        """Type of each attribute's values; `any` where they differ."""
        self._look()
        return {a: _BY_TAG[next(iter(t))][0] if len(t) == 1 else "any" for a, t in self._tags.items()}

    def value(self, attribute: str) -> Typed:
        kind = self.types().get(attribute, "any")
        return Typed(F.col("v") if kind == "any" else F.col("v")[TAGS[kind][1]], kind)

    # -- writing

    def next_tx(self) -> int:
        """An id that no other transaction has."""
        if not self.path:
            own = max((r[3] for r in self._rows), default=0)
            return max(own, (self._df.agg(F.max("tx")).first()[0] or 0) if self._df is not None and not self._rows else 0) + 1
        fs, folder = self._fs(f"{self.path}/_tx")
        taken = [int(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
        tx = max(taken, default=0)
        if not taken and self._folders(self.path):
            tx = self.raw().agg(F.max("tx")).first()[0] or 0  # a log that began with times
        while True:
            tx += 1
            if self.take(tx):
                return tx

    def take(self, tx: int) -> bool:
        """Whether nobody had taken this id."""
        if not self.path:
            return True
        fs, p = self._fs(f"{self.path}/_tx/{tx:020d}")
        return bool(fs.createNewFile(p))

    def append(self, rows: list[tuple]) -> None:
        if self.path:
            batch = self.spark.createDataFrame(rows, SCHEMA)
            marked = batch.withColumns({"attribute": F.col("a"), "kind": F.col("v.t").cast("int"), "asserts": F.col("added")})
            marked.write.mode("append").partitionBy("attribute", "kind", "asserts").parquet(self.path)
        else:
            self._rows += rows
            self._written = None
            if self._tags is not None:
                for _, a, v, _, added in rows:
                    self._tags.setdefault(a, set()).add(v[0])
                    if not added:
                        self._retracted.add(a)
        self.version += 1


class Transaction:
    """Facts that are written together: retractions, then assertions, then the transaction's own instant."""

    def __init__(self, log: DatomLog, time_tx: bool = False, at: dt.datetime | None = None):
        self.log, self.at, self.time_tx = log, at, time_tx or at is not None
        self._add: list[tuple[str, str, Any]] = []
        self._gone: list[tuple[str, str, Any]] = []
        self._open = True

    def set_time(self, at: dt.datetime) -> None:
        self.at, self.time_tx = at, True

    def _check(self) -> None:
        if not self._open:
            raise RuntimeError("the transaction has ended")

    def add(self, e: str, a: str, v: Any) -> None:
        self._check()
        type_of(v)
        self._add.append((e, a, v))

    def add_entity(self, e: str, facts: dict[str, Any]) -> str:
        for a, v in facts.items():
            self.add(e, a, v)
        return e

    def add_map(self, facts: dict[str, Any]) -> str:
        """Assert facts of a new entity; its id is derived from them."""
        return self.add_entity("id:" + hashlib.sha1(repr(sorted(facts.items(), key=str)).encode()).hexdigest(), facts)

    def retract(self, e: str, a: str, v: Any) -> None:
        self._check()
        self._gone.append((e, a, v))

    def commit(self) -> int:
        """Write one batch; returns the transaction id (microseconds since 1970 with time transactions)."""
        self._check()
        now = self.at or dt.datetime.now(dt.UTC)
        if now.tzinfo is None:
            now = now.replace(tzinfo=dt.UTC)
        if self.time_tx:
            tx = (now - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(microseconds=1)
            while not self.log.take(tx) and self.at is None:  # a stated time may be shared
                tx += 1
        else:
            tx = self.log.next_tx()
        rows = [(e, a, cell(v), tx, False) for e, a, v in self._gone] + [(e, a, cell(v), tx, True) for e, a, v in self._add]
        rows.append((f"tx:{tx}", ":db/txInstant", cell(now), tx, True))
        self.log.append(rows)
        self._open = False
        return tx

    def rollback(self) -> None:
        self._check()
        self._open, self._add, self._gone = False, [], []

