"""Structured Streaming: a table of the catalog may be a stream, as the compiler emits plain DataFrame operators.

Selections, filters, expressions and joins with static tables run in append mode. Aggregates run in
complete or update mode, or in append mode under a watermark on their time bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..database import Database
from ..query import Query
from ..sources.catalog import Catalog, Table


def table_stream(spark: SparkSession, name: str, path: str, like: DataFrame, *, key: tuple[str, ...] = (), prefix: str = "", time: str | None = None, late: str = "10 minutes") -> Table:
    """A table that grows by Parquet files under `path`; `time` gets a watermark of `late`."""
    stream = spark.readStream.schema(like.schema).parquet(path)
    if time:
        if dict(stream.dtypes)[time] == "timestamp_ntz":
            stream = stream.withColumn(time, F.col(time).cast("timestamp"))
        stream = stream.withWatermark(time, late)
    return Table(name, stream, key, prefix)


def standing(spark: SparkSession, query: str | Query, tables: list[Table], sink: str, *inputs, mode: str = "append", once: bool = False) -> StreamingQuery:
    """Start `query` over the tables into the memory sink `sink`; with `once`, until all that is there is read."""
    writer = Database(spark, Catalog(tables)).q(query, *inputs).writeStream.outputMode(mode).format("memory").queryName(sink)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_memory(df: DataFrame, sink: str, mode: str) -> None:
    """Read all that is there of a stream into the table `sink` on the driver: for small aggregates."""
    df.writeStream.outputMode(mode).format("memory").queryName(sink).trigger(availableNow=True).start().awaitTermination()


def into_files(df: DataFrame, path: str) -> None:
    """Append all that is there of a stream to Parquet files under `path`; its checkpoints lie beside them."""
    df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path).awaitTermination()


def drained(spark: SparkSession, query: str | Query, tables: list[Table], path: str, *inputs) -> DataFrame:
    """The rows that a standing query in append mode has written under `path` once all that is there is read."""
    df = Database(spark, Catalog(tables)).q(query, *inputs)
    into_files(df, path)
    return spark.read.schema(df.schema).parquet(path)


def windowed(stream: DataFrame, time: str, width: str, group: list[str], value: str, slide: str | None = None) -> DataFrame:
    """count, sum, avg, min and max of `value` in windows of event time."""
    buckets = F.window(time, width, slide) if slide else F.window(time, width)
    v = F.col(value)
    return stream.groupBy(buckets.alias("window"), *group).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"))
