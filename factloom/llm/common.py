"""What the operators share: table access, the shared scratch folder, checked broadcasts, let-bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests on local[*]), a folder under /tmp/checkpoints is set; on any other
    master that would not be shared, so it is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = "/tmp/checkpoints/local"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed once and written to the shared folder; lineage ends there."""
    scratch(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, kind: str) -> str:
    return f"{scratch(spark)}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def broadcast_if(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """`df` with a broadcast hint if its counted rows are within the limit; else Spark's own choice
    (a shuffled join whose skewed partitions AQE splits)."""
    return F.broadcast(df) if rows <= limit else df


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until `df` has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row.

    Projections are merged by the optimizer, and an expression that is used inside a lambda would be
    evaluated for each element; a lambda's argument is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The array of words of a text (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of `rows` documents where the session has Spark's default of 10,000: texts are long, and
    a worker holds a batch in several forms."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
