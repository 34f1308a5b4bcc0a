"""Generated price bars for benchmarks: symbols x days x bars of a day, made by the executors."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.registry import Typed
from .catalog import Catalog, Table
from .datoms import DatomLog, tagged


@dataclass(frozen=True)
class Bars:
    """`open` of a bar: base + per_symbol * symbol + per_day * day + per_bar * bar; the rest relative to it."""

    symbols: int = 10
    days: int = 30
    per_day_bars: int = 24
    minutes: int = 60  # between bars
    start: dt.datetime = dt.datetime(2024, 1, 1)
    base: float = 100.0
    per_symbol: float = 10.0
    per_day: float = 0.1
    per_bar: float = 0.01
    high: float = 2.0
    low: float = -1.5
    close: float = 0.5


#: Sizes of the published benchmarks.
DEFAULT = Bars()
MEDIUM = Bars(symbols=50)
LARGE = Bars(symbols=500, days=365, per_day_bars=390, minutes=1)
DAY_BENCH = Bars(symbols=3, days=10, per_day_bars=390, minutes=1, per_day=1.0, high=0.5, low=-0.3, close=0.2)


def price_rows(spark: SparkSession, c: Bars = DEFAULT) -> DataFrame:
    """bar_id, symbol_id, time, minute_of_day, open, high, low, close, volume; in the order of symbol, day, bar."""
    per_symbol = c.days * c.per_day_bars
    at = F.col("id")
    symbol, day, bar = F.floor(at / per_symbol), F.floor(at % per_symbol / c.per_day_bars), at % c.per_day_bars
    rows = spark.range(c.symbols * per_symbol).select(at.alias("bar_id"), symbol.alias("symbol_id"), day.alias("d"), bar.alias("b"))
    start = F.lit(c.start.isoformat(" ")).cast("timestamp_ntz")
    opened = F.lit(c.base) + F.col("symbol_id") * F.lit(c.per_symbol) + F.col("d") * F.lit(c.per_day) + F.col("b") * F.lit(c.per_bar)
    rows = rows.select("*", opened.alias("open"), F.make_dt_interval(days=F.col("d").cast("int"), mins=(F.col("b") * c.minutes).cast("int")).alias("after"))
    return rows.select(
        "bar_id", "symbol_id", (start + F.col("after")).alias("time"), (F.col("b") * c.minutes).alias("minute_of_day"),
        "open", (F.col("open") + c.high).alias("high"), (F.col("open") + c.low).alias("low"), (F.col("open") + c.close).alias("close"), (F.lit(1_000_000) + F.col("b") * 1000).alias("volume"),
    )


def catalog(spark: SparkSession, c: Bars = DEFAULT, prices: DataFrame | None = None) -> Catalog:
    """Tables `symbol` (ticker) and `price`, whose bars refer to symbols."""
    symbols = spark.range(c.symbols).select(F.col("id").alias("symbol_id"), F.format_string("SYM%04d", F.col("id")).alias("ticker"))
    return Catalog([Table("symbol", symbols, ("symbol_id",)), Table("price", price_rows(spark, c) if prices is None else prices, ("bar_id",), refs={"symbol": ("symbol_id", "symbol")})])


def log(spark: SparkSession, c: Bars = DEFAULT) -> DatomLog:
    """The same facts as datoms; a bar's transaction is its number."""
    kinds = {"open": "double", "high": "double", "low": "double", "close": "double", "volume": "long", "time": "time", "minute_of_day": "long", "symbol": "ref:"}
    cells = {k: Typed(F.col(k), t) for k, t in kinds.items() if k != "symbol"} | {"symbol": Typed(F.concat(F.lit("symbol:"), F.col("symbol_id").cast("string")), "ref:")}
    facts = F.array(*[F.struct(F.lit(f":price/{k}").alias("a"), tagged(x).alias("v")) for k, x in cells.items()])
    rows = price_rows(spark, c).select(F.concat(F.lit("price:"), F.col("bar_id").cast("string")).alias("e"), F.explode(facts).alias("f"), (F.col("bar_id") + 1).alias("tx"))
    return DatomLog(spark, df=rows.select("e", "f.a", "f.v", "tx", F.lit(True).alias("added")), types={f":price/{k}": t for k, t in kinds.items()})
