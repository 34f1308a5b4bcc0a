"""Named queries of the datom log, the database API, the relation API, streams and errors, each with SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fmt, query
from .database import Database
from .edn import EdnError
from .functions.registry import Typed
from .operators.relation import Relation
from .scratch import shared_folder
from .sources import ohlc
from .sources.catalog import Catalog, Table
from .sources.datoms import DatomLog, Ref, tagged
from .streaming import live
from .workloads import _api, _datalog, _event_log, _rel, _round


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# -- language

_datalog(
    "eq_binds", "SELECT DISTINCT p_name AS name, p_size AS size, p_size AS same FROM part",
    "[:find ?name ?size ?same :where [?p :part/name ?name] [?p :part/size ?size] [(= ?same ?size)]]",
)
_datalog(
    "eq_binds_constant", "SELECT DISTINCT n_name AS name, 5 AS x FROM nation",
    "[:find ?name ?x :where [?n :nation/name ?name] [(= ?x 5)]]",
)
_datalog(
    "pred_ground", "SELECT n_name AS name FROM nation",
    "[:find ?name :where [?n :nation/name ?name] [(ground ?name)]]",
)
_datalog(
    "pred_missing", "SELECT n_name AS name FROM nation WHERE false",
    "[:find ?name :where [?n :nation/name ?name] [(missing ?name)]]",
)
_datalog(
    "pred_missing_holds", "SELECT n_name AS name FROM nation",
    "[:find ?name :where [?n :nation/name ?name] [(missing ?never)]]",
)
_datalog(
    "str_of_numbers",
    """SELECT DISTINCT p_partkey AS k, p_size || 'e+06 ' || p_size || '.5 ' || p_size || 'e-06' AS x FROM part WHERE p_size IN (1, 2, 4, 8)""",
    "[:find ?k ?x :in $ [?s ...] :where [?p :part/partkey ?k] [?p :part/size ?s] [(* ?s 1000000.0) ?a] [(+ ?s 0.5) ?b] [(* ?s 0.000001) ?c] [(str ?a \" \" ?b \" \" ?c) ?x]]", [1, 2, 4, 8],
)
_datalog(
    "find_text_numbers", "SELECT DISTINCT n_name AS name, n_nationkey + 0.5::DOUBLE AS x FROM nation",
    '[:find ?name ?x :where [?n :nation/name ?name] [?n :nation/nationkey ?k] [(+ ?k "0.5") ?x]]',
)
_datalog(
    "tuple_of_keys", "SELECT n_name AS name, c AS n FROM nation JOIN (SELECT s_nationkey AS k, count(*) AS c FROM supplier GROUP BY 1) ON k = n_nationkey",
    "[:find ?name ?n :where [?x :nation/name ?name] [(q [:find (count ?s) :in $ ?k :where [?s :supplier/nation ?k]] $ ?x) [[?n]]]]",
)
_datalog(
    "agg_if", "SELECT l_returnflag AS flag, sum(l_quantity) FILTER (WHERE l_discount > 0.05) AS sum_q_if_big, count(*) AS count_l FROM lineitem GROUP BY 1",
    "[:find ?flag (sum ?q :if ?big) (count ?l) :where [?l :lineitem/returnflag ?flag] [?l :lineitem/quantity ?q] [?l :lineitem/discount ?d] [(over5 ?d) ?big]]",
    functions={"over5": (lambda d: d > 0.05, "bool")},
)
_datalog(
    "own_functions", "SELECT DISTINCT p_name AS name, p_size * 2 AS twice FROM part WHERE p_size % 2 = 0",
    "[:find ?name ?twice :where [?p :part/name ?name] [?p :part/size ?s] [(even? ?s)] [(twice ?s) ?twice]]",
    functions={"even?": (lambda s: s % 2 == 0, None), "twice": (lambda s: s * 2, "long")},
)
_datalog(
    "in_collection_join", "SELECT DISTINCT c_name AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM nation WHERE n_nationkey IN (1, 3, 5)) AND n_nationkey IN (1, 3, 5)",
    "[:find ?c ?n :in $ [?k ...] :where [?x :nation/nationkey ?k] [?x :nation/name ?n] [?y :customer/nation ?x] [?y :customer/name ?c]]", [1, 3, 5],
)


@_api("tx_constant", "SELECT event_id AS i, event_type AS x FROM events WHERE event_id = 3")
def tx_constant(spark: SparkSession, folder: str) -> DataFrame:
    """What was asserted by one stated transaction."""
    db = Database.over(spark, folder)
    tx = db.run("[:find ?tx :where [?e :events/event_id 3 ?tx]]")[0]["tx"]
    return db.q(f"[:find ?i ?x :where [?e :events/event_id ?i {tx}] [?e :events/event_type ?x]]")


@_api("order_is_kept", "SELECT row_number() OVER (ORDER BY s DESC, b) AS at, s, b FROM (SELECT DISTINCT p_size AS s, p_brand AS b FROM part)")
def order_is_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of a sorted result with the places at which they came."""
    rows = Database.over(spark, folder).run("[:find ?s ?b :where [?p :part/size ?s] [?p :part/brand ?b] :order-by [[?s :desc] ?b]]")
    return _values(spark, [(i, *r) for i, r in enumerate(rows, 1)], "at long, s long, b string")


@_api("many_queries", "SELECT 0 AS query, r_name AS name FROM region UNION ALL SELECT 1, n_name FROM nation")
def many_queries(spark: SparkSession, folder: str) -> DataFrame:
    first, second = Database.over(spark, folder).many("[:find ?name :where [_ :region/name ?name]] [:find ?name :where [_ :nation/name ?name]]")
    return first.select(F.lit(0).alias("query"), "name").unionByName(second.select(F.lit(1).alias("query"), "name"))


@_api("formatted_query", "SELECT n_name AS nation, max(c_acctbal) AS hi FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_nationkey > 3 GROUP BY n_nationkey, n_name")
def formatted_query(spark: SparkSession, folder: str) -> DataFrame:
    """A query that went through the formatter and the parser again."""
    text = "[:find ?nation ?hi :in $ ?least :where [?n :nation/name ?nation] [?n :nation/nationkey ?i] [(> ?i ?least)] [(q [:find (max ?b) :in $ ?k :where [?x :customer/nation ?k] [?x :customer/acctbal ?b]] $ ?n) [[?hi]]]]"
    return Database.over(spark, folder).q(query.format_query(query.parse(text)), 3)


#: (case, query, inputs, error)
REJECTED = (
    ("no find", "[:find :where [?n :nation/name ?x]]", (), "QueryError"),
    ("no where", "[:find ?x]", (), "QueryError"),
    ("open vector", "[:find ?x :where [?n :nation/name ?x]", (), "QueryError"),
    ("pattern of two", "[:find ?x :where [?n :nation/name] [?n ?x]]", (), "QueryError"),
    ("unbound in find", "[:find ?z :where [?n :nation/name ?x]]", (), "QueryError"),
    ("unknown attribute", "[:find ?x :where [?n :nation/colour ?x]]", (), "QueryError"),
    ("unknown function", "[:find ?x :where [?n :nation/name ?x] [(frob ?x)]]", (), "QueryError"),
    ("unknown aggregate", "[:find (median ?x) :where [?n :nation/nationkey ?x]]", (), "QueryError"),
    ("sum of text", "[:find (sum ?x) :where [?n :nation/name ?x]]", (), "QueryError"),
    ("part of a time as a test", "[:find ?x :where [?e :events/ts ?x] [(year ?x)]]", (), "QueryError"),
    ("unbound in a test", "[:find ?x :where [?n :nation/name ?x] [(> ?x ?y)]]", (), "QueryError"),
    ("order by another", "[:find ?x :where [?n :nation/name ?x] :order-by [?n]]", (), "QueryError"),
    ("too few inputs", "[:find ?x :in $ ?k :where [?n :nation/nationkey ?k] [?n :nation/name ?x]]", (), "QueryError"),
    ("too many inputs", "[:find ?x :where [?n :nation/name ?x]]", (1,), "QueryError"),
    ("arguments of a subquery", "[:find ?x ?y :where [?n :nation/name ?x] [(q [:find (count ?c) :in $ ?k :where [?c :customer/nation ?k]] $) [[?y]]]]", (), "QueryError"),
    ("unlinked groups", "[:find ?x ?y :where [?n :nation/name ?x] [?r :region/name ?y]]", (), "CartesianProductError"),
    ("collection of a subquery", "[:find ?x ?y :where [?n :nation/name ?x] [(q [:find ?r :where [_ :region/name ?r]] $) ?y]]", (), "NotImplementedError"),
)


@_api("rejected", f"SELECT * FROM (VALUES {', '.join(f"""('{c}', '{e}')""" for c, _, _, e in REJECTED)}) v(\"case\", error)")
def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """What each wrong query is answered with, before any job runs."""
    db, rows = Database.over(spark, folder), []
    for case, text, inputs, _ in REJECTED:
        try:
            db.q(text, *inputs)
            rows.append((case, "none"))
        except (ValueError, NotImplementedError, EdnError) as e:
            rows.append((case, type(e).__name__))
    return _values(spark, rows, "case string, error string")


@_api("tuple_guard", "SELECT 'a tuple binding expects one result' AS error")
def tuple_guard(spark: SparkSession, folder: str) -> DataFrame:
    wanted = "a tuple binding expects one result"
    try:
        Database.over(spark, folder).run("[:find ?v :where [(q [:find ?x :where [_ :region/name ?x]] $) [[?v]]]]")
        found = "none"
    except Exception as e:
        found = wanted if wanted in str(e) else str(e)
    return _values(spark, [(found,)], "error string")


@_api("events_of_a_query", "SELECT * FROM (VALUES ('query/invoked', 1), ('query/parsed', 1), ('pattern/scan', 2), ('join/natural', 1), ('aggregation', 1), ('query/planned', 1), ('query/complete', 1)) v(event, n)")
def events_of_a_query(spark: SparkSession, folder: str) -> DataFrame:
    db = Database.over(spark, folder).annotated()
    db.run("[:find ?r (count ?n) :where [?n :nation/region ?x] [?x :region/name ?r]]")
    names = [e.name for e in db.collector.events]
    return _values(spark, [(n, names.count(n)) for n in dict.fromkeys(names)], "event string, n int")


@_api("plan_cache", "SELECT 2 AS hits, 2 AS misses, 2 AS size")
def plan_cache(spark: SparkSession, folder: str) -> DataFrame:
    db = Database.over(spark, folder)
    for least in (1, 2, 1, 2):
        db.q("[:find ?x :in $ ?k :where [?n :nation/nationkey ?k] [?n :nation/name ?x]]", least)
    c = db.plan_cache()
    return _values(spark, [(c["hits"], c["misses"], c["size"])], "hits int, misses int, size int")


@_api("markdown", "SELECT unnest(['| name |', '| --- |']) AS line UNION ALL SELECT '| ' || r_name || ' |' FROM region UNION ALL SELECT unnest(['', '_5 rows_', ''])")
def markdown(spark: SparkSession, folder: str) -> DataFrame:
    text = fmt.markdown(Database.over(spark, folder).q("[:find ?name :where [_ :region/name ?name]]"))
    return _values(spark, [(x,) for x in text.split("\n")], "line string")


# -- rows without a key


def _acts(spark: SparkSession, folder: str) -> Database:
    """A table of few columns, so that many of its rows are equal."""
    df = Database.over(spark, folder).catalog.tables["events"].df.select("user_id", "event_type")
    return Database(spark, Catalog([Table("act", df)]))


@_api("keyless_rows", "SELECT user_id AS u, event_type AS t, count(*) AS n FROM events GROUP BY 1, 2")
def keyless_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Equal rows are entities apart: each is found once under its own id."""
    found = _acts(spark, folder).q("[:find ?e ?u ?t :where [?e :act/user_id ?u] [?e :act/event_type ?t]]")
    return found.distinct().groupBy("u", "t").agg(F.count("*").alias("n"))


@_api("keyless_count", "SELECT event_type AS t, count(*) AS count_e FROM events GROUP BY 1")
def keyless_count(spark: SparkSession, folder: str) -> DataFrame:
    return _acts(spark, folder).q("[:find ?t (count ?e) :where [?e :act/event_type ?t]]")


@_api("keyless_count_distinct", "SELECT event_type AS t, count(*) AS count_distinct_e FROM events GROUP BY 1")
def keyless_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The ids that are shown agree with the rows that are counted."""
    return _acts(spark, folder).q("[:find ?t (count-distinct ?e) :where [?e :act/event_type ?t]]")


# -- the datom log

_NATION = "'nation:' || n_nationkey"


def _written(spark: SparkSession, folder: str) -> tuple[Database, dict[str, int]]:
    """Facts of nations in four transactions: all asserted, region 0 retracted, region 1 retracted and asserted
    again together with a changed name, and one rolled back."""
    nations = sorted(tuple(r) for r in Database.over(spark, folder).run("[:find ?k ?n ?r :where [?x :nation/nationkey ?k] [?x :nation/name ?n] [?x :nation/regionkey ?r]]"))
    db, at = Database(spark), {}
    t = db.transaction()
    for k, n, r in nations:
        t.add_entity(f"nation:{k}", {":nation/name": n, ":nation/regionkey": r})
    at["all"] = t.commit()
    t = db.transaction()
    for k, n, r in nations:
        if r == 0:
            t.retract(f"nation:{k}", ":nation/name", n)
    at["gone"] = t.commit()
    t = db.transaction()
    for k, n, r in nations:
        if r == 1:
            t.retract(f"nation:{k}", ":nation/name", n)
            t.add(f"nation:{k}", ":nation/name", n)
            t.add(f"nation:{k}", ":nation/former", n.lower())
    at["again"] = t.commit()
    t = db.transaction()
    t.add("nation:0", ":nation/name", "NOWHERE")
    t.rollback()
    return db, at


@_api("log_assert", f"SELECT {_NATION} AS e, n_regionkey AS r FROM nation")
def log_assert(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder)[0].q("[:find ?e ?r :where [?e :nation/regionkey ?r]]")


@_api("log_retract", f"SELECT {_NATION} AS e, n_name AS n FROM nation WHERE n_regionkey <> 0")
def log_retract(spark: SparkSession, folder: str) -> DataFrame:
    return _written(spark, folder)[0].q("[:find ?e ?n :where [?e :nation/name ?n]]")


@_api("log_retract_as_of", f"SELECT {_NATION} AS e, n_name AS n FROM nation")
def log_retract_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Before the retraction all facts hold."""
    db, at = _written(spark, folder)
    return db.as_of(at["all"]).q("[:find ?e ?n :where [?e :nation/name ?n]]")


@_api("log_retract_assert", f"SELECT {_NATION} AS e, n_name AS n, lower(n_name) AS former FROM nation WHERE n_regionkey = 1")
def log_retract_assert(spark: SparkSession, folder: str) -> DataFrame:
    """A fact that one transaction retracts and asserts holds."""
    return _written(spark, folder)[0].q("[:find ?e ?n ?former :where [?e :nation/name ?n] [?e :nation/former ?former]]")


@_api("log_retract_many", """
WITH g AS (SELECT user_id, event_type, max(event_id) AS gone FROM events WHERE value < 30 GROUP BY 1, 2)
SELECT 'user:' || e.user_id AS u, e.event_type AS x, count(*) AS n FROM events e LEFT JOIN g USING (user_id, event_type)
WHERE e.value >= 30 AND (gone IS NULL OR e.event_id >= gone) GROUP BY 1, 2""")
def log_retract_many(spark: SparkSession, folder: str) -> DataFrame:
    """Each event asserts its user's action, or retracts it where its value is below 30."""
    e = Database.over(spark, folder).catalog.tables["events"].df
    rows = e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("e"), F.lit(":user/action").alias("a"), tagged(Typed(F.col("event_type"), "string")).alias("v"), F.col("event_id").alias("tx"), (F.col("value") >= 30).alias("added"))
    db = Database(spark, log=DatomLog(spark, df=rows, types={":user/action": "string"}, retracted=frozenset([":user/action"])))
    return db.q("[:find ?u ?x ?tx :where [?u :user/action ?x ?tx]]").groupBy("u", "x").agg(F.count("*").alias("n"))


@_api("log_add_map", "SELECT r_name AS name, 'region:' || r_regionkey AS r FROM region")
def log_add_map(spark: SparkSession, folder: str) -> DataFrame:
    db = Database(spark)
    t = db.transaction()
    for r in _rel(spark, folder, "region").df.collect():
        t.add_map({":made/name": r["r_name"], ":made/of": Ref(f"region:{r['r_regionkey']}")})
    t.commit()
    return db.q("[:find ?name ?r :where [?x :made/name ?name] [?x :made/of ?r]]")


@_api("log_time_tx", "SELECT k AS d, k * 2.0::DOUBLE AS c FROM range(1, 4) t(k)")
def log_time_tx(spark: SparkSession, folder: str) -> DataFrame:
    """Transactions are times: as of the 3rd of January, three of five days are known."""
    db = Database(spark, time_tx=True)
    for day in range(1, 6):
        t = db.transaction(dt.datetime(2024, 1, day))
        t.add(f"day:{day}", ":day/number", day)
        t.add(f"day:{day}", ":day/close", day * 2.0)
        t.commit()
    return db.as_of(dt.datetime(2024, 1, 3, 12)).q("[:find ?d ?c :where [?x :day/number ?d] [?x :day/close ?c]]")


@_api("log_tx_constant", "SELECT 'user:' || user_id AS u, event_type AS x FROM events WHERE event_id = 77")
def log_tx_constant(spark: SparkSession, folder: str) -> DataFrame:
    return _event_log(spark, folder).q("[:find ?u ?x :where [?u :user/action ?x 77]]")


@_api("log_any_attribute", "SELECT DISTINCT ':user/action' AS a, event_type AS v FROM events WHERE user_id = 5 UNION ALL SELECT ':user/value' AS a, count(DISTINCT value)::VARCHAR FROM events WHERE user_id = 5")
def log_any_attribute(spark: SparkSession, folder: str) -> DataFrame:
    """All facts of an entity; of the numbers only how many there are."""
    found = _event_log(spark, folder).q('[:find ?a ?v :where ["user:5" ?a ?v]]')
    numbers = found.where("a = ':user/value'").groupBy("a").agg(F.count("*").cast("string").alias("v"))
    return found.where("a = ':user/action'").unionByName(numbers)


def _shown(db: Database, rows: DataFrame) -> DataFrame:
    """Facts with their value as text."""
    return rows.select("e", "a", F.coalesce("v.s", F.round("v.d", 4).cast("string")).alias("v"), "tx")


_FACTS = """(SELECT 'user:' || user_id AS e, ':user/action' AS a, event_type AS v, event_id AS tx FROM events
  UNION ALL SELECT 'user:' || user_id, ':user/value', round(value, 4)::VARCHAR, event_id FROM events)"""


@_api("log_entity", f"SELECT * FROM {_FACTS} WHERE e = 'user:7'")
def log_entity(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.entity("user:7"))


@_api("log_attribute", f"SELECT * FROM {_FACTS} WHERE a = ':user/action'")
def log_attribute(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.attribute(":user/action"))


@_api("log_entity_attribute", f"SELECT * FROM {_FACTS} WHERE e = 'user:7' AND a = ':user/value'")
def log_entity_attribute(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.entity_attribute("user:7", ":user/value"))


@_api("log_attribute_value", f"SELECT * FROM {_FACTS} WHERE a = ':user/action' AND v = 'purchase'")
def log_attribute_value(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.attribute_value(":user/action", "purchase"))


@_api("log_get", f"SELECT * FROM {_FACTS} WHERE tx = 100 AND a = ':user/action'")
def log_get(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    r = db.attribute(":user/action").where("tx = 100").select("e", "v.s").first()
    return _shown(db, db.get(r["e"], ":user/action", r["s"], 100))


@_api("log_count", "SELECT count(*) AS n FROM events")
def log_count(spark: SparkSession, folder: str) -> DataFrame:
    return _values(spark, [(_event_log(spark, folder).count(":user/action"),)], "n long")


@_api("log_time_range", f"SELECT * FROM {_FACTS} WHERE tx >= 100 AND tx < 300")
def log_time_range(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.time_range(100, 300))


@_api("log_time_ranges", f"SELECT * FROM {_FACTS} WHERE tx >= 10 AND tx < 40 OR tx >= 500 AND tx < 520")
def log_time_ranges(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.time_ranges([(10, 30), (20, 40), (500, 520)]))


@_api("log_entity_time_range", f"SELECT * FROM {_FACTS} WHERE e = 'user:7' AND tx >= 100 AND tx < 900")
def log_entity_time_range(spark: SparkSession, folder: str) -> DataFrame:
    db = _event_log(spark, folder)
    return _shown(db, db.entity_time_range("user:7", 100, 900))


@_api("log_references", "SELECT 'price:' || (240 + b) AS e, 241 + b AS tx FROM range(0, 240) t(b)")
def log_references(spark: SparkSession, folder: str) -> DataFrame:
    db = Database(spark, log=ohlc.log(spark, ohlc.Bars(symbols=3, days=10)))
    return db.references("symbol:1").select("e", "tx")


@_api("log_stats", f"SELECT a AS attribute, count(*) AS facts, count(DISTINCT e) AS entities, count(DISTINCT tx) AS transactions, min(tx) AS first_tx, max(tx) AS last_tx FROM {_FACTS} GROUP BY 1")
def log_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _event_log(spark, folder).stats()


@_api("log_files", "SELECT n_name AS n, n_regionkey AS r FROM nation WHERE n_regionkey > 1 AND n_nationkey > 4")
def log_files(spark: SparkSession, folder: str) -> DataFrame:
    """A log in files: facts written by two transactions, one retracted, the last write read back."""
    path = shared_folder(spark, "log")
    db = Database(spark, path=path)
    nations = Database.over(spark, folder).run("[:find ?k ?n ?r :where [?x :nation/nationkey ?k] [?x :nation/name ?n] [?x :nation/regionkey ?r]]")
    t = db.transaction()
    for k, n, r in nations:
        t.add_entity(f"nation:{k}", {":nation/name": n, ":nation/regionkey": r})
    t.commit()
    t = db.transaction()
    for k, n, _ in nations:
        if k <= 4:
            t.retract(f"nation:{k}", ":nation/name", n)
    t.commit()
    rows = Database(spark, path=path).run("[:find ?n ?r :where [?e :nation/name ?n] [?e :nation/regionkey ?r] [(> ?r 1)]]")
    return _values(spark, [tuple(r) for r in rows], "n string, r long")


# -- generated bars

_BARS = """(SELECT s, d, b, 100.0::DOUBLE + s * 10.0::DOUBLE + d * 0.1::DOUBLE + b * 0.01::DOUBLE AS open
  FROM range(0, 10) a(s), range(0, 30) x(d), range(0, 24) y(b))"""


@_api("bars_daily", f"SELECT printf('SYM%04d', s) AS ticker, d + 1 AS day, round(max(open) + 2.0, 4) AS max_h, round(min(open) - 1.5, 4) AS min_l FROM {_BARS} GROUP BY 1, 2")
def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    db = Database(spark, ohlc.catalog(spark))
    return _round(db.q("[:find ?ticker ?day (max ?h) (min ?l) :where [?s :symbol/ticker ?ticker] [?p :price/symbol ?s] [?p :price/time ?t] [(day ?t) ?day] [?p :price/high ?h] [?p :price/low ?l]]"))


@_api("bars_of_a_day", f"SELECT b * 60 AS m, round(open, 4) AS o, round(open + 0.5, 4) AS c FROM {_BARS} WHERE s = 4 AND d = 11")
def bars_of_a_day(spark: SparkSession, folder: str) -> DataFrame:
    db = Database(spark, ohlc.catalog(spark))
    return _round(db.q('[:find ?m ?o ?c :where [?s :symbol/ticker "SYM0004"] [?p :price/symbol ?s] [?p :price/time ?t] [(year ?t) ?y] [(= ?y 2024)] [(month ?t) ?mo] [(= ?mo 1)] [(day ?t) ?d] [(= ?d 12)] [?p :price/minute_of_day ?m] [?p :price/open ?o] [?p :price/close ?c]]'))


@_api("bars_log", f"SELECT 'symbol:' || s AS s, round(max(open) + 2.0, 4) AS max_h, count(*) AS count_p FROM {_BARS} GROUP BY 1")
def bars_log(spark: SparkSession, folder: str) -> DataFrame:
    return _round(Database(spark, log=ohlc.log(spark)).q("[:find ?s (max ?h) (count ?p) :where [?p :price/symbol ?s] [?p :price/high ?h]]"))


# -- relations


@_api("rel_filter", "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20")
def rel_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _rel(spark, folder, "part").filter("p_size > 10").compare("p_size", "<", 20).df.select("p_partkey", "p_size")


@_api("rel_chain", "SELECT p_partkey, p_size FROM part WHERE p_partkey <= p_size AND p_size < p_retailprice")
def rel_chain(spark: SparkSession, folder: str) -> DataFrame:
    return _rel(spark, folder, "part").chain("<=", "p_partkey", "p_size").chain("<", "p_size", "p_retailprice").df.select("p_partkey", "p_size")


@_api("rel_evaluate", "SELECT p_partkey, round(p_retailprice * p_size, 4) AS worth FROM part")
def rel_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_rel(spark, folder, "part").evaluate(lambda a, b: a * b, ["p_retailprice", "p_size"], "worth").df.select("p_partkey", "worth"))


def _nations(spark: SparkSession, folder: str) -> Relation:
    return Relation(_rel(spark, folder, "nation").df.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")))


def _suppliers(spark: SparkSession, folder: str) -> Relation:
    return Relation(_rel(spark, folder, "supplier").df.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("supplier"), F.lit("x").alias("name")))


@_api("rel_join", "SELECT n_nationkey AS k, n_name AS name, s_name AS supplier FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def rel_join(spark: SparkSession, folder: str) -> DataFrame:
    return _nations(spark, folder).join(Relation(_suppliers(spark, folder).df.drop("name"))).df


@_api("rel_hash_join", "SELECT DISTINCT n_nationkey AS k, n_name AS name, s_name AS supplier FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def rel_hash_join(spark: SparkSession, folder: str) -> DataFrame:
    """On k alone, though both have a column `name`."""
    return _nations(spark, folder).hash_join(_suppliers(spark, folder), ["k"]).df


@_api("rel_join_where", "SELECT n_nationkey AS k, s_suppkey AS s FROM nation JOIN supplier ON n_nationkey > s_nationkey AND n_regionkey = s_suppkey % 5")
def rel_join_where(spark: SparkSession, folder: str) -> DataFrame:
    a = Relation(_rel(spark, folder, "nation").df.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r")))
    b = Relation(_rel(spark, folder, "supplier").df.select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("sk"), (F.col("s_suppkey") % 5).alias("m")))
    return a.join_where(b, [("k", ">", "sk"), ("r", "=", "m")]).df.select("k", "s")


@_api("rel_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def rel_anti(spark: SparkSession, folder: str) -> DataFrame:
    bought = Relation(_rel(spark, folder, "lineitem").df.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")))
    return _rel(spark, folder, "part").anti_join(bought, ["p_partkey"]).df.select("p_partkey")


@_api("rel_concat", "SELECT r_name AS name FROM region UNION ALL SELECT r_name FROM region")
def rel_concat(spark: SparkSession, folder: str) -> DataFrame:
    names = Relation(_rel(spark, folder, "region").df.select(F.col("r_name").alias("name")))
    return names.concat(names).df


@_api("rel_sorted", "SELECT row_number() OVER (ORDER BY n_regionkey, n_name) AS at, n_regionkey AS r, n_name AS name FROM nation")
def rel_sorted(spark: SparkSession, folder: str) -> DataFrame:
    rows = list(Relation(_rel(spark, folder, "nation").df.select(F.col("n_regionkey").alias("r"), F.col("n_name").alias("name"))).sorted())
    return _values(spark, [(i, r["r"], r["name"]) for i, r in enumerate(rows, 1)], "at long, r int, name string")


@_api("rel_sort_desc", "SELECT row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS at, c_custkey AS k FROM customer")
def rel_sort_desc(spark: SparkSession, folder: str) -> DataFrame:
    rows = list(_rel(spark, folder, "customer").sort(("c_acctbal", True), "c_custkey"))
    return _values(spark, [(i, r["c_custkey"]) for i, r in enumerate(rows, 1)], "at long, k long")


@_api("rel_project_pattern", "SELECT DISTINCT n_nationkey AS n, n_name AS name FROM nation")
def rel_project_pattern(spark: SparkSession, folder: str) -> DataFrame:
    whole = Relation(_rel(spark, folder, "nation").df.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n")))
    return whole.project_pattern("[?n :nation/name ?name]").df


@_api("rel_aggregate_where", "SELECT o_orderstatus, sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderpriority = '1-URGENT') > 0")
def rel_aggregate_where(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_rel(spark, folder, "orders").aggregate_where(["o_orderstatus"], "sum", "o_totalprice", F.col("o_orderpriority") == "1-URGENT", "urgent").df)


@_api("rel_size_get", "SELECT 25 AS size, 'nation' AS first_of, false AS empty")
def rel_size_get(spark: SparkSession, folder: str) -> DataFrame:
    r = _rel(spark, folder, "nation").materialize()
    return _values(spark, [(r.size(), "nation" if r.get(0)["n_nationkey"] is not None and r.get(99) is None else "", r.is_empty())], "size int, first_of string, empty boolean")


# -- streams


def _growing(spark: SparkSession, folder: str, late: str = "10 minutes") -> Table:
    like = Database.over(spark, folder).catalog.tables["events"].df
    return live.table_stream(spark, "events", f"{folder}/events.parquet*", like, key=("event_id",), time="ts", late=late)


@_api("stream_filter", "SELECT event_id AS i, user_id AS u FROM events WHERE event_type = 'error'")
def stream_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A standing query in append mode, into files."""
    return live.drained(spark, '[:find ?i ?u :where [?e :events/event_id ?i] [?e :events/user_id ?u] [?e :events/event_type "error"]]', [_growing(spark, folder)], shared_folder(spark, "stream"))


@_api("stream_join", "SELECT event_id AS i, c_name AS name FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'purchase'")
def stream_join(spark: SparkSession, folder: str) -> DataFrame:
    """A stream joined with a table that stands still."""
    customers = Database.over(spark, folder).catalog.tables["customer"]
    text = '[:find ?i ?name :where [?e :events/event_id ?i] [?e :events/user_id ?u] [?e :events/event_type "purchase"] [?c :customer/custkey ?u] [?c :customer/name ?name]]'
    return live.drained(spark, text, [_growing(spark, folder), customers], shared_folder(spark, "stream"))


@_api("stream_aggregate", "SELECT event_type AS t, count(*) AS count_e, round(sum(value), 4) AS sum_v, min(value) AS min_v, max(value) AS max_v FROM events GROUP BY 1")
def stream_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """A standing aggregate in complete mode."""
    name = f"agg_{id(object())}"
    live.standing(spark, "[:find ?t (count ?e) (sum ?v) (min ?v) (max ?v) :where [?e :events/event_type ?t] [?e :events/value ?v]]", [_growing(spark, folder)], name, mode="complete", once=True).awaitTermination()
    return _round(spark.table(name))


@_api("stream_windows", """
SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high
FROM events GROUP BY 1, 2""")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of event time under a watermark, kept up to date until the stream ends."""
    name = f"win_{id(object())}"
    windows = live.windowed(_growing(spark, folder).df, "ts", "6 hours", ["event_type"], "value")
    live.into_memory(windows, name, "complete")
    return _round(spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total", "low", "high"))


@_api("stream_windows_closed", """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(value) AS n FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windows_closed(spark: SparkSession, folder: str) -> DataFrame:
    """In append mode a window comes once the watermark, an hour behind the last event, has passed its end."""
    windows = live.windowed(_growing(spark, folder, "1 hour").df, "ts", "6 hours", ["event_type"], "value")
    path = shared_folder(spark, "stream")
    live.into_files(windows.select(F.col("window.start").alias("start"), "event_type", "n"), path)
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

