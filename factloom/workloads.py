"""Named queries over the star schema, each with the SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .operators.relation import Relation
from .sources.datoms import DatomLog, tagged

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _round(df: DataFrame) -> DataFrame:
    """Doubles to 4 places: engines add in different orders."""
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _datalog(name: str, sql: str, text: str, *inputs, finish: Callable[[DataFrame], DataFrame] = _round, functions: dict[str, tuple] | None = None) -> None:
    """`functions`: name -> (builder, type or None), registered before the query runs."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        db = Database.over(spark, folder)
        for own, (build, returns) in (functions or {}).items():
            db.register_function(own, build, returns=returns)
        return finish(db.q(text, *inputs))

    QUERIES[name], SQL[name] = run, sql


def _api(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_datalog("pattern_single", "SELECT DISTINCT n_name AS name FROM nation", "[:find ?name :where [?n :nation/name ?name]]")
_datalog("pattern_const_value", "SELECT DISTINCT c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'", '[:find ?n :where [?c :customer/mktsegment "BUILDING"] [?c :customer/name ?n]]')
_datalog("pattern_const_entity", "SELECT n_name AS name FROM nation WHERE n_nationkey = 7", '[:find ?name :where ["nation:7" :nation/name ?name]]')
_datalog("pattern_blank", "SELECT DISTINCT p_brand AS brand FROM part", "[:find ?brand :where [_ :part/brand ?brand]]")
_datalog("pattern_ref_output", "SELECT 'nation:' || n_nationkey AS n, 'region:' || n_regionkey AS r FROM nation", "[:find ?n ?r :where [?n :nation/region ?r]]")
_datalog("pattern_self_equal", "SELECT 'customer:' || c_custkey AS c FROM customer WHERE c_custkey = c_nationkey", "[:find ?c :where [?c :customer/custkey ?x] [?c :customer/nationkey ?x]]")
_datalog("join_star", "SELECT DISTINCT p_name AS name, p_brand AS brand, p_size AS size FROM part WHERE p_size > 40", "[:find ?name ?brand ?size :where [?p :part/name ?name] [?p :part/brand ?brand] [?p :part/size ?size] [(> ?size 40)]]")
_datalog("join_fk", "SELECT n_name AS nation, count(*) AS count_o, round(avg(o_totalprice), 4) AS avg_price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
         "[:find ?nation (count ?o) (avg ?price) :where [?o :orders/customer ?c] [?o :orders/totalprice ?price] [?c :customer/nation ?n] [?n :nation/name ?nation]]")
_datalog("join_5way", "SELECT r_name AS region, round(sum(l_quantity), 4) AS sum_q, count(*) AS count_l FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
         "[:find ?region (sum ?q) (count ?l) :where [?r :region/name ?region] [?n :nation/region ?r] [?c :customer/nation ?n] [?o :orders/customer ?c] [?l :lineitem/order ?o] [?l :lineitem/quantity ?q]]")
_datalog("join_value", "SELECT DISTINCT s_name AS s, c_name AS c FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9000", "[:find ?s ?c :where [?x :supplier/nationkey ?k] [?x :supplier/name ?s] [?y :customer/nationkey ?k] [?y :customer/name ?c] [?y :customer/acctbal ?b] [(> ?b 9000)]]")
_datalog("theta_join", "SELECT DISTINCT a.p_size AS size1, b.p_size AS size2 FROM part a, part b WHERE a.p_brand = 'Brand#11' AND b.p_brand = 'Brand#12' AND a.p_size < b.p_size", '[:find ?size1 ?size2 :where [?a :part/brand "Brand#11"] [?a :part/size ?size1] [?b :part/brand "Brand#12"] [?b :part/size ?size2] [(< ?size1 ?size2)]]')
for _op, _name in (("=", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    _datalog(f"pred_{_name}", f"SELECT DISTINCT p_name AS name, p_size AS size FROM part WHERE p_size {_op} 25", f"[:find ?name ?size :where [?p :part/size ?size] [?p :part/name ?name] [({_op} ?size 25)]]")
_datalog("pred_chain", "SELECT DISTINCT p_size AS size FROM part WHERE 10 <= p_size AND p_size <= 20", "[:find ?size :where [?p :part/size ?size] [(<= 10 ?size 20)]]")
_datalog("pred_eq_vars", "SELECT 'customer:' || c_custkey AS c, 'supplier:' || s_suppkey AS s FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal > 9500", "[:find ?c ?s :where [?c :customer/nationkey ?a] [?c :customer/acctbal ?b] [?s :supplier/nationkey ?d] [(= ?a ?d)] [(> ?b 9500)]]")
_datalog("pred_type_mismatch", "SELECT count(*) AS count_p FROM part HAVING count(*) > 0", '[:find (count ?p) :where [?p :part/size ?s] [(< ?s "x")]]')
_datalog("pred_ground_binding", "SELECT DISTINCT p_name AS name, 5 AS size FROM part", "[:find ?name ?size :where [?p :part/name ?name] [(= ?size 5)]]")
_datalog("str_starts", "SELECT DISTINCT p_name AS name FROM part WHERE starts_with(p_type, 'PROMO')", '[:find ?name :where [?p :part/name ?name] [?p :part/type ?t] [(str/starts-with? ?t "PROMO")]]')
_datalog("str_ends", "SELECT DISTINCT c_name AS name FROM customer WHERE ends_with(c_name, '7')", '[:find ?name :where [?p :customer/name ?name] [(str/ends-with? ?name "7")]]')
_datalog("str_contains", "SELECT DISTINCT p_type AS t FROM part WHERE contains(p_type, 'A')", '[:find ?t :where [?p :part/type ?t] [(str/contains? ?t "A")]]')
_datalog("same_date", "SELECT DISTINCT a.event_id AS i, b.event_id AS j FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts::DATE = b.ts::DATE WHERE a.event_type = 'purchase' AND b.event_type = 'error'",
         '[:find ?i ?j :where [?a :events/event_id ?i] [?a :events/user_id ?u] [?a :events/ts ?s] [?a :events/event_type "purchase"] [?b :events/event_id ?j] [?b :events/user_id ?u] [?b :events/ts ?t] [?b :events/event_type "error"] [(same-date? ?s ?t)]]')
_datalog("expr_arith", "SELECT DISTINCT o_orderkey AS k, o_orderkey + 1 AS a, o_orderkey - 2 AS b, round(o_totalprice * 100, 4) AS c FROM orders", "[:find ?k ?a ?b ?c :where [?o :orders/orderkey ?k] [?o :orders/totalprice ?p] [(+ ?k 1) ?a] [(- ?k 2) ?b] [(* ?p 100) ?c]]")
_datalog("expr_div", "SELECT DISTINCT p_partkey AS k, round(p_retailprice / p_size, 4) AS x FROM part", "[:find ?k ?x :where [?p :part/partkey ?k] [?p :part/retailprice ?r] [?p :part/size ?s] [(/ ?r ?s) ?x]]")
_datalog("expr_div_zero", "SELECT DISTINCT p_partkey AS k, 100.0::DOUBLE / (p_size - 10) AS x FROM part WHERE p_size <> 10", "[:find ?k ?x :where [?p :part/partkey ?k] [?p :part/size ?s] [(- ?s 10) ?d] [(/ 100 ?d) ?x]]", finish=lambda d: d)
_datalog("expr_str", "SELECT DISTINCT c_name || '/' || c_nationkey AS x FROM customer", '[:find ?x :where [?c :customer/name ?n] [?c :customer/nationkey ?k] [(str ?n "/" ?k) ?x]]')
_datalog("expr_time", "SELECT DISTINCT year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts)::BIGINT AS s FROM events", "[:find ?y ?mo ?d ?h ?mi ?s :where [?e :events/ts ?t] [(year ?t) ?y] [(month ?t) ?mo] [(day ?t) ?d] [(hour ?t) ?h] [(minute ?t) ?mi] [(second ?t) ?s]]")
_datalog("expr_ground", "SELECT DISTINCT n_name AS name, 42 AS x FROM nation", "[:find ?name ?x :where [?n :nation/name ?name] [(ground 42) ?x]]")
_datalog("expr_identity", "SELECT DISTINCT n_name AS name, n_name AS x FROM nation", "[:find ?name ?x :where [?n :nation/name ?name] [(identity ?name) ?x]]")
_datalog("agg_m1", "SELECT l_returnflag AS flag, sum(l_quantity) AS sum_qty, count(*) AS count_l FROM lineitem WHERE l_quantity > 10 GROUP BY 1", "[:find ?flag (sum ?qty) (count ?l) :where [?l :lineitem/returnflag ?flag] [?l :lineitem/quantity ?qty] [(> ?qty 10)] :order-by [?flag]]")
_datalog("agg_global", "SELECT count(o_totalprice) AS count_p, round(sum(o_totalprice), 4) AS sum_p, round(avg(o_totalprice), 4) AS avg_p, min(o_totalprice) AS min_p, max(o_totalprice) AS max_p FROM orders", "[:find (count ?p) (sum ?p) (avg ?p) (min ?p) (max ?p) :where [?o :orders/totalprice ?p]]")
_datalog("agg_group", "SELECT c_mktsegment AS s, round(avg(c_acctbal), 4) AS avg_b, count(*) AS count_c FROM customer GROUP BY 1", "[:find ?s (avg ?b) (count ?c) :where [?c :customer/mktsegment ?s] [?c :customer/acctbal ?b]]")
_datalog("agg_minmax_types", "SELECT min(o_orderdate) AS min_d, max(o_orderdate) AS max_d, min(o_orderpriority) AS min_s, max(o_orderkey) AS max_k FROM orders", "[:find (min ?d) (max ?d) (min ?s) (max ?k) :where [?o :orders/orderdate ?d] [?o :orders/orderpriority ?s] [?o :orders/orderkey ?k]]")
_datalog("agg_empty", "SELECT count(*) AS count_o, sum(o_totalprice) AS sum_p FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0", "[:find (count ?o) (sum ?p) :where [?o :orders/totalprice ?p] [(< ?p 0)]]")
_datalog("agg_dup_values", "SELECT sum(p_size)::DOUBLE AS sum_s, count(*) AS count_s FROM part", "[:find (sum ?s) (count ?s) :where [?p :part/size ?s]]")
_datalog("agg_blank_dedupes", "SELECT sum(s)::DOUBLE AS sum_s FROM (SELECT DISTINCT p_size AS s FROM part)", "[:find (sum ?s) :where [_ :part/size ?s]]")
_datalog("agg_count_distinct", "SELECT p_brand AS b, count(DISTINCT p_size) AS count_distinct_s FROM part GROUP BY 1", "[:find ?b (count-distinct ?s) :where [?p :part/brand ?b] [?p :part/size ?s]]")
_datalog("order_by_multi", "SELECT DISTINCT p_size AS s, p_brand AS b FROM part ORDER BY s DESC, b", "[:find ?s ?b :where [?p :part/size ?s] [?p :part/brand ?b] :order-by [[?s :desc] ?b]]")
_datalog("in_scalar", "SELECT DISTINCT c_name AS n FROM customer WHERE c_mktsegment = 'MACHINERY'", "[:find ?n :in $ ?seg :where [?c :customer/mktsegment ?seg] [?c :customer/name ?n]]", "MACHINERY")
_datalog("in_collection", "SELECT 'orders:' || o_orderkey AS o, round(o_totalprice * 100, 4) AS cents FROM orders WHERE o_orderstatus IN ('F', 'P') AND 1000 <= o_totalprice AND o_totalprice <= 90000", "[:find ?o ?cents :in $ [?status ...] ?lo ?hi :where [?o :orders/orderstatus ?status] [?o :orders/totalprice ?p] [(<= ?lo ?p ?hi)] [(* ?p 100) ?cents]]", ["F", "P"], 1000, 90000)
_datalog("in_tuple", "SELECT DISTINCT p_name AS n FROM part WHERE p_brand = 'Brand#13' AND p_size >= 20", "[:find ?n :in $ [[?brand ?least]] :where [?p :part/brand ?brand] [?p :part/size ?s] [?p :part/name ?n] [(>= ?s ?least)]]", ("Brand#13", 20))
_datalog("in_relation", "SELECT DISTINCT p_name AS n, p_brand AS b FROM part JOIN (VALUES ('Brand#11', 10), ('Brand#12', 20)) v(b, s) ON p_brand = v.b AND p_size = v.s", "[:find ?n ?b :in $ [[?b ?s] ...] :where [?p :part/brand ?b] [?p :part/size ?s] [?p :part/name ?n]]", [("Brand#11", 10), ("Brand#12", 20)])
_datalog("in_relation_agg", "SELECT DISTINCT count(*) AS count_p FROM part JOIN (VALUES ('Brand#11'), ('Brand#12')) v(b) ON p_brand = v.b GROUP BY p_brand", "[:find (count ?p) :in $ [[?b] ...] :where [?p :part/brand ?b]]", [("Brand#11",), ("Brand#12",)])
_datalog("in_empty_collection", "SELECT p_name AS n FROM part WHERE false", "[:find ?n :in $ [?b ...] :where [?p :part/brand ?b] [?p :part/name ?n]]", [])
_AVG = "(SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY 1)"
_datalog("subq_correlated", f"SELECT DISTINCT n_name AS nation, round(a, 4) AS avg FROM nation JOIN {_AVG} ON n_nationkey = k", "[:find ?nation ?avg :where [?n :nation/name ?nation] [(q [:find (avg ?b) :in $ ?k :where [?x :customer/nation ?k] [?x :customer/acctbal ?b]] $ ?n) [[?avg]]]]")
_datalog("subq_filter_above_avg", f"SELECT DISTINCT c_name AS name, c_acctbal AS bal, round(a, 4) AS avg FROM customer JOIN {_AVG} ON c_nationkey = k WHERE c_acctbal > a",
         "[:find ?name ?bal ?avg :where [?c :customer/name ?name] [?c :customer/acctbal ?bal] [?c :customer/nation ?n] [(q [:find (avg ?b) :in $ ?nat :where [?x :customer/nation ?nat] [?x :customer/acctbal ?b]] $ ?n) [[?avg]]] [(> ?bal ?avg)]]")
_datalog("subq_multi", "SELECT n_name AS nation, max(c_acctbal) AS hi, min(c_acctbal) AS lo FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey, n_name",
         "[:find ?nation ?hi ?lo :where [?n :nation/name ?nation] [(q [:find (max ?b) :in $ ?k :where [?x :customer/nation ?k] [?x :customer/acctbal ?b]] $ ?n) [[?hi]]] [(q [:find (min ?b) :in $ ?k :where [?x :customer/nation ?k] [?x :customer/acctbal ?b]] $ ?n) [[?lo]]]]")
_datalog("subq_relation", "SELECT DISTINCT n_name AS nation, s_name AS s FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 5000", "[:find ?nation ?s :where [?n :nation/name ?nation] [(q [:find ?name :in $ ?k :where [?x :supplier/nation ?k] [?x :supplier/name ?name] [?x :supplier/acctbal ?b] [(> ?b 5000)]] $ ?n) [[?s] ...]]]")
_datalog("subq_uncorrelated", "SELECT DISTINCT c_name AS name FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)", "[:find ?name :where [?c :customer/name ?name] [?c :customer/acctbal ?b] [(q [:find (max ?v) :where [?x :customer/acctbal ?v]] $) [[?most]]] [(= ?b ?most)]]")
_datalog("subq_nested", "SELECT DISTINCT r_name AS region, m AS most FROM region JOIN (SELECT n_regionkey AS k, max(n) AS m FROM (SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1, 2) GROUP BY 1) ON k = r_regionkey",
         "[:find ?region ?most :where [?r :region/name ?region] [(q [:find (max ?n) :in $ ?reg :where [?nat :nation/region ?reg] [(q [:find (count ?c) :in $ ?k :where [?c :customer/nation ?k]] $ ?nat) [[?n]]]] $ ?r) [[?most]]]]")
_datalog("subq_param_filter", "SELECT DISTINCT r_name AS region, n AS n FROM region JOIN (SELECT a.n_regionkey AS k, count(*) AS n FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey GROUP BY 1) ON k = r_regionkey",
         "[:find ?region ?n :where [?r :region/name ?region] [(q [:find (count ?b) :in $ ?reg :where [?a :nation/region ?reg] [?a :nation/nationkey ?i] [?b :nation/region ?reg] [?b :nation/nationkey ?j] [(< ?i ?j)]] $ ?r) [[?n]]]]")
_datalog("subq_empty_drops", "SELECT DISTINCT n_name AS nation, count(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 9000 GROUP BY n_name", "[:find ?nation ?n :where [?x :nation/name ?nation] [(q [:find (count ?s) :in $ ?k :where [?s :supplier/nation ?k] [?s :supplier/acctbal ?b] [(> ?b 9000)]] $ ?x) [[?n]]]]")
_datalog("time_range_rewrite", "SELECT 'orders:' || o_orderkey AS o, year(o_orderdate) AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'", "[:find ?o ?y :where [?o :orders/orderdate ?d] [(year ?d) ?y] [(= ?y 1997)]]")
_datalog("ohlc_daily", """
WITH e AS (SELECT *, year(ts) AS y, month(ts) AS m, day(ts) AS d FROM events)
SELECT y, m, d, round(arg_min(value, event_id), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, event_id), 4) AS close, count(*) AS n FROM e GROUP BY 1, 2, 3""",
         """[:find ?y ?m ?d ?open ?high ?low ?close ?n
             :where [(q [:find ?yy ?mm ?dd (min ?i) (max ?i) (max ?v) (min ?v) (count ?x)
                         :where [?x :events/event_id ?i] [?x :events/value ?v] [?x :events/ts ?t] [(year ?t) ?yy] [(month ?t) ?mm] [(day ?t) ?dd]] $) [[?y ?m ?d ?first ?last ?high ?low ?n] ...]]
                    [?a :events/event_id ?first] [?a :events/value ?open] [?b :events/event_id ?last] [?b :events/value ?close]]""")  # fmt: skip
_datalog("tx_bind", "SELECT event_id AS i, epoch_us(ts) AS tx FROM events WHERE event_type = 'error'", '[:find ?i ?tx :where [?e :events/event_id ?i ?tx] [?e :events/event_type "error"]]')
_datalog("wildcard_attr", "SELECT unnest([':nation/nationkey', ':nation/name', ':nation/regionkey']) AS a, unnest([n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR]) AS v FROM nation WHERE n_nationkey = 3", '[:find ?a ?v :where ["nation:3" ?a ?v]]')


@_api("as_of", "SELECT event_type AS t, count(*) AS count_e FROM events WHERE ts <= TIMESTAMP '2024-01-10' GROUP BY 1")
def as_of(spark: SparkSession, folder: str) -> DataFrame:
    import datetime as dt

    return Database.over(spark, folder).as_of(dt.datetime(2024, 1, 10)).q("[:find ?t (count ?e) :where [?e :events/event_type ?t]]")


def _event_log(spark: SparkSession, folder: str) -> Database:
    """Facts about users from the events: each event asserts the user's last action and value."""
    e = Database.over(spark, folder).catalog.tables["events"]
    from .functions.registry import Typed

    facts = F.array(F.struct(F.lit(":user/action").alias("a"), tagged(Typed(F.col("event_type"), "string")).alias("v")), F.struct(F.lit(":user/value").alias("a"), tagged(Typed(F.col("value"), "double")).alias("v")))
    rows = e.df.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("e"), F.explode(facts).alias("f"), F.col("event_id").alias("tx"))
    df = rows.select("e", "f.a", "f.v", "tx", F.lit(True).alias("added"))
    return Database(spark, log=DatomLog(spark, df=df, types={":user/action": "string", ":user/value": "double"}))


@_api("log_as_of", "SELECT 'user:' || user_id AS u, max(event_id) AS max_tx FROM events WHERE event_id <= 5000 GROUP BY 1")
def log_as_of(spark: SparkSession, folder: str) -> DataFrame:
    return _event_log(spark, folder).as_of(5000).q("[:find ?u (max ?tx) :where [?u :user/action _ ?tx]]")


@_api("log_tx_join", "SELECT event_id AS tx, event_type AS a, round(value, 4) AS v FROM events WHERE value > 90")
def log_tx_join(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_event_log(spark, folder).q("[:find ?tx ?a ?v :where [?u :user/action ?a ?tx] [?u :user/value ?v ?tx] [(> ?v 90)]]"))


@_api("log_latest", "SELECT 'user:' || user_id AS e, arg_max(event_type, event_id) AS v, max(event_id) AS tx FROM events GROUP BY 1")
def log_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _event_log(spark, folder).latest(":user/action")


def _rel(spark: SparkSession, folder: str, name: str) -> Relation:
    return Relation(Database.over(spark, folder).catalog.tables[name].df)


@_api("api_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def api_semi(spark: SparkSession, folder: str) -> DataFrame:
    orders = _rel(spark, folder, "orders").compare("o_orderstatus", "=", "P").df.select(F.col("o_custkey").alias("c_custkey"))
    return _rel(spark, folder, "customer").semi_join(Relation(orders), ["c_custkey"]).df.select("c_custkey", "c_name")


@_api("api_anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def api_anti(spark: SparkSession, folder: str) -> DataFrame:
    orders = Relation(_rel(spark, folder, "orders").compare("o_orderstatus", "=", "P").compare("o_totalprice", ">", 200000).df.select(F.col("o_custkey").alias("c_custkey")))
    return _rel(spark, folder, "customer").anti_join(orders, ["c_custkey"]).df.select("c_custkey", "c_name")


@_api("api_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def api_union(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _rel(spark, folder, "customer").df.select(F.col("c_nationkey").alias("k")), _rel(spark, folder, "supplier").df.select(F.col("s_nationkey").alias("k"))
    return Relation(a).union(Relation(b)).df


@_api("api_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def api_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return _rel(spark, folder, "part").project("p_brand", "p_type").df


@_api("api_product", "SELECT r_name, n_name FROM region, nation")
def api_product(spark: SparkSession, folder: str) -> DataFrame:
    return _rel(spark, folder, "region").project("r_name").product(_rel(spark, folder, "nation").project("n_name")).df


@_api("api_aggregate", "SELECT o_orderstatus, count(o_orderkey) AS count_o_orderkey, round(sum(o_totalprice), 4) AS sum_o_totalprice FROM orders GROUP BY 1")
def api_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_rel(spark, folder, "orders").aggregate(["o_orderstatus"], ("count", "o_orderkey"), ("sum", "o_totalprice")).df)


from . import workloads_facts  # noqa: E402, F401  (adds its queries)
