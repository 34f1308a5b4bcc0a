"""Small facts with expectations in line; the same queries over tables and over the datom log."""

import datetime as dt

import pytest

from factloom.database import Database
from factloom.edn import Keyword
from factloom.plans.compiler import CartesianProductError
from factloom.query import QueryError
from factloom.sources.catalog import Catalog, Table
from factloom.sources.datoms import Ref

BOATS = [("b1", "Auk", 12, "Hull", 40.5, True), ("b2", "Brig", 7, "Oban", None, False), ("b3", "Cog", 12, "Oban", 38.0, True), ("b4", "Dory", 4, "Rye", 5.5, None)]
TRIPS = [("t1", "b1", 3, 6), ("t2", "b1", 11, 7), ("t3", "b3", 20, 21), ("t4", "b4", 2, 22)]
AT = lambda h: dt.datetime(2023, 3, 14, h, 5)


@pytest.fixture(scope="module")
def tables(spark):
    boats = spark.createDataFrame(BOATS, "id string, name string, berths int, port string, weight double, motor boolean")
    trips = spark.createDataFrame([(i, b, c, AT(h)) for i, b, c, h in TRIPS], "id string, boat_id string, catch long, time timestamp_ntz")
    return Database(spark, Catalog([Table("boat", boats, ("id",)), Table("trip", trips, ("id",), refs={"boat": ("boat_id", "boat")})]))


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    db = Database(spark, path=str(tmp_path_factory.mktemp("log") / "d"))
    t = db.transaction()
    for i, n, b, p, w, m in BOATS:
        t.add_entity(f"boat:{i}", {":boat/name": n, ":boat/berths": b, ":boat/port": p} | ({":boat/weight": w} if w is not None else {}) | ({":boat/motor": m} if m is not None else {}))
    for i, b, c, h in TRIPS:
        t.add_entity(f"trip:{i}", {":trip/boat": Ref(f"boat:{b}"), ":trip/catch": c, ":trip/time": AT(h)})
    t.commit()
    return db


def rows(df):
    return sorted(tuple(r) for r in df.collect())


BOTH = [
    ("[:find ?n :where [_ :boat/name ?n]]", (), [("Auk",), ("Brig",), ("Cog",), ("Dory",)]),
    ('[:find ?n ?k :where [?b :boat/port "Oban"] [?b :boat/name ?n] [?b :boat/berths ?k] [(> ?k 7)]]', (), [("Cog", 12)]),
    ("[:find ?n ?w :where [?b :boat/name ?n] [?b :boat/weight ?w] [(< ?w 39)]]", (), [("Cog", 38.0), ("Dory", 5.5)]),
    ("[:find ?n (sum ?c) (count ?t) :where [?t :trip/boat ?b] [?t :trip/catch ?c] [?b :boat/name ?n]]", (), [("Auk", 14.0, 2), ("Cog", 20.0, 1), ("Dory", 2.0, 1)]),
    ("[:find (count ?p) :where [_ :boat/port ?p]]", (), [(3,)]),
    ("[:find (count ?p) :where [?b :boat/port ?p]]", (), [(4,)]),
    ("[:find (sum ?c) :where [?t :trip/catch ?c] [(> ?c 1000)]]", (), []),
    ("[:find ?n ?h :where [?t :trip/boat ?b] [?b :boat/name ?n] [?t :trip/time ?at] [(hour ?at) ?h] [(>= ?h 21)]]", (), [("Cog", 21), ("Dory", 22)]),
    ("[:find ?n ?x :where [?b :boat/name ?n] [?b :boat/berths ?k] [(- ?k 12) ?d] [(/ 60 ?d) ?x] [(< ?x -10)]]", (), [("Brig", -12.0)]),
    ('[:find ?x :where [?b :boat/name "Auk"] [?b :boat/weight ?w] [(str "w=" ?w) ?x]]', (), [("w=40.5",)]),
    ("[:find ?n ?m :where [?a :boat/berths ?k] [?b :boat/berths ?k] [?a :boat/name ?n] [?b :boat/name ?m] [(< ?n ?m)]]", (), [("Auk", "Cog")]),
    ("[:find ?n :in $ [?p ...] :where [?b :boat/port ?p] [?b :boat/name ?n]]", (["Rye", "Hull", "Rye"],), [("Auk",), ("Dory",)]),
    ("[:find ?p (count ?b) :in $ [?p ...] :where [?b :boat/port ?p]]", (["Oban", "Hull", "Ayr"],), [("Hull", 1), ("Oban", 2)]),
    ("[:find ?t :in $ [?b ...] :where [?t :trip/boat ?b]]", (["boat:b3", "boat:b4"],), [("trip:t3",), ("trip:t4",)]),
    ("[:find ?n :in $ [[?p ?k]] :where [?b :boat/port ?p] [?b :boat/berths ?k] [?b :boat/name ?n]]", (("Oban", 7),), [("Brig",)]),
    ("[:find ?n ?x :in $ [[?p ?x] ...] :where [?b :boat/port ?p] [?b :boat/name ?n]]", ([("Rye", 9), ("Ayr", 1)],), [("Dory", 9)]),
    ("[:find ?n ?m :where [?b :boat/name ?n] [(q [:find (max ?c) :in $ ?x :where [?t :trip/boat ?x] [?t :trip/catch ?c]] $ ?b) [[?m]]] [(> ?m 5)]]", (), [("Auk", 11), ("Cog", 20)]),
    ("[:find ?n :where [?b :boat/name ?n] [?b :boat/berths ?k] [(q [:find (avg ?y) :where [?x :boat/berths ?y]] $) [[?mean]]] [(> ?k ?mean)]]", (), [("Auk",), ("Cog",)]),
    ("[:find ?n ?k :in $ ?k :where [?b :boat/name ?n] [?b :boat/berths ?k]]", (4,), [("Dory", 4)]),
    ('[:find ?t :where [?b :boat/name "Cog"] [?t :trip/boat ?b]]', (), [("trip:t3",)]),
    ("[:find ?n :where [?b :boat/name ?n] [?b :boat/berths ?k] [(= ?k ?want)] [(ground 7) ?want]]", (), [("Brig",)]),
    ("[:find ?n :where [?b :boat/name ?n] [(missing ?b)]]", (), []),
    ("[:find ?n :where [?b :boat/name ?n] [(< ?n 5)] [(str/contains? ?n \"o\")]]", (), [("Cog",), ("Dory",)]),
    ("[:find ?a ?v :where [\"trip:t3\" ?a ?v] [(str/ends-with? ?a \"catch\")]]", (), [(":trip/catch", "20")]),
    ("[:find ?p (count ?b :if ?m) (max ?k) :where [?b :boat/port ?p] [?b :boat/motor ?m] [?b :boat/berths ?k]]", (), [("Hull", 1, 12), ("Oban", 1, 12)]),
    ("[:find ?p (count ?b :if ?m) :where [?b :boat/port ?p] [?b :boat/motor ?m] [?b :boat/berths 7]]", (), []),
]


@pytest.mark.parametrize(("text", "inputs", "want"), BOTH)
def test_tables_and_log_agree(tables, log, text, inputs, want):
    for db in (tables, log):
        got = rows(db.q(text, *inputs))
        assert got == [pytest.approx(w) for w in want]


def test_order_names_and_explain(tables):
    df = tables.q("[:find ?p (max ?k-x) :where [?b :boat/port ?p] [?b :boat/berths ?k-x] :order-by [[?p :desc]]]")
    assert df.columns == ["p", "max_k_x"] and [r.p for r in df.collect()] == ["Rye", "Oban", "Hull"]
    plan = tables.explain("[:find ?n :where [?b :boat/name ?n] [?b :boat/berths ?k] [?b :boat/port ?p]]")
    assert "Join" not in plan


def test_relation_input_aggregates_per_tuple(tables):
    assert rows(tables.q("[:find (count ?b) :in $ [[?p] ...] :where [?b :boat/port ?p]]", [("Oban",), ("Hull",), ("Rye",)])) == [(1,), (2,)]


def test_errors(tables, log):
    with pytest.raises(CartesianProductError):
        tables.q("[:find ?n ?c :where [?b :boat/name ?n] [?t :trip/catch ?c]]")
    for bad in ("[:find ?z :where [?b :boat/name ?n]]", "[:find ?n :where [?b :boat/nope ?n]]", "[:find (sum ?n) :where [?b :boat/name ?n]]", "[:find ?n :where [?b :boat/name ?n] [(frob ?n)]]", "[:find ?n :where [?b :boat/name ?n] [(> ?n ?z)]]", "[:find ?n :where [?b :boat/name ?n] :order-by [?b]]", "[:find (sum ?k :if ?z) :where [?b :boat/berths ?k]]"):
        with pytest.raises(QueryError):
            tables.q(bad)
    with pytest.raises(QueryError, match="not enough"):
        tables.q("[:find ?n :in $ ?p :where [?b :boat/port ?p] [?b :boat/name ?n]]")
    with pytest.raises(QueryError, match="too many"):
        tables.q("[:find ?n :where [?b :boat/name ?n]]", 1)
    with pytest.raises(NotImplementedError):
        tables.q("[:find ?n :where [?b :boat/name ?n] [(q [:find ?x :where [_ :boat/berths ?x]] $) ?y]]")
    with pytest.raises(Exception, match="one result"):
        tables.q("[:find ?v :where [(q [:find ?x :where [_ :boat/berths ?x]] $) [[?v]]]]").collect()


def test_time_range_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, dt.datetime(1990 + i, 5, 1)) for i in range(20)], "id long, at timestamp_ntz").write.parquet(str(tmp_path / "t"))
    db = Database(spark, Catalog([Table("t", spark.read.parquet(str(tmp_path / "t")), ("id",))]))
    text = "[:find ?i :where [?e :t/id ?i] [?e :t/at ?t] [(year ?t) ?y] [(= ?y 1997)] [(month ?t) ?m] [(= ?m 5)]]"
    assert rows(db.q(text)) == [(7,)]
    assert "GreaterThanOrEqual(at,1997-05-01" in db.explain(text).replace(", ", ",")


def test_transactions_and_time(spark, tmp_path):
    db = Database(spark, path=str(tmp_path / "log"))
    t = db.transaction()
    t.add("s:1", ":s/price", 10.5)
    t.add("s:1", ":s/kind", Keyword(":a/b"))
    first = t.commit()
    with pytest.raises(RuntimeError):
        t.add("s:1", ":s/price", 1.0)
    t = db.transaction()
    t.retract("s:1", ":s/price", 10.5)
    t.add("s:1", ":s/price", 11.0)
    made = t.add_map({":s/price": 5.0, ":s/of": Ref("s:1")})
    second = t.commit()
    gone = db.transaction()
    gone.add("s:9", ":s/price", 0.0)
    gone.rollback()
    assert rows(db.q("[:find ?e ?p :where [?e :s/price ?p]]")) == sorted([("s:1", 11.0), (made, 5.0)])
    assert rows(db.as_of(first).q("[:find ?p ?tx :where [?e :s/price ?p ?tx]]")) == [(10.5, first)]
    assert rows(db.q("[:find ?p :where [?x :s/of ?e] [?e :s/price ?p]]")) == [(11.0,)]
    assert rows(db.q("[:find ?e :where [?e :s/kind :a/b]]")) == [("s:1",)]
    assert [r.v for r in db.latest(":s/price").orderBy("v").collect()] == [5.0, 11.0]
    assert db.references("s:1").count() == 1 and db.entity("s:1").count() == 2 and db.time_range(first, second).count() == 2
    assert db.attribute_value(":s/price", 5.0).count() == 1 and db.entity_attribute("s:1", ":s/price").count() == 1 and db.entity_time_range("s:1", second, second + 1).count() == 1
    timed = Database(spark, time_tx=True)
    for day in (2, 3, 4):
        x = timed.transaction(dt.datetime(2024, 1, day))
        x.add("p:1", ":p/close", float(day))
        x.commit()
    assert timed.as_of(dt.datetime(2024, 1, 3, 23)).q("[:find ?c :where [_ :p/close ?c]]").count() == 2


def test_a_fact_retracted_and_asserted_at_once_holds(spark, tmp_path):
    for db in (Database(spark), Database(spark, path=str(tmp_path / "log"))):
        t = db.transaction()
        t.add("a", ":x/n", 1)
        t.add("b", ":x/n", 2)
        first = t.commit()
        t = db.transaction()
        t.retract("a", ":x/n", 1)
        t.add("a", ":x/n", 1)
        t.retract("b", ":x/n", 2)
        second = t.commit()
        assert second > first and rows(db.q("[:find ?e ?n ?t :where [?e :x/n ?n ?t]]")) == [("a", 1, second)]
        assert rows(db.as_of(first).q("[:find ?e ?n :where [?e :x/n ?n]]")) == [("a", 1), ("b", 2)]
        t = db.transaction()
        t.add("b", ":x/n", "two")
        t.commit()
        assert db.log.types()[":x/n"] == "any" and db.count(":x/n") == 2 and db.get("a", ":x/n", 1, second).count() == 1


def test_a_log_in_files_starts_no_job_to_plan(spark, tmp_path):
    db = Database(spark, path=str(tmp_path / "log"))
    t = db.transaction()
    t.add("a", ":x/n", 1)
    t.retract("a", ":x/m", 1.5)
    t.commit()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    db.q("[:find ?e ?n :where [?e :x/n ?n] [?e :x/m ?m]]")
    found = tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("other", "")
    assert len(found) == 0
    taken = {db.log.next_tx() for _ in range(3)} | {Database(spark, path=str(tmp_path / "log")).log.next_tx()}
    assert len(taken) == 4


def test_inputs_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, f"k{i % 7}") for i in range(50)], "id long, kind string").write.parquet(str(tmp_path / "t"))
    db = Database(spark, Catalog([Table("t", spark.read.parquet(str(tmp_path / "t")), ("id",))]))
    plan = db.explain("[:find ?i ?k :in $ [?k ...] :where [?e :t/id ?i] [?e :t/kind ?k]]", ["k1", "k2"])
    assert "In(kind, [k1,k2])" in plan and "Join" not in plan
    plan = db.explain("[:find ?i ?x :in $ [[?k ?x] ...] :where [?e :t/id ?i] [?e :t/kind ?k]]", [("k1", 5), ("k2", 6)])
    assert "In(kind, [k1,k2])" in plan and "LocalTableScan" in plan and "ExistingRDD" not in plan
    assert db.q("[:find ?i :in $ [?i ...] :where [?e :t/id ?i]]", list(range(40, 5000))).count() == 10
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    assert rows(db.q("[:find ?i ?t :in $ [[?i ?t] ...] :where [?e :t/id ?i]]", [(3, at), (3, at), (99, at)])) == [(3, dt.datetime(2024, 1, 1))]


def test_plans_are_kept_and_events_told(tables):
    from factloom import annotations

    seen = []
    db = tables.annotated(seen.append)
    text = "[:find ?p (count ?t) :where [?b :boat/port ?p] [?t :trip/boat ?b]]"
    assert len(db.run(text)) == 3
    names = [e.name for e in seen]
    assert names == [e.name for e in db.collector.events]
    assert [names.count(n) for n in (annotations.SCAN, annotations.JOIN, annotations.AGGREGATION, annotations.COMPLETE)] == [2, 1, 1, 1]
    assert seen[-1].data["rows"] == 3 and db.collector.seconds(annotations.COMPLETE) > 0
    assert "on boat" in annotations.event_text(next(e for e in seen if e.name == annotations.SCAN))
    assert db.q(text) is db.q(text)
    db.register_function("odd?", lambda x: x % 2 == 1)
    before = db.plan_cache()["misses"]
    db.q(text)  # another registry
    assert db.plan_cache()["misses"] == before + 1
    with pytest.raises(QueryError):
        db.q("[:find ?z :where [?b :boat/port ?p]]")
    assert seen[-1].name == "error/query.planned"


def test_doubles_as_text(spark):
    from pyspark.sql import functions as F

    from factloom.functions.registry import double_text

    cases = {1e6: "1e+06", 1e21: "1e+21", 1e-5: "1e-05", 100.0: "100", 123456.0: "123456", 1234567.0: "1.234567e+06", 123456789.0: "1.23456789e+08", 0.0001: "0.0001", 0.00012: "0.00012", 0.5: "0.5", -2.5e10: "-2.5e+10", 1e100: "1e+100", 0.0: "0", -1.0: "-1", float("inf"): "+Inf", 99999.5: "99999.5"}
    df = spark.createDataFrame([(k,) for k in cases], "x double")
    assert {r[0]: r[1] for r in df.select("x", double_text(F.col("x"))).collect()} == cases


def test_own_functions(tables):
    tables.register_function("double", lambda x: x * 2, returns="long")
    tables.register_function("even?", lambda x: x % 2 == 0)
    assert rows(tables.q("[:find ?d :where [?b :boat/berths ?k] [(even? ?k)] [(double ?k) ?d]]")) == [(8,), (24,)]


def test_lineitem_like_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (1, "a", 5.0), (2, "b", 1.0)], "k long, f string, q double")
    db = Database(spark, Catalog([Table("l", df)]))
    assert rows(db.q("[:find ?f (sum ?q) (count ?l) :where [?l :l/f ?f] [?l :l/q ?q]]")) == [("a", 10.0, 2), ("b", 1.0, 1)]
    assert rows(db.q("[:find ?f ?q :where [?l :l/f ?f] [?l :l/q ?q]]")) == [("a", 5.0), ("b", 1.0)]
    shown = rows(db.q("[:find ?l ?f ?q :where [?l :l/f ?f] [?l :l/q ?q]]"))
    assert [r[1:] for r in shown].count(("a", 5.0)) == 2 and len(set(shown)) == 3
    assert rows(db.q("[:find ?f (count-distinct ?l) :where [?l :l/f ?f]]")) == [("a", 2), ("b", 1)]
    one = next(r[0] for r in shown if r[0].endswith("/2"))
    assert rows(db.q(f'[:find ?k :where ["{one}" :l/k ?k]]')) == [(1,)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from factloom.__main__ import main

    spark.createDataFrame([(1, "n1")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    assert main(["--tables", str(tmp_path), "--query", "[:find ?n :where [_ :nation/name ?n]]"]) == 0 and "| n1 |" in capsys.readouterr().out
    assert main(["--tables", str(tmp_path), "--query", "[:find ?n]"]) == 1
    assert main(["--tables", str(tmp_path), "--query", "[:find ?n :where [_ :nation/name ?n]]", "--explain"]) == 0 and "Scan parquet" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO(".help\n.add x:1 :x/n 5\n[:find ?n :where [?e :x/n ?n]]\n.exit\n"))
    assert main(["--db", str(tmp_path / "log"), "-i"]) == 0
    out = capsys.readouterr().out
    assert ".add E A V" in out and "| 5 |" in out
