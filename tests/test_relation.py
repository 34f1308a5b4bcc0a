import pytest
from pyspark.sql import functions as F

from factloom.operators.relation import Relation
from factloom.streaming import live


@pytest.fixture(scope="module")
def pair(spark):
    a = Relation(spark.createDataFrame([(i, f"n{i % 7}") for i in range(100)], "x long, name string"))
    return a, Relation(spark.createDataFrame([(i % 50, i) for i in range(200)], "x long, value long"))


def test_joins(pair):
    a, b = pair
    assert a.join(b).size() == 200 and a.hash_join(b, ["x"]).size() == 200
    assert a.semi_join(b, ["x"]).size() == 50 and a.anti_join(b, ["x"]).size() == 50
    c = Relation(b.df.select(F.col("x").alias("y"), "value"))
    assert a.join_where(c, [("x", "=", "y"), ("x", "<", "value")]).size() == 150
    assert a.project("name").product(b.project("x")).size() == 350


def test_sets_and_groups(pair):
    a, b = pair
    assert a.project("name").size() == 7 and a.union(a).size() == 100 and a.concat(a).size() == 200
    out = b.aggregate(["x"], ("sum", "value"), ("count", "value")).sort(("sum_value", True)).get(0)
    assert (out.x, out.sum_value, out.count_value) == (49, 49 + 99 + 149 + 199, 4)
    assert b.filter("value < 0").aggregate([], ("count", "value")).is_empty()
    assert b.aggregate_where([], "sum", "value", F.col("x") == 0, "s").get(0).s == 300
    assert a.compare("x", ">=", 98).sorted().table() == "| x | name |\n| --- | --- |\n| 98 | n0 |\n| 99 | n1 |\n\n_2 rows_\n"
    assert b.chain("<", "x", "value").size() == 150 and b.evaluate(lambda x: x + 1, ["x"], "y").columns == ["x", "value", "y"]
    with pytest.raises(ValueError, match="no column"):
        a.project("nope")
    with pytest.raises(ValueError, match="same columns"):
        a.union(b)


def test_standing_query(spark, tmp_path):
    like = spark.createDataFrame([(1, "a", 5), (2, "b", 50), (3, "a", 70)], "id long, kind string, value long")
    like.write.parquet(str(tmp_path / "t"))
    t = live.table_stream(spark, "t", str(tmp_path / "t"), like, key=("id",))
    q = live.standing(spark, "[:find ?e ?k ?v :where [?e :t/kind ?k] [?e :t/value ?v] [(> ?v 10)]]", [t], "standing")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("standing").collect())) == [("t:2", "b", 50), ("t:3", "a", 70)]
    q = live.standing(spark, "[:find ?k (sum ?v) :where [?e :t/kind ?k] [?e :t/value ?v]]", [t], "sums", mode="complete")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sums").collect())) == [("a", 75.0), ("b", 50.0)]
