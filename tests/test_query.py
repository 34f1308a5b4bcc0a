import pytest

from factloom import workloads
from factloom.query import Aggregate, Blank, Const, Input, Pattern, Predicate, QueryError, Subquery, Var, format_query, parse, parse_many, variables

FULL = """[:find ?n (sum ?x) :in $ ?a [?b ...] [[?c ?d]] [[?e ?f] ...]
  :where [?p :t/n ?n _] [?p :t/x ?x ?tx] [(< 0 ?x ?a)] [(+ ?x 1) ?y] [(str/starts-with? ?n "A\\"")]
         [(q [:find (max ?z) :in $ ?k :where [?k :t/z ?z]] $ ?p) [[?m]]] [(q [:find ?z :where [_ :t/z ?z]] $) [[?w] ...]]
  :order-by [[?n :desc] ?x]]"""


def test_parse():
    q = parse(FULL)
    assert q.find == (Var("?n"), Aggregate("sum", Var("?x")))
    assert q.inputs == (Input("database"), Input("scalar", (Var("?a"),)), Input("collection", (Var("?b"),)), Input("tuple", (Var("?c"), Var("?d"))), Input("relation", (Var("?e"), Var("?f"))))
    assert q.where[0] == Pattern(Var("?p"), Const(":t/n"), Var("?n"), Blank())
    assert q.where[2] == Predicate("<", (Const(0), Var("?x"), Var("?a")))
    assert isinstance(q.where[5], Subquery) and q.where[5].binding == "tuple" and q.where[6].binding == "relation"
    assert q.order_by == ((Var("?n"), True), (Var("?x"), False))
    assert [v.name for v in variables(q.where)][:4] == ["?p", "?n", "?x", "?tx"]
    assert len(parse_many("[:find ?x :where [_ :a/b ?x]] [:find ?y :where [_ :a/b ?y]]")) == 2


def test_format_round_trips():
    assert parse(format_query(parse(FULL))) == parse(FULL)


@pytest.mark.parametrize(
    "bad",
    [
        "[:find ?x]", "[:where [?x :a/b ?y]]", "[:find (median ?x) :where [_ :a/b ?x]]", "[:find (sum ?x ?y) :where [_ :a/b ?x]]", "[:find ?x :where [?x :a]]", "[:find ?x :where [_ :a/b ?x] :as-of 3]",
        "[:find ?x :where [?x :a/b [1 2]]]", "[:find ?x :where [(+ 1 2 3) ?x]]", "[:find ?x :where [(!= ?x 1 2)]]", "[:find ?x :where [_ :a/b nil]]", "(:find ?x)", "[:find ?x :where [_ :a/b ?x] :limit 3]", "[:find ?x :in [1] :where [_ :a/b ?x]]",
    ],
)
def test_errors(bad):
    with pytest.raises(QueryError):
        parse(bad)


def test_workloads_have_sql():
    assert workloads.QUERIES.keys() == workloads.SQL.keys()
