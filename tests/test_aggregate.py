"""aggregate on small tables, with the cases that are easily got wrong: zeros, absence, having."""

import pytest

from keystrata.api import Engine
from keystrata.operators.aggregate import aggregate
from keystrata.plans.table import adapt


@pytest.fixture(scope="module", autouse=True)
def tables(make):
    make("jobs", ["status:varchar:16", "region:varchar:8", "amount:int"], {f"k{i}": {"status": "todo" if i % 3 else "done", "region": "n" if i % 2 else "s", "amount": 2 * i} for i in range(1, 91)}, ["status"])
    make("gaps", ["g:varchar:8", "n:int", "x:double", "m:numeric:10,2", "d:date", "f:bool"], {"a": {"g": "x", "n": 0, "x": 0.0, "m": "1.25", "d": "20260101", "f": True}, "b": {"g": "x", "n": 10, "x": 4.0, "m": "2.25", "d": "20250101", "f": False}, "c": {"g": ""}, "e": {"n": 5}})


@pytest.fixture
def agg(ask):
    def run(obj, *fns, **r):
        return ask("aggregate", object=obj, aggregates=[{k: v for k, v in zip(("fn", "field", "alias"), f.split()) if v != "-"} for f in fns], **r)

    return run


def test_global(agg):
    assert agg("jobs", "count", "sum amount total", "avg amount", "min amount", "max amount", criteria=[{"field": "status", "op": "neq", "value": "done"}]) == {"count": 60, "total": 5400, "avg_amount": 90, "min_amount": 2, "max_amount": 178}
    assert agg("jobs", "count", criteria={"status": "nosuch"}) == []
    assert agg("jobs", "min status", "max region") == {"min_status": "done", "max_region": "s"}


def test_groups_having_order(agg):
    rows = agg("jobs", "count", "sum amount s", group_by=["status", "region"])
    assert rows == [{"status": "done", "region": "n", "count": 15, "s": 1350}, {"status": "done", "region": "s", "count": 15, "s": 1440}, {"status": "todo", "region": "n", "count": 30, "s": 2700}, {"status": "todo", "region": "s", "count": 30, "s": 2700}]
    assert [r["s"] for r in agg("jobs", "sum amount s", group_by="status,region", order_by="s", order="desc", limit=3)] == [2700, 2700, 1440]
    eq = agg("jobs", "count - n", group_by="status", having=[{"field": "n", "op": "eq", "value": "30"}])
    assert eq == [{"status": "done", "n": 30}]
    tree = {"or": [{"field": "n", "op": "gt", "value": 50}, {"field": "status", "op": "eq", "value": "done"}]}
    assert len(agg("jobs", "count - n", group_by="status", having=tree)) == 2
    assert agg("jobs", "count", group_by="status+region", format="csv").splitlines()[:2] == ["status+region,count", "donen,15"]


def test_zeros_and_absence(agg):
    assert agg("gaps", "count", "count n c", "avg n", "avg x", "sum m", "min d", "count g cg") == {"count": 4, "c": 3, "avg_n": 5, "avg_x": 2, "sum_m": 3.5, "min_d": "20250101", "cg": 2}
    assert agg("gaps", "avg n", "min n", zero_is_absent=True) == {"avg_n": 7.5, "min_n": 5}
    groups = agg("gaps", "count", group_by="g")
    assert sorted((r["g"] or "", r["count"]) for r in groups) == [("", 1), ("", 1), ("x", 2)]
    assert agg("gaps", "sum f", criteria={"g": "x"}) == {"sum_f": 1}


@pytest.mark.parametrize("r", [{"aggregates": [{"fn": "median", "field": "amount"}]}, {"aggregates": [{"fn": "sum"}]}, {"group_by": "nosuch"}, {"order_by": "nosuch", "group_by": "status"}, {"having": [{"field": "nosuch", "op": "eq", "value": 1}]}, {"aggregates": [{"fn": "count"}] * 2}, {"aggregates": [{"fn": "sum", "field": "amount", "alias": f"a{i}"} for i in range(33)]}])
def test_errors(ask, r):
    assert "error" in ask("aggregate", object="jobs", **r)


def test_time_sums_are_refused(agg):
    assert "error" in agg("gaps", "sum d")


@pytest.mark.parametrize("limit, n", [(None, 120_000), (0, 120_000), ("all", 120_000), (7, 7)])
def test_groups_are_whole(spark, limit, n):
    table = adapt(spark.range(240_000).selectExpr("id % 120000 AS g"), "many")
    found = aggregate(table, [{"fn": "count", "alias": "n"}], "g", having=[{"field": "n", "op": "gte", "value": 2}], limit=limit)
    assert found.count() == n and found.first()["g"] == 0


def test_responses_hold_all_groups_or_fail(spark, engine):
    small = Engine(spark, engine.catalog.files.root, response_rows=3)
    r = {"mode": "aggregate", "dir": "t", "object": "jobs", "aggregates": [{"fn": "count"}], "group_by": "status,region"}
    assert "more than 3 groups" in small.request(r)["error"] and "more than 3 groups" in small.request(r | {"format": "csv"})["error"]
    assert len(small.request(r | {"limit": 3})) == 3 and small.frame(r).count() == 4
