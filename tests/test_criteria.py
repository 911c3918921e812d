"""All filter operators: small tables with known answers, and random trees against a Python evaluator."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from keystrata.functions.text import posix_to_java
from keystrata.operators.find import where
from keystrata.plans.table import Table
from keystrata.plans.types import RequestError, Schema, parse_field


@pytest.fixture(scope="module")
def table(spark):
    def build(specs, rows):
        fields = {f.name: f for f in map(parse_field, specs)}
        kind = T.StructType([T.StructField("key", T.StringType()), *(T.StructField(f.name, f.spark_type) for f in fields.values())])
        return Table(spark.createDataFrame([tuple(r) for r in rows], kind).repartition(1).cache(), Schema("t", fields, "key"))

    return build


def hits(t, *leaves, lenient=False):
    items = [dict(zip(("field", "op", "value", "value2"), x)) for x in leaves]
    return "".join(sorted(r.key[-1] for r in where(t, items, lenient=lenient).collect()))


def test_case_and_like(table):
    t = table(["name:varchar:32", "tag:varchar:32"], [("k1", "Nina", "TOP"), ("k2", "nina", "top"), ("k3", "TOM", "top"), ("k4", "tom", "TOP"), ("k5", "Corin", "low"), ("k6", "a_b%c", "ÀB"), ("k7", None, "")])
    for leaf, want in {
        ("name", "like", "Ni%"): "1", ("name", "ilike", "ni%"): "12", ("name", "like", "%ina"): "12", ("name", "like", "%ina%"): "12", ("name", "like", "N%a"): "", ("name", "like", "a_b%c"): "6", ("name", "like", "*om"): "4", ("name", "ilike", "%OM"): "34",
        ("name", "not_like", "%ina"): "34567", ("name", "nlike", "tom"): "123567", ("name", "inlike", "TOM"): "12567", ("name", "contains", "o"): "45", ("name", "icontains", "O"): "345", ("name", "not_contains", "o"): "12367", ("name", "incontains", "O"): "1267",
        ("name", "starts", "t"): "4", ("name", "istarts_with", "t"): "34", ("name", "ends", "m"): "4", ("name", "iends", "m"): "34", ("name", "contains", ""): "1234567", ("tag", "icontains", "àb"): "", ("tag", "icontains", "Àb"): "6",
        ("name", "in", "nina, TOM"): "23", ("name", "in", ("nina", "tom")): "24", ("name", "nin", "nina"): "134567", ("name", "neq", "tom"): "123567", ("name", "eq", "tom"): "4", ("name", "lt", "Z"): "1357", ("name", "gte", "a"): "246", ("name", "between", "D", "U"): "13",
        ("name", "exists"): "123456", ("tag", "not_exists"): "7", ("nosuch", "not_exists"): "1234567", ("nosuch", "neq", "x"): "", ("name+tag", "eq", "tomTOP"): "4", ("name+tag", "exists"): "123456",
    }.items():
        assert hits(t, leaf) == want, leaf


def test_lengths(table):
    t = table(["name:varchar:64"], [("k1", "a"), ("k2", "bob"), ("k3", "alice"), ("k4", "é"), ("k5", ""), ("k6", None)])
    for leaf, want in {("len_eq", 2): "4", ("len_neq", 1): "23456", ("len_lt", 3): "1456", ("len_gt", 2): "23", ("len_lte", 2): "1456", ("len_gte", 3): "23", ("len_between", 1, 2): "14", ("len_between", 0, 1): "156", ("len_eq", 0): "56"}.items():
        assert hits(t, ("name", *leaf)) == want, leaf


def test_regex(table):
    t = table(["email:varchar:64", "phone:varchar:32"], [("k1", "dora@mail.net", "+31612345678"), ("k2", "ned@MAIL.net", "4444444"), ("k3", "no-mail-at-all", "+49 30 1234 567"), ("k4", "fay@q.dev", "none"), ("k5", "abc\n", None)])
    for leaf, want in {
        ("email", "regex", r"^[a-z]+@[a-z]+\.(net|dev)$"): "14", ("phone", "regex", r"^\+[0-9 ]+$"): "13", ("phone", "regex", "[[:digit:]]{7}"): "12", ("email", "regex", "^(.*"): "", ("email", "not_regex", "^(.*"): "12345", ("email", "regex", "[[:upper:]]"): "2",
        ("email", "regex", "abc$"): "", ("phone", "not_regex", "[0-9]"): "45", ("email", "nregex", "@"): "35", ("email", "regex", "(d|y)@"): "24", ("email", "regex", "[^[:alpha:]]+-"): "", ("phone", "regex", "^4+$"): "2", ("phone", "regex", "^$"): "5",
    }.items():
        assert hits(t, leaf) == want, leaf


@pytest.mark.parametrize("posix, java", [("a+?", "(?:a+)?"), (r"[\.]", r"[\\.]"), ("x{2}$", r"x{2}\z"), ("[]a]", r"[\]a]"), ("a{,3}", "a{0,3}"), ("[a&&b]", r"[a\&\&b]"), ("(ab)*+", "(?:(ab)*)+")])
def test_posix(posix, java):
    assert posix_to_java(posix) == "(?s)" + java


@pytest.mark.parametrize("bad", ["(a", "[a", "*a", "a\\", "[[:nosuch:]]", "|*"])
def test_posix_errors(bad):
    with pytest.raises(ValueError):
        posix_to_java(bad)


def test_field_to_field(table):
    d = lambda s: dt.datetime.strptime(s, "%Y%m%d").date()
    t = table(
        ["r:int", "s:int", "name:varchar:32", "alias:varchar:32", "amount:numeric:10,2", "budget:numeric:10,2", "a:date", "b:date"],
        [("k1", 100, 200, "alice", "alice", Decimal(50), Decimal(100), d("20260101"), d("20260201")), ("k2", 300, 200, "bob", "BOB", Decimal(100), Decimal(100), d("20260301"), d("20260301")), ("k3", 150, 150, "carol", "carol", Decimal(75), Decimal(50), d("20260601"), d("20260101")), ("k4", None, 0, None, "", None, None, None, None)],
    )
    for leaf, want in {("r", "lt_field", "s"): "1", ("r", "eq_field", "s"): "34", ("r", "gte_field", "s"): "234", ("name", "eq_field", "alias"): "134", ("name", "neq_field", "alias"): "2", ("amount", "gt_field", "budget"): "3", ("amount", "lte_field", "budget"): "124", ("a", "lt_field", "b"): "1", ("a", "eq_field", "b"): "24", ("r", "eq_field", "name"): "", ("r", "eq_field", "nosuch"): ""}.items():
        assert hits(t, leaf) == want, leaf


def test_numbers_times_and_absence(table):
    t = table(
        ["n:int", "b:byte", "x:double", "m:numeric:10,2", "f:bool", "d:date", "w:datetime"],
        [("k1", -5, 255, 1.5, Decimal("-0.01"), True, dt.date(2026, 1, 2), dt.datetime(2026, 1, 2, 3, 4, 5)), ("k2", 0, 0, 0.0, Decimal(0), False, dt.date(2025, 1, 1), dt.datetime(2025, 1, 1)), ("k3", None, None, None, None, None, None, None)],
    )
    for leaf, want in {
        ("n", "lt", 1): "123", ("n", "neq", 0): "1", ("n", "neq", 7): "123", ("n", "not_in", "0"): "1", ("n", "in", (0, 9)): "23", ("n", "between", -9, -1): "1", ("n", "exists"): "123", ("n", "not_exists"): "", ("n", "contains", "5"): "",
        ("b", "gt", 200): "1", ("x", "gte", "1.5"): "1", ("m", "lt", "0"): "1", ("m", "eq", "-0.01"): "1", ("f", "eq", "true"): "1", ("f", "neq", "true"): "23", ("f", "in", "true,false"): "123",
        ("d", "neq", "20260102"): "2", ("d", "gte", "2026-01-02"): "1", ("d", "exists"): "12", ("d", "not_exists"): "3", ("w", "in", "20260102030405"): "1", ("w", "not_in", "20260102030405"): "2", ("w", "between", "20250101", "20251231"): "2",
    }.items():
        assert hits(t, leaf) == want, leaf
    assert hits(t, ("n", "gt", "abc"), lenient=True) == "" and hits(t, ("n", "gte", "0abc"), lenient=True) == "23"
    with pytest.raises(RequestError):
        hits(t, ("n", "gt", "abc"))
    with pytest.raises(RequestError):
        hits(t, ("b", "eq", "256"))


def test_text_order_of_composites(table):
    t = table(["a:int", "b:int"], [("k1", 1, 2), ("k2", 2, 1), ("k3", 10, 0)])
    assert hits(t, ("a+b", "gt", "20")) == "23" and hits(t, ("a+b", "eq", "12")) == "1" and hits(t, ("a+b", "lt", "x")) == "123"


def test_pushdown(spark, tmp_path, table):
    t = table(["s:varchar:9", "n:int"], [("k1", "ab", 1), ("k2", None, None)])
    t.data.write.parquet(str(tmp_path / "p"))
    plan = where(t.with_data(spark.read.parquet(str(tmp_path / "p"))), [{"field": "s", "op": "starts", "value": "a"}, {"field": "n", "op": "neq", "value": 5}]).select("key")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(s,a)" in plan and "Or(Not(EqualTo(n,5)),IsNull(n))" in plan


def evaluate(node, row):
    """The same semantics, row by row."""
    if "and" in node:
        return all(evaluate(x, row) for x in node["and"])
    if "or" in node:
        return any(evaluate(x, row) for x in node["or"])
    v, w, op = row[node["field"]], node["value"], node["op"]
    v = (0 if node["field"] == "n" else "") if v is None else v
    fold = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    tests = {"eq": v == w, "neq": v != w}
    if isinstance(v, int):
        tests |= {"lt": v < w, "gt": v > w, "lte": v <= w, "gte": v >= w}
    else:
        tests |= {"contains": w in v, "not_contains": w not in v, "starts": v.startswith(w), "ends": v.endswith(w), "icontains": fold(w) in fold(v), "not_ilike": fold(v) != fold(w)}
    return tests[op]


def test_random_trees(table):
    rng = random.Random(11)
    rows = [(f"k{i:03d}", rng.choice([None, -1, 0, 1, 2, 3]), rng.choice([None, "", "a", "Ab", "bA", "éa", "bb"])) for i in range(120)]
    t = table(["n:int", "s:varchar:9"], rows)

    def tree(depth):
        if depth and rng.random() < 0.6:
            return {rng.choice(["and", "or"]): [tree(depth - 1) for _ in range(rng.randint(1, 3))]}
        if rng.random() < 0.5:
            return {"field": "n", "op": rng.choice(["eq", "neq", "lt", "gt", "lte", "gte"]), "value": rng.randint(-2, 4)}
        return {"field": "s", "op": rng.choice(["eq", "neq", "contains", "not_contains", "starts", "ends", "icontains", "not_ilike"]), "value": rng.choice(["", "a", "b", "A", "é"])}

    for _ in range(25):
        c = tree(3)
        want = [k for k, n, s in rows if evaluate(c, {"n": n, "s": s})]
        assert sorted(r.key for r in where(t, [c]).collect()) == want, c
