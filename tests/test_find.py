"""find, count, cursors, formats and joins on small tables with known answers."""

import pytest


IX = {f"k{i}": (("open", "held", "lost")[i % 3], 7 * i % 200, ("north", "south")[i // 3 % 2], f"visit {i}") for i in range(180)}


@pytest.fixture(scope="module", autouse=True)
def tables(make):
    fields = ("status", "amount", "region", "notes")
    rows = {"v1": ("open", 120, "north", "gold"), "v2": ("open", 45, "south", "plain"), "v3": ("held", 310, "north", "gold"), "v4": ("lost", 0, "west", "gone"), "v5": ("back", 80, "south", "twice")}
    make("visits", ["status:varchar:16", "amount:int", "region:varchar:16", "notes:varchar:64"], {k: dict(zip(fields, r)) for k, r in rows.items()}, ["status", "region"])
    make("ix", ["status:varchar:16", "amount:int", "region:varchar:16", "notes:varchar:64"], {k: dict(zip(fields, r)) for k, r in IX.items()}, ["status", "amount", "region"])
    make("mem", ["name:varchar:32", "city:varchar:32"], {"m1": {"name": "Dana", "city": "Oslo"}, "m2": {"name": "Emil", "city": "Rome"}})
    joined = {"w1": (40, "open", "m1", "R1"), "w2": (90, "open", "m1", "R2"), "w3": (15, "open", "m2", "R1"), "w4": (60, "held", "none", "R9")}
    make("jo", ["amount:numeric:10,2", "status:varchar:20", "mem_id:varchar:16", "ref_code:varchar:32"], {k: dict(zip(("amount", "status", "mem_id", "ref_code"), v)) for k, v in joined.items()}, ["status", "mem_id", "ref_code"])
    make("cur", ["n:int", "tag:varchar:16"], {f"k{i}": {"n": 10 * i, "tag": "t"} for i in range(1, 11)}, ["n"])
    make("tie", ["grp:int"], {f"k{i}": {"grp": 5} for i in range(10)}, ["grp"])


@pytest.fixture
def keys(ask):
    def run(obj, criteria, **r):
        found = ask("find", object=obj, criteria=criteria, **r)
        assert isinstance(found, list), found
        return [x["key"] for x in found]

    return run


def leaf(f, op, v=None, v2=None):
    return {"field": f, "op": op, "value": v} | ({"value2": v2} if v2 is not None else {})


def test_or_and_shapes(keys):
    assert keys("visits", [{"or": [leaf("status", "eq", "open"), leaf("status", "eq", "held")]}]) == ["v1", "v2", "v3"]
    assert keys("visits", [leaf("region", "eq", "north"), {"or": [leaf("status", "eq", "open"), leaf("amount", "gt", 200)]}]) == ["v1", "v3"]
    assert keys("visits", {"or": [{"and": [leaf("region", "eq", "south"), leaf("amount", "lt", 50)]}, leaf("notes", "eq", "gone")]}) == ["v2", "v4"]
    assert keys("visits", {"status": "open"}) == ["v1", "v2"]
    assert keys("visits", leaf("amount", "gte", 120)) == ["v1", "v3"]
    assert keys("visits", {"or": [leaf("status", "eq", "open"), leaf("status", "eq", "held")]}, order_by="amount", order="desc") == ["v3", "v1", "v2"]


@pytest.mark.parametrize("criteria", [{"or": []}, [{"and": []}], [{"op": "eq", "value": 1}], "{bad", 5, [5], [leaf("status", "nosuch", 1)], [leaf("amount", "gt", "abc")]])
def test_criteria_errors(ask, criteria):
    assert "error" in ask("find", object="visits", criteria=criteria)


def test_depth(ask):
    c = leaf("status", "eq", "open")
    for _ in range(17):
        c = {"and": [c]}
    assert "error" in ask("find", object="visits", criteria=c)


def test_intersections(ask):
    n = lambda *c: ask("count", object="ix", criteria=list(c))
    count = lambda test: sum(test(*r) for r in IX.values())
    assert n(leaf("status", "eq", "open"), leaf("region", "eq", "south")) == count(lambda s, a, r, _: s == "open" and r == "south") > 0
    assert n(leaf("status", "eq", "open"), leaf("amount", "gt", 150)) == count(lambda s, a, r, _: s == "open" and a > 150) > 0
    assert n(leaf("status", "eq", "held"), leaf("amount", "between", 20, 60)) == count(lambda s, a, r, _: s == "held" and 20 <= a <= 60) > 0
    assert n() == len(IX)
    assert len(ask("find", object="ix", criteria=[leaf("status", "eq", "open")], limit=7)) == 7


def test_paging_and_exclusion(keys):
    assert keys("visits", [], offset=1, limit=2) == ["v2", "v3"]
    assert keys("visits", [], excludedKeys=["v1", "v3"], limit=2) == ["v2", "v4"]
    assert keys("visits", [], excludedKeys="v1,v3", limit=0) == ["v2", "v4", "v5"]
    assert keys("visits", [], excludedKeys=[f"x{i}" for i in range(300)] + ["v1"]) == ["v2", "v3", "v4", "v5"]


def test_projection(ask):
    assert ask("find", object="visits", criteria={"status": "held"}, fields="region+status,amount,nosuch") == [{"key": "v3", "value": {"region+status": "northheld", "amount": 310}}]
    assert "error" in ask("find", object="visits", order_by="nosuch")


def test_cursor(ask):
    for order, first in (("asc", 10), ("desc", 100)):
        seen, cursor = [], None
        for _ in range(9):
            page = ask("find", object="cur", order_by="n", order=order, limit=3, cursor=cursor, fields="tag")
            seen += [x["key"] for x in page["rows"]]
            assert all(set(x["value"]) == {"tag"} for x in page["rows"])
            cursor = page["cursor"]
            if cursor is None:
                break
        assert len(seen) == len(set(seen)) == 10 and seen[0] == f"k{first // 10}"
    page = ask("find", object="cur", order_by="n", limit=5, cursor={})
    assert ask("find", object="cur", order_by="n", limit=5, cursor=page["cursor"])["cursor"] is None
    seen, cursor = [], None
    while True:
        page = ask("find", object="tie", order_by="grp", limit=4, cursor=cursor)
        seen += [x["key"] for x in page["rows"]]
        if not (cursor := page["cursor"]):
            break
    assert seen == sorted(seen) and len(seen) == 10
    for bad in ({"order_by": "tag"}, {}, {"order_by": "n", "format": "csv"}, {"order_by": "n", "join": [{"object": "mem", "local": "tag", "remote": "key"}]}, {"order_by": "n", "cursor": {"n": 1}}):
        assert "error" in ask("find", **{"object": "cur", "cursor": None, **bad})


def test_formats(ask):
    assert ask("find", object="visits", criteria={"status": "held"}, format="rows") == {"columns": ["key", "status", "amount", "region", "notes"], "rows": [["v3", "held", 310, "north", "gold"]]}
    assert ask("find", object="visits", criteria={"status": "held"}, format="dict", fields=["amount"]) == {"v3": {"amount": 310}}
    assert ask("find", object="visits", criteria={"status": "open"}, format="csv", fields="amount,notes", delimiter=";") == "key;amount;notes\nv1;120;gold\nv2;45;plain\n"
    assert "error" in ask("find", object="visits", format="xml")


def test_points(ask):
    assert ask("get", object="visits", key="v2") == {"status": "open", "amount": 45, "region": "south", "notes": "plain"}
    assert ask("get", object="visits", key="v2", fields="amount") == {"amount": 45}
    assert ask("get", object="visits", key="zz") == {"error": "Not found"}
    assert ask("get", object="visits", keys=["v5", "zz", "v1"], fields="amount") == {"v5": {"amount": 80}, "zz": None, "v1": {"amount": 120}}
    assert ask("get", object="visits", keys=[]) == {}
    assert ask("get", object="visits", keys=["v5", "zz"], fields="amount", format="csv") == "key,amount\nv5,80\nzz,\n"
    assert ask("exists", object="visits", key="v1") is True and ask("exists", object="visits", key="zz") is False
    assert ask("exists", object="visits", keys=["zz", "v1"]) == {"zz": False, "v1": True}
    assert ask("not-exists", object="visits", keys=["zz", "v1", "yy"]) == ["zz", "yy"]
    assert ask("keys", object="visits", offset=1, limit=2) == ["v2", "v3"]
    assert ask("size", object="visits") == 5 and ask("orphaned", object="visits") == 0
    page = ask("fetch", object="visits", limit=3, fields="amount")
    assert [x["key"] for x in page["results"]] == ["v1", "v2", "v3"]
    assert [x["key"] for x in ask("fetch", object="visits", limit=3, cursor=page["cursor"])["results"]] == ["v4", "v5"]


def join(**j):
    return [{"object": "mem", "local": "mem_id", "remote": "key", "as": "c", **j}]


def test_joins(ask):
    f = lambda **r: ask("find", object="jo", **r)
    inner = f(join=join(fields=["name"]), fields="amount")
    assert inner == {"columns": ["jo.key", "jo.amount", "c.name"], "rows": [["w1", 40, "Dana"], ["w2", 90, "Dana"], ["w3", 15, "Emil"]]}
    assert f(join=join(type="left", fields=["name"]), fields="amount")["rows"][3] == ["w4", 60, None]
    assert f(join=join(fields=["city"]), fields="amount", limit=2, offset=1)["rows"] == [["w2", 90, "Oslo"], ["w3", 15, "Rome"]]
    assert f(join=join(type="left", fields=["city"]), fields="amount", format="csv", limit=4).splitlines()[-1] == "w4,60,"
    own = f(join=[{"object": "jo", "local": "ref_code", "remote": "ref_code", "as": "same", "fields": ["amount"]}], fields="ref_code")
    assert own["rows"] == [["w1", "R1", 40], ["w2", "R2", 90], ["w3", "R1", 40], ["w4", "R9", 60]]
    two = f(join=[*join(fields=["name"]), {"object": "mem", "local": "mem_id", "remote": "key", "as": "d", "type": "left"}], fields=["status"], criteria={"status": "open"})
    assert two["columns"] == ["jo.key", "jo.status", "c.name", "d.name", "d.city"] and len(two["rows"]) == 3
    for bad in (join(**{"as": "jo"}), join() + join(), join(object="nosuch"), join(remote="city"), join(local="nosuch"), join(fields=["nosuch"]), join(fields=["name+city"])):
        assert "error" in f(join=bad)
    assert "error" in f(join=join(), format="dict")


def test_limits(ask):
    assert "number" in ask("find", object="visits", limit="many")["error"] and "page" in ask("find", object="visits", limit="all")["error"]
    assert "page" in ask("find", object="visits", limit=2_000_000)["error"] and "error" in ask("aggregate", object="visits", group_by="status", limit="x") and "error" in ask("fetch", object="visits", limit=[1])


def test_frames_of_all_rows(engine):
    r = {"dir": "t", "object": "ix", "limit": "all"}
    assert engine.frame(r | {"mode": "fetch"}).count() == len(IX) and engine.frame(r | {"mode": "find", "order_by": "amount", "cursor": None}).count() == len(IX)
    assert engine.frame(r | {"mode": "aggregate", "aggregates": [{"fn": "count"}], "group_by": "notes"}).count() == len(IX)


def test_timeout(ask):
    assert ask("count", object="ix", criteria={"status": "open"}, timeout_ms=60000) == 60
    assert ask("find", object="ix", criteria={"status": "open"}, timeout_ms=1)["error"] == "timeout"
