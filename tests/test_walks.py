"""Cursor walks: pages that are read ahead are those of single requests, in few plans."""

import itertools

import pytest

from keystrata import walks
from keystrata.api import Engine

N = 400


@pytest.fixture
def walked(engine, ask, make, request, monkeypatch):
    """An object of the test's own, its walk, and the frames that were planned."""
    name, planned = f"walk_{request.node.name.replace('[', '_').replace(']', '').replace('-', '_')}"[:40], []
    make(name, ["g:int", "t:varchar:8"], {f"k{i:03d}": {"g": i * 7 % 9, "t": f"t{i}"} for i in range(N)} | {"none": {"t": "x"}}, ["g"])
    frame = Engine.frame
    monkeypatch.setattr(Engine, "frame", lambda self, r: (planned.append(r["limit"]), frame(self, r))[1])
    return lambda mode="find", **r: ask(mode, object=name, **({"order_by": "g", "limit": 3, "fields": "t"} if mode == "find" else {}) | r), planned


def walk(find, cursor=None, **r):
    while True:
        page = find(cursor=cursor, **r)
        yield from (x["key"] for x in page["rows"])
        if (cursor := page["cursor"]) is None:
            return


def expected(order="asc", keep=lambda i: True):
    return [k for _, k in sorted(((i * 7 % 9, f"k{i:03d}") for i in range(N) if keep(i)), reverse=order == "desc")]


@pytest.mark.parametrize("ahead, r", [(4096, {}), (16, {}), (16, {"order": "desc"}), (16, {"timeout_ms": 600_000}), (16, {"limit": 50}), (16, {"criteria": [{"field": "g", "op": "lt", "value": 4}], "excludedKeys": ["k004", "k009"]})])
def test_few_plans(walked, monkeypatch, ahead, r):
    find, planned = walked
    monkeypatch.setattr(walks, "AHEAD", ahead)
    keep = (lambda i: i * 7 % 9 < 4 and i not in (4, 9)) if "criteria" in r else lambda i: True
    assert list(walk(find, **r)) == expected(r.get("order"), keep)
    assert len(planned) <= (N // ahead + 8 if "timeout_ms" in r else 10)  # a plan for each page would be 60 or more, but for the large pages
    assert ("all" in planned) == (ahead == 16 and "timeout_ms" not in r)


@pytest.mark.parametrize("ahead", [4096, 16])
def test_pages_of_the_current_state(walked, monkeypatch, ahead):
    find, _ = walked
    monkeypatch.setattr(walks, "AHEAD", ahead)
    cursor, seen = None, []
    for _ in range(20):
        page = find(cursor=cursor)
        seen += [x["key"] for x in page["rows"]]
        last, cursor = cursor, page["cursor"]
    assert find(cursor=last) == page  # asked again, from behind where the walk stands
    other = list(itertools.islice(walk(find), 30))  # another walk by the same request
    assert other == expected()[:30]
    find("insert", key="k000a", value={"g": 5, "t": "new"})
    find("bulk-delete", keys=["k399"])
    rest = list(walk(find, cursor, limit=7))
    want = sorted([(i * 7 % 9, f"k{i:03d}") for i in range(N - 1)] + [(5, "k000a")])
    assert seen + rest == [k for _, k in want] and "k000a" in rest
    assert find("add-field", fields=["u:int"])["fields"] and "error" in find(cursor={"g": 1}) and "error" in find(cursor=cursor, order_by="t")


def test_walks_are_bounded(walked, engine):
    find, _ = walked
    for i in range(walks.OPEN + 3):
        assert find(cursor=None, excludedKeys=[f"k{i:03d}"])["cursor"]
    assert len(engine.walks._open) == walks.OPEN
