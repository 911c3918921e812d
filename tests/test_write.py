"""Writes, conditions, bulk forms, sequences, schema evolution, files and discovery."""

import base64
import json
import random
import threading

import pytest

from keystrata.api import Engine
from keystrata.sources.catalog import Conflict


@pytest.fixture
def obj(ask, request):
    """A small object of the test's own."""
    name = request.node.name.replace("[", "_").replace("]", "")[:40]
    assert ask("create-object", object=name, fields=["name:varchar:40", "status:varchar:16", "amount:int"], indexes=["status"])["status"] == "created"
    ask("bulk-insert", object=name, records={"a": {"name": "A", "status": "new", "amount": 1}, "b": {"name": "B", "status": "new", "amount": 2}, "c": {"name": "C", "status": "old", "amount": 3}})
    return lambda mode, **r: ask(mode, object=name, **r)


def test_insert_and_conditions(obj):
    assert obj("insert", key="d", value={"name": "D"}) == {"status": "inserted", "key": "d"}
    assert obj("insert", key="d", value={"name": "DD", "nosuch": 1}) == {"status": "updated", "key": "d"}
    assert obj("get", key="d") == {"name": "DD"}
    assert obj("insert", key="d", value={"name": "x"}, if_not_exists=True) == {"error": "condition_not_met", "current": {"name": "DD"}}
    assert obj("insert", key="e", value={"name": "x"}, if_not_exists=True)["status"] == "inserted"
    assert obj("insert", key="a", value={"name": "x"}, **{"if": [{"field": "status", "op": "eq", "value": "old"}]})["error"] == "condition_not_met"
    assert obj("insert", key="zz", value={"name": "x"}, **{"if": [{"field": "status", "op": "eq", "value": "old"}]}) == {"error": "condition_not_met", "current": None}
    assert "error" in obj("insert", key="k" * 65, value={"name": "x"})
    assert "error" in obj("update", key="a", value={}, **{"if": [{"or": [{"field": "status", "op": "eq", "value": "x"}]}]})


def test_update_and_delete(obj):
    c = lambda v: {"if": [{"field": "amount", "op": "eq", "value": v}]}
    assert obj("update", key="a", value={"status": "paid"}, **c("1")) == {"status": "updated", "key": "a"}
    assert obj("get", key="a") == {"name": "A", "status": "paid", "amount": 1}
    assert obj("update", key="a", value={"status": "x"}, **c("9"))["error"] == "condition_not_met"
    assert obj("update", key="zz", value={"status": "x"}) == {"error": "Not found"}
    assert obj("update", key="a", value={"status": "x"}, dry_run=True)["dry_run"] is True
    assert obj("delete", key="a", dry_run=True)["status"] == "would_delete" and obj("size") == 3
    assert obj("delete", key="a", **{"if": [{"field": "amount", "op": "gt", "value": "0"}]})["status"] == "deleted"
    assert obj("delete", key="a") == {"status": "not_found", "key": "a"} and obj("size") == 2


def test_bulk(obj, tmp_path):
    assert obj("bulk-insert", records=[{"key": "c", "value": {"name": "C2"}}, {"key": "d", "value": {"name": "D"}}, {"key": "d", "value": {"name": "D2"}}]) == {"inserted": 1}
    assert obj("get", keys=["c", "d"]) == {"c": {"name": "C2"}, "d": {"name": "D2"}}
    assert obj("bulk-insert", records={"d": {"name": "x"}, "e": {"name": "E"}}, if_not_exists=True) == {"inserted": 1, "skipped": 1}
    assert obj("bulk-update", records={"a": {"amount": 7}, "zz": {"amount": 1}}) == {"matched": 1, "updated": 1, "skipped": 1}
    assert obj("get", key="a") == {"name": "A", "status": "new", "amount": 7}
    assert obj("bulk-update", criteria={"status": "new"}, value={"status": "done"}, dry_run=True) == {"matched": 2, "updated": 0, "skipped": 0, "dry_run": True}
    assert obj("bulk-update", criteria={"status": "new"}, value={"status": "done"}, **{"if": [{"field": "amount", "op": "eq", "value": "7"}]}) == {"matched": 2, "updated": 1, "skipped": 1}
    assert obj("count", criteria={"status": "done"}) == 1
    assert obj("bulk-delete", keys=["a", "zz"]) == {"deleted": 1}
    assert "error" in obj("bulk-delete", criteria=[])
    assert obj("bulk-delete", criteria=[{"field": "name", "op": "exists"}], limit=2) == {"matched": 2, "deleted": 2, "skipped": 0}
    assert obj("keys") == ["d", "e"]
    (tmp_path / "k.json").write_text('["d"]')
    assert obj("bulk-delete", file=str(tmp_path / "k.json")) == {"deleted": 1}


def test_files_in(obj, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"key": "j1", "value": {"name": 'q"uote', "amount": 5}}, {"key": "j2", "value": {"name": "é\n"}}]))
    assert obj("bulk-insert", file=str(tmp_path / "a.json")) == {"inserted": 2}
    (tmp_path / "b.json").write_text(json.dumps({"j3": {"name": "x", "amount": "12"}}, indent=2))
    assert obj("bulk-insert", file=str(tmp_path / "b.json")) == {"inserted": 1}
    assert obj("get", keys=["j1", "j2", "j3"]) == {"j1": {"name": 'q"uote', "amount": 5}, "j2": {"name": "é\n"}, "j3": {"name": "x", "amount": 12}}
    (tmp_path / "c.csv").write_text('p1|"raw"|open|4\np2|short\nnodelimiter\np3|||bad\n')
    assert obj("bulk-insert-delimited", file=str(tmp_path / "c.csv")) == {"inserted": 3}
    assert obj("get", keys=["p1", "p2", "p3"]) == {"p1": {"name": '"raw"', "status": "open", "amount": 4}, "p2": {"name": "short"}, "p3": {}}
    (tmp_path / "d.csv").write_text("p1;;shut\nzz;x\n")
    assert obj("bulk-update-delimited", file=str(tmp_path / "d.csv"), delimiter=";") == {"matched": 1, "updated": 1, "skipped": 1}
    assert obj("get", key="p1") == {"name": '"raw"', "status": "shut", "amount": 4}


def test_json_lines(obj, tmp_path):
    lines = [json.dumps({"key": f"l{i}", "value": {"name": f"n{i}", "amount": i}}) for i in range(50)] + ["", json.dumps({"key": "l3", "value": {"name": "last"}})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    assert obj("bulk-insert", file=str(tmp_path / "x.jsonl")) == {"inserted": 50}
    assert obj("get", keys=["l2", "l3"]) == {"l2": {"name": "n2", "amount": 2}, "l3": {"name": "last"}}


def test_truncation_by_bytes(ask):
    ask("create-object", object="short", fields=["s:varchar:3"])
    ask("insert", object="short", key="k", value={"s": "abcdef"})
    assert ask("get", object="short", key="k") == {"s": "abc"}


def test_defaults_and_sequences(ask):
    d = lambda mode, **r: ask(mode, object="defs", **r)
    assert d("create-object", fields=["s:varchar:9:default=none", "n:long:default=seq(ids)", "u:varchar:36:default=uuid()", "r:varchar:16:default=random(4)", "made:datetime:auto_create", "seen:datetime:auto_update", "v:int"])["status"] == "created"
    d("bulk-insert", records={"a": {"s": "x"}, "b": {}, "c": {"n": 50}})
    got = d("get", keys=["a", "b", "c"])
    assert got["a"]["s"] == "x" and got["b"]["s"] == "none" and {got["a"]["n"], got["b"]["n"]} == {1, 2} and got["c"]["n"] == 50
    assert len(got["a"]["u"]) == 36 and got["a"]["u"] != got["b"]["u"] and len(got["a"]["r"]) == 8 and len(got["a"]["made"]) == 14
    d("update", key="a", value={"v": 1})
    after = d("get", key="a")
    assert after["made"] == got["a"]["made"] and after["u"] == got["a"]["u"] and after["seen"] >= got["a"]["seen"] and after["v"] == 1
    s = lambda action, **r: d("sequence", name="ids", action=action, **r)
    assert s("current")["value"] == 2 and s("next")["value"] == 3 and s("next-batch", batch=5) == {"sequence": "ids", "start": 4, "end": 8}
    assert s("reset")["value"] == 0 and "error" in s("nosuch")


def test_schema_evolution(obj):
    assert obj("add-field", fields=["note:varchar:20", "flag:bool:default=false"])["fields"] == 2
    assert obj("get", key="a") == {"name": "A", "status": "new", "amount": 1}
    obj("update", key="a", value={"note": "hi", "flag": True})
    assert obj("rename-field", old="status", new="state")["status"] == "renamed"
    assert obj("describe-object")["indexes"] == ["state"]
    assert obj("count", criteria={"state": "new"}) == 2
    obj("update", key="b", value={"state": "mid"})
    assert obj("get", keys=["a", "b"], fields="state") == {"a": {"state": "new"}, "b": {"state": "mid"}}
    assert obj("add-field", fields=["status:int"])["fields"] == 1  # the old name again, another type
    assert obj("count", criteria=[{"field": "status", "op": "eq", "value": 0}]) == 3
    assert obj("remove-field", fields=["state"])["indexes_dropped"] == ["state"]
    assert "state" not in obj("get", key="a") and "error" in obj("find", order_by="state")
    assert "error" in obj("add-field", fields=["state:int"])
    assert obj("vacuum", compact=True, splits=16)["splits"] == 16
    assert obj("add-field", fields=["state:int"])["fields"] == 1
    assert obj("get", key="a") == {"name": "A", "amount": 1, "note": "hi", "flag": True}
    assert obj("get", key="c") == {"name": "C", "amount": 3}
    assert obj("recount")["count"] == 3
    assert obj("truncate")["status"] == "truncated" and obj("size") == 0 and obj("find") == []


@pytest.mark.parametrize("spec", ["x", "x:nosuch", "x:varchar", "x:varchar:0", "key:int", "a+b:int", "x:int:sometimes", "x:int:default=abc"])
def test_bad_specs(ask, spec):
    assert "error" in ask("create-object", object="bad", fields=[spec])


def test_objects_and_indexes(ask, obj):
    assert "error" in ask("create-object", object="o", fields=["a:int"], splits=12) and "error" in ask("create-object", object="o", fields=["a:int"], indexes=["b"])
    assert obj("add-index", fields=["amount", "name+status"])["fields"] == ["amount", "name+status"]
    assert obj("add-index", field="amount")["fields"] == [] and obj("remove-index", field="amount")["fields"] == ["amount"] and obj("remove-index", field="amount")["fields"] == []
    assert obj("reindex")["status"] == "reindexed" and "t" in ask("db-dirs")
    assert obj("drop-object")["status"] == "dropped" and obj("drop-object", if_exists=True)["status"] == "not_found" and "error" in obj("drop-object")


def test_discovery_and_manifest(ask, engine):
    ask("create-object", object="dsc", fields=["amount:numeric:10,2", "total:long", "placed:datetime", "sku:varchar:8:default=x"], indexes=["sku"], if_not_exists=True)
    shown = ask("describe-object", object="dsc")
    assert shown["value_size"] == 8 + 8 + 6 + 10 and shown["fields"][0] == {"name": "amount", "type": "numeric", "size": 8, "scale": 2} and shown["record_count"] == 0
    assert "dsc" in ask("list-objects")
    manifest = engine.request({"mode": "export-schema", "dir": "t"})
    only = {"version": 1, "objects": [x | {"dir": "copy"} for x in manifest["objects"] if x["object"] == "dsc"]}
    assert engine.request({"mode": "import-schema", "manifest": only}) == {"created": 1, "skipped": 0}
    assert engine.request({"mode": "import-schema", "manifest": only}) == {"created": 0, "skipped": 1}
    assert engine.request({"mode": "describe-object", "dir": "copy", "object": "dsc"})["fields"] == shown["fields"]
    assert engine.request({"mode": "add-dir", "dir": "fresh"})["dir"] == "fresh" and engine.request({"mode": "remove-dir", "dir": "fresh", "check_empty": True})["dir"] == "fresh"
    assert engine.request({"mode": "nosuch"})["error"] and engine.request("{bad")["error"]
    assert engine.request({"mode": "stats"})["requests"]["describe-object"] >= 1 and "engine_requests_total" in engine.request({"mode": "stats-prom"})


def test_shards_and_backup(obj, engine):
    stats = obj("shard-stats")
    assert sum(s["active"] for s in stats["shards"]) == 3 and len(stats["shards"]) == 8
    obj("update", key="a", value={"amount": 9})
    assert any(x["vacuum"] for x in engine.request({"mode": "vacuum-check"}))
    assert obj("vacuum")["count"] == 3 and obj("size") == 3 and len(obj("find")) == 3
    assert engine.catalog.files.exists(obj("backup")["path"])


def test_blobs(obj, engine):
    data = base64.b64encode(b"hello\x00").decode()
    assert obj("put-file", filename="inv-1.pdf", data=data) == {"status": "stored", "filename": "inv-1.pdf", "bytes": 6}
    assert obj("put-file", filename="inv-1.pdf", data=data, if_not_exists=True)["error"] == "file exists"
    obj("put-file", filename="note.txt", data="")
    assert obj("get-file", filename="inv-1.pdf")["data"] == data and obj("get-file-path", filename="inv-1.pdf")["path"].endswith("files/inv-1.pdf")
    assert obj("list-files", prefix="inv")["files"] == ["inv-1.pdf"] and obj("list-files", pattern="*.txt", match="glob")["total"] == 1
    assert obj("list-files", pattern="1", match="contains")["total"] == 1 and obj("list-files", pattern=".txt", match="suffix")["total"] == 1
    for bad in ("../x", "a/b", "", "a\x01"):
        assert obj("put-file", filename=bad, data=data)["error"] == "invalid filename"
    assert "error" in obj("put-file", filename="x", data="!!") and obj("delete-file", filename="note.txt")["status"] == "deleted" and "error" in obj("get-file", filename="note.txt")


def test_csv_round_trip(ask, tmp_path):
    ask("create-object", object="csv", fields=["status:varchar:16", "amount:int", "note:varchar:64"])
    ask("bulk-insert", object="csv", records={"r1": {"status": "open", "amount": 70, "note": "first"}, "r2": {"status": "open", "amount": 35, "note": "one, two, three"}, "r3": {"status": "shut", "note": 'two\nlines "q"'}})
    text = ask("find", object="csv", format="csv")
    assert text == 'key,status,amount,note\nr1,open,70,first\nr2,open,35,"one, two, three"\nr3,shut,,"two lines ""q"""\n'
    body = ask("find", object="csv", criteria={"status": "open"}, format="csv", delimiter="|").split("\n", 1)[1]
    (tmp_path / "x.csv").write_text(body)
    ask("create-object", object="csv2", fields=["status:varchar:16", "amount:int", "note:varchar:64"])
    assert ask("bulk-insert-delimited", object="csv2", file=str(tmp_path / "x.csv")) == {"inserted": 2}
    assert ask("find", object="csv2") == ask("find", object="csv", criteria={"status": "open"})


def test_two_engines_on_one_root(spark, engine, ask):
    """Writers that share no lock, as in two processes: every commit survives, and a reader finds a whole state at any time."""
    ask("create-object", object="both", fields=["n:int"], if_not_exists=True)
    engines = [engine, Engine(spark, engine.catalog.files.root)]
    stop, seen, wrong = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(engines[0].catalog.meta("t", "both")["count"])
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    def write(i):
        for n in range(3):
            out = engines[i].request({"mode": "insert", "dir": "t", "object": "both", "key": f"{i}-{n}", "value": {"n": n}})
            if out.get("status") != "inserted":
                wrong.append(out)

    reader, writers = threading.Thread(target=read), [threading.Thread(target=write, args=(i,)) for i in range(2)]
    for t in [reader, *writers]:
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert not wrong and seen == sorted(seen) and ask("size", object="both") == 6 and ask("keys", object="both") == [f"{i}-{n}" for i in range(2) for n in range(3)]


def test_commits_conflict(engine, ask):
    ask("create-object", object="race", fields=["n:int"])
    with pytest.raises(Conflict), engine.catalog.writing("t", "race") as meta:
        meta["sequences"]["s"] = 1
        assert ask("sequence", object="race", name="s")["value"] == 1  # the thread's own lock lets it in
    assert ask("sequence", object="race", name="s", action="current")["value"] == 1
    assert not engine.catalog.files.create(engine.catalog._manifest("t", "race", 1), b"{}")


def test_deltas(spark, ask, engine):
    """Against a dictionary, through merges and compactions; a small write leaves the large part of the object alone."""
    rng, held = random.Random(4), {f"k{i}": i for i in range(300)}
    ask("create-object", object="deltas", fields=["n:int"])
    ask("bulk-insert", object="deltas", records={k: {"n": v} for k, v in held.items()})
    base = engine.catalog.meta("t", "deltas")["shards"]
    for step in range(11):
        keys = rng.sample(sorted(held), 3)
        ask("bulk-delete", object="deltas", keys=[keys[0], "nosuch"])
        del held[keys[0]]
        ask("bulk-insert", object="deltas", records={keys[1]: {"n": -step}, f"new{step}": {"n": step}})
        held |= {keys[1]: -step, f"new{step}": step}
    meta = engine.catalog.meta("t", "deltas")
    assert meta["shards"] == base and 0 < len(meta["deltas"]) < 16 and meta["count"] == len(held)
    rows = lambda: {r.key: r.n for r in engine.catalog.table("t", "deltas").data.collect()}
    assert rows() == held and ask("get", object="deltas", key="new10") == {"n": 10} and ask("count", object="deltas", criteria=[{"field": "n", "op": "lt", "value": 0}]) == sum(v < 0 for v in held.values())
    assert ask("bulk-update", object="deltas", criteria=[{"field": "n", "op": "gte", "value": 0}], value={"n": 7})["updated"] == sum(v >= 0 for v in held.values())
    held = {k: 7 if v >= 0 else v for k, v in held.items()}
    assert rows() == held and ask("vacuum", object="deltas")["count"] == len(held) and engine.catalog.meta("t", "deltas")["deltas"] == [] and rows() == held
    path = ask("backup", object="deltas")["path"]
    ask("truncate", object="deltas")
    label = path.rsplit("/", 1)[1]
    assert {r.key: r.n for r in engine.catalog.read("_backups/t", label, engine.catalog.meta_at(path)).collect()} == held


def test_sequence_follows_the_records(ask, tmp_path):
    ask("create-object", object="seqs", fields=["n:long:default=seq(s)", "v:int"])
    ask("bulk-insert", object="seqs", records=[{"key": f"k{i:03d}", "value": {"v": i} | ({"n": 1000 + i} if i % 7 == 0 else {})} for i in range(60)])
    got = ask("find", object="seqs")
    want, n = {}, 0
    for i in range(60):
        n += i % 7 != 0
        want[f"k{i:03d}"] = 1000 + i if i % 7 == 0 else n
    assert {x["key"]: x["value"]["n"] for x in got} == want


def test_stream_takes_the_greatest_of_equal_keys(spark, engine, ask, tmp_path):
    from keystrata.streaming.upsert import upsert_stream

    ask("create-object", object="last", fields=["n:int"])
    spark.createDataFrame([("a", i % 5, i) for i in range(20)], "key string, n int, at int").repartition(4).write.parquet(str(tmp_path / "in"))
    records = spark.readStream.schema("key string, n int, at int").parquet(str(tmp_path / "in"))
    upsert_stream(engine, records, "t", "last", str(tmp_path / "cp"), order_by="at").awaitTermination(60)
    assert ask("get", object="last", key="a") == {"n": 4}


def test_stream(spark, engine, ask, tmp_path):
    from keystrata.streaming.upsert import upsert_stream

    ask("create-object", object="stream", fields=["n:int"])
    spark.createDataFrame([("a", 1), ("b", 2)], "key string, n int").write.parquet(str(tmp_path / "in"))
    records = spark.readStream.schema("key string, n int").parquet(str(tmp_path / "in"))
    q = upsert_stream(engine, records, "t", "stream", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert ask("get", object="stream", keys=["a", "b"]) == {"a": {"n": 1}, "b": {"n": 2}}


def test_written_by_executors(spark, tmp_path):
    from keystrata.sources import formats

    df = spark.createDataFrame([("a", 'x "y"\nz')], "key string, s string").coalesce(1)
    formats.write_csv(df, str(tmp_path / "c"))
    formats.write_json(df, str(tmp_path / "j"), "key")
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["key,s", 'a,"x ""y"" z"']
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"key": "a", "value": {"s": 'x "y"\nz'}}
