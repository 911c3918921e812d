"""Tokens, scopes and trusted addresses."""

from keystrata.api import Engine


def test_access(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"), guarded=True)
    local = lambda **r: e.request(r, "127.0.0.1")
    away = lambda token, **r: e.request(r | {"auth": token}, "10.1.1.1")
    assert local(mode="create-object", dir="a", object="o", fields=["n:int"])["status"] == "created"
    local(mode="create-object", dir="b", object="o", fields=["n:int"])
    for token, scope in {"read-all-0": {"perm": "r"}, "write-a-00": {"dir": "a"}, "admin-b-00": {"dir": "b", "perm": "rwx"}, "object-a-o": {"dir": "a", "object": "o", "perm": "rwx"}, "root-00000": {"perm": "rwx"}}.items():
        assert local(mode="add-token", token=token, **scope)["status"] == "token_added"
    denied, size, put = {"error": "permission denied"}, {"mode": "size", "object": "o"}, {"mode": "bulk-delete", "object": "o", "keys": ["x"]}
    assert away("nosuch", **size, dir="a") == {"error": "auth failed"} and away("", **size, dir="a") == {"error": "auth failed"}
    assert away("read-all-0", **size, dir="b") == 0 and away("read-all-0", **put, dir="a") == denied
    assert away("write-a-00", **put, dir="a") == {"deleted": 0} and away("write-a-00", **size, dir="b") == denied and away("write-a-00", mode="truncate", dir="a", object="o") == denied
    assert away("admin-b-00", mode="create-object", dir="b", object="p", fields=["n:int"])["status"] == "created" and away("admin-b-00", mode="stats") == denied
    assert away("object-a-o", mode="truncate", dir="a", object="o")["status"] == "truncated" and away("object-a-o", mode="create-object", dir="a", object="p", fields=["n:int"]) == denied
    assert "uptime_ms" in away("root-00000", mode="stats")
    assert {"token": "obje...-a-o", "scope": "a/o", "perm": "rwx"} in local(mode="list-tokens")
    assert local(mode="remove-token", fingerprint="root...0000")["status"] == "token_removed" and away("root-00000", mode="stats") == {"error": "auth failed"}
    assert local(mode="add-ip", ip="10.1.1.1") == ["10.1.1.1"] and away("", **size, dir="a") == 0
    assert local(mode="remove-ip", ip="10.1.1.1") == [] and "error" in local(mode="remove-dir", dir="a") and "error" in local(mode="add-token", token="x", object="o")
    assert "root-00000" not in (tmp_path / "root" / "_access.json").read_text()
