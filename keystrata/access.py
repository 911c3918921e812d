"""Who may do what: tokens with a scope and a permission, and trusted addresses.

Tokens are kept as digests. A request passes if it comes from a trusted address, or if its token's scope
covers its dir and object and the permission covers its mode: r reads, rw also writes, rwx also
administers what the scope covers; server-wide modes need a global rwx token."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from .plans.types import RequestError
from .sources.storage import Storage

READ = {"get", "exists", "not-exists", "size", "orphaned", "find", "count", "aggregate", "keys", "fetch", "get-file", "get-file-path", "list-files", "list-objects", "describe-object"}
WRITE = {"insert", "update", "delete", "bulk-insert", "bulk-insert-delimited", "bulk-update", "bulk-update-delimited", "bulk-delete", "put-file", "delete-file", "sequence"}
OBJECT_ADMIN = {"truncate", "vacuum", "backup", "recount", "add-field", "remove-field", "rename-field", "add-index", "remove-index", "reindex"}
DIR_ADMIN = {"create-object", "drop-object", "export-schema", "import-schema"}
LOCAL = ("127.0.0.1", "::1")


def digest(token: str) -> str:
    return hashlib.sha256(token.encode()).hexdigest()


class Access:
    def __init__(self, files: Storage, trusted: Iterable[str] = LOCAL):
        self.files, self.path, self.always = files, files.path("_access.json"), set(trusted)

    def _load(self) -> dict:
        return json.loads(self.files.read(self.path)) if self.files.exists(self.path) else {"tokens": [], "ips": []}

    def _save(self, state: dict) -> None:
        self.files.write(self.path, json.dumps(state, indent=1).encode())

    def check(self, r: dict, ip: str | None) -> None:
        state = self._load()
        if ip is not None and (ip in self.always or ip in state["ips"]):
            return
        held = next((t for t in state["tokens"] if t["digest"] == digest(str(r.get("auth") or ""))), None)
        if held is None:
            raise RequestError("auth failed")
        mode, scope = r.get("mode"), (held["dir"], held["object"])
        need = "r" if mode in READ else "w" if mode in WRITE else "x"
        if need not in held["perm"]:
            raise RequestError("permission denied")
        covers = scope[0] is None or (scope[0] == r.get("dir") and (scope[1] is None or scope[1] == r.get("object")))
        if mode in DIR_ADMIN:
            covers = covers and scope[1] is None
        elif need == "x" and mode not in OBJECT_ADMIN:
            covers = scope[0] is None
        if not covers:
            raise RequestError("permission denied")

    def add_token(self, token: str, dir_: str | None = None, name: str | None = None, perm: str = "rw") -> dict:
        if not token or perm not in ("r", "rw", "rwx") or (name and not dir_):
            raise RequestError("invalid token, permission or scope")
        state = self._load()
        shown = f"{token[:4]}...{token[-4:]}"
        state["tokens"] = [t for t in state["tokens"] if t["digest"] != digest(token)]
        state["tokens"].append({"digest": digest(token), "shown": shown, "dir": dir_, "object": name, "perm": perm})
        self._save(state)
        return {"status": "token_added", "token": shown}

    def remove_token(self, token: str | None = None, fingerprint: str | None = None) -> dict:
        state = self._load()
        left = [t for t in state["tokens"] if not (token and t["digest"] == digest(token)) and t["shown"] != fingerprint]
        if len(left) == len(state["tokens"]):
            raise RequestError("unknown token")
        self._save(state | {"tokens": left})
        return {"status": "token_removed"}

    def tokens(self) -> list[dict]:
        return [{"token": t["shown"], "scope": "/".join(x for x in (t["dir"], t["object"]) if x) or "global", "perm": t["perm"]} for t in self._load()["tokens"]]

    def ips(self, add: str | None = None, remove: str | None = None) -> list[str]:
        state = self._load()
        if add or remove:
            state["ips"] = sorted({*state["ips"], *([add] if add else [])} - {remove})
            self._save(state)
        return state["ips"]
