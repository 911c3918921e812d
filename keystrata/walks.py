"""Cursor walks: rows that a client's next pages will ask for, kept between its requests.

Alone, each page is a scan and a top-k of the whole object, so a walk costs its pages times the object. A walk that goes
on reads ahead instead, in windows that double up to ``AHEAD`` rows; beyond, what is left is sorted once and streamed
to the driver, partition by partition. Pages are the same: a walk is taken up only by the same request, at the cursor where
it stands and on the state of the object that it was planned with; any other page begins anew at its cursor."""

from __future__ import annotations

import json
import threading
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, Row

from .operators.find import ALL

#: Walks that are kept (the one unused for longest goes first): each holds ``AHEAD`` rows or a sorted partition.
OPEN, AHEAD = 8, 4096
#: What of an object's metadata decides on pages. Folders have random names, so the same ones hold the same rows.
STATE = ("fields", "indexes", "shards", "deltas")
#: What of a request doesn't decide on the rows.
FREE = ("cursor", "limit", "timeout_ms", "auth")


class Walk:
    def __init__(self) -> None:
        self.read, self.ended = 0, False
        self._ahead: deque[Row] = deque()
        self._rest: Iterator[Row] | None = None

    def page(self, n: int, frame: Callable[[int | str], DataFrame], stream: bool) -> tuple[list[Row], bool]:
        """The next ``n`` rows, and whether there are more. ``frame`` gives rows from here on, as many as asked."""
        if len(self._ahead) <= n and self._rest is None and not self.ended:
            if stream and self.read >= AHEAD:
                self._ahead, self._rest = deque(), frame(ALL).toLocalIterator()
            else:
                size = max(n + 1, min(2 * self.read, AHEAD))
                self._ahead = deque(frame(size).collect())
                self.ended = len(self._ahead) < size
        if self._rest is not None:
            self._ahead.extend(islice(self._rest, n + 1 - len(self._ahead)))
        rows = [self._ahead.popleft() for _ in range(min(n, len(self._ahead)))]
        self.read += len(rows)
        return rows, bool(self._ahead)


class Walks:
    def __init__(self) -> None:
        self._open: OrderedDict[tuple[str, str], tuple[str, Walk]] = OrderedDict()
        self._guard = threading.Lock()

    def _at(self, r: dict, cursor: Any) -> tuple[str, str]:
        cursor = json.loads(cursor) if isinstance(cursor, str) else cursor
        return json.dumps({k: v for k, v in r.items() if k not in FREE}, sort_keys=True, default=str), json.dumps(cursor, sort_keys=True, default=str)

    @staticmethod
    def _state(meta: dict) -> str:
        return json.dumps([meta[k] for k in STATE], sort_keys=True)

    def take(self, r: dict, meta: dict) -> Walk:
        """The walk that stands at the request's cursor, or a new one. It belongs to the caller until it is put back."""
        if not r["cursor"]:
            return Walk()
        with self._guard:
            state, walk = self._open.pop(self._at(r, r["cursor"]), (None, None))
        return walk if walk is not None and state == self._state(meta) else Walk()

    def put(self, r: dict, meta: dict, cursor: dict, walk: Walk) -> None:
        at = self._at(r, cursor)
        with self._guard:
            self._open.pop(at, None)
            self._open[at] = self._state(meta), walk
            while len(self._open) > OPEN:
                self._open.popitem(last=False)
