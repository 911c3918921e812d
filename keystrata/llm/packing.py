"""Best-fit packing of documents into sequences by linear grouping.

Documents are tokenised; longer ones than ``capacity`` are cut into pieces of that many tokens, the
first taking what is over. The packing itself is planned on the histogram of piece lengths, at most
``capacity`` numbers, so the plan costs the same for any number of documents:

1. Large lengths, longest first, are dealt into ``GROUPS`` groups of equal cardinality and rounded
   up to the longest of their group.
2. Configurations over these few sizes are optimised by column generation: a linear program over the
   configurations in its basis, and a knapsack for the one that would improve it. What rounding its solution
   down leaves over goes into the fullest combinations, by dynamic programming.
3. Actual lengths take the places, a configuration at a time: the longest that the place's size allows, at the
   last place the longest that the sequence has room for, and more while one fits. What rounding took
   is so gathered in the later configurations, which run dry before their number is used up.
4. Small pieces, longest first, go where they fit best; then new sequences are opened.

Sequences with equal contents are planned together as one *kind*, so the plan is a table of places
for runs of ranks, of a size set by ``capacity`` and ``GROUPS`` alone. Each piece then finds its place by
its rank among the pieces of its length, which is counted in hashed buckets: no length, however
frequent, is ordered in one task.

Defined results: null text is empty text, one piece with the end token alone. Long texts are cut whole.
Rows with one id, equal ones too, are packed each for itself. Null ids are packed like others; an empty table has
no pieces. Extra columns, whatever their names, aren't kept."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._spark import checkpoint, parallelism, ship
from .byte_bpe import BYTE_LEVEL, MAX_PIECES, PIECE_CHARS, splitter
from .token_counts import byte_alphabet

GROUPS = 32
#: Lengths up to this share of the capacity are small.
SMALL = 1 / 8


class Ids(dict):
    """Packed ids of texts under a byte-level tokenizers file; pieces met before are kept."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        self.special = {x["content"]: array("I", [x["id"]]).tobytes() for x in spec["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [ranks[bytes(to_byte[c] for c in a + b)] for a, b in pairs]
        split = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or order != sorted(order) or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: ids don't follow the merges")
        self.library = tiktoken.Encoding("packing", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.split = splitter(BYTE_LEVEL)
        self.found = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def __missing__(self, piece: str) -> bytes:
        out = array("I", self.library.encode_ordinary(piece)).tobytes()
        if len(self) < MAX_PIECES and len(piece) <= PIECE_CHARS:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.found is None or not self.found.search(text):
            return b"".join(map(self.__getitem__, self.split(text)))
        # the parts between specials, and the specials themselves at odd places
        parts = self.found.split(text)
        return b"".join(self.special[x] if i % 2 else b"".join(map(self.__getitem__, self.split(x))) for i, x in enumerate(parts))


@lru_cache(2)
def ids_of(path: str) -> Ids:
    return Ids(path)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    ids, end, width = ids_of(path), array("I", [end_id]).tobytes(), 4 * capacity
    for batch in batches:
        docs, rows = batch.column(0).to_pylist(), []
        for doc, x in zip(docs, batch.column(1)):
            packed = ids.encode(x.as_py() or "") + end
            at, piece = 0, 0
            to = len(packed) % width or width
            while at < len(packed):
                rows.append((doc, piece, at // 4, (to - at) // 4, zlib.crc32(memoryview(packed)[at:to])))
                at, to, piece = to, to + width, piece + 1
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def fullest(worth: np.ndarray, sizes: list[int], most: list[int], room: int) -> np.ndarray:
    """How many of each size make the most of ``room`` in the sum of ``worth``; ``most`` of each at most."""
    best = np.zeros(room + 1)
    taken: list[np.ndarray] = []  # for each size, how many of it are in the best of every room
    for size, value, n in zip(sizes, worth.tolist(), most):
        many = np.zeros(room + 1, np.int64)
        base = best
        for k in range(1, min(n, room // size) + 1):
            with_k = base[: room + 1 - k * size] + k * value
            better = np.flatnonzero(with_k > best[k * size :] + 1e-12) + k * size
            best = best.copy()
            best[better] = with_k[better - k * size]
            many[better] = k
        taken.append(many)
    out = np.zeros(len(sizes), np.int64)
    for j in range(len(sizes) - 1, -1, -1):
        out[j] = taken[j][room]
        room -= out[j] * sizes[j]
    return out


def column_generation(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, how many of each size): the linear program's solution, rounded down."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.array(counts) / np.diag(basis)
    limits = [capacity // s for s in sizes]
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        enters = fullest(price, sizes, limits, capacity)
        if price @ enters <= 1 + 1e-9:
            break
        d = np.linalg.solve(basis, enters.astype(float))
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leaves = int(ratio.argmin())
        x = np.maximum(0, x - ratio[leaves] * d)
        x[leaves] = ratio[leaves]
        basis[:, leaves] = enters
    return [(int(v + 1e-6), basis[:, j].round().astype(np.int64)) for j, v in enumerate(x) if int(v + 1e-6)]


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(size's index, how many)]) that use up all counts; sizes descend."""
    left, out = np.array(counts, np.int64), []
    for times, many in column_generation(sizes, counts, capacity) if sizes else []:
        times = min([times, *(int(left[j] // many[j]) for j in np.flatnonzero(many))])
        if times:
            left -= times * many
            out.append((times, many))
    own = np.array(sizes, float)
    for lead in range(len(sizes)):
        while left[lead]:
            rest = left.copy()
            rest[lead] -= 1
            many = fullest(own, sizes, rest.tolist(), capacity - sizes[lead])
            many[lead] += 1
            times = int(min(left[j] // many[j] for j in np.flatnonzero(many)))
            left -= times * many
            out.append((times, many))
    return [(times, [(j, int(many[j])) for j in np.flatnonzero(many).tolist()]) for times, many in out]


def substitute(sizes: list[int], chosen: list[tuple[int, list[tuple[int, int]]]], have: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Kinds of sequences with the actual lengths of ``have`` in the places of the configurations, in their order."""
    have, lengths_left = dict(have), sorted(have)
    lows = {x: y for x, y in zip(sizes, [*sizes[1:], 0])}  # a group's lengths are above the next one's longest
    kinds: list[tuple[int, list[int]]] = []

    def fits(limit: int, took: dict[int, int]) -> Iterator[int]:
        """Lengths that are left, from the longest within ``limit`` on."""
        for at in range(bisect_right(lengths_left, limit) - 1, -1, -1):
            if have[lengths_left[at]] > took.get(lengths_left[at], 0):
                yield lengths_left[at]

    def fill(slots: list[int], times: int) -> int:
        """One kind, as often as the lengths allow; how often."""
        took: dict[int, int] = {}
        lengths: list[int] = []
        room = capacity

        def take(s: int) -> None:
            nonlocal room
            took[s] = took.get(s, 0) + 1
            lengths.append(s)
            room -= s

        for size in slots[:-2]:
            if s := next(fits(min(size, room), took), 0):
                take(s)
        if len(slots) > 1:  # the last two together: of the first one's group, the length that leaves the least
            least, pick = capacity + 1, 0
            for s in fits(min(slots[-2], room), took):
                if pick and s <= lows[slots[-2]]:
                    break
                rest = room - s - next(fits(room - s, took | {s: took.get(s, 0) + 1}), 0)
                if rest < least:
                    least, pick = rest, s
                if not least:
                    break
            if pick:
                take(pick)
        while s := next(fits(room, took), 0):
            take(s)
        runs = min([times, *(have[s] // n for s, n in took.items())])
        for s, n in took.items():
            have[s] -= runs * n
            if not have[s]:
                lengths_left.remove(s)
        kinds.append((runs, lengths))
        return runs

    for times, config in chosen:
        while times and lengths_left:
            times -= fill([sizes[j] for j, k in config for _ in range(k)], times)
    while lengths_left:
        fill([capacity], sum(have.values()))
    return kinds


def plan(histogram: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> list[tuple[int, list[int]]]:
    """Kinds of sequences: how many, and the lengths in each. The best of a few plans: with half as many groups, with
    half as many more, and with places filled from the longest or from the fullest configuration on."""
    tries = (_plan(histogram, capacity, g, small, longest) for g in dict.fromkeys((max(1, groups // 2), groups, groups + groups // 2)) for longest in (True, False))
    return min(tries, key=lambda kinds: sum(times for times, _ in kinds))


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: float, longest: bool) -> list[tuple[int, list[int]]]:
    edge = int(capacity * small)
    full = histogram.get(capacity, 0)
    large = {s: n for s, n in histogram.items() if edge < s < capacity and n}
    share = max(1, -(-sum(large.values()) // groups))
    sizes: list[int] = []
    counts: list[int] = []
    for s in sorted(large, reverse=True):
        n = large[s]
        while n:
            if not counts or counts[-1] == share:
                sizes.append(s)
                counts.append(0)
            took = min(n, share - counts[-1])
            counts[-1] += took
            n -= took
    chosen = sorted(configurations(sizes, counts, capacity), key=lambda c: c[1] if longest else [(-sum(sizes[j] * k for j, k in c[1]), 0)])
    kinds: list[tuple[int, list[int]]] = [(full, [capacity])] if full else []
    kinds += substitute(sizes, chosen, large, capacity)
    # best fit of the small ones over kinds by what they have left
    room: dict[int, list[tuple[int, list[int]]]] = {}
    open_rooms: list[int] = []

    def put(times: int, lengths: list[int]) -> None:
        r = capacity - sum(lengths)
        if r not in room:
            room[r] = []
            insort(open_rooms, r)
        room[r].append((times, lengths))

    for times, lengths in kinds:
        put(times, lengths)
    for s in range(edge, 0, -1):
        n = histogram.get(s, 0)
        while n:
            at = bisect_left(open_rooms, s)
            if at == len(open_rooms):
                each = min(capacity // s, n)
                put(n // each, [s] * each)
                n -= n // each * each
                continue
            r = open_rooms[at]
            times, lengths = room[r].pop()
            if not room[r]:
                del room[r]
                open_rooms.pop(at)
            each = min(r // s, n)
            took = min(times, n // each)
            put(took, lengths + [s] * each)
            if took < times:
                put(times - took, lengths)
            n -= took * each
    return [k for ks in room.values() for k in ks]


def places(kinds: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), ordered: where runs of ranks go."""
    rows, ranks, sequence = [], {}, 0
    for times, lengths in kinds:
        offset = 0
        for s in lengths:
            rows.append((s, ranks.get(s, 0), sequence, offset))
            ranks[s] = ranks.get(s, 0) + times
            offset += s
        sequence += times
    return np.array(sorted(rows) or np.zeros((0, 4)), np.int64).reshape(-1, 4)


def _place(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = np.int64(1) << 40
    keys = table[:, 0] * shift + table[:, 1]
    for batch in batches:
        length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank"))
        row = table[np.searchsorted(keys, length * shift + rank, "right") - 1]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(5)), X.signed(row[:, 2] + rank - row[:, 1]), X.signed(np.ascontiguousarray(row[:, 3]))],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    pieces = checkpoint(slim.mapInArrow(lambda it: _pieces(it, path, end_id, capacity), schema))
    buckets = parallelism(docs.sparkSession)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside)).join(base, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(lambda it: _place(it, table), schema + ", sequence_id long, offset long")
