"""Exact top-k inner-product search by pivot-table elimination.

Vectors are integers, floor(256 * x). One more component makes all of them as long as the longest,
so that a larger inner product is a smaller distance. The distances of every vector to ``PIVOTS`` pivots
are computed once and kept beside it; by the triangle inequality the greatest |d(q, p) - d(v, p)| over the pivots
is a lower bound of d(q, v), hence an upper bound of the score.

Vectors and queries are dealt by their nearest pivot into blocks of ``BLOCK`` and ``QUERY_BLOCK``, whose ranges
of distances to each pivot are a summary. Every query has a score to beat: its k-th best in the sample that
the pivots were chosen from. A pair of blocks is met only if its summaries allow a score that some query of it must
beat; the pairs are found among summaries alone, and then query blocks are sent to blocks of vectors. In a
meeting each query looks at the candidates in the order of their bounds and stops when the k-th best score, or the one
to beat, exceeds the next bound. Bounds are widened by the rounding error, and scores are exact, so the result is too.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, nor do
rows without an id; a vector meets only vectors of its own dimension. Rows with one id are the same
row to "other than the query's own", and each can be found; equal rows with a query's id are one query, other vectors
under that id further queries, whose rows are ranked together. Fewer than k candidates give fewer rows, an empty
table none. Scores beyond 2**53 are computed in 64-bit integers. Extra columns are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpoint, parallelism, ship

PIVOTS = 48
BLOCK = 2048
QUERY_BLOCK = 512
#: Vectors from which the pivots are chosen, and whose scores a query must beat.
PIVOT_SAMPLE = 2000
#: Summaries of query blocks that travel together.
PACK = 64


def choose_pivots(vectors: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal."""
    if not len(vectors):
        return vectors
    out = [0]
    near = np.full(len(vectors), np.inf)
    while len(out) < min(count, len(vectors)):
        near = np.minimum(near, ((vectors - vectors[out[-1]]) ** 2.0).sum(axis=1))
        out.append(int(near.argmax()))
    return vectors[out]


def scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[-1])
    if most < 2**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    return queries @ vectors.T


class Pivots:
    """Pivots of one dimension, the squared length of all lifted vectors, and a sample of (ids, vectors)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float, count: int = PIVOTS):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        self.points = choose_pivots(vectors, count).astype(np.float64)
        #: What rounding can add to a difference of distances.
        self.margin = 2e-6 * np.sqrt(longest) + 1e-6

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, self.longest - (x * x).sum(axis=1)))

    def of_vectors(self, vectors: np.ndarray) -> np.ndarray:
        """Distances of vectors, which all are lifted, to the pivots."""
        v = vectors.astype(np.float64)
        return np.sqrt(np.maximum(0, 2 * self.longest - 2 * (v @ self.points.T + np.outer(self._lift(v), self._lift(self.points))))).astype(np.float32)

    def of_queries(self, queries: np.ndarray) -> np.ndarray:
        q = queries.astype(np.float64)
        return np.sqrt(np.maximum(0, (q * q).sum(axis=1)[:, None] + self.longest - 2 * (q @ self.points.T))).astype(np.float32)

    def most(self, squares: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The greatest score of queries of some squared lengths at a distance of ``low`` or more."""
        low = np.maximum(0, low - self.margin)
        return (squares + self.longest - low * low) / 2 + 1e-9 * (1 + self.longest + squares)

    def to_beat(self, q_ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best score in the sample, -inf with fewer."""
        out = np.full(len(queries), -np.inf)
        for i in range(len(queries)):
            got = scores(queries[i : i + 1], self.vectors)[0][self.ids != q_ids[i]]
            if len(got) >= k:
                out[i] = np.partition(got, len(got) - k)[len(got) - k]
        return out


def search_block(ids: np.ndarray, vectors: np.ndarray, to_v: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, to_q: np.ndarray, beat: np.ndarray, pivots: Pivots, k: int) -> tuple[list[tuple[int, int, int]], int]:
    """(query, vector, score) of each query's best k in one block, as far as they reach the score to beat; and how many scores were computed."""
    squares = (queries.astype(np.float64) ** 2).sum(axis=1)
    out, computed = [], 0
    for i in range(len(queries)):
        low = np.abs(to_v - to_q[i]).max(axis=1, initial=0)
        bound = pivots.most(squares[i], low.astype(np.float64))
        order = np.flatnonzero((ids != q_ids[i]) & (bound >= beat[i]))
        order = order[np.argsort(-bound[order])]
        best: list[tuple[int, int]] = []
        floor, at, step = beat[i], 0, 64
        while at < len(order) and bound[order[at]] >= floor:
            part = order[at : at + step]
            computed += len(part)
            got = scores(queries[i : i + 1], vectors[part])[0]
            hit = got >= floor
            best = sorted([*best, *zip((-got[hit]).tolist(), ids[part[hit]].tolist())])[:k]
            if len(best) == k:
                floor = max(floor, -best[-1][0])
            at, step = at + step, step * 2
        out += [(int(q_ids[i]), n, -s) for s, n in best]
    return out, computed


def _packed(x: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them, which the first byte names."""
    most = int(max(x.max(initial=0), -1 - x.min(initial=0)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(rows, -1).astype(np.int64)


def _nearest(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """(dimension, nearest pivot, id, components)."""
    for batch in batches:
        lists = batch.column(1)
        size = np.diff(np.asarray(lists.offsets))
        cell = np.zeros(len(size), np.int32)
        flat, first = np.asarray(lists.values), np.asarray(lists.offsets)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            p = pivots.value.get(dim)
            if p is not None and len(p.points):
                x = flat[first[rows][:, None] + np.arange(dim)]
                cell[rows] = p.of_vectors(x).argmin(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(size.astype(np.int32)), pa.array(cell), batch.column(0), lists], names=["dim", "cell", "id", "x"])


_BLOCK = "b string, dim int, ids binary, data binary, far binary, lo array<float>, hi array<float>, beat binary, least double, square double"


def _blocks(batches: Iterator[pa.RecordBatch], size: int, pivots, k: int) -> Iterator[pa.RecordBatch]:
    """Rows in the order of dimension and nearest pivot to blocks with their distances to the pivots; ``k`` > 0: of queries."""
    held: list[tuple] = []

    def flush() -> pa.RecordBatch:
        dim = held[0][0]
        ids = np.array([r[1] for r in held], np.int64)
        x = np.array([r[2] for r in held], np.int64).reshape(len(held), dim)
        p = pivots.value.get(dim) or Pivots(np.zeros(0, np.int64), np.zeros((0, dim), np.int64), 0.0)
        far = p.of_queries(x) if k else p.of_vectors(x)
        beat = p.to_beat(ids, x, k) if k else np.zeros(0)
        held.clear()
        row = (uuid.uuid4().hex, dim, ids.tobytes(), _packed(x), far.tobytes(), far.min(axis=0).tolist(), far.max(axis=0).tolist(), beat.tobytes(), float(beat.min(initial=np.inf)), float((x.astype(np.float64) ** 2).sum(axis=1).max()))
        kinds = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.binary(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["b", "dim", "ids", "data", "far", "lo", "hi", "beat", "least", "square"])

    for batch in batches:
        for dim, i, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if held and (held[0][0] != dim or len(held) >= size):
                yield flush()
            held.append((dim, i, np.asarray(x.values)))
    if held:
        yield flush()


def _meetings(batches: Iterator[pa.RecordBatch], pivots) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks that can hold a score to beat, from a block's summary and a pack of those of query blocks."""
    for batch in batches:
        for b, dim, lo, hi, pack in zip(*(batch.column(i).to_pylist() for i in range(5))):
            p = pivots.value.get(dim)
            lo, hi = np.array(lo, np.float64), np.array(hi, np.float64)
            keep = []
            for x in pack:
                gap = np.maximum(lo - np.array(x["hi"], np.float64), np.array(x["lo"], np.float64) - hi).max(initial=0)
                if p is None or p.most(np.float64(x["square"]), gap) >= x["least"]:
                    keep.append(x["b"])
            yield pa.RecordBatch.from_arrays([pa.array([b] * len(keep), pa.string()), pa.array(keep, pa.string())], names=["b", "q"])


def _search(batches: Iterator[pa.RecordBatch], pivots, k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, ids, data, far, q_ids, q_data, q_far, beat in zip(*(batch.column(i) for i in range(8))):
            dim = dim.as_py()
            a, b = np.frombuffer(ids.as_buffer(), np.int64), np.frombuffer(q_ids.as_buffer(), np.int64)
            p = pivots.value.get(dim) or Pivots(a[:0], np.zeros((0, dim), np.int64), 0.0)
            to_v, to_q = (np.frombuffer(x.as_buffer(), np.float32).reshape(n, -1) for x, n in ((far, len(a)), (q_far, len(b))))
            rows, _ = search_block(a, _unpacked(data.as_py(), len(a)), to_v, b, _unpacked(q_data.as_py(), len(b)), to_q, np.frombuffer(beat.as_buffer(), np.float64), p, k)
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])


def search(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id ``every`` divides;
    ties go to the smaller id."""
    spark = vectors.sparkSession
    ship(spark)
    x = F.col("x")
    clean = (
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
        .where(F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
        .select("id", F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("x"))
    )
    slots = parallelism(spark)
    square = F.aggregate(x, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    longest = {r["dim"]: r["most"] for r in clean.groupBy(F.size("x").alias("dim")).agg(F.max(square).alias("most")).collect()}  # a row for each dimension
    sample: dict[int, list] = {}
    for r in clean.limit(PIVOT_SAMPLE).collect():
        sample.setdefault(len(r["x"]), []).append(r)
    table = {d: Pivots(np.array([r["id"] for r in rows], np.int64), np.array([r["x"] for r in rows], np.int64).reshape(len(rows), d), longest[d]) for d, rows in sample.items() if d}
    pivots = spark.sparkContext.broadcast(table)

    def blocks_of(rows: DataFrame, parts: int, size: int, k: int) -> DataFrame:
        # by range, so that a cell that many vectors are nearest to is spread over partitions
        placed = checkpoint(rows.mapInArrow(lambda it: _nearest(it, pivots), "dim int, cell int, id long, x array<long>"))
        dealt = placed.repartitionByRange(parts, "dim", "cell", F.xxhash64("id")).sortWithinPartitions("dim", "cell")
        return checkpoint(dealt.mapInArrow(lambda it: _blocks(it, size, pivots, k), _BLOCK))

    blocks = blocks_of(clean, slots, BLOCK, 0)
    asked = blocks_of(clean.where(F.col("id") % every == 0).dropDuplicates(), max(1, slots // 8), QUERY_BLOCK, k)
    # summaries of query blocks, in packs, meet those of all blocks of their dimension
    salt = F.pmod(F.xxhash64("b"), F.lit(slots)).cast("int")
    query_blocks = asked.select("dim", F.struct("b", "lo", "hi", "least", "square").alias("s"), F.spark_partition_id().alias("p"), F.floor(F.monotonically_increasing_id() % (1 << 33) / PACK).alias("n"))
    packs = query_blocks.groupBy("dim", "p", "n").agg(F.collect_list("s").alias("pack")).select("dim", "pack", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("salt"))
    pairs = blocks.select("b", "dim", "lo", "hi", salt.alias("salt")).join(packs, ["dim", "salt"]).select("b", "dim", "lo", "hi", "pack")
    meet = checkpoint(pairs.mapInArrow(lambda it: _meetings(it, pivots), "b string, q string"))
    queries = asked.select(F.col("b").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("far").alias("q_far"), "beat")
    sent = meet.join(queries, "q").repartition(slots, "b")
    joined = sent.join(blocks, "b").select("dim", "ids", "data", "far", "q_ids", "q_data", "q_far", sent["beat"])
    found = joined.mapInArrow(lambda it: _search(it, pivots, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
