"""MinHash near-duplicates: banding, signatures, verification on full sets, components by stars.

A document's set holds its distinct runs of ``shingle`` words, A-Z in lower case. Documents with
equal sets are one class and go on as one. Each class gets ``BANDS * ROWS`` universal hash minima
(a*x + b over 64 bits, of which the upper 16 are kept); classes that agree in a band share a bucket.
Links are found in two rounds, and neither writes the pairs of a bucket:

1. Each class is compared with one leader, the smallest class of its buckets that it meets in most
   of them. Most members of a group of copies are linked here.
2. Components are formed, and buckets that lie in one component are done. The members of the others
   are grouped by the component of their bucket's leader and dealt into blocks of two chunks of
   ``CHUNK``, so that any two of a group meet in one block. There members of different components
   that share a band are compared, the most alike first, unless links found in the block join them
   already. First the signatures alone are sent, then the sets of those members that need one.

So every bucket pair is either compared or already in one component, and the components are those
of all pairs. A pair is compared first by its signatures (``SLACK`` below the expected agreement:
five standard deviations), then on the full sets: linked if
100 * |intersection| >= threshold * |union|. Two sets at the threshold of 75 share no band with
probability (1 - 0.75**4)**32, five in a million, and are missed then.

Components come from alternating large-star and small-star until nothing changes.

Defined results
---------------
* Fewer words than a shingle: the whole sequence is the one shingle. No words, or null text: an
  empty set, linked with nothing.
* Rows with one id are one node, so they share a component; ``drop_near_duplicates`` keeps the first of them by text
  (null first). Null id: no link; component null, kept.
* Long texts are read whole, in one task each. Repeated rows are rows with one id. An empty table stays empty.
* Other columns pass through; columns of the names added here are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import checkpoint, id_filter, parallelism, rekeyed, ship, through

BANDS, ROWS = 32, 4
#: Allowed shortfall of agreeing signature values against the threshold.
SLACK = 0.19
#: Members of a block in the second round.
CHUNK = 256

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    w = X.words(data, bounds)
    h = w.hashes(lower=True)
    count = np.diff(w.first)
    runs = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(len(count)), runs)
    start = w.first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    s = X.run_hashes(h, start, np.minimum(shingle, count[owner]))
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(count) + 1))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima of all hashes over one set."""
    out = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        part = s[at : at + 2048]
        out = np.minimum(out, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1))
    return (out >> np.uint64(48)).astype(np.uint16)


def _sketch(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    names = ["d", "n", "x", "y", "sig"]
    for batch in batches:
        for a, b, data, bounds in X.chunks(batch.column(1)):
            s, first = shingle_sets(data, bounds, shingle)
            n = np.diff(first)
            one, two = X.mix(s), X.mix(s ^ np.uint64(0x5851F42D4C957F2D))
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)]) for v in (one, two)]
            x, y = (t[first[1:]] - t[first[:-1]] for t in sums)
            sig = [signature(s[i:j]).tobytes() if j > i else None for i, j in X.slices(first)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], X.signed(n), X.signed(x), X.signed(y), pa.array(sig, pa.binary())], names=names)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = np.asarray(batch.column(0))
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(d), BANDS, ROWS).astype(np.uint64)
        key = np.zeros((len(d), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = X.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
        yield pa.RecordBatch.from_arrays([X.signed(key.ravel()), pa.array(np.repeat(d, BANDS))], names=["b", "d"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[int], np.ndarray, list]]:
    """From rows (group, i, j, chunk, id, component, signature[, set]) in the order of the first three: what
    stands below each (group, i, j)."""

    def done(rows: list[tuple]) -> tuple:
        g, c, d, r, sig, *rest = zip(*((x[0], *x[3:]) for x in rows))
        return g[0], np.array(c), np.array(d), np.array(r), np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), -1), list(rest[0]) if rest else []

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:3] != held[-1][:3]:
                yield done(held)
                held = []
            held.append(row)
    if held:
        yield done(held)


def _candidates(c: np.ndarray, r: np.ndarray, sig: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member those after it, in the other chunk if there are two, of another component, that share a
    band and agree in ``least`` values, most alike first."""
    two = c.min() != c.max()
    for x in range(len(c) - 1):
        after = np.arange(x + 1, len(c))
        after = after[(r[after] != r[x]) & ((c[after] != c[x]) | (not two))]
        if not len(after):
            continue
        same = sig[after] == sig[x]
        agree = same.sum(axis=1)
        hit = (agree >= least) & same.reshape(len(after), BANDS, ROWS).all(axis=2).any(axis=1)
        if hit.any():
            yield x, after[hit][np.argsort(-agree[hit], kind="stable")]


def _alike(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Members with a candidate: (group, id, component)."""
    for g, c, d, r, sig, _ in _blocks(batches):
        found = np.zeros(len(d), bool)
        for x, others in _candidates(c, r, sig, least):
            found[x] = True
            found[others] = True
        n = int(found.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g)), pa.array(d[found]), pa.array(r[found])], names=["main", "d", "r"])


def _link(batches: Iterator[pa.RecordBatch], least: int, threshold: int) -> Iterator[pa.RecordBatch]:
    """Verified links between members; a pair that the block's links have joined already needs none."""
    for _, c, d, r, sig, packs in _blocks(batches):
        sets = [np.frombuffer(x, np.uint64) for x in packs]
        above = {x: x for x in set(r.tolist())}

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        links = []
        for x, others in _candidates(c, r, sig, least):
            for y in others.tolist():
                a, b = root(int(r[x])), root(int(r[y]))
                if a == b or 100 * min(len(sets[x]), len(sets[y])) < threshold * max(len(sets[x]), len(sets[y])):
                    continue
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= threshold * (len(sets[x]) + len(sets[y]) - both):
                    above[max(a, b)] = min(a, b)
                    links.append((int(d[x]), int(d[y])))
        cols = list(zip(*links)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["u", "v"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in X.chunks(batch.column(1)):
            s, first = shingle_sets(data, bounds, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([s[i:j].tobytes() for i, j in X.slices(first)], pa.binary())], names=["d", "s"])


def _agree(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) whose signatures agree in ``least`` values or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
        keep = pa.array((one == two).sum(axis=1) >= least)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def _verify(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for s, t in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(s.as_py(), np.uint64), np.frombuffer(t.as_py(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= threshold * (len(a) + len(b) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node that it can reach.

    Each round is a large-star and a small-star, both as a minimum for each node and a join back, so
    that a node's neighbours are never gathered in one place."""
    star = checkpoint(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_star(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(rekeyed(least, "u"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(rekeyed(lower, "u"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        star = checkpoint(small.where("u != v").distinct())
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one root at most, which has none (edges point down)."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    return ends.groupBy("x").agg(F.sum("up").alias("n"), F.min("up").alias("least")).where("n > 1 or (n = 1 and least = 0)").isEmpty()


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_shingles, component_id and kept (the id is its component's)."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    sketch = checkpoint(slim.where(F.col("d").isNotNull()).mapInArrow(lambda it: _sketch(it, shingle), "d long, n long, x long, y long, sig binary"))
    filled = sketch.where("n > 0")
    # one class for each set; its least id stands for it
    classes = checkpoint(filled.groupBy("x", "y", "n").agg(F.min("d").alias("d"), F.any_value("sig").alias("sig")))
    reps = classes.select("d", "sig")

    banded = reps.mapInArrow(_bands, "b long, d long")
    shared = banded.groupBy("b").agg(F.min("d").alias("lead"), F.max("d").alias("last")).where("lead < last").select("b", "lead")
    buckets = checkpoint(banded.join(rekeyed(shared, "b"), "b"))
    votes = buckets.where("d != lead").groupBy("d", "lead").agg(F.count(F.lit(1)).alias("n"))
    first = votes.groupBy("d").agg(F.min(F.struct(-F.col("n"), F.col("lead"))).alias("m")).select(F.col("d").alias("u"), F.col("m.lead").alias("v"))
    least = int(BANDS * ROWS * (threshold / 100 - SLACK))

    def sets_of(nodes: DataFrame) -> DataFrame:
        near = through(slim, id_filter(nodes, "d"), "d")  # of the other texts only what the filter can't tell apart is shuffled
        return checkpoint(near.join(nodes, "d", "left_semi").mapInArrow(lambda it: _sets(it, shingle), "d long, s binary").distinct())

    one = reps.select(F.col("d").alias("u"), F.col("sig").alias("p"))
    two = reps.select(F.col("d").alias("v"), F.col("sig").alias("q"))
    close = checkpoint(first.join(one, "u").join(two, "v").select("u", "v", "p", "q").mapInArrow(lambda it: _agree(it, least), "u long, v long").distinct())
    sets = sets_of(close.select(F.col("u").alias("d")).unionByName(close.select(F.col("v").alias("d"))).distinct())
    one, two = sets.select(F.col("d").alias("u"), F.col("s").alias("p")), sets.select(F.col("d").alias("v"), F.col("s").alias("q"))
    links = checkpoint(close.join(one, "u").join(two, "v").select("u", "v", "p", "q").mapInArrow(lambda it: _verify(it, threshold), "u long, v long").distinct())

    placed = buckets.join(components(links).withColumnRenamed("node", "d"), "d", "left").select("b", "d", F.coalesce("root", "d").alias("r"))
    mixed = placed.groupBy("b").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.min(F.struct("d", "r")).alias("head")).where("lo < hi").select("b", F.col("head.r").alias("main"))
    members = checkpoint(placed.join(rekeyed(mixed, "b"), "b").select("main", "d", "r").distinct())

    def in_blocks(rows: DataFrame) -> DataFrame:
        """Rows (main, d, r, ...) dealt into pairs of chunks of their group, so that any two meet in one."""
        chunks = rows.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("m"))
        dealt = rows.join(rekeyed(chunks, "main"), "main").withColumn("c", F.pmod(F.xxhash64("d"), "m").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        keys = [F.col("main"), F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j")]
        dealt = dealt.select(*keys, "c", "d", "r", *(x for x in rows.columns if x not in ("main", "d", "r")))
        return dealt.repartition(parallelism(docs.sparkSession), "main", "i", "j").sortWithinPartitions("main", "i", "j")

    alike = checkpoint(in_blocks(members.join(reps, "d")).mapInArrow(lambda it: _alike(it, least), "main long, d long, r long").distinct())
    if not alike.isEmpty():
        sets = sets_of(alike.select("d").distinct())
        links = links.unionByName(checkpoint(in_blocks(alike.join(reps, "d").join(sets, "d")).mapInArrow(lambda it: _link(it, least, threshold), "u long, v long").distinct()))
    # classes of one id are tied through that id; copies through their class
    of_class = filled.select("d", "x", "y", "n").join(classes.select("x", "y", "n", F.col("d").alias("c")), ["x", "y", "n"])
    edges = links.unionByName(of_class.select(F.col("d").alias("u"), F.col("c").alias("v")))
    final = components(edges).select(F.col("node").alias("_mh_id"), F.col("root").alias("_mh_root"))
    sizes = sketch.groupBy("d").agg(F.max("n").alias("_mh_n")).withColumnRenamed("d", "_mh_key")
    base = docs.drop(*[c for c in ("n_shingles", "component_id", "kept") if c in docs.columns])
    key = F.col(id_col).cast("long")
    out = base.withColumn("_mh_own", key).join(sizes, F.col("_mh_own") == F.col("_mh_key"), "left").join(final, F.col("_mh_own") == F.col("_mh_id"), "left")
    out = out.withColumns({"n_shingles": F.coalesce("_mh_n", F.lit(0)), "component_id": F.coalesce("_mh_root", "_mh_own")})
    return out.withColumn("kept", F.coalesce(F.col("_mh_own") == F.col("component_id"), F.lit(True))).drop("_mh_own", "_mh_n", "_mh_key", "_mh_id", "_mh_root")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component; of rows with one id, the first by text."""
    rows = docs.withColumn("_mh_key", F.col(id_col).cast("long"))
    marked = near_duplicates(docs.select(id_col, text_col), shingle, threshold, id_col, text_col)
    kept = marked.where("kept").select(F.col(id_col).cast("long").alias("_mh_kept")).where("_mh_kept is not null").distinct()
    repeated = checkpoint(rows.where("_mh_key is not null").groupBy("_mh_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_mh_key"))
    if not repeated.isEmpty():
        # equal texts: by the other columns, as far as they are plain values
        plain = [f.name for f in docs.schema.fields if f.name != text_col and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        several = rekeyed(rows.join(rekeyed(repeated, "_mh_key"), "_mh_key"), "_mh_key").groupBy("_mh_key")
        first = several.agg(F.min_by(F.struct(*docs.columns), F.struct(text_col, *plain)).alias("_mh_row"))
        rows = rows.join(repeated, "_mh_key", "left_anti").select(*docs.columns, "_mh_key").unionByName(first.select("_mh_row.*", "_mh_key"))
    return rows.join(kept, F.col("_mh_key") == F.col("_mh_kept"), "left").where("_mh_key is null or _mh_kept is not null").select(docs.columns)
