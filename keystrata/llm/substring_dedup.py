"""Substring deduplication by prefix-partitioned suffix trees.

Every window of ``min_words`` consecutive words begins a suffix, and a repeat of that length or more is an internal
node of the suffix tree at that depth or below. The tree isn't built whole: suffixes are split into groups that fit
in memory, and each group's subtree is built alone.

*Sampling.* Neighbouring windows that share a minimizer (the smallest hash of the runs of ``PREFIX`` words inside)
travel as one string, their *context*; equal windows have equal minimizers, so they meet. Equal contexts are one by a
map-side aggregate, so copies of a document cost one context however many there are. A minimizer whose contexts
all lie in one document has no repeat; one with a single context is a single path. Neither needs a tree.

*Groups.* The contexts of a minimizer are one group if there are ``group`` of them at most. Otherwise their suffixes are
told apart by their windows first: one that only one document has is done, and one with more than ``group``
suffixes, which no shorter prefix could bring into a group, is a single node, whose smallest id a distributed minimum
gives. The others are split by the words that they begin with, in steps of half as many more (8, 12, 18, ... words):
at each step a prefix with ``group`` suffixes at most is a group, and the others are lengthened.

*Subtrees* are suffix arrays with the lengths of neighbours' common prefixes. The leaves below a deep internal node (of
``min_words`` or more) are a repeat, and the smallest id among them is the source of the others.

Defined results
---------------
* A word goes if a window covering it also starts in a document with a smaller id. Windows are
  judged on the input. A window that repeats inside one document only stays.
* Null or empty text, and texts of fewer than ``min_words`` words: nothing is removed.
* Null id: the row is never a source and loses nothing. Rows with one id, repeated rows too: each gets its own
  result, and neither is a source for the other.
* Long texts are read whole; a text is in one task.
* Other columns pass through, whatever their names; columns of the names added here are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import checkpoint, id_filter, parallelism, rekeyed, replace_columns, ship, through, with_fields

PREFIX = 8
GROUP = 512
#: Symbols of one in-memory subtree batch.
TREE_SYMBOLS = 1 << 20
#: Rows of one id are told apart by their texts' hashes, as far as a hot id needs to be spread.
PRINTS = 1 << 16


class Contexts:
    """Contexts of a chunk of texts: windows ``low:high`` (starts, in words) that share a minimizer."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, min_words: int):
        self.words = w = X.words(data, bounds)
        self.hashes = h = w.hashes()
        k = min(PREFIX, min_words)
        span = min_words - k + 1
        n = len(h)
        empty = np.zeros(0, np.int64)
        self.low = self.high = self.text = empty
        self.prefix = self.name = np.zeros(0, np.uint64)
        valid = np.zeros(n, bool)
        for a, b in X.slices(w.first):
            if b - a >= min_words:
                valid[a : b - min_words + 1] = True
        if not valid.any():
            return
        at = np.arange(n - k + 1)
        grams = X.run_hashes(h, at, k)
        keyed = (grams & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64) if n < 1 << 24 else grams
        low = self._sliding_min(keyed, span)
        if n < 1 << 24:
            best = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        else:  # a single text of 16 million words: find the place by value
            best = self._leftmost(grams, low, span)
        windows = np.flatnonzero(valid)
        best = best[windows]
        new = np.ones(len(windows), bool)
        new[1:] = (best[1:] != best[:-1]) | (np.diff(windows) != 1)
        lead = np.flatnonzero(new)
        self.low = windows[lead]
        self.high = windows[np.append(lead[1:], len(windows)) - 1] + 1
        anchor = best[lead]
        self.prefix = grams[anchor]
        self.name = X.run_hashes(h, self.low, self.high - self.low + min_words - 1) ^ X.mix((anchor - self.low + 1).astype(np.uint64))
        self.text = np.searchsorted(w.first, self.low, "right") - 1

    @staticmethod
    def _sliding_min(v: np.ndarray, span: int) -> np.ndarray:
        n = len(v)
        rows = -(-n // span)
        padded = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = v
        block = padded.reshape(rows, span)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - span + 1
        return np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) if count > 0 else np.zeros(0, np.uint64)

    @staticmethod
    def _leftmost(v: np.ndarray, low: np.ndarray, span: int) -> np.ndarray:
        out = np.full(len(low), -1, np.int64)
        for back in range(span - 1, -1, -1):
            hit = v[back : back + len(low)] == low
            out[hit] = np.flatnonzero(hit) + back
        return out


def _anchors(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, prints = X.ids_of(batch.column(0))[0], np.asarray(batch.column(1)).astype(np.int32)
        for a, b, data, bounds in X.chunks(batch.column(2)):
            c = Contexts(data, bounds, min_words)
            owner = c.text + a
            if not len(owner):
                continue
            key = np.stack([c.text.astype(np.uint64), c.prefix, c.name], axis=1)
            _, first = np.unique(key[:, 2] ^ X.mix(key[:, 0] ^ X.mix(key[:, 1])), return_index=True)
            owner = owner[first]
            yield pa.RecordBatch.from_arrays([X.signed(c.prefix[first]), X.signed(c.name[first]), X.signed(ids[owner]), pa.array(prints[owner])], names=["p", "c", "d", "k"])


def _extract(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Word hashes of the wanted contexts."""
    for batch in batches:
        ids, wanted = X.ids_of(batch.column(0))[0], batch.column(2)
        for a, b, data, bounds in X.chunks(batch.column(1)):
            c = Contexts(data, bounds, min_words)
            edges = np.searchsorted(c.text, np.arange(b - a + 1))
            rows: list[tuple] = []
            for row in range(a, b):
                lo, hi = edges[row - a], edges[row - a + 1]
                place = {(p, n): j for j, (p, n) in enumerate(zip(c.prefix[lo:hi].view(np.int64).tolist(), c.name[lo:hi].view(np.int64).tolist()), lo)}
                want = wanted[row].values
                for p, n, size in zip(want.field(0).to_pylist(), want.field(1).to_pylist(), want.field(2).to_pylist()):
                    j = place.get((p, n))
                    if j is not None:
                        rows.append((p, n, int(ids[row]), size, c.hashes[c.low[j] : c.high[j] + min_words - 1].tobytes()))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:4]), pa.array(cols[4], pa.binary())], names=["p", "c", "d", "n", "symbols"])


def ladder(min_words: int) -> list[int]:
    """Lengths of prefixes, each half as long again as the one before; the last is a window."""
    out = [min(PREFIX, min_words)]
    while out[-1] < min_words:
        out.append(min(min_words, out[-1] + max(1, out[-1] // 2)))
    return out[1:] or out


def _prefixes(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Each suffix of the contexts (p, c, d, symbols): its place, and the hashes of its prefixes of the ladder's lengths."""
    steps = ladder(min_words)
    for batch in batches:
        for p, c, d, symbols in zip(*(batch.column(i).to_pylist() for i in range(4))):
            h = np.frombuffer(symbols, np.uint64)
            at = np.arange(len(h) - min_words + 1)
            keys = np.stack([X.run_hashes(h, at, n) for n in steps], axis=1).ravel()
            full = lambda x: pa.array(np.full(len(at), x, np.int64))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([full(p), full(c), full(d), pa.array(at.astype(np.int32)), X.list_column(np.arange(len(at) + 1) * len(steps), X.signed(keys))], names=["p", "c", "d", "i", "keys"])


class SuffixTree:
    """The suffix tree of some strings as its leaves in order and the common lengths of neighbours.

    Leaves are the suffixes of ``least`` symbols or more. Ranks at depth 2h order the pairs of ranks at
    depth h; a suffix that has ended ranks before all that go on."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, least: int):
        n = len(symbols)
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(n)
        ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1]
        most, have = int(lengths.max(initial=0)), 1
        while have < most:
            here, beyond = ranks[-1], np.zeros(n, np.int64)
            on = np.flatnonzero(left > have)
            beyond[on] = here[on + have]
            ranks.append(np.unique(here * (n + 1) + beyond, return_inverse=True)[1].astype(np.int64) + 1)
            have *= 2
        leaves = np.flatnonzero(left >= least)
        self.leaves = leaves[np.argsort(ranks[-1][leaves], kind="stable")]
        self.string = np.searchsorted(ends, self.leaves, "right")
        a, b = self.leaves[:-1].copy(), self.leaves[1:].copy()
        self.common = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            # a rank of 2**level symbols is of whole symbols only where so many are left
            ok = (left[np.minimum(a, n - 1)] >= 1 << level) & (left[np.minimum(b, n - 1)] >= 1 << level) & (self.common < np.minimum(left[self.leaves[:-1]], left[self.leaves[1:]]))
            same = np.flatnonzero(ok)
            same = same[ranks[level][a[same]] == ranks[level][b[same]]]
            self.common[same] += 1 << level
            a[same] += 1 << level
            b[same] += 1 << level

    def deep(self, depth: int) -> np.ndarray:
        """For each leaf the topmost node of ``depth`` or more above it; a leaf that stands alone is its own."""
        return np.cumsum(np.concatenate([[0], self.common < depth])) if len(self.leaves) else np.zeros(0, np.int64)

    def maximal_repeats(self, symbols: np.ndarray, lengths: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
        """(length, starts) of the nodes of ``depth`` or more whose leaves don't all follow one symbol."""
        out, n = [], len(self.leaves)
        begins = np.zeros(len(symbols), bool)
        begins[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        for length in np.unique(self.common[self.common >= depth]).tolist():
            edges = np.flatnonzero(np.concatenate([[True], self.common < length, [True]]))
            for lo, hi in zip(edges.tolist(), edges[1:].tolist()):
                if hi - lo < 2 or self.common[lo : min(hi, n) - 1].min() != length:
                    continue
                starts = self.leaves[lo:hi]
                before = {None if begins[s] else int(symbols[s - 1]) for s in starts.tolist()}
                if len(before) > 1 or None in before:
                    out.append((length, np.sort(starts)))
        return out


def _subtrees(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Smallest id below the deep node of each window, for rows (group, p, c, i, d, symbols) sorted by group."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        symbols = [np.frombuffer(r[5], np.uint64) for r in rows]
        lengths = np.array([len(s) for s in symbols])
        tree = SuffixTree(np.concatenate(symbols), lengths, min_words)
        node = tree.deep(min_words)
        least = np.full(int(node.max(initial=-1)) + 1, X.MAX_ID)
        np.minimum.at(least, node, np.array([r[4] for r in rows])[tree.string])
        order = np.argsort(tree.leaves)  # windows in the strings' order again
        lists = X.list_column(np.concatenate([[0], np.cumsum(lengths - min_words + 1)]), pa.array(least[node[order]]))
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))), lists], names=["p", "c", "i", "least"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if size >= TREE_SYMBOLS and held and held[-1][0] != row[0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) // 8
    if held:
        yield solve(held)


def _split(hot: DataFrame, min_words: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Suffixes below large minimizers: those in groups (group, p, c, i, d, symbols), and those that are one node (p, c, i, low)."""
    suffixes = checkpoint(hot.select("p", "c", "d", "symbols").mapInArrow(lambda it: _prefixes(it, min_words), "p long, c long, d long, i int, keys array<long>"))
    last = len(ladder(min_words)) - 1
    key = lambda level: F.xxhash64("p", F.col("keys")[level])

    def counted(left: DataFrame, level: int) -> DataFrame:
        left = left.select("p", "c", "d", "i", "keys").withColumn("g", key(level))
        sizes = left.groupBy("g").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high")
        return checkpoint(left.join(rekeyed(sizes.select("g", "low", "m"), "g"), "g"))

    # windows first: most suffixes of copies have one that is too frequent for any prefix's group, others one of a single document
    windows = counted(suffixes, last)
    suffixes, groups = windows.where(F.col("m") <= group), []
    for level in range(last):
        if suffixes.isEmpty():
            break
        left = counted(suffixes, level)
        groups.append(left.where(F.col("m") <= group).select("g", "p", "c", "i", "d"))
        suffixes = left.where(F.col("m") > group)
    groups.append(suffixes.select(key(last).alias("g"), "p", "c", "i", "d"))
    return reduce(DataFrame.unionByName, groups), windows.where(F.col("m") > group).select("p", "c", "i", "low")


def _cut(batches: Iterator[pa.RecordBatch], min_words: int, text_at: int, names: list[str], text: str, out: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, known = X.ids_of(batch.column(batch.schema.get_field_index("_ss_id")))
        hits = batch.column(batch.schema.get_field_index("_ss_hits")) if "_ss_hits" in batch.schema.names else None
        column = batch.column(text_at)
        valid = np.asarray(column.is_valid())
        n_words, n_removed, digest, kept = [], [], [], []
        for a, b, data, bounds in X.chunks(column):
            c = Contexts(data, bounds, min_words)
            w = c.words
            edges = np.searchsorted(c.text, np.arange(b - a + 1))
            gone = np.zeros(len(w.starts) + 1, np.int64)
            for row in range(a, b):
                if hits is None or not hits[row].is_valid:
                    continue
                lo, hi = edges[row - a], edges[row - a + 1]
                place: dict = {}
                for j in range(lo, hi):
                    place.setdefault((int(c.prefix[j].view(np.int64)), int(c.name[j].view(np.int64))), []).append(j)
                found = hits[row].values
                for p, n, places, least in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), found.field(2), found.field(3)):
                    for j in place.get((p, n), ()):
                        low, high = int(c.low[j]), int(c.high[j])
                        if least.is_valid:
                            at = np.flatnonzero(np.asarray(least.values) < ids[row])
                            at = low + (np.asarray(places.values)[at] if places.is_valid else at)
                            np.add.at(gone, at, 1)
                            np.add.at(gone, at + min_words, -1)
                        else:
                            gone[low] += 1
                            gone[high + min_words - 1] -= 1
            removed = np.cumsum(gone[:-1]) > 0
            raw = data.tobytes()
            for row, (lo, hi) in enumerate(X.slices(w.first), a):
                n_words.append(hi - lo)
                cut = removed[lo:hi]
                n_removed.append(int(cut.sum()))
                stay = np.flatnonzero(~cut) + lo
                digest.append(hashlib.sha256(b" ".join([raw[i:j] for i, j in zip(w.starts[stay].tolist(), w.ends[stay].tolist())])).hexdigest())
                if out is None:
                    continue
                if not valid[row]:
                    kept.append(None)
                    continue
                begin, end = int(bounds[row - a]), int(bounds[row - a + 1])
                if not n_removed[-1]:
                    kept.append(raw[begin:end].decode())
                    continue
                flags = np.concatenate([[False], cut, [False]]).astype(np.int8)
                parts, at = [], begin
                for i, j in zip(np.flatnonzero(np.diff(flags) == 1).tolist(), np.flatnonzero(np.diff(flags) == -1).tolist()):
                    parts.append(raw[at : w.starts[lo + i]])
                    at = int(w.starts[lo + j]) if lo + j < hi else int(w.ends[hi - 1])
                kept.append(b"".join([*parts, raw[at:end]]).decode())
        new = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if out is not None:
            new[text] = pa.array(kept, pa.string())
        yield replace_columns(batch, names, **new)


def dedup_substrings(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, group: int = GROUP) -> DataFrame:
    """``docs`` with repeated passages cut from the later documents.

    Adds n_words, n_removed and kept_sha256 (of the kept words joined by one space); ``text_col``
    holds what is left, with its own white space, or is dropped with ``keep_text=False``.
    ``group`` is the number of contexts up to which a prefix is one in-memory subtree."""
    spark = docs.sparkSession
    ship(spark)
    ident, print_ = F.col(id_col).cast("long"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(PRINTS)).cast("int")
    known = docs.select(ident.alias("d"), print_.alias("k"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    anchors = known.mapInArrow(lambda it: _anchors(it, min_words), "p long, c long, d long, k int")
    contexts = checkpoint(anchors.groupBy("p", "c").agg(F.min(F.struct("d", "k")).alias("first"), F.max("d").alias("most")))
    prefixes = contexts.groupBy("p").agg(F.min("first.d").alias("lo"), F.max("most").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("p", "n")
    shared = checkpoint(contexts.join(rekeyed(prefixes, "p"), "p").select("p", "c", "first.d", "first.k", "n"))
    del contexts, prefixes  # with the last reference their files go

    wanted = shared.where("n > 1").groupBy("d", "k").agg(F.collect_list(F.struct("p", "c", "n")).alias("want"))
    sources = through(known, id_filter(shared.where("n > 1"), "d"), "d")
    pieces = checkpoint(sources.join(wanted, ["d", "k"]).select("d", "t", "want").mapInArrow(lambda it: _extract(it, min_words), "p long, c long, d long, n long, symbols binary").dropDuplicates(["p", "c"]))
    whole = pieces.where(F.col("n") <= group).select(F.col("p").alias("g"), "p", "c", F.lit(-1).alias("i"), "d", "symbols")
    hot = pieces.where(F.col("n") > group)
    split = None
    if not hot.isEmpty():
        groups, split = _split(hot, min_words, group)
        words_ = F.substring("symbols", F.col("i") * 8 + 1, F.lit(8 * min_words))
        whole = whole.unionByName(groups.join(hot.select("p", "c", "symbols"), ["p", "c"]).select("g", "p", "c", "i", "d", words_.alias("symbols")))
    trees = whole.repartition(parallelism(spark), "g").sortWithinPartitions("g").mapInArrow(lambda it: _subtrees(it, min_words), "p long, c long, i int, least array<long>")
    if not hot.isEmpty():
        trees = checkpoint(trees)
    nodes = trees.where("i < 0").select("p", "c", F.array_min("least").alias("least"), F.lit(None).cast("array<int>").alias("at"), F.col("least").alias("nodes"))
    parts = trees.where("i >= 0").select("p", "c", "i", F.col("least")[0].alias("low"))
    parts = (parts if split is None else parts.unionByName(split)).groupBy("p", "c").agg(F.sort_array(F.collect_list(F.struct("i", "low"))).alias("x"))
    nodes = nodes.unionByName(parts.select("p", "c", F.array_min("x.low").alias("least"), F.col("x.i").alias("at"), F.col("x.low").alias("nodes")))
    # a context that a smaller id has goes whole; what its source loses, the trees tell
    sources_of = shared.select("p", "c", F.col("d").alias("source")).join(nodes, ["p", "c"], "left")
    later = F.col("source") < F.col("d")
    hits = checkpoint(
        anchors.join(sources_of, ["p", "c"]).where(later | (F.col("least") < F.col("d")))
        .select("d", "k", F.struct("p", "c", F.when(~later, F.col("at")).alias("at"), F.when(~later, F.col("nodes")).alias("nodes")).alias("x"))
        .groupBy(F.col("d").alias("_ss_key"), F.col("k").alias("_ss_print")).agg(F.collect_set("x").alias("_ss_hits"))
    )
    added = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    base = docs.drop(*[c for c in added if c in docs.columns])
    marked = base.withColumns({"_ss_id": ident, "_ss_own": print_})
    schema = with_fields(T.StructType([f for f in base.schema.fields if keep_text or f.name != text_col]), *added.items())
    names, text_at, out = schema.names, base.columns.index(text_col), text_col if keep_text else None
    found = id_filter(hits, "_ss_key")
    # texts without a hit stay where they are
    touched = through(marked, found, "_ss_id").join(hits, (F.col("_ss_id") == F.col("_ss_key")) & (F.col("_ss_own") == F.col("_ss_print")), "left").select(marked.columns + ["_ss_hits"])
    cut = lambda df: df.mapInArrow(lambda it: _cut(it, min_words, text_at, names, text_col, out), schema)
    return cut(touched).unionByName(cut(through(marked, found, "_ss_id", listed=False)))
