"""Line deduplication by pairwise alignment.

Lines of ``min_bytes`` or more that hold a word can be anchors; the second, third, ... time that a document has a
line are lines of their own, so an anchor is unique in every document. Overlapping documents are found through shared
anchors: each names the document with the smallest id that has it, so there is one link for each document and
line, however many documents share the line.

A document is aligned with its partners by patience diff, in the order of the rarest anchor that they share, then of
their ids: the longest chain of anchors that are in the same order in both, and around each link of the chain the
equal lines beside it, short and blank ones too. These blocks are deleted from the later document, and the
two are aligned again while an anchor that they share is left, for lines that cross are never in one chain. So an anchor
goes exactly if an earlier document has it, whichever document that is, and one alignment at least deletes it with
its block.

A partner isn't sent whole. The document's lines go to the partner, and what comes back are the partner's lines that
the document has, with a mark for each gap: so a long file is sent once, and a document gathers as many
partners as it has anchors at most, with the lines it shares with them.

Defined results
---------------
* Lines are what ``\\n`` separates, compared byte by byte.
* Null or empty text: no lines, nothing removed; null stays null. Long texts are read whole, in one task.
* Null id: the row is no one's partner and loses nothing. Rows with one id, repeated rows too: neither is earlier,
  each gets its own result; of several texts that hold a line under the smallest id, one is the partner.
* Other columns pass through; columns of the names added here are replaced. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as X
from ._spark import checkpoint, id_filter, rekeyed, replace_columns, ship, through, with_fields

MIN_BYTES = 20
#: Stands for a run of a partner's lines that the document hasn't.
GAP = np.uint64(0)


class Lines:
    """Hashes of all lines of a chunk of texts; ``first[i]:first[i+1]`` are those of text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, min_bytes: int):
        breaks = np.flatnonzero(data == 10)
        whole = bounds[1:] > bounds[:-1]
        owner = np.searchsorted(bounds, breaks, "right") - 1
        starts = np.concatenate([bounds[:-1][whole], breaks + 1])
        text = np.concatenate([np.flatnonzero(whole), owner])
        order = np.lexsort((starts, text))
        self.starts, self.text = starts[order], text[order]
        ends = np.empty(len(order), np.int64)
        ends[:-1] = self.starts[1:] - 1
        last = np.ones(len(order), bool)
        last[:-1] = self.text[1:] != self.text[:-1]
        ends[last] = bounds[1:][self.text[last]]
        self.ends = ends
        self.first = np.searchsorted(self.text, np.arange(len(bounds)))
        w = X.Words(data, bounds, self.starts, self.ends, self.first)
        self.hashes = w.hashes()
        solid = np.concatenate([[0], np.cumsum(~X._SPACE[data])])
        self.anchor = (self.ends - self.starts >= min_bytes) & (solid[self.ends] > solid[self.starts])


def numbered(lines: np.ndarray) -> np.ndarray:
    """Hashes that tell apart the times that one document has a line; the first time keeps the line's own."""
    order = np.argsort(lines, kind="stable")
    ranked = lines[order]
    new = np.ones(len(lines), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    time = np.arange(len(lines)) - np.maximum.accumulate(np.where(new, np.arange(len(lines)), 0))
    out = lines.copy()
    again = time > 0
    out[order[again]] = X.mix(ranked[again] + time[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _sequences(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """All line hashes of each document, packed, and which of them are anchors."""
    for batch in batches:
        for a, b, data, bounds in X.chunks(batch.column(2)):
            lines = Lines(data, bounds, min_bytes)
            packed = [lines.hashes[i:j].tobytes() for i, j in X.slices(lines.first)]
            can = [np.packbits(lines.anchor[i:j]).tobytes() for i, j in X.slices(lines.first)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(packed, pa.binary()), pa.array(can, pa.binary())], names=["d", "k", "lines", "can"])


def _anchors(can: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(can, np.uint8), count=count).astype(bool)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors: (hash, id, text's hash), each once a document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        found = []
        for lines, can in zip(*(batch.column(i).to_pylist() for i in (2, 3))):
            own = np.frombuffer(lines, np.uint64)
            found.append(numbered(own)[_anchors(can, len(own))])
        many = [len(x) for x in found]
        d, k = (np.repeat(np.asarray(batch.column(i)), many) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([X.signed(np.concatenate(found)), pa.array(d), pa.array(k)], names=["h", "d", "k"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partners' lines as far as the document has them, with a mark for each gap."""
    for batch in batches:
        out = []
        for own, other in zip(batch.column(4), batch.column(5)):
            a, b = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(other.as_buffer(), np.uint64)
            b = np.where(np.isin(b, a), b, GAP)
            out.append(b[np.concatenate([[True], (b[1:] != GAP) | (b[:-1] != GAP)])].tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary())], names=["d", "k", "df", "e", "other"])


def chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, which ascend in the first place, that ascends in the second too."""
    tops: list[int] = []
    heads: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        tops[p : p + 1], heads[p : p + 1] = [y], [k]
        back.append(heads[p - 1] if p else -1)
    k, out = heads[-1] if heads else -1, []
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def aligned_blocks(own: np.ndarray, anchor: np.ndarray, partners: list[np.ndarray]) -> np.ndarray:
    """Which of a document's lines go, given its partners' lines in order."""
    gone = np.zeros(len(own), bool)
    mine, names = own.tolist(), numbered(own).tolist()
    for partner in partners:
        other = partner.tolist()
        place = {x: y for y, x in enumerate(numbered(partner).tolist())}
        while pairs := [(i, place[names[i]]) for i in np.flatnonzero(anchor & ~gone).tolist() if names[i] in place]:
            run = chain(pairs)
            edges = [(-1, -1), *run, (len(mine), len(other))]
            for (i0, j0), (i, j), (i1, j1) in zip(edges, edges[1:], edges[2:]):
                gone[i] = True
                x, y = i - 1, j - 1
                while x > i0 and y > j0 and mine[x] == other[y]:
                    gone[x] = True
                    x, y = x - 1, y - 1
                x, y = i + 1, j + 1
                while x < i1 and y < j1 and mine[x] == other[y]:
                    gone[x] = True
                    x, y = x + 1, y + 1
    return gone


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, k, which lines go) of documents with their links (df, e, partner's lines)."""
    for batch in batches:
        out = []
        for lines, can, links in zip(*(batch.column(i) for i in (2, 3, 4))):
            own = np.frombuffer(lines.as_buffer(), np.uint64)
            found = links.values
            order = sorted(zip(found.field(0).to_pylist(), found.field(1).to_pylist(), found.field(2)), key=lambda x: (x[0], x[1], x[2].as_py()))
            out.append(np.packbits(aligned_blocks(own, _anchors(can.as_py(), len(own)), [np.frombuffer(x[2].as_buffer(), np.uint64) for x in order])).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_ld_key", "_ld_print", "_ld_gone"])


def _delete(batches: Iterator[pa.RecordBatch], min_bytes: int, text_at: int, text: str, names: list[str], keep_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = batch.column(batch.schema.get_field_index("_ld_gone")).to_pylist() if "_ld_gone" in batch.schema.names else [None] * batch.num_rows
        column = batch.column(text_at)
        n_lines, n_removed, digest, kept = [], [], [], []
        for a, b, data, bounds in X.chunks(column):
            lines = Lines(data, bounds, min_bytes)
            raw = data.tobytes()
            for row, (i, j) in enumerate(X.slices(lines.first), a):
                n_lines.append(j - i)
                whole = raw[bounds[row - a] : bounds[row - a + 1]]
                gone = [] if masks[row] is None else np.unpackbits(np.frombuffer(masks[row], np.uint8), count=j - i).tolist()
                n_removed.append(sum(gone))
                if n_removed[-1]:
                    whole = b"\n".join([x for x, g in zip(whole.split(b"\n"), gone) if not g])
                digest.append(hashlib.sha256(whole).hexdigest())
                if keep_text:
                    kept.append(whole.decode() if column[row].is_valid else None)
        new = {"n_lines": pa.array(n_lines, pa.int64()), "n_lines_removed": pa.array(n_removed, pa.int64()), "lines_sha256": pa.array(digest, pa.string())}
        if keep_text:
            new[text] = pa.array(kept, pa.string())
        yield replace_columns(batch, names, **new)


def dedup_lines(docs: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` without the lines that align with an earlier document.

    Adds n_lines, n_lines_removed and lines_sha256 (of the text that is left); ``text_col`` holds that
    text, or is dropped with ``keep_text=False``."""
    ship(docs.sparkSession)
    ident, print_ = F.col(id_col).cast("long"), F.xxhash64(F.col(text_col))  # rows of one id are told apart by their texts
    known = docs.select(ident.alias("d"), print_.alias("k"), F.col(text_col).alias("t")).where(F.col("d").isNotNull())
    sequences = known.mapInArrow(lambda it: _sequences(it, min_bytes), "d long, k long, lines binary, can binary").where(F.length("lines") > 0)
    sequences = checkpoint(sequences.groupBy("d", "k").agg(F.max("lines").alias("lines"), F.max("can").alias("can")))
    anchors = sequences.mapInArrow(_shared, "h long, d long, k long")
    holders = anchors.groupBy("h").agg(F.min(F.struct("d", "k")).alias("first"), F.count(F.lit(1)).alias("df")).where("df > 1")
    pairs = anchors.join(rekeyed(holders, "h"), "h").where("first.d < d").groupBy("d", "k", F.col("first.d").alias("e"), F.col("first.k").alias("f")).agg(F.min("df").alias("df"))
    asked = checkpoint(pairs).join(sequences.select("d", "k", "lines"), ["d", "k"])
    partners = rekeyed(sequences.select(F.col("d").alias("e"), F.col("k").alias("f"), F.col("lines").alias("other")), "e")
    met = asked.join(partners, ["e", "f"]).select("d", "k", "df", "e", "lines", "other")
    links = met.mapInArrow(_common, "d long, k long, df long, e long, other binary").groupBy("d", "k").agg(F.collect_list(F.struct("df", "e", "other")).alias("links"))
    masks = checkpoint(sequences.join(links, ["d", "k"]).select("d", "k", "lines", "can", "links").mapInArrow(_align, "_ld_key long, _ld_print long, _ld_gone binary"))
    added = {"n_lines": T.LongType(), "n_lines_removed": T.LongType(), "lines_sha256": T.StringType()}
    base = docs.drop(*[c for c in added if c in docs.columns])
    marked = base.withColumns({"_ld_id": ident, "_ld_own": print_})
    schema = with_fields(T.StructType([f for f in base.schema.fields if keep_text or f.name != text_col]), *added.items())
    names, text_at = schema.names, base.columns.index(text_col)
    found = id_filter(masks, "_ld_key")
    # texts that lose nothing stay where they are
    touched = through(marked, found, "_ld_id").join(masks, (F.col("_ld_id") == F.col("_ld_key")) & (F.col("_ld_own") == F.col("_ld_print")), "left").select(marked.columns + ["_ld_gone"])
    cut = lambda df: df.mapInArrow(lambda it: _delete(it, min_bytes, text_at, text_col, names, keep_text), schema)
    return cut(touched).unionByName(cut(through(marked, found, "_ld_id", listed=False)))
