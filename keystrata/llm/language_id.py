"""Language identification by rank-order n-gram profiles.

Training counts the n-grams (1 to ``N`` letters, case folded, words padded with a space) of all
labelled training documents and keeps the ``PROFILE`` most frequent of each language, in rank order.
A document's own most frequent n-grams are ranked in the same way, and its language is the one whose
profile is nearest by the out-of-place distance: the sum of the differences in rank, where an n-gram that
the profile lacks costs ``PROFILE``. Ties in frequency are ordered by the n-gram itself, ties in distance
by the language's name.

The score is 1 minus the ratio of the least distance to the second least (1 with one language).

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing was learned;
null labels and null texts teach nothing, repeated rows teach each time; each label has a profile, so the model
is ``PROFILE`` numbers a distinct label; long texts are judged whole; repeated rows each get their result; an empty
table stays empty; other columns pass through; columns of the names added here are replaced."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import checkpoint, replace_columns, ship, with_fields

N = 3
PROFILE = 400
#: Distinct n-grams that a task holds before it hands its counts on.
HELD = 400_000

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letter


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as integers, 21 bits a character; empty if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    known = letters()[code]
    if not known.any():
        return np.zeros(0, np.int64)
    code = np.concatenate([[32], np.where(known, code, 32), [32]])
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    out = [code[code != 32]]
    run = code
    for n in range(2, N + 1):
        run = (run[:-1] << 21) | code[n - 1 :]
        inner = np.ones(len(run), bool)
        for i in range(1, n - 1):  # a space inside joins two words
            inner &= code[i : i + len(run)] != 32
        out.append(run[inner])
    return np.concatenate(out)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, in order."""
    if len(codes) > 4 * size:
        least = np.partition(counts, -size)[-size]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.lexsort((codes, -counts))[:size]]


class Profiles:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.names), len(self.codes) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.codes, profiles[name])] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text) if text and self.names else np.zeros(0, np.int64)
        if not len(g):
            return "und", 0.0
        own = ranked(*np.unique(g, return_counts=True), self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        at = np.where(self.codes[at] == own, at, len(self.codes))
        there = self.rank[:, at]
        distance = np.where(there < 0, self.size, np.abs(there - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        if len(self.names) == 1:
            return self.names[0], 1.0
        second = int(np.partition(distance, 1)[1])
        return self.names[best], float(1 - distance[best] / second) if second else 0.0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}
    size = 0

    def settle() -> None:
        for lang, parts in waiting.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:
                old, n = held[lang]
                codes, inverse = np.unique(np.concatenate([old, codes]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n, counts])).astype(np.int64)
            held[lang] = codes, counts
        waiting.clear()

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            g = grams(text.as_py() or "")
            waiting.setdefault(lang, []).append(g)
            size += len(g)
            if size > 1 << 20:
                settle()
                size = 0
                if sum(len(c) for c, _ in held.values()) > HELD:
                    yield from rows()
    settle()
    yield from rows()


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows of ``docs`` with text and label; ``size`` n-grams a language."""
    ship(docs.sparkSession)
    labelled = docs.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = checkpoint(labelled.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    profiles: dict[str, list[int]] = {}
    for r in counts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= size).orderBy("lang", "r").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def _predict(batches: Iterator[pa.RecordBatch], text: str, profiles: dict[str, list[int]], size: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    model = Profiles(profiles, size)
    for batch in batches:
        found = [model.predict(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
        yield replace_columns(batch, names, lang_pred=pa.array([x[0] for x in found], pa.string()), score=pa.array([x[1] for x in found], pa.float64()))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """``docs`` with lang_pred and score."""
    ship(docs.sparkSession)
    schema = with_fields(docs.schema, ("lang_pred", T.StringType()), ("score", T.DoubleType()))
    names = schema.names
    return docs.mapInArrow(lambda it: _predict(it, text_col, profiles, size, names), schema)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null ids are in no fold."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
