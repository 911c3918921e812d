"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

**Words.** All words are counted, and the counts stay distributed. The ``GROWTH * sqrt(distinct words)`` most
frequent words and the end are tokens of their own, so what the model knows grows with the corpus; the rest
share ``SHARED`` tokens by their last two bytes, inside which a word has its add-one share of the counts.

**Model.** Each token has a context vector; those of the ``CONTEXT`` tokens before, each under a diagonal
position matrix, add up to the prediction, whose product with target vectors (plus a bias) gives scores.
Targets are factored into about sqrt(tokens) classes of equal size: P(token) = P(class) P(token | class), each a
softmax of such products, so a batch is normalised by two matrix products. Classes are cut by bisection from
what the tokens follow (counted over all training texts against the ``NEAR`` most frequent tokens).

**Training** is numpy in the executors: in each of ``ROUNDS`` rounds every task goes over its share of the training
texts in mini-batches, against noise drawn from the classes' and the words' frequencies, and the parameters are
averaged, weighted by tokens. Every training token is used; what a task sends is the model's size.

A table of the most frequent words, ``HEAD`` at most, is broadcast (20 bytes a word); all other words of a text
meet their counts in a join. Scores are log10 probabilities of whole texts, the end included.

Defined results: null or empty text is the end token alone; null ids never train; rows with one id are
scored each for itself, equal rows alike; long texts go through in slices; no training text gives
probability-1 base scores and an untrained model. Extra columns aren't kept."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._spark import checkpoint, parallelism, ship

GROWTH, SHARED = 8, 32
DIM, CONTEXT, NEAR = 16, 3, 24
ROUNDS, BATCH, RATE = 2, 4096, 0.2
#: Noise classes of a mini-batch, noise words of a token.
CLASS_NOISE, WORD_NOISE = 64, 2
HEAD = 1 << 20
#: Words that a task holds before it counts them, tokens that are sorted by class at once, those of them that are
#: normalised at once (their scores stay in a core's cache), numbers in a block of parameters.
HELD, SLICE, ROWS, BLOCK = 1 << 22, 1 << 17, 1 << 10, 1 << 16
#: The bias of an empty slot in sums.
NEVER = np.float32(-1e30)
END_HASH = np.int64(0x454E445F544F4B45)


def suffix_bucket(w: X.Words, which: np.ndarray | None = None) -> np.ndarray:
    """The shared token of each word (of those at ``which``), by its last two bytes."""
    starts, ends = (w.starts, w.ends) if which is None else (w.starts[which], w.ends[which])
    last = X._LOWER[w.data[ends - 1]].astype(np.uint64)
    before = np.where(ends - starts > 1, X._LOWER[w.data[np.maximum(ends - 2, 0)]], 0).astype(np.uint64)
    return (X.mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(SHARED)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, shared token, count), partly added up; the end counts once a text."""
    held: list[np.ndarray] = []
    kinds: list[np.ndarray] = []
    size = texts = 0

    def settle() -> pa.RecordBatch:
        h, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        k = np.concatenate(kinds)[first]
        held.clear()
        kinds.clear()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(k), pa.array(n.astype(np.int64))], names=["h", "k", "n"])

    for batch in batches:
        texts += batch.num_rows
        for _, _, data, bounds in X.chunks(batch.column(0)):
            w = X.words(data, bounds)
            held.append(w.hashes(lower=True).view(np.int64))
            kinds.append(suffix_bucket(w).astype(np.int32))
            size += len(held[-1])
            if size > HELD:
                yield settle()
                size = 0
    if size:
        yield settle()
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([-1], pa.int32()), pa.array([texts], pa.int64())], names=["h", "k", "n"])


def _find(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


class Vocabulary:
    """The head of the word counts, and tokens: 0 the end, then the shared ones, then the own words by hash.
    ``tokens`` is their number, and as a context the beginning."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, own: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.own = np.sort(own)
        self.own_counts = self.counts[_find(self.hashes, self.own)]
        # places of the own words by the low bits of their hashes; -1 none, -2 several
        self.low = np.int64((1 << (16 * len(own)).bit_length()) - 1)
        self.place = np.full(int(self.low) + 1, -1, np.int32)
        bits, n = np.unique(self.own & self.low, return_counts=True)
        self.place[self.own & self.low] = np.arange(len(own))
        self.place[bits[n > 1]] = -2
        self.tokens = 1 + SHARED + len(own)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places in ``own``, -1 where absent."""
        if not len(self.own):
            return np.full(len(h), -1)
        at = self.place[h & self.low].astype(np.int64)
        one, several = np.flatnonzero(at >= 0), np.flatnonzero(at == -2)
        at[one[self.own[at[one]] != h[one]]] = -1
        at[several] = _find(self.own, h[several])
        return at

    def sequence(self, w: X.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts, each after ``CONTEXT`` beginnings and before the end, and the places of the targets."""
        at = self.find(h)
        rest = np.flatnonzero(at < 0)
        at += 1 + SHARED
        at[rest] = 1 + suffix_bucket(w, rest)
        texts = len(w.first) - 1
        seq = np.full(len(h) + (CONTEXT + 1) * texts, self.tokens, np.int64)
        place = np.arange(len(h)) + (CONTEXT + 1) * w.owner() + CONTEXT
        seq[place] = at
        ends = w.first[1:] + (CONTEXT + 1) * np.arange(1, texts + 1) - 1
        seq[ends] = 0
        return seq, np.flatnonzero(seq != self.tokens)

    def count(self, h: np.ndarray) -> np.ndarray:
        """Counts, -1 for words that aren't in the head."""
        out = self.find(h)
        own, rest = np.flatnonzero(out >= 0), np.flatnonzero(out < 0)
        out[own] = self.own_counts[out[own]]
        if len(self.hashes):
            at = _find(self.hashes, h[rest])
            out[rest] = np.where(at >= 0, self.counts[at], -1)
        return out


def _sequences(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for _, _, data, bounds in X.chunks(batch.column(0)):
            w = X.words(data, bounds)
            yield vocabulary.value.sequence(w, w.hashes(lower=True).view(np.int64))


def _count_near(batches: Iterator[pa.RecordBatch], vocabulary, near: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token * (NEAR + 1) + place in ``near`` of the token before, count); the last place is any other token."""
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for seq, at in _sequences(batches, vocabulary):
        c, m = np.unique(seq[at] * (NEAR + 1) + near[seq[at - 1]], return_counts=True)
        code, inverse = np.unique(np.concatenate([code, c]), return_inverse=True)
        n = np.bincount(inverse, np.concatenate([n, m])).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])


@dataclass
class Model:
    """Parameters. Token t stands in ``slot[t]`` = class * width + place; empty slots have a bias of -inf."""

    slot: np.ndarray
    width: int
    R: np.ndarray  # context vectors, the beginning's last
    far: np.ndarray  # diagonal position matrices
    A: np.ndarray  # class vectors and biases
    a: np.ndarray
    Q: np.ndarray  # vectors and biases of the slots
    b: np.ndarray

    NAMES = ("R", "far", "A", "a", "Q", "b")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def with_flat(self, x: np.ndarray) -> Model:
        new, at = {}, 0
        for n in self.NAMES:
            old = getattr(self, n)
            new[n] = x[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Model(self.slot, self.width, **new)

    def prediction(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = self.R.take(seq[at - 1], axis=0) * self.far[0]
        for j in range(1, CONTEXT):
            out += self.R.take(seq[at - 1 - j], axis=0) * self.far[j]
        return out

    def log_probabilities(self, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Normalised natural log-probability of the tokens at some places of a sequence."""
        out = np.empty(len(at))
        # biases are one more row, which a last column of ones meets
        kinds = np.concatenate([self.A.T, self.a[None]])
        inner = np.concatenate([self.Q.reshape(-1, self.width, DIM).transpose(0, 2, 1), np.maximum(self.b, NEVER).reshape(-1, 1, self.width)], axis=1)
        for lo in range(0, len(at), SLICE):
            part = at[lo : lo + SLICE]
            slot = self.slot[seq[part]]
            order = _order(slot, len(self.b))
            kind, place = slot[order] // self.width, slot[order] % self.width
            c = np.ones((len(part), DIM + 1), np.float32)
            c[:, :DIM] = self.prediction(seq, part[order])
            found = np.empty(len(part))
            for i in range(0, len(part), ROWS):
                found[i : i + ROWS] = _log_softmax(c[i : i + ROWS], kinds, kind[i : i + ROWS])
            edges = np.searchsorted(kind, np.arange(len(self.a) + 1)).tolist()
            for k, (first, last) in enumerate(zip(edges, edges[1:])):
                for i in range(first, last, ROWS):
                    j = min(last, i + ROWS)
                    found[i:j] += _log_softmax(c[i:j], inner[k], place[i:j])
            out[lo + order] = found
        return out


def _order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys below ``most``; up to 16 bits it is a radix sort."""
    return np.argsort(keys.astype(np.uint16) if most <= 1 << 16 else keys, kind="stable")


def _log_softmax(c: np.ndarray, table: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Of the scores ``c @ table``. Only rows whose exponentials leave the range of a float are shifted by their maximum."""
    scores = c @ table
    hit = scores[np.arange(len(chosen)), chosen].astype(np.float64)
    with np.errstate(over="ignore", divide="ignore"):
        np.exp(scores, out=scores)
        total = scores @ np.ones(scores.shape[1], scores.dtype)
        out = hit - np.log(total.astype(np.float64))
    odd = np.flatnonzero(~((total > 1e-30) & (total < 1e30)))
    if len(odd):
        scores = c[odd].astype(np.float64) @ table
        top = scores.max(axis=1)
        out[odd] = scores[np.arange(len(odd)), chosen[odd]] - top - np.log(np.exp(scores - top[:, None]).sum(axis=1))
    return out


def bisected(v: np.ndarray, parts: int) -> np.ndarray:
    """Rows of ``v`` in an order whose ``parts`` (a power of 2) equal runs are cut at medians of the direction that varies most."""
    runs = [np.arange(len(v))]
    while len(runs) < parts:
        halves = []
        for rows in runs:
            x = v[rows] - v[rows].mean(axis=0) if len(rows) else v[rows]
            axis = np.linalg.eigh(x.T @ x)[1][:, -1] if len(rows) else np.zeros(v.shape[1])
            order = rows[np.argsort(x @ axis, kind="stable")]
            halves += [order[: (len(rows) + 1) // 2], order[(len(rows) + 1) // 2 :]]
        runs = halves
    return np.concatenate(runs)


def initial(n: np.ndarray, near: np.ndarray, seed: int = 7) -> Model:
    """The model before training, from the tokens' counts and what they follow (tokens x NEAR + 1)."""
    rng = np.random.default_rng(seed)
    tokens = len(n)
    parts = 1 << max(0, round(math.log2(tokens) / 2))
    after = near + 1.0
    lift = np.log(after / after.sum(axis=1, keepdims=True)) - np.log(after.sum(axis=0) / after.sum())
    lift *= np.sqrt(n / (n + 50.0))[:, None]  # few occurrences say little
    order = bisected(lift, parts)
    # the runs differ by one token at most
    sizes = np.array([len(order)])
    while len(sizes) < parts:
        sizes = np.stack([(sizes + 1) // 2, sizes // 2], axis=1).ravel()
    width = int(sizes.max())
    first = np.repeat(np.arange(parts) * width, sizes)
    slot = np.empty(tokens, np.int64)
    slot[order] = first + np.arange(tokens) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    mass = np.zeros(parts * width)
    mass[slot] = n + 0.5
    kinds = mass.reshape(parts, width).sum(axis=1)
    with np.errstate(divide="ignore"):
        b = np.log(mass / np.repeat(kinds, width))
    u, s, _ = np.linalg.svd(lift - lift.mean(axis=0), full_matrices=False)
    v = np.zeros((tokens + 1, DIM))
    k = min(DIM, len(s))
    v[:tokens, :k] = u[:, :k] * s[:k]
    v *= 0.3 / max(1e-9, float(np.sqrt((v * v).mean())))
    draw = lambda *shape: rng.standard_normal(shape) * 0.02
    f32 = lambda x: np.ascontiguousarray(x, np.float32)
    return Model(slot, width, f32(v + draw(*v.shape)), f32(np.full((CONTEXT, DIM), 1 / CONTEXT)), f32(draw(parts, DIM)), f32(np.log(kinds / kinds.sum())), f32(draw(parts * width, DIM)), f32(b))


def _add_rows(rows: np.ndarray, rate: float, *updates: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
    """An Adagrad step on some rows, which may repeat, of each (target, square, slopes)."""
    order = _order(rows, len(updates[0][0]))
    rows = rows[order]
    lead = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    rows = rows[lead]
    for target, square, slopes in updates:
        g = np.add.reduceat(slopes.take(order, axis=0), lead, axis=0)
        s = square.take(rows, axis=0)
        s += g * g
        square[rows] = s
        g *= rate
        g /= np.sqrt(s, out=s)
        g += target.take(rows, axis=0)
        target[rows] = g


class Trainer:
    """Noise-contrastive steps on a model, in place. Noise comes from the frequencies that the biases began with."""

    def __init__(self, model: Model, kinds: np.ndarray, mass: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.kinds, self.mass = kinds, mass  # shares of the classes, of the slots in all
        self.class_sums = np.cumsum(kinds)
        self.slot_sums = np.concatenate([[0.0], np.cumsum(mass)])
        edges = self.slot_sums[:: model.width]
        self.low, self.span = edges[:-1], np.diff(edges)
        self.usable = mass > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.shift = np.log(CLASS_NOISE * kinds).astype(np.float32)
            self.chance = np.where(self.usable, np.log(WORD_NOISE * mass / np.repeat(self.span, model.width)), 0).astype(np.float32)
        self.square = {n: np.full(getattr(model, n).shape, 1e-2, np.float32) for n in Model.NAMES}

    def step(self, seq: np.ndarray, at: np.ndarray, rate: float) -> None:
        m, n = self.m, len(at)
        slot = m.slot[seq[at]]
        order = _order(slot, len(m.b))  # neighbours read the same rows
        at, slot = at[order], slot[order]
        kind = slot // m.width
        before = np.stack([seq[at - 1 - j] for j in range(CONTEXT)])
        r = m.R.take(before, axis=0)
        c = r[0] * m.far[0]
        for j in range(1, CONTEXT):
            c += r[j] * m.far[j]
        # classes: one draw of noise for the batch
        drawn = np.minimum(np.searchsorted(self.class_sums, self.rng.random(CLASS_NOISE)), len(self.kinds) - 1)
        bias = m.a - self.shift
        own, noise = m.A.take(kind, axis=0), m.A[drawn]
        real = np.einsum("nd,nd->n", c, own) + bias[kind]
        fake = c @ noise.T + bias[drawn]
        up, down = _sigmoid(-real), -_sigmoid(fake)
        to_c = down @ noise
        own *= up[:, None]
        to_c += own
        rows = np.concatenate([kind, drawn])
        slopes = np.concatenate([up[:, None] * c, down.T @ c])
        bias = np.concatenate([up, down.sum(axis=0)])
        # words: noise from the target's own class
        u = self.low[kind][:, None] + self.span[kind][:, None] * self.rng.random((n, WORD_NOISE))
        other = np.clip(np.searchsorted(self.slot_sums, u, "right") - 1, (kind * m.width)[:, None], ((kind + 1) * m.width - 1)[:, None])
        both = np.concatenate([slot[:, None], other], axis=1)
        usable = self.usable[both]
        q = m.Q.take(both, axis=0)
        fit = np.einsum("nkd,nd->nk", q, c) + m.b.take(both) - self.chance.take(both)
        if not usable.all():
            fit = np.where(usable, fit, 0)
        slope = -_sigmoid(fit)
        slope[:, 0] += 1
        slope *= usable
        to_c += np.einsum("nk,nkd->nd", slope, q)
        _add_rows(both.ravel(), rate, (m.Q, self.square["Q"], (slope[:, :, None] * c[:, None, :]).reshape(-1, DIM)), (m.b, self.square["b"], slope.ravel()))
        _add_rows(rows, rate, (m.A, self.square["A"], slopes), (m.a, self.square["a"], bias))
        g = np.stack([np.einsum("nd,nd->d", to_c, r[j]) for j in range(CONTEXT)])
        _add_rows(before.ravel(), rate, (m.R, self.square["R"], (to_c[None] * m.far[:, None, :]).reshape(-1, DIM)))
        self.square["far"] += g * g
        m.far += rate * g / np.sqrt(self.square["far"])

    def run(self, seq: np.ndarray, at: np.ndarray, rate: float) -> None:
        at = self.rng.permutation(at)
        for lo in range(0, len(at), BATCH):
            self.step(seq, at[lo : lo + BATCH], rate)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    out = np.clip(x, -30, 30)
    np.exp(np.negative(out, out=out), out=out)
    out += 1
    return np.reciprocal(out, out=out)


def _train(batches: Iterator[pa.RecordBatch], vocabulary, shared, rate: float) -> Iterator[pa.RecordBatch]:
    """Parameters after one pass over a task's texts, in blocks: (block, tokens, numbers times tokens)."""
    trainer, tokens = None, 0
    for seq, at in _sequences(batches, vocabulary):
        if trainer is None:
            model, kinds, mass = shared.value
            trainer = Trainer(model.with_flat(model.flat()), kinds, mass, len(seq))
        trainer.run(seq, at, rate)
        tokens += len(at)
    if trainer is not None:
        x = trainer.m.flat()
        x = np.where(np.isfinite(x), x, 0) * np.float64(tokens)
        for i, lo in enumerate(range(0, len(x), BLOCK)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([float(tokens)]), pa.array([x[lo : lo + BLOCK].astype(np.float32).tobytes()], pa.binary())], names=["i", "w", "x"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for i, w, x in zip(*(c.to_pylist() for c in batch.columns)):
            v = np.frombuffer(x, np.float32).astype(np.float64)
            held[i] = [held[i][0] + w, held[i][1] + v] if i in held else [w, v]
    for i, (w, v) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([w]), pa.array([(v / w).astype(np.float32).tobytes()], pa.binary())], names=["i", "w", "x"])


def train(texts: DataFrame, vocabulary, counts: np.ndarray) -> Model:
    """The model after ``ROUNDS`` rounds over the column ``t`` of ``texts``; ``counts`` are those of the tokens."""
    sc = texts.sparkSession.sparkContext
    size = len(counts)
    top = np.lexsort((np.arange(size), -counts))[:NEAR]
    near = np.full(size + 1, NEAR)
    near[top] = np.arange(len(top))
    found = texts.mapInArrow(lambda it: _count_near(it, vocabulary, near), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size * (NEAR + 1))
    table[np.asarray(found.column("code")).astype(np.int64)] = np.asarray(found.column("n"))
    model = initial(counts, table.reshape(size, NEAR + 1))
    mass = np.zeros(len(model.b))
    mass[model.slot] = counts + 0.5
    mass /= mass.sum()
    kinds = mass.reshape(-1, model.width).sum(axis=1)
    for r in range(ROUNDS):
        shared = sc.broadcast((model, kinds, mass))
        share = texts.where(F.pmod(F.xxhash64("t"), F.lit(ROUNDS)) == r)
        rate = RATE / (1 + r)
        blocks = share.mapInArrow(lambda it: _train(it, vocabulary, shared, rate), "i int, w double, x binary")  # noqa: B023
        got = blocks.repartition(parallelism(texts.sparkSession), "i").mapInArrow(_add_blocks, "i int, w double, x binary").toArrow()
        shared.unpersist()
        if got.num_rows:
            empty = ~np.isfinite(model.flat())
            x = np.frombuffer(b"".join(d for _, d in sorted(zip(got.column("i").to_pylist(), got.column("x").to_pylist()))), np.float32)
            model = model.with_flat(np.where(empty, -np.inf, x))
    return model


def _score(batches: Iterator[pa.RecordBatch], vocabulary, shared, shares: np.ndarray, unit: float, end_count: int) -> Iterator[pa.RecordBatch]:
    """A row for each text, and one for each of its words that isn't in the head; rows of one text have its id and hash."""
    names = ["doc_id", "k", "h", "tf", "n_tokens", "n_known", "base", "score"]
    for batch in batches:
        v, model = vocabulary.value, shared.value
        for a, b, data, bounds in X.chunks(batch.column(2)):
            ids, keys = batch.column(0)[a:b], batch.column(1)[a:b]
            w = X.words(data, bounds)
            h = w.hashes(lower=True).view(np.int64)
            seq, at = v.sequence(w, h)
            neural = np.concatenate([[0.0], np.cumsum(model.log_probabilities(seq, at) / math.log(10))])
            first = w.first + np.arange(len(w.first))
            neural = neural[first[1:]] - neural[first[:-1]]
            count = v.count(h)
            tail = count < 0
            logs = np.log10(np.where(tail, 0, count) + 1.0)
            bucket = seq[at[seq[at] != 0]] - 1
            inside = np.where(bucket < SHARED, logs - shares[np.minimum(bucket, SHARED - 1)], 0.0)
            total = [np.concatenate([[0.0], np.cumsum(x)]) for x in (logs, inside, (count > 0).astype(np.int64))]
            base, extra, known = (t[w.first[1:]] - t[w.first[:-1]] for t in total)
            n = np.diff(w.first) + 1
            base = base + math.log10(end_count + 1) - n * unit
            # the hash spreads one text's rows and those of its rare words over the join
            lone = X.mix(np.asarray(keys.fill_null(0)).astype(np.int64).view(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids, keys, X.signed(lone), pa.nulls(b - a, pa.int64()), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64) + (end_count > 0)), pa.array(base), pa.array(neural + extra)],
                names=names,
            )
            if tail.any():
                owner, hash_ = w.owner()[tail], h[tail]
                order = np.lexsort((hash_, owner))
                owner, hash_ = owner[order], hash_[order]
                lead = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hash_[1:] != hash_[:-1])]))
                tf = np.diff(np.append(lead, len(owner)))
                of, empty = pa.array(owner[lead]), pa.nulls(len(lead), pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(of), keys.take(of), pa.array(hash_[lead]), pa.array(tf.astype(np.int64)), empty, empty, pa.nulls(len(lead), pa.float64()), pa.nulls(len(lead), pa.float64())], names=names)


def fit(docs: DataFrame, train_where: str, text_col: str = "text") -> tuple:
    """What scoring needs, from the rows that ``train_where`` (SQL over ``docs``) picks: counts (distributed), the
    broadcast vocabulary and model, log10 sizes of the shared tokens, and the training tokens, types and ends."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ship(spark)
    training = docs.where(train_where).select(F.col(text_col).alias("t"))
    counts = checkpoint(training.mapInArrow(_count_words, "h long, k int, n long").groupBy("h").agg(F.max("k").alias("k"), F.sum("n").alias("n")))
    kinds = {r["k"]: (r["n"], r["v"]) for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    tokens, types = (sum(x[i] for x in kinds.values()) for i in (0, 1))
    steps = {r["s"]: r["v"] for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("s")).agg(F.count(F.lit(1)).alias("v")).collect()}
    room, least = HEAD, None
    for s in sorted(steps, reverse=True):
        if steps[s] > room:
            break
        room, least = room - steps[s], s
    head = counts.where(F.floor(F.log2("n") * 4) >= (least if least is not None else 1 << 30)).toArrow()
    h, k, n = (np.asarray(head.column(c)) for c in ("h", "k", "n"))
    words = h != END_HASH
    end_count = kinds.get(-1, (0, 0))[0]
    h, k, n = h[words], k[words], n[words]
    top = np.lexsort((h, -n))[: int(GROWTH * math.sqrt(types))]
    top = top[np.argsort(h[top])]
    rest, shares = np.zeros(SHARED), np.zeros(SHARED)
    for j in range(SHARED):
        total, types_in = kinds.get(j, (0, 0))
        own = k[top] == j
        rest[j] = total - int(n[top][own].sum())
        shares[j] = math.log10(rest[j] + types_in - int(own.sum()) + 1)
    vocabulary = sc.broadcast(Vocabulary(h, n, h[top]))
    model = sc.broadcast(train(training, vocabulary, np.concatenate([[end_count], rest, n[top]])))
    return counts, vocabulary, model, shares, (int(tokens), int(types), int(end_count))


def score_documents(docs: DataFrame, train_where: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``, by a model of
    the rows that ``train_where`` (SQL over ``docs``) picks."""
    counts, vocabulary, model, shares, (tokens, types, end_count) = fit(docs, train_where, text_col)
    unit = math.log10(tokens + types + 1)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("k"), F.col(text_col).alias("t"))
    rows = slim.mapInArrow(
        lambda it: _score(it, vocabulary, model, shares, unit, end_count), "doc_id long, k long, h long, tf long, n_tokens long, n_known long, base double, score double"
    )
    found = rows.join(counts.select("h", F.col("n").alias("c")), "h", "left")
    own, c = F.coalesce("tf", F.lit(0)), F.when(F.col("tf").isNotNull(), F.coalesce("c", F.lit(0)))
    # equal rows are added up together, and dealt out again
    copies = F.count("n_tokens")
    logs = F.sum(F.coalesce(own * F.log10(c + 1), F.lit(0.0))) / copies
    summed = found.groupBy("doc_id", "k").agg(
        copies.alias("copies"), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.sum(F.when(c > 0, own).otherwise(0)) / copies).cast("long").alias("n_known"),
        (F.max("base") + logs).alias("base_score"), (F.max("score") + logs).alias("score"),
    )
    each = summed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
