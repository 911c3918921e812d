"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the encoding of its bytes exactly if every neighbouring pair is the encoding of
its own bytes. So each prefix of the input has one last token, and the machine only has to follow
*threads*: one for each place where a token that is still open may have begun, with the trie node
reached since, the token that ends at that place, and the tokens from the last emission to there.
What all threads agree on can't change any more and is emitted, at the latest after as many bytes as
the longest token has. Sets of threads are the states; they and their transitions are made when
first met and kept (up to ``MAX_STATES``, then begun anew), so frequent text costs one dictionary
lookup a byte. Whole matches of the split pattern are kept too, up to ``MAX_PIECES``.

Decoding feeds token bytes to an incremental UTF-8 machine whose state is the unfinished character
(three bytes at most); its transitions on whole tokens are made lazily as well. Bytes that can never
become a character are decoded to U+FFFD.

Defined results: null text is empty text (no ids); long texts, and long matches of the pattern, go through
whole, in memory of their own size; repeated rows each get their result; an empty table stays empty; other
columns pass through; columns of the names added here are replaced."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._spark import replace_columns, ship, with_fields

MAX_STATES = 200_000
MAX_PIECES = 300_000
#: Longer matches of the pattern aren't kept.
PIECE_CHARS = 48

#: Fixed value: the split pattern of the byte-level vocabularies, written with standard classes.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
_ODD = re.compile("[^\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a split pattern. Over characters on which the standard library's classes agree
    with Unicode's, the byte-level pattern runs in the faster of the two engines."""
    slow = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return slow
    fast, odd = _PLAIN.findall, _ODD.search
    return lambda text: slow(text) if odd(text) else fast(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(symbols: list, rank: Callable, join: Callable) -> list:
    """Merge neighbours, lowest rank first and leftmost of equals, with a heap over a linked list."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    parts: list = list(symbols)
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = join(a, b), None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := rank(parts[i], parts[k])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := rank(parts[h], parts[i])) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p is not None]


class Transducer:
    """Bytes to token ids, one byte at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for data, i in ranks.items():
            node = 0
            for b in data:
                down = self.children[node].get(b)
                if down is None:
                    down = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = down
            self.token[node] = i
        self._fits: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.next: list[dict[int, tuple[int, tuple]]] = []
        self.final: list[tuple] = []
        self._state(((0, -1, ()),))

    def _state(self, threads: tuple) -> int:
        s = self.index.get(threads)
        if s is None:
            s = self.index[threads] = len(self.states)
            self.states.append(threads)
            self.next.append({})
            self.final.append(threads[-1][2])
        return s

    def _plain(self, data: bytes) -> list[int]:
        found = merge([data[i : i + 1] for i in range(len(data))], lambda a, b: self.ranks.get(a + b), lambda a, b: a + b)
        return [self.ranks[p] for p in found]

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (-1: the beginning)."""
        ok = self._fits.get((a, b))
        if ok is None:
            want = [b] if a < 0 else [a, b]
            ok = self._plain(b"".join(self.bytes_of[i] for i in want)) == want
            if len(self._fits) < 4 * MAX_STATES:
                self._fits[a, b] = ok
        return ok

    def _move(self, s: int, byte: int) -> tuple[int, tuple]:
        threads, ended = [], None
        for node, last, chain in self.states[s]:
            down = self.children[node].get(byte)
            if down is None:
                continue
            t = self.token[down]
            if ended is None and t >= 0 and self._fit(last, t):
                ended = (0, t, (*chain, t))
            if self.children[down]:
                threads.append((down, last, chain))
        if ended is None:
            raise ValueError(f"byte {byte} isn't in the vocabulary")
        threads.append(ended)
        low, high = min(t[2] for t in threads), max(t[2] for t in threads)
        same = 0
        for x, y in zip(low, high):
            if x != y:
                break
            same += 1
        step = self._state(tuple((n, t, c[same:]) for n, t, c in threads)), low[:same]
        self.next[s][byte] = step
        return step

    def encode(self, data: bytes) -> list[int]:
        s, out, table = 0, [], self.next
        for byte in data:
            step = table[s].get(byte)
            if step is None:
                if len(self.states) >= MAX_STATES:  # inside a match too; only the threads go on
                    threads = self.states[s]
                    self._reset()
                    s, table = self._state(threads), self.next
                step = self._move(s, byte)
            s = step[0]
            if step[1]:
                out += step[1]
        out += self.final[s]
        return out


class Encoder(dict):
    """Text to packed ids; as a dictionary, the ids of the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = BYTE_LEVEL):
        self.machine, self.split = Transducer(ranks), splitter(pattern)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        ids = self.machine.encode(data)
        if len(ids) > 1 and data in self.machine.ranks:  # a vocabulary string that its own merges don't reach is still one token
            ids = [self.machine.ranks[data]]
        out = array("I", ids).tobytes()
        if len(self) < MAX_PIECES and len(piece) <= PIECE_CHARS:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return b"".join(map(self.__getitem__, self.split(text)))


def _open_tail(data: bytes) -> int:
    """Length of an unfinished character at the end."""
    for back in range(1, min(3, len(data)) + 1):
        b = data[-back]
        if b >= 0xC0:
            return back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
        if b < 0x80:
            return 0
    return 0


class Decoder:
    """Token ids to text, token by token; between calls the state is an unfinished character."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.table: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.state = b""

    def _move(self, state: bytes, token: int) -> tuple[str, bytes]:
        data = state + self.bytes_of[token]
        cut = len(data) - _open_tail(data)
        step = data[:cut].decode("utf-8", "replace"), data[cut:]
        self.table.setdefault(state, {})[token] = step
        return step

    def feed(self, ids: Iterable[int]) -> str:
        out, state = [], self.state
        row = self.table.setdefault(state, {})
        for token in ids:
            text, after = row.get(token) or self._move(state, token)
            out.append(text)
            if after != state:
                state, row = after, self.table.setdefault(after, {})
        self.state = state
        return "".join(out)

    def finish(self) -> str:
        rest, self.state = self.state.decode("utf-8", "replace"), b""
        return rest


@lru_cache(4)
def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    encoder = Encoder(load_ranks(path), pattern)
    return encoder, Decoder(encoder.machine.bytes_of)


def _round_trip(batches: Iterator[pa.RecordBatch], text: str, path: str, pattern: str, names: list[str], with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder, decoder = coder(path, pattern)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        new: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        lists = []
        for x in column:
            packed = encoder.encode(x.as_py() or "")
            ids = array("I", packed)
            back = decoder.feed(ids) + decoder.finish()
            new["n_tokens"].append(len(ids))
            new["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
            new["decoded_sha256"].append(hashlib.sha256(back.encode()).hexdigest())
            if with_ids:
                lists.append(ids)
        made = {"n_tokens": pa.array(new["n_tokens"], pa.int64())} | {k: pa.array(v, pa.string()) for k, v in list(new.items())[1:]}
        if with_ids:
            made["ids"] = pa.array(lists, pa.list_(pa.int32()))
        yield replace_columns(batch, names, **made)


def encode_documents(docs: DataFrame, path: str, pattern: str = BYTE_LEVEL, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``docs`` with ids (array<int>, unless ``with_ids`` is false), n_tokens, ids_sha256 and
    decoded_sha256, the digest of the bytes that the streaming decoder gives back."""
    ship(docs.sparkSession)
    added = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] + [("ids", T.ArrayType(T.IntegerType()))] * with_ids
    schema = with_fields(docs.schema, *added)
    names = schema.names
    return docs.mapInArrow(lambda it: _round_trip(it, text_col, path, pattern, names, with_ids), schema)


def _texts(batches: Iterator[pa.RecordBatch], ids: str, path: str, pattern: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    _, decoder = coder(path, pattern)
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(ids))
        out = [decoder.feed(x.as_py() or ()) + decoder.finish() for x in column]
        yield replace_columns(batch, names, decoded=pa.array(out, pa.string()))


def decode_documents(docs: DataFrame, path: str, pattern: str = BYTE_LEVEL, ids_col: str = "ids") -> DataFrame:
    """``docs`` with decoded, the text of ``ids_col``; null ids give empty text."""
    ship(docs.sparkSession)
    schema = with_fields(docs.schema, ("decoded", T.StringType()))
    names = schema.names
    return docs.mapInArrow(lambda it: _texts(it, ids_col, path, pattern, names), schema)
