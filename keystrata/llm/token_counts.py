"""Token counts with a whole-token shortcut.

Once for each vocabulary, on the driver, it is proved which of its strings encode alone: the split pattern leaves
the string in one piece and the merges bring it back to one token. Pieces of a text that are among
them count one without any merging; only the rest is merged. Counts of pieces met before are kept
(``MAX_PIECES``). Added special tokens are found in the text first and count one each, as the
library does by default.

Defined results: null text counts as empty (no tokens); long texts are counted whole; repeated rows each get
their result; an empty table stays empty; other columns pass through; columns of the names added here are
replaced."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._spark import replace_columns, ship, with_fields
from .byte_bpe import BYTE_LEVEL, MAX_PIECES, PIECE_CHARS, merge, splitter


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that print keep their
    code point, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter(dict):
    """Tokens of a text; as a dictionary, the counts of the pieces proved or met so far."""

    def __init__(self, path: str, proved: frozenset[str] | None = None):
        """``proved``: vocabulary strings that encode alone as one token, if they are known already."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        special = [x["content"] for x in spec.get("added_tokens", [])]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = splitter(BYTE_LEVEL)
        self.proved = frozenset(self._alone(model["vocab"], raw, special)) if proved is None else proved
        self.update(dict.fromkeys(self.proved, 1))
        self.room = len(self) + MAX_PIECES

    def _alone(self, vocabulary: Iterable[str], raw: Callable[[str], bytes], special: list[str]) -> Iterator[str]:
        for s in vocabulary:
            if s in special:
                continue
            try:
                piece = raw(s).decode()
            except UnicodeDecodeError:
                continue  # no text has it as a piece
            if self.split(piece) == [piece] and len(self._merged(piece.encode())) == 1:
                yield piece

    def _merged(self, data: bytes) -> list[bytes]:
        return merge([data[i : i + 1] for i in range(len(data))], lambda a, b: self.rank.get((a, b)), lambda a, b: a + b)

    def __missing__(self, piece: str) -> int:
        n = len(self._merged(piece.encode()))
        if len(self) < self.room and len(piece) <= PIECE_CHARS:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.split(text)))
        return len(self.special.findall(text)) + sum(sum(map(self.__getitem__, self.split(part))) for part in self.special.split(text))


_counters: dict[str, Counter] = {}


def counter(path: str, proved: frozenset[str] | None = None) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path, proved)
    return _counters[path]


def _counts(batches: Iterator[pa.RecordBatch], text: str, path: str, proved, limit: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    c = counter(path, proved.value)
    for batch in batches:
        n_bytes, n_tokens = [], []
        for x in batch.column(batch.schema.get_field_index(text)):
            s = x.as_py() or ""
            n_bytes.append(len(s) if s.isascii() else len(s.encode()))
            n_tokens.append(c.count(s))
        yield replace_columns(batch, names, n_bytes=pa.array(n_bytes, pa.int64()), n_tokens=pa.array(n_tokens, pa.int64()), over_limit=pa.array([n > limit for n in n_tokens], pa.bool_()))


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (more than ``limit`` tokens)."""
    ship(docs.sparkSession)
    schema = with_fields(docs.schema, ("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()))
    names = schema.names
    proved = docs.sparkSession.sparkContext.broadcast(counter(path).proved)  # once, here; a vocabulary's strings at most
    return docs.mapInArrow(lambda it: _counts(it, text_col, path, proved, limit, names), schema)
