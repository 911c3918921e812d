"""Encoding, decoding, counting and packing against the public libraries and brute force."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keystrata.llm import byte_bpe, packing, token_counts

TIK, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(TIK), special_tokens={})
TOKENIZER = Tokenizer.from_file(JSON)
TEXTS = [
    "", " ", "\n\n  \n", "Hello  world's end\t\tof\r\nline", "<|endoftext|>a<|endoftext|>", "Été à l'île; übergrößenträger ñandú", "日本語の文章 한국어 🙂🙂👩‍👩‍👧", "½ ² ⅷ ٣٤ x_y __ \x1c\x1d \x85 \xa0 a b",
    "a" * 3000, "ab" * 2000 + " " * 500 + "z", "don't we'll 'tis I'VE 'S", "﻿​­", "1234567890" * 30, "thththerer ononing " * 50,
]


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.coder(TIK, P.PATTERN)


def same(coder, text):
    encoder, decoder = coder
    ids = LIBRARY.encode_ordinary(text)
    assert array("I", encoder.encode(text)).tolist() == ids
    assert decoder.feed(ids) + decoder.finish() == text


@pytest.mark.parametrize("text", TEXTS)
def test_encode_decode(coder, text):
    same(coder, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_encode_decode_random(coder, text):
    same(coder, text)


def test_transducer_alone(coder):
    rng = random.Random(3)
    machine, alphabet = coder[0].machine, "etaonrish THE.,éß"
    for _ in range(300):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))).encode()
        want = LIBRARY._encode_single_piece(s)
        assert machine.encode(s) == list(want)


def test_states_begin_anew(coder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 50)
    machine = byte_bpe.Transducer(coder[0].machine.ranks)
    for w in ("internationalisation", "counterrevolutionary", "antidisestablishment"):
        assert machine.encode(w.encode()) == list(LIBRARY._encode_single_piece(w.encode()))


def test_states_are_bounded_inside_a_piece(coder, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 300)
    machine, rng = byte_bpe.Transducer(coder[0].machine.ranks), random.Random(8)
    s = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)).encode()
    assert machine.encode(s) == list(LIBRARY._encode_single_piece(s)) and len(machine.states) <= 301


def test_broken_utf8_decodes_to_replacements(coder):
    ranks, decoder = coder[0].machine.ranks, coder[1]
    ids = [ranks[b"\xc3"], ranks[b"a"], ranks[b"\xe2"], ranks[b"\x82"], ranks[b"\xac"], ranks[b"\xff"]]
    assert decoder.feed(ids) + decoder.finish() == b"\xc3a\xe2\x82\xac\xff".decode("utf-8", "replace")


@pytest.mark.parametrize("text", TEXTS)
def test_counts(text):
    assert token_counts.counter(JSON).count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_counts_random(text):
    assert token_counts.counter(JSON).count(text) == len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def test_count_query(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None), (None, "a b"), (0, "")]
    got = token_counts.count_tokens(frame(rows, extra=True), JSON, 5).collect()
    want = [(d, len((t or "").encode()), n := len(TOKENIZER.encode(t or "", add_special_tokens=False).ids), n > 5) for d, t in rows]
    assert sorted([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], key=str) == sorted(want, key=str)
    assert token_counts.count_tokens(frame([]), JSON).count() == 0


def test_encode_query(frame):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(99, None)]
    got = byte_bpe.encode_documents(frame(rows, extra=True), TIK, P.PATTERN)
    for r in byte_bpe.decode_documents(got, TIK, P.PATTERN).collect():
        t = dict(rows)[r.doc_id] or ""
        ids = LIBRARY.encode_ordinary(t)
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, t)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_encode_repeated_rows_and_empty(frame):
    got = byte_bpe.encode_documents(frame([(1, "a b"), (1, "a b"), (None, "a b")], extra=True), TIK, P.PATTERN, with_ids=False).collect()
    assert len(got) == 3 and len({(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got}) == 1
    assert byte_bpe.encode_documents(frame([], extra=True), TIK, P.PATTERN).count() == 0


def check_packing(rows, got, capacity):
    """Pieces are the documents', and sequences are gapless and not too long."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for doc, text in rows:
        ids = array("I", [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2])
        at = 0
        for n, r in enumerate(sorted(by_doc.pop(doc), key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and (n == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(frame):
    rng = random.Random(5)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["the", "ondthing", "x"]) for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(99, None)]
    got = packing.pack_documents(frame(rows, extra=True), JSON, 2, 64).collect()
    used = check_packing(rows, got, 64)
    assert used <= 1.03 * -(-sum(r.length for r in got) // 64) + 2
    assert packing.pack_documents(frame([]), JSON, 2, 64).count() == 0


def test_packing_repeated_rows(frame):
    got = packing.pack_documents(frame([(1, "same text")] * 50 + [(None, "a")]), JSON, 2, 16).collect()
    assert len(got) == 51 and len({(r.sequence_id, r.offset) for r in got}) == 51


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 128), st.integers(1, 40), max_size=60), st.integers(1, 20))
def test_plan_places_every_piece(histogram, groups):
    kinds = packing.plan(histogram, 128, groups)
    seen = defaultdict(int)
    for times, lengths in kinds:
        assert times > 0 and sum(lengths) <= 128
        for s in lengths:
            seen[s] += times
    assert dict(seen) == histogram
    table = packing.places(kinds)
    assert len({(s, r) for s, r, _, _ in table.tolist()}) == len(table)


@pytest.mark.parametrize("seed", [1, 2])
def test_few_groups_suffice(seed):
    """With 32 groups, rounded up, the plan is as dense as lengths allow that pair badly; sizes are few."""
    rng = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(5000):
        histogram[rng.randint(150, 800)] += 1
    used = sum(t for t, _ in packing.plan(dict(histogram), 1024))
    assert packing.GROUPS == 32 and used <= 1.02 * sum(s * n for s, n in histogram.items()) / 1024 + 1
    sizes, counts = [900, 600, 400, 300, 150], [3, 50, 40, 70, 90]
    solved = packing.configurations(sizes, counts, 1024)
    spent = [0] * 5
    for times, config in solved:
        assert sum(sizes[j] * k for j, k in config) <= 1024
        for j, k in config:
            spent[j] += times * k
    assert spent == counts


def test_plan_is_near_the_bound():
    rng = random.Random(1)
    histogram = defaultdict(int)
    for _ in range(20000):
        histogram[min(1024, int(rng.lognormvariate(5.8, 0.8)) + 1)] += 1
    used = sum(t for t, _ in packing.plan(dict(histogram), 1024))
    assert used <= 1.002 * sum(s * n for s, n in histogram.items()) / 1024 + 1
