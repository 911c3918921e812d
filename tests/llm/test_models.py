"""Language-model scoring, language id, quality rules and top-k search."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import _text as text_kernels
from keystrata.llm import exact_topk, language_id, lm_scoring, quality, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def held_out(d, n):
    return d is not None and zlib.crc32(str(d).encode()) % n == 2


@pytest.mark.parametrize("head", [1 << 20, 64])
def test_scores(frame, monkeypatch, head):
    """Base scores against brute force, with all words in the broadcast head and with nearly none."""
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    con = duckdb.connect()
    rows = con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall() + [(5001, None), (5002, ""), (5003, "Zzyx qqq Zzyx the")]
    train = [x for d, t in rows if not held_out(d, 7) for x in [*WORD.findall(lower(t)), None]]
    c, n = Counter(train), len(train)
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(rows, extra=True), "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").collect()}
    assert len(got) == len(rows)
    gain = 0
    for d, t in rows:
        tokens = [*WORD.findall(lower(t)), None]
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(c[x] > 0 for x in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + len(c) + 1)) for x in tokens), rel=1e-9)
        gain += (r.score - r.base_score) if held_out(d, 7) else 0
    assert gain > 0


def test_scores_against_the_models_tables(frame):
    """Each score again, token by token in plain loops; over the whole vocabulary, the shared tokens' words and the
    unknown one included, probabilities add up to one."""
    rng = random.Random(2)
    names = [f"{chr(97 + i % 26)}{i}" for i in range(400)]
    text = lambda n: " ".join(names[min(int(rng.expovariate(0.02)), 399)] for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(120)] + [(500, "never seen A1 Zz9 zz9"), (501, None), (7, "b1 b1")]
    docs = frame(rows)
    counts, vocabulary, model, shares, (tokens, types, ends) = lm_scoring.fit(docs, "doc_id < 100")
    v, m = vocabulary.value, model.value
    of_word = {}
    for i, t in rows:
        if t and i < 100:
            for x in WORD.findall(lower(t)):
                of_word[x] = of_word.get(x, 0) + 1

    def token(x):
        data = np.frombuffer(x.encode(), np.uint8)
        w = text_kernels.words(data, np.array([0, len(data)]))
        at = np.flatnonzero(v.own == w.hashes(lower=True).view(np.int64)[0])
        return 1 + lm_scoring.SHARED + int(at[0]) if len(at) else 1 + int(lm_scoring.suffix_bucket(w)[0])

    def softmax(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    def chances(before):
        c = sum(m.R[t].astype(float) * m.far[j] for j, t in enumerate(before[::-1]))
        kinds = softmax(m.A @ c + m.a)
        inner = [softmax(m.Q[k * m.width : (k + 1) * m.width] @ c + m.b[k * m.width : (k + 1) * m.width]) for k in range(len(kinds))]
        return np.array([kinds[s // m.width] * inner[s // m.width][s % m.width] for s in m.slot.tolist()])

    sizes = {}
    for x, n in of_word.items():
        if token(x) <= lm_scoring.SHARED:
            sizes[token(x)] = sizes.get(token(x), 0) + n + 1
    got = {(r.doc_id, r.n_tokens): r for r in lm_scoring.score_documents(docs, "doc_id < 100").collect()}
    for i, t in rows[95:]:
        seq, total = [v.tokens] * lm_scoring.CONTEXT, 0.0
        for x in [*WORD.findall(lower(t)), None]:
            here = 0 if x is None else token(x)
            p = chances(seq[-lm_scoring.CONTEXT :])
            assert p.sum() == pytest.approx(1, abs=1e-5)
            share = 1.0 if not 0 < here <= lm_scoring.SHARED else (of_word.get(x, 0) + 1) / (sizes.get(here, 0) + 1)
            total += math.log10(p[here] * share)
            seq.append(here)
        assert got[i, len(seq) - lm_scoring.CONTEXT].score == pytest.approx(total, rel=1e-4, abs=1e-3)
    # inside a shared token: the words' shares and the unknown one's
    for k, n in sizes.items():
        assert sum((c + 1) / (n + 1) for x, c in of_word.items() if token(x) == k) + 1 / (n + 1) == pytest.approx(1)
        assert shares[k - 1] == pytest.approx(math.log10(n + 1))


def test_vocabulary_grows_with_the_corpus():
    assert [int(lm_scoring.GROWTH * math.sqrt(n)) for n in (10**4, 10**6, 10**8)] == [800, 8000, 80000]


def test_training_learns_what_follows_what():
    """On a cycle of words the model is sure of the next; classes are of equal size."""
    rng = np.random.default_rng(0)
    tokens = 64
    seq = np.concatenate([np.full(lm_scoring.CONTEXT, tokens), np.tile([5, 9, 33, 7], 4000)])
    at = np.arange(lm_scoring.CONTEXT, len(seq))
    n = np.bincount(seq[at], minlength=tokens).astype(float)
    near = np.zeros((tokens, lm_scoring.NEAR + 1))
    for a, b in zip(seq[at - 1][1:].tolist(), seq[at][1:].tolist()):
        near[b, a % lm_scoring.NEAR] += 1
    model = lm_scoring.initial(n, near)
    assert sorted(set(model.slot.tolist())) == sorted(model.slot.tolist()) and len(model.a) == 8 and model.width == 8
    before = model.log_probabilities(seq, at).mean()
    mass = np.zeros(len(model.b))
    mass[model.slot] = (n + 0.5) / (n + 0.5).sum()
    trainer = lm_scoring.Trainer(model.with_flat(model.flat()), mass.reshape(-1, model.width).sum(axis=1), mass, 1)
    for _ in range(4):
        trainer.run(seq, rng.permutation(at), 0.3)
    assert before == pytest.approx(math.log(1 / 4), abs=0.1) and trainer.m.log_probabilities(seq, at).mean() > -0.15


@pytest.mark.parametrize("scale", [1, 300])
def test_scoring_in_small_blocks(monkeypatch, scale):
    """Scores are normalised a few rows at a time, and right where exponentials leave the range of a float."""
    rng = np.random.default_rng(3)
    tokens = 100
    model = lm_scoring.initial(rng.integers(1, 500, tokens).astype(float), rng.integers(0, 9, (tokens, lm_scoring.NEAR + 1)).astype(float))
    model = model.with_flat(np.where(np.isfinite(x := model.flat()), x + rng.standard_normal(len(x)) * np.sqrt(scale), x))
    seq = np.concatenate([np.full(lm_scoring.CONTEXT, tokens), rng.integers(0, tokens, 5000)])
    at = rng.permutation(np.arange(lm_scoring.CONTEXT, len(seq)))
    sizes, real = [], lm_scoring._log_softmax
    monkeypatch.setattr(lm_scoring, "_log_softmax", lambda *a: sizes.append(len(a[0])) or real(*a))
    got = model.log_probabilities(seq, at)
    log_sum = lambda x: x.max(axis=-1) + np.log(np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1))
    c = model.prediction(seq, at).astype(float)
    kinds, inner = c @ model.A.T.astype(float) + model.a, (c @ model.Q.T.astype(float) + model.b).reshape(len(at), -1, model.width)
    slot, row = model.slot[seq[at]], np.arange(len(at))
    kind, place = slot // model.width, slot % model.width
    want = kinds[row, kind] - log_sum(kinds) + inner[row, kind, place] - log_sum(inner[row, kind])
    assert got == pytest.approx(want, rel=1e-4, abs=1e-3 * scale) and max(sizes) <= 1024


def test_own_words_are_found_without_a_search(monkeypatch):
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(-(2**63), 2**63 - 1, 5000))
    hashes[1] = hashes[0] + (1 << 40)  # two with the same low bits
    counts = rng.integers(1, 99, len(hashes))
    own = np.concatenate([hashes[:2], rng.choice(hashes[2:], 300, replace=False)])
    v = lm_scoring.Vocabulary(rng.permutation(hashes), counts, own)
    of = dict(zip(v.hashes.tolist(), v.counts.tolist()))
    searched, real = [], lm_scoring._find
    monkeypatch.setattr(lm_scoring, "_find", lambda table, h: searched.append(len(h)) or real(table, h))
    asked = np.concatenate([np.repeat(own, 100), rng.integers(-(2**63), 2**63 - 1, 50), hashes[-50:]])
    assert v.count(asked).tolist() == [of.get(x, -1) for x in asked.tolist()]
    assert sum(searched) < 1000


def test_tasks_that_are_rerun_change_nothing(frame):
    """Equal rows and rows of one id have results of their own, keyed by what they hold."""
    rows = [(1, "a b c"), (1, "a b c"), (1, "a b"), (None, "a b c"), (2, "")]
    got = sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 9)) for r in lm_scoring.score_documents(frame(rows, extra=True), "doc_id = 1").collect())
    again = sorted((str(r.doc_id), r.n_tokens, round(r.base_score, 9)) for r in lm_scoring.score_documents(frame(rows[::-1], extra=True).repartition(3), "doc_id = 1").collect())
    assert got == again and [x[:2] for x in got] == [("1", 3), ("1", 4), ("1", 4), ("2", 1), ("None", 4)]


def test_scores_without_training(frame):
    got = lm_scoring.score_documents(frame([(1, "a b"), (1, "a b"), (None, None)]), "false").collect()
    assert len(got) == 3 and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert lm_scoring.score_documents(frame([]), "true").count() == 0


# languages


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = language_id.fold("doc_id", 4) == 2
    out = language_id.identify(docs.select("doc_id", "text", "lang"), language_id.learn(docs.where(~fold))).where(fold)
    n, right = out.agg(F.count(F.lit(1)), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 200 and right / n > 0.98


def test_language_edges(frame, spark):
    train = spark.createDataFrame([("the cat and the hat", "en"), ("le chat et la belle", "fr"), (None, "en"), ("mystery", None)], "text string, lang string")
    profiles = language_id.learn(train)
    assert sorted(profiles) == ["en", "fr"]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the the the"), (5, "la belle"), (6, "x"), (7, "the cat " * 30000), (None, "chat")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(frame(rows, extra=True), profiles).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == "en" and got[5][0] == "fr" and got[7][0] == "en" and got[None][0] == "fr" and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.identify(frame([(1, "abc")]), {}).first().lang_pred == "und"
    assert language_id.learn(train.where("false")) == {}
    assert language_id.identify(frame([], extra=True), profiles).count() == 0
    twice = language_id.identify(frame([(1, "the hat"), (1, "the hat"), (1, "le chat")]), profiles).collect()
    assert sorted(r.lang_pred for r in twice) == ["en", "en", "fr"]


def test_out_of_place_distance():
    """The prediction against the definition, gram by gram."""
    rng = random.Random(8)
    texts = {"a": "tha ing ere " * 20 + "xo", "b": "der und ich " * 20 + "ä"}
    profiles = {k: language_id.ranked(*np.unique(language_id.grams(t), return_counts=True), 30).tolist() for k, t in texts.items()}
    model = language_id.Profiles(profiles, 30)
    for _ in range(40):
        t = " ".join("".join(rng.choice("thardeungicx") for _ in range(rng.randint(1, 5))) for _ in range(6))
        own = language_id.ranked(*np.unique(language_id.grams(t), return_counts=True), 30).tolist()
        far = {k: sum(abs(p.index(g) - i) if g in p else 30 for i, g in enumerate(own)) for k, p in profiles.items()}
        assert model.predict(t)[0] == min(far, key=lambda k: (far[k], k))
    assert Counter(language_id.grams("Ab c").tolist())[ord("a") << 21 | ord("b")] == 1 and len(language_id.grams("ab")) == 2 + 3 + 2


# quality


def brute_quality(t):
    w = WORD.findall(t or "")
    n = len(w)
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    g = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    cover = {j for i in range(n - 7) if g[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return n, sum(map(len, w)), sum((t or "").count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(cover), n < 20 or 100 * len(cover) > 30 * n


TEXTS = [
    None, "", " \n\t", "one two three", "a b c d e f g h " * 9, "word " * 8, "x " * 400, "é ß x 日本 " * 12, "# * $ % & | < > " * 5 + "plain words here", "line\nline\n\nline \n  \nline", " lead\x0bing and\x0ctrail\ring ",
    " ".join(f"w{i}" for i in range(100)), " ".join(f"w{i % 50}" for i in range(140)), "\n".join(["the same line of some words"] * 3 + [f"other {i} words" for i in range(30)]), "long" * 30000 + " " + " ".join(f"v{i}" for i in range(20000)), "STOP!! NOW!! " * 15, "this this this this that that that that of of of of in in in in on on on on at at at at by by by by",
]


def test_quality_figures(frame):
    rows = list(enumerate(TEXTS)) + [(None, "a b"), (3, "a b")]
    for r in quality.judge(frame(rows, extra=True)).collect():
        t = "a b" if r.doc_id is None else None
        want = [brute_quality(x) for d, x in rows if d == r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want, (r.doc_id, t)
        assert not (r.base_failed and r.kept)
    assert quality.judge(frame([])).count() == 0


def test_quality_verdict_ignores_the_order(frame):
    rows = list(enumerate(TEXTS))
    names = list(quality.rules())
    verdicts = [sorted((r.doc_id, r.kept) for r in quality.judge(frame(rows), order=o).collect()) for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1] and dict(verdicts[0])[11] and not dict(verdicts[0])[15] and not dict(verdicts[0])[16]
    assert sorted(quality.cascade_order(frame(rows))) == sorted(names)
    df = frame(rows, extra=True)
    kept = quality.keep(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, k in verdicts[0] if k}


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    got = Counter((r.quality, r.kept) for r in quality.judge(docs).select("quality", "kept").collect())
    assert got[1, True] / (got[1, True] + got[1, False]) > 0.95 and got[0, False] / (got[0, False] + got[0, True]) > 0.6


# top-k


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(12)]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(60)]  # ties
    rows += [(2000, None), (2050, [1.0, None] + [0.0] * 10), (2100, [float("nan")] * 12), (2150, [float("inf")] * 12), (2200, [0.0] * 12), (2250, [1.0, 2.0]), (2251, [1.0, 2.0]), (2300, []), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1), "x": F.lit(0)})
    got = [tuple(r) for r in exact_topk.search(df, 5, 50).select("query_id", "rank", "vec_id", "score").collect()]
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q and len(x) == len(y))[:5]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    assert sorted(got) == sorted(want)


def test_pivots_eliminate():
    """On clustered vectors few candidates are scored; the result is that of scoring all."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    x = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.02 * rng.standard_normal((4000, 16)))).astype(np.int64)
    ids = np.arange(4000)
    p = exact_topk.Pivots(ids[:500], x[:500], float((x.astype(float) ** 2).sum(axis=1).max()))
    q = np.arange(0, 4000, 50)
    rows, computed = exact_topk.search_block(ids, x, p.of_vectors(x), ids[q], x[q], p.of_queries(x[q]), p.to_beat(ids[q], x[q], 5), p, 5)
    want = []
    for i in q.tolist():
        s = (x @ x[i]).astype(float)
        s[i] = -np.inf
        want += [(i, int(j), int(s[j])) for j in np.lexsort((ids, -s))[:5]]
    assert sorted(rows) == sorted(want)
    share = computed / len(q) / len(x)
    print("share of candidates scored", share)
    assert share < 0.35


def test_topk_repeated_ids_and_empty(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.25, 0.0])]
    got = sorted(tuple(r) for r in exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 50).collect())
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 1, 128 * 256), (0, 3, 2, 64 * 256)]


def test_topk_large_values_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(exact_topk, "BLOCK", 64)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    rows = [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 6)]) for i in range(500)]
    got = Counter()
    for r in exact_topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 50).collect():
        got[r.query_id] += r.score
    for q, x in rows[::50]:
        best = sorted((sum(int(a) * int(b) * 65536 for a, b in zip(x, y)) for i, y in rows if i != q), reverse=True)[:3]
        assert got[q] == sum(best)
    assert exact_topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_queries_are_named():
    assert [n.split("_")[0] for n in queries.queries()][:10] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
