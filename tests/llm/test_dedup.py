"""Substring, line and near-duplicate removal against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from keystrata.llm import _text as text
from keystrata.llm import line_dedup, minhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# substring dedup


def brute_substrings(rows, n):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - n + 1):
            if d is not None:
                g = tuple(w[i : i + n])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i : i + n])] < d:
                gone.update(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def corpus(seed, docs, n):
    """Texts with shared passages of about n words, copies, near copies and repeats inside one text."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "ß x"]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [fresh(n + k) for k in (-1, 0, 1, 7, 3 * n)]
    rows = []
    for d in range(docs):
        w = fresh(rng.randint(0, 3 * n))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randint(0, len(w))
            w[at:at] = p
        if rows and rng.random() < 0.2:
            w = words(rng.choice(rows)[1])
        rows.append((d, "".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("group", [4096, 12, 2])
@pytest.mark.parametrize("n", [50, 9])
def test_substrings(frame, n, group):
    rows = [*corpus(n, 120, n), (500, None), (501, ""), (502, "one"), (None, " ".join(f"w{i}" for i in range(60)))]
    got = substring_dedup.dedup_substrings(frame(rows, extra=True), n, keep_text=False, group=group).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_substrings(rows, n)


def test_substrings_hot_copies_and_equal_ids(frame):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(60)] + [(100 + i, " ".join([*base[:90], f"x{i}", *base[91:]])) for i in range(60)] + [(7, " ".join(base[10:120])), (7, " ".join(base)), (5, " ".join(base))]
    for group in (4096, 1):
        got = substring_dedup.dedup_substrings(frame(rows), 50, group=group).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_substrings(rows, 50)
        for r in got:
            assert sha(" ".join(words(r.text))) == r.kept_sha256


def test_substrings_of_near_copies_are_split_once(frame, monkeypatch):
    """Suffixes below a large minimizer meet their prefixes' sizes about once each, not at every length."""
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    rows = [(i, " ".join(f"x{i}" if j == (i * 37) % 200 else x for j, x in enumerate(base))) for i in range(100)]
    made, real = {"all": 0, "counted": 0}, substring_dedup.checkpoint

    def spy(df):
        out = real(df)
        if "keys" in out.columns:
            made["counted" if "m" in out.columns else "all"] += out.count()
        return out

    monkeypatch.setattr(substring_dedup, "checkpoint", spy)
    got = substring_dedup.dedup_substrings(frame(rows), 50, group=16).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == brute_substrings(rows, 50)
    assert 0 < made["counted"] <= 1.2 * made["all"]


def test_substrings_keep_white_space_and_long_texts(frame):
    long = " ".join(f"v{i}" for i in range(120_000))
    rows = [(1, long), (2, "a\n\nb  " + long + "\n c"), (3, "x  y\n")]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(frame(rows), 50).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 120_000 and got[2].text == "a\n\nb  c" and got[3].text == "x  y\n"
    assert substring_dedup.dedup_substrings(frame([]), 50).count() == 0


def test_suffix_tree():
    """Deep nodes and maximal repeats against brute force."""
    rng = random.Random(3)
    for trial in range(60):
        strings = [[rng.randint(0, 1 + trial % 3) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 5))]
        symbols, lengths = np.array([x for t in strings for x in t], np.uint64), np.array([len(t) for t in strings])
        owner = np.repeat(np.arange(len(strings)), lengths)
        ends = np.cumsum(lengths)[owner]
        for depth in (1, 2, 3):
            tree = substring_dedup.SuffixTree(symbols, lengths, depth)
            at = [i for i in range(len(symbols)) if ends[i] - i >= depth]
            assert sorted(tree.leaves.tolist()) == at and tree.string.tolist() == owner[tree.leaves].tolist()
            by_prefix = defaultdict(set)
            for i in at:
                by_prefix[tuple(symbols[i : i + depth].tolist())].add(i)
            by_node = defaultdict(set)
            for i, node in zip(tree.leaves.tolist(), tree.deep(depth).tolist()):
                by_node[node].add(i)
            assert sorted(map(sorted, by_node.values())) == sorted(map(sorted, by_prefix.values()))
            want = set()
            for n in range(depth, 15):
                groups = defaultdict(list)
                for i in range(len(symbols)):
                    if ends[i] - i >= n:
                        groups[tuple(symbols[i : i + n].tolist())].append(i)
                for starts in groups.values():
                    left = {None if i == 0 or owner[i - 1] != owner[i] else int(symbols[i - 1]) for i in starts}
                    right = {None if i + n == ends[i] else int(symbols[i + n]) for i in starts}
                    if len(starts) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                        want.add((n, tuple(starts)))
            assert {(n, tuple(s.tolist())) for n, s in tree.maximal_repeats(symbols, lengths, depth)} == want


# hashes


def thue_morse(n, a, b):
    """A sequence and its complement, on which polynomial hashes modulo powers of two agree."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [b if x else a for x in bits], [a if x else b for x in bits]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_and_lines_that_polynomials_confuse(frame, n):
    x, y = ("".join(t) for t in thue_morse(n, "a", "b"))
    rest = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join([*rest[:25], x, *rest[25:]])), (2, " ".join([*rest[:25], y, *rest[25:]])), (3, x), (4, y), (5, f"{x} own words of five"), (6, f"{y} own words of five")]
    got = substring_dedup.dedup_substrings(frame(rows[:2]), 50).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}
    want = brute_components(rows)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(rows)).collect()} == {d: root for d, (_, root) in want.items()}
    got = line_dedup.dedup_lines(frame([(1, x), (2, y), (3, f"own\n{y}")])).collect()
    assert {r.doc_id: r.n_lines_removed for r in got} == {1: 0, 2: 0, 3: 1}
    p, q = thue_morse(n, "one", "two")
    got = substring_dedup.dedup_substrings(frame([(1, " ".join(p)), (2, " ".join(q))]), n).collect()
    assert {r.doc_id: r.n_removed for r in got} == {1: 0, 2: 0}
    data = np.frombuffer(f"{x} {y}".encode(), np.uint8)
    assert len(set(text.words(data, np.array([0, len(data)])).hashes().tolist())) == 2


# line dedup


def brute_lines(rows, least):
    """What goes, written from the definition: (n_lines, n_removed, digest), and the places by document."""
    can = lambda x: len(x.encode()) >= least and bool(words(x))
    by_id = {d: (t or "").split("\n") if t else [] for d, t in rows}
    named = {d: [(x, ls[:i].count(x)) for i, x in enumerate(ls)] for d, ls in by_id.items()}
    holders = defaultdict(list)
    for d in sorted(by_id):
        for x in named[d]:
            if can(x[0]):
                holders[x].append(d)
    out, places = {}, {}
    for d, ls in by_id.items():
        rare = {}
        for x in named[d]:
            if can(x[0]) and holders[x][0] < d:
                e = holders[x][0]
                rare[e] = min(rare.get(e, 1 << 60), len(holders[x]))
        gone = set()
        for _, e in sorted((n, e) for e, n in rare.items()):
            other = by_id[e]
            while left := [i for i, x in enumerate(named[d]) if can(x[0]) and i not in gone and x in named[e]]:
                at = [named[e].index(named[d][i]) for i in left]
                size = []
                for k, y in enumerate(at):
                    size.append(1 + max((size[m] for m in range(k) if at[m] < y), default=0))
                run = [max(k for k in range(len(at)) if size[k] == max(size))]
                while size[run[0]] > 1:  # of equal runs, the one whose places come last in the document
                    run.insert(0, max(m for m in range(run[0]) if size[m] == size[run[0]] - 1 and at[m] < at[run[0]]))
                links = [(left[k], at[k]) for k in run]
                for n, (i, j) in enumerate(links):
                    before, after = (links[n - 1] if n else (-1, -1)), (links[n + 1] if n + 1 < len(links) else (len(ls), len(other)))
                    gone.add(i)
                    step = 1
                    while i - step > before[0] and j - step > before[1] and ls[i - step] == other[j - step]:
                        gone.add(i - step)
                        step += 1
                    step = 1
                    while i + step < after[0] and j + step < after[1] and ls[i + step] == other[j + step]:
                        gone.add(i + step)
                        step += 1
        places[d] = gone
        out[d] = (len(ls), len(gone), sha("\n".join(x for i, x in enumerate(ls) if i not in gone)))
    # whoever the partners were: an anchor goes exactly if any earlier document has it as often, and nothing goes alone
    for d, ls in by_id.items():
        for i, x in enumerate(named[d]):
            if can(x[0]):
                assert (i in places[d]) == any(e < d and x in named[e] for e in by_id)
        for i in places[d]:
            lo = hi = i
            while lo - 1 in places[d]:
                lo -= 1
            while hi + 1 in places[d]:
                hi += 1
            assert any(can(ls[j]) for j in range(lo, hi + 1))
    return out


def test_lines(frame):
    rng = random.Random(4)
    pool = [f"line number {i} of the shared pool" for i in range(40)] + ["", "short", "  ", "é" * 12]
    rows = []
    for d in range(150):
        ls = [rng.choice(pool) if rng.random() < 0.5 else f"own line {d} {rng.random()}" for _ in range(rng.randint(0, 14))]
        if rows and rng.random() < 0.3:
            ls = rng.choice(rows)[1].split("\n")
            ls.insert(rng.randint(0, len(ls)), f"new {d} line of its own")
        rows.append((d, "\n".join(ls)))
    rng.shuffle(rows)
    rows += [(300, None), (301, "\n\n"), (302, pool[0])]
    got = line_dedup.dedup_lines(frame(rows, extra=True)).collect()
    want = brute_lines(rows, line_dedup.MIN_BYTES)
    assert {r.doc_id: (r.n_lines, r.n_lines_removed, r.lines_sha256) for r in got} == want
    assert sum(w[1] for w in want.values()) > 100
    for r in got:
        assert sha(r.text or "") == r.lines_sha256
    assert {r.doc_id for r in got if r.text is None} == {300}


def test_lines_edges(frame):
    line = "a line that is long enough"
    rows = [(None, line), (1, line), (1, line + "\nmore of the same document"), (2, line), (3, f"{line}\n{line}\nx"), (4, "x" * 200_000)]
    got = sorted([(r.doc_id, r.n_lines_removed) for r in line_dedup.dedup_lines(frame(rows)).collect()], key=str)
    assert got == sorted([(None, 0), (1, 0), (1, 0), (2, 1), (3, 1), (4, 0)], key=str)
    assert line_dedup.dedup_lines(frame([])).count() == 0


def test_lines_that_cross_and_repeat(frame):
    """No link is lost: lines in another order, lines that a document has more often, and holders that aren't the first."""
    a, b, c = (f"a line of boilerplate that is {x}" for x in ("first", "second", "third"))
    rows = [(1, f"{b}\n{a}"), (2, f"{a}\n{b}"), (3, f"{a}\n{b}"), (4, f"own\n{c}\nx"), (5, f"{c}\nown of five\n{c}"), (6, f"{c}\nx\n{c}\nx\n{c}")]
    got = {r.doc_id: (r.n_lines_removed, r.text) for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (2, ""), 3: (2, ""), 4: (0, rows[3][1]), 5: (1, f"own of five\n{c}"), 6: (2, f"x\nx\n{c}")}


def test_lines_of_repeated_rows_and_texts_of_one_id(frame):
    a, b = "a line that is long enough", "another line that is long enough"
    rows = [(1, a), (1, b), (1, b), (2, f"{a}\n{b}"), (2, f"{a}\n{b}"), (None, a)]
    got = sorted([(r.doc_id, r.n_lines_removed) for r in line_dedup.dedup_lines(frame(rows, extra=True)).collect()], key=str)
    assert got == sorted([(1, 0), (1, 0), (1, 0), (2, 2), (2, 2), (None, 0)], key=str)


def test_numbered_lines_and_chains():
    rng = random.Random(6)
    for _ in range(100):
        own = np.array([rng.randint(1, 4) for _ in range(rng.randint(0, 9))], np.uint64)
        names = line_dedup.numbered(own).tolist()
        assert len(set(names)) == len(names) and all(names[i] == own[i] for i in range(len(own)) if own[i] not in own[:i])
        ys = rng.sample(range(20), rng.randint(0, 9))
        run = line_dedup.chain(list(enumerate(ys)))
        best = max((bin(m).count("1") for m in range(1 << len(ys)) if (s := [y for i, y in enumerate(ys) if m >> i & 1]) == sorted(s)), default=0)
        assert len(run) == best and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(run, run[1:]))


# near duplicates


def shingles(t):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = defaultdict(list)
    for d, t in rows:
        if d is not None:
            sets[d].append(shingles(t))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, u in enumerate(ids):
        for v in ids[:i]:
            if any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[u] for b in sets[v]):
                x, y = sorted((find(u), find(v)))
                root[y] = x
    return {d: (max(map(len, sets[d])), find(d)) for d in ids}


def near_rows(seed):
    rng = random.Random(seed)
    rows, bases = [], [[f"b{i}w{rng.randint(0, 400)}" for _ in range(rng.randint(30, 150))] for i in range(8)]
    for d in range(160):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            if w:
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
        if rng.random() < 0.2:
            w = w + [f"t{rng.randint(0, 9999)}" for _ in range(rng.randint(1, 25))]
        t = " ".join(w)
        rows.append((d, t.upper() if rng.random() < 0.1 else t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(frame, seed):
    rows = [*near_rows(seed), (900, None), (901, ""), (902, "Two words"), (903, "two WORDS"), (904, "two")]
    want = brute_components(rows)
    got = minhash.near_duplicates(frame(rows, extra=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.drop_near_duplicates(frame(rows, extra=True))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c) and kept.columns == frame(rows, extra=True).columns


def test_near_duplicates_edges(frame):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (3, t), (3, "entirely other words that stand here"), (8, "entirely other words that stand here"), (None, t), (None, None)]
    got = sorted([(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows)).collect()], key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (8, 3, False), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(frame([])).count() == 0


def test_drop_near_duplicates_of_one_id(frame, spark):
    """Repeated rows and two texts of one id: one row stays, in the operator and in the pipeline's stage."""
    t, u = " ".join(f"w{i}" for i in range(40)), "entirely other words that stand here"
    rows = [(5, t), (3, t), (3, t), (3, u), (8, u), (9, "alone one two"), (9, "alone one two"), (10, None), (10, None), (11, "b"), (None, t), (None, t)]
    want = sorted([(3, u), (9, "alone one two"), (10, None), (11, "b"), (None, t), (None, t)], key=str)
    for out in (minhash.drop_near_duplicates(frame(rows, extra=True)), corpus_pipeline.near_dedup(spark, frame(rows, extra=True), "")):
        assert out.columns == frame(rows, extra=True).columns
        assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == want


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(60)] + [(200, 200)]
    root = {}
    for u, v in edges:
        for x in (u, v):
            root.setdefault(x, x)
    for _ in range(200):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k != 200}
