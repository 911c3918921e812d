"""Each pipeline stage against brute force on its own input, and the queries against their SQL."""

import duckdb
import pytest
from test_dedup import brute_components, brute_lines, brute_substrings, sha, words
from test_tokens import check_packing

import corpus_pipeline
from keystrata.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_stages(spark, con):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        inputs.append((name, before, docs.collect()))
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in inputs[-1][2])
    (_, all_docs, passed), (_, a, lines), (_, b, near), (_, c, cut), (_, d, packed) = inputs
    assert {r.doc_id for r in passed} == {x[0] for x in con.execute(f"SELECT doc_id FROM ({queries.oracle_sql()['op9_quality_rules']}) WHERE kept").fetchall()} and all(all_docs[r.doc_id] == r.text for r in passed)
    want = brute_lines(list(a.items()), line_dedup.MIN_BYTES)
    assert {r.doc_id: sha(r.text) for r in lines} == {k: v[2] for k, v in want.items()} and any(v[1] for v in want.values())
    roots = brute_components(list(b.items()))
    assert {r.doc_id: r.text for r in near} == {k: t for k, t in b.items() if roots[k][1] == k}
    assert sorted((r.doc_id, sha(" ".join(words(r.text)))) for r in cut) == sorted((x[0], x[3]) for x in brute_substrings(list(c.items()), 50))
    check_packing(list(d.items()), packed, 1024)


def test_stages_of_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table through every stage but the first, which
    would reject most of them, and through all."""
    good = " ".join(f"word{i} of the text" for i in range(40))
    rows = [(1, good), (1, good), (2, good), (3, None), (3, None), (4, ""), (None, good), (None, None), (5, f"{good}\nanother line of the fifth document"), (6, "short")]
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text").cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit("s")})
    docs = docs.withColumns({c: F.lit("x") for c in ("n_words", "kept", "score", "d", "k", "t", "h", "n_lines", "component_id", "n_removed")})
    empty = docs.where("false")
    for table in (docs, empty):
        for skip in (0, 1):
            df = table
            for name, stage in corpus_pipeline.STAGES[skip:]:
                before, df = df, stage(spark, df, SF)
                assert name == "packing" or df.columns == before.columns
            got = df.collect()
            if table is empty:
                assert not got
    ids = [r.doc_id for r in got] if got else []
    assert ids == []
    kept = corpus_pipeline.near_dedup(spark, corpus_pipeline.dedup_lines(spark, docs, SF), SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, i) for i in (1, 2, 3, 4, 5, 6)] + [(True, 0)] * 2
    assert sorted({r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}, key=str) == sorted([1, 2, 5, None], key=str)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100
