"""The registered queries: on empty tables, and against brute force or SQL on the smallest one."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from sensortwin.llm import queries
from sensortwin.session import scratch_path

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "pages", "benchmark", "embeddings")


def test_every_query_takes_empty_tables(spark):
    import corpus_pipeline

    empty = scratch_path(spark, "empty-llm")
    for name in TABLES:
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    for name, fn in {**queries.queries(), "pipeline": corpus_pipeline.run}.items():
        assert fn(spark, empty).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted(tuple(r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want


def test_fingerprint_likeness_of_the_query_is_near_exact_jaccard(spark):
    """op5: edited texts by plain slicing, near_edited and near_next against exact 5-word Jaccard."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))

    def shingles(t):
        w = t.lower().split()
        return set(zip(*[w[k:] for k in range(5)])) or ({tuple(w)} if w else set())

    def jaccard(a, b):
        a, b = shingles(a), shingles(b)
        return 1.0 if a == b else len(a & b) / len(a | b)

    errors = []
    for r in queries.queries()["op5_fingerprints"](spark, SF).collect():
        t, after = texts[r.doc_id], texts[following[r.doc_id]]
        half = len(t) // 2
        head = after[:half]
        edited = t[: len(t) - half] + head
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        errors += [abs(r.near_edited - jaccard(t, edited)), abs(r.near_next - jaccard(t, after))]
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.2
