"""The pipeline's stages against plain versions of them, and one after the other on awkward rows."""

from __future__ import annotations

import re
from fractions import Fraction

import pytest

import corpus_pipeline
from sensortwin.llm import bpe, secrets, toxicity
from sensortwin.session import scratch_path

from .helpers import awkward, documents, prose

SF = "/root/testdata/sf0.001"
PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_toxic_documents_go_and_others_stay(spark, docs):
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {i for i, t in texts(docs).items() if model.score_texts([t])[0][0] < 0.5}
    assert kept.columns == docs.columns and set(texts(kept)) == want


def test_one_of_each_group_of_near_duplicates_stays(spark, docs):
    sets = {}
    for i, t in texts(docs).items():
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(5)])) or (frozenset([tuple(w)]) if w else frozenset())
    name = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and Fraction(both, len(sets[a]) + len(sets[b]) - both) >= Fraction(8, 10) and name[a] != name[b]:
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if x == old else x for i, x in name.items()}
    assert set(texts(corpus_pipeline.drop_near_duplicates(spark, docs, SF))) == {i for i in ids if name[i] == i}


def test_documents_with_a_benchmark_passage_go(spark, docs):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    words = [t.lower().translate(PUNCTUATION).split() for t in items]
    runs = [set(zip(*[w[k:] for k in range(3)])) for w in words]
    kept = set(texts(corpus_pipeline.drop_benchmark(spark, docs, SF)))
    for i, t in texts(docs).items():
        w = t.lower().translate(PUNCTUATION).split()
        line, mine = f" {' '.join(w)} ", set(zip(*[w[k:] for k in range(3)]))
        if any(f" {' '.join(x)} " in line for x in words):
            assert i not in kept
        elif not any(len(mine & r) >= len(r) / 3 for r in runs):  # too few runs for any item within its edits
            assert i in kept


def test_secrets_are_replaced_and_nothing_else(spark, docs):
    before, after = texts(docs), texts(corpus_pipeline.redact_secrets(spark, docs, SF))
    scanner = secrets.Scanner()
    for i, t in before.items():
        covered = [False] * len(t)
        for a, b, _ in scanner.spans(t):
            covered[a:b] = [True] * (b - a)
        parts = re.findall(r"(?:\x00)+|[^\x00]+", "".join("\x00" if c else x for x, c in zip(t, covered)))
        # adjacent spans are marks of their own; the kept text is the same
        assert after[i].replace("[secret]", "") == "".join(p for p in parts if p[0] != "\x00").replace("[secret]", "")
        assert (after[i] != t) == any(covered)


def test_texts_are_encoded_as_the_library_does(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_file(bpe.DEFAULT_TOKENIZER))
    library.no_truncation()
    library.no_padding()
    mine = texts(docs)
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        assert r.ids == library.encode(mine[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_stages_take_awkward_rows_one_after_the_other(spark):
    """Repeated ids and rows, missing ids and texts, very long texts and clashing column names, in either order."""
    _, rows = awkward(spark)
    rows += [(10, prose(333, 40)), (None, prose(6, 80)), (11, "password = 'abcdefgh12345678' " + prose(8, 30)), (11, prose(9, 30))]
    folder = scratch_path(spark, "awkward")
    spark.createDataFrame([(1, 0, 1), (5, None, None), (None, 1, 0), (6, 0, 0), (10, 0, 1), (10, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(777, 20)), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    seen = []
    for order in (rows, rows[::-1]):
        docs = documents(spark, order)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, folder)
            assert got.columns == docs.columns, name
            path = scratch_path(spark, name)
            got.write.parquet(path)
            docs = spark.read.parquet(path)
        seen.append(sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in docs.collect()))
        coded = corpus_pipeline.encode(spark, docs, folder)
        assert coded.count() == docs.count()
    assert seen[0] == seen[1]
    kept = [x for x in seen[0] if not x[0]]
    assert {x[1] for x in kept} >= {1, 3, 4, 5, 6, 7, 9, 10, 11} and 2 not in {x[1] for x in kept}
    assert sum(x[1] == 10 for x in kept) == 2 and sum(x[1] == 11 for x in kept) == 2  # different texts under one id stay
    assert not any("abcdefgh12345678" in x[2] for x in kept)
