"""The pipeline's stages against plain versions of their decisions, and its queries against their SQL."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((docs.columns, {r["doc_id"]: r for r in docs.collect()}))
    return spark.read.parquet(f"{SF}/documents.parquet").columns, {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}, out


def test_stages(kept):
    columns, docs, stages = kept
    assert all(c == columns for c, _ in stages[:-1]) and columns == stages[-1][0][: len(columns)]
    ids = [set(docs), *(set(rows) for _, rows in stages)]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert ids[1] == {d for d, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    assert ids[2] == ids[1]
    # Near copies: what went has a near copy of a smaller id, and none of five-word similarity stay.
    texts = {d: stages[1][1][d]["text"].encode().lower().split() for d in ids[2]}
    sets = {d: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for d in ids[2] - ids[3]:
        assert any(alike(d, x) for x in ids[2] if x != d)
    left = sorted(ids[3])
    missed = [(a, b) for i, a in enumerate(left) for b in left[:i] if alike(a, b)]
    assert not missed
    # Decontamination: exactly the documents with a window of an item.
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    grams = {tuple(w[i : i + 10]) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall() for w in [split(t)] for i in range(max(1, len(w) - 9))}
    assert all(len(g) == 10 for g in grams)
    hit = {d for d in ids[3] for w in [split(stages[2][1][d]["text"])] if any(tuple(w[i : i + 10]) in grams for i in range(len(w) - 9))}
    assert ids[3] - ids[4] == hit
    assert all(r["copies"] >= 1 for r in stages[-1][1].values())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_sql(spark, name):
    from tests.support import compare

    compare(spark, SF, name)
