"""The registered queries and the pipeline over the smallest tables, against brute force."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import words
from tests.llm.test_duplicates import brute_repeats, brute_simhash, grouped, kept_by_brute_force
from tests.llm.test_rules_and_scores import verdicts
from tests.llm.test_tokens import PATH, check_packing, ids_of
from tidemark.llm import attention, packing, resharding
from tidemark.llm.common import stored
from tidemark.llm.queries import GOOD, ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="tables not present")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()


def rows_of(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, DIR).collect()}


def test_query_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, DIR)
    got = sorted([str(r[n]) for n in sorted(names)] for r in df.collect())
    want = sorted([str(r[names.index(n)]) for n in sorted(names)] for r in cur.fetchall())
    assert got == want


def test_op1_op2_op10(spark, documents):
    counts, coded = rows_of(spark, "op1_token_counts"), rows_of(spark, "op2_bpe_transducer")
    assert len(counts) == len(coded) == len(documents)
    for r in documents:
        ids = ids_of(r["text"])
        raw = np.array(ids, "<u4").tobytes()
        assert tuple(counts[r["doc_id"]])[1:] == (len(r["text"].encode()), len(ids), len(ids) > 512)
        assert tuple(coded[r["doc_id"]])[1:] == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    packed = QUERIES["op10_configuration_packing"](spark, DIR).collect()
    n = check_packing(packed, [(r["doc_id"], r["text"]) for r in documents], packing.CAPACITY)
    assert n <= -(-sum(r["length"] for r in packed) // packing.CAPACITY) + 1


def test_op4(spark, documents):
    rows = QUERIES["op4_flow_resharding"](spark, DIR).collect()
    sizes = np.bincount([r["shard"] for r in rows], minlength=8)
    assert len(rows) == len(documents) and sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    by = {r["doc_id"]: r for r in rows}
    for d in documents:
        raw = d["text"].encode()
        assert (by[d["doc_id"]]["size"], by[d["doc_id"]]["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for k in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sizes[k]))


def test_op4_moves_the_whole_table(spark, documents, monkeypatch):
    """The files of the new shards and those that stay hold every column of the documents."""
    seen, reshard = [], resharding.reshard

    def watched(docs, *args):
        seen.append(reshard(docs, *args))
        return seen[0]

    monkeypatch.setattr(resharding, "reshard", watched)
    QUERIES["op4_flow_resharding"](spark, DIR)
    columns = documents[0].__fields__
    assert set(columns) <= set(seen[0].columns)
    assert sorted(map(tuple, seen[0].select(*columns).collect())) == sorted(map(tuple, documents))


def test_op7_op8(spark, documents):
    fp = {r["doc_id"]: brute_simhash(r["text"]) for r in documents}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    root = grouped(pairs, fp)
    assert {k: tuple(r)[1:] for k, r in rows_of(spark, "op7_simhash_pivots").items()} == {k: (f"{fp[k]:016x}", root[k]) for k in fp}
    want = brute_repeats([(r["doc_id"], r["text"]) for r in documents])
    got = rows_of(spark, "op8_suffix_trees")
    assert {k: tuple(r)[1:] for k, r in got.items()} == {k: (n, m, hashlib.sha256(t.encode()).hexdigest()) for k, (n, m, t) in want.items()}


def test_pipeline_against_brute_force(spark, documents):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = {v[0] for v in verdicts(documents) if v[-1]}
    docs = [r for r in documents if r["doc_id"] in good]
    model = attention.train(spark.createDataFrame(documents), labels)
    score = {r["doc_id"]: float(model.score(*attention.passages([r["text"].encode()]))[0]) for r in docs}
    docs = [r for r in docs if score[r["doc_id"]] >= GOOD]
    left = kept_by_brute_force(docs)
    assert 0 < len(left) < len(docs)
    docs = [r for r in docs if r["doc_id"] in left]
    cut = brute_repeats([(r["doc_id"], r["text"]) for r in docs])
    texts = [(r["doc_id"], cut[r["doc_id"]][2] if cut[r["doc_id"]][1] else r["text"]) for r in docs]
    assert 50 < len(texts) < len(documents)
    check_packing(corpus_pipeline.run(spark, DIR).collect(), texts, packing.CAPACITY)


def test_the_classifier_of_the_pipeline_learns_from_both_labels(spark, documents, monkeypatch):
    """Stage 1 keeps no document with label 0, so the stage's model is fitted on the whole table."""
    fit, seen = attention.fit, []

    def watched(x, bag, y, *args):
        seen.append(y)
        return fit(x, bag, y, *args)

    monkeypatch.setattr(attention, "fit", watched)
    good = {v[0] for v in verdicts(documents) if v[-1]}
    frame = spark.createDataFrame([r for r in documents if r["doc_id"] in good])
    corpus_pipeline.classifier_stage(spark, frame, DIR).count()
    assert len(seen) == 1 and set(seen[0].tolist()) == {0.0, 1.0}


def test_the_sample_is_taken_from_labelled_documents(spark):
    """Labels of documents that are not there take no place in the sample."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(900, 1000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1000)], "doc_id bigint, quality int")
    known = sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(900, 1000))
    _, _, y = attention._sampled(docs, labels, "doc_id", "text", "quality", 50)
    assert known > 50 and len(y) == 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert [f.name for f in out.schema] == docs.columns and out.dtypes == docs.dtypes
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    assert words(" a b") == [b"a", b"b"] and PATH


def test_stages_on_awkward_and_empty_tables(spark, messy, empty):
    """NULLs, odd texts, repeated rows and no rows at all go through every stage."""
    for docs in (messy, empty):
        docs = docs.select(*corpus_pipeline.COLUMNS)
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.count(), stored(stage(spark, docs, DIR), "stage")
            if name == "best-fit packing":
                assert docs.count() >= before
            else:
                assert docs.columns == corpus_pipeline.COLUMNS and docs.count() <= before, name
