"""Registered text queries: against SQL where there is some, and the pipeline stage by stage."""

import os
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers
from edges import corpus, frame, words

import corpus_pipeline
from studylattice.llm import quality, queries, toxicity
from studylattice.session import fresh_dir

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in db.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()), key=repr)


def test_stages_take_effect(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    leak = " ".join(words(77, 30))
    rows += [(5000, " ".join(words(5000, 50)) + " " + leak)]
    folder = fresh_dir(spark, "corpus")
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    marks = [(i, 1, 0) for i in range(1, 30)] + [(400 + i, 0, 1) for i in range(10)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[2:4]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        left = {r.doc_id for r in out.collect()}
        assert len(left) < before
        before = len(left)
        if name == "near_dedup":
            assert {100, 5000} <= left and not left & set(range(101, 106))
        else:
            assert 5000 not in left and 100 in left
        path = fresh_dir(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("doc_id").count().count() <= before
    assert packed.count() > 0


def written(spark, rows, labels, items=()):
    """Tables of a small folder."""
    folder = fresh_dir(spark, "corpus")
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_first_and_last_stages_equal_plain_loops(spark):
    """The classifiers one text at a time, and the packed ids against the tokenizer's."""
    rows = [(i, t) for i, t in corpus() if i is not None and len(t or "") < 50_000]
    good = [(1000 + i, " ".join(words(1000 + i, 80)) + " and that is all there is to say.") for i in range(60)]
    bad = [(2000 + i, "@@@ ### $$$ " * 10 + words(i, 3)[0]) for i in range(60)]
    rude = [(3000 + i, " ".join(words(3000 + i, 40)) + " you horrible idiot " + words(i, 2)[1]) for i in range(60)]
    rows += good + bad + rude
    labels = [(i, int(i < 2000 or i >= 3000), int(i >= 3000)) for i, _ in good + bad + rude]
    folder = written(spark, rows, labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    models = {"quality": quality.train(docs, marks), "toxicity": toxicity.train(docs, marks)}

    def stays(name, text):
        if name == "quality":
            return models[name].score(quality.features(pa.array([(text or "").encode()], pa.binary())))[0] >= 0.7
        return models[name].score([text or ""])[0] < 0.5

    for name, stage in corpus_pipeline.STAGES[:2]:
        kept = stage(spark, docs, folder)
        assert kept.schema.names == docs.schema.names
        want = [(i, t) for i, t in rows if stays(name, t)]
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(want, key=repr)
        assert 60 < len(want) < len(rows)
    few = docs.filter("doc_id >= 3000 or doc_id in (400, 401, 407)")
    pieces = corpus_pipeline.STAGES[4][1](spark, few, folder).collect()
    texts = {r.doc_id: r.text for r in few.collect()}
    encoder = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in texts.items():
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        packed = b"".join(bytes(p.ids) for p in own)
        assert packed == np.array(ids, "<u4").tobytes() and {p.doc_tokens for p in own} == {len(ids)}
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) and p.length * 4 == len(p.ids) for p in own)


def test_empty_documents_go_through(spark):
    folder = written(spark, [], [], [(1, "some words")])
    assert corpus_pipeline.run(spark, folder).count() == 0
