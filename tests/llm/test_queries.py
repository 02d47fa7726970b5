"""The registered queries at the smallest scale: against SQL where there is one, else against brute force."""

import hashlib
import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import language, lines, mixing, neardup, pieces, png, queries

SF = "/root/testdata/sf0.001"


def shown(v):
    """A value as text; whole numbers alike, whether pandas holds them as integers or, beside NULLs, as floats."""
    if v is None or v != v:
        return "NULL"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(shown, row)) for row in df.where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_oracle(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_op3(spark):
    from tests.llm.test_small import exact_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    idf = neardup.word_weights(*neardup.document_frequencies(docs))
    rows = [(r.doc_id, r.text, None) for r in docs.collect()]
    got = {r.doc_id: r.class_id for r in queries.op3_minhash_near_dedup(spark, SF).collect()}
    assert got == exact_classes(rows, idf)


def test_op5(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.op5_media_png(spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        data = png.payload(texts[r.doc_id])
        media = png.write_png(data)
        assert (r.payload_sha256, r.media_sha256, r.media_bytes) == (hashlib.sha256(data).hexdigest(), hashlib.sha256(media).hexdigest(), len(media))
        assert r.feature == png.cosine_hash(np.frombuffer(data, np.uint8).reshape(-1, 64))


def test_op6_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = [r for r in queries.op6_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) > 0.98 * len(out)


def test_op10(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op10_sentencepiece(spark, SF).collect():
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.round_trip) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)


def test_pipeline(spark):
    """Each stage against brute force over what the stage before it left."""
    import sentencepiece

    from tests.llm.test_small import WORDS, brute_lines, exact_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        got[name] = docs.collect()
        assert name == "sentencepiece" or tuple(docs.columns) == corpus_pipeline.COLUMNS
    known = {r.doc_id: r for r in got["language_id"]}
    assert all(known[r.doc_id].text == r.text for r in before if r.doc_id in known) and len(known) > 0.98 * len(before)
    assert all(not any(map(str.isalpha, r.text or "")) or len(r.text) >= 200 for r in before if r.doc_id not in known)
    want = {i: v[3] for i, v in brute_lines([(r.doc_id, r.text, None) for r in got["language_id"]]).items()}
    assert {r.doc_id: r.text for r in got["line_dedup"]} == {i: t for i, t in want.items() if WORDS.search(t)}
    assert all(r.n_chars == len(r.text) for r in got["line_dedup"])
    rows = [(r.doc_id, r.text, None) for r in got["line_dedup"]]
    idf = neardup.word_weights(*neardup.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert sorted(r.doc_id for r in got["minhash_near_dedup"]) == sorted(set(exact_classes(rows, idf).values()))
    source = spark.createDataFrame(got["minhash_near_dedup"], spark.read.parquet(f"{SF}/documents.parquet").schema)
    copies = {r.doc_id: r._mix_copies for r in mixing.mix(source).collect()}
    taken = [r.doc_id for r in got["mix_sources"]]
    assert {i: taken.count(i) for i in set(taken)} == {i: n for i, n in copies.items() if n}
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in got["mix_sources"]}
    assert len(got["sentencepiece"]) == len(taken)
    for r in random.Random(0).sample(got["sentencepiece"], 40):
        assert r.ids == model.encode(texts[r.doc_id]) and r.round_trip
    assert corpus_pipeline.run(spark, SF).count() == len(taken)
    assert language.UNKNOWN == "und" and lines.MIN_WORDS == 8
