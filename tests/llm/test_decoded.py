"""The pipeline's last stage decodes what it encodes."""

import hashlib

import corpus_pipeline as P


def test_last_stage_decodes(spark):
    texts = ["Plain words, 12 of them.", "é 🙂\n\n  x", "", None]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.decoded_sha256 for r in P.encode(spark, docs, "").collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in enumerate(texts)}
