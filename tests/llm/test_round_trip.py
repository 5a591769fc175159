"""The pipeline's last stage decodes what it encodes and compares the bytes."""

import pytest

from tickweave.llm import byte_bpe

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_last_stage_checks_the_round_trip(spark):
    docs = spark.createDataFrame([(1, "Some words, ünïcode 你好\n\n 12"), (2, ""), (3, None)], "doc_id BIGINT, text STRING")
    got = corpus_pipeline.tokens(spark, docs, "").collect()
    assert [x.round_trip for x in got] == [True, True, True] and [len(x.ids) == x.n_tokens for x in got] == [True] * 3
    assert byte_bpe.encode(docs).columns == ["doc_id", "n_tokens", "ids"]
