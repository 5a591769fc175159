import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        counts.append(docs.count())
        if name == "line_dedup":
            assert docs.selectExpr("sum(length(text)) n").first().n < before.selectExpr("sum(length(text)) n").first().n
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4] == counts[5] > 0
    assert docs.filter("n_tokens <> size(ids)").count() == 0


def test_cases_of_rows(spark):
    """Nulls, empty and very long texts, repeated rows, repeated ids and clashing names pass every stage."""
    prose = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "a", 1, "b", "c", "d") for r in prose]
    odd = [(None, "no id " * 30), (None, None), (900, None), (901, ""), (902, "word " * 40_000), (903, rows[3][1]), (903, "another text of id 903 with some words of its own\n" + rows[4][1]), (904, "\n \n")]
    rows += [(d, t, None, None, None, None, None, None, None, None) for d, t in odd] + [rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, fp STRING, own INT, gone STRING, keep STRING, component_id STRING")
    for name, stage in corpus_pipeline.STAGES:
        got = spark.createDataFrame(stage(spark, docs, SF).collect(), stage(spark, docs, SF).schema)
        assert {x.doc_id for x in got.select("doc_id").collect()} <= {x.doc_id for x in docs.select("doc_id").collect()}
        assert got.filter("doc_id IS NULL").count() == 2
        if name == corpus_pipeline.STAGES[-1][0]:
            assert got.count() == docs.count() and got.filter("NOT round_trip").count() == 0
        else:
            assert got.columns == docs.columns
            assert stage(spark, docs.limit(0), SF).count() == 0
            docs = got
