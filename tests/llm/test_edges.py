"""Nulls, repeated rows and empty tables where the other tests have none; the pipeline's stages on such a table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from veilframe.llm import exact_dedup, line_dedup, sentencepiece_viterbi
from veilframe.llm.queries import tokenizer

LINE = "a line that is long enough to be compared"
SF = "/root/testdata/sf0.001"


def test_lines_of_null_ids_and_repeated_rows(spark):
    rows = [(None, f"{LINE}\nkept"), (None, f"{LINE}\nkept"), (1, f"{LINE}!\nown words of the first"), (1, f"{LINE}!\nown words of the first"), (2, LINE)]
    got = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, f"{LINE}\nkept", 2, 0)] * 2 + [(1, "own words of the first", 2, 1)] * 2 + [(2, "", 1, 1)]


def test_rows_that_stay_without_copies(spark):
    rows = [(3, "same", "x"), (1, "same", "y"), (1, "same", "y"), (None, "same", "z"), (None, "alone", "z"), (4, None, "n"), (5, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    assert sorted(map(str, exact_dedup.without_copies(docs).collect())) == sorted(map(str, docs.where("(doc_id = 1) or (doc_id is null and text = 'alone') or doc_id = 4").collect()))
    assert exact_dedup.without_copies(docs.limit(0)).count() == 0


def test_pieces_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    coded = sentencepiece_viterbi.encode(empty, tokenizer("piece_bpe_32k.model"))
    assert coded.count() == 0 and sentencepiece_viterbi.decode(coded.drop("text"), tokenizer("piece_bpe_32k.model")).count() == 0


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, f"{LINE}\nwrite to anna.berg@mail.org about it"), (1, f"{LINE}\nwrite to anna.berg@mail.org about it"), (2, None), (3, ""), (None, f"{LINE}\nand of nobody"), (4, LINE), (5, "word " * 30_000), (6, "\n \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string")})
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def test_each_stage_of_the_pipeline_on_odd_rows(spark, odd, tmp_path):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "toxicity":
            assert docs.count() == 8  # all clean, repeated rows and null ids too
        elif name == "line_dedup":
            got = {(r.doc_id, r.text) for r in docs.collect()}
            assert (None, f"{LINE}\nand of nobody") in got and not any(d == 4 for d, _ in got) and {(2, None), (3, "")} <= got
        elif name == "minhash_near_dedup":
            assert docs.where("doc_id = 1").count() == 1 and docs.where("doc_id in (2, 3) or doc_id is null").count() == 3
        elif name == "pii":
            assert "anna.berg" not in docs.where("doc_id = 1").first().text and docs.where("doc_id = 2").first().text is None
    assert {r.doc_id for r in docs.collect()} >= {None, 1, 2, 3, 5}


def test_each_stage_of_the_pipeline_on_no_rows(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
