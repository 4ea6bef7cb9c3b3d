"""What a written table leaves behind."""

import time
from pathlib import Path

from veilframe.llm.common import written


def _shuffled(spark) -> set[str]:
    """Shuffle files of some size."""
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for d in dirs for p in Path(str(d)).rglob("shuffle_*.data") if p.stat().st_size > 2_000}


def test_no_shuffle_files_stay(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    told, before = spark.conf.get(key, None), _shuffled(spark)
    some = spark.range(100_000).selectExpr("id % 1000 AS k").groupBy("k").count()
    assert len(some.collect()) == 1000
    there = _shuffled(spark)
    assert there - before  # as Spark leaves them
    table = written(some.where("k >= 0"))
    for _ in range(20):  # files go in the background
        if not _shuffled(spark) - there:
            break
        time.sleep(0.5)
    assert not _shuffled(spark) - there
    assert table.count() == 1000 and spark.conf.get(key, None) == told


def test_no_broadcasts_stay(spark):
    from pyspark.sql import functions as F

    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().memoryStore().memoryUsed()
    before, some = held(), spark.range(1000).selectExpr("id AS a", "id AS b")
    table = written(some.join(F.broadcast(some.limit(5)), ["a", "b"]))  # on two keys: at least a page of memory
    written(spark.range(1))  # Spark's listeners may have seen the first one late
    for _ in range(20):  # it goes in the background
        if held() - before < 1e6:
            break
        time.sleep(0.5)
    assert held() - before < 1e6
    assert table.count() == 5


def test_a_worker_gives_back_what_it_freed():
    import re

    from veilframe.llm.common import tidy

    rss = lambda: int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024

    def batches():
        held = [bytes(1000) for _ in range(100_000)]
        yield len(held), held.pop()

    before = rss()
    ((n, last),) = tidy(batches())  # the last one keeps the heap's end
    assert n == 100_000 and len(last) == 1000
    assert rss() - before < 50


def test_workers_drop_an_encoder_that_others_left():
    import pyarrow as pa

    from veilframe.llm import line_dedup, minhash_dedup, tokens
    from veilframe.llm.queries import tokenizer

    texts = pa.array(["one line of a text\nand another line of it"])
    for run in (
        lambda: line_dedup._cut_lines(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), texts], names=["id", "row", "text"])]), 24, 1),
        lambda: minhash_dedup._signatures(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), texts], names=["id", "hash", "text"])]), 2),
    ):
        tokens.encoder(tokenizer("word_bpe_49k.json"), False)
        assert sum(b.num_rows for b in run())
        assert not tokens._ENCODERS
