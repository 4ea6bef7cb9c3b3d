"""Best-fit packing of token sequences in bulk-synchronous rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered, tidy, written
from .tokens import encoded, encoder


def pieces_of(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, window: int, end_id: int) -> DataFrame:
    """``id, item, piece, start, length, ids``: texts as token ids, those of more than ``window`` cut so that only their first piece is shorter. ``item`` numbers the pieces."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, item = encoder(tokenizer, True), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, _, flat, offsets in encoded(batch, enc, end_id):
                flat = flat.astype("<u4")
                sizes = np.diff(offsets)
                first = np.where(sizes > window, (sizes - 1) % window + 1, sizes)
                count = 1 + (sizes - first) // window
                own = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                start = np.where(piece == 0, 0, first[own] + (piece - 1) * window)
                length = np.where(piece == 0, first[own], window)
                at = offsets[own] + start
                ids = pa.array((flat[a:b].tobytes() for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + lo)), pa.array(item + np.arange(len(own))), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids], names=["id", "item", "piece", "start", "length", "ids"])
                item += len(own)

    return written(rows.mapInArrow(lambda it: tidy(cut(it)), f"id {kind}, item long, piece int, start long, length long, ids binary"), "pieces")


def match(items: DataFrame, slots: DataFrame) -> DataFrame:
    """``item, length, bin``: for each item the gap that it gets, or null; items: ``item, length``; slots: ``bin, slot, gap``.

    Items and gaps are sorted by size together, a gap after the items of its size. Of the items
    below a gap, the largest that no smaller gap takes gets it, as brackets match: an item goes one
    step up, a gap one step down, and an item's successor is the next gap that leaves the item's
    height. Sorted by height and place, the two are neighbours.
    """
    both = items.select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("item").alias("key"), F.lit(0).alias("slot"), F.lit(1).cast("long").alias("height"))
    both = both.unionAll(slots.select(F.col("gap"), F.lit(1), F.col("bin"), F.col("slot"), F.lit(-1).cast("long")))
    high = ordered(both, ["size", "kind", "key", "slot"], ("height",)).withColumn("height", F.col("height") + F.col("kind"))
    sweep = ordered(high.withColumnRenamed("n", "place"), ["height", "place"])
    some = sweep.where("kind = 0").select(F.col("key").alias("item"), F.col("size").alias("length"), "height", (F.col("n") + 1).alias("n"))
    return some.join(sweep.where("kind = 1").select("n", "height", F.col("key").alias("bin")), ["n", "height"], "left").select("item", "length", "bin")


def best_fit(items: DataFrame, window: int) -> DataFrame:
    """``item, bin, offset``: places of ``items(item, length)``, each at most ``window`` long, in few bins of ``window``.

    Each round opens as many bins as the waiting items need beyond the room there is, at least one if none fits;
    sorts items and gaps by size, gives each gap its nearest item below (``match``), takes what the
    items fill from the gaps, and goes on with the items that had to give way. A gap that holds the largest waiting
    item several times counts as so many equal gaps in that round, so short items do not need a round each.
    """
    spark = items.sparkSession
    waiting = written(items.select("item", F.col("length").cast("int").alias("length")), "waiting")
    gaps = spark.createDataFrame([], "bin long, gap int")
    placed, bins, turn = [], 0, 0
    while True:
        n, total, most, least = waiting.agg(F.count("*"), F.sum("length"), F.max("length"), F.min("length")).first()
        if not n:
            break
        open_n, room, widest = gaps.where(F.col("gap") >= least).agg(F.count("*"), F.coalesce(F.sum("gap"), F.lit(0)), F.coalesce(F.max("gap"), F.lit(0))).first()
        new = max(0, -(-(total - room) // window), int(not open_n))
        gaps = gaps.where(F.col("gap") >= least).unionAll(spark.range(bins, bins + new).select(F.col("id").alias("bin"), F.lit(window).alias("gap")))
        bins += new
        times = F.greatest(F.lit(1), F.least(F.expr(f"gap div {most}"), F.lit(-(-2 * n // (open_n + new)))).cast("int"))
        slots = gaps.withColumn("times", times).select("bin", F.posexplode(F.array_repeat(F.expr("cast(gap div times as int)"), F.col("times"))).alias("slot", "gap"))
        told = written(match(waiting, slots).withColumn("turn", F.lit(turn)), "matched")
        placed.append(told.where("bin is not null"))
        used = placed[-1].select("bin", (-F.col("length")).alias("gap"))
        gaps = written(gaps.unionAll(used).groupBy("bin").agg(F.sum("gap").cast("int").alias("gap")), "gaps")
        waiting, turn = told.where("bin is null").select("item", "length"), turn + 1
    if not placed:
        return items.select("item", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"))
    every = placed[0]
    for p in placed[1:]:
        every = every.unionAll(p)
    #: A bin has at most ``window`` items.
    before = Window.partitionBy("bin").orderBy("turn", "item").rowsBetween(Window.unboundedPreceding, -1)
    return every.select("item", "bin", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))


def pack_best_fit(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in few sequences of at most ``window`` ids: ``<id_col>, piece, start, length, ids, sequence_id, offset``.

    A document is its ids and ``end_id``; null texts count as empty and are one id long. Only longer
    documents are cut, from their end, so that all pieces but the first have ``window`` ids. Full
    pieces are sequences of their own; the others, at most one a document, are packed by ``best_fit``, which sees their
    lengths only. ``ids``: little-endian unsigned 32-bit integers. Null ids are documents like
    others, repeated rows are packed as often as they stand, other columns are not read. An empty table gives no rows.
    """
    pieces = pieces_of(docs, tokenizer, id_col, text_col, window, end_id)
    full = pieces.where(F.col("length") == window).select("id", "piece", "start", "length", "ids", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = pieces.where(F.col("length") < window)
    places = best_fit(short.select("item", "length"), window)
    rest = short.join(places, "item").select("id", "piece", "start", "length", "ids", F.col("bin").alias("sequence_id"), "offset")
    return full.unionAll(rest).withColumnRenamed("id", id_col)
