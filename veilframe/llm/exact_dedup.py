"""Exact dedup by content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, keep: str = "smallest", salts: int = 512) -> DataFrame:
    """One row per row of ``docs``: ``<id_col>, keep_id, group_size, kept, text_sha256``.

    Sampled splitters range-partition the rows by the text's first characters, with its SHA-256 and
    then a salt as tie-breaks, so splitters never hold whole texts. Each partition is sorted by the
    text's bytes, on disk as needed: equal texts are neighbours and are compared in full. That
    settles every range. A text that many rows have spans ranges, as its rows get up to ``salts``
    salts (one for each thousandth of all rows or part of it, ``salts`` at most); what its ranges
    have found is merged afterwards, a row a range, again by comparing whole texts.

    normalise: the text to compare (default: the text itself, byte for byte). Null counts as
    empty. keep: ``smallest`` or ``largest`` id of a group stays; a null id never stays if the
    group has another id. Rows that share id and text are one group of so many rows, all marked
    kept if their id stays. An empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit(""))
    best = F.max if keep == "largest" else F.min
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text")).withColumn("_sha", F.unhex(F.sha2("_text", 256)))
    total = max(1, docs.count())
    #: Fewer than 1000 texts have more than a thousandth of all rows each, so their digests are broadcast.
    many = rows.groupBy("_sha").agg(F.count("*").alias("_n")).where(F.col("_n") * 1000 > total)
    many = many.select("_sha", F.least(F.lit(salts), F.ceil(F.col("_n") * 1000 / total)).cast("long").alias("_salts"))
    dealt = rows.join(F.broadcast(many), "_sha", "left").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.coalesce("_salts", F.lit(1).cast("long"))))
    ranged = dealt.withColumn("_head", F.substring("_text", 1, 32)).repartitionByRange("_head", "_sha", "_salt")
    group = Window.partitionBy("_head", "_text", "_sha", "_salt")
    first = F.row_number().over(group.orderBy("_id")) == 1
    found = ranged.select("_id", "_sha", "_salt", best("_id").over(group).alias("_near"), F.count("*").over(group).alias("_size"), F.when(F.col("_salts") > 1, F.when(first, F.col("_text"))).alias("_split"))
    found = written(found, "settled")
    #: One row for each range of a text that spans several; whole texts are compared once more.
    pieces = found.where(F.col("_split").isNotNull()).select("_sha", "_salt", "_near", "_size", "_split")
    merged = pieces.groupBy("_sha", "_split").agg(F.sum("_size").alias("_all"), best("_near").alias("_best"))
    merged = pieces.join(merged, ["_sha", "_split"]).select(F.col("_sha").alias("_s"), F.col("_salt").alias("_t"), F.col("_near").alias("_k"), "_all", "_best")
    told = found.join(merged, (F.col("_sha") == F.col("_s")) & (F.col("_salt") == F.col("_t")) & F.col("_near").eqNullSafe(F.col("_k")), "left")
    spans = F.col("_all").isNotNull()
    keep_id = F.when(spans, F.col("_best")).otherwise(F.col("_near"))
    return told.select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("_all", "_size").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise: Column | None = None, **options) -> DataFrame:
    """The rows of ``docs`` whose id stays, with all their columns; null ids stay only where no other id has their text."""
    found = exact_dedup(docs, id_col, text_col, normalise, **options).where("kept")
    kept = found.select(F.col(id_col).alias("_keep"), F.col("text_sha256").alias("_digest")).distinct()
    digest = F.sha2(F.coalesce(F.col(text_col) if normalise is None else normalise, F.lit("")), 256)
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_keep")) & (digest == F.col("_digest")), "left_semi")
