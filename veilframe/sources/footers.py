"""Blueprints of many tables at once, from the footers of their files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where Spark keeps a schema with its comments and other metadata in a file's footer.
_OWN = b"org.apache.spark.sql.parquet.row.metadata"
FIELDS = "table string, file string, field string, ord int, type string, required boolean, comment string, tags array<string>"


def files_of(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """``table, file`` of Parquet tables by the path of each; file contents are not read."""
    found = None
    for table, path in tables.items():
        part = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(F.lit(table).alias("table"), F.col("path").alias("file"))
        found = part if found is None else found.unionAll(part)
    return found


def schema_of(footer: pa.Schema) -> T.StructType:
    """Spark's own schema if the file has one, else that of its columns."""
    own = (footer.metadata or {}).get(_OWN)
    if own:
        return T.StructType.fromJson(json.loads(own))
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(footer, prefer_timestamp_ntz=True)


def fields_of(schema: T.StructType, prefix: str = "") -> Iterator[tuple]:
    """``field, type, required, comment, tags`` of every field, those of structs by dotted path behind their struct."""
    for f in schema.fields:
        known = f.metadata or {}
        yield prefix + f.name, f.dataType.simpleString(), not f.nullable, known.get("comment"), [str(t) for t in known.get("tags") or ()]
        if isinstance(f.dataType, T.StructType):
            yield from fields_of(f.dataType, f"{prefix}{f.name}.")


def footers(files: DataFrame, at_once: int = 64) -> DataFrame:
    """``FIELDS``: every field of every file of ``files(table, file)``. Executors read the footers, about ``at_once`` files a task; a file that cannot be read fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {name: [] for name in ("table", "file", "field", "ord", "type", "required", "comment", "tags")}
            for table, file in zip(*(batch.column(c).to_pylist() for c in ("table", "file")), strict=True):
                fs, path = (pafs.LocalFileSystem(), "/" + file.removeprefix("file:").lstrip("/")) if file.startswith(("/", "file:")) else pafs.FileSystem.from_uri(file)
                for n, row in enumerate(fields_of(schema_of(pq.read_schema(path, filesystem=fs)))):
                    for name, value in zip(rows, (table, file, row[0], n, *row[1:]), strict=True):
                        rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("table", pa.string()), ("file", pa.string()), ("field", pa.string()), ("ord", pa.int32()), ("type", pa.string()), ("required", pa.bool_()), ("comment", pa.string()), ("tags", pa.list_(pa.string()))]))

    tasks = max(1, -(-files.count() // at_once))
    return files.select("table", "file").repartition(tasks, "file").mapInArrow(read, FIELDS)


def blueprints(files: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """The blueprint of each table: ``table, title, field, ord, type, required, comment, tags, conflict``.

    A field is the same in all files of a table if its path is, whatever its letter case; it stands
    at its first place, is required where every file has and requires it, keeps any comment, and all tags. ``type``
    is that of the most files, of several the least; ``conflict`` says that not all have it. tags: ``table, field, tag`` from elsewhere, which are added.
    ``title`` is the last part of the table's name.
    """
    rows = footers(files)
    total = files.groupBy("table").agg(F.countDistinct("file").alias("all"))
    by_type = rows.groupBy("table", F.lower("field").alias("name"), "type").agg(
        F.min("field").alias("field"), F.min("ord").alias("ord"), F.min("required").alias("required"), F.max("comment").alias("comment"), F.flatten(F.collect_set("tags")).alias("tags"), F.countDistinct("file").alias("n")
    )
    #: Types of one field are few.
    told = by_type.groupBy("table", "name").agg(
        F.min("field").alias("field"), F.min("ord").alias("ord"), F.min("required").alias("required"), F.max("comment").alias("comment"), F.flatten(F.collect_list("tags")).alias("tags"),
        F.sum("n").alias("n"), F.min(F.struct(-F.col("n"), "type")).getField("type").alias("type"), (F.count("*") > 1).alias("conflict"),
    )
    told = told.join(total, "table")
    if tags is not None:
        more = tags.groupBy("table", F.lower("field").alias("name")).agg(F.collect_set("tag").alias("more"))
        told = told.join(more, ["table", "name"], "left").withColumn("tags", F.concat("tags", F.coalesce("more", F.array().cast("array<string>"))))
    title = F.element_at(F.split("table", r"\."), -1).alias("title")
    return told.select("table", title, "field", "ord", "type", (F.col("required") & (F.col("n") >= F.col("all"))).alias("required"), "comment", F.array_sort(F.array_distinct("tags")).alias("tags"), "conflict")
