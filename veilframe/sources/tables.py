"""Sources and sinks: typed CSV samples, policies as JSON rows, views, tables and CSV results."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.types import spark_type
from veilframe.model import Field


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where it is unset a local session gets a temporary folder; on a cluster this is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.get(context.applicationId) or tempfile.mkdtemp(prefix="veilframe-")
        _LOCAL[context.applicationId] = found
    return found.rstrip("/")


def read_csv(spark: SparkSession, path: str, fields: Iterable[Field]) -> DataFrame:
    """A CSV sample with a header, typed by a policy's fields.

    Columns are found by name, whatever their order and letter case; others are ignored, missing
    ones are null, values that do not parse are null. If no name matches there are no rows.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    own = {c.strip().lower(): c for c in raw.columns}
    hit = False
    out = []
    for f in fields:
        kind, at = spark_type(f.type), own.get(f.name.lower())
        hit |= at is not None
        out.append((F.lit(None).cast(kind) if at is None else F.trim(F.col(f"`{at}`")).try_cast(kind) if kind != "string" else F.col(f"`{at}`")).alias(f.name))
    return (raw if hit else raw.limit(0)).select(*out)


def read_policies(table: DataFrame, schema: str, json_col: str = "policy") -> DataFrame:
    """Policy rows with their JSON parsed; keys that the schema lacks are ignored."""
    return table.withColumn("parsed", F.from_json(json_col, schema))


def write_csv(df: DataFrame, path: str, by_principal: bool = False) -> None:
    """CSV with a header; null and empty text both print as nothing. A matrix goes to one folder for each principal."""
    w = df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "")
    (w.partitionBy("principal") if by_principal else w).csv(path)


def create_view(df: DataFrame, target: str) -> None:
    """A view by its whole name; a name with dots is one name and is written in back quotes."""
    df.createOrReplaceTempView(f"`{target}`")


def save_tables(frames: dict[str, DataFrame]) -> None:
    """One table for each rule set."""
    for target, df in frames.items():
        df.write.mode("overwrite").saveAsTable(target)
