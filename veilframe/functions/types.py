"""Type names of policies as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

#: Names that Spark's own parser does not know, or knows otherwise.
NAMES = {"int2": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "bool": "boolean", "float4": "float", "float64": "double", "float8": "double", "numeric": "double", "decimal": "double", "text": "string", "varchar": "string", "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "datetime": "timestamp"}


def spark_type(name: str) -> str:
    """Spark's name; sized text types lose their size, unknown names are text."""
    name = (name or "string").strip().lower()
    if name.startswith(("varchar(", "character varying", "char(")):
        return "string"
    if name.startswith("number("):
        return name.replace("number", "decimal")
    name = NAMES.get(name, name)
    try:
        T._parse_datatype_string(name)
    except Exception:
        return "string"
    return name


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)
