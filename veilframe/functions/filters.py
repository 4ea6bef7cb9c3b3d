"""The row filters of a policy as Spark conditions on source columns."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.members import Caller, dispatch
from veilframe.model import Filter, PolicyError


def clock(as_of: datetime | str | Column | None, kind: T.DataType) -> Column:
    """The job's one clock in the type of the column it is compared with."""
    now = F.current_timestamp() if as_of is None else as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    return now.cast(kind if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "timestamp")


def kept(col: Column, days: int | None, now: Column) -> Column:
    """Younger than so many days, to the moment; without a period always. Written so that a scan can skip old row groups."""
    return F.lit(True) if days is None else col > now - F.make_dt_interval(F.lit(days))


def condition(f: Filter, caller: Caller, schema: T.StructType, as_of: datetime | str | Column | None = None) -> Column:
    """Of the entries the first for this caller; a condition that is NULL drops the row."""
    if f.kind == "generic":
        return dispatch(f.conditions, caller, lambda c: F.expr(c.value))
    if f.kind == "retention":
        name = next((x for x in schema.names if x.lower() == f.field.lower()), None)
        if name is None:
            raise PolicyError(f"retention on unknown field {f.field!r}")
        now = clock(as_of, schema[name].dataType)
        return dispatch(f.conditions, caller, lambda c: kept(F.col(f"`{name}`"), c.value, now))
    raise PolicyError(f"unknown filter {f.kind!r}")


def all_hold(filters: tuple[Filter, ...], caller: Caller, schema: T.StructType, as_of: datetime | str | Column | None = None) -> Column | None:
    """Every filter must hold; None without filters."""
    found = [condition(f, caller, schema, as_of) for f in filters]
    return reduce(lambda a, b: a & b, found) if found else None
