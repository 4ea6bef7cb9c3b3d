"""The column transforms of a policy as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.types import is_numeric, spark_type
from veilframe.model import PolicyError, Transform


def nullify(kind: T.DataType) -> Column:
    return F.lit(None).cast(kind)


def fixed(spark: SparkSession, value: str, kind: T.DataType) -> Column:
    """A literal of the field's type; a value that does not parse as that is refused here."""
    #: Over literal rows this is folded while planning; no job runs.
    if spark.sql(f"SELECT try_cast(:value AS {kind.simpleString()}) IS NULL AS bad FROM VALUES (1)", args={"value": value}).first()["bad"]:
        raise PolicyError(f"fixed value {value!r} is no {kind.simpleString()}")
    return F.lit(value).cast(kind)


def has_group(pattern: str) -> bool:
    """Does a Java pattern capture anything? Plain and named groups count; quoted text, escapes and character classes do not."""
    depth = at = 0
    while at < len(pattern):
        rest = pattern[at:]
        if rest.startswith("\\Q"):
            end = pattern.find("\\E", at)
            at = len(pattern) if end < 0 else end + 2
            continue
        if rest[0] == "\\":
            at += 2
            continue
        if rest[0] == "[":
            depth += 1
        elif rest[0] == "]":
            depth = max(0, depth - 1)
        elif rest[0] == "(" and not depth and (not rest.startswith("(?") or re.match(r"\(\?<[A-Za-z]", rest)):
            return True
        at += 1
    return False


def check_regexp(spark: SparkSession, pattern: str, replacement: str = "") -> None:
    """A pattern that Spark's regular expressions (Java's) do not take is refused here."""
    text = "regexp_replace('', :p, :r)" if replacement else f"regexp_extract('', :p, {int(has_group(pattern))})"
    try:
        #: Over literal rows this is folded while planning; no job runs.
        spark.sql(f"SELECT {text} FROM VALUES (1)", args={"p": pattern} | ({"r": replacement} if replacement else {})).first()
    except Exception as e:
        raise PolicyError(f"no regular expression: {pattern!r}") from e


def regexp(col: Column, pattern: str, replacement: str = "") -> Column:
    """Without a replacement the first group, or the whole match ('' without one); else all matches replaced, ``$1`` a group. Patterns are Java's."""
    if not replacement:
        return F.regexp_extract(col, pattern, int(has_group(pattern)))
    return F.regexp_replace(col, pattern, replacement)


def hashed(col: Column, kind: T.DataType, seed: str | int | None = None) -> Column:
    """Numbers to a number of 60 bits, from the first hex digits of the SHA-256 of their text; text to SHA-256 in hex."""
    if is_numeric(kind):
        text = col.cast("string")
        digest = F.sha2(text if seed is None else F.concat(F.lit(f"{seed}:"), text), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    if isinstance(kind, T.StringType):
        return F.sha2(col if seed is None else F.concat(F.lit(f"{seed}:"), col), 256)
    raise PolicyError(f"hashing {kind.simpleString()} is not supported")


def rounded(col: Column, how: str, divisor: float | None = None, precision: int | None = None) -> Column:
    """ceil, floor: to multiples of the divisor; round: half away from zero, to a precision, of multiples if a divisor is given. With a divisor in double precision, so whole numbers beyond 2^53 lose digits."""
    if how in ("ceil", "floor"):
        d = F.lit(float(divisor))
        return (F.ceil if how == "ceil" else F.floor)(col.cast("double") / d) * d
    if how != "round":
        raise PolicyError(f"unknown rounding {how!r}")
    if divisor is not None:
        d = F.lit(float(divisor))
        return F.round(col.cast("double") / d, precision or 0) * d
    return F.round(col, precision or 0)


def aggregate(col: Column, how: str, cast_to: str | None = None) -> Column:
    """The aggregate function, before its window."""
    if how == "sum":
        return F.sum(col)
    if how == "avg":
        return F.avg(col.cast(spark_type(cast_to) if cast_to else "double"))
    if how in ("min", "max"):
        return (F.min if how == "min" else F.max)(col)
    raise PolicyError(f"unknown aggregate {how!r}")


def settings_of(t: Transform, key: str) -> dict:
    """A nested setting as a dict."""
    found = t.get(key)
    return dict(found) if isinstance(found, tuple) else {}


def rounding_of(t: Transform) -> tuple[str, float | None, int | None]:
    for how in ("ceil", "floor", "round"):
        if t.get(how) is not None:
            s = settings_of(t, how)
            divisor, precision = s.get("divisor"), s.get("precision")
            return how, None if divisor is None else float(divisor), None if precision is None else int(precision)
    raise PolicyError("rounding without a kind")


def aggregation_of(t: Transform) -> tuple[str, list[str], str | None, int | None]:
    for how in ("sum", "avg", "min", "max"):
        if t.get(how) is not None:
            s = settings_of(t, how)
            parts = t.get("partition_by") or ()
            precision = s.get("precision")
            return how, [str(p) if isinstance(p, str) else ".".join(p) for p in parts], s.get("cast_to"), None if precision is None else int(precision)
    raise PolicyError("aggregation without a kind")
