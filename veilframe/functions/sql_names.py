"""Which columns and functions the SQL texts of a policy name, as columns over a table of texts.

A text is cut into tokens by one regular expression, so a table of any size is scanned where it
lies; texts are not parsed. What a name is follows from its neighbours: a function stands before a
bracket, a literal's unit behind the literal, a type behind AS.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN, _QUOTED = r"[\p{L}_][\p{L}\p{N}_]*", "`(?:[^`]|``)*`"
_NAME = rf"(?:{_QUOTED}|{_PLAIN})"
#: In this order: comments, texts (raw ones too), a lambda's parameters with their arrow, a type behind AS, dotted names, numbers, any other sign.
_TOKEN = "|".join(
    (
        r"--[^\n]*|/\*.*?\*/",
        r"[rR]'[^']*'|[rR]\"[^\"]*\"|[xX]?'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"",
        rf"\(\s*{_PLAIN}(?:\s*,\s*{_PLAIN})*\s*\)\s*->|{_PLAIN}\s*->",
        rf"(?i:\bas)\s+{_PLAIN}(?:\s*<[\p{{L}}\p{{N}}_\s<>,:()]*>)?(?:\s*\(\s*\d+(?:\s*,\s*\d+)?\s*\))?",
        rf"{_NAME}(?:\s*\.\s*{_NAME})*",
        r"\d+(?:\.\d*)?(?:[eE][+-]?\d+)?\p{L}*",
        r"->|\S",
    )
)
#: Words that are neither columns nor functions.
KEYWORDS = ("all", "and", "any", "asc", "between", "both", "by", "case", "desc", "distinct", "div", "else", "end", "escape", "false", "from", "ilike", "in", "interval", "is", "leading", "like", "not", "null", "or", "regexp", "rlike", "some", "then", "trailing", "true", "when")
#: Parts of a date that stand before FROM.
UNITS = ("year", "quarter", "month", "week", "day", "dayofweek", "hour", "minute", "second")
#: Niladic functions, which stand without brackets.
NILADIC = ("current_date", "current_timestamp", "current_time", "current_user", "session_user", "user", "localtimestamp")


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, although an inner function asks for it at each element."""
    return F.transform(F.array(value), use)[0]


def _bare(name: Column) -> Column:
    """A name without quotes and the spaces around dots, in lower case."""
    return F.lower(F.replace(F.regexp_replace(name, r"\s*\.\s*", "."), F.lit("`"), F.lit("")))


def _kind(x: Column) -> Column:
    """Of a token: ``text`` (a literal), ``name`` (no keyword), ``number`` or ``sign``."""
    name = x.rlike(r"^(?!(?i:as)\s)[`\p{L}_]") & ~x.endswith("->") & ~F.lower(x).isin(*KEYWORDS)
    return F.when(x.rlike(r"^[rRxX]?['\"]"), "text").when(name, "name").when(x.rlike(r"^\d"), "number").otherwise("sign")


def _names(text: Column, wanted: Callable[..., Column]) -> Column:
    """``wanted(told, columns, functions)`` of the tokens (``x``, its ``kind``); the latter two pick the names of a kind from ``told``."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"(?s){_TOKEN}"), F.lit(0)), lambda x: ~(x.startswith("--") | x.startswith("/*")))
    tokens = F.transform(found, lambda x: F.struct(x.alias("x"), _kind(x).alias("kind")))

    def listed(told: Column, right: Callable[[Column, Column], Column]) -> Column:
        return F.sort_array(F.array_distinct(F.transform(F.filter(told["tokens"], lambda t, i: (t["kind"] == "name") & right(t["x"], i)), lambda t: _bare(t["x"]))))

    def columns(told: Column) -> Column:
        def right(x: Column, i: Column) -> Column:
            after, before = F.get(told["tokens"], i + 1), F.get(told["tokens"], i - 1)
            behind = F.coalesce(after["x"], F.lit(""))
            literal = F.coalesce(after["kind"] == "text", F.lit(False)) | F.coalesce(before["kind"].isin("text", "number"), F.lit(False))
            unit = (F.lower(behind) == "from") & F.lower(x).isin(*UNITS)
            inside = (F.size(told["taken"]) > 0) & F.array_contains(told["taken"], F.split(_bare(x), r"\.")[0])
            return (behind != "(") & ~literal & ~unit & ~F.lower(x).isin(*NILADIC) & ~inside

        return listed(told, right)

    def functions(told: Column) -> Column:
        return listed(told, lambda x, i: (F.coalesce(F.get(told["tokens"], i + 1)["x"], F.lit("")) == "(") | F.lower(x).isin(*NILADIC))

    def use(tokens: Column) -> Column:
        taken = F.flatten(F.transform(F.filter(tokens, lambda t: t["x"].endswith("->")), lambda t: F.regexp_extract_all(F.lower(t["x"]), F.lit(_PLAIN), F.lit(0))))
        return _with(F.when(tokens.isNotNull(), F.struct(tokens.alias("tokens"), taken.alias("taken"))), lambda told: wanted(told, columns, functions))

    return _with(tokens, use)


def names_in(text: Column) -> Column:
    """``columns`` and ``functions`` of an SQL expression, for whoever wants both: its tokens are cut once."""
    return _names(text, lambda told, columns, functions: F.struct(columns(told).alias("columns"), functions(told).alias("functions")))


def columns_in(text: Column) -> Column:
    """The columns that an SQL expression names, with the fields of structs behind dots: lower case, sorted, each once."""
    return _names(text, lambda told, columns, functions: columns(told))


def functions_in(text: Column) -> Column:
    """The functions that it calls, in the same way."""
    return _names(text, lambda told, columns, functions: functions(told))
