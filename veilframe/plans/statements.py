"""Rule sets as Spark SQL text: statements over catalog relations that outlive the session, and the views made of them.

A statement says the same as the frame of ``apply_rule_set`` and has the same types. It names relations
only, no frames, so ``CREATE VIEW`` takes it; who asks is known when the view is read, not when it is made.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from veilframe.functions import transforms as tf
from veilframe.functions.types import is_numeric, spark_type
from veilframe.model import Field, Policy, PolicyError, RuleSet, Transform
from veilframe.operators.apply import _Builder, _free, _names, _path, token_key, total_key

#: Targets whose statement goes into a model of another tool: nothing is made here, and fixed values stand as written.
MODEL = "DBT_SQL"


@dataclass(frozen=True)
class Members:
    """Who is in which group: a relation (table, or a query in brackets) that has a row for each user and group. The caller is the session's user."""

    relation: str
    user: str = "user"
    group: str = "group"

    def groups(self) -> str:
        """A scalar subquery: the caller's groups, an empty array if there are none."""
        return f"(SELECT collect_set({quoted(self.group)}) FROM {self.relation} WHERE {quoted(self.user)} = session_user())"


def quoted(name: str) -> str:
    """One name in back quotes."""
    return "`" + name.replace("`", "``") + "`"


def dotted(name: str) -> str:
    """A name of several parts, each quoted."""
    return ".".join(map(quoted, name.split(".")))


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Text:
    """The columns of one rule set as text."""

    def __init__(self, df: DataFrame, caller: Collection[str] | Members, groups: str, raw: bool):
        self.df, self.caller, self.groups, self.raw = df, caller, groups, raw
        self.kinds = _Builder(df, set(), ())
        self.totals: dict[str, str] = {}
        self.tokens: dict[str, str] = {}

    def dispatch(self, entries: tuple, build: Callable) -> str:
        if not entries or entries[-1].principals or any(not e.principals for e in entries[:-1]):
            raise PolicyError("the last entry, and no other, must be for everybody else")
        if not isinstance(self.caller, Members):
            return build(next(e for e in entries if not e.principals or set(e.principals) & set(self.caller)))
        whens = "".join(f" WHEN arrays_overlap({quoted(self.groups)}, array({', '.join(map(literal, e.principals))})) THEN {build(e)}" for e in entries[:-1])
        return f"CASE{whens} ELSE {build(entries[-1])} END" if whens else build(entries[-1])

    def branch(self, t: Transform, name: str, kind: T.DataType) -> str:
        x, spark = dotted(name), self.df.sparkSession
        as_text = x if isinstance(kind, T.StringType) else f"CAST({x} AS STRING)"
        if t.kind == "identity":
            return x
        if t.kind == "nullify":
            return "NULL"
        if t.kind == "fixed":
            if self.raw:
                return str(t.get("value"))
            tf.fixed(spark, t.get("value"), kind)
            return f"CAST({literal(t.get('value'))} AS {kind.simpleString()})"
        if t.kind == "regexp":
            pattern, new = t.get("regexp"), t.get("replacement") or ""
            tf.check_regexp(spark, pattern, new)
            return f"regexp_replace({as_text}, {literal(pattern)}, {literal(new)})" if new else f"regexp_extract({as_text}, {literal(pattern)}, {int(tf.has_group(pattern))})"
        if t.kind == "hash":
            tf.hashed(self.df[name], kind, t.get("seed"))
            seeded = as_text if t.get("seed") is None else f"concat({literal(str(t.get('seed')) + ':')}, {as_text})"
            return f"CAST(conv(substring(sha2({seeded}, 256), 1, 15), 16, 10) AS BIGINT)" if is_numeric(kind) else f"sha2({seeded}, 256)"
        if t.kind == "sql_statement":
            return f"({t.get('statement', t.get('value'))})"
        if t.kind == "numeric_rounding":
            how, divisor, precision = tf.rounding_of(t)
            if divisor is None and how == "round":
                return f"round({x}, {precision or 0})"
            part = f"CAST({x} AS DOUBLE) / {float(divisor)!r}D"
            return f"({how}({part}{f', {precision or 0}' if how == 'round' else ''}) * {float(divisor)!r}D)"
        if t.kind == "detokenize":
            return f"coalesce(CAST({quoted(self.tokens[token_key(name, t)])} AS STRING), {as_text})"
        if t.kind == "aggregation":
            total, precision = quoted(self.totals[total_key(name, t)]), tf.aggregation_of(t)[3]
            return total if precision is None else f"round({total}, {precision})"
        raise PolicyError(f"unknown transform {t.kind!r}")

    def field(self, name: str, entries: tuple[Transform, ...]) -> str:
        kind = _path(self.df, name)
        if self.raw:
            return self.dispatch(entries, lambda t: self.branch(t, name, kind))
        common = self.kinds.common(name, entries).simpleString()
        return self.dispatch(entries, lambda t: f"CAST({self.branch(t, name, kind)} AS {common})")

    def column(self, name: str, kind: T.DataType, wanted: dict) -> str:
        """A field with whatever is transformed within it; a struct is put together again, a null one stays null."""
        if name.lower() in wanted:
            return self.field(*wanted[name.lower()])
        if not any(n.startswith(name.lower() + ".") for n in wanted):
            return dotted(name)
        parts = ", ".join(f"{literal(f.name)}, {self.column(f'{name}.{f.name}', f.dataType, wanted)}" for f in kind.fields)
        return f"if({dotted(name)} IS NULL, NULL, named_struct({parts}))"


def _condition(text: _Text, f, as_of) -> str:
    if f.kind == "generic":
        return text.dispatch(f.conditions, lambda c: f"({c.value})")
    if f.kind != "retention":
        raise PolicyError(f"unknown filter {f.kind!r}")
    kind = _path(text.df, f.field)
    kind = kind if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else T.TimestampType()
    now = f"CAST({'current_timestamp()' if as_of is None else literal(str(as_of))} AS {kind.simpleString()})"
    return text.dispatch(f.conditions, lambda c: "true" if c.value is None else f"({quoted(f.field)} > {now} - make_dt_interval({c.value}))")


def statement(df: DataFrame, rule_set: RuleSet, source: str, caller: Collection[str] | Members, fields: Iterable[Field] | None = None, token_sources: dict[str, str] | None = None, as_of: datetime | str | None = None) -> str:
    """``apply_rule_set`` as a SELECT over relation ``source``, whose columns are those of ``df``.

    caller: a fixed set of groups, which decides while the text is made, or ``Members``, which
    decides when it runs. token_sources: relations by the policy's name for them (default: that name).
    The rule set's own texts stand in it as they are, in brackets.
    """
    wanted = {name.lower(): (name, entries) for name, entries in rule_set.transforms}
    if len(wanted) < len(rule_set.transforms):
        raise PolicyError("a field is transformed twice")
    for name, _ in wanted.values():
        _path(df, name)
    text = _Text(df, caller, _free(df, "groups"), rule_set.target_type == MODEL)
    asks = f", {caller.groups()} AS {quoted(text.groups)}" if isinstance(caller, Members) else ""
    base = f"SELECT *{asks} FROM {source}"
    where = " AND ".join(f"({_condition(text, f, as_of)})" for f in rule_set.filters)
    visible = f"SELECT * FROM ({base})" + (f" WHERE {where}" if where else "")
    joins, taken = [], set()
    for name, entries in wanted.values():
        for t in entries:
            if t.kind != "detokenize" or token_key(name, t) in text.tokens:
                continue
            ref = t.get("token_source_ref")
            token, value = (x if isinstance(x, str) else ".".join(dict(x)["name_parts"]) for x in (t.get("token_field"), t.get("value_field")))
            k = len(text.tokens)
            text.tokens[token_key(name, t)] = f"__value_of_{k}"
            side = f"SELECT CAST({dotted(token)} AS STRING) AS `__token_of_{k}`, {dotted(value)} AS `__value_of_{k}` FROM {(token_sources or {}).get(ref, ref)}"
            joins.append(f"LEFT JOIN ({side}) ON CAST({dotted(name)} AS STRING) = `__token_of_{k}`")
            taken |= {f"__value_of_{k}", f"__token_of_{k}"}
    body = f"SELECT * FROM __visible {' '.join(joins)}" if joins else "SELECT * FROM __visible"
    sets: dict[tuple[str, ...], dict[str, str]] = {}
    for name, entries in wanted.values():
        for t in entries:
            if t.kind == "aggregation" and total_key(name, t) not in text.totals:
                how, by, cast_to, _ = tf.aggregation_of(t)
                alias = text.totals[total_key(name, t)] = f"__total_of_{len(text.totals)}"
                x = dotted(name)
                sets.setdefault(tuple(by), {})[alias] = f"avg(CAST({x} AS {spark_type(cast_to) if cast_to else 'double'}))" if how == "avg" else f"{how}({x})"
    backs = []
    for i, (by, aggs) in enumerate(sets.items()):
        keys = [f"`__by_{i}_{j}`" for j in range(len(by))]
        picked = ", ".join([*(f"{dotted(c)} AS {k}" for c, k in zip(by, keys, strict=True)), *(f"{a} AS {quoted(n)}" for n, a in aggs.items())])
        if by:
            backs.append(f"LEFT JOIN (SELECT {picked} FROM __rows GROUP BY {', '.join(map(dotted, by))}) ON {' AND '.join(f'{dotted(c)} <=> {k}' for c, k in zip(by, keys, strict=True))}")
        else:
            backs.append(f"CROSS JOIN (SELECT {picked} FROM __rows)")
        taken |= {k.strip("`") for k in keys} | set(aggs)
    if clash := taken & {c.lower() for c in df.columns}:
        raise PolicyError(f"the source has columns named like the statement's own: {sorted(clash)}")
    picked = ", ".join(f"{text.column(c, df.schema[c].dataType, wanted)} AS {quoted(c)}" for c in _names(df, fields))
    return f"WITH __visible AS ({visible}), __rows AS ({body}) SELECT {picked} FROM __rows{''.join(' ' + b for b in backs)}"


def statements(df: DataFrame, policy: Policy, caller: Collection[str] | Members, source: str | None = None, **options) -> dict[str, str]:
    """One statement for each target of a policy; ``source``: its relation, if it is not the policy's own name."""
    return {r.target: statement(df, r, source or policy.source, caller, policy.fields or None, **options) for r in policy.rule_sets}


def publish(spark: SparkSession, policy: Policy, caller: Collection[str] | Members, source: str | None = None, **options) -> dict[str, str]:
    """Make every target of a policy; its statements by target.

    Views stay in the catalog and are worked out for whoever reads them. Targets of another type are
    tables, written now, which is refused where the result would depend on who asks; for models (``MODEL``) there is the statement only.
    """
    df = spark.sql(f"SELECT * FROM {source or policy.source}")
    made = statements(df, policy, caller, source, **options)
    for r in policy.rule_sets:
        if r.target_type == "SQL_VIEW":
            spark.sql(f"CREATE OR REPLACE VIEW {dotted(r.target)} AS {made[r.target]}")
        elif r.target_type != MODEL:
            if isinstance(caller, Members):
                raise PolicyError(f"{r.target} is a table: it needs fixed groups")
            spark.sql(made[r.target]).write.mode("overwrite").saveAsTable(dotted(r.target))
    return made
