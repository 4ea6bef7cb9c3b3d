"""Applying a policy: filter, then join tokens, then project. One caller, every principal in one scan, or each user."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions import transforms as tf
from veilframe.functions.filters import all_hold, condition
from veilframe.functions.members import Caller, dispatch, member
from veilframe.functions.types import is_numeric
from veilframe.model import Condition, Field, Filter, Policy, PolicyError, RuleSet, Transform, principals_in

UNMATCHED = "unmatched"


def _names(df: DataFrame, fields: Iterable[Field] | None) -> list[str]:
    """The policy's fields in order, as the table spells them; all columns without a list."""
    if fields is None:
        return df.columns
    own = {c.lower(): c for c in df.columns}
    missing = [f.name for f in fields if f.name.split(".")[0].lower() not in own]
    if missing:
        raise PolicyError(f"the source has no {missing}")
    out = [own[f.name.split(".")[0].lower()] for f in fields]
    return list(dict.fromkeys(out))


def _path(df: DataFrame, name: str) -> T.DataType:
    kind: T.DataType = df.schema
    for part in name.split("."):
        hit = next((f for f in kind.fields if f.name.lower() == part.lower()), None) if isinstance(kind, T.StructType) else None
        if hit is None:
            raise PolicyError(f"unknown field {name!r}")
        kind = hit.dataType
    return kind


def _active(entries: tuple[Transform, ...], caller: Caller) -> list[Transform]:
    """The entries that can decide for this caller."""
    if isinstance(caller, Column):
        return list(entries)
    return [next(e for e in entries if not e.principals or member(caller, e.principals))] if entries and not entries[-1].principals else list(entries)


class _Builder:
    """Columns of one rule set over a filtered, joined frame."""

    def __init__(self, df: DataFrame, caller: Caller, keys: tuple[str, ...]):
        self.df, self.caller, self.keys = df, caller, keys
        self.totals: dict[str, Column] = {}
        self.tokens: dict[str, str] = {}

    def branch(self, t: Transform, col: Column, name: str, kind: T.DataType) -> Column:
        if t.kind == "identity":
            return col
        if t.kind == "nullify":
            return tf.nullify(kind)
        if t.kind == "fixed":
            return tf.fixed(self.df.sparkSession, t.get("value"), kind)
        if t.kind == "regexp":
            tf.check_regexp(self.df.sparkSession, t.get("regexp"), t.get("replacement") or "")
            return tf.regexp(col.cast("string"), t.get("regexp"), t.get("replacement") or "")
        if t.kind == "hash":
            return tf.hashed(col, kind, t.get("seed"))
        if t.kind == "sql_statement":
            return F.expr(t.get("statement", t.get("value")))
        if t.kind == "numeric_rounding":
            return tf.rounded(col, *tf.rounding_of(t))
        if t.kind == "detokenize":
            text = col if isinstance(kind, T.StringType) else col.cast("string")
            return F.coalesce(F.col(f"`{self.tokens[token_key(name, t)]}`").cast("string"), text) if token_key(name, t) in self.tokens else text
        if t.kind == "aggregation":
            total, precision = self.totals[total_key(name, t)], tf.aggregation_of(t)[3]
            return total if precision is None else F.round(total, precision)
        raise PolicyError(f"unknown transform {t.kind!r}")

    def kind_of(self, t: Transform, col: Column, name: str, kind: T.DataType) -> T.DataType:
        """Type of a branch whoever asks, from the analysed expression; no job runs."""
        if t.kind in ("identity", "nullify", "fixed"):
            return kind
        if t.kind == "hash":
            return T.LongType() if is_numeric(kind) else T.StringType()
        if t.kind == "regexp":
            return T.StringType()
        if t.kind == "detokenize":
            return T.StringType()
        if t.kind == "aggregation":
            how, _, cast_to, precision = tf.aggregation_of(t)
            out = tf.aggregate(col, how, cast_to)
            return self.df.agg((out if precision is None else F.round(out, precision)).alias("x")).schema["x"].dataType
        return self.df.select(self.branch(t, col, name, kind).alias("x")).schema["x"].dataType

    def common(self, name: str, entries: tuple[Transform, ...]) -> T.DataType:
        """The type of a transformed field: that of its branches, a common one of numbers, else text."""
        kinds = [self.kind_of(t, _column(name), name, _path(self.df, name)) for t in entries]
        if all(k == kinds[0] for k in kinds):
            return kinds[0]
        if all(map(is_numeric, kinds)):
            return self.df.sparkSession.range(1).select(F.coalesce(*(F.lit(None).cast(k) for k in kinds)).alias("x")).schema["x"].dataType
        return T.StringType()

    def column(self, name: str, entries: tuple[Transform, ...]) -> Column:
        kind, col, common = _path(self.df, name), _column(name), self.common(name, entries)
        return dispatch(entries, self.caller, lambda t: self.branch(t, col, name, kind).cast(common))


def _column(name: str) -> Column:
    """A field by its dotted path."""
    first, *rest = name.split(".")
    return reduce(lambda c, p: c[p], rest, F.col(f"`{first}`"))


def _free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return next(n for k in range(len(taken) + 1) if (n := f"__{stem}_{k}") not in taken)


def token_key(name: str, t: Transform) -> str:
    """A join for each field: two fields of one token source have values of their own."""
    return f"{name.lower()}|{t.get('token_source_ref')}|{t.get('token_field')}|{t.get('value_field')}"


def apply_rule_set(df: DataFrame, rule_set: RuleSet, caller: Caller, fields: Iterable[Field] | None = None, token_sources: dict[str, DataFrame] | Callable[[str], DataFrame] | None = None, as_of: datetime | str | None = None, unique_tokens: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as ``caller`` sees it: source columns only, in source order, in types that do not depend on the caller.

    caller: a set of groups, or an array column of ``df`` with the groups of each row's caller.
    Columns that the policy does not list are not exposed. Filters see source columns. Window
    aggregates see the rows that pass the filters for this caller; without partition fields they
    are one aggregate that is joined to every row. Detokenizing joins every token source whoever
    asks, so a repeated token multiplies rows; with ``unique_tokens`` the caller vouches that
    tokens are unique and unneeded joins are left out. Detokenized values are text; a token and a field of different types are
    compared as text; each field joins its token source directly, and Spark splits the partition of a token that very many rows have.
    ``keys``: columns that lead the output and every window (principal matrix).
    """
    wanted = {}
    for name, entries in rule_set.transforms:
        if name.lower() in wanted:
            raise PolicyError(f"{name!r} is transformed twice")
        wanted[name.lower()] = (name, entries)
    names = [c for c in _names(df, fields) if c not in keys]
    source = df
    rows = all_hold(rule_set.filters, caller, df.schema, as_of)
    if rows is not None:
        source = source.where(rows)
    build = _Builder(source, caller, keys)
    asked: dict[str, tuple[str, Transform]] = {}
    for name, entries in wanted.values():
        _path(df, name)
        for t in entries if not unique_tokens else _active(entries, caller):
            if t.kind == "detokenize":
                asked.setdefault(token_key(name, t), (name, t))
    totals = [(name, t) for name, entries in wanted.values() for t in _active(entries, caller) if t.kind == "aggregation"]
    if unique_tokens:
        source = _with_totals(source, totals, build)
    for name, t in asked.values():
        source = _with_tokens(source, name, t, token_sources, build)
    if not unique_tokens:
        source = _with_totals(source, totals, build)
    build.df = source
    out = [F.col(f"`{k}`") for k in keys]
    for c in names:
        inner = [(n, e) for n, e in wanted.values() if n.lower().split(".")[0] == c.lower()]
        col = F.col(f"`{c}`")
        for n, entries in inner:
            col = build.column(n, entries) if "." not in n else col.withField(n.split(".", 1)[1], build.column(n, entries))
        out.append(col.alias(c))
    return source.select(*out)


def _token_source(df: DataFrame, t: Transform, token_sources) -> tuple[DataFrame, str, str]:
    """The token table and the names of its token and value."""
    ref = t.get("token_source_ref")
    table = token_sources(ref) if callable(token_sources) else (token_sources or {}).get(ref)
    if table is None:
        try:
            table = df.sparkSession.table(ref)
        except Exception as e:
            raise PolicyError(f"token source {ref!r} is missing") from e
    token, value = (x if isinstance(x, str) else ".".join(dict(x)["name_parts"]) for x in (t.get("token_field"), t.get("value_field")))
    return table, token, value


def _with_tokens(df: DataFrame, name: str, t: Transform, token_sources, build: _Builder) -> DataFrame:
    table, token, value = _token_source(df, t, token_sources)
    build.tokens[token_key(name, t)] = alias = _free(df, "value")
    key = _free(df, "token")
    side = table.select(F.col(token).alias(key), F.col(value).alias(alias))
    own, same = _column(name), side.schema[key].dataType == _path(df, name)
    return df.join(side, own == F.col(key) if same else own.cast("string") == F.col(key).cast("string"), "left").drop(key)


def total_key(name: str, t: Transform) -> str:
    how, by, cast_to, _ = tf.aggregation_of(t)
    return f"{name}|{how}|{cast_to}|{','.join(by)}"


def _with_totals(df: DataFrame, totals: list[tuple[str, Transform]], build: _Builder) -> DataFrame:
    """Window aggregates as grouped ones: all of one set of keys in one grouping, partially aggregated before its shuffle and joined back null-safely.

    Rows are not moved for it where the groups are few (Spark then broadcasts them by their measured
    size), and a group of very many rows stays in many tasks. Several sets of keys are one grouping
    too: each row goes in once for each set, with its keys. Its result joins once for each set and every total is
    taken from whichever join has it; so all joins read the same exchange, and the frame is scanned twice in all.
    """
    wanted: dict[str, tuple[Column, tuple[str, ...]]] = {}
    for name, t in totals:
        how, by, cast_to, _ = tf.aggregation_of(t)
        wanted.setdefault(total_key(name, t), (tf.aggregate(_column(name), how, cast_to), (*build.keys, *by)))
    if not wanted:
        return df
    sets = list(dict.fromkeys(on for _, on in wanted.values()))
    alias = {key: _free(df, f"total_{i}") for i, key in enumerate(wanted)}
    build.totals |= {key: F.col(a) for key, a in alias.items()}
    rows = _free(df, "rows")
    if len(sets) == 1:
        names = [_free(df, f"by_{i}") for i in range(len(sets[0]))]
        side = df.groupBy(*(_column(c).alias(n) for c, n in zip(sets[0], names, strict=True))).agg(F.count("*").alias(rows), *(agg.alias(alias[k]) for k, (agg, _) in wanted.items()))
        return _joined_back(df, side, sets[0], names, rows)
    columns = list(dict.fromkeys(c for on in sets for c in on))
    which, names = _free(df, "set"), {c: _free(df, f"by_{i}") for i, c in enumerate(columns)}
    kinds = {c: df.select(_column(c).alias("x")).schema["x"].dataType for c in columns}
    copies = F.array(*(F.struct(F.lit(i).alias(which), *((_column(c) if c in on else F.lit(None)).cast(kinds[c]).alias(n) for c, n in names.items())) for i, on in enumerate(sets)))
    inner = _free(df, "copies")
    told = df.withColumn(inner, F.explode(copies)).groupBy(*(F.col(inner)[n].alias(n) for n in (which, *names.values())))
    #: The set once more as an aggregate: a condition on it is not moved below the grouping, which would make another grouping of each join.
    mark = _free(df, "mark")
    own = {k: sets.index(on) for k, (_, on) in wanted.items()}
    told = told.agg(F.max(F.col(inner)[which]).alias(mark), F.count("*").alias(rows), *(agg.alias(alias[k]) for k, (agg, _) in wanted.items()))
    told = told.select(mark, rows, *names.values(), *(F.when(F.col(mark) == own[k], F.col(a)).alias(a) for k, a in alias.items()))
    out = df
    for i, on in enumerate(sets):
        keys = [_free(df, f"key_{i}_{j}") for j in range(len(on))]
        side = told.where(F.col(mark) == i).select(rows, *(F.col(names[c]).alias(n) for c, n in zip(on, keys, strict=True)), *(F.col(a).alias(f"{a}_{i}") for a in alias.values()))
        out = _joined_back(out, side, on, keys, rows, on == next(filter(None, sets)))
    return out.select(*df.columns, *(F.coalesce(*(F.col(f"{a}_{i}") for i in range(len(sets)))).alias(a) for a in alias.values()))


#: The largest groups, of which each may have more than one in LARGEST of all rows; their rows are dealt out over PLACES places.
LARGEST, PLACES = 1000, 64


def _joined_back(df: DataFrame, side: DataFrame, on: tuple[str, ...], names: list[str], rows: str, deal: bool = True) -> DataFrame:
    """``df`` with the values of ``side``, which has one row a group and in ``rows`` how many of df's rows it has.

    The largest groups are broadcast, so at most LARGEST rows; whatever rows find theirs there leave their key in the other
    join, where they would all meet in one task, and are dealt out. deal: do so; a later join of the same grouping is planned
    by its measured size and moves no rows where groups are few.
    """
    if not on:
        return df.crossJoin(F.broadcast(side.drop(rows)))
    if not deal:
        return df.join(side.drop(rows), reduce(lambda a, b: a & b, (_column(c).eqNullSafe(F.col(n)) for c, n in zip(on, names, strict=True))), "left")
    values = [c for c in side.columns if c not in (*names, rows)]
    got, place, own = _free(df, "got"), _free(df, "place"), _free(df, "own_place")
    heads = [_free(df, f"head_{j}") for j in range(len(names))]
    same = lambda keys: reduce(lambda a, b: a & b, (_column(c).eqNullSafe(F.col(n)) for c, n in zip(on, keys, strict=True)))
    large = side.orderBy(F.desc(rows)).limit(LARGEST).select(*(F.col(n).alias(h) for n, h in zip(names, heads, strict=True)), F.struct(*values).alias(got))
    plain = [F.col(f"`{f.name}`") for f in df.schema if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    dealt = df.join(F.broadcast(large), same(heads), "left").withColumn(place, F.when(F.col(got).isNotNull(), F.pmod(F.xxhash64(*plain), F.lit(PLACES)) + 1).otherwise(0))
    #: Always 0, but no constant: that would not be a key.
    rest = side.withColumn(own, F.when(F.col(rows) < 0, 1).otherwise(0).cast("long"))
    out = dealt.join(rest, same(names) & (F.col(place) == F.col(own)), "left")
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.when(F.col(got).isNotNull(), F.col(got)[v]).otherwise(F.col(v)).alias(v) for v in values))


def principals_frame(df: DataFrame, rule_set: RuleSet, only: Collection[str] | None = None) -> DataFrame:
    """``principal, groups``: each principal that the rule set names, and one that is in no group.

    only: these; ``unmatched`` asks for the latter. Principals that the rule set does not name are refused.
    """
    known = principals_in(rule_set)
    if only is not None and (unknown := sorted(set(only) - {*known, UNMATCHED})):
        raise PolicyError(f"the policy does not name {unknown}")
    rows = [(p, [p]) for p in known] + [(UNMATCHED, [])]
    return df.sparkSession.createDataFrame([r for r in rows if only is None or r[0] in only], "principal string, groups array<string>")


def _choices(rule_set: RuleSet) -> list[tuple]:
    """Every list of entries of which one is chosen for a caller."""
    return [entries for _, entries in rule_set.transforms if entries] + [f.conditions for f in rule_set.filters]


def decisions(rule_set: RuleSet, groups: Column, groups_seen: bool = False) -> Column:
    """Which entry of each list a caller of these groups gets, as text: callers with the same see the same.

    groups_seen: SQL text of the rule set sees the groups themselves; then those that it names tell callers apart too.
    """
    out = [F.lit("")]
    for entries in _choices(rule_set):
        pick = F
        for i, e in enumerate(entries[:-1]):
            pick = pick.when(member(groups, e.principals), F.lit(str(i)))
        out.append(pick.otherwise(F.lit(str(len(entries) - 1))) if len(entries) > 1 else F.lit("0"))
    if groups_seen:
        out.append(F.to_json(F.array_sort(F.array_intersect(groups, F.array(*map(F.lit, principals_in(rule_set))).cast("array<string>")))))
    return F.concat_ws(",", *out)


def _seen_by_any(df: DataFrame, rule_set: RuleSet, as_of) -> DataFrame:
    """Rows that some caller may see, for the scan: of each filter any condition holds."""
    for f in rule_set.filters:
        some = [condition(Filter(f.kind, (Condition(c.value),), f.field), set(), df.schema, as_of) for c in f.conditions]
        df = df.where(reduce(lambda a, b: a | b, some))
    return df


def principal_matrix(df: DataFrame, rule_set: RuleSet, principals: DataFrame | None = None, principal_col: str = "principal", groups_col: str | None = None, **options) -> DataFrame:
    """What every principal sees, in one scan: ``<principal_col>`` and the source columns.

    principals: ``principal, groups`` (default: those of the rule set and ``unmatched``). The result
    has a row for each principal and row it may see. Principals for whom the same entries decide are
    one class (``decisions``): the rule set is applied once a class, and principals join the result by their class.
    So the work before that grows with the classes, of which a policy has few, not with the users. groups_col: a name by which the policy's
    SQL text sees the groups of the caller, as far as the rule set names them. The source must not have a column ``principal_col``.
    """
    if principal_col.lower() in (c.lower() for c in df.columns):
        raise PolicyError(f"the source has a column {principal_col!r}: give principal_col another name")
    if groups_col is not None and groups_col.lower() in (c.lower() for c in df.columns):
        raise PolicyError(f"the source has a column {groups_col!r}")
    of, groups = _free(df, "class"), groups_col or _free(df, "groups")
    if principals is None:
        #: The policy's own principals are told apart while the plan is made.
        own: dict[tuple, list] = {}
        for p, gs in [(p, [p]) for p in principals_in(rule_set)] + [(UNMATCHED, [])]:
            picked = tuple(next((i for i, e in enumerate(entries) if not e.principals or set(gs) & set(e.principals)), -1) for entries in _choices(rule_set))
            own.setdefault((*picked, *(gs if groups_col else ())), []).append((p, gs))
        classes = df.sparkSession.createDataFrame([(str(i), ps[0][1]) for i, ps in enumerate(own.values())], T.StructType([T.StructField(of, T.StringType()), T.StructField(groups, T.ArrayType(T.StringType()))]))
        told = df.sparkSession.createDataFrame([(str(i), p) for i, ps in enumerate(own.values()) for p, _ in ps], T.StructType([T.StructField(of, T.StringType()), T.StructField(principal_col, T.StringType())]))
    else:
        told = principals.select(F.col("principal").alias(principal_col), F.coalesce("groups", F.array().cast("array<string>")).alias(groups))
        told = told.withColumn(of, decisions(rule_set, F.col(groups), groups_col is not None))
        named = F.array_sort(F.array_intersect(groups, F.array(*map(F.lit, principals_in(rule_set))).cast("array<string>")))
        classes = told.groupBy(of).agg(F.min(named).alias(groups))
    rows = df if groups_col is not None else _seen_by_any(df, rule_set, options.get("as_of"))
    both = rows.crossJoin(F.broadcast(classes) if principals is None else classes)
    fields = options.pop("fields", None) or [Field(c) for c in df.columns]
    seen = apply_rule_set(both, rule_set, F.col(groups), fields, keys=(of,), **options)
    side = told.select(of, principal_col)
    out = [c for c in seen.columns if c != of]
    return seen.join(F.broadcast(side) if principals is None else side, of).select(principal_col, *(F.col(f"`{c}`") for c in out))


def evaluate(df: DataFrame, policy: Policy, only: Collection[str] | None = None, **options) -> dict[str, DataFrame]:
    """The principal matrix of every rule set, by target."""
    return {r.target: principal_matrix(df, r, principals_frame(df, r, only), fields=policy.fields or None, **options) for r in policy.rule_sets}


def apply_policy(df: DataFrame, policy: Policy, caller: Caller, **options) -> dict[str, DataFrame]:
    """One governed frame for each target."""
    return {r.target: apply_rule_set(df, r, caller, policy.fields or None, **options) for r in policy.rule_sets}


def dynamic(df: DataFrame, rule_set: RuleSet, user_groups: DataFrame, user: str | None = None, **options) -> DataFrame:
    """One frame whose result depends on who runs it: the user's groups are one row, read when the query runs."""
    from veilframe.functions.members import groups_of

    groups = _free(df, "groups")
    both = df.crossJoin(F.broadcast(groups_of(user_groups, user).withColumnRenamed("groups", groups)))
    return apply_rule_set(both, rule_set, F.col(groups), options.pop("fields", None) or [Field(c) for c in df.columns], **options)

