"""Checks of policies as rows: each returns the violations, ``policy, rule, detail``.

Tables: policies(policy, source_ref, platform, title, target_type), fields(policy, field, type),
entries(policy, rule_set, field, ord, kind, principals, value), conditions(policy, rule_set,
filter, filter_kind, field, ord, principals), tokens(policy, rule_set, token_source).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.sql_names import columns_in, functions_in, names_in
from veilframe.functions.types import spark_type


def _out(df: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    return df.select("policy", F.lit(rule).alias("rule"), (F.lit("") if detail is None else detail.cast("string")).alias("detail"))


def source_empty(policies: DataFrame) -> DataFrame:
    return _out(policies.where(F.coalesce("source_ref", F.lit("")) == ""), "source_empty")


def platform_empty(policies: DataFrame) -> DataFrame:
    return _out(policies.where((F.col("target_type") == "SQL_VIEW") & (F.coalesce("platform", F.lit("")) == "")), "platform_empty")


def title_short(policies: DataFrame, least: int = 3) -> DataFrame:
    return _out(policies.where(F.length(F.coalesce("title", F.lit(""))) < least), "title_short", F.col("title"))


def unknown_principal(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Letter case does not count."""
    used = entries.select("policy", F.explode("principals").alias("p")).distinct()
    return _out(used.join(groups.select(F.upper("group").alias("g")).distinct(), F.upper("p") == F.col("g"), "left_anti"), "unknown_principal", F.col("p"))


def unknown_field(entries: DataFrame, fields: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Fields of transforms, and of retention filters if given, that the source lacks; letter case does not count."""
    used = entries.select("policy", "field")
    if conditions is not None:
        used = used.unionByName(conditions.where("filter_kind = 'retention'").select("policy", "field"))
    known = fields.select(F.col("policy").alias("kp"), F.upper("field").alias("kf"))
    return _out(used.distinct().join(known, (F.col("policy") == F.col("kp")) & (F.upper("field") == F.col("kf")), "left_anti"), "unknown_field", F.col("field"))


def _repeated(df: DataFrame, rule: str, *keys: str | Column, detail: str) -> DataFrame:
    named = df.groupBy("policy", *keys).count().where("count > 1")
    return _out(named, rule, F.col(detail))


def duplicate_tokens(tokens: DataFrame) -> DataFrame:
    return _repeated(tokens, "duplicate_token_source", "rule_set", "token_source", detail="token_source")


def empty_transforms(lists: DataFrame) -> DataFrame:
    """lists: ``policy, field, entries``."""
    return _out(lists.where(F.size("entries") == 0), "no_transforms", F.col("field"))


def last_has_principals(entries: DataFrame, keys: tuple[str, ...] = ("rule_set", "field"), rule: str = "last_entry_not_default", detail: str = "field") -> DataFrame:
    """The last entry of a list names somebody; serves transforms and, by (rule_set, filter), filter conditions."""
    last = entries.groupBy("policy", *keys).agg(F.max(F.struct("ord", F.size("principals").alias("n"))).alias("m"))
    return _out(last.where(F.col("m.n") > 0), rule, F.col(detail))


def several_defaults(entries: DataFrame) -> DataFrame:
    return _repeated(entries.where(F.size("principals") == 0), "several_defaults", "rule_set", "field", detail="field")


def overlapping_principals(entries: DataFrame) -> DataFrame:
    """Principals that two entries of a field name, in the same spelling; one entry that names somebody twice is no overlap."""
    lists = entries.groupBy("policy", "rule_set", "field").agg(F.flatten(F.collect_list(F.array_distinct("principals"))).alias("all"))
    #: Only fields that name somebody twice are taken apart, within the same exchange.
    some = lists.where(F.size("all") > F.size(F.array_distinct("all"))).select("policy", "rule_set", "field", F.explode("all").alias("principal"))
    twice = some.groupBy("policy", "rule_set", "field", "principal").count().where("count > 1")
    return _out(twice, "overlapping_principals", F.col("principal"))


def field_twice(lists: DataFrame) -> DataFrame:
    """lists: ``policy, rule_set, field``, one row for each list of transforms."""
    return _repeated(lists.withColumn("name", F.upper("field")), "field_twice", "rule_set", "name", detail="name")


def filter_last_has_principals(conditions: DataFrame) -> DataFrame:
    return last_has_principals(conditions, ("rule_set", "filter"), "last_condition_not_default", "filter")


def retention_twice(filters: DataFrame) -> DataFrame:
    """filters: ``policy, rule_set, field``, one row for each retention filter."""
    return _repeated(filters.withColumn("name", F.upper("field")), "retention_twice", "rule_set", "name", detail="name")


def filter_kind_missing(conditions: DataFrame) -> DataFrame:
    return _out(conditions.where(F.col("filter_kind").isNull() | ~F.col("filter_kind").isin("generic", "retention")), "filter_kind_missing", F.col("filter"))


def names_empty(entries: DataFrame) -> DataFrame:
    """Empty parts of field names and empty principal names."""
    parts = entries.where(F.exists(F.split("field", r"\."), lambda x: x == ""))
    who = entries.where(F.exists("principals", lambda x: x == ""))
    return _out(parts, "name_part_empty", F.col("field")).unionByName(_out(who, "principal_empty", F.col("field")))


#: Types that a text may fail to cast to.
TYPES = ("smallint", "int", "bigint", "float", "double", "boolean", "date", "timestamp")


def _misfit(kind: Column, value: Column) -> Column:
    """Does the text not cast to the type of this name?"""
    aliases = {t: [t, *(a for a in ("int4", "integer", "int8", "int2", "bool", "float4", "float8", "float64", "timestamptz") if spark_type(a) == t)] for t in TYPES}
    bad = F.lit(False)
    for t, names in aliases.items():
        bad = F.when(F.lower(kind).isin(names), value.try_cast(t).isNull()).otherwise(bad)
    return bad


def bad_fixed(entries: DataFrame, fields: DataFrame) -> DataFrame:
    """Fixed values that do not cast to the type of their field."""
    known = fields.select(F.col("policy").alias("kp"), F.upper("field").alias("kf"), "type")
    values = entries.where("kind = 'fixed'").join(known, (F.col("policy") == F.col("kp")) & (F.upper("field") == F.col("kf")))
    return _out(values.where(_misfit(F.col("type"), F.col("value"))), "bad_fixed_value", F.col("value"))


def _texts(entries: DataFrame, conditions: DataFrame | None) -> DataFrame:
    texts = entries.where("kind = 'sql_statement'").select("policy", F.col("value").alias("text"))
    if conditions is not None:
        texts = texts.unionByName(conditions.where("filter_kind = 'generic'").select("policy", F.col("value").alias("text")))
    return texts.where("text is not null")


def _unknown(used: DataFrame, known: DataFrame, rule: str, same: Column) -> DataFrame:
    """``used(policy, name)`` that meet nothing known, each once: what is known, often more, is not made distinct for that."""
    return _out(used.join(known, same, "left_anti").distinct(), rule, F.col("name"))


def _known_columns(fields: DataFrame) -> tuple[DataFrame, Column]:
    known = fields.select(F.col("policy").alias("kp"), F.split(F.lower("field"), r"\.")[0].alias("kf"))
    return known, (F.col("policy") == F.col("kp")) & (F.split("name", r"\.")[0] == F.col("kf"))


def unknown_columns(entries: DataFrame, fields: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Columns in the SQL text of statements, and of generic filters if given (``value``), that the source lacks; of a dotted name the first part counts, letter case does not."""
    used = _texts(entries, conditions).select("policy", F.explode(columns_in(F.col("text"))).alias("name"))
    known, same = _known_columns(fields)
    return _unknown(used, known, "unknown_column", same)


def unknown_functions(entries: DataFrame, functions: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Functions in the same texts that ``functions(name)`` lacks."""
    used = _texts(entries, conditions).select("policy", F.explode(functions_in(F.col("text"))).alias("name"))
    return _unknown(used, functions.select(F.lower("name").alias("kn")).distinct(), "unknown_function", F.col("name") == F.col("kn"))


def unknown_names(entries: DataFrame, fields: DataFrame, functions: DataFrame, conditions: DataFrame | None = None) -> DataFrame:
    """Both of these checks; each text is cut into tokens once."""
    names = _texts(entries, conditions).select("policy", names_in(F.col("text")).alias("names"))
    column = F.transform("names.columns", lambda n: F.struct(F.lit(True).alias("column"), n.alias("name")))
    function = F.transform("names.functions", lambda n: F.struct(F.lit(False).alias("column"), n.alias("name")))
    used = names.select("policy", F.explode(F.concat(column, function)).alias("x")).select("policy", "x.*")
    calls = functions.select(F.lower("name").alias("kn")).distinct()
    used = used.join(calls, ~F.col("column") & (F.col("name") == F.col("kn")), "left_anti")
    known, same = _known_columns(fields)
    left = used.join(known, F.col("column") & same, "left_anti").distinct()
    return left.select("policy", F.when(F.col("column"), "unknown_column").otherwise("unknown_function").alias("rule"), F.col("name").alias("detail"))


def masked_columns_return(entries: DataFrame) -> DataFrame:
    """Statements that show a field to somebody for whom the rule set hides it: ``<statement's field> shows <field> to <principal>``.

    For each principal that a rule set names, and for everybody else (``*``), the first entry that
    names them decides each field, else its default. A statement that decides one field and names another, or part of it, is
    reported where that other one's deciding entry is not identity. Whoever is in several groups
    sees what one of these, asked first, sees.
    """
    at = ["policy", "rule_set"]
    one = entries.where("policy is not null and rule_set is not null").select(*at, F.lower("field").alias("field"), F.struct("ord", "kind", F.col("value").alias("text"), "principals").alias("entry"))
    #: Dealt out by rule set, so that neither grouping moves rows again; a list, or a rule set, is a part of one document.
    lists = one.repartition(*at).groupBy(*at, "field").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    sets = lists.groupBy(*at).agg(F.collect_list(F.struct("field", "entries")).alias("lists"))
    sets = sets.where(F.exists("lists", lambda f: F.exists(f["entries"], lambda e: e["kind"] == "sql_statement")))
    none = F.array().cast("array<string>")
    who = F.flatten(F.transform("lists", lambda f: F.flatten(F.transform(f["entries"], lambda e: F.coalesce(e["principals"], none)))))
    who = F.array_distinct(F.concat(F.filter(who, lambda p: p.isNotNull()), F.array(F.lit("*"))))

    def used(entry: Column) -> Column:
        return F.when(entry["kind"] == "sql_statement", columns_in(entry["text"])).otherwise(none)

    #: Each statement is cut into tokens once, whoever is shown it.
    known = F.transform(F.filter("lists", lambda f: f["field"].isNotNull()), lambda f: F.struct(f["field"].alias("field"), F.transform(f["entries"], lambda e: F.struct(e["kind"].alias("kind"), e["principals"].alias("principals"), used(e).alias("used"))).alias("entries")))
    sets = sets.select(*at, who.alias("who"), known.alias("lists"))

    def decided(p: Column) -> Column:
        """Of each field the entry that decides for this principal."""
        first = lambda es, right: F.get(F.filter(es, right), F.lit(0))
        pick = lambda es: F.coalesce(first(es, lambda e: F.array_contains(e["principals"], p)), first(es, lambda e: F.size(e["principals"]) == 0))
        return F.transform("lists", lambda f: F.struct(f["field"].alias("field"), pick(f["entries"]).alias("entry")))

    each = sets.select("policy", F.explode("who").alias("who"), "lists").select("policy", "who", F.filter(decided(F.col("who")), lambda d: d["entry"].isNotNull()).alias("told"))
    shown = F.filter("told", lambda d: d["entry"]["kind"] == "sql_statement")
    both = each.select("policy", "who", "told", F.explode(shown).alias("s"))
    #: A name may be a field, a struct that holds it, or a part of it.
    within = lambda u, h: (u == h) | F.startswith(u, F.concat(h, F.lit("."))) | F.startswith(h, F.concat(u, F.lit(".")))
    hidden = F.filter("told", lambda h: (h["entry"]["kind"] != "identity") & (h["field"] != F.col("s.field")) & F.exists("s.entry.used", lambda u: within(u, h["field"])))
    both = both.select("policy", "who", F.col("s.field").alias("by"), F.explode(hidden).alias("h")).select("policy", "who", "by", F.col("h.field").alias("hides"))
    return _out(both, "masked_column_returns", F.concat_ws(" ", "by", F.lit("shows"), "hides", F.lit("to"), "who"))


def all_rules(policies: DataFrame, fields: DataFrame, lists: DataFrame, entries: DataFrame, conditions: DataFrame, tokens: DataFrame, groups: DataFrame, title: int = 3) -> DataFrame:
    """Every check above over the same tables at once: ``policy, rule, detail``.

    lists: ``policy, rule_set, field``, one row for each list of transforms; groups: ``group``. Rules about a row are told
    from the row. The others take two groupings, of counts and numbers only, so that both are hash aggregates over
    flat rows: one of names that the known fields must have (fields, retention fields, fixed values), which meets
    these in one join, one of whatever is merely counted (principals of a field, filters, token sources, names
    in either letter case). ``unknown_field`` covers retention filters too.
    """
    none, own = F.array().cast("array<string>"), F.col("rule_set").cast("int")
    conditions = conditions.withColumns({"filter_kind": F.coalesce("filter_kind", F.lit("")), "principals": F.coalesce("principals", none)})
    entries = entries.withColumn("principals", F.coalesce("principals", none))
    kept = conditions.where("filter_kind = 'retention'")
    #: A retention filter is one row, its first condition.
    first = F.when(F.col("ord") == 1, 1).otherwise(0)
    #: The greatest one of a list is odd if its last entry names somebody.
    last = F.coalesce(F.col("ord").cast("int").cast("long"), F.lit(-(1 << 32))) * 2 + (F.size("principals") > 0).cast("long")
    columns = {"rule_set": own, "name": None, "extra": F.lit(""), "lists": F.lit(0), "entries": F.lit(0), "defaults": F.lit(0), "last": F.lit(None)}
    kinds = {"rule_set": "int", "name": "string", "extra": "string", "last": "long"}

    def rows(df: DataFrame, about: str, name: str | Column, **given: Column) -> DataFrame:
        own = {**columns, "name": F.col(name) if isinstance(name, str) else name, **given}
        return df.select("policy", F.lit(about).alias("about"), *(c.cast(kinds.get(k, "int")).alias(k) for k, c in own.items()))

    def states(*parts: DataFrame) -> DataFrame:
        every = reduce(DataFrame.unionAll, parts)
        return every.groupBy("policy", "about", "rule_set", "name", "extra").agg(*(F.sum(c).alias(c) for c in ("lists", "entries", "defaults")), F.max("last").alias("last"))

    def told(df: DataFrame, *found: tuple[Column, str, Column, Column | int]) -> DataFrame:
        """A row for each condition that holds: ``policy, rule, detail, n``."""
        each = F.array(*(F.when(c, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))) for c, rule, detail, n in found))
        return df.select("policy", F.explode(each).alias("x")).where("x is not null").select("policy", "x.*")

    about, name, empty = lambda *x: F.col("about").isin(*x), F.col("name"), F.lit("")
    #: A field is unknown to a policy once, in whatever rule sets it stands.
    named = states(
        rows(entries, "use", "field", rule_set=F.lit(0)),
        rows(kept, "use", "field", rule_set=F.lit(0)),
        rows(entries.where("kind = 'fixed'"), "fixed", "field", extra=F.coalesce("value", empty), entries=F.lit(1)),
    )
    known = fields.groupBy(F.col("policy").alias("_p"), F.upper("field").alias("_f")).agg(F.min(F.lower("type")).alias("type"))
    named = named.join(known, (F.col("policy") == F.col("_p")) & (F.upper("name") == F.col("_f")), "left")
    counted = states(
        rows(lists, "field", "field", lists=F.lit(1)),
        rows(entries, "field", "field", entries=F.lit(1), defaults=(F.size("principals") == 0).cast("int"), last=last),
        rows(entries.select("*", F.explode(F.array_distinct("principals")).alias("principal")), "who", "field", extra=F.col("principal"), entries=F.lit(1)),
        rows(conditions, "filter", "filter", last=last),
        rows(tokens, "token", "token_source", lists=F.lit(1)),
        rows(lists, "field twice", F.upper("field"), lists=F.lit(1)),
        rows(kept, "retention twice", F.upper("field"), lists=first),
    )
    found = [
        told(policies, (F.coalesce("source_ref", empty) == "", "source_empty", empty, 1), ((F.col("target_type") == "SQL_VIEW") & (F.coalesce("platform", empty) == ""), "platform_empty", empty, 1), (F.length(F.coalesce("title", empty)) < title, "title_short", F.col("title"), 1)),
        told(conditions, (~F.col("filter_kind").isin("generic", "retention"), "filter_kind_missing", F.col("filter"), 1)),
        told(entries, (F.exists(F.split("field", r"\."), lambda x: x == ""), "name_part_empty", F.col("field"), 1), (F.array_contains("principals", ""), "principal_empty", F.col("field"), 1)),
        told(
            named,
            (about("use") & F.col("_p").isNull(), "unknown_field", name, 1),
            (about("fixed") & _misfit(F.col("type"), F.col("extra")), "bad_fixed_value", F.col("extra"), F.col("entries")),
        ),
        told(
            counted,
            (about("field") & (F.col("entries") == 0), "no_transforms", name, F.col("lists")),
            (about("field") & (F.col("last") % 2 != 0), "last_entry_not_default", name, 1),
            (about("field") & (F.col("defaults") > 1), "several_defaults", name, 1),
            (about("who") & (F.col("entries") > 1) & F.col("extra").isNotNull(), "overlapping_principals", F.col("extra"), 1),
            (about("filter") & (F.col("last") % 2 != 0), "last_condition_not_default", name, 1),
            (about("token") & (F.col("lists") > 1), "duplicate_token_source", name, 1),
            (about("field twice") & (F.col("lists") > 1), "field_twice", name, 1),
            (about("retention twice") & (F.col("lists") > 1), "retention_twice", name, 1),
        ),
    ]
    every = reduce(DataFrame.unionAll, found)
    every = every.select("policy", "rule", "detail", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_")).drop("_")
    return every.unionAll(unknown_principal(entries, groups))
