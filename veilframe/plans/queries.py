"""The registered queries of the policy engine, each with the same question in DuckDB SQL.

Policies are written out as documents; tables of policies, tags, members and edges are derived
from the given tables, so that every query grows with its input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.members import distinct_groups, groups_by_user
from veilframe.functions.sql_names import names_in
from veilframe.model import Field, Policy, RuleSet, policy_from
from veilframe.operators import checks, lineage, models_meta, registry, tags
from veilframe.operators.apply import apply_policy, apply_rule_set, dynamic, principal_matrix, principals_frame
from veilframe.plans.statements import Members, publish, statement
from veilframe.sources.footers import blueprints, files_of
from veilframe.sources.tables import create_view, read_csv, read_policies, shared_folder, write_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rules(transforms: dict | None = None, filters: list | None = None) -> RuleSet:
    """A rule set of ``field: [(kind, settings, groups...)]`` and filters as in a document."""
    listed = [{"field": f, "transforms": [{k: v, "principals": [{"group": g} for g in gs]} for k, v, *gs in ts]} for f, ts in (transforms or {}).items()]
    return policy_from({"source": {"ref": "source"}, "rule_sets": [{"field_transforms": listed, "filters": filters or []}]}).rule_sets[0]


def generic(*conditions) -> dict:
    return {"generic_filter": {"conditions": [{"condition": c, "principals": [{"group": g} for g in gs]} for c, *gs in conditions]}}


def retention(field: str, *periods) -> dict:
    return {"retention_filter": {"field": {"name_parts": [field]}, "conditions": [{"principals": [{"group": g} for g in gs], **({} if d is None else {"period": {"days": d}})} for d, *gs in periods]}}


def fields(*names: str) -> list[Field]:
    return [Field(n) for n in names]


@F.pandas_udf(T.IntegerType())
def square(x: pd.Series) -> pd.Series:
    return x * x


ID, NULL = ("identity", {}), ("nullify", {})
CUSTOMER = rules({"c_name": [(*ID, "sales"), ("regexp", {"regexp": "^(.*)#.*$", "replacement": "$1#****"})], "c_acctbal": [(*ID, "sales"), NULL]}, [generic(("true", "sales"), ("c_acctbal > 0",))])
AS_OF = "2024-01-20 12:30:00"


# --- projections


@query("select o_orderkey, o_custkey, o_totalprice from orders")
def identity_closed_projection(spark, d):
    return apply_rule_set(table(spark, d, "orders"), rules({"o_totalprice": [ID]}), set(), fields("o_orderkey", "O_CUSTKEY", "o_totalprice"))


@query("select c_custkey, regexp_replace(c_name, '^(.*)#.*$', '\\1#****') c_name, c_nationkey, null::double c_acctbal, c_mktsegment from customer where c_acctbal > 0")
def mask_fixed_nullify(spark, d):
    return apply_rule_set(table(spark, d, "customer"), CUSTOMER, {"support"})


@query("select c_custkey, '****' c_name, 0 c_nationkey, c_mktsegment from customer")
def fixed_values(spark, d):
    r = rules({"c_name": [(*ID, "sales"), ("fixed", {"value": "****"})], "c_nationkey": [(*ID, "sales"), ("fixed", {"value": "0000"})]})
    return apply_rule_set(table(spark, d, "customer"), r, {"other"}, fields("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("select p_partkey, regexp_extract(p_type, '^(\\w+)', 1) p_type, regexp_extract(p_brand, '[0-9]+', 0) p_brand from part")
def regexp_extract_case(spark, d):
    return apply_rule_set(table(spark, d, "part"), rules({"p_type": [("regexp", {"regexp": "^(\\w+)"})], "p_brand": [("regexp", {"regexp": "[0-9]+"})]}), set(), fields("p_partkey", "p_type", "p_brand"))


@query("select c_custkey, regexp_replace(c_name, '^(.*)#0*(\\d+)$', '\\2/\\1', 'g') c_name from customer")
def regexp_replace_backref(spark, d):
    return apply_rule_set(table(spark, d, "customer"), rules({"c_name": [("regexp", {"regexp": "^(.*)#0*(\\d+)$", "replacement": "$2/$1"})]}), set(), fields("c_custkey", "c_name"))


@query("select c_custkey, sha256(c_name) c_name from customer")
def hash_string(spark, d):
    return apply_rule_set(table(spark, d, "customer"), rules({"c_name": [("hash", {})]}), set(), fields("c_custkey", "c_name"))


@query("select c_custkey, sha256('42:' || c_name) c_name from customer")
def hash_string_seed(spark, d):
    return apply_rule_set(table(spark, d, "customer"), rules({"c_name": [("hash", {"seed": 42})]}), set(), fields("c_custkey", "c_name"))


@query("select o_orderkey, ('0x' || substr(sha256('7:' || o_custkey), 1, 15))::bigint o_custkey from orders")
def hash_numeric(spark, d):
    return apply_rule_set(table(spark, d, "orders"), rules({"o_custkey": [("hash", {"seed": 7})]}), set(), fields("o_orderkey", "o_custkey"))


@query(r"select c_custkey, regexp_extract(c_name, '(\p{L}+)#', 1) c_name, regexp_extract(c_mktsegment, '\p{Lu}[(]?', 0) c_mktsegment, regexp_extract(c_acctbal::varchar, '(?P<whole>-?\d+)[.]', 1) c_acctbal from customer")
def regexp_unicode(spark, d):
    """Patterns that only Java's syntax has: letters by category, a named group, quoted brackets that are no group."""
    r = rules({"c_name": [("regexp", {"regexp": r"(\p{L}+)#"})], "c_mktsegment": [("regexp", {"regexp": r"\p{Lu}[(]?(?:\Q(\E)?"})], "c_acctbal": [("regexp", {"regexp": r"(?<whole>-?\d+)[.]"})]})
    rows = table(spark, d, "customer").withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal"))
    return apply_rule_set(rows, r, set(), fields("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))


def _rounding(name: str, settings: dict, sql: str, field: str = "l_extendedprice") -> None:
    def run(spark, d):
        return apply_rule_set(table(spark, d, "lineitem"), rules({field: [("numeric_rounding", settings)]}), set(), fields("l_orderkey", "l_linenumber", field))

    run.__name__ = name
    query(f"select l_orderkey, l_linenumber, {sql} {field} from lineitem")(run)


_rounding("round_ceil", {"ceil": {"divisor": 100}}, "ceil(l_extendedprice / 100.0::double) * 100.0::double")
_rounding("round_floor", {"floor": {"divisor": -10}}, "floor(l_quantity / (-10.0)::double) * (-10.0)::double", "l_quantity")
_rounding("round_precision", {"round": {"precision": -3}}, "round(l_extendedprice, -3)")
_rounding("round_divisor", {"round": {"precision": 0, "divisor": 7}}, "round(l_quantity / 7.0::double, 0) * 7.0::double", "l_quantity")


@query("select p_partkey, case when p_size > 25 then 'large' else 'small' end p_brand, p_size from part")
def sql_statement_case(spark, d):
    r = rules({"p_brand": [("sql_statement", {"statement": "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END"})]})
    return apply_rule_set(table(spark, d, "part"), r, set(), fields("p_partkey", "p_brand", "p_size"))


@query("select p_partkey, p_size * p_size p_size from part")
def udf_transform(spark, d):
    spark.udf.register("policy_square", square)
    return apply_rule_set(table(spark, d, "part"), rules({"p_size": [("sql_statement", {"statement": "policy_square(p_size)"})]}), set(), fields("p_partkey", "p_size"))


@query("select c_custkey, case when c_custkey % 2 = 0 then c_nationkey::varchar else '***' end c_nationkey from customer")
def branch_types(spark, d):
    """Branches of different types become text, for a caller of each row's own groups."""
    df = table(spark, d, "customer").withColumn("groups", F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")))
    r = rules({"c_nationkey": [(*ID, "even"), ("sql_statement", {"statement": "'***'"})]})
    return apply_rule_set(df, r, F.col("groups"), fields("c_custkey", "c_nationkey"))


# --- filters


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 150000")
def generic_filter_default(spark, d):
    return apply_rule_set(table(spark, d, "orders"), rules(filters=[generic(("true", "audit"), ("o_totalprice > 150000",))]), {"sales"}, fields("o_orderkey", "o_totalprice"))


@query("select o_orderkey, o_orderstatus from orders where o_totalprice > 50000 and o_orderstatus <> 'F'")
def filters_conjunction(spark, d):
    r = rules(filters=[generic(("o_totalprice > 50000",)), generic(("true", "audit"), ("o_orderstatus <> 'F'",))])
    return apply_rule_set(table(spark, d, "orders"), r, set(), fields("o_orderkey", "o_orderstatus"))


@query("select o_orderkey from orders where case when o_orderstatus = 'O' then null else true end")
def null_condition(spark, d):
    return apply_rule_set(table(spark, d, "orders"), rules(filters=[generic(("CASE WHEN o_orderstatus = 'O' THEN NULL ELSE TRUE END",))]), set(), fields("o_orderkey"))


@query(f"select event_id, event_type, value from events where ts + interval 30 day > timestamp '{AS_OF}'")
def retention_by_principal(spark, d):
    r = rules(filters=[retention("ts", (3, "press"), (30, "analysts"), (None, "auditors"), (0,))])
    return apply_rule_set(table(spark, d, "events"), r, {"analysts"}, fields("event_id", "event_type", "value"), as_of=AS_OF)


@query("select o_orderkey, o_totalprice from orders")
def retention_infinite(spark, d):
    r = rules(filters=[retention("o_orderdate", (None, "fraud"), (0,))])
    return apply_rule_set(table(spark, d, "orders"), r, {"fraud"}, fields("o_orderkey", "o_totalprice"), as_of=AS_OF)


@query("select count(*) n from orders where o_orderdate + interval 0 day > timestamp '1996-01-01 00:00:00'")
def retention_zero(spark, d):
    r = rules(filters=[retention("o_orderdate", (0,))])
    return apply_rule_set(table(spark, d, "orders"), r, set(), as_of="1996-01-01 00:00:00").agg(F.count("*").alias("n"))


# --- detokenize


def _detokenize(ref: str, token: str, value: str) -> dict:
    return {"token_source_ref": ref, "token_field": {"name_parts": [token]}, "value_field": {"name_parts": [value]}}


def _order_tokens(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderpriority")


def _customer_tokens(spark, d, where: str = "true") -> DataFrame:
    return table(spark, d, "customer").where(where).select(F.col("c_custkey").cast("string").alias("token"), F.col("c_name").alias("value"))


@query("select o_orderkey, coalesce(c_name, o_custkey::varchar) o_custkey, o_orderpriority from orders left join customer on o_custkey = c_custkey")
def detokenize_single(spark, d):
    r = rules({"o_custkey": [("detokenize", _detokenize("tokens", "token", "value"), "fraud"), ID]})
    return apply_rule_set(_order_tokens(spark, d), r, {"fraud"}, token_sources={"tokens": _customer_tokens(spark, d)})


@query("select l_orderkey, l_linenumber, coalesce(p_name, l_partkey::varchar) l_partkey, coalesce(s_name, l_suppkey::varchar) l_suppkey from lineitem left join part on p_partkey = l_partkey left join supplier on s_suppkey = l_suppkey")
def detokenize_two(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("l_partkey"), F.col("l_suppkey").cast("string").alias("l_suppkey"))
    sources = {
        "parts": table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("token"), F.col("p_name").alias("value")),
        "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("token"), F.col("s_name").alias("value")),
    }
    r = rules({"l_partkey": [("detokenize", _detokenize("parts", "token", "value"))], "l_suppkey": [("detokenize", _detokenize("suppliers", "token", "value"))]})
    return apply_rule_set(lines, r, set(), token_sources=sources)


@query("select o_orderkey, coalesce(c_name, o_custkey::varchar) o_custkey, o_orderpriority from orders left join (select * from customer where c_custkey % 3 <> 0) on o_custkey = c_custkey")
def detokenize_miss(spark, d):
    r = rules({"o_custkey": [("detokenize", _detokenize("tokens", "token", "value"))]})
    return apply_rule_set(_order_tokens(spark, d), r, set(), token_sources={"tokens": _customer_tokens(spark, d, "c_custkey % 3 <> 0")})


@query("select o_orderkey, o_custkey::varchar o_custkey, o_orderpriority from orders")
def detokenize_elided(spark, d):
    """With unique tokens the join is left out for a caller who does not detokenize."""
    r = rules({"o_custkey": [("detokenize", _detokenize("tokens", "token", "value"), "fraud"), ID]})
    return apply_rule_set(_order_tokens(spark, d), r, {"sales"}, token_sources={"tokens": _customer_tokens(spark, d)}, unique_tokens=True)


@query("select o_orderkey, coalesce(a.c_name, o_custkey::varchar) o_custkey, coalesce(b.c_name, o_orderkey::varchar) o_again from orders left join customer a on o_custkey = a.c_custkey left join customer b on o_orderkey = b.c_custkey")
def detokenize_shared_source(spark, d):
    """Two fields with one token source, each with values of its own."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderkey").cast("string").alias("o_again"))
    t = ("detokenize", _detokenize("tokens", "token", "value"))
    return apply_rule_set(rows, rules({"o_custkey": [t], "o_again": [t]}), set(), token_sources={"tokens": _customer_tokens(spark, d)})


@query("select o_orderkey, coalesce(c_name, o_custkey::varchar) o_custkey, o_orderpriority from orders left join (select * from customer where c_custkey % 3 <> 0) on o_custkey = c_custkey")
def detokenize_number(spark, d):
    """A number as token, whose values are text."""
    tokens = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("decimal(20,0)").alias("token"), F.col("c_name").alias("value"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return apply_rule_set(rows, rules({"o_custkey": [("detokenize", _detokenize("tokens", "token", "value"))]}), set(), token_sources={"tokens": tokens})


_ONCE_SQL = """
with t as (select c_custkey token, c_name "value" from customer where c_custkey % 4 <> 0 union all select c_custkey, 'again ' || c_custkey from customer where c_custkey % 8 = 1 union all select 1, null union all select 7, null)
select l_orderkey, l_linenumber, coalesce(a.value, (l_partkey % 500)::varchar) l_partkey, coalesce(b.value, case when l_suppkey % 3 = 0 then '7' else l_suppkey::varchar end) l_suppkey, coalesce(c.value, l_orderkey::varchar) again
from lineitem left join t a on a.token = l_partkey % 500 left join t b on b.token = case when l_suppkey % 3 = 0 then 7 else l_suppkey end left join t c on c.token = l_orderkey"""


@query(_ONCE_SQL)
def detokenize_once(spark, d):
    """Three fields of one token source that meet it in one join; one token has a third of all rows, some tokens have two values or a null one."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 500).cast("string").alias("l_partkey"), F.when(F.col("l_suppkey") % 3 == 0, "7").otherwise(F.col("l_suppkey").cast("string")).alias("l_suppkey"), F.col("l_orderkey").cast("string").alias("again"))
    c = table(spark, d, "customer")
    tokens = c.where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("token"), F.col("c_name").alias("value")).unionAll(c.where("c_custkey % 8 = 1").select("c_custkey", F.concat(F.lit("again "), F.col("c_custkey").cast("string"))))
    tokens = tokens.unionAll(spark.createDataFrame([(1, None), (7, None)], "token long, value string"))
    t = [("detokenize", _detokenize("tokens", "token", "value"))]
    return apply_rule_set(rows, rules({"l_partkey": t, "l_suppkey": t, "again": t}), set(), token_sources={"tokens": tokens})


@query("select o_orderkey, coalesce(c_name, o_custkey::varchar) who, o_orderpriority priority from orders left join customer on o_custkey = c_custkey")
def detokenize_nested(spark, d):
    """A token inside a struct, beside a column that is named like the engine's own."""
    base = _order_tokens(spark, d)
    rows = base.select("o_orderkey", F.struct(F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("priority")).alias("inner"), F.lit(1).alias("__value_0"))
    out = apply_rule_set(rows, rules({"inner.who": [("detokenize", _detokenize("tokens", "token", "value"))]}), set(), token_sources={"tokens": _customer_tokens(spark, d)})
    return out.select("o_orderkey", "inner.who", "inner.priority")


_TARGETS = {"source": {"ref": "customer"}, "rule_sets": [
    {"target": {"ref": "gold.names"}, "field_transforms": [{"field": "c_name", "transforms": [{"principals": [{"role": "clerk"}, {"permission": "names.read"}], "identity": {}}, {"nullify": {}}]}]},
    {"target": {"ref": "gold_names", "type": "SQL_TABLE"}, "filters": [{"generic_filter": {"conditions": [{"principals": [{"role": "clerk"}], "condition": "c_custkey % 2 = 0"}, {"condition": "false"}]}}]},
]}
_TARGETS_SQL = "select 'gold.names' target, c_custkey, c_name from customer union all select 'gold_names', c_custkey, c_name from customer where c_custkey % 2 = 0"


def _by_target(frames: dict[str, DataFrame]) -> DataFrame:
    parts = [f.select(F.lit(t).alias("target"), "c_custkey", "c_name") for t, f in frames.items()]
    return parts[0].unionByName(parts[1])


@query(_TARGETS_SQL)
def all_targets(spark, d):
    """Every rule set of a policy, for a caller with a role."""
    return _by_target(apply_policy(table(spark, d, "customer"), policy_from(_TARGETS), {"role:clerk"}))


@query(_TARGETS_SQL)
def target_views(spark, d):
    """The same as views whose names differ in a dot only, read back by name."""
    frames = apply_policy(table(spark, d, "customer"), policy_from(_TARGETS), {"role:clerk", "permission:names.read"})
    for name, df in frames.items():
        create_view(df, name)
    return _by_target({name: spark.table(f"`{name}`") for name in frames})


@query("select c_custkey, c_name, round(c_acctbal, 2) c_acctbal from customer where c_acctbal > 0")
def csv_result(spark, d):
    """A governed frame written as CSV and read back with its types."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(apply_rule_set(table(spark, d, "customer"), rules(filters=[generic(("c_acctbal > 0",))]), set(), fields("c_custkey", "c_name", "c_acctbal")), path)
    return read_csv(spark, path, [Field("c_custkey", "bigint"), Field("c_name", "varchar"), Field("c_acctbal", "double")]).withColumn("c_acctbal", F.round("c_acctbal", 2))


@query(" union all ".join(f"select {p!r} principal, c_custkey, {n} c_name from customer {w}" for p, n, w in (("sales", "c_name", ""), ("unmatched", "null", "where c_acctbal > 0"))))
def csv_by_principal(spark, d):
    """What each principal sees, written to a folder of its own and read back from there."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    r = rules({"c_name": [(*ID, "sales"), NULL]}, [generic(("true", "sales"), ("c_acctbal > 0",))])
    write_csv(principal_matrix(table(spark, d, "customer"), r, fields=fields("c_custkey", "c_name")), path, by_principal=True)
    parts = [read_csv(spark, f"{path}/principal={p}", [Field("c_custkey", "bigint"), Field("c_name", "varchar")]).select(F.lit(p).alias("principal"), "c_custkey", "c_name") for p in ("sales", "unmatched")]
    return parts[0].unionByName(parts[1])


@query("select c_custkey, c_name, -1::bigint c_nationkey from customer where c_acctbal > 0")
def target_tables(spark, d):
    """A target that is a table: written for fixed groups, read back by name."""
    name = f"governed_{uuid.uuid4().hex}"
    r = rules({"c_nationkey": [(*ID, "sales"), ("fixed", {"value": "-1"})]}, [generic(("true", "sales"), ("c_acctbal > 0",))])
    publish(spark, Policy(_file(d, "customer"), tuple(fields("c_custkey", "c_name", "c_nationkey")), (replace(r, target=f"default.{name}", target_type="SQL_TABLE"),)), {"support"})
    return spark.table(f"default.{name}")


# --- aggregation transforms


def _agg(name: str, tbl: str, names: tuple[str, ...], field: str, settings: dict, sql: str, filters: list | None = None, out=None) -> None:
    def run(spark, d):
        df = apply_rule_set(table(spark, d, tbl), rules({field: [("aggregation", settings)]}, filters), {"finance"}, fields(*names))
        return df if out is None else df.withColumn(field, out(F.col(field)))

    run.__name__ = name
    query(sql)(run)


_two = lambda c: F.round(c, 2)
_agg("agg_sum_total", "customer", ("c_custkey", "c_acctbal"), "c_acctbal", {"sum": {}}, "select c_custkey, round((select sum(c_acctbal) from customer), 2) c_acctbal from customer", out=_two)
_agg("agg_sum_by", "lineitem", ("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", {"sum": {}, "partition_by": [{"name_parts": ["l_returnflag"]}]}, "select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_returnflag) l_quantity from lineitem")
_agg("agg_avg_precision", "customer", ("c_custkey", "c_acctbal"), "c_acctbal", {"avg": {"precision": 0}, "partition_by": [{"name_parts": ["c_nationkey"]}]}, "select c_custkey, round(avg(c_acctbal) over (partition by c_nationkey), 0) c_acctbal from customer")
_agg("agg_avg_cast", "part", ("p_partkey", "p_retailprice"), "p_retailprice", {"avg": {"cast_to": "int4", "precision": 3}, "partition_by": ["p_brand"]}, "select p_partkey, round(avg(trunc(p_retailprice)) over (partition by p_brand), 3) p_retailprice from part")
_agg("agg_min_by", "customer", ("c_custkey", "c_acctbal"), "c_acctbal", {"min": {}, "partition_by": ["c_mktsegment", "c_nationkey"]}, "select c_custkey, min(c_acctbal) over (partition by c_mktsegment, c_nationkey) c_acctbal from customer")
_agg("agg_max_by", "customer", ("c_custkey", "c_acctbal"), "c_acctbal", {"max": {}, "partition_by": ["c_mktsegment"]}, "select c_custkey, max(c_acctbal) over (partition by c_mktsegment) c_acctbal from customer")
_agg("agg_after_filter", "orders", ("o_orderkey", "o_totalprice"), "o_totalprice", {"avg": {"precision": 1}, "partition_by": ["o_orderpriority"]}, "select o_orderkey, round(avg(o_totalprice) over (partition by o_orderpriority), 1) o_totalprice from orders where o_orderstatus = 'O'", [generic(("true", "audit"), ("o_orderstatus = 'O'",))])


_SHARED = {"l_quantity": {"sum": {}, "partition_by": ["l_returnflag"]}, "l_extendedprice": {"max": {}, "partition_by": ["l_returnflag"]}, "l_discount": {"avg": {"precision": 6}, "partition_by": ["l_returnflag"]}, "l_tax": {"min": {}, "partition_by": ["l_returnflag"]}, "l_partkey": {"max": {}, "partition_by": ["l_returnflag"]}, "l_suppkey": {"min": {}, "partition_by": ["l_returnflag"]}}
_SHARED_FIELDS = ("l_orderkey", "l_linenumber", *_SHARED)


@query("select l_orderkey, l_linenumber, sum(l_quantity) over w l_quantity, max(l_extendedprice) over w l_extendedprice, round(avg(l_discount) over w, 6) l_discount, min(l_tax) over w l_tax, max(l_partkey) over w l_partkey, min(l_suppkey) over w l_suppkey from lineitem window w as (partition by l_returnflag)")
def agg_shared(spark, d):
    """Six aggregates over the same groups: one grouping."""
    return apply_rule_set(table(spark, d, "lineitem"), rules({k: [("aggregation", v)] for k, v in _SHARED.items()}), set(), fields(*_SHARED_FIELDS))


@query("select l_orderkey, l_linenumber, sum(l_quantity) over (partition by l_returnflag) l_quantity, max(l_extendedprice) over () l_extendedprice, round(avg(l_discount) over (partition by l_linestatus, l_returnflag), 6) l_discount, min(l_tax) over (partition by n) l_tax, max(l_partkey) over () l_partkey, min(l_suppkey) over (partition by l_shipdate) l_suppkey from (select *, nullif(l_linenumber, 3) n from lineitem where l_quantity > 5)")
def agg_shared_sets(spark, d):
    """Six aggregates over five sets of groups, one of them all rows and one with a null group: one grouping."""
    by = {"l_quantity": ["l_returnflag"], "l_extendedprice": [], "l_discount": ["l_linestatus", "l_returnflag"], "l_tax": ["n"], "l_partkey": [], "l_suppkey": ["l_shipdate"]}
    r = rules({k: [("aggregation", v | {"partition_by": by[k]})] for k, v in _SHARED.items()}, [generic(("l_quantity > 5",))])
    return apply_rule_set(table(spark, d, "lineitem").withColumn("n", F.expr("nullif(l_linenumber, 3)")), r, set(), fields(*_SHARED_FIELDS))


# --- members


def _members(spark, d) -> DataFrame:
    """user_groups(user, group): a customer is in the group of its segment, and in that of its nation."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("group")).unionByName(c.select(F.col("c_name").alias("user"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("group")))


@query("select distinct c_mktsegment \"group\" from customer union select distinct 'nation-' || c_nationkey from customer")
def membership_groups(spark, d):
    return distinct_groups(_members(spark, d))


@query("select c_name principal, list_aggregate(list_sort([c_mktsegment, 'nation-' || c_nationkey]), 'string_agg', ',') \"groups\" from customer")
def membership_join(spark, d):
    return groups_by_user(_members(spark, d)).withColumn("groups", F.array_join("groups", ","))


_MATRIX = rules({"c_name": [(*ID, "sales"), ("regexp", {"regexp": "#.*$", "replacement": "#***"}, "marketing"), ("fixed", {"value": "****"})], "c_acctbal": [("aggregation", {"avg": {"precision": 1}, "partition_by": ["c_nationkey"]}, "sales"), NULL]}, [generic(("true", "sales"), ("c_acctbal > 0", "marketing"), ("c_acctbal > 5000",))])
_MATRIX_SQL = {
    "sales": "select 'sales' principal, c_custkey, c_name, round(avg(c_acctbal) over (partition by c_nationkey), 1) c_acctbal from customer",
    "marketing": "select 'marketing', c_custkey, regexp_replace(c_name, '#.*$', '#***'), null from customer where c_acctbal > 0",
    "unmatched": "select 'unmatched', c_custkey, '****', null from customer where c_acctbal > 5000",
}


@query(" union all ".join(_MATRIX_SQL.values()))
def principal_matrix_all(spark, d):
    return principal_matrix(table(spark, d, "customer"), _MATRIX, fields=fields("c_custkey", "c_name", "c_acctbal"))


@query(" union all ".join(_MATRIX_SQL[k] for k in ("sales", "unmatched")))
def selected_principals(spark, d):
    df = table(spark, d, "customer")
    return principal_matrix(df, _MATRIX, F.broadcast(principals_frame(df, _MATRIX, ["sales", "unmatched"])), fields=fields("c_custkey", "c_name", "c_acctbal"))


@query("select viewer, c_custkey, principal, c_acctbal from (" + " union all ".join(f"select '{v}' viewer, c_custkey, {n} principal, {a} c_acctbal from customer {w}" for v, n, a, w in (("sales", "c_name", "c_acctbal", ""), ("marketing", "regexp_replace(c_name, '#.*$', '#***')", "null", "where c_acctbal > 0"), ("unmatched", "'****'", "null", "where c_acctbal > 5000"))) + ")")
def matrix_named_principal(spark, d):
    """A source that has a column ``principal``, and columns named like the engine's own."""
    df = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("principal"), "c_acctbal", *(F.lit(1).alias(c) for c in ("groups", "__groups", "__groups_0", "__class_0", "__by_0")))
    r = rules({"principal": [(*ID, "sales"), ("regexp", {"regexp": "#.*$", "replacement": "#***"}, "marketing"), ("fixed", {"value": "****"})], "c_acctbal": [(*ID, "sales"), NULL]}, [generic(("true", "sales"), ("c_acctbal > 0", "marketing"), ("c_acctbal > 5000",))])
    return principal_matrix(df, r, principal_col="viewer", fields=fields("c_custkey", "principal", "c_acctbal"))


@query("""
with u as (select c_name principal, c_mktsegment s, c_nationkey n from customer)
select principal, n_nationkey, case when s in ('BUILDING', 'MACHINERY') or n in (1, 2) then n_name when s = 'FURNITURE' then left(n_name, 1) end n_name, case when n = 3 then n_regionkey when s in ('BUILDING', 'HOUSEHOLD') then round(avg(n_regionkey) over (partition by principal), 3) else -1 end n_regionkey
from nation, u where s = 'BUILDING' or (n_nationkey < 9 and s <> 'HOUSEHOLD') or (s = 'HOUSEHOLD' and n_nationkey > 20)""")
def user_classes(spark, d):
    """Many users in few classes: the rule set is applied once for each set of deciding entries, then joined with its users."""
    r = rules(
        {
            "n_name": [(*ID, "BUILDING", "MACHINERY", "nation-1", "nation-2"), ("sql_statement", {"statement": "left(n_name, 1)"}, "FURNITURE"), NULL],
            "n_regionkey": [(*ID, "nation-3"), ("aggregation", {"avg": {"precision": 3}}, "BUILDING", "HOUSEHOLD"), ("fixed", {"value": "-1"})],
        },
        [generic(("true", "BUILDING"), ("n_nationkey > 20", "HOUSEHOLD"), ("n_nationkey < 9",))],
    )
    return principal_matrix(table(spark, d, "nation"), r, groups_by_user(_members(spark, d)), fields=fields("n_nationkey", "n_name", "n_regionkey"))


@query("""
with u as (select c_name principal, [c_mktsegment, 'nation-' || c_nationkey] g from customer)
select principal, n_nationkey, case when list_contains(g, 'nation-' || n_nationkey) then n_name when list_contains(g, 'BUILDING') then upper(left(n_name, 1)) else '-' end n_name
from nation, u where list_contains(g, 'BUILDING') or n_nationkey < 20""")
def user_fanout(spark, d):
    """Each user in several groups: the first entry that names one of them decides."""
    who = groups_by_user(_members(spark, d))
    nations = table(spark, d, "nation")
    first = [("sql_statement", {"statement": f"CASE WHEN n_nationkey = {n} THEN n_name WHEN array_contains(__groups, 'BUILDING') THEN upper(left(n_name, 1)) ELSE '-' END"}, f"nation-{n}") for n in range(25)]
    r = rules({"n_name": [*first, ("sql_statement", {"statement": "'-'"})]}, [generic(("true", "BUILDING"), ("n_nationkey < 20",))])
    return principal_matrix(nations, r, who, groups_col="__groups", fields=fields("n_nationkey", "n_name"))


@query("""
select o_orderkey, case when exists (select 1 from customer where c_name = (select min(c_name) from customer) and c_mktsegment = 'BUILDING') then o_orderpriority else '-' end o_orderpriority from orders""")
def dynamic_groups(spark, d):
    """One frame that reads its user's groups when it runs."""
    first = table(spark, d, "customer").agg(F.min("c_name").alias("who"))
    own = _members(spark, d).join(F.broadcast(first), F.col("user") == F.col("who"), "left_semi").withColumn("user", F.lit("me"))
    r = rules({"o_orderpriority": [(*ID, "BUILDING"), ("fixed", {"value": "-"})]})
    return dynamic(table(spark, d, "orders"), r, own, "me", fields=fields("o_orderkey", "o_orderpriority"))


# --- statements


def _file(d: str, name: str) -> str:
    """A file as a relation that a lasting view may name."""
    return f"parquet.`{d}/{name}.parquet`"


_GOVERNED = rules(
    {
        "c_name": [("detokenize", _detokenize("segments", "token", "value"), "nation-3", "BUILDING"), ("regexp", {"regexp": "^(.*)#.*$", "replacement": "$1#'*"})],
        "c_acctbal": [(*ID, "auditors"), ("aggregation", {"avg": {"precision": 1}, "partition_by": ["c_nationkey"]}, "BUILDING", "nation-7"), NULL],
        "c_nationkey": [("numeric_rounding", {"floor": {"divisor": 5}}, "BUILDING"), ("fixed", {"value": "-1"})],
        "c_mktsegment": [("hash", {"seed": "it's"})],
    },
    [generic(("true", "auditors"), ("c_acctbal > 0", "BUILDING", "nation-7"), ("c_acctbal > 5000",))],
)


@query("""
with g as (select [c_mktsegment, 'nation-' || c_nationkey] g from customer where c_name = (select max(c_name) from customer where c_mktsegment = 'BUILDING')),
v as (select c.*, list_contains(g, 'BUILDING') or list_contains(g, 'nation-7') b, list_contains(g, 'BUILDING') o, list_contains(g, 'BUILDING') or list_contains(g, 'nation-3') t from customer c, g)
select c_custkey, case when t then coalesce('segment of ' || o_orderkey, c_name) else regexp_replace(c_name, '^(.*)#.*$', '\\1#''*') end c_name,
  case when o then floor(c_nationkey / 5.0::double) * 5.0::double else -1.0 end c_nationkey, case when b then round(avg(c_acctbal) over (partition by c_nationkey), 1) end c_acctbal, sha256('it''s:' || c_mktsegment) c_mktsegment
from v left join (select o_custkey, min(o_orderkey) o_orderkey from orders where o_orderkey % 5 = 0 group by 1) on c_name = 'Customer#' || lpad(o_custkey::varchar, 9, '0')
where case when b then c_acctbal > 0 else c_acctbal > 5000 end""")
def lasting_view(spark, d):
    """A catalog view whose text asks for the groups of whoever reads it, read back by another session."""
    name = f"governed_{uuid.uuid4().hex}"
    policy = Policy(_file(d, "customer"), tuple(fields("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")), (replace(_GOVERNED, target=f"default.{name}"),))
    mine = f"(SELECT session_user() AS user, g AS group FROM {_file(d, 'customer')} LATERAL VIEW explode(array(c_mktsegment, concat('nation-', c_nationkey))) AS g WHERE c_name = (SELECT max(c_name) FROM {_file(d, 'customer')} WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'nobody', 'auditors')"
    tokens = f"(SELECT concat('Customer#', lpad(o_custkey, 9, '0')) AS token, concat('segment of ', min(o_orderkey)) AS value FROM {_file(d, 'orders')} WHERE o_orderkey % 5 = 0 GROUP BY o_custkey)"
    publish(spark, policy, Members(mine), token_sources={"segments": tokens})
    return spark.newSession().table(f"default.{name}")


@query("select c_custkey, upper(c_name) c_name, 40 + 2 c_nationkey from customer where c_acctbal > 0")
def statement_model_target(spark, d):
    """The statement of a model's target: fixed values stand as they are written, the groups are decided."""
    r = rules({"c_name": [(*NULL, "sales"), ("fixed", {"value": "upper(c_name)"})], "c_nationkey": [("fixed", {"value": "40 + 2"})]}, [generic(("false", "sales"), ("c_acctbal > 0",))])
    text = statement(table(spark, d, "customer"), replace(r, target_type="DBT_SQL"), _file(d, "customer"), {"support"}, fields("c_custkey", "c_name", "c_nationkey"))
    return spark.sql(text)


# --- sources


@query("select doc_id, quality, toxic::boolean toxic from labels")
def csv_typed_scan(spark, d):
    """Labels written as CSV in another column order, read back by name and type."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "labels").select("toxic", F.lit("x").alias("unused"), "quality", "doc_id").write.option("header", True).csv(path)
    return read_csv(spark, path, [Field("doc_id", "bigint"), Field("QUALITY", "int4"), Field("toxic", "boolean")]).withColumnRenamed("QUALITY", "quality")


@query("select o_orderkey, o_orderstatus status, o_totalprice total from orders")
def policy_rows_json(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.lit(1).alias("unknown"))).alias("policy"))
    return read_policies(rows, "status string, total double").select("o_orderkey", "parsed.*")


# --- tags


def _fields(spark, d) -> DataFrame:
    """fields(table, field, tags): each customer as a table with one field, tagged by its segment and nation."""
    return table(spark, d, "customer").select(F.concat(F.lit("t"), F.col("c_nationkey").cast("string")).alias("table"), F.col("c_name").alias("field"), F.array(F.concat(F.lit("Seg "), F.lower("c_mktsegment")), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string"))).alias("tags"))


def _transforms(spark, d) -> DataFrame:
    """Global transforms: for each segment two entries and a default, for each nation an overlapping entry and a default."""
    seg = table(spark, d, "customer").select("c_mktsegment").distinct()
    nation = table(spark, d, "nation")
    parts = [
        seg.select(F.concat(F.lit("SEG_"), F.col("c_mktsegment")).alias("tag"), F.lit(0).alias("ord"), F.array(F.lit("admin"), F.lit("fraud")).alias("groups"), F.lit("identity").alias("transform")),
        seg.select(F.concat(F.lit("SEG_"), F.col("c_mktsegment")), F.lit(1), F.array().cast("array<string>"), F.concat(F.lit("mask "), F.col("c_mktsegment"))),
        nation.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.lit(0), F.array(F.lit("fraud"), F.lit("sales")), F.lit("hash")),
        nation.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.lit(1), F.array(F.lit("fraud")), F.lit("round")),
        nation.select(F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")), F.lit(2), F.array().cast("array<string>"), F.lit("nullify")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_TAGS_SQL = """
with f as (select 't' || c_nationkey t, c_name field, unnest(['Seg ' || lower(c_mktsegment), 'nation-' || c_nationkey]) tag, unnest([0, 1]) pos from customer),
g as (select distinct 'SEG_' || c_mktsegment tag, 0 ord, ['admin', 'fraud'] gs, 'identity' tr from customer
  union all select distinct 'SEG_' || c_mktsegment, 1, []::varchar[], 'mask ' || c_mktsegment from customer
  union all select 'nation ' || n_nationkey, 0, ['fraud', 'sales'], 'hash' from nation
  union all select 'nation ' || n_nationkey, 1, ['fraud'], 'round' from nation
  union all select 'nation ' || n_nationkey, 2, []::varchar[], 'nullify' from nation)"""


@query(_TAGS_SQL + " select t \"table\", field, pos tag_pos, ord, array_to_string(gs, ',') \"groups\", tr \"transform\" from f join g on lower(translate(f.tag, ' -', '__')) = lower(translate(g.tag, ' -', '__'))")
def tag_match_loose(spark, d):
    return tags.tag_transforms(_fields(spark, d), _transforms(spark, d)).withColumn("groups", F.array_join("groups", ","))


@query("select c_custkey, n_name from customer join nation on c_name = n_name union all select c_custkey, c_mktsegment from customer")
def tag_match_strict(spark, d):
    """Strictly, only the same spelling matches: customers tagged by segment against segments in both cases."""
    c = table(spark, d, "customer")
    f = c.select(F.col("c_custkey").cast("string").alias("table"), F.lit("f").alias("field"), F.array("c_mktsegment").alias("tags"))
    seg = c.select("c_mktsegment").distinct()
    g = seg.select(F.col("c_mktsegment").alias("tag"), F.lit(0).alias("ord"), F.array().cast("array<string>").alias("groups"), F.col("c_mktsegment").alias("transform")).union(seg.select(F.lower("c_mktsegment"), F.lit(0), F.array().cast("array<string>"), F.lit("lower")))
    return tags.tag_transforms(f, g, strict=True).select(F.col("table").cast("long").alias("c_custkey"), F.col("transform").alias("n_name"))


_COMBINED_SQL = _TAGS_SQL + """,
m as (select t, field, pos, ord, gs, tr from f join g on lower(translate(f.tag, ' -', '__')) = lower(translate(g.tag, ' -', '__'))),
e as (select *, unnest(gs) grp from m), r as (select *, row_number() over (partition by t, field, grp order by pos, ord) k from e),
a as (select t, field, pos, ord, string_agg(grp, ',' order by grp) gs, any_value(tr) tr, 0 z from r where k = 1 group by t, field, pos, ord),
b as (select t, field, pos, ord, '' gs, tr, 1 z from (select *, row_number() over (partition by t, field order by pos, ord) k from m where len(gs) = 0) where k = 1),
c as (select t, field, row_number() over (partition by t, field order by z, pos, ord) ord, gs, tr from (select * from a union all select * from b))"""


@query(_COMBINED_SQL + " select t \"table\", field, ord, gs \"groups\", tr \"transform\" from c")
def combine_transforms(spark, d):
    return tags.combine(tags.tag_transforms(_fields(spark, d), _transforms(spark, d))).withColumn("groups", F.array_join("groups", ","))


@query(_COMBINED_SQL + " select t \"table\", t || '_view' target, field, string_agg(ord || ':' || gs || ':' || tr, ';' order by ord) transforms from c group by t, field")
def ruleset_from_tags(spark, d):
    made = tags.rule_sets_from_tags(_fields(spark, d), _transforms(spark, d))
    return made.withColumn("transforms", F.array_join(F.transform("transforms", lambda x: F.concat_ws(":", x["ord"].cast("string"), F.array_join(x["groups"], ","), x["transform"])), ";"))


@query("""select c_custkey, array_to_string(list_transform(regexp_extract_all('a policy::' || c_mktsegment || ' b policy::"' || c_name || '" policy:no', 'policy::("[^"]+"|[A-Za-z0-9_-]+)', 1), lambda x: trim(x, '"')), '|') tags from customer""")
def comment_tags(spark, d):
    comment = F.concat(F.lit("a policy::"), "c_mktsegment", F.lit(' b policy::"'), "c_name", F.lit('" policy:no'))
    return table(spark, d, "customer").select("c_custkey", F.array_join(tags.comment_tags(comment), "|").alias("tags"))


@query("select page_id, 'page/' || split_part(url, '/', 3) path from pages")
def field_path(spark, d):
    path = F.concat(F.lit("[version=2.0].[type=struct].page.[type=string]."), F.translate(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), ".", "\x01"))
    return table(spark, d, "pages").select("page_id", F.translate(F.array_join(tags.field_path(path), "/"), "\x01", ".").alias("path"))


@query("select c_custkey id, r_name || '.' || n_name || '.' || c_name path from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey")
def nested_parents(spark, d):
    """Regions hold nations hold customers, as nested fields."""
    region = table(spark, d, "region").select((F.col("r_regionkey") - 1000).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, d, "nation").select((F.col("n_nationkey") - 500).cast("long"), (F.col("n_regionkey") - 1000).cast("long"), "n_name")
    customer = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") - 500).cast("long"), "c_name")
    return tags.parent_paths(region.union(nation).union(customer)).where("id >= 0").select("id", F.array_join("path", ".").alias("path"))


@query("select c_mktsegment \"column\", string_agg(n, ',' order by n) tags from (select distinct c_mktsegment, 'n' || c_nationkey n from customer) group by 1")
def tags_per_column(spark, d):
    c = table(spark, d, "customer")
    pairs = c.select(F.col("c_mktsegment").alias("column"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("tag")).distinct()
    return tags.attach_tags(c.select(F.col("c_mktsegment").alias("column")).distinct(), pairs).withColumn("tags", F.array_join("tags", ","))


@query("select coalesce(a.r, b.r) \"ref\", coalesce(b.body, a.body) body from (select 'Seg-' || c_custkey r, 'old' body, 'seg_' || c_custkey k from customer where c_custkey % 2 = 0) a full join (select 'seg ' || c_custkey r, c_name body, 'seg_' || c_custkey k from customer where c_custkey % 3 = 0) b on a.k = b.k")
def transform_upsert(spark, d):
    c = table(spark, d, "customer")
    key = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("ref")
    return tags.upsert_transforms(c.where("c_custkey % 2 = 0").select(key("Seg-"), F.lit("old").alias("body")), c.where("c_custkey % 3 = 0").select(key("seg "), F.col("c_name").alias("body")))


@query("select 'Seg-' || c_custkey \"ref\", c_name body from customer where c_custkey % 3 <> 0")
def transform_delete(spark, d):
    c = table(spark, d, "customer")
    return tags.delete_transforms(c.select(F.concat(F.lit("Seg-"), F.col("c_custkey").cast("string")).alias("ref"), F.col("c_name").alias("body")), c.where("c_custkey % 3 = 0").select(F.concat(F.lit("SEG "), F.col("c_custkey").cast("string")).alias("ref")))


@query("select count(*) deleted from customer where c_custkey % 3 = 0")
def transform_number_deleted(spark, d):
    """How many go, each ref given twice in two spellings."""
    c = table(spark, d, "customer")
    ref = lambda p: F.concat(F.lit(p), F.col("c_custkey").cast("string")).alias("ref")
    return tags.number_deleted(c.select(ref("Seg-"), "c_name"), c.where("c_custkey % 3 = 0").select(ref("SEG ")).unionAll(c.where("c_custkey % 3 = 0").select(ref("seg_"))))


@query("select 'Seg-' || c_custkey \"ref\", c_mktsegment \"type\" from customer where c_mktsegment = 'BUILDING'")
def transform_list(spark, d):
    """Stored transforms of one type."""
    stored = table(spark, d, "customer").select(F.concat(F.lit("Seg-"), F.col("c_custkey").cast("string")).alias("ref"), F.col("c_mktsegment").alias("type"))
    return tags.transforms_of(stored, "BUILDING")


_CHANGED_SQL = _COMBINED_SQL.replace("unnest(['Seg ' || lower(c_mktsegment), 'nation-' || c_nationkey]) tag", "unnest([case when c_custkey % 50 = 3 then 'seg-building' else 'Seg ' || lower(c_mktsegment) end, 'nation-' || c_nationkey]) tag").replace("from customer),\ng as", "from customer where c_custkey % 50 <> 4),\ng as").replace("select 'nation ' || n_nationkey, 1, ['fraud'], 'round' from nation", "select 'nation ' || n_nationkey, 1, ['fraud'], 'round' from nation where n_nationkey <> 7").replace("select 'nation ' || n_nationkey, 2, []::varchar[], 'nullify' from nation", "select 'nation ' || n_nationkey, 2, []::varchar[], case when n_nationkey = 9 then 'fixed' else 'nullify' end from nation")


@query(_CHANGED_SQL + " select t \"table\", t || '_view' target, field, string_agg(ord || ':' || gs || ':' || tr, ';' order by ord) transforms from c group by t, field")
def rule_sets_refreshed(spark, d):
    """Some fields get another tag, some go, a transform goes, one changes: only what these touch is made anew."""
    fields, transforms = _fields(spark, d), _transforms(spark, d)
    key = F.regexp_extract("field", "#0*(\\d+)$", 1).cast("int") % 50
    now = fields.where(key != 4).withColumn("tags", F.when(key == 3, F.array(F.lit("seg-building"), F.get("tags", F.lit(1)))).otherwise(F.col("tags")))
    after = transforms.where("not (tag = 'nation 7' and ord = 1)").withColumn("transform", F.when((F.col("tag") == "nation 9") & (F.col("ord") == 2), "fixed").otherwise(F.col("transform")))
    touched = tags.touched_fields(now, transforms, after, fields.where(key.isin(3, 4)))
    made = tags.refreshed_rule_sets(tags.rule_sets_from_tags(fields, transforms), now, after, touched)
    return made.withColumn("transforms", F.array_join(F.transform("transforms", lambda x: F.concat_ws(":", x["ord"].cast("string"), F.array_join(x["groups"], ","), x["transform"])), ";"))


@query("select c_nationkey, min(c_custkey) c_custkey from customer group by 1")
def first_match(spark, d):
    return tags.first_match(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("""
with t(field, type, n) as (select 'event_id', 'bigint', count(event_id) from events union all select 'ts', 'timestamp', count(ts) from events union all select 'user_id', 'bigint', count(user_id) from events
union all select 'event_type', 'string', count(event_type) from events union all select 'value', 'double', count("value") from events union all select 'props', 'string', count(props) from events)
select 'events' "table", t.field, column_index - 1 ord, t.type, t.n from t join duckdb_columns() c on c.table_name = 'events' and c.column_name = t.field""")
def blueprint_fields(spark, d):
    """Every field of the events table with its place and type, and how many of its values are there."""
    e = table(spark, d, "events")
    there = e.select(*(F.count(c).alias(c) for c in e.columns))
    there = there.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in e.columns))).alias("x")).select("x.*")
    kind = F.regexp_replace("type", "_ntz$", "").alias("type")
    return tags.blueprint(e, "events").join(there, "field").select("table", "field", F.col("ord").cast("long").alias("ord"), kind, "n")


_LAKE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("""
with c as (select table_name t, column_name f, column_index o, data_type k from duckdb_columns() where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations'))
select 'lake.' || t "table", t title, f field, (o - min(o) over (partition by t))::bigint ord,
  case when k like '%[]' then 'array<' || lower(replace(k, '[]', '')) || '>' else coalesce(map(['VARCHAR', 'INTEGER', 'TIMESTAMP'], ['string', 'int', 'timestamp'])[k], lower(k)) end "type", false required, '' "comment",
  case when t = 'customer' and f = 'c_mktsegment' then (select string_agg(distinct c_mktsegment, ',' order by c_mktsegment) from customer) else '' end tags, false conflict from c""")
def lake_blueprints(spark, d):
    """Every field of every given table, from the footers of its files, with tags from a table of tags."""
    files = files_of(spark, {f"lake.{t}": f"{d}/{t}.parquet" for t in _LAKE})
    more = table(spark, d, "customer").select(F.lit("lake.customer").alias("table"), F.lit("C_MKTSEGMENT").alias("field"), F.col("c_mktsegment").alias("tag"))
    made = blueprints(files, more)
    return made.select("table", "title", "field", F.col("ord").cast("long").alias("ord"), F.regexp_replace("type", "timestamp_ntz", "timestamp").alias("type"), "required", F.coalesce("comment", F.lit("")).alias("comment"), F.array_join("tags", ",").alias("tags"), "conflict")


# --- registry: orders as a log of policy versions (policy = customer, platform = priority)


def _history(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    w = Window.partitionBy("id", "platform").orderBy("o_orderkey")
    base = o.select(F.col("o_custkey").cast("string").alias("id"), F.substring("o_orderpriority", 1, 1).alias("platform"), "o_orderkey", F.col("o_orderstatus").alias("policy"))
    v = base.withColumn("version", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("id", "platform")))
    return v.select("id", "platform", "version", (F.col("version") == F.col("n")).alias("active"), F.lit(10).cast("long").alias("created_at"), F.lit(10).cast("long").alias("updated_at"), "policy")


_HISTORY_SQL = """with h as (select o_custkey::varchar id, left(o_orderpriority, 1) platform, row_number() over (partition by o_custkey, left(o_orderpriority, 1) order by o_orderkey) version,
count(*) over (partition by o_custkey, left(o_orderpriority, 1)) n, o_orderstatus policy from orders)"""


@query(_HISTORY_SQL + " select id, platform, version, policy from h where version = n")
def policy_latest(spark, d):
    return registry.latest(_history(spark, d)).select("id", "platform", F.col("version").cast("long").alias("version"), "policy")


@query(_HISTORY_SQL + """, i as (select c_custkey::varchar id, '1' platform, c_name policy from customer where c_custkey % 5 = 0),
l as (select id, platform, max(version) v from h group by 1, 2)
select id, platform, version, version = n and (id, platform) not in (select (id, platform) from i) active, 10::bigint created_at, policy from h
union all select i.id, i.platform, coalesce(v, 0) + 1, true, case when v is null then 20 else 10 end, i.policy from i left join l using (id, platform)""")
def policy_upsert(spark, d):
    new = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("id"), F.lit("1").alias("platform"), F.col("c_name").alias("policy"))
    return registry.upsert(_history(spark, d), new, F.lit(20).cast("long")).select("id", "platform", F.col("version").cast("long").alias("version"), "active", "created_at", "policy")


@query(_HISTORY_SQL + ", l as (select id, platform, max(version) v from h group by 1, 2) select id, platform, 1::bigint version, v::bigint stored from l where v <> 1")
def policy_stale(spark, d):
    given = _history(spark, d).select("id", "platform").distinct().withColumn("version", F.lit(1))
    return registry.stale(_history(spark, d), given).select("id", "platform", F.col("version").cast("long").alias("version"), F.col("stored").cast("long").alias("stored"))


_WRITERS_SQL = _HISTORY_SQL + """, l as (select id, platform, max(version) v from h group by 1, 2),
i as (select c_custkey::varchar id, '1' platform, 1 + w version, 'w' || (c_custkey + w) % 3 writer, c_name || w policy from customer, range(3) r(w) where c_custkey % 2 = 0
  union all select c_custkey::varchar, '1', coalesce(v, 7), 'late', 'x' from customer left join l on l.id = c_custkey::varchar and l.platform = '1' where c_custkey % 4 = 0),
j as (select i.*, v stored, v is null or version = v fits from i left join l using (id, platform)),
o as (select *, case when not fits then 'stale' when row_number() over (partition by id, platform, fits order by writer, policy) = 1 then 'set' else 'lost' end outcome from j)"""


def _writers(spark, d) -> DataFrame:
    """Up to four writers of a policy, who start from different versions."""
    c = table(spark, d, "customer").where("c_custkey % 2 = 0").crossJoin(spark.range(3).select(F.col("id").alias("w")))
    key = F.col("c_custkey").cast("string").alias("id")
    some = c.select(key, F.lit("1").alias("platform"), (F.col("w") + 1).cast("int").alias("version"), F.concat(F.lit("w"), ((F.col("c_custkey") + F.col("w")) % 3).cast("string")).alias("writer"), F.concat("c_name", F.col("w").cast("string")).alias("policy"))
    late = table(spark, d, "customer").where("c_custkey % 4 = 0").select(key).join(registry.latest_version(_history(spark, d)).where("platform = '1'"), "id", "left")
    return some.unionByName(late.select("id", F.lit("1").alias("platform"), F.coalesce("version", F.lit(7)).alias("version"), F.lit("late").alias("writer"), F.lit("x").alias("policy")))


@query(_WRITERS_SQL + " select id, platform, version::bigint version, writer, coalesce(stored, 0)::bigint stored, outcome from o where outcome <> 'set'")
def policy_refused(spark, d):
    """Writers that start from a version that is not the stored one, or come second."""
    refused = registry.compare_and_set(_history(spark, d), _writers(spark, d), F.lit(20).cast("long"))[1]
    return refused.withColumns({"version": F.col("version").cast("long"), "stored": F.coalesce("stored", F.lit(0)).cast("long")})


@query(_WRITERS_SQL + """, s as (select * from o where outcome = 'set') select id, platform, version, version = n and (id, platform) not in (select (id, platform) from s) active, policy from h
union all select id, platform, coalesce(stored, 0) + 1, true, policy from s""")
def policy_compare_and_set(spark, d):
    """History after the same batch: one more version for each policy that a writer was first for."""
    after = registry.compare_and_set(_history(spark, d), _writers(spark, d), F.lit(20).cast("long"))[0]
    return after.select("id", "platform", F.col("version").cast("long").alias("version"), "active", "policy")


@query(_HISTORY_SQL + " select id, platform, version from h where version = n order by id, platform, version limit 25 offset 10")
def policy_page(spark, d):
    return registry.active_page(_history(spark, d), 10, 25).select("id", "platform", F.col("version").cast("long").alias("version"))


@query("select distinct c_mktsegment \"group\" from customer where c_mktsegment not in (select c_mktsegment from customer where c_custkey = 1) order by 1 limit 10")
def group_page(spark, d):
    c = table(spark, d, "customer")
    groups = c.select(F.col("c_mktsegment").alias("group")).union(c.select(F.concat(F.lit("pg_"), "c_mktsegment"))).distinct()
    return registry.group_page(groups, c.where("c_custkey = 1").select(F.col("c_mktsegment").alias("group")))


# --- checks: orders as policies, lines as their entries


def _entries(spark, d) -> DataFrame:
    """entries(policy, rule_set, field, ord, kind, principals, value): a line is an entry of the field named by its flag."""
    li = table(spark, d, "lineitem")
    who = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("l_returnflag"), F.concat(F.lit("G"), (F.col("l_quantity") % 4).cast("int").cast("string"))))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "fixed").otherwise("identity")
    value = F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int").cast("string")).otherwise(F.concat(F.lit("q"), F.col("l_quantity").cast("int").cast("string")))
    return li.select(F.col("l_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.concat(F.lit("F_"), "l_returnflag").alias("field"), F.col("l_linenumber").alias("ord"), kind.alias("kind"), who.alias("principals"), value.alias("value"))


_ENTRIES_SQL = """with e as (select l_orderkey policy, 'F_' || l_returnflag field, l_linenumber ord, case when l_linenumber % 2 = 0 then 'fixed' else 'identity' end kind,
case when l_linenumber % 3 = 0 then []::varchar[] else [lower(l_returnflag), 'G' || (l_quantity % 4)::int] end principals,
case when l_quantity > 25 then (l_quantity::int)::varchar else 'q' || (l_quantity::int)::varchar end value from lineitem)"""


def _policies(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("policy"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderstatus")).alias("source_ref"), F.when(F.col("o_orderkey") % 5 > 0, "spark").otherwise("").alias("platform"), F.substring("o_orderpriority", 3, 30).alias("title"), F.when(F.col("o_orderstatus") == "F", "DBT_SQL").otherwise("SQL_VIEW").alias("target_type"))


@query("select o_orderkey policy, 'source_empty' rule, '' detail from orders where o_orderkey % 7 = 0")
def check_source_empty(spark, d):
    return checks.source_empty(_policies(spark, d))


@query("select o_orderkey policy, 'platform_empty' rule, '' detail from orders where o_orderkey % 5 = 0 and o_orderstatus <> 'F'")
def check_platform_empty(spark, d):
    return checks.platform_empty(_policies(spark, d))


@query("select o_orderkey policy, 'title_short' rule, substr(o_orderpriority, 3, 30) detail from orders where length(substr(o_orderpriority, 3, 30)) < 5")
def check_title_short(spark, d):
    return checks.title_short(_policies(spark, d), 5)


@query(_ENTRIES_SQL + " select distinct policy, 'unknown_principal' rule, p detail from (select policy, unnest(principals) p from e) where upper(p) not in ('A', 'N', 'G1', 'G2')")
def check_unknown_principal(spark, d):
    flags = table(spark, d, "lineitem").select(F.lower("l_returnflag").alias("group")).distinct().where("group <> 'r'")
    more = table(spark, d, "lineitem").select(F.concat(F.lit("g"), (F.col("l_quantity") % 4).cast("int").cast("string")).alias("group")).distinct().where("group in ('g1', 'g2')")
    return checks.unknown_principal(_entries(spark, d), flags.union(more))


def _check_fields(spark, d) -> DataFrame:
    """Every policy knows two of the three fields; one is a number."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"))
    return o.select("policy", F.explode(F.array(F.struct(F.lit("f_a").alias("field"), F.lit("bigint").alias("type")), F.struct(F.lit("f_n").alias("field"), F.lit("string").alias("type")))).alias("x")).select("policy", "x.*")


@query(_ENTRIES_SQL + " select distinct policy, 'unknown_field' rule, field detail from e where upper(field) = 'F_R'")
def check_unknown_field(spark, d):
    return checks.unknown_field(_entries(spark, d), _check_fields(spark, d))


@query("select l_orderkey policy, 'duplicate_token_source' rule, l_returnflag detail from lineitem group by l_orderkey, l_returnflag having count(*) > 1")
def check_duplicate_tokens(spark, d):
    return checks.duplicate_tokens(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.col("l_returnflag").alias("token_source")))


@query("select o_orderkey policy, 'no_transforms' rule, o_orderstatus detail from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def check_empty_transforms(spark, d):
    lists = _entries(spark, d).where("field = 'F_R'").groupBy("policy").agg(F.collect_list("ord").alias("entries"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"), F.col("o_orderstatus").alias("field"))
    return checks.empty_transforms(o.join(lists, "policy", "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<int>"))))


@query(_ENTRIES_SQL + " select policy, 'last_entry_not_default' rule, field detail from (select policy, field, arg_max(len(principals), ord) n from e group by 1, 2) where n > 0")
def check_last_transform(spark, d):
    return checks.last_has_principals(_entries(spark, d))


@query(_ENTRIES_SQL + " select policy, 'several_defaults' rule, field detail from e where len(principals) = 0 group by policy, field having count(*) > 1")
def check_several_defaults(spark, d):
    return checks.several_defaults(_entries(spark, d))


@query(_ENTRIES_SQL + " select policy, 'overlapping_principals' rule, p detail from (select policy, field, unnest(list_distinct(principals)) p from e) group by policy, field, p having count(*) > 1")
def check_overlapping_principals(spark, d):
    return checks.overlapping_principals(_entries(spark, d))


@query("select l_orderkey policy, 'field_twice' rule, 'F_' || l_returnflag detail from lineitem group by l_orderkey, l_returnflag having count(*) > 1")
def check_field_twice(spark, d):
    return checks.field_twice(_entries(spark, d).select("policy", "rule_set", "field"))


@query(_ENTRIES_SQL + " select policy, 'last_condition_not_default' rule, field detail from (select policy, field, arg_max(len(principals), ord) n from e group by 1, 2) where n > 0")
def check_last_condition(spark, d):
    return checks.filter_last_has_principals(_entries(spark, d).withColumnRenamed("field", "filter"))


@query("select l_orderkey policy, 'retention_twice' rule, l_linestatus detail from lineitem group by l_orderkey, l_linestatus having count(*) > 1")
def check_retention_twice(spark, d):
    return checks.retention_twice(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.col("l_linestatus").alias("field")))


@query("select o_orderkey policy, 'filter_kind_missing' rule, o_orderpriority detail from orders where o_orderstatus = 'P'")
def check_filter_kind(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "generic").when(F.col("o_orderstatus") == "O", "retention")
    return checks.filter_kind_missing(table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"), kind.alias("filter_kind"), F.col("o_orderpriority").alias("filter")))


@query(_ENTRIES_SQL + " select policy, 'name_part_empty' rule, field || '.' detail from e where ord = 1 union all select policy, 'principal_empty', field || case when ord = 1 then '.' else '' end from e where value like 'q%'")
def check_names_empty(spark, d):
    e = _entries(spark, d).withColumn("field", F.when(F.col("ord") == 1, F.concat("field", F.lit("."))).otherwise(F.col("field")))
    return checks.names_empty(e.withColumn("principals", F.when(F.col("value").startswith("q"), F.array(F.lit(""))).otherwise(F.col("principals"))))


@query(_ENTRIES_SQL + " select policy, 'bad_fixed_value' rule, value detail from e where kind = 'fixed' and field = 'F_A' and value like 'q%'")
def check_fixed_value(spark, d):
    return checks.bad_fixed(_entries(spark, d), _check_fields(spark, d))


_ALL_SQL = """with e as (select l_orderkey policy, l_suppkey % 2 rule_set, case when l_partkey % 2 = 0 then 'F_' else 'f_' end || l_returnflag || case when l_partkey % 10 = 0 then '.' else '' end field, l_linenumber * 1000 + l_partkey % 1000 ord, case when l_linenumber % 2 = 0 then 'fixed' else 'identity' end kind,
  case when l_partkey % 3 = 0 then []::varchar[] else [lower(l_returnflag), case when l_quantity = 7 then '' else 'G' || (l_quantity % 4)::int end] end principals, case when l_quantity > 25 then (l_quantity::int)::varchar else 'q' || (l_quantity::int)::varchar end value from lineitem),
l as (select distinct policy, rule_set, field from e union all select o_orderkey, 0, 'f_A' from orders union all select o_orderkey, 1, 'none' from orders where o_orderkey % 3 = 0),
c as (select o_orderkey policy, 0 rule_set, o_orderpriority flt, case o_orderstatus when 'F' then 'generic' when 'O' then 'retention' end filter_kind, case when o_custkey % 2 = 0 then 'f_a' else 'gone' end field, 1 ord, case when o_custkey % 5 = 0 then ['x'] else []::varchar[] end principals from orders union all
  select o_orderkey, 0, 'second', 'retention', case when o_custkey % 4 = 0 then 'F_A' else 'F_N' end, 1, []::varchar[] from orders),
t as (select l_orderkey policy, 0 rule_set, l_returnflag token_source from lineitem),
k as (select o_orderkey policy, upper(f) field, t type from orders, (values ('f_a', 'bigint'), ('f_n', 'string')) x(f, t)), p as (select o_orderkey policy, nullif(o_orderstatus, 'F') source_ref, case when o_orderkey % 5 > 0 then 'spark' else '' end platform, substr(o_orderpriority, 3, 30) title, case when o_orderstatus = 'F' then 'DBT_SQL' else 'SQL_VIEW' end target_type from orders)
select policy, 'source_empty' rule, '' detail from p where source_ref is null
union all select policy, 'platform_empty', '' from p where target_type = 'SQL_VIEW' and platform = ''
union all select policy, 'title_short', title from p where length(title) < 5
union all select distinct policy, 'unknown_principal', x from (select policy, unnest(principals) x from e) where upper(x) not in ('A', 'N', 'G1', 'G2')
union all select distinct policy, 'unknown_field', field from (select policy, field from e union all select policy, field from c where filter_kind = 'retention') u where not exists (select 1 from k where k.policy = u.policy and k.field = upper(u.field))
union all select policy, 'duplicate_token_source', token_source from t group by policy, rule_set, token_source having count(*) > 1
union all select policy, 'no_transforms', field from l where not exists (select 1 from e where e.policy = l.policy and e.rule_set = l.rule_set and e.field = l.field)
union all select policy, 'last_entry_not_default', field from (select policy, rule_set, field, max((ord, len(principals))) m from e group by 1, 2, 3) where m[2] > 0
union all select policy, 'last_condition_not_default', flt from c where len(principals) > 0
union all select policy, 'several_defaults', field from e where len(principals) = 0 group by policy, rule_set, field having count(*) > 1
union all select policy, 'overlapping_principals', x from (select policy, rule_set, field, unnest(list_distinct(principals)) x from e) group by policy, rule_set, field, x having count(*) > 1
union all select policy, 'filter_kind_missing', flt from c where filter_kind is null
union all select policy, 'name_part_empty', field from e where field like '%.'
union all select policy, 'principal_empty', field from e where list_contains(principals, '')
union all select e.policy, 'bad_fixed_value', value from e join k on k.policy = e.policy and k.field = upper(e.field) where kind = 'fixed' and type = 'bigint' and value like 'q%'
union all select policy, 'field_twice', upper(field) from l group by policy, rule_set, upper(field) having count(*) > 1
union all select policy, 'retention_twice', upper(field) from c where filter_kind = 'retention' group by policy, rule_set, upper(field) having count(*) > 1"""


@query(_ALL_SQL)
def check_all(spark, d):
    """All rules over policies with several rule sets, names in both letter cases, empty names, and lists without entries, in one pass."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    key, none = F.col("o_orderkey").alias("policy"), F.array().cast("array<string>")
    field = F.concat(F.when(F.col("l_partkey") % 2 == 0, "F_").otherwise("f_"), "l_returnflag", F.when(F.col("l_partkey") % 10 == 0, ".").otherwise(""))
    who = F.when(F.col("l_partkey") % 3 == 0, none).otherwise(F.array(F.lower("l_returnflag"), F.when(F.col("l_quantity") == 7, "").otherwise(F.concat(F.lit("G"), (F.col("l_quantity") % 4).cast("int").cast("string")))))
    whole = F.col("l_quantity").cast("int").cast("string")
    entries = li.select(F.col("l_orderkey").alias("policy"), (F.col("l_suppkey") % 2).alias("rule_set"), field.alias("field"), (F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000).alias("ord"), F.when(F.col("l_linenumber") % 2 == 0, "fixed").otherwise("identity").alias("kind"), who.alias("principals"), F.when(F.col("l_quantity") > 25, whole).otherwise(F.concat(F.lit("q"), whole)).alias("value"))
    lists = entries.select("policy", "rule_set", "field").distinct().unionAll(o.select(key, F.lit(0), F.lit("f_A"))).unionAll(o.where("o_orderkey % 3 = 0").select(key, F.lit(1), F.lit("none")))
    conditions = o.select(key, F.lit(0).alias("rule_set"), F.col("o_orderpriority").alias("filter"), F.when(F.col("o_orderstatus") == "F", "generic").when(F.col("o_orderstatus") == "O", "retention").alias("filter_kind"), F.when(F.col("o_custkey") % 2 == 0, "f_a").otherwise("gone").alias("field"), F.lit(1).alias("ord"), F.when(F.col("o_custkey") % 5 == 0, F.array(F.lit("x"))).otherwise(none).alias("principals"))
    conditions = conditions.unionAll(o.select(key, F.lit(0), F.lit("second"), F.lit("retention"), F.when(F.col("o_custkey") % 4 == 0, "F_A").otherwise("F_N"), F.lit(1), none))
    tokens = li.select(F.col("l_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.col("l_returnflag").alias("token_source"))
    policies = o.select(key, F.expr("nullif(o_orderstatus, 'F')").alias("source_ref"), F.when(F.col("o_orderkey") % 5 > 0, "spark").otherwise("").alias("platform"), F.substring("o_orderpriority", 3, 30).alias("title"), F.when(F.col("o_orderstatus") == "F", "DBT_SQL").otherwise("SQL_VIEW").alias("target_type"))
    groups = li.select(F.lower("l_returnflag").alias("group")).where("group <> 'r'").unionAll(li.select(F.concat(F.lit("g"), (F.col("l_quantity") % 4).cast("int").cast("string"))).where("l_quantity % 4 in (1, 2)"))
    return checks.all_rules(policies, _check_fields(spark, d), lists, entries, conditions, tokens, groups, title=5)


#: Statements as they are generated, with the columns and functions that they name.
_STATEMENTS = [
    ("CASE WHEN c_acctbal > 0 THEN upper(C_Name) ELSE 'c_phone (x)' END", ["c_acctbal", "c_name"], ["upper"]),
    ("concat(`odd name`, '--', c_name) -- and c_address", ["c_name", "odd name"], ["concat"]),
    ("CAST(c_nationkey AS DECIMAL(10, 2)) / 2.5e3D + date_part('day', c_since - INTERVAL '3' DAY)", ["c_nationkey", "c_since"], ["cast", "date_part"]),
    ("transform(c_tags, (x, i) -> concat(x, c_name, i))[0] /* c_address */", ["c_name", "c_tags"], ["concat", "transform"]),
    ("c_home.Street . name LIKE \"c_%\" AND c_since < DATE '2024-01-01' OR my_mask(c_phone) IS NULL", ["c_home.street.name", "c_phone", "c_since"], ["my_mask"]),
    ("extract(YEAR FROM c_since) BETWEEN 1 AND year", ["c_since", "year"], ["extract"]),
    ("filter(c_tags, t -> t.kind <> 'it''s') IS NOT NULL AND NOT exists(SPLIT(c_name, r'\\'), s -> s = session_user())", ["c_name", "c_tags"], ["exists", "filter", "session_user", "split"]),
    ("nullif(current_date, c_since)", ["c_since"], ["current_date", "nullif"]),
]
_STATEMENTS_SQL = "with s(k, cols, funs) as (values " + ", ".join(f"({i}, {c!r}, {f!r})" for i, (_, c, f) in enumerate(_STATEMENTS)) + "), e as (select o_orderkey policy, cols, funs from orders join s on k = o_orderkey % 8)"


def _statement_entries(spark, d) -> DataFrame:
    """Each order as a policy with a statement, told apart by a number in it."""
    texts = F.array(*(F.lit(t) for t, _, _ in _STATEMENTS))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.lit("c_name").alias("field"), F.lit(1).alias("ord"), F.lit("sql_statement").alias("kind"), F.array().cast("array<string>").alias("principals"), F.concat(F.get(texts, (F.col("o_orderkey") % 8).cast("int")), F.lit("\n/* "), F.col("o_orderkey").cast("string"), F.lit(" */")).alias("value"))


@query(_STATEMENTS_SQL + " select policy, array_to_string(cols, ',') cols, array_to_string(funs, ',') funs from e")
def statement_names(spark, d):
    """Columns and functions of every statement."""
    told = _statement_entries(spark, d).select("policy", names_in(F.col("value")).alias("names"))
    return told.select("policy", F.array_join("names.columns", ",").alias("cols"), F.array_join("names.functions", ",").alias("funs"))


@query(_STATEMENTS_SQL + " select distinct policy, 'unknown_column' rule, c detail from (select policy, unnest(cols) c from e) where split_part(c, '.', 1) not in ('c_name', 'c_home', 'c_since', 'c_tags') union all select distinct policy, 'unknown_function', f from (select policy, unnest(funs) f from e) where f = 'my_mask'")
def check_statement_names(spark, d):
    """Columns that the source lacks, functions that Spark lacks."""
    entries = _statement_entries(spark, d)
    known = F.explode(F.array(*map(F.lit, ("C_NAME", "c_home.street", "c_home.zip", "c_since", "c_tags"))))
    functions = spark.sql("SHOW SYSTEM FUNCTIONS").select(F.col("function").alias("name"))
    return checks.unknown_names(entries, entries.select("policy", known.alias("field")), functions)


@query("""
with r as (select o_orderkey policy, o_orderkey % 4 k from orders)
select policy, 'masked_column_returns' rule, unnest(case k
  when 0 then ['c_name shows c_phone to *', 'c_name shows c_phone to sales']
  when 1 then ['c_name shows c_phone to *']
  when 2 then ['c_name shows c_home.street to audit', 'c_name shows c_home.street to *']
  else []::varchar[] end) detail from r""")
def check_masked_return(spark, d):
    """Fields that are hidden from somebody who is shown them through another field's statement."""
    none = F.array().cast("array<string>")
    key = F.col("o_orderkey") % 4
    entry = lambda field, n, kind, who, value=None: F.struct(F.lit(field).alias("field"), F.lit(n).alias("ord"), F.lit(kind).alias("kind"), (F.array(*map(F.lit, who)) if who else none).alias("principals"), F.lit(value).cast("string").alias("value"))
    phone = "concat(c_name, C_PHONE)"
    cases = [
        [entry("c_name", 1, "identity", ["audit"]), entry("c_name", 2, "sql_statement", [], phone), entry("c_phone", 1, "identity", ["audit"]), entry("c_phone", 2, "nullify", [])] + [entry("c_zip", 1, "identity", ["sales"]), entry("c_zip", 2, "fixed", [], "c_phone")],
        [entry("C_Name", 1, "sql_statement", ["sales", "audit"], "concat(c_name, c_phone)"), entry("c_name", 2, "sql_statement", [], phone), entry("c_phone", 1, "identity", ["sales"]), entry("c_phone", 2, "identity", ["audit"]), entry("c_phone", 3, "hash", ["sales"]), entry("c_phone", 4, "hash", [])],
        [entry("c_name", 1, "sql_statement", [], "to_json(c_home)"), entry("c_home.street", 1, "hash", ["audit"]), entry("c_home.street", 2, "nullify", [])],
        [entry("c_name", 1, "sql_statement", [], "concat(c_name, 'c_phone', c_zip)"), entry("c_phone", 1, "nullify", [])],
    ]
    pick = F.array()
    for i, c in enumerate(cases):
        pick = F.array(*c) if i == 0 else F.when(key == i, F.array(*c)).otherwise(pick)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.explode(pick).alias("e"))
    return checks.masked_columns_return(rows.select("policy", "rule_set", "e.*"))


# --- grants and lineage: customers feed nations feed regions


def _edges(spark, d) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return c.select(name("c", "c_custkey").alias("source_fqn"), name("n", "c_nationkey").alias("target_fqn"), F.col("c_mktsegment").alias("relation")).unionByName(n.select(name("n", "n_nationkey").alias("source_fqn"), name("r", "n_regionkey").alias("target_fqn"), F.lit("nation").alias("relation")))


def _governed(spark, d) -> DataFrame:
    """policies(source, targets): one for each nation of an even key; a target is a region."""
    return table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("source"), F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("targets"))


_EDGES_SQL = """with e as (select 'c' || c_custkey s, 'n' || c_nationkey t, c_mktsegment rel from customer union all select 'n' || n_nationkey, 'r' || n_regionkey, 'nation' from nation),
p as (select 'n' || n_nationkey s, 'r' || n_regionkey t from nation where n_nationkey % 2 = 0), m as (select s f from p union select t from p),
x as (select t fqn, 'upstream' direction, s neighbour, rel from e where t in (select s from p) union all select s, 'downstream', t, rel from e where s in (select s from p))"""


@query(_EDGES_SQL + " select f fqn from m")
def managed_resources(spark, d):
    return lineage.managed_resources(_governed(spark, d))


@query(_EDGES_SQL + " select fqn, direction, neighbour, rel relation from x")
def lineage_neighbours(spark, d):
    return lineage.neighbours(_edges(spark, d), _governed(spark, d).select(F.col("source").alias("fqn")).distinct())


@query(_EDGES_SQL + " select s source_fqn, t target_fqn, rel relation, s in (from m) source_managed, t in (from m) target_managed from e")
def lineage_managed(spark, d):
    return lineage.flagged(_edges(spark, d), lineage.managed_resources(_governed(spark, d)))


@query(_EDGES_SQL + " select fqn, direction, neighbour, rel relation, neighbour in (from m) managed from x")
def lineage_scan(spark, d):
    return lineage.scan(_edges(spark, d), _governed(spark, d))


@query(_EDGES_SQL + " select fqn, direction, neighbour, rel relation, false managed from x where neighbour not in (from m)")
def lineage_gaps(spark, d):
    return lineage.gaps(_edges(spark, d), _governed(spark, d))


@query("select l_orderkey link, 'p' || l_partkey source_fqn, 's' || l_suppkey target_fqn, o_custkey process, c_name \"sql\" from lineitem left join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey and c_custkey % 2 = 0")
def lineage_relation(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("link"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source_fqn"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target_fqn"))
    processes = table(spark, d, "orders").select(F.col("o_orderkey").alias("link"), F.col("o_custkey").alias("process"))
    sql = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("process"), F.col("c_name").alias("sql"))
    return lineage.with_relation(links, processes, sql)


@query(_ENTRIES_SQL + " select distinct policy, p principal from (select policy, unnest(principals) p from e) union select o_orderkey, 'c-' || lower(o_orderstatus) from orders")
def rule_set_principals(spark, d):
    cond = table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.array(F.concat(F.lit("c-"), F.lower("o_orderstatus"))).alias("principals"))
    return lineage.rule_set_principals(_entries(spark, d), cond).drop("rule_set")


@query(_ENTRIES_SQL + " select distinct o_orderpriority target, 'SELECT' privilege, p principal from (select policy, unnest(principals) p from e) join orders on o_orderkey = policy")
def grant_list(spark, d):
    targets = table(spark, d, "orders").select(F.col("o_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.col("o_orderpriority").alias("target"))
    principals = _entries(spark, d).select("policy", "rule_set", F.explode("principals").alias("principal"))
    return lineage.grants(principals, targets)


@query("select o_orderpriority reader, o_orderstatus reads from orders union select o_orderpriority, 'tok-' || l_returnflag from orders join lineitem on l_orderkey = o_orderkey")
def access_dependencies(spark, d):
    o = table(spark, d, "orders")
    targets = o.select(F.col("o_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.col("o_orderpriority").alias("target"))
    tokens = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("policy"), F.lit(0).alias("rule_set"), F.concat(F.lit("tok-"), "l_returnflag").alias("token_source"))
    return lineage.access_dependencies(targets, tokens, o.select(F.col("o_orderkey").alias("policy"), F.col("o_orderstatus").alias("source")))


# --- model metadata: a manifest for each nation, a model for each of its customers


def _manifests(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    tr = F.array().cast("array<string>")
    k = F.col("c_custkey") % 6
    col_meta = F.struct((k != 1).alias("enabled"), F.lit(None).cast("boolean").alias("generated"), tr.alias("rule_sets"), F.when(k.isin(0, 1), F.array(F.lit("mask"))).otherwise(tr).alias("column_transforms"))
    meta = F.struct(F.when(k == 2, True).when(k == 3, False).alias("enabled"), (k == 5).alias("generated"), F.when(k.isin(0, 3, 4, 5), F.array(F.lit("model"))).otherwise(tr).alias("rule_sets"), tr.alias("column_transforms"))
    cols = F.map_from_arrays(F.array(F.lit("a")), F.array(F.struct(F.lit("a").alias("name"), col_meta.alias("meta"))))
    node = F.struct(F.lit("db").alias("database"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("schema"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 11 == 0, "seed").otherwise("model").alias("resource_type"), F.array(F.lit("db"), F.col("c_name")).alias("fqn"), cols.alias("columns"), meta.alias("meta"))
    each = c.groupBy("c_nationkey", F.floor(F.col("c_custkey") / 50)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("model."), "c_name").alias("k"), node.alias("v")))).alias("nodes"))
    return each.select(F.to_json(F.struct(F.struct(F.lit("spark").alias("adapter_type")).alias("metadata"), "nodes", F.lit(1).alias("unknown"))).alias("manifest"))


@query("select 'db.n' || c_nationkey || '.' || c_name || '_view' target, c_custkey % 6 in (0, 2, 4) enabled from customer where c_custkey % 11 <> 0")
def model_meta_enabled(spark, d):
    m = models_meta.models(_manifests(spark, d))
    target = models_meta.default_target(models_meta.full_name(F.col("database"), F.col("schema"), F.col("name")))
    return m.select(target.alias("target"), models_meta.enabled(F.col("meta"), F.col("columns")).alias("enabled"))


@query("select c_custkey, case when c_custkey % 3 = 1 then 'a.b.' || c_custkey else 'n' || c_nationkey || '.' || c_custkey end \"path\", case when c_custkey % 3 = 2 then 'x.y' else case when c_custkey % 3 = 1 then 'a.b.' || c_custkey else 'n' || c_nationkey || '.' || c_custkey end end fqn from customer")
def model_meta_path(spark, d):
    """A path from the name, a name from the path, both kept where both are there."""
    key = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("a.b."), key)).when(F.col("c_custkey") % 3 == 2, "x.y")
    given = F.when(F.col("c_custkey") % 3 != 1, F.array(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), key))
    path, fqn = models_meta.complete_path(given, name)
    return table(spark, d, "customer").select("c_custkey", F.array_join(path, ".").alias("path"), fqn.alias("fqn"))


@query("select c_name, case when c_custkey % 6 = 0 then 'mask' when c_custkey % 6 in (3, 4, 5) then 'model' else '{}' end rules from customer where c_custkey % 11 <> 0")
def model_meta_precedence(spark, d):
    m = models_meta.models(_manifests(spark, d))
    return m.select(F.col("name").alias("c_name"), F.array_join(models_meta.effective_rules(F.col("meta"), F.col("columns")), ",").alias("rules"))

