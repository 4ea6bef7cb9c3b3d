"""Statements and lasting views against the frames that they stand for."""

import ast
import os
import subprocess
import sys
from dataclasses import replace
from decimal import Decimal
from pathlib import Path

import pytest

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from veilframe.functions.sql_names import columns_in, functions_in
from veilframe.model import Field, Policy, PolicyError
from veilframe.operators import checks
from veilframe.operators.apply import apply_rule_set
from veilframe.plans.queries import _STATEMENTS, generic, retention, rules
from veilframe.plans.statements import MODEL, Members, publish, statement

ROOT = Path(__file__).resolve().parents[1]
TOKENS = [("t1", "one"), ("t1", "uno"), ("t2", None), ("t3", "three")]
SHAPES = {
    "every kind": {
        "fields": {
            "name": [("identity", {}, "eu"), ("regexp", {"regexp": r"(\p{L})[^']*'?", "replacement": r"$1\\'"}, "us"), ("nullify", {})],
            "code": [("hash", {"seed": 3}, "eu"), ("numeric_rounding", {"round": {"precision": -1}})],
            "amount": [("numeric_rounding", {"ceil": {"divisor": -2.5}}, "eu"), ("aggregation", {"sum": {}, "partition_by": ["name"]}, "us"), ("aggregation", {"avg": {"cast_to": "int", "precision": 2}})],
            "token": [("detokenize", {"token_source_ref": "tokens", "token_field": {"name_parts": ["token"]}, "value_field": {"name_parts": ["value"]}}, "eu", "us"), ("fixed", {"value": "it's \\\\ hidden"})],
            "deep.who": [("sql_statement", {"statement": "CASE WHEN code > 2 THEN name ELSE 'x' END"}, "eu"), ("hash", {})],
            "deep.more.n": [("identity", {}, "us"), ("fixed", {"value": "7"})],
        },
        "filters": [generic(("true", "eu"), ("amount > 1 OR name IS NULL",)), retention("at", (None, "us"), (400,))],
    },
    "one group of all": {"fields": {"amount": [("aggregation", {"max": {}})], "code": [("aggregation", {"min": {}, "partition_by": ["code"]})]}, "filters": []},
    "nothing": {"fields": {}, "filters": []},
}


@pytest.fixture(scope="module")
def governed(spark, tmp_path_factory):
    """A table of files and its relation, with nulls, quotes, a null struct and repeated rows; tokens with two values and a null one."""
    path = str(tmp_path_factory.mktemp("governed"))
    made = spark.sql("""
        SELECT * FROM VALUES ('Ana', 1, 2.5D, 't1', named_struct('who', 'w1', 'more', named_struct('n', 1, 'm', 'x')), timestamp '2024-01-01 00:00:00'),
          ("O'Neil", 2, 0.5D, 't2', named_struct('who', 'w2', 'more', CAST(NULL AS struct<n: int, m: string>)), timestamp '2020-01-01 00:00:00'),
          (NULL, 3, 7.0D, 't3', CAST(NULL AS struct<who: string, more: struct<n: int, m: string>>), timestamp '2024-02-01 00:00:00'), ('Ana', 4, NULL, 'no', named_struct('who', NULL, 'more', named_struct('n', NULL, 'm', 'y')), NULL),
          ('Ana', 1, 2.5D, 't1', named_struct('who', 'w1', 'more', named_struct('n', 1, 'm', 'x')), timestamp '2024-01-01 00:00:00') AS t(name, code, amount, token, deep, at)""")
    made.write.parquet(f"{path}/rows")
    spark.createDataFrame(TOKENS, "token string, value string").write.parquet(f"{path}/tokens")
    spark.createDataFrame([("ann", "eu"), ("ann", "other"), ("bob", "us"), ("bob", None)], "user string, group string").write.parquet(f"{path}/members")
    return {n: f"parquet.`{path}/{n}`" for n in ("rows", "tokens", "members")}


def _plain(df):
    return df.schema.simpleString(), sorted(map(str, df.collect()))


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("groups", [{"eu"}, {"us"}, {"eu", "us"}, set()])
def test_statement_says_what_the_frame_says(spark, governed, shape, groups):
    r = rules(SHAPES[shape]["fields"], SHAPES[shape]["filters"])
    df = spark.sql(f"SELECT * FROM {governed['rows']}")
    frame = apply_rule_set(df, r, groups, token_sources={"tokens": spark.sql(f"SELECT * FROM {governed['tokens']}")}, as_of="2024-03-01")
    text = statement(df, r, governed["rows"], groups, token_sources={"tokens": governed["tokens"]}, as_of="2024-03-01")
    assert _plain(spark.sql(text)) == _plain(frame)
    mine = " UNION ALL ".join(f"SELECT session_user() AS user, '{g}' AS group" for g in sorted(groups)) or "SELECT 'someone' AS user, 'eu' AS group"
    text = statement(df, r, governed["rows"], Members(f"({mine})"), token_sources={"tokens": governed["tokens"]}, as_of="2024-03-01")
    assert _plain(spark.sql(text)) == _plain(frame)


def test_statement_refusals(spark, governed):
    df = spark.sql(f"SELECT * FROM {governed['rows']}")
    for transforms in ({"name": [("fixed", {"value": "x"}, "eu")]}, {"code": [("fixed", {"value": "x"})]}, {"nope": [("nullify", {})]}, {"at": [("hash", {})]}, {"name": [("regexp", {"regexp": "("})]}):
        with pytest.raises(PolicyError):
            statement(df, rules(transforms), governed["rows"], {"us"})
    table = Policy(governed["rows"], (), (replace(rules({}), target="t", target_type="SQL_TABLE"),))
    with pytest.raises(PolicyError):
        publish(spark, table, Members(governed["members"]))


def test_model_targets_keep_fixed_values_as_written(spark, governed):
    df = spark.sql(f"SELECT * FROM {governed['rows']}")
    r = replace(rules({"name": [("fixed", {"value": "1.5"})], "code": [("fixed", {"value": "upper('x')"})]}), target="models.m", target_type=MODEL)
    made = publish(spark, Policy(governed["rows"], tuple(map(Field, ("name", "code"))), (r,)), set())
    assert spark.sql(made["models.m"]).distinct().collect() == [(Decimal("1.5"), "X")]
    assert not spark.catalog.tableExists("models.m") and "name" in df.columns


READ = """
import sys
from pyspark.sql import SparkSession
from tests.test_statements import SHAPES
from veilframe.model import Policy
from veilframe.plans.queries import rules
from veilframe.plans.statements import Members, publish
from dataclasses import replace
home, make, rows, tokens, members = sys.argv[1:]
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", home + "/warehouse").config("spark.hadoop.javax.jdo.option.ConnectionURL", f"jdbc:derby:;databaseName={home}/store;create=true").config("spark.driver.extraJavaOptions", f"-Dderby.system.home={home}").enableHiveSupport().getOrCreate()
if make == "make":
    r = replace(rules(SHAPES["every kind"]["fields"], SHAPES["every kind"]["filters"]), target="default.lasting")
    publish(s, Policy(rows, (), (r,)), Members(members), token_sources={"tokens": tokens}, as_of="2024-03-01")
df = s.table("default.lasting")
print("SEEN", repr((df.schema.simpleString(), sorted(map(str, df.collect())))))
"""


def test_view_outlives_the_application_and_follows_its_reader(spark, governed, tmp_path):
    """Made by one application as ann, read by another as bob; each sees what the frame shows to its user's groups."""
    seen = {}
    for user, make in (("ann", "make"), ("bob", "read")):
        run = subprocess.run([sys.executable, "-c", READ, str(tmp_path), make, *governed.values()], cwd=ROOT, env=os.environ | {"SPARK_USER": user, "HADOOP_USER_NAME": user}, capture_output=True, text=True, timeout=300)
        lines = [x for x in run.stdout.splitlines() if x.startswith("SEEN ")]
        assert lines, run.stderr[-3000:]
        seen[user] = ast.literal_eval(lines[0][5:])
    r = rules(SHAPES["every kind"]["fields"], SHAPES["every kind"]["filters"])
    df, tokens = (spark.sql(f"SELECT * FROM {governed[n]}") for n in ("rows", "tokens"))
    for user, groups in (("ann", {"eu", "other"}), ("bob", {"us"})):
        assert seen[user] == _plain(apply_rule_set(df, r, groups, token_sources={"tokens": tokens}, as_of="2024-03-01"))
    assert seen["ann"] != seen["bob"]


SOURCE = "c_acctbal double, c_name string, `odd name` string, c_nationkey int, c_since date, c_tags array<struct<kind: string>>, c_home struct<street: struct<name: string>>, c_phone string, year int, c_address string"


@pytest.mark.parametrize("text, columns, functions", _STATEMENTS)
def test_names_are_those_that_spark_resolves(spark, text, columns, functions):
    """Spark accepts the text over the whole source, and misses each column that is named, and no other, once it is gone."""
    row = spark.range(1).select(F.lit(text).alias("x")).select(columns_in(F.col("x")).alias("c"), functions_in(F.col("x")).alias("f")).first()
    assert (row["c"], row["f"]) == (columns, functions)
    text = text.replace("my_mask(", "upper(").replace("concat(x, c_name, i)", "concat(x.kind, c_name, i)")
    whole = spark.createDataFrame([], SOURCE)
    whole.select(F.expr(text))
    for gone in whole.columns:
        if gone in {c.split(".")[0] for c in columns}:
            with pytest.raises(AnalysisException):
                whole.drop(gone).select(F.expr(text))
        else:
            whole.drop(gone).select(F.expr(text))


@pytest.mark.parametrize("text, columns", [("", []), (None, None), ("1", []), ("'a -- b' || x", ["x"]), ("'it''s' <> x", ["x"]), ("CAST(a AS ARRAY<STRUCT<b: INT>>)", ["a"]), ("`a``b`.c", ["ab.c"]), ("x" * 5000, ["x" * 5000]), ("größe > 1", ["größe"]), ("NOT(a)", ["a"]), ("(b) IN (1, c)", ["b", "c"])])
def test_names_in_odd_texts(spark, text, columns):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(columns_in(F.col("x")).alias("c")).first()["c"] == columns


def test_all_rules_says_what_single_rules_say(spark):
    """Over a small table with every flaw: the union of the single checks."""
    none: list = []
    policies = spark.createDataFrame([(1, "", "p", "title", "SQL_VIEW"), (2, "s", None, "t", "SQL_VIEW"), (3, "s", "", None, "DBT_SQL")], "policy int, source_ref string, platform string, title string, target_type string")
    fields = spark.createDataFrame([(1, "A", "int"), (2, "a", "date"), (2, "b.c", "string")], "policy int, field string, type string")
    entries = spark.createDataFrame([(1, 0, "a", 1, "fixed", ["x", "X"], "q"), (1, 0, "a", 2, "fixed", ["x", ""], "7"), (1, 0, "a", 3, "nullify", none, None), (1, 0, "a", 4, "nullify", none, None), (2, 0, "A", 1, "fixed", ["y"], None), (2, 1, "b.", 1, "identity", none, None), (3, 0, "z", 1, "hash", none, None)], "policy int, rule_set int, field string, ord int, kind string, principals array<string>, value string")
    lists = entries.select("policy", "rule_set", "field").distinct().unionAll(spark.createDataFrame([(1, 0, "A"), (2, 1, "b.c"), (2, 1, "b.c")], "policy int, rule_set int, field string"))
    conditions = spark.createDataFrame([(1, 0, "f", "retention", "a", 1, none), (1, 0, "g", "retention", "A", 1, none), (1, 0, "g", "retention", "A", 2, ["x"]), (2, 0, "h", None, None, 1, ["x"]), (2, 0, "i", "retention", "nope", 1, none)], "policy int, rule_set int, filter string, filter_kind string, field string, ord int, principals array<string>")
    tokens = spark.createDataFrame([(1, 0, "t"), (1, 0, "t"), (1, 1, "t")], "policy int, rule_set int, token_source string")
    groups = spark.createDataFrame([("X",)], "group string")
    full = lists.join(entries.groupBy("policy", "rule_set", "field").agg(F.collect_list("ord").alias("entries")), ["policy", "rule_set", "field"], "left").withColumn("entries", F.coalesce("entries", F.array().cast("array<int>")))
    single = [
        checks.source_empty(policies), checks.platform_empty(policies), checks.title_short(policies), checks.unknown_principal(entries, groups), checks.unknown_field(entries, fields, conditions), checks.duplicate_tokens(tokens),
        checks.empty_transforms(full), checks.last_has_principals(entries), checks.filter_last_has_principals(conditions), checks.several_defaults(entries), checks.overlapping_principals(entries), checks.field_twice(lists),
        checks.retention_twice(conditions.where("filter_kind = 'retention' and ord = 1")), checks.filter_kind_missing(conditions), checks.names_empty(entries), checks.bad_fixed(entries, fields),
    ]
    want = sorted(tuple(r) for df in single for r in df.fillna("").collect())
    got = sorted(tuple(r) for r in checks.all_rules(policies, fields, lists, entries, conditions, tokens, groups).fillna("").collect())
    assert got == want and len({r for _, r, _ in got}) == 17
