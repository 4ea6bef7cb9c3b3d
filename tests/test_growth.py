"""What keeps the work of a query in proportion to its input: plans and edge cases."""

from pyspark.sql import functions as F

from veilframe.functions.sql_names import columns_in, names_in
from veilframe.operators import checks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_a_text_are_cut_once(spark):
    """Not once more for each token, nor for columns and functions."""
    texts = spark.createDataFrame([("upper(a) || 'x' || b.c -- d",), (None,)], "t string")
    for named in (columns_in(F.col("t")), names_in(F.col("t"))):
        assert plan(texts.select(named.alias("n"))).count("regexp_extract_all(t") == 1
    got = texts.select(names_in(F.col("t")).alias("n")).select("n.columns", "n.functions").collect()
    assert [tuple(r) for r in got] == [(["a", "b.c"], ["upper"]), (None, None)]


def test_unknown_names_are_those_of_the_two_checks(spark):
    """Each text is cut once for both; what is known is not grouped first."""
    entries = spark.createDataFrame([(1, "sql_statement", "f(a) + b.c"), (2, "sql_statement", "UPPER(d) + g(e, a)"), (2, "sql_statement", "g(e)"), (3, "fixed", "f(x)"), (4, "sql_statement", None)], "policy long, kind string, value string")
    fields = spark.createDataFrame([(1, "A"), (1, "b.z"), (2, "a")], "policy long, field string")
    functions = spark.createDataFrame([("upper",), ("F",)], "name string")
    got = checks.unknown_names(entries, fields, functions)
    assert plan(got).count("regexp_extract_all(value") == 1
    single = checks.unknown_columns(entries, fields).union(checks.unknown_functions(entries, functions))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, single.collect())) == [(2, "unknown_column", "d"), (2, "unknown_column", "e"), (2, "unknown_function", "g")]


def test_masked_columns_of_a_rule_set_meet_in_one_exchange(spark):
    """Entries without principals (null), without a field, and a principal named like everybody else."""
    rows = [
        (1, 0, "a", 1, "identity", ["x"], None), (1, 0, "A", 2, "sql_statement", [], "b || c"), (1, 0, "b", 1, "nullify", []), (1, 0, "c", 1, "hash", None), (1, 0, "c", 2, "identity", []),
        (2, 0, "a", 1, "sql_statement", [], "b.d"), (2, 0, "b.d.e", 1, "nullify", ["*"]), (2, 0, None, 1, "nullify", ["y", None]), (2, 0, "b", 1, "identity", []), (2, 1, "b", 1, "nullify", []),
    ]
    entries = spark.createDataFrame([(*r, None)[:7] for r in rows], "policy long, rule_set int, field string, ord int, kind string, principals array<string>, value string")
    found = checks.masked_columns_return(entries)
    assert plan(found).count("Exchange") == 1
    assert sorted((r.policy, r.detail) for r in found.collect()) == [(1, "a shows b to *"), (2, "a shows b.d.e to *")]


def test_all_rules_group_flat_rows(spark):
    """Counts and numbers are hash aggregates; lists in a group's state were sorted by its keys."""
    entries = spark.createDataFrame([(1, 0, "a", 1, "fixed", ["x", "y"], "q"), (1, 0, "a", 2, "fixed", ["x"], "q"), (1, 1, "a.", 1, "identity", None, None)], "policy long, rule_set int, field string, ord int, kind string, principals array<string>, value string")
    lists = entries.select("policy", "rule_set", "field").distinct()
    policies = spark.createDataFrame([(1, "s", "p", "title", "SQL_VIEW")], "policy long, source_ref string, platform string, title string, target_type string")
    fields = spark.createDataFrame([(1, "A", "int")], "policy long, field string, type string")
    conditions = spark.createDataFrame([(1, 0, "f", "retention", "gone", 1, []), (1, 0, "g", "retention", "gone", None, ["x"])], "policy long, rule_set int, filter string, filter_kind string, field string, ord int, principals array<string>")
    tokens = spark.createDataFrame([(1, 0, "t")], "policy long, rule_set int, token_source string")
    found = checks.all_rules(policies, fields, lists, entries, conditions, tokens, spark.createDataFrame([("X",)], "group string"))
    assert "ObjectHashAggregate" not in plan(found)
    assert sorted((r.rule, r.detail) for r in found.collect()) == sorted([("bad_fixed_value", "q")] * 2 + [("last_condition_not_default", "g"), ("last_entry_not_default", "a"), ("name_part_empty", "a."), ("overlapping_principals", "x"), ("unknown_field", "a."), ("unknown_field", "gone"), ("unknown_principal", "y")])


def test_views_are_held_and_their_tokens_go_past(spark):
    from veilframe.operators import lineage

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        targets = spark.createDataFrame([(1, 0, "v"), (1, 1, "w"), (2, 0, "v")], "policy long, rule_set int, target string")
        tokens = spark.createDataFrame([(1, 1, "t"), (1, 1, "t"), (2, 1, "u")], "policy long, rule_set int, token_source string")
        sources = spark.createDataFrame([(1, "s"), (2, "r")], "policy long, source string")
        found = lineage.access_dependencies(targets, tokens, sources)
        assert "SortMergeJoin" not in plan(found)
        assert sorted(map(tuple, found.collect())) == [("v", "r"), ("v", "s"), ("w", "s"), ("w", "t")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_a_large_group_are_dealt_out(spark):
    """Also a group of null, and with columns that cannot be hashed."""
    from veilframe.model import policy_from
    from veilframe.operators.apply import apply_rule_set

    total = lambda f, by: {"field": f, "transforms": [{"aggregation": {"sum": {}, "partition_by": [{"name_parts": [b]} for b in by]}, "principals": []}]}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(4000).select("id", F.when(F.col("id") >= 10, F.lit(1)).alias("k"), F.col("id").alias("x"), F.create_map("id", "id").alias("m"))
        seen = apply_rule_set(df, policy_from({"source": {"ref": "s"}, "rule_sets": [{"field_transforms": [total("x", ["k"])]}]}).rule_sets[0], set())
        per_task = seen.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert per_task < 2000
        assert {(r.k, r.x) for r in seen.select("k", "x").distinct().collect()} == {(None, 45), (1, 7998000 - 45)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
