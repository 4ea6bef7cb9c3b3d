"""Values from small literals; the registered queries are compared with DuckDB in test_queries.py."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions.members import groups_of
from veilframe.model import Field, PolicyError, policy_from
from veilframe.operators import checks, registry, tags
from veilframe.operators.apply import apply_rule_set, evaluate, principal_matrix, principals_frame
from veilframe.plans.queries import generic, retention, rules
from veilframe.sources.tables import read_csv, save_tables
from veilframe.streaming.apply import apply_to_stream

#: Parcels: dispatchers see them all, billing sees whose they are, everybody else light ones without a number.
POLICY = {
    "metadata": {"title": "parcels"},
    "source": {"ref": "parcels", "fields": [{"nameParts": [n], "type": t} for n, t in (("parcel", "integer"), ("sender", "varchar"), ("grams", "integer"), ("city", "varchar"))]},
    "ruleSets": [
        {
            "target": {"ref": {"integrationFqn": "parcels_open"}},
            "fieldTransforms": [
                {"field": {"nameParts": ["city"]}, "transforms": [{"principals": [{"group": "billing"}, {"group": "dispatch"}]}, {"sqlStatement": {"statement": "upper(substring(city, 1, 2))"}}]},
                {"field": {"nameParts": ["Sender"]}, "transforms": [{"principals": [{"group": "dispatch"}], "nullify": {}}, {"principals": [{"group": "billing"}], "identity": {}}, {"regexp": {"regexp": "[aeiou]", "replacement": "."}}]},
                {"field": {"nameParts": ["parcel"]}, "transforms": [{"principals": [{"group": "dispatch"}], "identity": {}}, {"fixed": {"value": "-1"}}]},
            ],
            "filters": [{"genericFilter": {"conditions": [{"principals": [{"group": "dispatch"}], "condition": "true"}, {"condition": "grams < 500"}]}}],
        }
    ],
}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(41, "Oslo Fish", 120, "Bergen", "x"), (42, None, 500, "Graz", "x"), (43, "", None, None, "x")], "parcel int, sender string, grams int, city string, note string")


def seen(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_principal(rows):
    r = policy_from(POLICY).rule_sets[0]
    by = evaluate(rows, policy_from(POLICY))["parcels_open"]
    assert seen(by.where("principal = 'dispatch'").drop("principal")) == [(41, None, 120, "Bergen"), (42, None, 500, "Graz"), (43, None, None, None)]
    assert seen(by.where("principal = 'billing'").drop("principal")) == [(-1, "Oslo Fish", 120, "Bergen")]
    assert seen(by.where("principal = 'unmatched'").drop("principal")) == [(-1, "Osl. F.sh", 120, "BE")]
    for who in ("dispatch", "billing"):
        one = apply_rule_set(rows, r, {who}, policy_from(POLICY).fields)
        assert seen(one) == seen(by.where(f"principal = '{who}'").drop("principal"))
        assert one.columns == ["parcel", "sender", "grams", "city"]


def test_selected_and_unknown_principals(rows):
    r = policy_from(POLICY).rule_sets[0]
    assert principals_frame(rows, r, ["dispatch", "unmatched"]).count() == 2
    with pytest.raises(PolicyError):
        principals_frame(rows, r, ["nobody"])


def test_refusals(rows):
    bad = [{"nope": [("identity", {})]}, {"parcel": [("fixed", {"value": "x"})]}, {"parcel": [("identity", {}, "g")]}, {"grams": [("hash", {})], "GRAMS": [("hash", {})]}]
    bad += [{"grams": [("aggregation", {"median": {}})]}, {"grams": [("numeric_rounding", {})]}]
    for x in bad:
        with pytest.raises(PolicyError):
            apply_rule_set(rows, rules(x), set())
    with pytest.raises(PolicyError):
        apply_rule_set(rows.selectExpr("grams > 1 heavy"), rules({"heavy": [("hash", {})]}), set())
    with pytest.raises(PolicyError):
        policy_from({"rule_sets": [{"field_transforms": [{"field": "a", "transforms": [{"shred": {}}]}]}]})


def test_retention_bounds(spark):
    """One row an hour before noon of the 9th of May; a period of whole days, none, and a period of no days."""
    df = spark.sql("select id, timestamp_ntz'2031-05-09 12:00:00' - make_dt_interval(0, cast(id as int)) ts from range(75) union all select -1, null")
    see = lambda g: sorted(r.id for r in apply_rule_set(df, rules(filters=[retention("ts", (2, "short"), (None, "all"), (0,))]), {g}, as_of="2031-05-09 12:00:00").collect())
    assert see("short") == [*range(48)] and see("other") == [] and see("all") == [-1, *range(75)]


def test_total_over_no_rows_and_filtered(spark, rows):
    r = rules({"grams": [("aggregation", {"sum": {}})]}, [generic(("grams < 500",))])
    assert [x.grams for x in apply_rule_set(rows, r, set()).collect()] == [120]
    assert apply_rule_set(rows.limit(0), r, set()).count() == 0
    assert principal_matrix(rows.limit(0), r).count() == 0


def test_repeated_tokens_multiply(spark, rows):
    tok = spark.createDataFrame([("Oslo Fish", "A"), ("Oslo Fish", "B")], "token string, value string")
    r = rules({"sender": [("detokenize", {"token_source_ref": "k", "token_field": {"name_parts": ["token"]}, "value_field": {"name_parts": ["value"]}})]})
    got = apply_rule_set(rows, r, set(), [Field("parcel"), Field("sender")], {"k": tok})
    assert seen(got) == [(41, "A"), (41, "B"), (42, None), (43, "")]
    with pytest.raises(PolicyError):
        apply_rule_set(rows, r, set(), token_sources={})


def test_two_fields_of_one_token_source(spark):
    df = spark.createDataFrame([("t1", "t2")], "buyer string, seller string")
    tok = spark.createDataFrame([("t1", "Ann"), ("t2", "Bob")], "token string, value string")
    t = ("detokenize", {"token_source_ref": "k", "token_field": {"name_parts": ["token"]}, "value_field": {"name_parts": ["value"]}})
    assert seen(apply_rule_set(df, rules({"buyer": [t], "seller": [t]}), set(), token_sources={"k": tok})) == [("Ann", "Bob")]


def test_overlap_keeps_case_and_entries(spark):
    e = [(1, 0, "f", 0, ["A", "B", "B"]), (1, 0, "f", 1, ["a"]), (2, 0, "f", 0, ["A", "C"]), (2, 0, "f", 1, ["C", "A"]), (2, 0, "g", 0, ["C"])]
    got = checks.overlapping_principals(spark.createDataFrame(e, "policy int, rule_set int, field string, ord int, principals array<string>"))
    assert seen(got) == [(2, "overlapping_principals", "A"), (2, "overlapping_principals", "C")]


def test_long_chains_and_cycles_of_fields(spark):
    chain = spark.range(40).selectExpr("id", "nullif(id, 0) - 1 parent", "concat('f', id) name")
    assert max(len(r.path) for r in tags.parent_paths(chain).collect()) == 40
    with pytest.raises(ValueError):
        tags.parent_paths(spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, None, "c")], "id int, parent int, name string")).collect()


def test_tables_for_targets(spark):
    save_tables({"parcels_saved": spark.range(3)})
    assert spark.table("parcels_saved").count() == 3
    spark.sql("drop table parcels_saved")


def test_nested_field(spark):
    df = spark.sql("select named_struct('a', 'x', 'b', named_struct('c', 5)) s")
    got = apply_rule_set(df, rules({"s.b.c": [("nullify", {})]}), set()).first().s
    assert got.a == "x" and got.b.c is None


def test_csv_by_name(spark, tmp_path):
    (tmp_path / "x.csv").write_text("age,unused,ID\n7,z,1\nbad,z,2\n")
    got = read_csv(spark, str(tmp_path / "x.csv"), [Field("id", "integer"), Field("age", "integer"), Field("gone", "bigint")])
    assert seen(got) == [(1, 7, None), (2, None, None)]
    assert read_csv(spark, str(tmp_path / "x.csv"), [Field("other")]).count() == 0


def test_exhausted_entries_go(spark):
    e = spark.createDataFrame([("t", "f", 0, 0, ["g1"], "nullify"), ("t", "f", 1, 0, ["g1"], "identity"), ("t", "f", 1, 1, [], "nullify"), ("t", "f", 2, 0, [], "hash")], "table string, field string, tag_pos int, ord int, groups array<string>, transform string")
    assert [(r.ord, r.groups, r.transform) for r in tags.combine(e).orderBy("ord").collect()] == [(1, ["g1"], "nullify"), (2, [], "nullify")]


def test_groups_of_nobody(spark):
    g = spark.createDataFrame([("u", "b"), ("u", "a")], "user string, group string")
    assert groups_of(g, "u").first().groups == ["a", "b"] and groups_of(g, "v").first().groups == []


def test_streaming(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    r = rules({"sender": [("nullify", {})]}, [generic(("grams < 500",))])
    q = apply_to_stream(stream, r, set()).writeStream.format("memory").queryName("governed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("governed").count() == 1
    with pytest.raises(PolicyError):
        apply_to_stream(stream, rules({"grams": [("aggregation", {"sum": {}})]}), set())


def test_writers_that_collide(spark):
    """Two start from one version: one is set; null and repeated rows have a defined result; counted up, every one but the first is lost."""
    history = spark.createDataFrame([("a", "p", 1, False, 5, 5, "x"), ("a", "p", 2, True, 5, 6, "y")], "id string, platform string, version int, active boolean, created_at int, updated_at int, policy string")
    incoming = spark.createDataFrame([("a", "p", 2, "bob", "B"), ("a", "p", 2, "ann", "A"), ("a", "p", 1, "cy", "C"), ("a", "p", None, "dee", "D"), ("b", "p", 9, "ann", "N"), ("b", "p", 9, "ann", "N")], "id string, platform string, version int, writer string, policy string")
    after, refused = registry.compare_and_set(history, incoming, F.lit(7))
    assert sorted((r.id, r.version, r.active, r.created_at, r.policy) for r in after.collect()) == [("a", 1, False, 5, "x"), ("a", 2, False, 5, "y"), ("a", 3, True, 5, "A"), ("b", 1, True, 7, "N")]
    assert sorted((r.id, r.writer, r.outcome) for r in refused.collect()) == [("a", "bob", "lost"), ("a", "cy", "stale"), ("a", "dee", "stale"), ("b", "ann", "lost")]
    counted = registry.judged(history, incoming, auto_increment=True)
    assert sorted((r.writer, r.outcome) for r in counted.where("id = 'a'").collect()) == [("ann", "set"), ("bob", "lost"), ("cy", "lost"), ("dee", "lost")]
    again = registry.compare_and_set(after, incoming.where("writer = 'bob'"), F.lit(8))
    assert [r.outcome for r in again[1].collect()] == ["stale"] and again[0].count() == after.count()
