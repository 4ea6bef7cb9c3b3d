"""Blueprints from footers against the schemas that Spark itself reads."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.sources.footers import blueprints, files_of, footers


def test_many_tables(spark, tmp_path):
    kinds = [T.LongType(), T.StringType(), T.DecimalType(10, 2), T.TimestampType(), T.ArrayType(T.DateType()), T.StructType([T.StructField("deep", T.StructType([T.StructField("er", T.DoubleType())]))])]
    tables, want = {}, set()
    for i in range(25):
        schema = T.StructType([T.StructField(f"f{j}", kinds[(i + j) % 6], nullable=True, metadata={"comment": f"c{j}", "tags": ["pii"]} if j == 1 else {}) for j in range(1 + i % 4)])
        name, path = f"a.b.t{i}", str(tmp_path / f"t{i}")
        spark.createDataFrame([], schema).write.parquet(path)
        tables[name] = path
        for j, f in enumerate(schema.fields):
            want.add((name, f"t{i}", f.name, f.dataType.simpleString(), f"c{j}" if j == 1 else None, ("pii",) if j == 1 else ()))
            if isinstance(f.dataType, T.StructType):
                want.add((name, f"t{i}", f"{f.name}.deep", "struct<er:double>", None, ()))
                want.add((name, f"t{i}", f"{f.name}.deep.er", "double", None, ()))
    files = files_of(spark, tables)
    got = blueprints(files).collect()
    assert {(r.table, r.title, r.field, r.type, r.comment, tuple(r.tags)) for r in got} == want and len(got) == len(want)
    assert not any(r.conflict or r.required for r in got)
    assert footers(files, at_once=4).where("table = 'a.b.t3'").orderBy("ord").first()["field"] == "f0"


def test_files_of_one_table_that_differ(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).selectExpr("cast(id as int) ID", "'x' name").coalesce(1).write.parquet(path)
    spark.range(3).selectExpr("cast(id as int) id", "2.5D extra").coalesce(1).write.mode("append").parquet(path)
    spark.range(3).selectExpr("id", "'x' name").coalesce(1).write.mode("append").parquet(path)
    tags = spark.createDataFrame([("t", "NAME", "b"), ("t", "name", "a"), ("other", "name", "c")], "table string, field string, tag string")
    got = {r.field.lower(): (r.type, r.conflict, r.tags) for r in blueprints(files_of(spark, {"t": path}), tags).collect()}
    assert got == {"id": ("int", True, []), "name": ("string", False, ["a", "b"]), "extra": ("double", False, [])}


def test_no_files(spark, tmp_path):
    none = spark.createDataFrame([], "table string, file string")
    assert blueprints(none).count() == 0 and blueprints(none).where(F.col("conflict")).isEmpty()
