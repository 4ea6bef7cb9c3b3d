"""Policies from model metadata: a manifest of models, their columns and their meta entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "struct<enabled:boolean,generated:boolean,rule_sets:array<string>,column_transforms:array<string>>"
MANIFEST = f"struct<metadata:struct<adapter_type:string>,nodes:map<string,struct<database:string,schema:string,name:string,resource_type:string,fqn:array<string>,columns:map<string,struct<name:string,meta:{META}>>,meta:{META}>>>"


def models(manifests: DataFrame, json_col: str = "manifest") -> DataFrame:
    """One row for each model of each manifest: ``platform, node`` and the model's attributes."""
    read = manifests.select(F.from_json(json_col, MANIFEST).alias("m"))
    each = read.select(F.col("m.metadata.adapter_type").alias("platform"), F.explode("m.nodes").alias("node", "n"))
    return each.where("n.resource_type = 'model'").select("platform", "node", "n.*")


def column_rules(columns: Column) -> Column:
    """All transforms of columns that are not disabled."""
    return F.flatten(F.transform(F.map_values(columns), lambda c: F.when(F.coalesce(c["meta"]["enabled"], F.lit(True)), F.coalesce(c["meta"]["column_transforms"], F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))))


def enabled(meta: Column, columns: Column) -> Column:
    """Generated models never; else with column transforms or rule sets that are not disabled, or if enabled explicitly."""
    on, rules = meta["enabled"], F.coalesce(F.size(meta["rule_sets"]), F.lit(0)) > 0
    by_column = F.coalesce(F.size(column_rules(columns)), F.lit(0)) > 0
    return ~F.coalesce(meta["generated"], F.lit(False)) & (by_column | (rules & F.coalesce(on, F.lit(True))) | F.coalesce(on, F.lit(False)))


def effective_rules(meta: Column, columns: Column) -> Column:
    """Column transforms stand before the model's rule sets; neither: one empty rule set, which passes everything through."""
    own, sets = F.coalesce(column_rules(columns), F.array().cast("array<string>")), F.coalesce(meta["rule_sets"], F.array().cast("array<string>"))
    return F.when(F.size(own) > 0, own).when(F.size(sets) > 0, sets).otherwise(F.array(F.lit("{}")))


def default_target(fqn: Column) -> Column:
    return F.concat(fqn, F.lit("_view"))


def full_name(database: Column, schema: Column, name: Column) -> Column:
    """``database.schema.name`` of what is there."""
    return F.concat_ws(".", database, schema, name)


def complete_path(path: Column, fqn: Column) -> tuple[Column, Column]:
    """A path from the name, or the name from the path, where one is missing."""
    return F.coalesce(path, F.split(fqn, r"\.")), F.coalesce(fqn, F.array_join(path, "."))
