"""Lineage over an edge table ``source_fqn, target_fqn, relation``, grants and access lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def managed_resources(policies: DataFrame) -> DataFrame:
    """Sources and targets of active policies: ``fqn``; policies: ``source, targets``."""
    return policies.select(F.col("source").alias("fqn")).union(policies.select(F.explode("targets"))).distinct()


def neighbours(edges: DataFrame, resources: DataFrame) -> DataFrame:
    """Both directions around each of ``resources(fqn)``: ``fqn, direction, neighbour, relation``."""
    ends = F.array(
        F.struct(F.col("target_fqn").alias("fqn"), F.lit("upstream").alias("direction"), F.col("source_fqn").alias("neighbour")),
        F.struct(F.col("source_fqn").alias("fqn"), F.lit("downstream").alias("direction"), F.col("target_fqn").alias("neighbour")),
    )
    return edges.select(F.explode(ends).alias("e"), "relation").select("e.*", "relation").join(resources, "fqn", "left_semi").select("fqn", "direction", "neighbour", "relation")


def flagged(edges: DataFrame, managed: DataFrame) -> DataFrame:
    """Edges with ``source_managed`` and ``target_managed``."""
    m = managed.select(F.col("fqn").alias("m")).distinct().withColumn("hit", F.lit(True))
    out = edges
    for side in ("source", "target"):
        out = out.join(m.select(F.col("m").alias(f"_{side}"), F.col("hit").alias(f"{side}_managed")), F.col(f"{side}_fqn") == F.col(f"_{side}"), "left").withColumn(f"{side}_managed", F.coalesce(f"{side}_managed", F.lit(False))).drop(f"_{side}")
    return out


def scan(edges: DataFrame, policies: DataFrame) -> DataFrame:
    """Neighbours of every policy's source with their managed flag; a source without edges keeps one row without a neighbour."""
    managed = managed_resources(policies)
    sources = policies.select(F.col("source").alias("fqn")).distinct()
    near = neighbours(edges, sources)
    told = near.join(managed.select(F.col("fqn").alias("m")).distinct(), F.col("neighbour") == F.col("m"), "left").withColumn("managed", F.col("m").isNotNull()).drop("m")
    return sources.join(told, "fqn", "left")


def gaps(edges: DataFrame, policies: DataFrame) -> DataFrame:
    """Neighbours of governed sources that no policy covers."""
    return scan(edges, policies).where(F.col("neighbour").isNotNull() & ~F.col("managed"))


def with_relation(links: DataFrame, processes: DataFrame, queries: DataFrame) -> DataFrame:
    """Links (``link, source_fqn, target_fqn``) with the process that made them and its SQL text."""
    return links.join(processes, "link", "left").join(queries, "process", "left")


def rule_set_principals(entries: DataFrame, conditions: DataFrame) -> DataFrame:
    """Distinct principals of transforms and filters: ``policy, rule_set, principal``."""
    each = lambda df: df.select("policy", "rule_set", F.explode("principals").alias("principal"))
    return each(entries).unionByName(each(conditions)).distinct()


def grants(principals: DataFrame, targets: DataFrame) -> DataFrame:
    """Who must be granted what: ``target, privilege, principal``; targets: ``policy, rule_set, target``."""
    return principals.join(targets, ["policy", "rule_set"]).select("target", F.lit("SELECT").alias("privilege"), "principal").distinct()


def access_dependencies(targets: DataFrame, tokens: DataFrame, sources: DataFrame) -> DataFrame:
    """Views that must be readable from other tables: ``reader, reads``; sources: ``policy, source``."""
    #: A view is one row, so targets are the side that a task holds; the other rows, of which there are several a view, go past it unsorted.
    held = targets.hint("shuffle_hash")
    base = held.join(sources, "policy").select(F.col("target").alias("reader"), F.col("source").alias("reads"))
    more = held.join(tokens, ["policy", "rule_set"]).select(F.col("target").alias("reader"), F.col("token_source").alias("reads"))
    return base.unionByName(more).distinct()
