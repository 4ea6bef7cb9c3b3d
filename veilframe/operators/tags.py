"""Tag-driven policies: tags of columns, matched with global transforms, combined into rule sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_key(tag: Column, strict: bool = False) -> Column:
    """What two tags must share to match; loosely, letter case and the difference of space, ``-`` and ``_`` do not count."""
    return tag if strict else F.lower(F.translate(tag, " -", "__"))


def comment_tags(comment: Column, marker: str = "policy") -> Column:
    """Every ``marker::tag`` or ``marker::"a tag"`` of a comment, in order, without quotes."""
    return F.transform(F.regexp_extract_all(comment, F.lit(rf'{marker}::("[^"]+"|[A-Za-z0-9_-]+)'), F.lit(1)), lambda t: F.regexp_replace(t, '^"|"$', ""))


def field_path(path: Column) -> Column:
    """Parts of a field path such as ``[version=2.0].[type=struct].a.[type=string].b``."""
    return F.split(F.regexp_replace(path, r"\[(?:version|type)=[^\]]*\]\.", ""), r"\.")


def parent_paths(fields: DataFrame, id_col: str = "id", parent_col: str = "parent", name_col: str = "name") -> DataFrame:
    """``id, path``: names from the root down to each field. A parent that is not there makes a root; a cycle is an error.

    Each round doubles the distance that is bridged, so a chain of n fields takes log2 n rounds.
    """
    now = fields.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), F.array(name_col).alias("path"))
    bridged, most, keep = 1, fields.count(), fields.sparkSession.sparkContext.getCheckpointDir() is not None
    while not now.where("up is not null").isEmpty():
        if bridged > most:
            raise ValueError("fields are parents of each other")
        above = now.select(F.col("id").alias("p_id"), F.col("up").alias("p_up"), F.col("path").alias("p_path"))
        now = now.join(above, F.col("up") == F.col("p_id"), "left").select("id", F.col("p_up").alias("up"), F.concat(F.coalesce("p_path", F.array().cast("array<string>")), "path").alias("path"))
        now, bridged = now.checkpoint() if keep else now, bridged * 2
    return now.select("id", "path")


def attach_tags(columns: DataFrame, tags: DataFrame, key: str = "column", tag_col: str = "tag") -> DataFrame:
    """``columns`` with the sorted list of tags of each; no tags: an empty list."""
    lists = tags.groupBy(key).agg(F.sort_array(F.collect_list(tag_col)).alias("tags"))
    return columns.join(lists, key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_transforms(fields: DataFrame, transforms: DataFrame, strict: bool = False) -> DataFrame:
    """Entries that a field's tags bring in: ``table, field, tag_pos, ord, groups, transform``.

    fields: ``table, field, tags``; transforms: ``tag, ord, groups, transform`` (no groups: default).
    """
    tagged = fields.select("table", "field", F.posexplode("tags").alias("tag_pos", "tag")).withColumn("k", tag_key(F.col("tag"), strict)).drop("tag")
    known = transforms.withColumn("k", tag_key(F.col("tag"), strict)).drop("tag")
    return tagged.join(known, "k").drop("k")


def combine(entries: DataFrame) -> DataFrame:
    """Each group's first transform for a field, and one default, last: ``table, field, ord, groups, transform``.

    A group belongs to the first entry that names it, in the order of the tags and of their
    entries. An entry whose groups are all taken goes (it does not become a default, which could
    expose data); of the defaults the first stays.
    """
    at = ["table", "field"]
    #: Fields are dealt out once; what follows groups and numbers within them. An entry for everybody stands as one group without a name.
    dealt = entries.select(*at, (F.col("tag_pos").cast("long") * (1 << 32) + F.col("ord")).alias("pos"), "transform", F.explode_outer(F.when(F.size("groups") > 0, F.col("groups"))).alias("group")).repartition(*at)
    first = dealt.groupBy(*at, "group").agg(F.min("pos").alias("pos"), F.min_by("transform", "pos").alias("transform"))
    #: Entries of one place keep their own transforms.
    whole = first.groupBy(*at, F.col("group").isNull().alias("last"), "pos", "transform").agg(F.array_sort(F.collect_list("group")).alias("groups"))
    place = F.row_number().over(Window.partitionBy(*at).orderBy("last", "pos", "transform"))
    return whole.select(*at, place.alias("ord"), "groups", "transform")


def rule_sets_from_tags(fields: DataFrame, transforms: DataFrame, strict: bool = False) -> DataFrame:
    """One row for each field that gets transforms: ``table, target, field, transforms``; the target is ``<table>_view``."""
    made = combine(tag_transforms(fields, transforms, strict))
    listed = made.groupBy("table", "field").agg(F.sort_array(F.collect_list(F.struct("ord", "groups", "transform"))).alias("transforms"))
    return listed.select("table", F.concat("table", F.lit("_view")).alias("target"), "field", "transforms")


def touched_fields(fields: DataFrame, before: DataFrame, after: DataFrame, changed: DataFrame, strict: bool = False) -> DataFrame:
    """``table, field`` whose rule sets may differ: those in ``changed`` (their tags changed, or they came or went), and those with a tag of which a transform came, went or changed.

    before, after: transforms ``tag, ord, groups, transform``. Only rows that differ are looked at further.
    """
    at = ["tag", "ord", "groups", "transform"]
    signed = before.select(*at, F.lit(-1).alias("n")).unionAll(after.select(*at, F.lit(1)))
    differ = signed.groupBy(*at).agg(F.sum("n").alias("n")).where("n <> 0").select(tag_key(F.col("tag"), strict).alias("k")).distinct()
    tagged = fields.select("table", "field", F.explode("tags").alias("tag")).withColumn("k", tag_key(F.col("tag"), strict))
    return tagged.join(differ, "k", "left_semi").select("table", "field").unionAll(changed.select("table", "field")).distinct()


def refreshed_rule_sets(stored: DataFrame, fields: DataFrame, transforms: DataFrame, touched: DataFrame, strict: bool = False) -> DataFrame:
    """Stored rule sets (of ``rule_sets_from_tags``) brought up to date: ``touched`` fields are made anew from ``fields`` and ``transforms``, all others stay as they are.

    Equal to making all of them, but the join with transforms and their combination see touched fields only. Fields that are gone, or have no transform any more, go.
    """
    again = rule_sets_from_tags(fields.join(touched, ["table", "field"], "left_semi"), transforms, strict)
    return stored.join(touched, ["table", "field"], "left_anti").select(*again.columns).unionByName(again)


def upsert_transforms(stored: DataFrame, incoming: DataFrame, strict: bool = False) -> DataFrame:
    """Stored rows (``ref, body``) with new bodies where the ref matches, keeping the stored spelling; others are added."""
    a = stored.select(F.col("ref").alias("ref_a"), F.col("body").alias("body_a"), tag_key(F.col("ref"), strict).alias("k"))
    b = incoming.select(F.col("ref").alias("ref_b"), F.col("body").alias("body_b"), tag_key(F.col("ref"), strict).alias("k"))
    return a.join(b, "k", "full").select(F.coalesce("ref_a", "ref_b").alias("ref"), F.coalesce("body_b", "body_a").alias("body"))


def delete_transforms(stored: DataFrame, refs: DataFrame, strict: bool = False) -> DataFrame:
    """Stored rows without those that match; ``number_deleted`` says how many these are."""
    return stored.withColumn("k", tag_key(F.col("ref"), strict)).join(refs.select(tag_key(F.col("ref"), strict).alias("k")).distinct(), "k", "left_anti").drop("k")


def number_deleted(stored: DataFrame, refs: DataFrame, strict: bool = False) -> DataFrame:
    """One row, ``deleted``: how many stored rows ``delete_transforms`` leaves out; those of each ref in ``refs``, once however often it is given."""
    gone = stored.select(tag_key(F.col("ref"), strict).alias("k")).join(refs.select(tag_key(F.col("ref"), strict).alias("k")).distinct(), "k", "left_semi")
    return gone.agg(F.count("*").alias("deleted"))


def first_match(candidates: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key, aggregated before its shuffle."""
    rest = [c for c in candidates.columns if c != key and c not in order]
    first = candidates.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("_first"))
    return first.select(*(F.col(key) if c == key else F.col(f"_first.`{c}`") for c in candidates.columns))


def transforms_of(stored: DataFrame, kind: str) -> DataFrame:
    """Stored transforms of one type."""
    return stored.where(F.col("type") == kind)


def blueprint(df: DataFrame, table: str) -> DataFrame:
    """``table, field, ord, type, required, tags, comment`` of a frame's schema; nested fields by dotted path."""
    from pyspark.sql import types as T

    rows: list[tuple] = []

    def walk(schema: T.StructType, prefix: str) -> None:
        for f in schema.fields:
            rows.append((table, prefix + f.name, len(rows), f.dataType.simpleString(), not f.nullable, list((f.metadata or {}).get("tags", [])), (f.metadata or {}).get("comment")))
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, f"{prefix}{f.name}.")

    walk(df.schema, "")
    return df.sparkSession.createDataFrame(rows, "table string, field string, ord int, type string, required boolean, tags array<string>, comment string")
