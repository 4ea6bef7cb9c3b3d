"""The table of policy versions: ``id, platform, version, active, created_at, updated_at, policy``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("id", "platform")


def page(df: DataFrame, *order: str, skip: int = 0, size: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(skip).limit(size)


def active_page(history: DataFrame, skip: int = 0, size: int = 10) -> DataFrame:
    return page(history.where("active"), "id", "platform", "version", skip=skip, size=size)


def group_page(groups: DataFrame, login_roles: DataFrame | None = None, skip: int = 0, size: int = 10) -> DataFrame:
    """Groups by name, without system roles (``pg_...``) and login roles; groups: ``group``."""
    out = groups.where(~F.col("group").startswith("pg_"))
    return page(out if login_roles is None else out.join(login_roles.select("group"), "group", "left_anti"), "group", skip=skip, size=size)


def latest(history: DataFrame) -> DataFrame:
    """The active version of each policy; of several the highest."""
    rest = [c for c in history.columns if c not in KEY]
    last = history.where("active").groupBy(*KEY).agg(F.max_by(F.struct(*rest), "version").alias("_last"))
    return last.select(*(F.col(c) if c in KEY else F.col(f"_last.{c}") for c in history.columns))


def latest_version(history: DataFrame) -> DataFrame:
    return history.groupBy(*KEY).agg(F.max("version").alias("version"))


def upsert(history: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """History after a batch: stored versions of the given policies become inactive, each gets one more, active, version.

    incoming: ``id, platform, policy``, one row for each policy. The first version is 1; later ones
    keep the time of creation.
    """
    last = history.groupBy(*KEY).agg(F.max("version").alias("v"), F.min("created_at").alias("c"))
    new = incoming.join(last, list(KEY), "left").select(*KEY, (F.coalesce("v", F.lit(0)) + 1).alias("version"), F.lit(True).alias("active"), F.coalesce("c", now).alias("created_at"), now.alias("updated_at"), "policy")
    given = incoming.select(*KEY, F.lit(True).alias("_given")).distinct()
    old = history.join(given, list(KEY), "left").withColumn("active", F.col("active") & F.col("_given").isNull()).select(*new.columns)
    return old.unionByName(new)


def stale(history: DataFrame, incoming: DataFrame, auto_increment: bool = False) -> DataFrame:
    """Incoming policies (``id, platform, version``) whose version is not the stored one; none if versions are counted up."""
    found = incoming.join(latest_version(history).withColumnRenamed("version", "stored"), list(KEY)).where(~F.col("version").eqNullSafe(F.col("stored")))
    return found.limit(0) if auto_increment else found


def judged(history: DataFrame, incoming: DataFrame, auto_increment: bool = False) -> DataFrame:
    """Each incoming policy (``id, platform, version, writer, policy``) with ``stored``, the version that it meets, and ``outcome``.

    A writer names the version that its policy is based on. ``set``: it is the stored one, or nothing is stored, or versions
    are counted up; of several such writers of one policy the least by ``writer`` (then by policy) is first, the others have
    ``lost``. ``stale``: it is another version. So of writers that start from one version one is set, and no version is given twice.
    Stored policies meet the batch's keys only; a key is as large as the writers of one policy.
    """
    given = incoming.select(*KEY).distinct()
    stored = latest_version(history.join(given, list(KEY), "left_semi")).withColumnRenamed("version", "stored")
    told = incoming.join(stored, list(KEY), "left").withColumn("fits", F.lit(auto_increment) | F.col("stored").isNull() | F.col("version").eqNullSafe(F.col("stored")))
    rank = F.row_number().over(Window.partitionBy(*KEY, "fits").orderBy("writer", "policy"))
    outcome = F.when(~F.col("fits"), "stale").when(rank == 1, "set").otherwise("lost")
    return told.select(*KEY, "version", "writer", "policy", "stored", outcome.alias("outcome"))


def compare_and_set(history: DataFrame, incoming: DataFrame, now: Column, auto_increment: bool = False) -> tuple[DataFrame, DataFrame]:
    """History after a batch in which writers may collide (``judged``), and what was refused: ``id, platform, version, writer, stored, outcome``.

    Both read ``incoming`` and ``history``, so these have to be what they were when both are stored: write the two as one commit of the table's format.
    """
    told = judged(history, incoming, auto_increment)
    return upsert(history, told.where("outcome = 'set'").select(*KEY, "policy"), now), told.where("outcome <> 'set'").drop("policy")
