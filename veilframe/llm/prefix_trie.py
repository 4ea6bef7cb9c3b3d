"""Conversations that share their beginnings as one trie, with sums over its subtrees by an Euler tour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ordered, spread_join, written

#: Turns whose names are chained within one window; longer conversations take one more level for each factor of it.
STEP = 64
#: Ids of one end that are put together first, by ranges of so many.
PIECE = 1024


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv, i, turn, chars``: the turns of each conversation from 1, each by the SHA-256 of its role and text, and the code points of the text.

    Rows are ordered by turn (null first), then role and text; null roles and texts are empty. Rows without ``conv_id`` belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    #: Role and text decide between rows of one turn by their digest, so that sorting carries no texts.
    named = rows.select("conv", F.col("turn").alias("_turn"), name.alias("turn"), F.length("text").cast("long").alias("chars"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("_turn").asc_nulls_first(), "turn"))
    return named.select("conv", place.cast("long").alias("i"), "turn", "chars")


def rebuilt(turns: DataFrame, conversations: DataFrame, shared: Column, base: Column) -> DataFrame:
    """``conv, i, turn, chars``: each conversation with its first ``shared`` turns from conversation ``base`` in place of its own first ``shared``. Both are columns over ``conv``."""
    convs = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv")).distinct().select("conv", shared.cast("long").alias("h"), base.cast("long").alias("base"))
    heads = turns.where(F.col("i") <= convs.agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]).withColumnRenamed("conv", "base")
    taken = written(convs.join(heads, "base").where("i <= h").select("conv", "i", "turn", "chars"), "heads")
    held = taken.groupBy("conv").agg(F.max("i").alias("held"))
    own = turns.join(convs, "conv").where("i > h").join(held, "conv", "left")
    return taken.unionAll(own.select("conv", (F.col("i") - F.col("h") + F.coalesce("held", F.lit(0))).alias("i"), "turn", "chars"))


def named_prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``node``, a name of the conversation's first ``i`` turns, and ``parent``, that of the first ``i - 1`` (of none: the empty name).

    Within a step of ``STEP`` turns a name is the SHA-256 of the step's turns so far, put behind the
    name of all steps before, which is found in the same way with the steps as turns. So no window
    holds more than a step's rows, however long a conversation is.
    """
    longest = turns.agg(F.coalesce(F.max("i"), F.lit(0))).first()[0]
    step = Window.partitionBy("conv", "_step").orderBy("i")
    so_far = F.sha2(F.array_join(F.collect_list("turn").over(step.rowsBetween(Window.unboundedPreceding, 0)), ""), 256)
    rows = turns.withColumn("_step", F.expr(f"(i - 1) div {STEP}")).withColumn("node", so_far)
    if longest <= STEP:
        return rows.withColumn("parent", F.coalesce(F.lag("node").over(step), F.lit(""))).select(*turns.columns, "node", "parent")
    rows = written(rows.withColumn("_whole", F.expr(f"i div {STEP}")), "steps")
    ends = rows.where(F.col("i") % STEP == 0).select("conv", F.col("_whole").alias("i"), F.col("node").alias("turn"))
    heads = named_prefixes(ends).select("conv", F.col("i").alias("_whole"), F.col("node").alias("_head"))
    #: Where a step ends, its name among the steps is the turn's name; behind whole steps, their name leads.
    rows = rows.join(heads, ["conv", "_whole"], "left").withColumn("node", F.when(F.col("_head").isNull(), F.col("node")).when(F.col("i") % STEP == 0, F.col("_head")).otherwise(F.sha2(F.concat("_head", "node"), 256)))
    return rows.withColumn("parent", F.coalesce(F.lag("node").over(step), "_head", F.lit(""))).select(*turns.columns, "node", "parent")


def prefix_sums(df: DataFrame, place: str, sums: list[str], block: int = 1 << 14) -> DataFrame:
    """``df`` with the running sums of ``sums`` in order of ``place`` (numbers from 0, each once), own row included; blocks of places are summed up first, by the same function."""
    top = df.agg(F.coalesce(F.max(place), F.lit(0))).first()[0]
    rows = df.withColumn("_block", F.expr(f"{place} div {block}"))
    inside = Window.partitionBy("_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    if top < block:
        return rows.withColumns({c: F.sum(c).over(inside) for c in sums}).drop("_block")
    whole = rows.groupBy(F.col("_block").alias("_up")).agg(*(F.sum(c).alias(c) for c in sums))
    ends = prefix_sums(whole, "_up", sums, block).select((F.col("_up") + 1).alias("_block"), *(F.col(c).alias(f"_{c}") for c in sums))
    told = rows.withColumns({c: F.sum(c).over(inside) for c in sums}).join(ends, "_block", "left")
    return told.select(*(c if c not in sums else (F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in df.columns))


def ranked(arcs: DataFrame) -> DataFrame:
    """``arc, place`` (from 0) of a list ``arc, next`` whose last arc has a null ``next``: pointers double in each round, so it takes as many as the number of arcs has bits."""
    n = arcs.count()
    jump = written(arcs.select("arc", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("left")), "arcs")
    for _ in range(max(0, n - 1).bit_length()):
        #: Each arc is the next one of at most one other.
        ahead = jump.select(F.col("arc").alias("next"), F.col("next").alias("after"), F.col("left").alias("more"))
        far = jump.where("next is not null").join(ahead, "next").select("arc", F.col("after").alias("next"), (F.col("left") + F.col("more")).alias("left"))
        jump = written(far.unionAll(jump.where("next is null")), "arcs")
    return jump.select("arc", (F.lit(n - 1) - F.col("left")).alias("place"))


def euler_arcs(nodes: DataFrame) -> DataFrame:
    """``arc, next``: the tour through a tree ``n, name, parent``; node ``n`` is entered by arc ``2n`` and left by ``2n + 1``.

    Nodes are numbered so that siblings follow each other, so only a parent's first and last child are looked up, by joins in which each key stands once.
    """
    ends = nodes.where("parent is not null").groupBy("parent").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    held = written(nodes.select("n", "name").join(ends.withColumnRenamed("parent", "name"), "name", "left").select("n", "first", "last"), "families")
    enter = held.select((2 * F.col("n")).alias("arc"), F.coalesce(2 * F.col("first"), 2 * F.col("n") + 1).alias("next"))
    back = held.where("last is not null").select(F.col("last").alias("n"), (2 * F.col("n") + 1).alias("up"))
    root = nodes.where("parent is null").select("n", F.lit(True).alias("top"))
    leave = held.select("n").join(back, "n", "left").join(F.broadcast(root), "n", "left")
    leave = leave.select((2 * F.col("n") + 1).alias("arc"), F.when(F.col("top").isNull(), F.coalesce("up", 2 * F.col("n") + 2)).alias("next"))
    return enter.unionAll(leave)


def subtree_sums(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """``n`` and the sums of ``sums`` over each node's subtree, its top included: prefix sums at the places of its two arcs."""
    places = ranked(euler_arcs(nodes))
    side = nodes.select((2 * F.col("n")).alias("arc"), *sums)
    arcs = places.join(side, "arc", "left").select("arc", "place", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sums), *(F.coalesce(c, F.lit(0)).cast("long").alias(f"own_{c}") for c in sums))
    run = prefix_sums(arcs, "place", sums)
    odd = F.col("arc") % 2 == 1
    return run.groupBy(F.expr("arc div 2").alias("n")).agg(*(F.sum(F.when(odd, F.col(c)).otherwise(F.col(f"own_{c}") - F.col(c))).alias(c) for c in sums))


def prefix_trie(conversations: DataFrame, shared: Column | None = None, base: Column | None = None) -> DataFrame:
    """One row for each distinct beginning of conversations ``conv_id, turn, role, text``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node stands for the conversations whose first ``depth`` turns are equal in role and text
    (compared by SHA-256); ``conv_id`` is the smallest of them, so it and ``depth`` name the node.
    ``saved_tokens`` is what a cache of prefixes saves in the subtree, in code points; ``ends_sha256`` tells which
    conversations end here. shared, base: columns over ``conv``; its first so many turns are taken from conversation ``base``.

    Null roles and texts count as empty; of equal turn numbers role and text decide, by digest. Rows
    without ``conv_id`` are left out, repeated rows are turns of their own. An empty table gives no
    rows; a conversation without turns ends at the root. Other columns are not read.
    """
    turns = written(turns_of(conversations), "turns")
    if shared is not None:
        turns = written(rebuilt(turns, conversations, shared, base), "rebuilt")
    rows = written(named_prefixes(turns), "prefixes")
    ids = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv")).distinct()
    root = ids.select(F.lit("").alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv", F.lit(0).cast("long").alias("chars"))
    every = root.unionAll(rows.select("node", "parent", "i", "conv", "chars"))
    nodes = every.groupBy("name").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    nodes = written(ordered(nodes, ["parent", "conv"]), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    held = nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    held = written(held.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}), "held")
    above = held.where("n_children > 0").select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"), F.col("n_children").alias("_n"))
    told = spread_join(held.select("name", "parent", "depth", "conv", "n_convs", "n_children", "n"), above, ["parent"], "_n")
    return told.join(subtree_sums(held, ["n_leaves", "saved_tokens"]), "n").join(_ends(ids, rows), "name", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def _ends(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the nodes where conversations end. Their ids are joined to text by ranges of ids, then range by range, as a SHA-256 takes its text in order."""
    last = rows.groupBy("conv").agg(F.max_by("node", "i").alias("name"))
    at = ids.join(last, "conv", "left").select("conv", F.coalesce("name", F.lit("")).alias("name"))
    parts = at.groupBy("name", F.floor(F.col("conv") / PIECE).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("text"))
    whole = parts.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("range", "text"))).alias("parts"))
    return whole.select("name", F.sha2(F.array_join(F.col("parts.text"), ","), 256).alias("ends_sha256"))
