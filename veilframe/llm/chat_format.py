"""Chat formatting: reply trees to conversations, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Control strings of the template. Inside texts ``<`` + backslashes + ``|`` gets one backslash more, so neither occurs there.
TURN, END, BREAK = "<|turn|>", "<|end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    """``text`` without any control string; ``unescape`` gives it back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def reply_paths(nodes: DataFrame, keep: int = 1, rounds: int = 40) -> DataFrame:
    """Root-to-leaf paths of reply trees: ``tree, path, node, depth`` for the ``keep`` best leaves of each tree.

    nodes: ``tree, node, parent, score`` (node: long, unique in its tree). A parent that is null or
    not in the tree makes a root. A path's score is the sum over its nodes (null: 0); ties go to
    the deeper, then to the smaller leaf, whose id is ``path``. Each round of self-joins doubles
    the distance that is bridged, so a thread of n replies takes log2 n rounds. A reply cycle is
    an error.
    """
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
    known = base.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    same = F.col("tree").eqNullSafe(F.col("t"))
    level = base.join(known, same & (F.col("parent") == F.col("n")), "left").select("tree", "node", F.col("n").alias("up"), F.lit(1).alias("depth"), "total")
    levels = [written(level, "reply")]
    while not levels[-1].where("up is not null").isEmpty():
        if len(levels) > rounds:
            raise ValueError("replies form a cycle")
        now = levels[-1]
        above = now.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        joined = now.where("up is not null").join(above, same & (F.col("up") == F.col("n")))
        levels.append(written(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("s2")).alias("total")).unionByName(now.where("up is null")), "reply"))
    done = levels[-1].select("tree", "node", "depth", "total")
    parents = levels[0].where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = done.join(parents, same & (F.col("node") == F.col("n")), "left_anti")
    best = F.struct("total", "depth", (-F.col("node")).alias("last"))
    if keep == 1:
        chosen = leaves.groupBy("tree").agg(F.max(best).alias("b")).select("tree", (-F.col("b.last")).alias("node"))
    else:
        chosen = leaves.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(best.desc()))).where(F.col("r") <= keep).select("tree", "node")
    marked = chosen.select("tree", F.col("node").alias("path"), "node")
    for level in reversed(levels[:-1]):
        up = level.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        marked = written(marked.unionByName(marked.join(up, same & (F.col("node") == F.col("n"))).select("tree", "path", F.col("up").alias("node"))), "marked")
    depth = done.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return marked.join(depth, same & (F.col("node") == F.col("n"))).select("tree", "path", "node", "depth")


def format_threads(rows: DataFrame, tree_col: str = "conv_id", node_col: str = "node", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score: Column | None = None, keep: int = 1, loss_role: str = "assistant") -> DataFrame:
    """One formatted conversation for each chosen path: ``<tree_col>, path, formatted, loss_spans``.

    ``formatted`` is the turns from root to leaf, each as ``<|turn|>role\\ntext<|end|>\\n``.
    ``loss_spans`` is an array of (start, length) in code points, from 0: the texts of
    ``loss_role``. Null roles and texts count as empty; line breaks in a role are written as
    ``<|nl|>``. A node that stands in several rows of a tree counts once, by the smallest of its
    (parent, role, text, score), nulls first; rows without a node are left out, a null tree is a tree.
    Other columns are not read; an empty table gives no rows.
    """
    score = F.lit(0.0) if score is None else score
    turns = rows.select(F.col(tree_col).alias("tree"), F.col(node_col).cast("long").alias("node"), F.col(parent_col).cast("long").alias("parent"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), score.alias("score"))
    one = turns.where("node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("row"))
    turns = written(one.select("tree", "node", "row.*"), "turns")
    paths = reply_paths(turns, keep)
    said = turns.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    on = paths.join(said, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    head = F.concat(F.lit(TURN), F.regexp_replace(escape(F.col("role")), "\n", BREAK.replace("|", r"\|").replace("\\", "")), F.lit("\n"))
    on = on.select("tree", "path", "depth", (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("tree", "path").orderBy("depth")
    size = F.length("head") + F.length("body") + len(END)
    on = on.withColumn("at", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END))
    piece = F.struct("depth", F.concat("head", "body", F.lit(END)).alias("piece"), F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length")).alias("span"), "loss")
    whole = on.groupBy("tree", "path").agg(F.array_sort(F.collect_list(piece)).alias("all"))
    return whole.select(
        F.col("tree").alias(tree_col),
        "path",
        F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.transform(F.filter("all", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"),
    )


def as_threads(rows: DataFrame, tree_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row replies to the one before it, by turn, then role and text (nulls first)."""
    order = Window.partitionBy(tree_col).orderBy(turn_col, role_col, text_col)
    node = F.row_number().over(order).cast("long")
    return rows.select(tree_col, role_col, text_col, node.alias("node")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, r"<\|end\|>\n")
    role = lambda x: unescape(F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"^<\|turn\|>([^\n]*)\n", 1), r"<\|nl\|>", "\n"), r"\A\z", ""))
    text = lambda x: unescape(F.regexp_replace(x, r"\A<\|turn\|>[^\n]*\n", ""))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
