"""Repair of damaged conversations by weighted CYK parsing over spans of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block; all spans within a block are parsed, with all their splits.
BLOCK = 8
#: Characters that count as space.
SPACE = " \t\n\x0b\x0c\r"

# The language of role initials, (s?(ua)+)?, read by an automaton: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
READ = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
#: The nonterminals: N(p, q) makes the spans whose repaired rows lead from state p to q. In Chomsky normal form: N(p, q) -> N(p, r) N(r, q) for
#: every r between, and N(p, q) -> a row with its edit. Insertions make rows of nothing, so they are closed over beforehand.
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
Cells = dict[tuple[int, int], tuple[int, str]]


def times(left: Cells, right: Cells) -> Cells:
    """Spans one after the other: the least (cost, audit) for each nonterminal."""
    out: Cells = {}
    for (p, r), (c, a) in left.items():
        for (s, q), (d, b) in right.items():
            if r == s:
                out[p, q] = min(out.get((p, q), (c + d, a + b)), (c + d, a + b))
    return out


def inserted() -> Cells:
    """Rows that are inserted where there is none: the closure of single insertions, the empty one included."""
    out: Cells = {(p, p): (0, "") for p in range(4)}
    one = out | {edge: (2, "I") for c in "ua" for edge in READ[c]}
    while (more := times(out, one)) != out:
        out = more
    return out


def terminals() -> dict[str, Cells]:
    """Cells of a single row by its symbol, with insertions before and after it: s, u, a, o (another role), in upper case where its text is cut off, x where it has to go."""
    out = {}
    for symbol in "suaoSUAOx":
        cells: Cells = {(p, p): (3, "D") for p in range(4)}
        if symbol != "x":
            late = int(symbol.isupper())
            edits = [(edge, (2 + late, "R")) for c in "ua" for edge in READ[c]] + [(edge, (late, "K")) for edge in READ.get(symbol.lower(), ())]
            for edge, cell in edits:
                cells[edge] = min(cells.get(edge, cell), cell)
        out[symbol] = times(times(inserted(), cells), inserted())
    return out


def _product(left: Column, right: Column) -> list[Column]:
    """``times`` as columns: arrays with a cell (or null) for each of ``PAIRS``."""
    out = []
    for p, q in PAIRS:
        ways = []
        for k, (s, r) in enumerate(PAIRS):
            if s == p and (r, q) in PAIRS:
                a, b = left[k], right[PAIRS.index((r, q))]
                ways.append(F.when(a.isNotNull() & b.isNotNull(), F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))))
        out.append(F.array_min(F.array(*ways)))
    return out


def parsed_shapes(shapes: DataFrame) -> DataFrame:
    """``shape, cells`` of distinct strings of at most ``BLOCK`` symbols: CYK, all spans by length, all splits of each."""
    spark = shapes.sparkSession
    single = [(s, [cells.get(pair) for pair in PAIRS]) for s, cells in terminals().items()]
    grammar = F.broadcast(spark.createDataFrame(single, "symbol string, cells array<struct<cost: int, audit: string>>"))
    at = shapes.select("shape", F.explode(F.sequence(F.lit(1), F.length("shape"))).alias("start"))
    spans = written(at.withColumn("symbol", F.substr("shape", F.col("start"), F.lit(1))).join(grammar, "symbol").select("shape", "start", F.lit(1).alias("size"), "cells"), "spans")
    for size in range(2, BLOCK + 1):
        left = spans.withColumn("middle", F.col("start") + F.col("size"))
        right = spans.select("shape", F.col("start").alias("middle"), F.col("size").alias("more"), F.col("cells").alias("others"))
        pairs = left.join(right, ["shape", "middle"]).where(F.col("size") + F.col("more") == size)
        cut = pairs.select("shape", "start", *(c.alias(f"c{k}") for k, c in enumerate(_product(F.col("cells"), F.col("others")))))
        best = cut.groupBy("shape", "start").agg(*(F.min(f"c{k}").alias(f"c{k}") for k in range(len(PAIRS))))
        longer = written(best.select("shape", "start", F.lit(size).alias("size"), F.array(*(f"c{k}" for k in range(len(PAIRS)))).alias("cells")), "spans")
        spans = spans.unionAll(longer)
    return spans.where(F.col("size") == F.length("shape")).select("shape", "cells")


def parsed(symbols: DataFrame) -> DataFrame:
    """``key, cost, audit`` of ``key, i, symbol`` (rows from 1): the cheapest repair of each conversation, of equally cheap ones that of the least audit.

    Equal blocks of rows are parsed once. Longer spans, of twice as many blocks in each round, are
    parsed from one split each: as nonterminals are pairs of states, any split of a span gives the
    same cells. The least (cost, audit) of a span is the least of its parts put together, since of two
    audits of equal cost for the same rows none begins with the other: what followed could
    only be insertions, which cost.
    """
    block = F.expr(f"(i - 1) div {BLOCK}").alias("block")
    held = symbols.groupBy("key", block).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "symbol"))), lambda x: x["symbol"]), "").alias("shape"))
    held = written(held, "blocks")
    cells = written(parsed_shapes(written(held.select("shape").distinct(), "shapes")), "parsed")
    rows = written(held.join(cells, "shape").select("key", "block", "cells"), "cells")
    most = rows.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0]
    whole = rows.where("block = 0") if not most else rows.join(rows.where("block = 1").select("key"), "key", "left_anti")
    rest = rows.join(rows.where("block = 1").select("key"), "key", "left_semi")
    while most:
        odd = F.col("block") % 2 == 1
        two = rest.groupBy("key", F.expr("block div 2").alias("block")).agg(F.max(F.when(~odd, F.col("cells"))).alias("left"), F.max(F.when(odd, F.col("cells"))).alias("right"))
        rest = written(two.select("key", "block", F.when(F.col("right").isNull(), F.col("left")).otherwise(F.array(*_product(F.col("left"), F.col("right")))).alias("cells")), "cells")
        most //= 2
        if not most:
            whole = whole.unionByName(rest)
    best = F.least(F.col("cells")[PAIRS.index((0, 0))], F.col("cells")[PAIRS.index((0, 3))])
    return whole.select("key", best["cost"].cast("long").alias("cost"), best["audit"].alias("audit"))


def with_faults(conversations: DataFrame) -> DataFrame:
    """``key, i, turn, role, text, initial, fault, fresh``: rows in order, with their first fault: blank, duplicate, truncated or none. ``fresh``: first row of its turn.

    Rows go by turn (null first), then role and text. Null counts as one space, in ``conv_id`` too (as ``key``).
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "turn", space("role"), space("text"))
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"i": F.row_number().over(order).cast("long"), "fresh": ~F.col("turn").eqNullSafe(F.lag("turn").over(order)) & F.col("turn").isNotNull(), "_before": F.lag(F.substring("role", 1, 1)).over(order)})
    again = F.row_number().over(Window.partitionBy("key", "role", F.sha2("text", 256)).orderBy("i")) > 1
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(end == "", "blank").when(again, "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("none")
    initial = F.substring("role", 1, 1)
    illegal = F.col("_before").isNotNull() & ~F.concat("_before", initial).isin("su", "ua", "au")
    return rows.select("key", "i", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"), "fresh", illegal.alias("illegal"))


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """``key, o, role, text, edit``: the rows that are left or put in, from 1; rows: of ``with_faults``; repairs: of ``parsed``."""
    letters = repairs.select("key", F.posexplode(F.split("audit", "")).alias("j", "edit")).where("edit <> ''")
    so_far = Window.partitionBy("key").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    letters = letters.withColumns({"i": F.sum((F.col("edit") != "I").cast("long")).over(so_far), "o": F.sum((F.col("edit") != "D").cast("long")).over(so_far)}).where("edit <> 'D'")
    own = rows.select("key", "i", F.col("role").alias("its"), "text", "initial")
    told = letters.join(own.withColumn("edit", F.lit("K")).unionAll(own.withColumn("edit", F.lit("R"))), ["key", "i", "edit"], "left")
    first = F.max((F.col("o") == 1) & (F.col("edit") == "K") & (F.col("initial") == "s")).over(Window.partitionBy("key"))
    role = F.when((F.col("o") + first.cast("int")) % 2 == 1, "user").otherwise("assistant")
    return told.select("key", "o", F.when(F.col("edit") == "K", F.col("its")).otherwise(role).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report, a row for each conversation that has rows, and the repaired rows, of ``conv_id, turn, role, text``.

    Report: ``key, gaps, blank, duplicate, truncated, illegal, cost, audit``. Keeping a row costs 0,
    another role (user or assistant) 2, dropping it 3, which blank rows and repetitions have to be,
    inserting an empty row 2; a truncated row that stays costs 1 more. The repaired initials are
    ``(s?(ua)+)?``; ``audit`` has K, R, D and I in order, the least of the cheapest. Roles whose
    initial is none of s, u, a, or that are empty, cannot be kept.

    Null counts as one space; of equal turn numbers role and text decide; repeated rows are
    duplicates. An empty table gives two empty ones. Other columns are not read. The rows of
    one conversation are numbered in one task, as a stream, and its repaired text is one value.
    """
    rows = written(with_faults(conversations), "rows")
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    repairs = written(parsed(rows.select("key", "i", symbol.alias("symbol"))), "repairs")
    count = lambda c: F.count(F.when(c, 1))
    told = rows.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("fresh")), F.lit(0)).cast("long").alias("gaps"),
        *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")),
        count(F.col("illegal")).alias("illegal"),
    )
    return told.join(repairs, "key"), repaired_turns(rows, repairs)


def repaired_text(turns: DataFrame) -> DataFrame:
    """``key, repaired``: ``role:text`` of the repaired rows, a line each."""
    return turns.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.concat("role", F.lit(":"), "text").alias("line")))), lambda x: x["line"]), "\n").alias("repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that a stream of them has, by the CRC-32 of ``conv_id:turn`` modulo 20: 0 lost, 1 text empty, 2 without ``.!?``, 3 twice, 4 said by the user. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), hit.alias("_hit")).where("_hit <> 0")
    text = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_hit") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.when(F.col("_hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), twice.alias("_copy")).drop("_copy")
