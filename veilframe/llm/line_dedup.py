"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OTHER, Hashed, bucket_links, mix, spread_join, text_slices, tidy, written
from .tokens import drop_encoder

_WORD = (1 << 64) - 1
#: Which of the first code points are letters or digits; those above count as such.
_ALNUM = np.array([chr(c).isalnum() for c in range(1 << 16)] + [True])
#: The bit of a parity sketch that a code point toggles (by its lower 16 bits), and odd factors that hash pairs of them: any fixed values do.
_BIT = np.uint64(1) << (mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64)) >> np.uint64(58))
_LEFT, _RIGHT = OTHER[0], OTHER[1]


def within(a: str, b: str, most: int) -> bool:
    """Is the edit distance at most ``most`` (up to 31)? Bit-parallel over a band of diagonals, after common ends are cut off."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n <= most:
        return True
    if not m:
        return False
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, dist = _WORD << 63 - most & _WORD, 0, most
    last = 1 << 62
    for j in range(m):
        first = most + j - 63  # of a's characters, the one at the band's lowest bit
        x = at.get(b[j], 0)
        x = (x >> first if first > 0 else x << -first) & _WORD
        d = ((((x & up) + up) ^ up) | x | down) & _WORD
        hp, hn = (down | ~(d | up)) & _WORD, d & up
        if j < n - most:  # along the lowest diagonal
            dist += not d >> 63
        else:  # along the last row
            dist += bool(hp & last) - bool(hn & last)
            last >>= 1
        if dist > most + (m - j - 1 if j >= n - most else 2 * most):
            return False
        up, down = (hn | ~((d >> 1) | hp)) & _WORD, (d >> 1) & hp
    return dist <= most


def _lines(texts: list[str], least: int, exact: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, and of each line of at least ``least`` characters, or of at least ``exact`` with a letter or digit, its text, number there, bounds, and number among all lines."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(bounds, starts, "right")
    first = np.searchsorted(starts, np.concatenate([[0], bounds[:-1]]))
    number = np.arange(len(starts)) - first[text]
    size, known = ends - starts, np.concatenate([[0], np.cumsum(_ALNUM[np.minimum(points, 1 << 16)])])
    long = (size >= least) | (size >= exact) & (known[ends] > known[starts])
    return points, text[long], number[long], np.stack([starts[long], ends[long]]), np.flatnonzero(long)


def segment_keys(hashed: Hashed, start: np.ndarray, end: np.ndarray, errors: int) -> np.ndarray:
    """Keys (rows) by which two lines within ``errors`` edits meet, for each line (columns).

    A line of length l is cut into errors + 1 even segments; one of them is intact in any line
    within reach. Longer or equal lines probe it at the places where, counting the edits to its
    left and right, it can stand.
    """
    size, parts, keys = end - start, errors + 1, []
    for more in range(parts):
        length = size - more
        base, rest = length // parts, length % parts
        for i in range(parts):
            grown = np.maximum(0, i - (parts - rest))
            at, n = i * base + grown, base + (i >= parts - rest)
            for shift in range(max(-i, more - (errors - i)), min(i, more + errors - i) + 1):
                lo = start + at + shift
                fits = (at + shift >= 0) & (lo + n <= end) & (n > 0)
                lo = np.where(fits, lo, start)
                key = mix(hashed.of(lo, np.where(fits, lo + n, start)) ^ mix((length * parts + i).astype(np.uint64)))
                own = mix(mix(hashed.of(start, end)) ^ np.uint64(len(keys) + 1))  # meets nobody
                keys.append(np.where(fits, key, own))
    return np.stack(keys)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _line_keys(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """``key, id`` of the rows ``line, text``: a row for each of the line's segment keys."""
    for batch in batches:
        line = batch.column(0).to_numpy()
        for lo, hi, texts in text_slices(batch.column(1), 1 << 18):
            points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
            end = np.flatnonzero(points == 10)
            keys = segment_keys(Hashed(points), np.concatenate([[0], end[:-1] + 1]), end, errors)
            yield pa.RecordBatch.from_arrays([_signed(keys.T.ravel()), pa.array(np.repeat(line[lo:hi], len(keys)))], names=["key", "id"])


def _cut_lines(batches: Iterator[pa.RecordBatch], least: int, exact: int) -> Iterator[pa.RecordBatch]:
    """A row for each line; the first row of a line in a slice of texts has its text, if it is long enough."""
    drop_encoder()
    for batch in batches:
        for lo, _, texts in text_slices(batch.column("text"), 1 << 18):
            points, text, number, (start, end), place = _lines(texts, least, exact)
            if not len(text):
                continue
            cut = "\n".join([*texts, ""]).encode("utf-8", "surrogatepass").split(b"\n")
            digest = b"".join(blake2b(cut[k], digest_size=16).digest() for k in place.tolist())
            line, check = np.frombuffer(digest, np.uint64).reshape(-1, 2).T
            wide = points.astype(np.uint64)
            pair = wide[:-1] * _LEFT + wide[1:] * _RIGHT
            bit = np.append(np.uint64(1) << (pair >> np.uint64(58)), np.uint64(0))
            sketch = np.bitwise_xor.reduceat(bit, np.stack([start, end - 1], 1).ravel())[::2]
            letters = np.bitwise_xor.reduceat(_BIT[points & 0xFFFF], np.stack([start, end], 1).ravel())[::2]
            has = np.zeros(len(line), bool)
            has[np.unique(line ^ mix(check), return_index=True)[1]] = True
            has &= end - start >= least
            whole, words = "\n".join([*texts, ""]), np.full(len(line), None, object)
            words[has] = [whole[a:b] for a, b in zip(start[has].tolist(), end[has].tolist(), strict=True)]
            at = pa.array(text + lo)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number.astype(np.int32)), _signed(line), _signed(check), pa.array((end - start).astype(np.int32)), _signed(sketch), _signed(letters), pa.array(has), pa.array(words, pa.string())],
                names=["id", "row", "number", "line", "check", "size", "sketch", "letters", "has", "text"],
            )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = 2, least: int = 24, exact: int = 1) -> DataFrame:
    """``docs`` with every repeated line removed from ``text_col``; ``n_lines`` and ``n_dropped`` are added (and replace columns of these names).

    Lines (between line breaks) of at least ``least`` characters form classes: lines within
    ``errors`` (up to 15) edits are linked, links chain. Shorter lines of at least ``exact`` characters that hold a
    letter or digit form classes of equal lines. Of each class the first line in order of (id, row's
    text hash, line number) stays, all others go; ids order as Spark sorts them, null first.
    All other lines, empty and null texts stay as they are. Rows that share id and text are treated
    alike: their lines count once. All columns and rows stay.

    One pass over the texts writes a table of lines, each with the 128 bits of its BLAKE2b digest, by which lines are
    equal; a second, over the long lines, makes the keys of ``segment_keys`` (segment,
    its number, the line's length), which go straight into their exchange. Lines that share a key are kept apart by length and by parity sketches of
    letters and letter pairs, and links are confirmed by ``within`` on the lines themselves.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    docs = docs.select(*(F.col(f"`{c}`") for c in names))
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("row"), text.alias("text")).where(F.length(text) >= max(1, min(least, exact)))
    kind = rows.schema["id"].dataType.simpleString()
    columns = f"id {kind}, row long, number int, line long, check long, size int, sketch long, letters long, has boolean, text string"
    lines = written(rows.mapInArrow(lambda it: tidy(_cut_lines(it, least, max(1, exact))), columns), "lines")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [within(a, b, errors) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    each = lines.groupBy("line", "check").agg(
        F.count("*").alias("n"), F.min("id").alias("low"), F.max(F.col("id").isNull()).alias("null_id"), F.min(F.when(F.col("has"), F.col("id"))).alias("has_id"), F.min("size").alias("size"), F.min("sketch").alias("sketch"), F.min("letters").alias("letters")
    )
    each = written(each.withColumn("node", F.monotonically_increasing_id()), "each")
    long = each.where(F.col("size") >= least)

    def texts(ids: DataFrame) -> DataFrame:
        wanted = long.join(ids, F.col("node") == F.col("id")).select("line", "check", F.col("has_id").alias("id"), "node")
        held = lines.where("has").select(F.col("line").alias("l"), F.col("check").alias("c"), F.col("id").alias("i"), "text")
        found = wanted.join(held, (F.col("line") == F.col("l")) & (F.col("check") == F.col("c")) & F.col("id").eqNullSafe(F.col("i")))
        return found.groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))

    bits = lambda a, b, c: F.bit_count(a[c].bitwiseXOR(b[c]))
    near = lambda a, b: (F.abs(a["size"] - b["size"]) <= errors) & (bits(a, b, "letters") <= 2 * errors) & (bits(a, b, "sketch") <= 4 * errors)
    facts = long.select(F.col("node").alias("id"), F.struct("size", "sketch", "letters").alias("fact"))
    nodes = long.select(F.col("line").alias("id"), "node")
    members = lines.where("has").select("line", "text").mapInArrow(lambda it: tidy(_line_keys(it, errors)), "key long, id long")
    comps = bucket_links(members, facts, near, texts, lambda pairs: pairs.mapInArrow(lambda it: tidy(confirm(it)), "a long, b long"), named=lambda found: found.join(nodes, "id").select("key", F.col("node").alias("id")))

    #: Lines that stand more than once, by themselves or with those they are linked to, with the first id of their class.
    linked = each.join(comps, F.col("node") == F.col("id")).select("line", "check", "n", F.col("comp").alias("class"), "low", "null_id")
    first = linked.groupBy("class").agg(F.min("low").alias("low"), F.max("null_id").alias("null_id"))
    linked = linked.select("line", "check", "n", "class").join(first, "class").select("line", "check", "n", "class", "low", "null_id")
    alone = each.where("n > 1").join(comps, F.col("node") == F.col("id"), "left_anti").select("line", "check", "n", F.col("node").alias("class"), "low", "null_id")
    many = written(linked.unionByName(alone), "many")
    found = spread_join(lines.select("id", "row", "number", "line", "check"), many, ["line", "check"]).where("class is not null")
    opens = F.when(F.col("null_id"), F.col("id").isNull()).otherwise(F.col("id") == F.col("low"))
    found = written(found.select("id", "row", "number", "class", opens.alias("opens")), "found")
    place = F.struct("row", "number")
    inner = found.where("opens")
    later = inner.join(inner.groupBy("class").agg(F.min(place).alias("place")), "class").where(place != F.col("place"))
    gone = found.where("not opens").select("id", "row", "number").unionByName(later.select("id", "row", "number"))
    gone = gone.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("number").alias("_gone"))
    joined = docs.withColumn("_text", text).join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_row")), "left")
    new = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.filter(F.split("_text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    lines_n = F.coalesce(F.size(F.split("_text", "\n")), F.lit(0))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in names), F.when(F.col("_text").isNull(), 0).otherwise(lines_n).alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_dropped"))
