"""Shared pieces of the operators: written tables, components, bucketed pair search."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; on a cluster, where such a folder
    would not be shared, this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _LOCAL.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="veilframe-")
        _LOCAL[context.applicationId] = found
    return found.rstrip("/")


#: Spark removes the shuffle files of a query when it ends, instead of when the driver next collects its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back.

    This cuts the lineage: a lost executor repeats at most the stage it was in. A job reads the
    table as often as it likes; the folder may be cleared once the result has been consumed. Once the
    table is there its shuffle files and broadcasts are of no more use and go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_TIDY)
        else:
            spark.conf.set(_TIDY, before)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Free what broadcasts of finished queries hold on executors.

    Spark takes them back when the driver collects its garbage, and a driver with free memory may not do so for
    half an hour. A broadcast side of a join on several keys is 16 MB on each executor, be it one row.
    """
    spark.sparkContext._jvm.System.gc()


#: A key is hot if it has more than one in HOT of all rows, so there are fewer hot keys than this; each is dealt out over SALTS places.
HOT, SALTS = 1000, 64
#: Members of a bucket that one task compares with the bucket, about; a larger bucket is cut into as many tiles as it takes.
TILE = 4096


def spread_join(big: DataFrame, small: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """``big`` left-joined with ``small``, which has one row for each key ``on`` and in ``n`` how many of big's rows have it.

    The hot keys, fewer than ``HOT``, are broadcast, nothing else of them; their rows in ``big`` are
    dealt out by a hash of the whole row, and their rows in ``small`` are repeated for each place.
    ``small`` is read more than once and should be a written table; nulls in keys match nothing.
    Returns big's columns and those of ``small`` but for ``on`` and ``n``.
    """
    rest = [c for c in small.columns if c not in (*on, n)]
    total = small.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    flag = F.broadcast(small.where(hot).select(*on, F.lit(True).alias("_hot")))
    salted = big.join(flag, on, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*big.columns), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    places = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    side = small.select(*on, F.explode(places).alias("_salt"), *rest)
    return salted.join(side, [*on, "_salt"], "left").select(*big.columns, *rest)


def _with_least(edges: DataFrame, x: str, y: str, places: int = 8) -> DataFrame:
    """``edges(x, y)`` with ``m``, the least ``y`` of each ``x``; the edges of one ``x`` are dealt out over ``places`` places, for each of which its row is repeated."""
    low = edges.groupBy(x).agg(F.min(y).alias("m"))
    low = low.select(x, "m", F.explode(F.array(*(F.lit(k).cast("long") for k in range(places)))).alias("_salt"))
    return edges.withColumn("_salt", F.pmod(F.xxhash64(y), F.lit(places))).join(low, [x, "_salt"]).drop("_salt")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``: ``id, comp``.

    Alternates the large-star and small-star steps until the edges are stars; each step is one
    grouped minimum (pre-aggregated before its shuffle) and one join, in which the edges of a node
    with very many neighbours are dealt out. Rows with a null end or equal ends carry no link.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionAll(e.select("v", F.lit(0), F.lit(1)))
        loose = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up > 1 or (up = 1 and low = 1)")
        if loose.isEmpty():
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select("v", "u"))
        large = _with_least(both, "x", "y").where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v")).distinct()
        told = _with_least(large, "u", "v")
        small = told.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(told.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def bucket_links(members: DataFrame, facts: DataFrame, near: Callable[[Column, Column], Column], texts: Callable[[DataFrame], DataFrame], verify: Callable[[DataFrame], DataFrame], rounds: int = 2, named: Callable[[DataFrame], DataFrame] | None = None, once: tuple[Column, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """Components of all pairs that share a bucket and pass ``verify``, without listing a bucket's pairs.

    members: ``key, id`` (a row for each bucket a node is in; rows may repeat); facts: ``id, fact`` (fact: a
    struct that ``near`` compares, as a necessary condition); texts: ``id`` to ``id, text``, one row
    each; verify: ``a, b, ta, tb`` to the ``a, b`` of those that are linked; named: ``key, id`` to the same with the ids
    by which facts and texts go, where those of ``members`` are others; once: for the last comparison, an expression over ``key``
    and ``fact`` for what is compared there and a condition on two of these, which has to hold in one bucket for each pair that ``near`` takes;
    without it, a pair that several buckets share leaves the join as often. Returns ``id, comp`` for the nodes that have a link.

    One exchange of (key, id) finds the buckets with more than one node; only for their nodes are
    texts fetched, once. Then, in each of ``rounds`` rounds, one node of every bucket that still
    holds several components, a pivot, is compared with the members of the others, and what the
    links join is settled: a bucket of copies costs as many comparisons as it has members. At last
    all members that are not pivots and are still in different components are compared, so each
    pair of a bucket has been compared or is known to be in one component. Here members of a bucket's
    largest component meet those of the others only, and go out once, while the others, few in a bucket of
    near copies, are repeated for each tile of about ``TILE`` of them; the others are cut into such tiles too,
    and every two of these meet once. Pairs are made of ids and are distinct before texts join them. A node has few of all keys, so even one
    bucket with a third of all nodes is a small share of all (key, id) rows.
    """
    bucket = Window.partitionBy("key")
    ends = members.select("key", "id", F.min("id").over(bucket).alias("low"), F.max("id").over(bucket).alias("high"))
    inside = ends.where("low <> high").select("key", "id").distinct()
    inside = rows = written(inside if named is None else named(inside), "members")
    some = written(texts(inside.select("id").distinct()), "texts")
    comps = None
    for last in [False] * rounds + [True]:
        if comps is None:
            told = rows.withColumn("comp", F.col("id"))
        else:
            told = rows.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        told = told.select("*", F.min("comp").over(bucket).alias("low"), F.max("comp").over(bucket).alias("high"), F.count("*").over(bucket).alias("held")).where("low <> high")
        if last:
            #: Here facts go with the members, so that only pairs that can be linked leave the join.
            size = F.count("*").over(Window.partitionBy("key", "comp"))
            told = told.select("key", "id", "comp", "held", size.alias("size"))
            told = told.select("*", F.max(F.struct("size", "comp")).over(bucket).alias("main"))
            tiles = lambda n: F.ceil(n / TILE).cast("long")
            told = told.select("key", "id", "comp", (F.col("comp") == F.col("main.comp")).alias("most"), tiles(F.col("held") - F.col("main.size")).alias("tiles"), tiles(F.col("main.size")).alias("main_tiles"))
            told = written(told.join(facts, "id"), "mixed")
            if once is not None:
                told = told.withColumn("fact", once[0])
            meet = (near if once is None else once[1])(F.col("fact"), F.col("its"))
            rest = told.where("not most")
            one, other = tiled(rest)
            crossed = (F.col("own") > F.col("tile")) | (F.col("a") < F.col("b"))
            pairs = one.join(other, ["key", "tile"]).where(F.expr("comp <> other") & crossed & meet).select("a", "b")
            most, few = beside(told.where("most"), rest)
            pairs = pairs.unionAll(most.join(few, ["key", "tile"]).where(meet).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            if once is not None:
                pairs = _near(pairs, facts, near)
        else:
            told = written(told.select("key", "id", "comp", "high", F.min(F.when(F.col("comp") == F.col("high"), F.col("id"))).over(bucket).alias("pivot")), "mixed")
            pairs = _near(told.where("comp <> high").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), facts, near)
            rows = told.where("id <> pivot").select("key", "id")
        if told.isEmpty():
            break
        links = written(verify(with_texts(pairs, some)), "links")
        if comps is not None:
            if links.isEmpty():
                continue
            links = links.unionByName(comps.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        comps = written(connected_components(links), "components")
    return comps if comps is not None else inside.select("id", F.col("id").alias("comp")).limit(0)


def tiled(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``told(key, id, comp, tiles, fact)`` as ``key, a, comp, fact, tile`` and ``key, b, other, its, own, tile``: each member's tile, and each member once for its own tile and every lower one.

    So two tiles meet once, and members of a bucket that is one tile are not repeated at all.
    """
    places = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = F.pmod(F.xxhash64("id"), "tiles")
    one = told.select("key", F.col("id").alias("a"), "comp", "fact", own.alias("tile")).repartition(places, "key", "tile")
    other = told.select("key", F.col("id").alias("b"), F.col("comp").alias("other"), F.col("fact").alias("its"), own.alias("own"))
    return one, other.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("tile"))


def beside(most: DataFrame, rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of a bucket's largest component once, ``key, a, fact, tile``, and the others for each of its tiles, ``key, b, its, tile``."""
    places = int(most.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = most.select("key", F.col("id").alias("a"), "fact", F.pmod(F.xxhash64("id"), "main_tiles").alias("tile")).repartition(places, "key", "tile")
    return one, rest.select("key", F.col("id").alias("b"), F.col("fact").alias("its"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("main_tiles") - 1)).alias("tile"))


def _near(pairs: DataFrame, facts: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    fa = facts.select(F.col("id").alias("a"), F.col("fact").alias("fa"))
    fb = facts.select(F.col("id").alias("b"), F.col("fact").alias("fb"))
    return pairs.join(fa, "a").join(fb, "b").where(near(F.col("fa"), F.col("fb"))).select("a", "b")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b`` with the texts of both, ``ta, tb``; texts: a written table ``id, text``, one row an id. An ``a`` that is in very many pairs, as pivots are, is joined by ``spread_join``."""
    pairs = written(pairs, "pairs")
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    counts = pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n"))
    return spread_join(both, texts.join(counts, "id").select(F.col("id").alias("a"), F.col("text").alias("ta"), "n"), ["a"]).select("a", "b", "ta", "tb")


#: Random 64-bit values for bytes and the powers of an odd base: any fixed values do.
_RANDOM = np.random.default_rng(20240229)
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POINT = _RANDOM.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
#: A second table, for a hash that is independent of the first.
OTHER = _RANDOM.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, at least."""
    if len(_POWERS["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for k, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a fixed bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Digests(dict):
    """The first 8 bytes of the BLAKE2b digest of each word, as a number; remembered up to ``most`` bytes of words."""

    def __init__(self, most: int = 1 << 23):
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 100
        if self.held > self.most:
            self.clear()
            self.held = len(word) + 100
        self[word] = found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return found


class Hashed:
    """Hashes of any substrings of bytes, or of code points, from one running sum. Where equality rests on a hash take ``Digests``: long texts of regular build can share one of these."""

    def __init__(self, data: np.ndarray, table: np.ndarray = POINT):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        values = BYTE[data] if data.dtype == np.uint8 else table[data & 0xFFFF]
        if data.dtype != np.uint8 and len(data) and data.max() > 0xFFFF:
            values = values ^ (data >> 16).astype(np.uint64) * table[data >> 16]
        np.cumsum(values * up[: len(data)], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of at most ``most`` in all, or of one larger item."""
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def text_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int, list]]:
    """Consecutive values of a string or binary column, of at most ``most`` bytes at once or one longer value; null counts as empty."""
    empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
    for lo, hi in slices(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), most):
        yield lo, hi, [x or empty for x in column.slice(lo, hi - lo).to_pylist()]


def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; when they end, the worker's unused memory goes back, as workers outlive their tasks."""
    try:
        yield from batches
    finally:
        give_back()


#: The C library's own heap keeps what Python and numpy have freed; only some of them can be told to give it back.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Return unused memory of this process, Arrow's and the C library's, to the system."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def ordered(df: DataFrame, by: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``n``, each row's place (from 0) in ascending order of ``by``, and in place of ``sums`` their running sums, own row included.

    Rows are range-partitioned and sorted within their range, so no key is in one task alone as long
    as ``by`` tells rows apart; numbers and sums of earlier ranges come from one row a range. The
    sorted rows are a written table: what a lost executor repeats gets the same places.
    """
    rows = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    ranges = rows.groupBy("_part").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{c}") for c in sums))
    #: One row for each range, so as many as there are tasks.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranges.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_base") for c in ranges.columns[1:]))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    told = rows.withColumns({f"_run_{c}": F.sum(c).over(inside) for c in sums}) if sums else rows
    place = F.col("_n_base") + F.col("_at").bitwiseAND((1 << 33) - 1)
    rest = [c for c in df.columns if c not in sums]
    return told.join(F.broadcast(bases), "_part").select(*rest, *((F.col(f"_sum_{c}_base") + F.col(f"_run_{c}")).alias(c) for c in sums), place.alias("n"))
