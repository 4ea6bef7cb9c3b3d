"""MinHash near-dedup: a multi-index Hamming join over b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Digests, bucket_links, mix, spread_join, text_slices, tidy, with_texts, written
from .tokens import drop_encoder

#: A signature has CHUNKS longs of LANES minhashes of BITS bits each.
CHUNKS, LANES, BITS = 16, 5, 12
#: Pigeonhole: of two signatures that differ in at most DISTANCE places, some chunk differs in at most one.
DISTANCE = 2 * CHUNKS - 1
#: Longs of the parity sketch: each shingle toggles one of its bits.
PARITY = 16
_SEEDS = np.random.default_rng(7).integers(1, 2**63, (2, CHUNKS * LANES), dtype=np.uint64)
#: Rows that agree in these are one node: size, two fingerprints, and where they were found to differ, the text's hash.
_SAME = ["n", "p0", "p1", "split"]
_PARTS = [*(f"s{c}" for c in range(CHUNKS)), *(f"x{c}" for c in range(PARITY))]
_ODD, _FLIP = _SEEDS[0] | np.uint64(1), _SEEDS[1]


_WORDS = Digests()


def _shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, made of a digest of each word."""
    out = []
    for text in texts:
        cut = text.lower().split()
        n = len(cut)
        one = np.fromiter(map(_WORDS.__getitem__, cut), np.uint64, n)
        if n >= words:
            many = np.zeros(n - words + 1, np.uint64)
            for k in range(words):
                many = mix(many + one[k : n - words + 1 + k])
            out.append(np.unique(many))
        else:  # all words as one shingle; none without words
            whole = np.uint64(n)
            for w in one:
                whole = mix(np.array([w]) ^ mix(np.array([whole])))[0]
            out.append(np.array([whole][: bool(n)], np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    drop_encoder()
    for batch in batches:
        for lo, hi, texts in text_slices(batch.column(2).cast(pa.binary()), 1 << 19):
            sets = _shingles(texts, words)
            n = np.array([len(s) for s in sets], np.int64)
            flat, start = np.concatenate(sets), np.concatenate(([0], np.cumsum(n)[:-1]))
            full = n > 0
            sig = np.zeros((len(sets), CHUNKS), np.uint64)
            prints = np.zeros((2, len(sets)), np.uint64)
            odd = np.zeros((len(sets), PARITY), np.uint64)
            np.bitwise_xor.at(odd, (np.repeat(np.arange(len(sets)), n), (flat >> np.uint64(6)).astype(np.int64) % PARITY), np.uint64(1) << (flat & np.uint64(63)))
            if full.any():
                for k in range(CHUNKS * LANES):
                    least = np.minimum.reduceat((flat ^ _FLIP[k]) * _ODD[k], start[full])
                    sig[full, k // LANES] |= (mix(least) >> np.uint64(64 - BITS)) << np.uint64(BITS * (k % LANES))
                prints[0, full] = np.add.reduceat(flat, start[full])
                prints[1, full] = np.add.reduceat(mix(flat ^ _FLIP[0]), start[full])
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(n), *(pa.array(_signed(p)) for p in prints), *(pa.array(_signed(sig[:, c])) for c in range(CHUNKS)), *(pa.array(_signed(odd[:, c])) for c in range(PARITY))], names=["id", "hash", "n", "p0", "p1", *_PARTS])


#: In each place of a long, its highest bit, and the bits below that.
_TOP, _REST = (sum(bits << BITS * k for k in range(LANES)) for bits in (1 << BITS - 1, (1 << BITS - 1) - 1))


def _places(a: Column, b: Column, c: int) -> Column:
    """The highest bit of each place of chunk ``c`` in which two signatures differ."""
    x = a[f"s{c}"].bitwiseXOR(b[f"s{c}"])
    # The sum sets a place's highest bit if any of its lower ones is set, without a carry beyond it.
    return (x.bitwiseAND(F.lit(_REST)) + F.lit(_REST)).bitwiseOR(x).bitwiseAND(F.lit(_TOP))


def _apart(a: Column, b: Column) -> Column:
    """Number of places in which two signatures differ."""
    return sum((F.bit_count(_places(a, b, c)) for c in range(CHUNKS)), F.lit(0))


def _first(a: Column, b: Column) -> Column:
    """Is the key, in two signatures that share it, the first of all they share? So each pair is compared in one bucket of all that it meets in."""
    # No earlier chunk agrees in all or all but one of its places; where all of a chunk agree, the key without its first place goes first.
    first = (a["lane"] == 0) | (a["own"] != b["own"])
    for c in range(CHUNKS - 1):
        first = first & ((a["chunk"] <= c) | (F.bit_count(_places(a, b, c)) > 1))
    return first


def _filled(columns: dict[str, Column]) -> Column:
    """A struct of fields that are never null. Spark knows that, so comparing two of them stays below the size of a method that the JVM compiles."""
    return F.struct(*(F.coalesce(c, F.lit(0)).alias(name) for name, c in columns.items()))


def _possible(a: Column, b: Column, percent: int) -> Column:
    """Can two sets be similar enough? Never false for sets that are.

    Bits in which the parity sketches differ stand for shingles that one set has alone, so there
    are at most as many of them as such shingles, and the sizes bound these.
    """
    differ = sum((F.bit_count(a[f"x{c}"].bitwiseXOR(b[f"x{c}"])) for c in range(PARITY)), F.lit(0))
    return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & ((100 + percent) * differ <= (100 - percent) * (a["n"] + b["n"]))


def _keys() -> Column:
    """The bucket keys of a signature, one for each chunk without one place; the lowest seven bits are the key's number."""
    whole = (1 << BITS * LANES) - 1
    key = lambda c, k: F.xxhash64(F.lit(c * LANES + k), F.col(f"s{c}").bitwiseAND(F.lit(whole ^ ((1 << BITS) - 1) << BITS * k)))
    return F.array(*(key(c, k).bitwiseAND(F.lit(~127)).bitwiseOR(F.lit(c * LANES + k)) for c in range(CHUNKS) for k in range(LANES)))


def _once(percent: int) -> tuple[Column, Callable[[Column, Column], Column]]:
    """What the last comparison of ``bucket_links`` needs: the facts, with the key's place in them, and whether two are to be compared in this bucket. Most pairs of a large bucket that signatures let through are ruled out by the parity sketches."""
    part = {c: F.col(f"fact.{c}") for c in ("n", *_PARTS)}
    number = F.col("key").bitwiseAND(F.lit(127)).cast("int")
    chunk = F.floor(number / LANES).cast("int")
    ready = _filled({**part, "chunk": chunk, "lane": number % LANES, "own": F.array(*(part[c] for c in _PARTS[:CHUNKS]))[chunk]})
    return ready, lambda a, b: _possible(a, b, percent) & _first(a, b)


def _confirm(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts, those whose shingle sets, words compared in full, are similar enough."""

    def full(text: str | None) -> set:
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)}

    last, left = None, set()
    for batch in batches:
        keep = []
        for ta, tb in zip(batch.column(2), batch.column(3), strict=True):
            if (ta := ta.as_py()) != last:
                last, left = ta, full(ta)
            right = full(tb.as_py())
            both = len(left & right)
            keep.append(100 * both >= percent * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _classes(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """``id, hash, n, comp, first`` for each row of ``rows(id, hash, text)``; hash: of the text.

    comp: the smallest id of the row's class, null where the row can't be linked (no id, no words);
    first: is the row's (id, hash) the smallest one of its class?
    """
    longs = ", ".join(f"{c} long" for c in _PARTS)
    kind = rows.schema["id"].dataType.simpleString()
    percent = round(100 * similarity)
    sigs = written(rows.mapInArrow(lambda it: tidy(_signatures(it, words)), f"id {kind}, hash long, n long, p0 long, p1 long, {longs}"), "signatures")
    sigs = sigs.withColumn("split", F.lit(0).cast("long"))
    able = sigs.where("id is not null and n > 0")
    odd = _unlike(rows, able, words)
    if odd is not None:
        sigs = written(sigs.join(odd, "hash", "left").withColumn("split", F.coalesce("odd", F.lit(0))).drop("odd"), "signatures")
        able = sigs.where("id is not null and n > 0")
    sets = able.groupBy(*_SAME).agg(F.min(F.struct("id", "hash")).alias("low"), F.count("*").alias("rows"), *(F.first(s).alias(s) for s in _PARTS))
    sets = written(sets.select(F.monotonically_increasing_id().alias("node"), "*"), "sets")
    own = sets.select(*_SAME, "node", "low", "rows")

    def texts(ids: DataFrame, low: str = "low") -> DataFrame:
        """The texts of nodes, found by the id and hash of one of their rows."""
        wanted = ids.join(sets.select(F.col("node").alias("id"), "low"), "id").select(F.col("id").alias("node"), F.col("low.id").alias("id"), F.col("low.hash").alias("hash"))
        return rows.join(wanted, ["id", "hash"]).groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))

    def verify(pairs: DataFrame) -> DataFrame:
        return pairs.mapInArrow(lambda it: tidy(_confirm(it, words, percent)), "a long, b long")

    members = sets.select(F.explode(_keys()).alias("key"), F.col("node").alias("id"))
    facts = sets.select(F.col("node").alias("id"), _filled({c: F.col(c) for c in ("n", *_PARTS)}).alias("fact"))
    comps = bucket_links(members, facts, lambda a, b: _possible(a, b, percent) & (_apart(a, b) <= DISTANCE), texts, verify, once=_once(percent))
    linked = written(comps.join(own.select(F.col("node").alias("id"), "low"), "id").select(F.col("id").alias("node"), F.col("comp").alias("class"), "low"), "linked")
    least = linked.groupBy("class").agg(F.min("low").alias("least"))
    named = own.join(linked.join(least, "class").select("node", "least"), "node", "left").select(*_SAME, "rows", F.coalesce("least", "low").alias("least"))
    told = spread_join(sigs.select("id", "hash", *_SAME), written(named, "named"), _SAME, "rows")
    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    return told.select("id", "hash", "n", F.when(linkable, F.col("least.id")).alias("comp"), F.coalesce(F.struct("id", "hash") == F.col("least"), F.lit(False)).alias("first"))


def _unlike(rows: DataFrame, able: DataFrame, words: int) -> DataFrame | None:
    """Rows that share size and both fingerprints of a set, but not the text, are compared with one of them on the full sets; ``hash, odd`` of those whose sets differ after all, if there are any. They become nodes by themselves."""
    firsts = able.groupBy("n", "p0", "p1").agg(F.min(F.struct("id", "hash")).alias("low"), F.count("*").alias("rows")).where("rows > 1")
    alike = spread_join(able.select("id", "hash", "n", "p0", "p1"), written(firsts, "firsts"), ["n", "p0", "p1"], "rows")
    pairs = written(alike.where("low is not null and hash <> low.hash").groupBy(F.col("low.hash").alias("a"), F.col("hash").alias("b")).agg(F.min("id").alias("id"), F.min("low.id").alias("low")), "alike")
    if pairs.isEmpty():
        return None
    wanted = pairs.select(F.col("low").alias("id"), F.col("a").alias("hash")).unionByName(pairs.select("id", F.col("b").alias("hash"))).distinct()
    texts = written(rows.join(wanted, ["id", "hash"]).groupBy(F.col("hash").alias("id")).agg(F.min("text").alias("text")), "texts")
    same = with_texts(pairs.select("a", "b"), texts).mapInArrow(lambda it: tidy(_confirm(it, words, 100)), "a long, b long")
    odd = written(pairs.select("a", "b").join(same, ["a", "b"], "left_anti").select(F.col("b").alias("hash"), F.col("b").alias("odd")).distinct(), "odd")
    return None if odd.isEmpty() else odd


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Class of every document among documents whose word-shingle sets have a Jaccard similarity of at least ``similarity``.

    Returns one row per row of ``docs``: ``<id_col>, n_shingles, component_id, kept``. Words are
    runs of anything but ASCII white space, A-Z lower-cased; a text with fewer words than
    ``words`` is one shingle; one without words, or null, has none and is linked with nothing.
    ``component_id`` is the smallest id reachable over links, ``kept`` marks the row that is it.

    Method: 80 minhashes of 12 bits stand in 16 chunks. Two signatures that differ in at most 31
    places agree, in some chunk, in all or all but one of its 5 places, so the 16 x 5 keys "chunk
    without one place" bring every such pair into one bucket. A pair at similarity 0.8 differs in
    more than 31 places with a probability below 0.0001, more similar ones more rarely still.
    Rows with equal sets become one node beforehand, so large groups of copies count once; texts
    that differ are compared for that on their full sets. Buckets are compared by
    ``bucket_links``, which leaves out pairs that sizes and parity sketches rule out; each link is
    confirmed on the full sets of words.

    Rows that share an id share the smallest class that one of them is in; null ids are linked with
    nothing and kept. Only id and text are read, so other columns may have any name. An empty table
    gives no rows.
    """
    text = F.col(text_col).cast("string")
    found = _classes(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")), words, similarity)
    found = written(found, "classes")
    told = found.select("id", "n").join(found.where("comp is not null").groupBy("id").agg(F.min("comp").alias("comp")), "id", "left")
    comp = F.coalesce("comp", "id")
    return told.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("id").eqNullSafe(comp).alias("kept"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does, with all their columns.

    Of a class the row with the smallest id stays, among rows that share this id the one whose text
    has the smallest hash, among full repeats of it one. Rows without an id or without words stay.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found = _classes(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")), words, similarity)
    told = written(found.where("comp is not null").groupBy("id", "hash").agg(F.max("first").alias("first"), F.count("*").alias("rows")), "classes")
    marked = docs.withColumns({"_id": F.col(f"`{id_col}`"), "_hash": F.xxhash64(text)})
    keys = ["_id", "_hash"]
    named = told.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"), "first", "rows")
    stay = marked.join(named.where("not first").select(*keys), keys, "left_anti")
    again = named.where("first and rows > 1").select(*keys)
    one = stay.join(again, keys, "left_semi").dropDuplicates(keys)
    return stay.join(again, keys, "left_anti").unionByName(one).drop(*keys)
