"""Packing of token sequences by lexical retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, tidy, written
from .tokens import encoded, encoder

#: Length of the document vectors by which related documents are brought together.
_WIDE = 64
#: Branches of the tree of cuts, at most, and documents looked at for each to place the cuts: what the driver holds is bounded by their product.
BRANCHES, _LOOKED_AT = 4096, 16
#: Shards that are dealt out together, about.
TOGETHER = 8
#: Terms of the greatest weight from which the parts of a branch are told.
_TOP = 10


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5)).astype(np.float32)


def _counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of each distinct term of each document, in that order."""
    sizes, flat = [len(d) for d in docs], np.concatenate(docs)
    #: Short numbers sort faster.
    kind, bits = (np.uint32, 16) if flat.itemsize <= 2 and len(docs) <= 1 << 16 else (np.uint64, 32)
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(bits), sizes) | flat.astype(kind)
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    tf, key = np.diff(first, append=len(key)), key[first]
    return (key >> kind(bits)).astype(np.int64), (key & kind((1 << bits) - 1)).astype(np.int64), tf.astype(np.float32)


@lru_cache(maxsize=1)
def _signs(n: int) -> np.ndarray:
    bits = mix(np.arange(1, n + 1, dtype=np.uint64)).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(bits, axis=1).astype(np.float32) * 2 - 1


def vectors(docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
    """BM25 term weights of the documents, projected by fixed random signs and brought to length one."""
    doc, term, tf = _counted(docs)
    long = np.array([len(d) for d in docs], np.float32)[doc] / max(mean, 1e-9)
    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long))
    signs, bounds = _signs(len(idf)), np.searchsorted(doc, np.arange(len(docs) + 1)).tolist()
    out = np.empty((len(docs), _WIDE), np.float32)
    for i, (lo, hi) in enumerate(pairwise(bounds)):
        out[i] = weight[lo:hi] @ signs[term[lo:hi]]
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float16).astype(np.float32)


def _moved(row: np.ndarray) -> np.ndarray:
    """A little that differs from document to document, so that any number of copies can be cut apart."""
    return (mix(row.astype(np.uint64)) >> np.uint64(40)).astype(np.float32) / (1 << 24) * 1e-3


def part_of(docs: list[np.ndarray], idf: np.ndarray, parts: int, row: np.ndarray) -> np.ndarray:
    """Part of its branch for each document: by the smallest hash of its rarest terms, moved a little so that copies spread over a twentieth of the parts."""
    if parts == 1:
        return np.zeros(len(docs), np.int64)
    place = np.zeros(len(docs))
    for i, ids in enumerate(docs):
        terms = np.unique(ids)
        rare = terms[np.argsort(-idf[terms], kind="stable")[:_TOP]]
        place[i] = int(mix(rare.astype(np.uint64) + np.uint64(1)).min()) / 2**64
    return ((place + _moved(row) * 50) % 1 * parts).astype(np.int64)


def cuts(x: np.ndarray, moved: np.ndarray, shards: int) -> list[tuple]:
    """A tree of cuts across the direction in which the documents of a branch differ most: (direction, bound, low branch, high branch), or (None, shard, -1, -1)."""
    tree: list[tuple] = []
    leaves = 0

    def grow(at: np.ndarray, n: int) -> int:
        nonlocal leaves
        own = len(tree)
        tree.append((None, leaves, -1, -1))
        if n < 2 or len(at) < 2:
            leaves += 1
            return own
        part = x[at]
        way = np.linalg.eigh(np.cov(part.T))[1][:, -1].astype(np.float32)
        side = part @ way + moved[at]
        order = np.argsort(side, kind="stable")
        low = len(at) * (n // 2) // n
        bound = (side[order[low - 1]] + side[order[low]]) / 2 if low else side[order[0]] - 1
        tree[own] = (way, bound, grow(at[order[:low]], n // 2), grow(at[order[low:]], n - n // 2))
        return own

    grow(np.arange(len(x)), shards)
    return tree


def shard_of(tree: list[tuple], x: np.ndarray, moved: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        way, bound, low, high = tree[node]
        if way is None:
            out[at] = bound
            continue
        up = x[at] @ way + moved[at] > bound
        todo += [(k, part) for k, part in ((low, at[~up]), (high, at[up])) if len(part)]
    return out


class Index:
    """BM25 inverted index over the documents of one shard, under the term weights ``idf`` and the mean length of all documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, k1: float = 1.2, b: float = 0.75):
        self.n = n = len(docs)
        size = np.array([len(d) for d in docs], np.float32)
        parts = [(lo, *_counted(docs[lo:hi])) for lo, hi in slices(size, 1 << 18)]
        doc, term, tf = (np.concatenate(x) for x in zip(*(((d + lo).astype(np.int32), t.astype(np.int32), c) for lo, d, t, c in parts), strict=True))
        order = np.argsort(term, kind="stable")
        self.doc, tf = doc[order], tf[order]
        terms, self.first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.last = self.first + df
        number = np.empty(len(term), np.int32)
        number[order] = np.repeat(np.arange(len(terms), dtype=np.int32), df)
        #: Each document's terms, by their number among the shard's.
        self.own = np.split(number, np.searchsorted(doc, np.arange(1, n)))
        long = size[self.doc] / max(mean, 1e-9)
        self.weight = np.repeat(idf[terms], df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long))
        #: Terms that more than a quarter of the documents hold have a row with a place for each document, at most four times as long as their lists.
        common = np.flatnonzero(df * 4 > n)
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common.tolist()):
            self.rows[k, self.doc[self.first[t] : self.last[t]]] = self.weight[self.first[t] : self.last[t]]

    def scores(self, doc: int) -> np.ndarray:
        """Of all documents of the shard, for the distinct terms of one of them."""
        at = self.own[doc]
        row = self.row[at]
        asked = np.zeros(len(self.rows), np.float32)
        asked[row[row >= 0]] = 1
        at = at[row < 0]
        lo, size = self.first[at], self.last[at] - self.first[at]
        ends = np.cumsum(size)
        post = np.repeat(lo - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[post], self.weight[post], self.n) + asked @ self.rows


def pack_shard(docs: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (doc, start, length, sequence, offset) of a shard.

    A seed document opens a window; its best unused neighbours that fit follow, best first; the
    best one left is cut to fill the window to the last place, and what is left of it opens the
    next window. So only the shard's last window can be short; it is cut into sequences of
    descending powers of two, which need no padding.
    """
    index, sizes = Index(docs, idf, mean), [len(d) for d in docs]
    free = np.ones(len(docs), bool)
    seed, start, sequence, following = -1, 0, 0, 0
    last: list[tuple[int, int, int]] = []
    while True:
        if seed < 0:
            while following < len(docs) and not free[following]:
                following += 1
            if following == len(docs):
                break
            seed, start = following, 0
            free[seed] = False
        took = min(window, sizes[seed] - start)
        pieces, room = [(seed, start, took)], window - took
        left = (seed, start + took) if start + took < sizes[seed] else (-1, 0)
        if room and free.any():
            rank = np.flatnonzero(free)
            rank = rank[np.argsort(-index.scores(seed)[rank], kind="stable")]
            for d in rank.tolist():
                if sizes[d] <= room:
                    pieces.append((d, 0, sizes[d]))
                    free[d], room = False, room - sizes[d]
                    if not room:
                        break
            if room and len(rest := rank[free[rank]]):
                d = int(rest[0])
                pieces.append((d, 0, room))
                free[d], left, room = False, (d, room), 0
        seed, start = left
        if room:
            last = pieces
            continue
        offset = 0
        for d, s, n in pieces:
            yield d, s, n, sequence, offset
            offset += n
        sequence += 1
    total = sum(n for _, _, n in last)
    offset, room = 0, 0
    for d, s, n in last:
        while n:
            if not room:
                room = 1 << int(total).bit_length() - 1
            k = min(n, room)
            yield d, s, k, sequence, offset
            s, n, total, room, offset = s + k, n - k, total - k, room - k, offset + k
            if not room:
                sequence, offset = sequence + 1, 0


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 4096, end_id: int = 2, shard_docs: int = 1000) -> DataFrame:
    """Pieces of all documents, packed: ``<id_col>, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are the piece's token ids as little-endian unsigned 32-bit integers, ``end_id`` closing
    each document. Null texts count as empty and are one id long. Sequences hold at most ``window``
    (a power of two) ids; all are full but for at most one each of the lesser powers of two in a
    shard.

    Document frequencies, number and mean length are those of all documents. Neighbours are looked for within a
    shard of about ``shard_docs`` documents, so related documents are brought into one: each
    document's BM25 weights are projected to a short vector, and the space of these is cut in two, across the
    direction of largest spread, until there is a branch for each shard, or ``BRANCHES`` of them (``cuts``, from 16
    documents a branch; each document then goes down the tree). Larger branches are parted by the
    smallest hash of a document's rarest terms. Copies beyond a shard's size are cut apart by a
    hash of id and text. Neighbours that a cut separates do not meet: README has the share.
    A shard is closed at twice its size, so memory is bounded by that; tasks hold about
    ``TOGETHER`` shards whatever the size of the input; the driver holds a number for each term and 65,536 short vectors at most.
    Null ids are documents like others; repeated rows are packed as often as they stand. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("row", F.xxhash64("id", "text"))
    kind = rows.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        wide = "<u2" if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        for batch in batches:
            for lo, hi, flat, offsets in encoded(batch, enc, end_id):
                raw = [flat[a:b].astype(wide).tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(raw, pa.binary()), pa.array(np.diff(offsets))], names=["id", "row", "ids", "n"])

    def read(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [np.frombuffer(x, f"<u{len(x) // n}") for x, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for batch in batches:
            for lo, hi in slices(batch.column("n").to_numpy(), 1 << 17):
                part = batch.slice(lo, hi - lo)
                yield part, read(part)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for _, some in parts(batches):
            now = np.bincount(_counted(some)[1], minlength=len(df))
            now[: len(df)] += df
            df = now
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    coded = written(rows.mapInArrow(lambda it: tidy(encode(it)), f"id {kind}, row long, ids binary, n long"), "tokens")
    total, mean = coded.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    shards = max(1, -(-total // shard_docs))
    counts = coded.mapInArrow(lambda it: tidy(frequencies(it)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(max([end_id, *counts["term"].to_pylist()]) + 1, np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    idf = idf_of(df, total)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in parts(batches):
            x = vectors(some, idf, mean)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([v.astype(np.float16).tobytes() for v in x], pa.binary())], names=["row", "x"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in parts(batches):
            row = part.column("row").to_numpy()
            at = shard_of(tree, vectors(some, idf, mean), _moved(row)) if branches > 1 else np.zeros(len(some), np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at * inner + part_of(some, idf, inner, row))], names=[*part.schema.names, "shard"])

    branches = min(shards, BRANCHES)
    inner = -(-shards // branches)
    tree: list[tuple] = []
    if branches > 1:
        chosen = F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < F.lit(max(1, round((1 << 40) * min(1.0, _LOOKED_AT * branches / total))))
        seen = coded.where(chosen).mapInArrow(lambda it: tidy(placed(it)), "row long, x binary").toArrow().sort_by("row")
        x = np.frombuffer(b"".join(seen["x"].to_pylist()), np.float16).reshape(-1, _WIDE).astype(np.float32)
        tree = cuts(x, _moved(seen["row"].to_numpy()), branches)
    sent = coded.mapInArrow(lambda it: tidy(dealt(it)), f"id {kind}, row long, ids binary, n long, shard long")
    sent = sent.repartition(max(1, shards // TOGETHER), F.floor(F.col("shard") / TOGETHER)).sortWithinPartitions("shard", "id", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = None, TaskContext.get().partitionId() << 20
        keys: list = []
        docs_in: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pieces = np.array(list(pack_shard(docs_in, window, idf, mean)), np.int64).reshape(-1, 5)
            for lo in range(0, len(pieces), 4096):
                part = pieces[lo : lo + 4096]
                raw = [docs_in[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in part.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([keys[d] for d in part[:, 0].tolist()], own), pa.array(part[:, 1]), pa.array(part[:, 2]), pa.array(raw, pa.binary()), pa.array(np.array([len(docs_in[d]) for d in part[:, 0].tolist()], np.int64)), pa.array(part[:, 3] + (number << 20)), pa.array(part[:, 4])], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            own = batch.column("id").type
            for key, ids, shard in zip(batch.column("id").to_pylist(), read(batch), batch.column("shard").to_pylist(), strict=True):
                if shard != now or len(docs_in) >= 2 * shard_docs:
                    if docs_in:
                        yield from flush()
                        number += 1
                    now, keys, docs_in = shard, [], []
                keys.append(key)
                docs_in.append(ids)
        if docs_in:
            yield from flush()

    out = sent.mapInArrow(lambda it: tidy(run(it)), f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
