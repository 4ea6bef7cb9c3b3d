"""Embedding near-dedup by an epsilon grid order join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, spread_join, tidy, written

#: Leading principal dimensions that make the grid, and those by which blocks are joined; bytes of a block's vectors; the number below which vectors are compared.
DIMS, JOINED, BLOCK, LEAF = 6, 3, 1 << 21, 128


def _basis(sample: list, dims: int) -> dict[int, np.ndarray]:
    """Principal directions by vector length. Any orthonormal directions give the same links; good ones skip more."""
    out: dict[int, np.ndarray] = {}
    for n in {len(v) for v in sample}:
        x = _unit(np.array([v for v in sample if len(v) == n], np.float64))
        out[n] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:dims].T if len(x) > 1 else np.eye(n)[:, :dims]
    return out


def _place(x: np.ndarray, basis: dict[int, np.ndarray]) -> np.ndarray:
    """Leading coordinates of unit vectors, filled up with zeros."""
    n = x.shape[1]
    found = x @ basis.get(n, np.eye(n)[:, :DIMS])
    return np.pad(found, ((0, 0), (0, DIMS - found.shape[1])))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, brought near length one by a power of two (which changes no digit), and their lengths then."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x, np.sqrt((x * x).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    x, norm = _scaled(x)
    return x / norm[:, None]


def _cells(batches: Iterator[pa.RecordBatch], basis: dict, eps: float, kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs = batch.column("vec").to_pylist()
        cells = np.zeros((len(vecs), DIMS), np.int32)
        for n in {len(v) for v in vecs}:
            at = [i for i, v in enumerate(vecs) if len(v) == n]
            cells[at] = np.floor(_place(_unit(np.array([vecs[i] for i in at], kind)), basis) / eps)
        raw = pa.array([np.asarray(v, kind).tobytes() for v in vecs], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("id"), batch.column("size"), *(pa.array(cells[:, k]) for k in range(DIMS)), raw], names=["label", "id", "size", *(f"c{k}" for k in range(DIMS)), "raw"])


def _blocks(batches: Iterator[pa.RecordBatch], basis: dict, kind: str) -> Iterator[pa.RecordBatch]:
    """Cut a sorted run into blocks of one label and vector length, each with its bounding box."""
    names = ["block", "label", "bytes", "n", *(f"lo{k}" for k in range(DIMS)), *(f"hi{k}" for k in range(DIMS)), "ids", "sizes", "raws"]
    base, seq, key, ids, sizes, raws = TaskContext.get().partitionId() << 32, 0, None, [], [], []

    def block() -> pa.RecordBatch:
        place = _place(_unit(np.frombuffer(b"".join(raws), kind).reshape(len(raws), -1)), basis)
        row = [base + seq, key[0], key[1], len(ids), *place.min(0).tolist(), *place.max(0).tolist(), np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), b"".join(raws)]
        kinds = [pa.int64(), None, pa.int32(), pa.int32(), *[pa.float64()] * 2 * DIMS, pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x], t or label_kind) for x, t in zip(row, kinds, strict=True)], names=names)

    for batch in batches:
        label_kind = batch.column(0).type
        for label, i, size, raw in zip(*(batch.column(k).to_pylist() for k in ("label", "id", "size", "raw")), strict=True):
            if ids and (key != (label, len(raw)) or (len(ids) + 1) * len(raw) > BLOCK):
                yield block()
                seq, ids, sizes, raws = seq + 1, [], [], []
            key = (label, len(raw))
            ids.append(i)
            sizes.append(size)
            raws.append(raw)
    if ids:
        yield block()


def _root(up: np.ndarray, i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _tiles(batches: Iterator[pa.RecordBatch], basis: dict, eps: float, cosine: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Links between two blocks: for each vector its linked ids' number of rows, and edges that connect what is linked."""
    for batch in batches:
        for r in batch.to_pylist():
            same = r["a"] == r["b"]
            sides = []
            for s in "a" if same else "ab":
                x, norm = _scaled(np.frombuffer(r[f"raws_{s}"], kind).reshape(r[f"n_{s}"], -1))
                unit = x / norm[:, None]
                sides.append((np.frombuffer(r[f"ids_{s}"], np.int64), np.frombuffer(r[f"sizes_{s}"], np.int64), unit, norm, _place(unit, basis), x))
            sides *= 1 + same
            (ia, wa, ua, na, pa_, xa), (ib, wb, ub, nb, pb, xb) = sides
            links, count_a, count_b = [], np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
            todo = [(0, len(ia), 0, len(ib))]
            while todo:
                la, ha, lb, hb = todo.pop()
                if same and hb - 1 <= la:
                    continue
                gap = np.maximum(0, np.maximum(pa_[la:ha].min(0) - pb[lb:hb].max(0), pb[lb:hb].min(0) - pa_[la:ha].max(0)))
                if gap @ gap > eps * eps:
                    continue
                if max(ha - la, hb - lb) > LEAF:
                    ma, mb = ((la + ha) // 2 if ha - la > LEAF else ha), ((lb + hb) // 2 if hb - lb > LEAF else hb)
                    todo += [(x, y, z, w) for x, y in ((la, ma), (ma, ha)) for z, w in ((lb, mb), (mb, hb)) if x < y and z < w]
                    continue
                i, j = np.nonzero(ua[la:ha] @ ub[lb:hb].T >= cosine - 1e-9)
                i, j = i + la, j + lb
                if same:
                    i, j = i[i < j], j[i < j]
                true = (xa[i] * xb[j]).sum(1) / (na[i] * nb[j]) >= cosine
                i, j = i[true], j[true]
                np.add.at(count_a, i, wb[j])
                np.add.at(count_b, j, wa[i])
                links.append(np.stack([i, j]))
            if not links:
                continue
            i, j = np.concatenate(links, axis=1)
            ids = ia if same else np.concatenate([ia, ib])
            up, edges, shift = np.arange(len(ids)), [], 0 if same else len(ia)
            for x, y in zip(i.tolist(), (j + shift).tolist(), strict=True):
                p, q = _root(up, x), _root(up, y)
                if p != q:
                    up[max(p, q)] = min(p, q)
                    edges.append((ids[x], ids[y]))
            count = count_a + count_b if same else np.concatenate([count_a, count_b])
            hit = np.flatnonzero(count)
            e = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([ids[hit], e[:, 0]]), np.concatenate([np.full(len(hit), -1), e[:, 1]]), np.concatenate([count[hit], np.zeros(len(e), np.int64)]))], names=["a", "b", "n"])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", cosine: float = 0.93, sample: int = 2048) -> DataFrame:
    """Links of every vector with vectors of the same label at a cosine of at least ``cosine`` (over 0), in double precision.

    Returns one row per row of ``vectors``: ``<id_col>, n_links, component_id, kept``. Vectors that
    are null, empty, zero or hold null or non-finite components, and rows whose label or id is
    null, link with nothing. Vectors of different length do not link. Repeated rows count as
    further vectors; rows that share an id share what is found for it. An empty table gives no
    rows. Only the named columns are read.

    Method: unit vectors at that cosine are at most eps = sqrt(2 - 2 cosine) apart. They are sorted
    by their grid cells (side eps) on the leading principal dimensions, range-partitioned in that
    order and cut into blocks of 2 MB with bounding boxes. Blocks that meet in a cell of the leading
    dimensions and whose boxes are within eps are joined: both sequence intervals are halved again
    and again, box pairs further apart than eps are skipped, and what is left is compared. The
    directions come from ``sample`` rows (the bound); the links do not depend on them. Equal vectors
    are compared once and counted by their number.
    """
    eps = float(np.sqrt(2 - 2 * cosine) * (1 + 1e-9))
    label = F.lit(0) if label_col is None else F.col(label_col)
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    number, kind = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast(f"array<{number}>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    able = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & fine)
    reps = written(able.groupBy("label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("size")), "vectors")
    basis = _basis([r.vec for r in reps.orderBy(F.xxhash64("id")).select("vec").limit(sample).collect()], DIMS)
    order = ["label", F.length("raw"), *(f"c{k}" for k in range(DIMS)), "id"]
    type_ = reps.schema["label"].dataType.simpleString()
    cells = reps.mapInArrow(lambda it: tidy(_cells(it, basis, eps, kind)), f"label {type_}, id long, size long, {', '.join(f'c{k} int' for k in range(DIMS))}, raw binary")
    run = cells.repartitionByRange(*order).sortWithinPartitions(*order).select("label", "id", "size", "raw")
    boxes = ", ".join(f"{e}{k} double" for e in ("lo", "hi") for k in range(DIMS))
    blocks = written(run.mapInArrow(lambda it: tidy(_blocks(it, basis, kind)), f"block long, label {type_}, bytes int, n int, {boxes}, ids binary, sizes binary, raws binary"), "blocks")
    meta = written(blocks.drop("ids", "sizes", "raws", "n"), "boxes")
    at = lambda c: F.floor(F.col(c) / eps)
    a = meta.select(*(F.col(c).alias(f"a_{c}") for c in meta.columns))
    b = meta
    for k in range(JOINED):  # the cells that a box, or its surroundings, reach
        a = a.withColumn(f"x{k}", F.explode(F.sequence(at(f"a_lo{k}") - 1, at(f"a_hi{k}") + 1)))
        b = b.withColumn(f"y{k}", F.explode(F.sequence(at(f"lo{k}"), at(f"hi{k}"))))
    gap2 = sum((F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"a_hi{k}")), 2) for k in range(DIMS)), F.lit(0.0))
    meet = (F.col("a_label") == F.col("label")) & (F.col("a_bytes") == F.col("bytes"))
    once = (F.col("a_block") <= F.col("block")) & (gap2 <= eps * eps)
    for k in range(JOINED):
        meet &= F.col(f"x{k}") == F.col(f"y{k}")
        once &= F.col(f"x{k}") == F.greatest(at(f"a_lo{k}") - 1, at(f"lo{k}"))
    pairs = written(a.join(b, meet).where(once).select(F.col("a_block").alias("a"), F.col("block").alias("b")), "pairs")
    sides = [blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "ids", "sizes", "raws"))) for s in "ab"]
    other = [F.when(F.col("a") != F.col("b"), F.col(f"{c}_b")).alias(f"{c}_b") for c in ("n", "ids", "sizes", "raws")]
    tiles = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", *(f"{c}_a" for c in ("n", "ids", "sizes", "raws")), *other)
    found = written(tiles.repartition(max(1, pairs.count()), "a", "b").mapInArrow(lambda it: tidy(_tiles(it, basis, eps, cosine, kind)), "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    comps = connected_components(found.where("n = 0").select("a", "b")).select(F.col("id").alias("rep"), "comp")
    sets = reps.select("label", "vec", F.col("id").alias("rep"), "size").join(counts, "rep", "left").join(comps, "rep", "left")
    sets = sets.select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"), F.coalesce("comp", "rep").alias("comp"), "size")
    told = spread_join(able, written(sets, "sets"), ["label", "vec"], "size").groupBy("id").agg(F.sum("links").alias("links"), F.min("comp").alias("comp"), F.count("*").alias("rows"))
    comp = F.coalesce("comp", "id")
    named = spread_join(rows.select("id"), written(told, "told"), ["id"], "rows")
    return named.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))
