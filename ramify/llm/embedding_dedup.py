"""Near-duplicate vectors by collision counting over one-dimensional projections.

Equal vectors collapse first. Each of `tables` tables cuts `anchors` random projections into windows (cells with a
random offset); vectors that share a table's cell meet in one task, large cells in pairs of blocks. There, COUNTED
further projections are sorted; for each vector as the query, the vectors within a window centred on it collide with
it, and a pair whose number of collisions reaches a threshold is verified by its cosine in double precision. Window,
threshold and number of tables come from the recall that a pair at the cosine threshold shall have (`recall`), and the
number of anchors from the number of vectors, so that cells of unrelated vectors stay small at any size. A pair is
counted in the first table that shows it, so no pair is returned, only counts of links and spanning forests.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors
of other lengths never link; rows with a null id have null component and no links; rows that share an id are one node,
and copies link with one another; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_arrow, components, local_roots, mix

#: Projections whose collisions are counted, and the half width of their windows in standard deviations of a pair's difference.
COUNTED, REACH = 32, 2.0
#: Cells of the anchors, in standard deviations of a random unit vector's projection.
CELL = 2.0
#: Vectors of a block of a cell.
BLOCK = 192


def settings(n: int, cosine: float, recall: float) -> dict[str, int]:
    """anchors, tables and threshold for n vectors."""
    gap = math.sqrt(2 - 2 * cosine)
    unrelated = 1 - 2 * sum(_normal(-k * CELL / math.sqrt(2)) for k in (0.5,))  # two random projections within half a cell or so
    anchors = max(3, round(math.log(max(n, 2) / 48) / -math.log(min(unrelated, 0.5))))
    same_cell = (1 - gap * math.sqrt(2 / math.pi) / CELL) ** anchors
    passed = 2 * _normal(REACH) - 1
    threshold, below = 0, 0.0
    while below + math.comb(COUNTED, threshold) * passed**threshold * (1 - passed) ** (COUNTED - threshold) <= (1 - recall) / 2:
        below += math.comb(COUNTED, threshold) * passed**threshold * (1 - passed) ** (COUNTED - threshold)
        threshold += 1
    tables = math.ceil(math.log((1 - recall) / 2) / math.log(1 - same_cell))
    return {"anchors": anchors, "tables": tables, "threshold": threshold}


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """(count, dim) directions of random signs and sizes, scaled so that a unit vector's projection has deviation 1."""
    return np.random.default_rng((seed, dim)).standard_normal((count, dim))


def units(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cell_keys(x: np.ndarray, s: dict[str, int]) -> np.ndarray:
    """(vectors, tables) hashes of the anchor windows that hold each unit vector."""
    dim, out = x.shape[1], np.empty((len(x), s["tables"]), np.int64)
    for t in range(s["tables"]):
        rng = np.random.default_rng((17, dim, t))
        offset = rng.random(s["anchors"]) * CELL
        window = np.floor((x @ rng.standard_normal((dim, s["anchors"])) + offset) / CELL).astype(np.int64)
        key = np.full(len(x), t + 1 + dim * 1009, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(s["anchors"]):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + window[:, k].view(np.uint64))
        out[:, t] = key.view(np.int64)
    return out


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, vector) to id and the vector's bytes (null if it is not valid)."""
    for batch in batches:
        out = []
        for v in batch.column(1):
            data = None
            if v.is_valid and len(v.values):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(x).all() and x.any():  # a null component reads as NaN
                    data = (x + 0.0).tobytes()  # -0 and 0 are equal
            out.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "data"])


def _matrix(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and the vectors of each length."""
    data = column.to_pylist()
    lengths = np.array([len(d) for d in data])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.frombuffer(b"".join(data[i] for i in at), np.float64).reshape(len(at), -1)


def _cells(s: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for at, data in _matrix(batch.column(1)):
                keys = cell_keys(units(data), s)
                ids = batch.column(0).to_numpy()[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, s["tables"])), pa.array(np.tile(np.arange(s["tables"], dtype=np.int32), len(at))), pa.array(keys.ravel())], ["id", "tab", "cell"])

    return run


def collisions(p: np.ndarray, reach: float) -> np.ndarray:
    """How many of the projections (rows of p are vectors) put each two vectors into windows centred on each other.

    Each projection is sorted. The window of a vector then ends within its sorted order, and all windows are filled in
    by one comparison of places.
    """
    n = len(p)
    out, place = np.zeros((n, n), np.uint8), np.empty(n, np.int32)
    for k in range(p.shape[1]):
        order = np.argsort(p[:, k], kind="stable")
        v = p[order, k]
        place[order] = np.arange(n, dtype=np.int32)
        lo, size = np.empty(n, np.int32), np.empty(n, np.int32)
        first = np.searchsorted(v, v - reach)
        lo[order], size[order] = first, np.searchsorted(v, v + reach, "right") - first
        # below the window the difference wraps round to a large number
        out += (place[None, :] - lo[:, None]).view(np.uint32) < size[:, None].view(np.uint32)
    return out


def _count(cosine: float, s: dict[str, int]):
    def run(group: pa.Table) -> pa.Table:
        ids, mult, side, tab = (group[c].to_numpy() for c in ("id", "n", "side", "tab"))
        nodes, links, roots = [], [], []
        for at, data in _matrix(group["data"]):
            x = units(data)
            hits = collisions(x @ directions(x.shape[1], COUNTED, 5).T, REACH * math.sqrt(2 - 2 * cosine)) >= s["threshold"]
            hits &= np.triu(np.ones(hits.shape, bool), 1)
            if side.min() != side.max():
                hits &= side[at][:, None] != side[at][None, :]
            i, j = np.nonzero(hits)
            if not len(i):
                continue
            keep = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[keep], j[keep]
            t = int(tab[0])
            if t and len(i):
                keys = cell_keys(x, s | {"tables": t})
                new = ~(keys[i] == keys[j]).any(1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            m = mult[at]
            total = np.bincount(i, m[j], len(at)) + np.bincount(j, m[i], len(at))
            own = ids[at]
            a, b = local_roots(own[i], own[j])
            top = dict(zip(a.tolist(), b.tolist(), strict=True))
            for k in np.flatnonzero(total):
                nodes.append(int(own[k]))
                links.append(int(total[k]))
                roots.append(top.get(int(own[k]), int(own[k])))
        return pa.table({"node": pa.array(nodes, pa.int64()), "links": pa.array(links, pa.int64()), "root": pa.array(roots, pa.int64())})

    return run


def link_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, recall: float = 0.99) -> DataFrame:
    """One row per row of vectors: id_col, n_links long, component_id long, kept boolean."""
    spark = vectors.sparkSession
    bounded_arrow(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_valid, "id long, data binary")
    rows = scratch.write(rows.withColumns({"h1": F.xxhash64("data"), "h2": F.xxhash64(F.lit(1), "data")}), "vectors")
    valid = rows.where("data IS NOT NULL AND id IS NOT NULL")
    groups = scratch.write(valid.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "groups")
    s = settings(groups.count(), cosine, recall)

    reps = groups.select(F.col("rep").alias("id"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "n")
    reps = valid.join(reps, "id").where("h1 = g1 AND h2 = g2").select("id", "data", "n").dropDuplicates(["id", "data"])
    reps = scratch.write(reps, "reps")
    cells = scratch.write(reps.select("id", "data").mapInArrow(_cells(s), "id long, tab int, cell long"), "cells")
    sizes = cells.groupBy("tab", "cell").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = cells.join(sizes, ["tab", "cell"]).withColumn("b", F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int"))
    dealt = dealt.select("id", "tab", "cell", "b", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    dealt = dealt.select("id", "tab", "cell", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), (F.col("b") > F.col("o")).cast("int").alias("side"))
    found = dealt.join(reps, "id").groupBy("tab", "cell", "bi", "bj").applyInArrow(_count(cosine, s), "node long, links long, root long")
    found = scratch.write(found, "found")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    same = valid.select("id", "h1", "h2").join(groups, ["h1", "h2"]).select("id", "rep", "n")
    same = scratch.write(same, "same")
    edges = found.where("node <> root").select("node", "root").unionByName(same.where("id <> rep").select(F.col("id").alias("node"), F.col("rep").alias("root")))
    roots = components(scratch, edges, "vectors-cc")
    # what a representative links with, its copies link with too; copies of one id count among one another
    counted = same.join(links.withColumnRenamed("node", "rep"), "rep", "left").select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    counted = counted.groupBy("id").agg(F.max("n_links").alias("n_links"))
    out = rows.select("id", F.col("data").isNotNull().alias("ok")).join(counted, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
