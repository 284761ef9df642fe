"""The most similar vectors of every vector: collision counting over sorted projection arrays, then exact cosines.

Every vector is projected on DIRECTIONS fixed directions; the ROOTS on which it is most extreme, by sign, are those where
it may collide (similar vectors stay together there: the hash that is aware of the query). A pair counts from THRESHOLD
collisions on, so the arrays are named by pairs of such directions: in each of them all vectors meet that collide in both,
sorted by their projection on the first. Within an array a window around each vector's own value grows step by step;
what it meets, and is close by its sketch, is verified by the exact cosine.

A vector with more than ENOUGH close ones in any window is crowded. Crowded vectors are compared with each other exactly,
block by block; only blocks too far apart to hold any pair are passed over. What a crowded vector and one that isn't have
in common is met in the windows of the latter, which span all of the radius.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import Stash, spread

DIRECTIONS = 256
ROOTS = 12
#: Collisions that make a candidate; the arrays are those of so many directions.
THRESHOLD = 2
#: Bits of the sign sketch that an entry carries, in words of 64, and how many standard deviations its Hamming distance
#: may lie above what the least cosine gives. 3 of them lose 0.13 % of pairs just at the least cosine, fewer above it.
WORDS, SLACK = 4, 3.0
SKETCH = 64 * WORDS
#: Entries that are searched together, about: whole arrays, as many as that takes.
GROUP = 150_000
#: Entries that a task holds before it hands them on.
FLUSH = 1_000_000
#: Ids broadcast at most (16 bytes each); beyond, the join is by shuffle.
BROADCAST_IDS = 500_000
#: Vectors on either side of a window at first, and the growth per step (virtual rehashing). The window stops growing
#: when it spans all of the radius that the least cosine allows, or holds more than ENOUGH close vectors by their
#: sketches; then its vector is crowded. Numbers compared at once.
WINDOW, GROWTH, ENOUGH, AT_ONCE = 256, 4, 96, 1 << 24
#: Crowded vectors in a block (all pairs of two blocks are compared in one piece), and the most cells of a model.
BLOCK, CELLS = 1000, 256


@cache
def _directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, DIRECTIONS + SKETCH)).astype(np.float32)


def decode(blobs: list[bytes | None], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors in float64) of the blobs that hold dim finite little-endian float32 numbers, not all zero."""
    rows = np.array([i for i, b in enumerate(blobs) if b is not None and len(b) == 4 * dim], np.int64)
    if not len(rows):
        return rows, np.zeros((0, dim))
    x = np.frombuffer(b"".join(blobs[i] for i in rows), "<f4").reshape(-1, dim).astype(np.float64)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very small or large numbers are lost
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(batches: Iterator[pa.RecordBatch], dims: dict[str, int], size: int = 1000) -> Iterator[tuple[list[str], str, np.ndarray, np.ndarray]]:
    """(ids, model, digests, unit vectors in float32) of the usable vectors, in small blocks."""
    for whole_batch in batches:
        for a in range(0, whole_batch.num_rows, size):
            batch = whole_batch.slice(a, size)
            ids, models, blobs = (batch.column(c).to_pylist() for c in ("id", "model", "blob"))
            for model in sorted(set(models) & set(dims)):
                rows, x = decode([b if m == model else None for m, b in zip(models, blobs, strict=True)], dims[model])
                if len(rows):
                    u = unit(x).astype("<f4")
                    salt = model.encode()
                    digest = b"".join(hashlib.blake2b(v.tobytes(), digest_size=8, key=salt[:64]).digest() for v in u)
                    yield [ids[i] for i in rows], model, np.frombuffer(digest, "<i8"), u


def _names(dims: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, model, vec, _ in _vectors(batches, dims):
            yield pa.record_batch([pa.array(ids), pa.array([model] * len(ids)), pa.array(vec)], names=["id", "model", "vec"])

    return run


def _units(dims: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, vec, u in _vectors(batches, dims):
            yield pa.record_batch([pa.array(vec), pa.array([v.tobytes() for v in u], pa.binary())], names=["vec", "unit"])

    return run


def _project(dims: dict[str, int], groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of the arrays, as one row of packed columns for each group of arrays, so that a shuffle moves a few long rows."""
        seen: set[int] = set()  # copies in one partition enter the arrays once
        i, j = np.triu_indices(ROOTS, 1)
        held: dict[str, list[tuple[np.ndarray, ...]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for model, parts in held.items():
                array, vec, value, sketch = (np.concatenate(x) for x in zip(*parts, strict=True))
                grp = (array.astype(np.int64) * 2654435761 >> 7) % groups
                order = np.argsort(grp, kind="stable")
                edges = np.append(np.flatnonzero(np.diff(grp[order], prepend=-1)), len(order))
                cut = lambda x, order=order, edges=edges: pa.array([x[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
                yield pa.record_batch([pa.array([model] * (len(edges) - 1)), pa.array(grp[order[edges[:-1]]].astype(np.int32)), cut(array), cut(vec), cut(value), cut(sketch)], names=["model", "grp", *_ENTRY])

        for _, model, vec, u in _vectors(batches, dims):
            first = np.array([n for n, v in enumerate(vec.tolist()) if not (v in seen or seen.add(v))], np.int64)
            if not len(first):
                continue
            vec, y = vec[first], u[first] @ _directions(dims[model])
            sketch = np.packbits(y[:, DIRECTIONS:] > 0, axis=1).view(np.uint64)
            y = y[:, :DIRECTIONS]
            top = np.sort(np.argpartition(-np.abs(y), ROOTS, axis=1)[:, :ROOTS], axis=1)
            value = np.take_along_axis(y, top, 1)
            sign = top * 2 + (value < 0)
            array = (sign[:, i] * (2 * DIRECTIONS) + sign[:, j]).ravel().astype(np.int32)
            held.setdefault(model, []).append((array, np.repeat(vec, len(i)), np.abs(value)[:, i].ravel().astype(np.float32), np.repeat(sketch, len(i), axis=0)))
            size += len(array)
            if size >= FLUSH:
                yield from flush()
                held.clear()
                size = 0
        yield from flush()

    return run


_ENTRY = ("arrays", "vecs", "values", "sketches")


def _collide(least: float):
    angle = np.arccos(least) / np.pi
    far = SKETCH * angle + SLACK * np.sqrt(SKETCH * angle * (1 - angle))
    soon = SKETCH / 2 * angle + (SLACK + 1) * np.sqrt(SKETCH / 2 * angle * (1 - angle))  # of the first half of the bits
    half = WORDS // 2
    radius = 3 * np.sqrt(2 * (1 - least))  # of projections on standard normal directions, three deviations

    def one(table: pa.Table) -> pa.Table:
        """All arrays of a group, each by itself. Rows with a = b tell that a is crowded."""
        slot, vec, value, words = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in zip(_ENTRY, (np.int32, np.int64, np.float32, np.uint64), strict=True))
        sketch = list(words.reshape(-1, WORDS).T.copy())
        order = np.lexsort((value, vec, slot))
        first = np.ones(len(order), bool)
        first[1:] = (slot[order][1:] != slot[order][:-1]) | (vec[order][1:] != vec[order][:-1])
        order = order[first]
        order = order[np.lexsort((value[order], slot[order]))]
        edges = np.append(np.flatnonzero(np.diff(slot[order], prepend=slot[order][:1] - 1)), len(order))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        size = np.diff(edges)
        for a, b in zip(edges[:-1][size > WINDOW], edges[1:][size > WINDOW], strict=True):
            rows = order[a:b]
            windows(value[rows], vec[rows], [w[rows] for w in sketch], out)
        rows = order[np.repeat((size > 1) & (size <= WINDOW), size)]
        together(slot[rows], value[rows], vec[rows], [w[rows] for w in sketch], out)
        a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (vec[:0], vec[:0])
        return pa.table({"a": a, "b": b})

    def together(slot: np.ndarray, value: np.ndarray, vec: np.ndarray, s: list[np.ndarray], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """All small arrays at once: each vector with the next, the next but one, and so on, within its array and the radius."""
        at, close = np.arange(len(slot)), np.zeros(len(slot), np.int32)
        found = []
        for step in range(1, WINDOW):
            at = at[at + step < len(slot)]
            at = at[slot[at + step] == slot[at]]
            at = at[value[at + step] - value[at] <= radius]
            if not len(at):
                break
            count = sum(np.bitwise_count(w[at] ^ w[at + step]).astype(np.int16) for w in s)
            hit = at[count <= far]
            close += np.bincount(hit, minlength=len(slot)).astype(np.int32) + np.bincount(hit + step, minlength=len(slot)).astype(np.int32)
            found.append((hit, hit + step))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (at[:0], at[:0])
        crowded = close > ENOUGH
        keep = ~(crowded[x] & crowded[y])  # pairs of two crowded ones are compared block by block
        pair = np.unique(np.stack([np.minimum(vec[x], vec[y])[keep], np.maximum(vec[x], vec[y])[keep]]), axis=1)
        hot = np.unique(vec[crowded])
        out.append((np.concatenate([pair[0], hot]), np.concatenate([pair[1], hot])))

    def windows(value: np.ndarray, vec: np.ndarray, s: list[np.ndarray], out: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n = len(value)
        found, crowded = [], []
        work = []
        for a in range(0, n, 512):
            q = np.arange(a, min(a + 512, n))
            work.append((q, np.searchsorted(value, value[q] - radius), np.searchsorted(value, value[q] + radius, "right"), WINDOW))
        while work:
            q, low, high, reach = work.pop()
            lo, hi = np.maximum(low, q - reach), np.minimum(high, q + reach + 1)
            first, last = int(lo.min()), int(hi.max())
            if len(q) > 1 and len(q) * (last - first) > AT_ONCE:
                half_q = len(q) // 2
                work += [(q[:half_q], low[:half_q], high[:half_q], reach), (q[half_q:], low[half_q:], high[half_q:], reach)]
                continue
            near = np.zeros((len(q), last - first), np.int16)
            for w in s[:half]:
                near += np.bitwise_count(w[q, None] ^ w[None, first:last])
            x, y = np.nonzero(near <= soon)
            y_at = y + first
            inside = (y_at >= lo[x]) & (y_at < hi[x]) & (y_at != q[x])
            x, y_at, count = x[inside], y_at[inside], near[x[inside], y[inside]]
            count = count + sum(np.bitwise_count(w[q[x]] ^ w[y_at]).astype(np.int16) for w in s[half:])
            x, y_at = x[count <= far], y_at[count <= far]
            many = np.bincount(x, minlength=len(q)) > ENOUGH
            done = ((lo == low) & (hi == high)) | many
            crowded.append(vec[q[many]])
            whole_window = (done & ~many)[x]
            found.append((vec[q[x[whole_window]]], vec[y_at[whole_window]]))
            if not done.all():
                work.append((q[~done], low[~done], high[~done], reach * GROWTH))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True))
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        hot = np.concatenate(crowded)
        out.append((np.concatenate([pair[0], hot]), np.concatenate([pair[1], hot])))

    return one


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, 2000):
            batch = whole_batch.slice(at, 2000)
            ua, ub = batch.column("ua").to_pylist(), batch.column("ub").to_pylist()
            sizes = np.array([len(x) for x in ua])
            cosine = np.zeros(len(ua))
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x, y = (unit(np.frombuffer(b"".join(u[i] for i in rows), "<f4").reshape(len(rows), -1).astype(np.float64)) for u in (ua, ub))
                cosine[rows] = np.einsum("ij,ij->i", x, y)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(np.round(cosine, 6))], names=["a", "b", "cosine"])


def _cells(pivots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models, blobs = (batch.column(c).to_pylist() for c in ("model", "unit"))
            cell = np.zeros(len(models), np.int32)
            for model in set(models):
                rows = [i for i, m in enumerate(models) if m == model]
                x = np.frombuffer(b"".join(blobs[i] for i in rows), "<f4").reshape(len(rows), -1)
                cell[rows] = np.argmax(x @ pivots[model].T, axis=1)
            yield pa.record_batch([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _pack(table: pa.Table) -> pa.Table:
    """One block: vectors in the order of their ids, the direction of their mean, and how far from it they lie."""
    table = table.sort_by("id")
    blobs = table.column("unit").to_pylist()
    u = unit(np.frombuffer(b"".join(blobs), "<f4").reshape(len(blobs), -1).astype(np.float64))
    mean = u.sum(0)
    centre = unit(mean[None, :])[0] if mean.any() else u[0]
    radius = float(np.arccos(np.clip(u @ centre, -1, 1)).max())
    first = lambda c: table.column(c)[0].as_py()
    return pa.table({"model": [first("model")], "cell": pa.array([first("cell")], pa.int32()), "part": pa.array([first("part")], pa.int32()), "centre": [centre.tolist()], "radius": [radius], "vecs": [table.column("vec").to_numpy().tobytes()], "units": [b"".join(blobs)]})


def _between(least: float, k: int):
    """All pairs of two blocks: for each vector its k + 1 best of the other block, unless as many better ones are known."""
    floor = round(least * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                va, vb = (np.frombuffer(row[c], np.int64) for c in ("va", "vb"))
                ua, ub = (unit(np.frombuffer(row[c], "<f4").reshape(len(v), -1).astype(np.float64)) for c, v in (("ua", va), ("ub", vb)))
                millionths = np.rint(ua @ ub.T * 1_000_000).astype(np.int64)
                same = row["ia"] == row["ib"]
                if same:
                    np.fill_diagonal(millionths, -2_000_000)
                for number, mine, others, m in [(row["ia"], va, vb, millionths)] + ([] if same else [(row["ib"], vb, va, millionths.T)]):
                    keys = m * len(others) - np.arange(len(others))  # ties go by id, the order of the block
                    most = min(k + 1, len(others))
                    top = np.argpartition(-keys, most - 1, axis=1)[:, :most]
                    score = np.take_along_axis(m, top, 1)
                    best = known.get(number, np.full((len(mine), k + 1), floor))
                    known[number] = best = -np.sort(-np.concatenate([best, score], axis=1), axis=1)[:, : k + 1]
                    x, y = np.nonzero(score >= best[:, -1:])
                    a, b = mine[x], others[top[x, y]]
                    yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(score[x, y] / 1_000_000)], names=["a", "b", "cosine"])

    return run


def crowded_pairs(crowded: DataFrame, least: float, k: int, stash: Stash) -> DataFrame | None:
    """(a, b, cosine) of (vec, model, id, unit): each one's k + 1 most similar of its model, by exact cosine, ties by id.

    Vectors go to cells around sampled ones, cells are cut into blocks, and blocks are compared two by two without a
    shuffle, unless no pair of them can reach ``least`` by the angles of their means.
    """
    spark = crowded.sparkSession
    sample = crowded.withColumn("r", F.row_number().over(Window.partitionBy("model").orderBy(F.xxhash64("vec")))).where(F.col("r") <= CELLS).select("model", "unit").collect()
    if not sample:
        return None
    pivots = {m: np.stack([np.frombuffer(r.unit, "<f4") for r in sample if r.model == m]) for m in {r.model for r in sample}}
    placed = stash.keep(crowded.mapInArrow(_cells(pivots), "vec long, model string, id string, unit binary, cell int"), "cells")
    parts = placed.groupBy("model", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    cut = placed.join(F.broadcast(parts), ["model", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec", F.lit(1)), F.col("parts")).cast("int"))
    blocks = stash.keep(cut.select("vec", "model", "id", "unit", "cell", "part").groupBy("model", "cell", "part").applyInArrow(_pack, "model string, cell int, part int, centre array<double>, radius double, vecs binary, units binary"), "blocks")
    heads = blocks.select("model", "cell", "part", "centre", "radius").collect()
    rows = []
    for model in pivots:
        own = [(i, r) for i, r in enumerate(heads) if r.model == model]
        number, radius, centre = np.array([i for i, _ in own]), np.array([r.radius for _, r in own]), np.array([r.centre for _, r in own])
        for at, (i, r) in enumerate(own):
            reach = np.arccos(np.clip(centre[at:] @ centre[at], -1, 1)) - radius[at:] - radius[at]
            rows.append((model, r.cell, r.part, i, number[at:][reach <= np.arccos(least) + 1e-6].tolist()))
    known = spark.createDataFrame(rows, "model string, cell int, part int, i int, partners array<int>")
    numbered = stash.keep(blocks.join(F.broadcast(known), ["model", "cell", "part"]).select("i", "partners", "vecs", "units"), "numbered")
    left = numbered.select(F.col("i").alias("ia"), "partners", F.col("vecs").alias("va"), F.col("units").alias("ua"))
    right = numbered.select(F.col("i").alias("ib"), F.col("vecs").alias("vb"), F.col("units").alias("ub"))
    both = left.join(right, F.array_contains("partners", F.col("ib"))).select("ia", "ib", "va", "ua", "vb", "ub")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "4")  # rows of some MB
    try:
        return stash.keep(both.mapInArrow(_between(least, k), "a long, b long, cosine double"), "crowded-pairs")
    finally:
        spark.conf.set(size, before)


def similar_vectors(vectors: DataFrame, dims: dict[str, int], least: float = 0.8, k: int = 5, vector_id: str = "image_id", blob: str = "embedding_blob", model: str = "embedding_model", stash: Stash | None = None) -> DataFrame:
    """(a, b, cosine), a < b: pairs of one model with cosine at least ``least``, one of them among the other's k most similar.

    Usable are vectors of a model in ``dims`` with its full length, finite numbers, and not all zero. Repeated rows count
    once; of rows with one id and different vectors the one with the smallest digest counts. Ties of the cosine, at six decimals, go by
    id. Vectors of the same direction are one point for the search, and are told apart again by their ids, of which k + 1
    suffice. Crowded vectors are compared exactly. Recall is stated in the README against brute force.
    """
    spark = vectors.sparkSession
    stash = stash or Stash(spark)
    source = vectors.select(F.col(vector_id).cast("string").alias("id"), F.col(model).alias("model"), F.col(blob).alias("blob")).where("id is not null and blob is not null").where(F.col("model").isin(sorted(dims)))
    source = spread(source)
    named = source.mapInArrow(_names(dims), "id string, model string, vec long").groupBy("id", "model").agg(F.min("vec").alias("vec"))
    named = stash.keep(named, "named")
    groups = max(1, named.count() * (ROOTS * (ROOTS - 1) // 2) // GROUP)
    entries = source.mapInArrow(_project(dims, groups), "model string, grp int, " + ", ".join(f"{c} binary" for c in _ENTRY))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups)
    hits = entries.repartition(parts, "model", "grp").groupBy("model", "grp").applyInArrow(_collide(least), "a long, b long")
    collided = stash.keep(hits.distinct(), "pairs")
    pairs, crowded = collided.where("a <> b"), collided.where("a = b").select(F.col("a").alias("vec"))
    met = collided.select(F.col("a").alias("vec")).union(collided.select("b")).distinct()
    ids = stash.keep(named.join(met, "vec").groupBy("vec").agg(F.min("id").alias("id")).select("id").distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    points = source.join(few, "id", "left_semi").mapInArrow(_units(dims), "vec long, unit binary").dropDuplicates(["vec"])
    points = stash.keep(points, "points")
    side = lambda v, u: points.select(F.col("vec").alias(v), F.col("unit").alias(u))
    close = pairs.join(side("a", "ua"), "a").join(side("b", "ub"), "b").select("a", "b", "ua", "ub").mapInArrow(_cosines, "a long, b long, cosine double").where(F.col("cosine") >= least)
    low = named.join(crowded, "vec").groupBy("vec", "model").agg(F.min("id").alias("id"))
    exact = crowded_pairs(stash.keep(low.join(points, "vec").select("vec", "model", "id", "unit"), "crowded"), least, k, stash)
    if exact is not None:
        close = close.union(exact).groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    close = stash.keep(close, "close")
    # the k + 1 first ids of each point are all that can be among anyone's k most similar by way of it
    buckets = F.pmod(F.xxhash64("id"), F.lit(64))
    near = named.withColumn("r", F.row_number().over(Window.partitionBy("vec", "model", buckets).orderBy("id"))).where(F.col("r") <= k + 1)
    heads = stash.keep(near.withColumn("r", F.row_number().over(Window.partitionBy("vec", "model").orderBy("id"))).where(F.col("r") <= k + 1).select("vec", "id"), "heads")
    both = close.select(F.col("a").alias("vec"), F.col("b").alias("other"), "cosine").union(close.select("b", "a", "cosine")).union(heads.select("vec", F.col("vec").alias("other"), F.lit(1.0).alias("cosine")).distinct())
    # for each point the k + 1 best ids around it; of those, each id at it takes the k best that are not itself
    around = both.join(heads.select(F.col("vec").alias("other"), F.col("id").alias("near")), "other")
    best = around.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy(F.desc("cosine"), "near"))).where(F.col("r") <= k + 1).groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("r", "near", "cosine"))).alias("best"))
    mine = named.join(best, "vec").select("id", F.slice(F.filter("best", lambda x: x["near"] != F.col("id")), 1, k).alias("best")).select("id", F.explode("best").alias("x")).select("id", F.col("x.near").alias("near"), F.col("x.cosine").alias("cosine"))
    return mine.groupBy(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).agg(F.max("cosine").alias("cosine"))
