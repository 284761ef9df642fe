"""Image fingerprints: exact and near matches, decisions, and what an incremental build must do."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import hamming, high_half, low_half
from foliant.session import ship

#: The widest radius that goes by bands; beyond, bands of under 4 bits don't select. Hashes in a block.
BANDED, BLOCK = 15, 512


def same_content(images: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, image_id): images of other documents with a query's normalised digest. Null digests match none."""
    other = images.select("image_id", F.col("doc_id").alias("other_doc"), "sha256_norm")
    return queries.select(F.col("image_id").alias("query_id"), "doc_id", "sha256_norm").where("sha256_norm is not null").join(other, "sha256_norm").where("query_id <> image_id and not (doc_id <=> other_doc)").select("query_id", "image_id").distinct()


def hamming_join(images: DataFrame, queries: DataFrame, radius: int = 7, key: str = "image_id", phash: str = "phash_hex") -> DataFrame:
    """(query_id, image_id, distance): images whose 64-bit hash differs from a query's in at most ``radius`` bits.

    By the pigeonhole rule two such hashes agree in one of radius + 1 bands, so the join is an equality on bands; every
    pair is then counted once, at the first band on which it agrees. Beyond BANDED bits the different hashes of both sides
    are compared block by block. Invalid hashes match none. Queries are a stated set.
    """
    if not 0 <= radius <= 64:
        raise ValueError("hashes have 64 bits")
    if radius > BANDED:
        return _compared(images, queries, radius, key, phash)
    bands = radius + 1
    edges = [round(i * 64 / bands) for i in range(bands + 1)]

    def cut(rows: DataFrame, name: str) -> DataFrame:
        valid = rows.select(F.col(key).alias(name), F.lower(phash).alias(f"{name}_hash")).where(F.col(f"{name}_hash").rlike("^[0-9a-f]{16}$")).distinct()
        bits = valid.withColumn("bits", F.concat(F.lpad(F.conv(F.substring(f"{name}_hash", 1, 8), 16, 2), 32, "0"), F.lpad(F.conv(F.substring(f"{name}_hash", 9, 8), 16, 2), 32, "0")))
        parts = F.array(*(F.substring("bits", a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)))
        return bits.select(name, f"{name}_hash", F.posexplode(parts).alias("band", "part"))

    left, right = cut(queries, "query_id"), cut(images, "other_id")
    met = left.join(right, ["band", "part"]).where(F.col("query_id") != F.col("other_id")).select("query_id", "other_id", "query_id_hash", "other_id_hash").distinct()
    return met.withColumn("distance", hamming(F.col("query_id_hash"), F.col("other_id_hash"))).where(F.col("distance") <= radius).select("query_id", F.col("other_id").alias("image_id"), "distance")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = batch.column(0).to_numpy()
        parts = [h[a : a + BLOCK] for a in range(0, len(h), BLOCK)]
        yield pa.record_batch([pa.array(parts, pa.list_(pa.int64()))], names=["block"])


def _within(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, o in zip(batch.column("q"), batch.column("o"), strict=True):
                q, o = q.values.to_numpy(), o.values.to_numpy()
                distance = np.bitwise_count(q.view(np.uint64)[:, None] ^ o.view(np.uint64)[None, :])
                x, y = np.nonzero(distance <= radius)
                if len(x):
                    yield pa.record_batch([pa.array(q[x]), pa.array(o[y]), pa.array(distance[x, y].astype(np.int32))], names=["query_hash", "other_hash", "distance"])

    return run


def _compared(images: DataFrame, queries: DataFrame, radius: int, key: str, phash: str) -> DataFrame:
    """All different hashes of both sides, compared in blocks of BLOCK; ids are joined to the pairs found."""
    ship(images.sparkSession)

    def hashes(rows: DataFrame, name: str, number: str) -> DataFrame:
        valid = rows.select(F.col(key).alias(name), F.lower(phash).alias("_h")).where(F.col("_h").rlike("^[0-9a-f]{16}$"))
        return valid.select(name, F.shiftleft(high_half(F.col("_h")).cast("long"), 32).bitwiseOR(low_half(F.col("_h")).cast("long")).alias(number)).distinct()

    left, right = hashes(queries, "query_id", "query_hash"), hashes(images, "other_id", "other_hash")
    q, o = (rows.select(c).distinct().mapInArrow(_blocks, "block array<long>").withColumnRenamed("block", name) for rows, c, name in ((left, "query_hash", "q"), (right, "other_hash", "o")))
    met = o.crossJoin(q).mapInArrow(_within(radius), "query_hash long, other_hash long, distance int")
    return met.join(left, "query_hash").join(right, "other_hash").where(F.col("query_id") != F.col("other_id")).select("query_id", F.col("other_id").alias("image_id"), "distance").distinct()


def area_alike(w1: Column, h1: Column, w2: Column, h2: Column, low: float = 0.25, high: float = 4.0) -> Column:
    """Whether two areas are within the allowed ratio."""
    return F.coalesce(F.try_divide((w1 * h1).cast("double"), w2 * h2).between(low, high), F.lit(False))


def decide(same_doc: Column, same_sha: Column, distance: Column, embedding: Column, geometry: Column) -> tuple[Column, Column]:
    """(score, level) of a pair: equal content 1; hashes too far apart 0; with an embedding .75 of it, .15 of the geometry
    and .10 of the hash; else .6 of the hash and .4 of the geometry."""
    hashed = 1 - distance / 64.0
    geo = F.coalesce(geometry, F.lit(0.0))
    score = F.when(same_doc, 0.0).when(same_sha, 1.0).when(distance > 18, 0.0).when(embedding.isNotNull(), 0.75 * embedding + 0.15 * geo + 0.10 * hashed).otherwise(0.6 * hashed + 0.4 * geo)
    return score, F.when(score >= 0.9, "high").when(score >= 0.72, "medium").when(score > 0, "low").otherwise("none")


def changed_documents(listed: DataFrame, stored: DataFrame, key: str = "doc_id", size: str = "file_size", mtime: str = "file_mtime") -> DataFrame:
    """Listed documents that are new or whose size or time differ from what is stored."""
    known = stored.select(F.col(key).alias("_k"), F.col(size).alias("_s"), F.col(mtime).alias("_t"))
    return listed.join(known, (listed[key] == known["_k"]) & listed[size].eqNullSafe(known["_s"]) & listed[mtime].eqNullSafe(known["_t"]), "left_anti")


def pruned(stored: DataFrame, listed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Stored rows whose document is listed no more."""
    return stored.join(listed.select(key).distinct(), key, "left_anti")
