"""Vectors: blocked cosine search of a query set, similarity graphs, and matching by score with exclusions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import ship

#: Numbers of the query side broadcast at most (8 bytes each); a larger query set is searched in several passes.
BROADCAST_NUMBERS = 16_000_000


def _unit(frame: pd.Series) -> np.ndarray:
    x = np.stack(frame.to_numpy()).astype(np.float64)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, cosine, rank): of every query vector the k most similar others; ties by id.

    Blocks of queries, each of a size that may be broadcast, are multiplied with all vectors where these lie; every partition only
    hands on its own k best of each query. All-zero vectors have cosine 0 with all; null ones are left out.
    """
    spark = vectors.sparkSession
    ship(spark)
    base = vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).dropna()
    asked = queries.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).dropna()
    shape = asked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    parts = max(1, -(-(shape.n * (shape.d or 1)) // BROADCAST_NUMBERS))
    out: DataFrame | None = None
    for part in range(parts):
        frame = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part).toPandas()
        if frame.empty:
            continue
        shared = spark.sparkContext.broadcast((frame["vec_id"].to_numpy(), _unit(frame["v"])))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best: dict[int, list[tuple[float, int]]] = {}
            for block in batches:
                if block.empty:
                    continue
                found = np.round(q @ _unit(block["v"]).T, 6)
                mine = block["vec_id"].to_numpy()
                found[ids[:, None] == mine[None, :]] = -2
                for i, row in enumerate(found):
                    cut = np.lexsort((mine, -row))[:k]
                    best[i] = sorted([*best.get(i, []), *((-row[j], int(mine[j])) for j in cut if row[j] > -2)])[:k]
            rows = [(int(ids[i]), v, -s) for i, found in best.items() for s, v in found]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "cosine"])

        found = base.mapInPandas(search, "query_id long, vec_id long, cosine double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mean_vectors(vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, center): component-wise means; partial sums of (key, place) are combined before the shuffle."""
    parts = vectors.where(F.col(key).isNotNull()).select(key, F.posexplode(vector).alias("place", "x")).groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("center"))


def knn_graph(neighbours: DataFrame, attributes: DataFrame, key: str, extra: Column, weights: tuple[float, float], least: float) -> DataFrame:
    """(a, b, weight): undirected edges from (query_id, vec_id, cosine), blended with an ``extra`` similarity of both ends'
    attributes (columns of ``attributes`` with the prefixes a_ and b_); the larger weight of the two directions counts."""
    left = attributes.select(*(F.col(c).alias(f"a_{c}") for c in attributes.columns))
    right = attributes.select(*(F.col(c).alias(f"b_{c}") for c in attributes.columns))
    joined = neighbours.join(left, F.col("query_id") == F.col(f"a_{key}")).join(right, F.col("vec_id") == F.col(f"b_{key}"))
    edges = joined.withColumn("weight", weights[0] * F.col("cosine") + weights[1] * extra)
    return edges.groupBy(F.least("query_id", "vec_id").alias("a"), F.greatest("query_id", "vec_id").alias("b")).agg(F.max("weight").alias("weight")).where(F.round("weight", 9) >= least)


def exclude_conflicts(pairs: DataFrame, left_unit: Column, right_unit: Column) -> DataFrame:
    """Pairs whose units are neither equal nor contained in one another; a missing unit conflicts with none."""
    clash = (left_unit == right_unit) | F.contains(left_unit, right_unit) | F.contains(right_unit, left_unit)
    return pairs.where(~F.coalesce(clash & (F.length(left_unit) > 0) & (F.length(right_unit) > 0), F.lit(False)))


def assign_top(scored: DataFrame, key: str, other: str, score: str, top: int) -> DataFrame:
    """The best ``top`` of each key; ties go to the later id, as a reversed stable sort has it."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.desc(other))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
