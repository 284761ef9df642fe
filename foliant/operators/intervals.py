"""Spans of text as half-open intervals: islands, lengths of unions, range semi and anti joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """(keys, start, end, parts): spans that touch, overlap, or lie at most ``gap`` apart, merged. Empty or null spans don't count."""
    valid = spans.where(F.col(start) < F.col(end))
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce((F.col(start) > F.max(end).over(before) + gap).cast("int"), F.lit(1))
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    marked = valid.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(upto))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def union_length(spans: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, covered, islands): positions covered by at least one span of a key."""
    return islands(spans, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count("*").alias("islands"))


def _hits(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, cell: int) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides bucketed by cells of positions, so that the range condition becomes an equality and a check."""
    cells = islands(spans, keys, start, end).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))).alias("_cell"))
    left = points.withColumn("_cell", F.floor(F.col(at) / cell))
    return left, cells, (F.col(at) >= F.col("_s")) & (F.col(at) < F.col("_e"))


def outside(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "pos", start: str = "start", end: str = "end", cell: int = 1024) -> DataFrame:
    """The points that lie in no span of their key."""
    left, cells, inside = _hits(points, spans, keys, at, start, end, cell)
    on = [left[k].eqNullSafe(cells[k]) for k in keys]
    return left.join(cells, [left["_cell"] == cells["_cell"], *on, inside], "left_anti").drop("_cell")


def inside(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str = "pos", start: str = "start", end: str = "end", cell: int = 1024) -> DataFrame:
    """The points that lie in a span of their key, once each."""
    left, cells, cond = _hits(points, spans, keys, at, start, end, cell)
    on = [left[k].eqNullSafe(cells[k]) for k in keys]
    return left.join(cells, [left["_cell"] == cells["_cell"], *on, cond], "left_semi").drop("_cell")


def mask(text: Column, spans: Column) -> Column:
    """The text with each span (start, end) of an array replaced by spaces, so that offsets stay."""
    return F.aggregate(spans, text, lambda acc, s: F.overlay(acc, F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
