"""Two typed documents compared: items by type, nearest values by name, and totals against details."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import ship


def largest_by_type(items: DataFrame, keys: Sequence[str], amount: str = "amount") -> DataFrame:
    """Of items of one key the one with the largest absolute amount; ties go to the larger amount."""
    return items.groupBy(*keys).agg(F.max_by(amount, F.struct(F.abs(amount), amount)).alias(amount))


def compare_items(left: DataFrame, right: DataFrame, keys: Sequence[str], amount: str = "amount", tolerance: float = 0.01, ratio: float = 0.2) -> DataFrame:
    """(keys, left_amount, right_amount, delta, level): a full outer comparison, missing sides as 0.

    RED beyond ``ratio`` of the left amount, YELLOW beyond ``tolerance`` of it, else GREEN.
    """
    a = left.select(*keys, F.col(amount).alias("left_amount"))
    b = right.select(*keys, F.col(amount).alias("right_amount"))
    out = a.join(b, list(keys), "full_outer").fillna(0.0, ["left_amount", "right_amount"])
    delta = F.col("right_amount") - F.col("left_amount")
    share = F.coalesce(F.try_divide(F.abs(delta), F.abs("left_amount")), F.when(delta == 0, 0.0).otherwise(1.0))
    return out.withColumn("delta", delta).withColumn("level", F.when(share > ratio, "RED").when(share > tolerance, "YELLOW").otherwise("GREEN"))


def total_conflicts(totals: DataFrame, details: DataFrame, key: str, total: str, amount: str, tolerance: float) -> DataFrame:
    """(key, total, details, delta): stated totals that differ from the sum of their details by more than the tolerance."""
    sums = details.groupBy(key).agg(F.sum(amount).alias("details"))
    return totals.select(key, F.col(total).alias("total")).join(sums, key).withColumn("delta", F.col("details") - F.col("total")).where(F.abs(F.round("delta", 6)) > tolerance)


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.assign(gap=(frame["left_value"] - frame["right_value"]).abs()).sort_values(["gap", "left_id", "right_id"])
    used_left, used_right, rows = set(), set(), []
    for r in frame.itertuples():
        if r.left_id not in used_left and r.right_id not in used_right:
            used_left.add(r.left_id), used_right.add(r.right_id)
            rows.append((r.pair, r.name, r.left_id, r.right_id, r.gap))
    return pd.DataFrame(rows, columns=["pair", "name", "left_id", "right_id", "gap"])


def match_metrics(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, name, left_id, right_id, gap): metrics of one name in two documents, nearest values first, each used once.

    Inputs: (pair, name, id, value). Greedy one-to-one matching depends on order, so it runs by pair and name, over all
    combinations of what two documents say under one name, which are a handful.
    """
    ship(left.sparkSession)
    a = left.select("pair", "name", F.col("id").cast("long").alias("left_id"), F.col("value").cast("double").alias("left_value")).dropna()
    b = right.select("pair", "name", F.col("id").cast("long").alias("right_id"), F.col("value").cast("double").alias("right_value")).dropna()
    return a.join(b, ["pair", "name"]).groupBy("pair", "name").applyInPandas(_greedy, "pair string, name string, left_id long, right_id long, gap double")


def first_nonempty(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """(key, columns): of several sources of one record the first non-empty value of each column, by order."""
    return rows.groupBy(key).agg(*(F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.col(order))).alias(c) for c in columns))


def first_match(rows: DataFrame, key: str, levels: Sequence, tie: Sequence[str]) -> DataFrame:
    """Progressive relaxation: of each key the rows that satisfy the strictest of the conditions, the first by ``tie``."""
    level = F.coalesce(*(F.when(cond, F.lit(i)) for i, cond in enumerate(levels)))
    order = Window.partitionBy(key).orderBy("level", *tie)
    return rows.withColumn("level", level).where("level is not null").withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
