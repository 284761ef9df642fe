"""Panels over time: yearly states, growth, findings over two windows, and policy shocks on a baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def yearly(facts: DataFrame, key: str, year: str, funded: Column, amount: Column) -> DataFrame:
    """(key, year, applications, funded, funding, requested): one row for each key and year that has facts."""
    return facts.groupBy(key, year).agg(F.count("*").alias("applications"), F.count_if(funded).alias("funded"), F.sum(F.when(funded, amount).otherwise(0.0)).alias("funding"), F.sum(amount).alias("requested"))


def baseline(panel: DataFrame, key: str, year: str = "year", recent: int = 2) -> DataFrame:
    """(key, applications, funded, funding, funded_ratio, avg_award, growth, recent_share, scale): the state of each key.

    growth: .6 of the applications' and .4 of the funding's change from its first to its last year, within [-1, 1].
    recent_share: applications in the last years of the whole panel. scale: log1p of applications over the largest.
    """
    order = Window.partitionBy(key).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(order).cast("double")
    last = lambda c: F.last(c).over(order).cast("double")
    change = lambda c: clamp(F.coalesce(F.try_divide(last(c) - first(c), first(c)), F.lit(0.0)), -1.0)
    marked = panel.withColumn("_growth", 0.6 * change("applications") + 0.4 * change("funding")).crossJoin(F.broadcast(panel.agg(F.max(year).alias("_latest"))))
    out = marked.groupBy(key).agg(
        F.sum("applications").alias("applications"), F.sum("funded").alias("funded"), F.sum("funding").alias("funding"), F.max("_growth").alias("growth"),
        F.sum(F.when(F.col(year) > F.col("_latest") - recent, F.col("applications")).otherwise(0)).alias("_recent"),
    )
    out = out.crossJoin(F.broadcast(out.agg(F.max("applications").alias("_most"))))
    return out.select(
        key, "applications", "funded", "funding",
        F.coalesce(F.try_divide(F.col("funded").cast("double"), F.col("applications")), F.lit(0.0)).alias("funded_ratio"),
        F.coalesce(F.try_divide("funding", F.col("funded")), F.lit(0.0)).alias("avg_award"), "growth",
        F.coalesce(F.try_divide(F.col("_recent").cast("double"), F.col("applications")), F.lit(0.0)).alias("recent_share"),
        (F.log1p("applications") / F.log1p("_most")).alias("scale"),
    )


def span_stats(panel: DataFrame, key: str, year: str = "year") -> DataFrame:
    """One row: how many keys were active in one year and in several, and for how many years."""
    active = panel.groupBy(key).agg(F.countDistinct(year).alias("years"))
    return active.agg(F.count_if(F.col("years") == 1).alias("single_year"), F.count_if(F.col("years") > 1).alias("multi_year"), F.avg("years").alias("avg_years"), F.max("years").alias("max_years"))


def two_windows(before: DataFrame, after: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Both windows side by side, missing sides as 0."""
    left = before.select(key, *(F.col(m).alias(f"{m}_before") for m in metrics))
    right = after.select(key, *(F.col(m).alias(f"{m}_after") for m in metrics))
    return left.join(right, key, "full_outer").fillna(0, [f"{m}_{w}" for m in metrics for w in ("before", "after")])


def findings(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(key, finding, severity): one row for each rule (name, severity, condition) that holds. Unknown conditions don't."""
    checks = F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity"))) for name, severity, cond in rules))
    return rows.select(key, F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("f")).select(key, "f.finding", "f.severity")


def apply_shocks(states: DataFrame, shocks: DataFrame, key: str, spill: float = 0.3, least: float = 0.6, neighbours: int = 8) -> DataFrame:
    """(key, effect, direct, spillover): effects of shocks on their targets, and on the states most like them.

    shocks: (shock_id, target, strength, lag); a null target means all. Strength is dampened by max(.35, 1 - .15 lag).
    Spillover goes to at most ``neighbours`` other states with a similarity of scale and funded ratio of at least ``least``.
    States are a bounded summary (one row for each topic); shocks are a small table of a scenario.
    """
    effect = F.col("strength") * F.greatest(F.lit(0.35), 1 - 0.15 * F.col("lag"))
    hits = shocks.withColumn("effect", effect)
    direct = hits.where("target is not null").select("shock_id", F.col("target").alias(key), "effect").unionByName(hits.where("target is null").select("shock_id", "effect").join(states.select(key)).select("shock_id", key, "effect"))
    direct = direct.join(states.select(key), key, "left_semi")
    a, b = states.select(F.col(key).alias("_a"), F.col("scale").alias("_sa"), F.col("funded_ratio").alias("_ra")), states.select(F.col(key).alias("_b"), F.col("scale").alias("_sb"), F.col("funded_ratio").alias("_rb"))
    like = 0.5 * (1 - F.abs(F.col("_sa") - F.col("_sb"))) + 0.5 * (1 - F.abs(F.col("_ra") - F.col("_rb")))
    targets = direct.select(F.col(key).alias("_a")).distinct()
    near = a.join(targets, "_a", "left_semi").join(b, (F.col("_a") != F.col("_b"))).withColumn("like", like).where(F.round("like", 9) >= least)
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("_a").orderBy(F.desc(F.round("like", 9)), "_b"))).where(F.col("_r") <= neighbours)
    spread = direct.join(near, direct[key] == near["_a"]).select(F.col("_b").alias(key), (F.col("effect") * F.col("like") * spill).alias("spillover"))
    return states.select(key).join(direct.groupBy(key).agg(F.sum("effect").alias("direct")), key, "left").join(spread.groupBy(key).agg(F.sum("spillover").alias("spillover")), key, "left").fillna(0.0, ["direct", "spillover"]).withColumn("effect", F.col("direct") + F.col("spillover"))


def compounded(steps: DataFrame, key: str, order: str, rate: str, start: float = 1.0) -> DataFrame:
    """(key, value): rates applied one after the other, start × Π (1 + rate), kept at 0 or more after each step."""
    ordered = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rate).alias("r")))).alias("s"))
    return ordered.select(key, F.aggregate("s", F.lit(start), lambda acc, x: F.greatest(F.lit(0.0), acc * (1 + x["r"]))).alias("value"))
