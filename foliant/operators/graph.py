"""Graphs as node and edge tables: co-occurrence, hops, PageRank, label propagation, communities and their migration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import Stash


def cooccurrence(members: DataFrame, group: str, item: str, most: int = 120) -> DataFrame:
    """(a, b, weight): how many groups two items share. Of a group the first ``most`` items by id count (the operator's
    rule, which also bounds the pairs a group can give)."""
    order = Window.partitionBy(group).orderBy(item)
    few = members.select(group, item).dropna().distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    other = few.select(group, F.col(item).alias("b"))
    return few.select(group, F.col(item).alias("a")).join(other, group).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst, weight) of undirected (a, b, weight)."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(edges.select("b", "a", "weight"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(node, hop): nodes within so many steps of the seeds, and the least number of steps. Nodes already met aren't expanded again."""
    arrows = both_ways(edges).select("src", "dst").distinct()
    seen = seeds.select("node", F.lit(0).alias("hop")).distinct()
    front = seen
    for hop in range(1, hops + 1):
        met = front.join(arrows, front["node"] == arrows["src"]).select(F.col("dst").alias("node")).distinct()
        front = met.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        seen = seen.union(front)
    return seen


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, every: int = 5, stash: Stash | None = None) -> DataFrame:
    """(node, score) by power iteration on (src, dst, weight); what dangling nodes hold is spread over all.

    Ranks start at 1 / n. Contributions are combined by target before the shuffle; lineage is cut every few rounds.
    """
    spark = edges.sparkSession
    stash = stash or Stash(spark)
    arrows = stash.keep(edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "arrows")
    out = arrows.groupBy("src").agg(F.sum("weight").alias("total"))
    nodes = stash.keep(arrows.select(F.col("src").alias("node")).union(arrows.select("dst")).distinct(), "nodes")
    count = nodes.count()
    if not count:
        return nodes.withColumn("score", F.lit(0.0))
    shares = stash.keep(arrows.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "shares")
    ranks = nodes.withColumn("score", F.lit(1.0 / count))
    ends = nodes.join(out, nodes["node"] == out["src"], "left_anti")
    dangling = stash.keep(ends, "dangling") if ends.take(1) else None
    for number in range(rounds):
        given = ranks.join(shares, ranks["node"] == shares["src"]).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        every_node = nodes.join(given, "node", "left")
        if dangling is None:
            every_node = every_node.withColumn("lost", F.lit(0.0))
        else:
            every_node = every_node.crossJoin(F.broadcast(ranks.join(dangling, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))))
        ranks = every_node.select("node", ((1 - damping) / count + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / count)).alias("score"))
        if (number + 1) % every == 0:
            ranks = stash.keep(ranks, "ranks")
    return ranks


def label_propagation(edges: DataFrame, rounds: int = 5, stash: Stash | None = None, settle: bool = False) -> DataFrame:
    """(node, label): deterministic label propagation on undirected (a, b, weight).

    All nodes take at once the label with the greatest weight among their neighbours and themselves (with the weight of
    their strongest edge); ties go to the smallest label. Communities of other algorithms differ in their labels. With
    ``settle`` it ends once labels are stable or repeat every other round, with those that all ``rounds`` would give.
    """
    stash = stash or Stash(edges.sparkSession)
    arrows = stash.keep(both_ways(edges), "arrows")
    own = arrows.groupBy("src").agg(F.max("weight").alias("weight"))
    loops = own.select(F.col("src"), F.col("src").alias("dst"), "weight")
    around = stash.keep(arrows.union(loops), "around")
    labels = own.select(F.col("src").alias("node"), F.col("src").alias("label"))
    seen: list[DataFrame] = [labels]
    for number in range(rounds):
        votes = around.join(labels, around["dst"] == labels["node"]).groupBy("src", "label").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("votes")).alias("less"), "label")).alias("m"))
        labels = stash.keep(best.select(F.col("src").alias("node"), F.col("m.label").alias("label")), "labels")
        if settle:
            same = lambda old, new=labels: not old.withColumnRenamed("label", "old").join(new, "node").where("old <> label").take(1)
            if same(seen[-1]):
                break
            if len(seen) > 1 and same(seen[-2]):
                return labels if (rounds - number - 1) % 2 == 0 else seen[-1]
            seen = [seen[-1], labels]
    return labels


def community_summary(labels: DataFrame, names: int = 8, stash: Stash | None = None) -> DataFrame:
    """(label, size, members, rank): size, the first member ids, and rank by size of each community."""
    order = Window.partitionBy("label").orderBy("node")
    ranked = labels.withColumn("_r", F.row_number().over(order))
    members = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= names, F.col("node")))), lambda n: n.cast("string"))
    out = ranked.groupBy("label").agg(F.count("*").alias("size"), F.concat_ws(",", members).alias("members"))
    return numbered(out, [F.desc("size"), F.col("label")], "rank", stash)


def numbered(rows: DataFrame, order: Sequence, name: str, stash: Stash | None = None) -> DataFrame:
    """Rows numbered from 1 in a total order: ranges of it are counted, then numbered each in a task of its own."""
    stash = stash or Stash(rows.sparkSession)
    ranged = stash.keep(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_w", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_w")).drop("_part", "_w", "_before")


def migration_links(before: DataFrame, after: DataFrame, levels: Sequence[float] = (0.05, 0.005, 0.0)) -> DataFrame:
    """(source, target, shared, jaccard): communities of two windows that share keywords, at the strictest level of
    Jaccard that leaves any link. Inputs: (community, keyword), distinct."""
    size = lambda rows, name: rows.groupBy("community").agg(F.count("*").alias(name))
    b, a = before.distinct(), after.distinct()
    shared = b.withColumnRenamed("community", "source").join(a.withColumnRenamed("community", "target"), "keyword").groupBy("source", "target").agg(F.count("*").alias("shared"))
    sized = shared.join(size(b, "nb").withColumnRenamed("community", "source"), "source").join(size(a, "na").withColumnRenamed("community", "target"), "target")
    scored = sized.withColumn("jaccard", F.col("shared") / (F.col("nb") + F.col("na") - F.col("shared")))
    ladder = F.array(*(F.lit(float(x)) for x in levels))
    top = scored.agg(F.max("jaccard").alias("top")).select(F.coalesce(F.try_element_at(F.filter(ladder, lambda x: F.col("top") >= x), F.lit(1)), F.lit(0.0)).alias("level"))
    return scored.crossJoin(F.broadcast(top)).where(F.col("jaccard") >= F.col("level")).select("source", "target", "shared", "jaccard")


#: Edges that one task takes for communities by modularity.
MODULARITY_EDGES = 150_000
RESOLUTIONS = (0.4, 0.6, 0.8, 1.0, 1.2, 1.5, 2.0, 3.0)


def louvain(edges: DataFrame, resolution: float = 1.0, limit: int = MODULARITY_EDGES) -> DataFrame:
    """(node, community) by modularity: nodes move, in order, to the neighbouring community with the greatest gain until none
    moves; communities become nodes, and so on. A community is named by its smallest node; ties go to the smaller name.

    Undirected (a, b, weight) of at most ``limit`` edges (checked; every move depends on all before, so it is one task's
    work); larger graphs have ``label_propagation``.
    """
    from foliant.session import ship

    if edges.count() > limit:
        raise ValueError(f"more than {limit} edges: use label_propagation")
    ship(edges.sparkSession)
    rows = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("weight"), F.lit(0).alias("k"))
    return rows.groupBy("k").applyInPandas(lambda frame: _louvain(frame, resolution), "node long, community long")


def nearest_resolution(edges: DataFrame, target: int, resolutions: Sequence[float] = RESOLUTIONS) -> tuple[float, DataFrame]:
    """Of the communities at several resolutions those whose number is nearest to ``target``; ties to the smaller resolution."""
    best: tuple[int, float, DataFrame] | None = None
    for r in resolutions:
        found = louvain(edges, r)
        off = abs(found.select("community").distinct().count() - target)
        if best is None or off < best[0]:
            best = (off, r, found)
    return best[1], best[2]


def _louvain(frame, resolution: float):
    import pandas as pd

    near: dict[int, dict[int, float]] = {}
    for a, b, w in zip(frame["a"].tolist(), frame["b"].tolist(), frame["weight"].tolist(), strict=True):
        near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0.0) + w
        if a != b:
            near.setdefault(b, {})[a] = near.setdefault(b, {}).get(a, 0.0) + w
    whole = sum(w * (2 if u == v else 1) for u, out in near.items() for v, w in out.items())
    home = {u: u for u in near}  # node → the community that holds it, by way of its level
    while True:
        weight = {u: sum(w * (2 if u == v else 1) for v, w in out.items()) for u, out in near.items()}
        own = {u: u for u in near}
        total = dict(weight)
        moved, moved_any = True, False
        while moved:
            moved = False
            for u in sorted(near):
                now = own[u]
                total[now] -= weight[u]
                to: dict[int, float] = {now: 0.0}
                for v, w in near[u].items():
                    if v != u:
                        to[own[v]] = to.get(own[v], 0.0) + w
                gain = {c: w - resolution * weight[u] * total[c] / whole for c, w in to.items()}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c))
                if gain[best] <= gain[now] + 1e-12:
                    best = now
                total[best] += weight[u]
                if best != now:
                    own[u], moved, moved_any = best, True, True
        if not moved_any:
            break
        name: dict[int, int] = {}
        for u in sorted(near):
            name.setdefault(own[u], u)
        home = {u: name[own[c]] for u, c in home.items()}
        merged: dict[int, dict[int, float]] = {}
        for u, out in near.items():
            for v, w in out.items():
                if u <= v:
                    a, b = sorted((name[own[u]], name[own[v]]))
                    merged.setdefault(a, {})[b] = merged.setdefault(a, {}).get(b, 0.0) + w
                    if a != b:
                        merged.setdefault(b, {})[a] = merged[a][b]
                    else:
                        merged.setdefault(a, {})
        near = merged
    least: dict[int, int] = {}
    for u in sorted(home):
        least.setdefault(home[u], u)
    return pd.DataFrame([(u, least[c]) for u, c in sorted(home.items())], columns=["node", "community"])
