"""Grouping: spherical k-means, linkage, splitting and capacity-bound reassignment, balance and purity, risk flags, titles."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import cosine
from foliant.session import Stash, ship

#: Numbers of the centres broadcast at most (8 bytes each).
CENTRE_NUMBERS = 16_000_000


def spherical_kmeans(vectors: DataFrame, k: int, rounds: int = 10, seed: int = 42, vector_id: str = "vec_id", vector: str = "embedding", stash: Stash | None = None) -> DataFrame:
    """(vec_id, cluster) by cosine. Centres start at the k vectors with the smallest hashes; an empty cluster keeps its centre.

    Each round is one pass: centres (k × dimensions, checked against CENTRE_NUMBERS) are broadcast, partitions sum their
    members by cluster, and only these sums are shuffled. Null vectors are left out; with at most k vectors each is a
    cluster of its own.
    """
    spark = vectors.sparkSession
    ship(spark)
    stash = stash or Stash(spark)
    base = stash.keep(vectors.select(F.col(vector_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).dropna(), "vectors")
    start = base.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(k).select("v").toPandas()
    if start.empty:
        return base.select("vec_id", F.lit(0).alias("cluster"))
    centres = _units(np.stack(start["v"].to_numpy()))
    if centres.size > CENTRE_NUMBERS:
        raise ValueError("more centres than may be broadcast; cluster in two levels")

    def nearest(block: pd.DataFrame, centres: np.ndarray) -> np.ndarray:
        return np.argmax(np.round(_units(np.stack(block["v"].to_numpy())) @ centres.T, 9), axis=1)

    def sums(batches, shared):
        total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), np.int64)
        for block in batches:
            if len(block):
                own = nearest(block, shared.value)
                np.add.at(total, own, _units(np.stack(block["v"].to_numpy())))
                count += np.bincount(own, minlength=len(count))
        yield pd.DataFrame({"cluster": np.arange(len(count)), "n": count, "s": list(total)})

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)
        found = base.mapInPandas(lambda it, b=shared: sums(it, b), "cluster int, n long, s array<double>").where("n > 0")
        each = found.select("cluster", "n", F.posexplode("s").alias("place", "x")).groupBy("cluster", "place").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("s")).toPandas()
        fresh = centres.copy()
        for row in each.itertuples():
            fresh[row.cluster] = _units(np.asarray(row.s)[None, :])[0]
        moved = float(np.abs(fresh - centres).max())
        centres = fresh
        if moved < 1e-9:
            break
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for block in batches:
            yield pd.DataFrame({"vec_id": block["vec_id"], "cluster": nearest(block, shared.value) if len(block) else np.zeros(0, int)})

    return base.mapInPandas(assign, "vec_id long, cluster int")


def _units(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def balance(groups: DataFrame, group: str = "cluster", subject: str = "label") -> DataFrame:
    """One row: groups, balance (1 - population deviation / mean of sizes, at least 0), purity (mean share of the most
    frequent subject), and the mean of both."""
    counted = groups.groupBy(group, subject).agg(F.count("*").alias("n"))
    sizes = counted.groupBy(group).agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    out = sizes.agg(F.count("*").alias("groups"), F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_pop("size"), F.avg("size"))).alias("balance"), F.avg(F.col("top") / F.col("size")).alias("purity"))
    return out.withColumn("score", (F.col("balance") + F.col("purity")) / 2)


def dominant_subject(groups: DataFrame, group: str, subject: str) -> DataFrame:
    """(group, subject, members): the most frequent subject of each group; ties to the smallest."""
    counted = groups.where(F.col(subject).isNotNull()).groupBy(group, subject).agg(F.count("*").alias("members"))
    best = counted.groupBy(group).agg(F.min(F.struct((-F.col("members")).alias("less"), F.col(subject).alias("s"))).alias("m"))
    return best.select(group, F.col("m.s").alias(subject), (-F.col("m.less")).alias("members"))


def risk_flags(groups: DataFrame, centres: DataFrame, group: str = "cluster", subject: str = "label", vector: str = "embedding", far: float = 0.45, low: int = 3, high: int = 60) -> DataFrame:
    """(id columns, flags): members whose group mixes subjects, whose subject occurs once in it, that lie far from its
    centre, or whose group has an exceptional size. centres: (group, center)."""
    size = F.count("*").over(Window.partitionBy(group))
    same = F.count("*").over(Window.partitionBy(group, subject))
    out = groups.withColumn("_size", size).withColumn("_same", same).join(centres, group)
    flags = F.array_compact(
        F.array(
            F.when(F.col("_same") < F.col("_size"), "mixed_subjects"),
            F.when(F.col("_same") == 1, "singleton_subject"),
            F.when(F.round(cosine(F.col(vector), F.col("center")), 6) < far, "outlier"),
            F.when(~F.col("_size").between(low, high), "size_exception"),
        )
    )
    return out.withColumn("flags", flags).drop("_size", "_same", "center", vector)


def interleave(rows: DataFrame, group_count: int, order_desc: str, tie: str) -> DataFrame:
    """Items dealt out by quality in turn: rank 1 to group 0, rank 2 to group 1, and so on."""
    # ranks are counted in ranges of quality first, so that the whole table is never sorted in one task
    stash = Stash(rows.sparkSession)
    ranged = stash.keep(rows.repartitionByRange(F.desc(order_desc), tie).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(order_desc), tie))
    return ranged.withColumn("_w", within).join(F.broadcast(before), "_part").withColumn("group", F.pmod(F.col("_before") + F.col("_w") - 1, F.lit(group_count)).cast("int")).drop("_part", "_w", "_before")


#: Vectors of one bucket that linkage takes; it needs all their similarities at once. Words have no such limit.
LINKAGE = 3_000


def _word_linkage(sets: list[frozenset], least: float, to: int) -> np.ndarray:
    """The first member of each member's cluster. Only what can count is held: a merge needs two members that are alike by
    ``least``, so clusters stay within the parts that such pairs connect, and only similarities above 0 within a part are kept."""
    heads: dict[frozenset, int] = {}
    # equal sets merge before all others; under a number of clusters their order counts, so then each is by itself
    copy_of = np.array([i if to > 1 or not x or least > 1 else heads.setdefault(x, i) for i, x in enumerate(sets)], int)
    own, size = copy_of.copy(), np.bincount(copy_of, minlength=len(sets)).astype(float).tolist()
    each = np.flatnonzero(copy_of == np.arange(len(sets))).tolist()
    postings: dict = {}
    for i in each:
        for x in sets[i]:
            postings.setdefault(x, []).append(i)
    held = {x: np.array(v) for x, v in postings.items()}
    lens = np.array([len(x) for x in sets], float)

    def like(i: int) -> tuple[np.ndarray, np.ndarray]:
        """The members after i that share a word with it, and how similar they are."""
        met = [v[np.searchsorted(v, i, "right") :] for v in (held[x] for x in sets[i])]
        others, same = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, int), np.zeros(0))
        return others, same / (lens[i] + lens[others] - same)

    part = list(range(len(sets)))

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = i = part[part[i]]
        return i

    for i in each:
        others, s = like(i)
        for j in others[np.round(s, 9) >= least].tolist() if least > 0 else each:
            part[root(j)] = root(i)
    near: dict[int, dict[int, float]] = {i: {} for i in each}  # sums over the members' pairs: a mean of rounded means would drift off a tie
    heap = []
    mean = lambda i, j: round(near[i][j] / (size[i] * size[j]), 9)
    for i in each:
        others, s = like(i)
        mine = root(i)
        for j, x in zip(others.tolist(), s.tolist(), strict=True):
            if root(j) == mine:
                near[i][j] = near[j][i] = x * size[i] * size[j]
                if mean(i, j) >= least:
                    heap.append((-mean(i, j), i, j))
    if least <= 0:  # what has nothing in common may merge as well
        for i, j in itertools.combinations(each, 2):
            if j not in near[i]:
                near[i][j] = near[j][i] = 0.0
                heap.append((-0.0, i, j))
    heapq.heapify(heap)
    alive, into = len(near), {}
    while heap and alive > to:
        x, i, j = heapq.heappop(heap)  # the highest; of equal ones the smallest names
        if i not in near or j not in near[i] or mean(i, j) != -x:
            continue
        a, b = near[i], near.pop(j)
        del a[j], b[i]
        size[i] += size[j]
        into[j] = i
        for k in {*a, *b}:
            a[k] = near[k][i] = a.get(k, 0.0) + b.get(k, 0.0)
            near[k].pop(j, None)
            if (x := mean(i, k)) >= least:
                heapq.heappush(heap, (-x, min(i, k), max(i, k)))
        alive -= 1
    for j in sorted(into):  # a cluster goes into one of a smaller name, which is settled by then
        into[j] = into.get(into[j], into[j])
    return np.array([into.get(i, i) for i in own.tolist()], int)


def average_linkage(items: DataFrame, bucket: str, key: str, features: str, least: float, kind: str = "words", to: int | None = None) -> DataFrame:
    """(bucket, key, cluster): within each bucket the two clusters with the highest mean similarity are merged while it is at
    least ``least`` and, if given, more than ``to`` clusters are left. A cluster is named by its smallest key.

    kind: "words" (arrays compared by Jaccard) or "vectors" (by cosine). Ties go to the smaller names. Buckets of more than
    LINKAGE vectors are refused: split them first, as ``split_oversize`` does.
    """
    ship(items.sparkSession)
    kinds = dict(items.dtypes)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key).reset_index(drop=True)
        n = len(frame)
        if kind == "words":
            own = _word_linkage([frozenset(x) if x is not None else frozenset() for x in frame[features]], least, max(1, to or 1))
            return pd.DataFrame({bucket: frame[bucket], key: frame[key], "cluster": frame[key].to_numpy()[own]})
        if n > LINKAGE:
            raise ValueError(f"more than {LINKAGE} vectors in one bucket")
        u = _units(np.stack([np.asarray(v, float) for v in frame[features]]))
        s = u @ u.T
        own, size = np.arange(n), np.ones(n)
        s = np.round(s, 12)
        np.fill_diagonal(s, -2.0)
        alive = n
        while alive > max(1, to or 1):
            i, j = divmod(int(np.argmax(s)), n)  # the first of the highest: smallest names
            if s[i, j] < least:
                break
            i, j = min(i, j), max(i, j)
            row = np.round((s[i] * size[i] + s[j] * size[j]) / (size[i] + size[j]), 12)
            row[s[i] == -2.0], row[s[j] == -2.0] = -2.0, -2.0
            s[i], s[:, i] = row, row
            s[i, i] = s[i, j] = s[j, i] = -2.0
            s[j], s[:, j] = -2.0, -2.0
            size[i] += size[j]
            own[own == j] = i
            alive -= 1
        return pd.DataFrame({bucket: frame[bucket], key: frame[key], "cluster": frame[key].to_numpy()[own]})

    rows = items.select(bucket, key, features).where(F.col(key).isNotNull() & F.col(bucket).isNotNull()).dropDuplicates([bucket, key])
    return rows.groupBy(bucket).applyInPandas(fold, f"`{bucket}` {kinds[bucket]}, `{key}` {kinds[key]}, cluster {kinds[key]}")


def group_count(members: int, target: int = 25, least: int = 1) -> int:
    """How many groups so many members make: as many as come nearest to the target size."""
    return max(least, int(members / target + 0.5)) if members else 0


def split_oversize(vectors: DataFrame, most: int, rounds: int = 6, stash: Stash | None = None) -> DataFrame:
    """(vec_id, cluster): (vec_id, embedding, cluster) with every cluster of more than ``most`` split in two at the mean of
    its widest axis, again and again, until none is larger or ``rounds`` are done; what is still larger then is cut by id."""
    stash = stash or Stash(vectors.sparkSession)
    now = stash.keep(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("cluster").cast("string").alias("cluster")), "clusters")
    for _ in range(rounds):
        sizes = now.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") > most)
        if not sizes.take(1):
            return now.select("vec_id", "cluster")
        large = now.join(sizes.select("cluster"), "cluster", "left_semi")
        # both halves of every large cluster in one pass: by the side of its mean on its widest axis
        axis = large.select("cluster", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "i").agg(F.stddev_pop("x").alias("d"), F.avg("x").alias("m"))
        widest = axis.groupBy("cluster").agg(F.max_by(F.struct("i", "m"), F.struct("d", -F.col("i"))).alias("w"))
        side = F.when(F.get("embedding", F.col("w.i")) > F.col("w.m"), "1").otherwise("0")
        halved = large.join(widest, "cluster").select("vec_id", "embedding", F.concat_ws(".", "cluster", side).alias("cluster"))
        now = stash.keep(now.join(sizes.select("cluster"), "cluster", "left_anti").select("vec_id", "embedding", "cluster").unionByName(halved), "clusters")
    number = F.row_number().over(Window.partitionBy("cluster").orderBy("vec_id"))
    return now.select("vec_id", F.concat_ws(".", "cluster", F.floor((number - 1) / most).cast("string")).alias("cluster"))


def reassign_small(members: DataFrame, least: int, most: int, rounds: int = 4) -> DataFrame:
    """(vec_id, cluster): members of clusters under ``least`` go, the most similar first, to the cluster whose centre is most
    like them among those with room under ``most``; centres are those of the start of a round. A round moves at most as many
    as a cluster has room for; what finds no room stays."""
    stash = Stash(members.sparkSession)
    now = stash.keep(members.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("cluster").cast("string").alias("cluster")), "members")
    for _ in range(rounds):
        sizes = stash.keep(now.groupBy("cluster").agg(F.count("*").alias("n")), "sizes")
        small = now.join(sizes.where(F.col("n") < least).select("cluster"), "cluster", "left_semi")
        open_ = sizes.where((F.col("n") >= least) & (F.col("n") < most)).select("cluster", (most - F.col("n")).alias("room"))
        centres = now.join(open_, "cluster").select("cluster", "room", F.posexplode("embedding").alias("i", "x")).groupBy("cluster", "room", "i").agg(F.avg("x").alias("x")).groupBy("cluster", "room").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
        if centres.count() * 4096 > CENTRE_NUMBERS:
            raise ValueError("more centres than may be broadcast; reassign in parts")
        scored = small.select("vec_id", F.col("embedding").alias("e")).crossJoin(F.broadcast(centres.withColumnRenamed("cluster", "goal"))).select("vec_id", "goal", "room", F.round(cosine(F.col("e"), F.col("c")), 9).alias("s"))
        best = scored.groupBy("vec_id").agg(F.max_by(F.struct("goal", "room", "s"), F.struct("s", F.hash("goal"))).alias("b")).select("vec_id", "b.*")
        taken = best.withColumn("r", F.row_number().over(Window.partitionBy("goal").orderBy(F.desc("s"), "vec_id"))).where(F.col("r") <= F.col("room")).select("vec_id", "goal")
        taken = stash.keep(taken, "taken")
        if not taken.take(1):
            break
        now = stash.keep(now.join(taken, "vec_id", "left").select("vec_id", "embedding", F.coalesce("goal", "cluster").alias("cluster")), "members")
    return now.select("vec_id", "cluster")


def group_titles(rows: DataFrame, group: str, title: str, key: str, first: int = 10, words: int = 2) -> DataFrame:
    """(group, title): the most frequent words (runs of 2 to 8 ideographs) in the first titles of each group, ties in order of
    the words."""
    few = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("_r") <= first)
    counted = few.select(group, F.explode(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"([一-鿿]{2,8})"), F.lit(1))).alias("w")).groupBy(group, "w").agg(F.count("*").alias("n"))
    top = counted.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "w"))).where(F.col("_r") <= words)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "w"))), lambda s: s["w"]).alias("t")).select(group, F.concat_ws("、", "t").alias("title"))
