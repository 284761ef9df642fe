"""Groups from pairwise matches: deterministic Borůvka hooking over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from foliant.session import Stash

#: Rows under one key beyond which they are spread over SALTS tasks; fewer than rows / HOT keys can be so frequent.
HOT, SALTS = 1_000_000, 64


def counted(stash: Stash, df: DataFrame, label: str, value: Column | None = None) -> tuple[DataFrame, int]:
    """The frame, kept, and how many rows it has, or the sum of a value: seen while it is written."""
    seen = Observation()
    kept = stash.keep(df.observe(seen, F.coalesce(F.sum(F.lit(1) if value is None else value), F.lit(0)).alias("n")), label)
    return kept, int(seen.get.get("n") or 0)


def joined(many: DataFrame, one: DataFrame, key: str, rows: int) -> DataFrame:
    """Each row of many with the row of its key in one. A key with more than HOT of the rows is spread over SALTS tasks; in
    a table of no more rows there can't be one."""
    if rows <= HOT:
        return many.join(one, key)
    hot = F.broadcast(many.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(key, F.lit(SALTS).alias("_s")))
    salt = F.pmod(F.xxhash64(*many.columns), F.coalesce("_s", F.lit(1)))
    left = many.join(hot, key, "left").withColumn("_salt", salt).drop("_s")
    right = one.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_s", F.lit(1)).cast("long") - 1))).drop("_s")
    return left.join(right, [key, "_salt"]).drop("_salt")


def pointer_doubling(parents: DataFrame, rows: int, stash: Stash, limit: int = 64) -> DataFrame:
    """(node, parent) of a forest → (node, root). Roots point to themselves; depth halves with each pass."""
    now = parents
    for _ in range(limit):
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        next_ = joined(now.select("node", "parent"), up, "parent", rows).select("node", F.col("up").alias("parent"), (F.col("up") != F.col("parent")).alias("moved"))
        after, moved = counted(stash, next_, "doubled", F.col("moved").cast("long"))
        if now is not parents:
            stash.drop(now)
        now = after.select("node", "parent")
        now._foliant_path = after._foliant_path
        if not moved:
            return now
    raise RuntimeError("the parents hold a cycle")


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", stash: Stash | None = None) -> DataFrame:
    """(node, group_id) for every node with a link to another; group_id is the smallest node of its component.

    Each round, every component selects its smallest outgoing edge (edges are ordered by their ends, smaller end first),
    which gives trees with one two-way edge each; the smaller end of that becomes the root. Pointer doubling collapses
    the trees, and edges are relabelled, cleared of loops and repeats, until none is left. At least half of the
    components vanish in a round. All steps are partial aggregations and joins on narrow rows; in the joins, what hangs on
    one hub or root is spread over several tasks. Null ends and loops are no links. Links may come in either order and
    more than once.
    """
    spark = links.sparkSession
    stash = stash or Stash(spark)
    plain = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges, many = counted(stash, plain.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    label: DataFrame | None = None  # node → its component's name
    nodes = 0
    while many:
        both = edges.select(F.col("x").alias("node"), F.col("y").alias("other"), "x", "y").union(edges.select(F.col("y").alias("node"), F.col("x").alias("other"), "x", "y"))
        chosen = both.groupBy("node").agg(F.min(F.struct("x", "y", "other")).alias("m")).select("node", F.col("m.other").alias("other"))
        chosen, here = counted(stash, chosen, "chosen")
        back = chosen.select(F.col("node").alias("other"), F.col("other").alias("theirs"))
        hooked = stash.keep(joined(chosen, back, "other", here).select("node", F.when((F.col("theirs") == F.col("node")) & (F.col("node") < F.col("other")), F.col("node")).otherwise(F.col("other")).alias("parent")), "hooked")
        stash.drop(chosen)
        roots = pointer_doubling(hooked, here, stash)
        stash.drop(hooked)
        if label is None:
            after, nodes = roots.select("node", F.col("parent").alias("name")), here
            after._foliant_path = roots._foliant_path
        else:
            moved = joined(label, label.select("name").distinct().join(roots.select(F.col("node").alias("name"), "parent"), "name", "left"), "name", nodes)
            after = stash.keep(moved.select("node", F.coalesce("parent", "name").alias("name")), "labels")
            stash.drop(label)
        label = after
        x_root, y_root = (roots.select(F.col("node").alias(c), F.col("parent").alias("r" + c)) for c in "xy")
        relabelled = joined(joined(edges, x_root, "x", many), y_root, "y", many).where("rx <> ry")
        fewer, many = counted(stash, relabelled.select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
        stash.drop(edges)
        edges = fewer
    if label is None:
        return edges.select(F.col("x").alias("node"), F.col("y").alias("group_id"))
    smallest = label.groupBy("name").agg(F.min("node").alias("group_id"))
    return joined(label, smallest, "name", nodes).select("node", "group_id")


def similarity_links(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b) of rows whose similarity counts: values above 1 are per cents; null, NaN, negative or low ones don't count.

    Every row counts by itself, whatever other rows of the pair say.
    """
    value = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    return pairs.where(~F.isnan("similarity") & (value >= least) & F.col("doc_a").isNotNull() & F.col("doc_b").isNotNull() & (F.col("doc_a") != F.col("doc_b"))).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
