"""Sources mixed to target weights: quotas under repeat limits, then Pfair interleaving by earliest deadline first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.tokens import PIECES, load
from foliant.session import Stash, spread

#: Tokens of a block, whatever the size of the mixture, and slots of the schedule that one task lays out.
BLOCK, FRAME = 4096, 100_000
#: Ranges of hashes into which a source is split for its running sums, so that no source is summed in one task.
RANGES = 1024


def _sizes(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                yield pa.record_batch([part.column("doc_id"), part.column("source"), pa.array(tokenizer.count(part.column("text").to_pylist()), pa.int64())], names=["doc_id", "source", "tokens"])

    return run


def quotas(sizes: dict[str, int], weights: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, int]:
    """Tokens that each source gives. Without a total: as many as all can give in their shares within their repeats.

    Shares of listed sources that have nothing are spread over the others in proportion. With a total that is too large for
    some, those give what they may, and fall short of their share.
    """
    there = {s: w for s, (w, r) in weights.items() if sizes.get(s, 0) > 0 and w > 0 and r > 0}
    if not there:
        return {}
    scale = sum(there.values())
    share = {s: w / scale for s, w in there.items()}
    most = {s: sizes[s] * weights[s][1] for s in there}
    if total is None:
        total = int(min(most[s] / share[s] for s in there))
    return {s: min(most[s], round(total * share[s])) for s in sorted(there)}


def edges(blocks: dict[str, int], size: int) -> list[dict[str, int]]:
    """How many blocks of each source lie before each frame of so many slots, and at the end: never fewer than before, and
    never a block or more from its share."""
    total = sum(blocks.values())
    out = [dict.fromkeys(sorted(blocks), 0)]
    for slot in [*range(size, total, size), total][: -(-total // size)]:
        done = {s: max(out[-1][s], n * slot // total) for s, n in sorted(blocks.items())}
        short = sorted((s for s in done if done[s] * total < blocks[s] * slot), key=lambda s: (done[s] * total - blocks[s] * slot, s))
        for s in short[: slot - sum(done.values())]:
            done[s] += 1
        out.append(done)
    return out


def pfair(blocks: dict[str, int]) -> list[tuple[str, int]]:
    """The order of all blocks: block k of a source with weight w is released at (k - 1) / w and due at k / w, in slots; of
    those released, the one due first runs. At any time each source is less than one block from its share."""
    total = sum(blocks.values())
    done = dict.fromkeys(blocks, 0)
    waiting = [(0, s) for s, n in sorted(blocks.items()) if n]
    ready: list[tuple[int, int, str]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            release, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[s] + 1) * total // blocks[s]), release, s))
        _, _, s = heapq.heappop(ready)
        out.append((s, done[s]))
        done[s] += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * total // blocks[s], s))
    return out


def frame(now: dict[str, int], end: dict[str, int]) -> list[tuple[str, int]]:
    """The blocks of a frame: a Pfair schedule of what is due in it. As frames begin and end less than one block from every
    source's share, no source is ever two blocks from it."""
    return [(s, now[s] + k) for s, k in pfair({s: end[s] - now[s] for s in now})]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            order = frame(dict(zip(row["sources"], row["now"], strict=True)), dict(zip(row["sources"], row["end"], strict=True)))
            yield pa.record_batch([pa.array([s for s, _ in order], pa.string()), pa.array([k for _, k in order], pa.int64()), pa.array(range(row["first"], row["first"] + len(order)), pa.int64())], names=["source", "block", "slot"])


def mixture(documents: DataFrame, weights: DataFrame, total_tokens: int | None = None, tokenizer: str = PIECES, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, stash: Stash | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, shares). plan: slot, source, doc_id, copy_no, tokens — each use of a document and the block it belongs to.
    shares: source, target_share, actual_share, tokens, available_tokens, documents, uses, max_repeats — every listed source.

    weights (source, target_share, max_repeats) is a bounded table; of rows for one source the largest share counts. Documents without text,
    source or a listed source stay out, repeated rows count once. Whole passes over a source come first; the rest of its
    quota goes to documents in the order of a hash, so actual shares differ from targets by at most one document of each
    source. Blocks have ``block`` tokens, whatever the size of the mixture; the schedule is laid out in frames of FRAME slots, each by a
    task. A source is summed in ranges of hashes, then over ranges, so none is held by one task.
    """
    spark = documents.sparkSession
    stash = stash or Stash(spark)
    listed = {r.source: (float(r.w), int(r.n)) for r in weights.where("source is not null").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("w"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("n")).collect()}
    wanted = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).dropna().where(F.col("source").isin(sorted(listed)))
    sizes = spread(wanted).mapInArrow(_sizes(tokenizer), "doc_id long, source string, tokens long").where("tokens > 0")
    sizes = stash.keep(sizes.groupBy("doc_id", "source").agg(F.max("tokens").alias("tokens")), "sizes")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(RANGES)).cast("int")
    parts = sizes.groupBy("source", spot.alias("spot")).agg(F.sum("tokens").alias("sum"), F.count("*").alias("docs"))
    parts = stash.keep(parts, "ranges")
    have = {r.source: (r.t, r.d) for r in parts.groupBy("source").agg(F.sum("sum").alias("t"), F.sum("docs").alias("d")).collect()}
    quota = quotas({s: t for s, (t, _) in have.items()}, listed, total_tokens)
    blocks = {s: -(-q // block) for s, q in quota.items() if q}
    cuts = edges(blocks, FRAME)
    frames = spark.createDataFrame([(i * FRAME, list(a), list(a.values()), list(b.values())) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))], "first long, sources array<string>, now array<long>, end array<long>")
    slots = frames.mapInArrow(_frames, "source string, block long, slot long")
    goals = spark.createDataFrame([(s, q // have[s][0], q % have[s][0], have[s][0]) for s, q in quota.items()], "source string, passes int, rest long, size long")
    # running sums: of the ranges before, then within the range
    ahead = parts.withColumn("ahead", F.sum("sum").over(Window.partitionBy("source").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1))).select("source", "spot", F.coalesce("ahead", F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "spot").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("spot", spot).withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(ahead, ["source", "spot"]).withColumn("begin", F.col("ahead") + F.col("within"))
    uses = placed.join(F.broadcast(goals), "source").withColumn("uses", F.col("passes") + (F.col("begin") + F.col("tokens") / 2 <= F.col("rest")).cast("int")).where("uses > 0")
    each = uses.select("source", "doc_id", "tokens", "size", "begin", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("copy_no"))
    numbered = each.withColumn("block", F.floor((F.col("copy_no") * F.col("size") + F.col("begin")) / block))
    last = spark.createDataFrame([(s, n - 1) for s, n in blocks.items()], "source string, last long")
    plan = numbered.join(F.broadcast(last), "source").withColumn("block", F.least("block", "last")).join(slots, ["source", "block"]).select("slot", "source", "doc_id", "copy_no", "tokens")
    sums = uses.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("uses"), F.max("uses").alias("most"))
    register = spark.createDataFrame([(s, w, n, have.get(s, (0, 0))[0], have.get(s, (0, 0))[1]) for s, (w, n) in sorted(listed.items())], "source string, target_share double, max_repeats int, available_tokens long, documents long")
    joined = register.join(sums, "source", "left").fillna(0, ["tokens", "uses", "most"])
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    shares = joined.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), all_tokens), F.lit(0.0)).alias("actual_share"), "tokens", "available_tokens", "documents", "uses", F.col("most").alias("most_uses"), "max_repeats")
    return plan, shares
