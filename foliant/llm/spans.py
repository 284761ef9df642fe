"""Long exact spans shared between records: FM-indexes over the stretches that can be shared, one for each shard.

A stretch of ``length`` code points that occurs in two records has the same minimizer (the smallest hash of its grams)
in both. Records send their stretches to the shard of the minimizer, and only those whose minimizer occurs under
another owner too. So all places where a shared stretch occurs meet in one shard, and no record meets all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.text import U, code_points, gram_hash, pieces, row_of, spans_union, whole
from foliant.session import Stash, spread

#: Code points of a minimizer. Must be less than the length sought.
GRAM = 24
#: Code points in one FM-index, about.
SHARD_CHARS = 600_000
#: Different stretches under one minimizer beyond which they are cut again by the minimizers of longer grams; the last are
#: as long as the length sought, under which no two stretches differ.
HOT, LONGER = 4_000, (42,)


def minimizers(points: np.ndarray, bounds: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, start, end): for each run of windows with one minimizer, the stretch they cover."""
    none = np.zeros(0, np.int64)
    begins = whole(bounds, length)
    if not len(begins):
        return none, none.astype(U), none, none
    h = gram_hash(points, gram)
    low = (h >> U(32) << U(32)) | np.arange(len(h), dtype=U)  # ties go to the first
    span = length - gram + 1
    size, best = 1, low
    while size * 2 <= span:
        best = np.minimum(best[: len(best) - size], best[size:])
        size *= 2
    best = np.minimum(best[: len(low) - span + 1], best[span - size : span - size + len(low) - span + 1])
    at = (best[begins] & U(0xFFFFFFFF)).astype(np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 0) | (np.diff(begins) != 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    row = np.searchsorted(bounds, begins[first], "right") - 1
    return row, h[at[first]], begins[first] - bounds[row], begins[last] + length - bounds[row]


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            row, h, start, end = minimizers(*code_points(batch.column("text")), length)
            take = pa.array(row)
            yield pa.record_batch([pa.array(h.view(np.int64)), *(batch.column(c).take(take) for c in ("owner", "id", "body")), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["h", "owner", "id", "body", "start", "end"])

    return run


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each record's stretches out of its text."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], [], []]
        for key, owner, body, text, parts in zip(*(batch.column(c).to_pylist() for c in ("id", "owner", "body", "text", "parts")), strict=True):
            for p in parts:
                for column, value in zip(out, (p["h"], owner, key, body, p["start"], p["end"], text[p["start"] : p["end"]]), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), batch.schema.field("id").type, pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["h", "owner", "id", "body", "start", "end", "stretch"])


class Bits:
    """A bit vector with ranks: ones before a position, by one count for each 64 bits and a population count."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        rest = self.words[word] & ((U(1) << (at & 63).astype(U)) - U(1))
        return self.before[word] + np.bitwise_count(rest)


class Wavelet:
    """A wavelet matrix over small integers: rank(symbol, position) in one bit-vector rank for each level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.rows, self.zeros = levels, [], []
        now = values
        for level in range(levels - 1, -1, -1):
            bit = (now >> level) & 1
            self.rows.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        order = np.argsort(now, kind="stable")
        self.first = np.searchsorted(now[order], np.arange((1 << levels) + 1))
        start = np.zeros(1 << levels, np.int64)  # where each symbol's zone begins after all levels
        symbols = np.arange(1 << levels)
        for i, level in enumerate(range(levels - 1, -1, -1)):
            one = self.rows[i].rank(start)
            start = np.where((symbols >> level) & 1, self.zeros[i] + one, start - one)
        self.start = start

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = self.rows[i].rank(at)
            at = np.where((symbol >> level) & 1, self.zeros[i] + one, at - one)
        return at - self.start[symbol]


class FMIndex:
    """The Burrows-Wheeler transform of concatenated stretches in a wavelet matrix, for patterns of up to ``depth``.

    Suffixes are sorted by their first ``depth`` + 1 code points at least. ``lower`` and ``upper`` give, for each place in the
    suffix order, the bounds of the suffixes that share its first ``depth`` code points: the ancestor at that depth.
    """

    def __init__(self, stretches: list[np.ndarray], depth: int):
        sizes = np.array([len(s) + 1 for s in stretches])
        self.begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.owner = np.repeat(np.arange(len(stretches)), sizes)
        raw = np.zeros(int(sizes.sum()), np.uint32)
        for b, s in zip(self.begin, stretches, strict=True):
            raw[b : b + len(s)] = s
        alphabet, text = np.unique(raw, return_inverse=True)  # 0, the separator, is the smallest
        self.text = text.astype(np.int64)
        n = len(text)
        bits = max(1, int(len(alphabet)).bit_length())
        step = max(1, min(62 // bits, depth))
        key = np.zeros(n, np.int64)
        for i in range(step):
            key = key << bits
            if i < n:
                key[: n - i] |= self.text[i:]
        reach, ranks = step, {}
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        ranks[reach] = rank
        while reach < depth + 1 and rank.max() < n - 1:
            nxt = np.zeros(n, np.int64)
            nxt[: n - reach] = rank[reach:] + 1 if reach < n else 0
            rank = np.unique(rank * (n + 1) + nxt, return_inverse=True)[1].astype(np.int64)
            reach *= 2
            ranks[reach] = rank
        self.order = np.argsort(rank, kind="stable")
        bwt = self.text[self.order - 1]
        self.wavelet = Wavelet(bwt, bits)
        self.count = np.searchsorted(np.sort(bwt), np.arange((1 << bits) + 1))
        part = max(r for r in ranks if r <= depth)
        r = ranks[part]
        left, right = r[self.order], r[np.minimum(self.order + depth - part, n - 1)]
        edge = np.ones(n + 1, bool)
        edge[1:n] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        if 2 * part < depth:  # the two ranks leave a gap between them
            for shift in range(part, depth - part, part):
                mid = r[np.minimum(self.order + shift, n - 1)]
                edge[1:n] |= mid[1:] != mid[:-1]
        marks = np.flatnonzero(edge)
        group = np.cumsum(edge[:n]) - 1
        self.lower, self.upper = marks[group], marks[group + 1]

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes that begin with symbol and go on as those from lo to hi."""
        base = self.count[symbol]
        return base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)


def shared_windows(index: FMIndex, owners: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(stretch, start) of each window of ``depth`` that also occurs in a stretch of another owner.

    All stretches are streamed from their ends at once. The match never grows beyond ``depth``: when it would, it is cut
    back to the ancestor interval, so each code point costs one backward step.
    """
    place = owners[index.owner[index.order]]  # the owner of each suffix, in suffix order
    change = np.flatnonzero(np.diff(place)) + 1
    following = np.concatenate([change, [len(place)]])
    other = following[np.searchsorted(change, np.arange(len(place)), "right")]  # where the next owner begins
    sizes = np.diff(np.concatenate([index.begin, [len(index.owner)]])) - 1
    by = np.argsort(-sizes, kind="stable")
    sizes, begin, mine = sizes[by], index.begin[by], owners[by]
    lo, hi = np.zeros(len(by), np.int64), np.full(len(by), len(index.owner), np.int64)
    found = []
    for t in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -t, "left"))
        at = begin[:live] + sizes[:live] - 1 - t
        lo[:live], hi[:live] = index.extend(index.text[at], lo[:live], hi[:live])
        if t >= depth - 1:
            if t >= depth:
                lo[:live], hi[:live] = index.lower[lo[:live]], index.upper[hi[:live] - 1]
            a = lo[:live]
            hit = np.flatnonzero((place[a] != mine[:live]) | (other[a] < hi[:live]))
            found.append((by[hit], at[hit] - begin[hit]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _index_shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        points, bounds = code_points(table.column("stretch"))
        rows = [points[bounds[i] : bounds[i + 1]] for i in range(table.num_rows)]
        # a stretch of several owners is shared as a whole; as an owner of its own it makes all it meets shared
        low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
        _, owner = np.unique(np.where(low == high, low, 0), return_inverse=True)
        many = low != high
        owner = np.where(many, owner.max() + 1 + np.arange(len(owner)), owner)
        which, at = shared_windows(FMIndex(rows, length), owner, length)
        w, s, e = spans_union(np.concatenate([which, np.flatnonzero(many)]), np.concatenate([at, np.zeros(many.sum(), np.int64)]), np.concatenate([at + length, np.diff(bounds)[many]]))
        take = pa.array(w)
        return pa.table({"h": table.column("h").take(take), "digest": table.column("digest").take(take), "from": pa.array(s.astype(np.int32)), "to": pa.array(e.astype(np.int32))})

    return run


def _longer(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches cut by the minimizers of longer grams, each under a key of both."""
        for batch in pieces(batches, "stretch"):
            points, bounds = code_points(batch.column("stretch"))
            row, h, start, end = minimizers(points, bounds, length, gram)
            if not len(row):
                continue
            take = pa.array(row)
            before = batch.column("h").to_numpy().view(U)[row]
            with np.errstate(over="ignore"):
                key = (before * U(0x9E3779B97F4A7C15)) ^ h
            at = batch.column("start").to_numpy()[row]
            text = points.tobytes().decode("utf-32-le")
            a, b = (bounds[row] + start).tolist(), (bounds[row] + end).tolist()
            yield pa.record_batch([pa.array(key.view(np.int64)), *(batch.column(c).take(take) for c in ("owner", "id", "body")), pa.array((at + start).astype(np.int32)), pa.array((at + end).astype(np.int32)), pa.array([text[x:y] for x, y in zip(a, b, strict=True)], pa.string())], names=["h", "owner", "id", "body", "start", "end", "stretch"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    keys, owner = np.unique(table.column("id").to_numpy(zero_copy_only=False), return_inverse=True)
    texts, owner = np.unique(np.stack([owner, table.column("body").to_numpy()]), axis=1, return_inverse=True)
    o, s, e = spans_union(owner, table.column("start").to_numpy().astype(np.int64), table.column("end").to_numpy().astype(np.int64))
    return pa.table({"id": pa.array(keys[texts[0][o]], table.schema.field("id").type), "span_start": pa.array(s), "span_end": pa.array(e)})


def shared_spans(records: DataFrame, length: int = 60, record_id: str = "match_id", owner: str = "doc_a", text: str = "text", stash: Stash | None = None) -> DataFrame:
    """(record id, span_start, span_end): the maximal runs of positions that lie in ``length`` consecutive code points which also
    occur, unchanged, in a record of another owner. Spans are half-open offsets in code points.

    Whole rows that repeat count once. Null or shorter texts have no span; a null id is left out; a null owner is an owner of its own for each record.
    Several texts under one id are told apart. Texts that occur under many owners are brought together by partial
    aggregation and enter an index once. A minimizer with more than HOT different stretches (a common phrase in differing
    surroundings) is too much for one index: they are cut again by longer minimizers, and go to the indexes of those.
    """
    spark = records.sparkSession
    stash = stash or Stash(spark)
    own = F.xxhash64(F.coalesce(F.col(owner).cast("string"), F.concat(F.lit("\0"), F.col(record_id).cast("string"))))
    source = records.select(F.col(record_id).alias("id"), own.alias("owner"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.length(text)).alias("body")).where(F.col("id").isNotNull() & (F.length("text") >= length))
    kind = source.schema["id"].dataType.simpleString()
    anchors = spread(source).mapInArrow(_anchors(length), f"h long, owner long, id {kind}, body long, start int, end int")
    anchors = stash.keep(anchors, "anchors")
    shared = anchors.groupBy("h").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high").select("h")
    parts = anchors.join(shared, "h").groupBy("id", "owner", "body").agg(F.collect_set(F.struct("h", "start", "end")).alias("parts"))
    cut = source.dropDuplicates(["id", "owner", "body"]).join(parts, ["id", "owner", "body"]).select("id", "owner", "body", "text", "parts")
    rows = f"h long, owner long, id {kind}, body long, start int, end int, stretch string"
    places = stash.keep(cut.mapInArrow(_stretches, rows).withColumn("digest", F.md5("stretch")), "places")
    cool_places, cool = None, None
    for gram in (*(g for g in LONGER if GRAM < g < length), length, None):
        distinct = places.groupBy("h", "digest").agg(F.min("owner").alias("low"), F.max("owner").alias("high"), F.first("stretch").alias("stretch"))
        distinct = stash.keep(distinct, "distinct")
        hot = distinct.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h")
        hot = stash.keep(hot, "hot") if gram else None
        done = hot is None or not hot.take(1)
        mine, own = (places, distinct) if done else (places.join(hot, "h", "left_anti"), distinct.join(hot, "h", "left_anti"))
        cool_places, cool = (mine, own) if cool is None else (cool_places.unionByName(mine), cool.unionByName(own))
        if done:
            break
        again = stash.keep(places.join(hot, "h", "left_semi").drop("digest").mapInArrow(_longer(length, gram), rows).withColumn("digest", F.md5("stretch")), "longer")
        shared = again.groupBy("h").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).where("low <> high").select("h")
        places = stash.keep(again.join(shared, "h", "left_semi"), "places")
        stash.drop(again)
    places = cool_places
    total = cool.agg(F.sum(F.length("stretch") + 1)).first()[0] or 0
    shards = max(1, -(-total // SHARD_CHARS))
    spans = cool.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_index_shard(length), "h long, digest string, from int, to int")
    found = places.join(spans, ["h", "digest"]).select("id", "body", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"))
    buckets = F.pmod(F.xxhash64("id"), F.lit(max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards))).cast("int")
    return found.distinct().groupBy(buckets.alias("bucket")).applyInArrow(_merge, f"id {kind}, span_start long, span_end long").withColumnRenamed("id", record_id)


def shared_share(records: DataFrame, spans: DataFrame, record_id: str = "match_id", text: str = "text") -> DataFrame:
    """(record id, n_chars, shared_chars, shared_share) of every record with an id: how much of it is found elsewhere.

    Records without a span have 0; null and empty texts have 0 characters and a null share.
    """
    sums = spans.groupBy(record_id).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sizes = records.where(F.col(record_id).isNotNull()).groupBy(record_id).agg(F.max(F.coalesce(F.length(text), F.lit(0))).cast("long").alias("n_chars"))
    joined = sizes.join(sums, record_id, "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.select(record_id, "n_chars", "shared_chars", F.try_divide(F.col("shared_chars").cast("double"), F.col("n_chars")).alias("shared_share"))
