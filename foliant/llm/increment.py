"""New batches against all history: immutable per-batch sorted arrays of keys, stored, searched by the keys of later batches.

A text's keys are made of all its suffixes, by their first 5 folded code points: each key names the MINIMA suffixes that come
first in as many random orders of all suffixes. Two texts have a key in common with a chance that follows from their overlap
alone, wherever in them the common suffixes lie; no position is passed over.

A ``History`` is a folder of such arrays, one segment for each batch, in tables bucketed by shard: a new batch is read
once, its arrays are written, and joined bucket by bucket with the stored ones, which are neither shuffled nor built
again; no accepted text is read. Segments of like size are merged, so there are logarithmically many. The keys a pair of
texts has in common are summed over shards (its coverage). Pairs covered well enough are then compared exactly, for which
the texts of these pairs, and no others, are fetched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliant.llm.text import U, code_points, fold, gram_hash, pieces, row_of, whole
from foliant.session import Stash, shared_dir, ship, spread

#: Keys of a text, and the orders of suffixes that make one: a pair of overlap x has each key in common with the chance x ** MINIMA.
KEYS, MINIMA = 72, 3
#: Least share of its keys that a candidate pair has in common: 4 keys. At an overlap of 65 %, 19.8 are to be expected, and fewer
#: than 4 come with a chance of 3e-7 (binomial, see README).
COVERAGE = 4 / 72
#: Earlier texts taken from one run of equal suffixes at first, and how much more in each further round.
RUN, RUN_GROWTH = 32, 16
#: Keys in a shard, about, and at most in one stored array (26 bytes each); shards at most (Spark's limit on buckets). Each batch
#: writes a file for each shard, and executors were seen to fork (for a local file's mode, most likely), which counts their memory
#: twice for a moment: so shards aren't made small.
SHARD, SHARDS = 400_000, 100_000
#: Keys that a reading task holds before it hands them on.
FLUSH = 200_000
#: New batches that are searched at once, before their segments are merged.
LOADS = 16
#: Ids broadcast at most (8 bytes each); beyond, texts are joined by shuffle, and askers go in several blocks.
BROADCAST_IDS = 1_000_000
#: Bytes of asking keys broadcast at most; beyond, they are shuffled to the shards' buckets.
BROADCAST_BYTES = 16_000_000

#: Flags beside a text's number of different 5-grams, as far as it is told: in a batch after history.
ASKS, WEIGHT = 1 << 13, (1 << 13) - 1
KEY = "S8"

_FACTORS, _SHIFTS = (np.random.default_rng(20).integers(0, 1 << 64, (2, KEYS, MINIMA), U) | np.array([1, 0], U)[:, None, None])


def suffix_keys(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, keys of each row with a sequence of 5); and of every row how many different 5-grams it has."""
    begins = whole(bounds, 5)
    grams, rows = gram_hash(points, 5)[begins] if len(begins) else np.zeros(0, U), row_of(bounds)[begins]
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    each = np.sort((rows.astype(U) << U(44)) | (grams >> U(20)))
    count = np.bincount((each[np.diff(each, prepend=~each[:1]) != 0] >> U(44)).astype(np.int64), minlength=len(bounds) - 1)
    keys = np.zeros((len(heads), KEYS), ">u8")
    if len(heads):
        turned = np.empty_like(grams)
        with np.errstate(over="ignore"):
            for i in range(KEYS):
                key = np.full(len(heads), i, U)
                for j in range(MINIMA):
                    np.bitwise_xor(grams, _SHIFTS[i, j], out=turned)
                    np.multiply(turned, _FACTORS[i, j], out=turned)
                    key = key * U(0x9E3779B97F4A7C15) ^ np.minimum.reduceat(turned, heads)
                    key ^= key >> U(31)
                keys[:, i] = key
    return rows[heads], keys, count


_SEGMENT = "shard int, kind int, doc_id long, batch int, d1 long, d2 long, low binary, high binary, k binary, docs binary, d1s binary, flags binary"
_ARROW = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("batch", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), *((c, pa.binary()) for c in ("low", "high", "k", "docs", "d1s", "flags"))])
#: Kinds of rows in a segment: its texts, and its suffix arrays.
TEXT, ARRAY = 0, 1


def _rows(kind: int, size: int, **columns) -> pa.RecordBatch:
    """Rows of a segment; columns not given are null."""
    given = {"kind": np.full(size, kind, np.int32), **columns}
    return pa.record_batch([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW)


def shards_for(texts: int, least: int) -> int:
    """In how many shards the keys of so many texts are kept."""
    return max(least, -(-texts * KEYS // SHARD))


def _shard_of(k: np.ndarray, shards: int) -> np.ndarray:
    words = np.frombuffer(k.tobytes(), np.uint64)
    with np.errstate(over="ignore"):
        mixed = words * U(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> U(32))) * U(0xBF58476D1CE4E5B9)
    return ((mixed >> U(33)) % U(shards)).astype(np.int32)


def _by_shard(parts: list[tuple[np.ndarray, ...]], shards: int) -> pa.RecordBatch:
    """Keys as one row of arrays for each shard, so that a shuffle moves a few long rows."""
    k, doc, d1, flag = (np.concatenate(x) for x in zip(*parts, strict=True))
    shard = _shard_of(k, shards)
    order = np.argsort(shard, kind="stable")
    k, doc, d1, flag, shard = k[order], doc[order], d1[order], flag[order], shard[order]
    edges = np.append(np.flatnonzero(np.diff(shard, prepend=shard[:1] - 1)), len(shard))
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return _rows(ARRAY, len(edges) - 1, shard=shard[edges[:-1]], k=cut(k), docs=cut(doc), d1s=cut(d1), flags=cut(flag))


def _digests(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(points[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)), np.int64).reshape(-1, 2)


def _read(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text with a sequence of 5; keys of each different text of this partition: copies collapse here."""
        known: dict[int, tuple[int, int]] = {}
        parts, held = [], 0
        for batch in pieces(batches, "text", 200_000):
            points, bounds = fold(*code_points(batch.column("text")))
            rows, keys, grams = suffix_keys(points, bounds)
            doc, number = (batch.column(c).to_numpy() for c in ("doc_id", "batch"))
            asks = number >= 1
            flag = (np.minimum(grams, WEIGHT) | np.where(asks, ASKS, 0)).astype(np.uint16)
            digest = _digests(points, bounds)
            has = np.diff(bounds) >= 5
            fresh = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(has).tolist():
                d, a = int(doc[i]), int(asks[i])
                low, asked = known.get(key := int(digest[i, 0]), (d + 1, 0))
                if d < low or a > asked:
                    known[key] = min(d, low), max(a, asked)
                    fresh[i] = True
            at = np.flatnonzero(has)
            yield _rows(TEXT, len(at), shard=(digest[at, 0] % shards).astype(np.int32), doc_id=doc[at], batch=number[at], d1=digest[at, 0], d2=digest[at, 1])
            take = fresh[rows]
            rows = np.repeat(rows[take], KEYS)
            parts.append((keys[take].view(KEY).ravel(), doc[rows].astype(np.int64), digest[rows, 0], flag[rows]))
            held += len(rows)
            if held >= FLUSH:
                yield _by_shard(parts, shards)
                parts, held = [], 0
        if held:
            yield _by_shard(parts, shards)

    return run


def _settled(k: np.ndarray, doc: np.ndarray, d1: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted by key, then document; each text once at a key, by its smallest document."""
    order = np.lexsort((doc, d1, k.view(">u8").astype(U)))
    k, doc, d1, flag = k[order], doc[order], d1[order], flag[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d1[1:] != d1[:-1])
    heads = np.flatnonzero(new)
    flag = np.bitwise_or.reduceat(flag, heads) if len(heads) else flag
    segment = Segment(k[heads], doc[heads], heads)
    at = np.searchsorted(heads, segment.ref)
    return segment.k, segment.doc, d1[segment.ref], flag[at]


def _blobs(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The arrays of all rows of a table, end to end."""
    out = []
    for name, kind in (("k", KEY), ("docs", np.int64), ("d1s", np.int64), ("flags", np.uint16)):
        out.append(np.frombuffer(b"".join(table.column(name).to_pylist()), kind))
    return tuple(out)


def _arrays(shard: int, k: np.ndarray, doc: np.ndarray, d1: np.ndarray, flag: np.ndarray, kind: int = ARRAY) -> pa.RecordBatch:
    """Sorted keys in rows of at most SHARD."""
    starts = np.arange(0, len(k), SHARD)
    cut = lambda x: [x[a : a + SHARD].tobytes() for a in starts]
    full = k.view("V8")
    return _rows(kind, len(starts), shard=np.full(len(starts), shard, np.int32), low=[full[a].tobytes() for a in starts], high=[full[min(a + SHARD, len(k)) - 1].tobytes() for a in starts], k=cut(k), docs=cut(doc), d1s=cut(d1), flags=cut(flag))


def _built(table: pa.Table) -> pa.Table:
    """The segment of a shard: its texts as they are, and one sorted array."""
    table = table.select(_ARROW.names).cast(_ARROW)
    kind = table.column("kind").to_numpy()
    texts, arrays = table.filter(pa.array(kind == TEXT)), table.filter(pa.array(kind == ARRAY))
    shard = table.column("shard")[0].as_py()
    return pa.concat_tables([texts, pa.Table.from_batches([_arrays(shard, *_settled(*_blobs(arrays)))])])


class Segment:
    """A sorted array of keys, never changed; within equal keys the smallest document comes first."""

    def __init__(self, k: np.ndarray, doc: np.ndarray, ref: np.ndarray):
        order = np.lexsort((doc, k.astype(KEY).view(">u8").astype(U)))
        self.k, self.doc, self.ref = k[order], doc[order], ref[order]

    def __len__(self) -> int:
        return len(self.k)

    def merge(self, other: Segment) -> Segment:
        return Segment(*(np.concatenate(x) for x in ((self.k, other.k), (self.doc, other.doc), (self.ref, other.ref))))

    def search(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.k, k, "left"), np.searchsorted(self.k, k, "right")


def add_segment(segments: list, fresh) -> list:
    """The log-structured merge: while the last segment is under twice the new one's size, the two become one."""
    while segments and len(segments[-1]) < 2 * len(fresh):
        fresh = segments[-1].merge(fresh)
        segments = segments[:-1]
    return [*segments, fresh]


_SEEN = "qa long, ea long, qdoc long, edoc long, hits int, weight int, upto long, shard int, k binary"
_SEEN_ARROW = pa.schema([("qa", pa.int64()), ("ea", pa.int64()), ("qdoc", pa.int64()), ("edoc", pa.int64()), ("hits", pa.int32()), ("weight", pa.int32()), ("upto", pa.int64()), ("shard", pa.int32()), ("k", pa.binary())])


def _meet(shard: int, q: tuple[np.ndarray, ...], e: tuple[np.ndarray, ...], first: int, last: int, least: float) -> Iterator[pa.RecordBatch]:
    """The keys of q that ask, binary-searched in the sorted array e: of each run of equal ones the documents at the
    places from ``first`` to ``last`` that are smaller than the asker and not so much shorter or longer that the overlap
    can't reach ``least``. Rows with ea null tell that smaller ones may follow."""
    qk, qdoc, qd1, qflag = q
    ek, edoc, ed1, eflag = e
    who = np.flatnonzero(qflag & ASKS)
    lo, hi = np.searchsorted(ek, qk[who], "left"), np.searchsorted(ek, qk[who], "right")
    cut = np.flatnonzero(hi - lo > last)
    upto = edoc[lo[cut] + last - 1]
    blind = upto < qdoc[who[cut]]
    cut, upto = cut[blind], upto[blind]
    lo, hi = np.minimum(lo + first, hi), np.minimum(lo + last, hi)
    size = hi - lo
    asker = np.repeat(who, size)
    hit = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    na, nb = (qflag[asker] & WEIGHT).astype(np.int64), (eflag[hit] & WEIGHT).astype(np.int64)
    ok = (edoc[hit] < qdoc[asker]) & (ed1[hit] != qd1[asker]) & (np.minimum(na, nb) + 1 >= least * np.maximum(na, nb))
    asker, hit = asker[ok], hit[ok]
    order = np.lexsort((ed1[hit], qd1[asker]))
    asker, hit = asker[order], hit[order]
    new = np.ones(len(asker), bool)
    new[1:] = (qd1[asker][1:] != qd1[asker][:-1]) | (ed1[hit][1:] != ed1[hit][:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(asker))).astype(np.int32)
    asker, hit = asker[heads], hit[heads]
    n = len(asker)
    if n:
        yield pa.record_batch([pa.array(qd1[asker]), pa.array(ed1[hit]), pa.array(qdoc[asker]), pa.array(edoc[hit]), pa.array(count), pa.array((qflag[asker] & WEIGHT).astype(np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=_SEEN_ARROW)
    n, cut = len(cut), who[cut]
    if n:
        full = qk.view("V8")
        yield pa.record_batch([pa.array(qd1[cut]), pa.nulls(n, pa.int64()), pa.array(qdoc[cut]), pa.nulls(n, pa.int64()), pa.array(np.ones(n, np.int32)), pa.array((qflag[cut] & WEIGHT).astype(np.int32)), pa.array(upto), pa.array(np.full(n, shard, np.int32)), pa.array([full[i].tobytes() for i in cut], pa.binary())], schema=_SEEN_ARROW)


def _sides(table: pa.Table, row: int) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(table.column(c)[row].as_buffer(), kind) for c, kind in (("k", KEY), ("docs", np.int64), ("d1s", np.int64), ("flags", np.uint16)))


def _search(first: int, last: int, least: float):
    def one(table: pa.Table) -> pa.Table:
        """All arrays of a shard: those of new segments are searched in all, or those that ``asked`` in each."""
        shard, out = table.column("shard")[0].as_py(), []
        low, high = (table.column(c).to_pylist() for c in ("low", "high"))
        if "asked" in table.column_names:
            asked = pa.Table.from_pylist(table.column("asked")[0].as_py())
            for i in range(asked.num_rows):
                a, b = asked.column("low")[i].as_py(), asked.column("high")[i].as_py()
                for j in range(table.num_rows):
                    if a <= high[j] and b >= low[j]:
                        out += _meet(shard, _sides(asked, i), _sides(table, j), first, last, least)
            return pa.Table.from_batches(out, _SEEN_ARROW)
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(asks).tolist():
            q = _sides(table, i)
            for j in range(table.num_rows):
                if low[i] <= high[j] and high[i] >= low[j]:
                    e = _sides(table, j)
                    out += _meet(shard, q, e, first, last, least)
                    if not asks[j] and q[1].min() < e[1].max():  # accepted texts that ask may repeat a smaller new one
                        out += _meet(shard, e, q, first, last, least)
        return pa.Table.from_batches(out, _SEEN_ARROW)

    return one


class History:
    """A folder of accepted batches: segments, merged logarithmically, as the partitions of one table bucketed by shard.

    ``add`` accepts a batch, ``search`` tells what the texts of new batches may repeat, ``compact`` merges segments, and
    ``texts`` lists all accepted texts. A folder written before is opened again by its path. ``shards`` is fixed when the
    folder is begun: keys expected, over SHARD. ``least``: the overlap that is asked for; what can't reach it by its size isn't met.
    """

    def __init__(self, spark: SparkSession, root: str, shards: int, least: float = 0.0):
        ship(spark)
        self.least, self.spark, self.root, self.name = least, spark, root.rstrip("/"), f"foliant_{uuid.uuid4().hex}"
        here = self._path()
        self.files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.files.mkdirs(here)
        found = [p.getPath().getName() for p in self.files.listStatus(here)]
        done = [tuple(map(int, f.removeprefix("segment=").split("-"))) for f in found if f.startswith("segment=")]
        self.shards = done[0][3] if done else max(1, min(SHARDS, shards))
        # a merge that was broken off leaves both its parts and, where it was written whole, their union
        inner = {x for x in done for y in done if x != y and y[0] <= x[0] and x[1] <= y[1]}
        self.segments = [Stored(*x[:3], self.shards) for x in sorted(set(done) - inner)]
        self.number = max((x[1] for x in done), default=0)
        self.tables = 0

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _rows(self, segments: list[Stored]) -> DataFrame:
        """The rows of some segments in one scan, each bucket of all of them in one partition: a grouping by shard moves nothing."""
        spark = self.spark
        spark.sql(f"DROP TABLE IF EXISTS {self.name}_{self.tables}")
        self.tables += 1
        table = f"{self.name}_{self.tables}"
        spark.sql(f"CREATE TABLE {table} ({_SEGMENT}, segment string) USING parquet PARTITIONED BY (segment) CLUSTERED BY (shard) INTO {self.shards} BUCKETS LOCATION '{self.root}'")
        spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        return spark.table(table).where(F.col("segment").isin([s.name for s in segments]))

    def add(self, texts: DataFrame) -> list[Stored]:
        """doc_id, batch, text of a new batch, read once → its segment; none if no text has a sequence of 5."""
        self.number += 1
        read = spread(texts).mapInArrow(_read(self.shards), _SEGMENT).repartition(self.shards, "shard")
        fresh = self._write(read, self.number, self.number)
        if len(fresh):
            self.segments.append(fresh)
        return [fresh][: len(fresh)]

    def _write(self, rows: DataFrame, first: int, last: int) -> Stored:
        """Rows by shard, sorted and written under a name that isn't read, then given the name that tells their size."""
        draft, table, spark, seen = f"_draft-{first}-{last}", f"{self.name}_draft", self.spark, Observation()
        built = rows.groupBy("shard").applyInArrow(_built, _SEGMENT).observe(seen, F.coalesce(F.sum(F.length("docs")), F.lit(0)).alias("bytes"))
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        built.write.mode("overwrite").bucketBy(self.shards, "shard").option("path", f"{self.root}/{draft}").option("compression", "zstd").saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")
        done = Stored(first, last, seen.get["bytes"] // 8, self.shards)
        if len(done):
            self.files.rename(self._path(draft), self._path(f"segment={done.name}"))
        return done

    def search(self, fresh: list[Stored], stash: Stash) -> DataFrame:
        """What the keys of new segments met in all others and in themselves. Bucket by bucket: nothing is shuffled."""
        rows = self._rows(self.segments).where(F.col("kind") == ARRAY)
        return self._met(rows.select(*_ARRAYS, F.col("segment").isin([s.name for s in fresh]).alias("asks")), 0, RUN, stash)

    def ask_again(self, cuts: DataFrame, first: int, last: int, stash: Stash) -> DataFrame:
        """(qa, qdoc, weight, shard, k) of keys whose runs were cut, qdoc being what is looked below: the places from first to last."""
        packed = cuts.repartition(self.shards, "shard").groupBy("shard").applyInArrow(_asked, _SEGMENT)
        asked = stash.keep(packed.groupBy("shard").agg(F.collect_list(F.struct(*_ARRAYS[1:])).alias("asked")), "asked")
        rows = self._rows(self.segments).where(F.col("kind") == ARRAY).select(*_ARRAYS)
        mine = F.broadcast(asked) if asked.agg(F.sum(F.aggregate("asked", F.lit(0), lambda n, x: n + F.length(x["k"]) * 2))).first()[0] < BROADCAST_BYTES else asked
        joined = rows.join(mine, "shard")
        return self._met(joined.select(*_ARRAYS, "asked"), first, last, stash)

    def _met(self, rows: DataFrame, first: int, last: int, stash: Stash) -> DataFrame:
        return stash.keep(rows.groupBy("shard").applyInArrow(_search(first, last, self.least), _SEEN), "met")

    def compact(self) -> None:
        """While the last segment but one is under twice the size of the last, the two become one."""
        done: list[Stored] = []
        for segment in self.segments:
            done = add_segment(done, segment)
        self.segments = [self._write(self._rows(list(s.parts)).drop("segment"), s.first, s.last) if s.parts else s for s in done]
        for old in [p for s in done for p in s.parts]:
            self.files.delete(self._path(f"segment={old.name}"), True)

    def texts(self) -> DataFrame:
        """(doc_id, batch, d1, d2) of all accepted texts."""
        return self._rows(self.segments).where(F.col("kind") == TEXT).select("doc_id", "batch", "d1", "d2")

    def close(self, remove: bool = False) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{self.tables}")
        if remove:
            self.files.delete(self._path(), True)


class Stored:
    """A segment in the history's folder: batches first to last, how many keys they have, in how many shards. Merging
    only notes the parts."""

    def __init__(self, first: int, last: int, size: int, shards: int, parts: tuple[Stored, ...] = ()):
        self.first, self.last, self.size, self.shards, self.parts = first, last, size, shards, parts

    def __len__(self) -> int:
        return self.size

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}-{self.size}-{self.shards}"

    def merge(self, other: Stored) -> Stored:
        return Stored(self.first, other.last, self.size + other.size, self.shards, (*(self.parts or (self,)), *(other.parts or (other,))))


_ARRAYS = ("shard", "low", "high", "k", "docs", "d1s", "flags")


def _asked(table: pa.Table) -> pa.Table:
    k = np.frombuffer(b"".join(table.column("k").to_pylist()), KEY)
    flag = table.column("weight").to_numpy() | ASKS
    return pa.Table.from_batches([_arrays(table.column("shard")[0].as_py(), *_settled(k, table.column("qdoc").to_numpy(), table.column("qa").to_numpy(), flag.astype(np.uint16)))])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        points, bounds = fold(*code_points(batch.column("text")))
        whole_text = points.tobytes().decode("utf-32-le")
        yield pa.record_batch([pa.array(_digests(points, bounds)[:, 0]), pa.array([whole_text[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())], names=["d1", "text"])


def _overlap(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "ta", 250_000), "tb", 250_000):
            sets = []
            for name in ("ta", "tb"):
                points, bounds = code_points(batch.column(name))
                begins = whole(bounds, 5)
                row, gram = row_of(bounds)[begins], gram_hash(points, 5)[begins]
                order = np.lexsort((gram, row))
                row, gram = row[order], gram[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
                sets.append((row[new], gram[new]))
            rows = batch.num_rows
            na, nb = (np.bincount(s[0], minlength=rows) for s in sets)
            row, gram = (np.concatenate(x) for x in zip(*sets, strict=True))
            order = np.lexsort((gram, row))
            row, gram = row[order], gram[order]
            same = np.bincount(row[1:][(row[1:] == row[:-1]) & (gram[1:] == gram[:-1])], minlength=rows)
            union = na + nb - same
            ok = (union > 0) & (same >= least * union - 1e-9)
            take = pa.array(np.flatnonzero(ok))
            yield pa.record_batch([batch.column("qa").take(take), batch.column("ea").take(take), pa.array((same / np.maximum(union, 1))[ok])], names=["qa", "ea", "overlap"])

    return run


def _same_text(corpus: DataFrame, pairs: DataFrame, stash: Stash) -> DataFrame:
    """(d1, folded text) of the documents in the pairs: of all others, no text leaves the scan."""
    ids = stash.keep(pairs.select(F.col("qdoc").alias("doc_id")).union(pairs.select("edoc")).distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = stash.keep(corpus.join(few, "doc_id", "left_semi").select("text").mapInArrow(_folded, "d1 long, text string").dropDuplicates(["d1"]), "texts")
    stash.drop(ids)
    return texts


def _verified(corpus: DataFrame, pairs: DataFrame, least: float, stash: Stash) -> DataFrame:
    texts = _same_text(corpus, pairs, stash)
    both = pairs.join(texts.select(F.col("d1").alias("qa"), F.col("text").alias("ta")), "qa").join(texts.select(F.col("d1").alias("ea"), F.col("text").alias("tb")), "ea").select("qa", "ea", "ta", "tb")
    good = stash.keep(both.mapInArrow(_overlap(least), "qa long, ea long, overlap double"), "good")
    stash.drop(texts)
    return good


def _need() -> int:
    return max(1, round(KEYS * COVERAGE))


def _summed(seen: DataFrame) -> DataFrame:
    """Pairs with all their hits."""
    return seen.groupBy("qa", "ea").agg(F.sum("hits").cast("int").alias("hits"), F.min("qdoc").alias("qdoc"), F.min("edoc").alias("edoc"))


def _hidden(cuts: DataFrame) -> DataFrame:
    """(qa, cut): how many cut runs may hide something from an asker."""
    return cuts.groupBy("qa").agg(F.count("*").alias("cut"))


def confirmed(history: History, corpus: DataFrame, met: list[DataFrame], least: float, stash: Stash) -> DataFrame:
    """(qa, ea, overlap) of all pairs of texts that reach ``least``, from what batches met when they were accepted.

    A pair is compared if its hits, with those that cut runs may hide, reach what is needed. Where cut runs alone could reach it, the
    asker reads on in them, below the smallest document that it repeats so far, until none is left.
    """
    seen = met[0]
    for part in met[1:]:
        seen = seen.unionByName(part)
    pairs = _summed(seen.where("ea is not null"))
    cuts = seen.where("ea is null").drop("ea", "edoc", "hits")
    hidden, need = stash.keep(_hidden(cuts), "hidden"), _need()
    reached = (F.col("hits") >= need) | (F.col("cut") < need) & (F.col("hits") + F.col("cut") >= need)
    chosen = stash.keep(pairs.join(hidden, "qa", "left").where(reached).select("qa", "ea", "qdoc", "edoc"), "pairs")
    good = _verified(corpus, chosen, least, stash)
    asking = hidden.where(F.col("cut") >= need).select("qa")
    if not asking.take(1):
        return good
    lowest = stash.keep(history.texts().groupBy("d1").agg(F.min("doc_id").alias("low")), "lowest")
    cuts = stash.keep(cuts.join(asking, "qa", "left_semi"), "cuts")
    known = stash.keep(pairs.join(asking, "qa", "left_semi"), "known")
    run = RUN
    while True:
        best = good.join(lowest.withColumnRenamed("d1", "ea"), "ea").groupBy("qa").agg(F.min("low").alias("best"))
        left = cuts.join(best, "qa", "left").withColumn("below", F.coalesce("best", "qdoc")).where("upto < below")
        left = stash.keep(left.select("qa", F.col("below").alias("qdoc"), "weight", "upto", "shard", "k"), "left")
        hidden = stash.keep(_hidden(left), "hidden")
        asking = hidden.where(F.col("cut") >= need).select("qa")
        more: DataFrame | None = None
        if asking.take(1):
            again = left.join(asking, "qa", "left_semi").groupBy("qa", "shard", "k").agg(F.min("qdoc").alias("qdoc"), F.min("weight").alias("weight"))
            more = history.ask_again(again, run, run * RUN_GROWTH, stash)
            run *= RUN_GROWTH
            columns = ("qa", "ea", "qdoc", "edoc", "hits")
            known = stash.keep(_summed(known.select(*columns).unionByName(more.where("ea is not null").select(*columns))), "known")
            cuts = stash.keep(more.where("ea is null").drop("ea", "edoc", "hits").unionByName(left.join(asking, "qa", "left_anti"), allowMissingColumns=True), "cuts")
            hidden = stash.keep(_hidden(cuts), "hidden")
        fresh = known.join(hidden, "qa", "left").where(reached).select("qa", "ea", "qdoc", "edoc").join(chosen, ["qa", "ea"], "left_anti")
        fresh = stash.keep(fresh, "pairs")
        if fresh.take(1):
            good = good.unionByName(_verified(corpus, fresh, least, stash))
            chosen = chosen.unionByName(fresh)
        if more is None:
            return good


def repeated_texts(documents: DataFrame, least: float = 0.65, doc_id: str = "doc_id", text: str = "text", batch: str = "batch_no", stash: Stash | None = None, folder: str | None = None) -> DataFrame:
    """(dup_of, doc_id, overlap): each document of batch 1 or later that repeats an earlier one, and the smallest such.

    Two documents repeat each other if, of the distinct 5-character sequences found in either folded text, both have at
    least ``least``. Batches are accepted one by one into a ``History``, in ``folder`` where one is given and kept; a folder with
    accepted batches may be given, with documents that hold the new batches and, for their candidates' texts, the old
    ones. Texts that fold to the same characters count as one from the start, so copies cost nothing. A null batch is
    history (0); null, empty and symbol-only texts are no cases; a doc_id that comes more than once counts once for each
    different text. Runs of equal keys longer than RUN are read RUN smallest documents at a time; documents for which
    that could hide a pair ask again, further on, until none is left, so nothing is capped.
    """
    spark = documents.sparkSession
    stash = stash or Stash(spark)
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(batch).cast("int"), F.lit(0)), F.lit(0)).alias("batch"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    sizes = {r.batch: r.n for r in source.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    history = History(spark, folder or f"{shared_dir(spark)}/foliant-history-{uuid.uuid4().hex}", shards_for(sum(sizes.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))), least)
    accepted = {r.batch for r in history.texts().select("batch").distinct().collect()} if history.segments else set()
    met, fresh = [], []
    numbers = sorted(set(sizes) - accepted)
    for i, number in enumerate(numbers):
        added = history.add(source.where(F.col("batch") == number))
        fresh += added if number >= 1 else []
        if fresh and (len(fresh) == LOADS or i == len(numbers) - 1):
            met.append(history.search(fresh, stash))
            fresh = []
            if folder or i < len(numbers) - 1:
                history.compact()
    plain = stash.keep(history.texts(), "plain")
    verified = confirmed(history, source.select("doc_id", "text"), met, least, stash) if met else spark.createDataFrame([], "qa long, ea long, overlap double")
    history.close(remove=folder is None)
    classes = stash.keep(plain.groupBy("d1", "d2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "classes")
    links = verified.join(classes.select(F.col("d1").alias("qa"), F.col("low").alias("la")), "qa").join(classes.select(F.col("d1").alias("ea"), F.col("low").alias("lb")), "ea")
    near = links.select(F.greatest("la", "lb").alias("low"), F.least("la", "lb").alias("near"), "overlap").groupBy("low").agg(F.min(F.struct("near", F.negative("overlap").alias("less"))).alias("m"))
    told = classes.join(near, "low", "left").where("n > 1 or m is not null").select("d1", "d2", "low", "m")
    asked = plain.where("batch >= 1")
    for number in accepted:
        asked = asked.where(F.col("batch") != number)
    out = asked.join(told, ["d1", "d2"]).select("doc_id", F.coalesce("m.near", F.when(F.col("doc_id") > F.col("low"), F.col("low"))).alias("dup_of"), F.coalesce(-F.col("m.less"), F.lit(1.0)).alias("overlap"))
    return out.where("dup_of < doc_id").groupBy("doc_id").agg(F.min(F.struct("dup_of", "overlap")).alias("m")).select("m.dup_of", "doc_id", "m.overlap")
