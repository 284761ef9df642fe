"""Expert search and matching: characters hit, subjects, units in conflict, phrases that texts contain."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import Stash, spread

#: Phrases are looked up by so many of their first characters, as many as they have.
HEADS = (6, 12, 18, 36)
#: Bits of the map of phrases' heads that texts are held against, as a power of two; it passes more where it is full, never less.
MAP_BITS = 26
#: Candidate texts broadcast at most (8 bytes each); beyond, texts are joined by shuffle.
BROADCAST_IDS = 500_000


def expert_subjects(experts: DataFrame, slots: Sequence[str] = ("sxxk1", "sxxk2", "sxxk3", "sxxk4", "sxxk5"), key: str = "id") -> DataFrame:
    """(id, slot, code): the filled subject slots of each expert, repeated rows once."""
    pairs = F.filter(F.array(*(F.struct(F.lit(i + 1).alias("slot"), F.trim(c).alias("code")) for i, c in enumerate(slots))), lambda x: F.coalesce(x["code"], F.lit("")) != "")
    return experts.select(key, F.explode(pairs).alias("p")).select(key, "p.slot", "p.code").distinct()


def hit_search(rows: DataFrame, query: str, text: str, key: str, top: int) -> DataFrame:
    """(key, hits, rank): rows by how many of the query's different characters occur in their text."""
    chars = sorted(set(query) - {" "})
    hits = sum((F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(c)).cast("int") for c in chars), F.lit(0))
    best = rows.groupBy(key).agg(F.max(hits).alias("hits")).where("hits > 0").orderBy(F.desc("hits"), key).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("hits"), key)))


def match_by_subject(projects: DataFrame, subjects: DataFrame, least: float = 0.55, top: int = 5) -> DataFrame:
    """(project_id, expert_id, score, rank): experts by the best similarity of their subjects to a project's.

    projects: (project_id, code, unit); subjects: (expert_id, code, unit). Experts of the project's own unit are left out. Ties go by id.
    Levels of a code (all, seven, five digits) are joined by equality. Of a level only the first 2 × ``top`` experts by id are
    joined, with at most ``top`` of each unit: more than one project's own unit can't be missing from them, so no result
    is lost, and a frequent code doesn't pair all its projects with all its experts.
    """
    levels = {"code": F.col("code"), "seven": F.when(F.length("code") >= 7, F.substring("code", 1, 7)), "five": F.when(F.length("code") >= 5, F.substring("code", 1, 5))}
    pairs: DataFrame | None = None
    for name, level in levels.items():
        keyed = subjects.where("code is not null").select("expert_id", "code", F.coalesce("unit", F.concat(F.lit("\0"), "expert_id")).alias("u"), "unit", level.alias("level")).where("level is not null").dropDuplicates(["level", "expert_id"])
        few = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("level", "u").orderBy("expert_id"))).where(F.col("_r") <= top)
        few = few.withColumn("_r", F.row_number().over(Window.partitionBy("level").orderBy("expert_id"))).where(F.col("_r") <= 2 * top)
        asked = projects.where("code is not null").select("project_id", F.col("unit").alias("pu"), level.alias("level"))
        value = {"code": 1.0, "seven": 0.9, "five": 0.55}[name]
        part = asked.join(few.select("level", "expert_id", F.col("unit").alias("eu")), "level").where("pu is null or eu is null or pu <> eu").select("project_id", "expert_id", F.lit(value).alias("score"))
        pairs = part if pairs is None else pairs.unionByName(part)
    scored = pairs.groupBy("project_id", "expert_id").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), "expert_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _runs(batches: Iterator[pa.RecordBatch], text: str, chars: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of about so many characters, or one row, with their code points end to end and where each row begins."""
    for batch in batches:
        upto = np.cumsum(pa.compute.utf8_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(upto):
            base = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, base + chars, "right")))
            part = batch.slice(at, end - at)
            yield part, np.frombuffer("".join(part.column(text).to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], upto[at:end] - base])
            at = end


def _head_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` code points from each position on."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        base, out = np.uint64(0x9E3779B97F4A7C15), np.full(n, size, np.uint64)
        for i in range(size):
            out *= base
            out += points[i : i + n]
            if i % 6 == 5:  # unmixed, equal differences in two places could cancel
                out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(29))


def _places(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    mask = np.uint64((1 << MAP_BITS) - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def _phrase_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, points, bounds in _runs(batches, "phrase"):
        lens, out = np.diff(bounds), np.zeros(batch.num_rows, np.uint64)
        for size in HEADS:
            rows = np.flatnonzero(lens >= size)
            out[rows] = _head_hashes(points, size)[bounds[rows]] if len(rows) else 0
        keep = np.flatnonzero(lens >= HEADS[0])
        yield pa.record_batch([pa.array(out[keep].view(np.int64)), batch.column("phrase").take(pa.array(keep))], names=["h", "phrase"])


def _head_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << MAP_BITS >> 3, np.uint8)
    for batch in batches:
        for place in _places(batch.column("h").to_numpy().view(np.uint64)):
            np.bitwise_or.at(bits, place >> 3, (1 << (place & 7)).astype(np.uint8))
    yield pa.record_batch([pa.array([bits.tobytes()], pa.binary())], names=["bits"])


def contained(phrases: DataFrame, texts: DataFrame, stash: Stash | None = None) -> DataFrame:
    """(key, phrase): which of the different phrases (phrase, of at least HEADS[0] characters) each text (key, text) contains.

    Every position of every text is looked up by the hashes of its next characters, in a map of all phrases' heads that has one
    size for any number of them. Only what the map lets pass is shuffled, and only texts of candidates leave the scan, to be
    compared in full.
    """
    stash = stash or Stash(texts.sparkSession)
    heads = stash.keep(spread(phrases.select("phrase").where("phrase is not null").distinct()).mapInArrow(_phrase_heads, "h long, phrase string"), "heads")
    maps = heads.select("h").coalesce(8).mapInArrow(_head_map, "bits binary").collect()
    shared = texts.sparkSession.sparkContext.broadcast(np.bitwise_or.reduce([np.frombuffer(r.bits, np.uint8) for r in maps]) if maps else np.zeros(1 << MAP_BITS >> 3, np.uint8))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch, points, bounds in _runs(batches, "text"):
            ends, ids = np.repeat(bounds[1:], np.diff(bounds)), batch.column("rid").to_numpy()
            for size in HEADS:
                hashes = _head_hashes(points, size)
                at = np.flatnonzero(np.arange(size, size + len(hashes)) <= ends[: len(hashes)])
                for place in (0, 1):
                    found = _places(hashes[at])[place]
                    at = at[(bits[found >> 3] >> (found & 7).astype(np.uint8)) & 1 == 1]
                rows = np.searchsorted(bounds, at, "right") - 1
                yield pa.record_batch([pa.array(ids[rows]), pa.array(hashes[at].view(np.int64))], names=["rid", "h"])

    rows = texts.where("text is not null").withColumn("rid", F.xxhash64("key", "text"))
    met = spread(rows.select("rid", "text")).mapInArrow(scan, "rid long, h long").join(heads, "h").select("rid", "phrase")
    met = stash.keep(met.distinct(), "met")
    ids = stash.keep(met.select("rid").distinct(), "ids")
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return rows.join(few, "rid", "left_semi").join(met, "rid").where(F.contains("text", "phrase")).select("key", "phrase").distinct()
