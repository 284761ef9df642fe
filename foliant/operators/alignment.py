"""Alignment of candidate pairs: windows and their coverage, anchors, diagonal runs, merging, and pair scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import fingerprint32, gram_list, grams, squeeze
from foliant.operators.intervals import union_length
from foliant.session import ship


def sliding_windows(documents: DataFrame, size: int = 240, step: int = 80, least: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, win_no, start, end, body): windows of squeezed text. The last is clipped at the end; those with fewer
    than ``least`` characters are dropped, unless the text has no longer one."""
    plain = documents.select(F.col(doc_id).alias("doc_id"), squeeze(F.col(text)).alias("body")).where(F.length("body") > 0)
    starts = plain.withColumn("size", F.length("body")).select("doc_id", "body", "size", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(step))).alias("win_no", "start"))
    cut = starts.where((F.col("start") == 0) | (F.col("start") + size - step < F.col("size"))).withColumn("end", F.least(F.col("start") + size, F.col("size")))
    return cut.where((F.col("end") - F.col("start") >= least) | (F.col("size") < least) & (F.col("start") == 0)).select("doc_id", "win_no", "start", "end", F.substr("body", F.col("start") + 1, F.col("end") - F.col("start")).alias("body"))


def window_coverage(windows: DataFrame, documents: DataFrame, pairs: DataFrame, sizes: tuple[int, ...] = (2, 4, 8), weights: tuple[float, ...] = (0.15, 0.35, 0.5), least: float = 0.12) -> DataFrame:
    """(query_id, doc_id, win_no, score): how much of a query's window its candidate covers: the weighted shares of the
    window's distinct grams of each size that occur in the candidate.

    windows: of queries. documents: (doc_id, text). pairs: (query_id, doc_id), few for each query.
    """
    sets = documents.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *(grams(squeeze(F.col("text")), n).alias(f"d{n}") for n in sizes))
    cut = windows.select(F.col("doc_id").alias("query_id"), "win_no", *(grams(F.col("body"), n).alias(f"w{n}") for n in sizes))
    joined = pairs.select("query_id", "doc_id").join(sets, "doc_id").join(cut, "query_id")
    parts = [w * F.size(F.array_intersect(f"w{n}", f"d{n}")) / F.size(f"w{n}") for n, w in zip(sizes, weights, strict=True)]
    return joined.select("query_id", "doc_id", "win_no", sum(parts[1:], parts[0]).alias("score")).where(F.round("score", 9) >= least)


def suspicion(scores: DataFrame, top: int = 6, weights: tuple[float, float, float] = (0.55, 0.35, 0.10), least: float = 0.08) -> DataFrame:
    """(query_id, doc_id, best, mean3, hits, suspicion): of a pair's best windows, the highest, the mean of the first
    three, and the share of ``top`` that there are, weighted."""
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "win_no")
    ranked = scores.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    out = ranked.groupBy("query_id", "doc_id").agg(F.max("score").alias("best"), F.avg(F.when(F.col("r") <= 3, F.col("score"))).alias("mean3"), F.count("*").alias("hits"))
    value = weights[0] * F.col("best") + weights[1] * F.col("mean3") + weights[2] * F.col("hits") / top
    return out.withColumn("suspicion", value).where(F.round("suspicion", 9) >= least)


def positions(documents: DataFrame, n: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, pos): the fingerprint of every n-gram of squeezed text and where it begins."""
    plain = documents.select(F.col(doc_id).alias("doc_id"), squeeze(F.col(text)).alias("body")).where(F.length("body") >= n)
    return plain.select("doc_id", F.posexplode(gram_list(F.col("body"), n)).alias("pos", "gram")).select("doc_id", fingerprint32(F.col("gram")).alias("fp"), "pos")


def anchors(pairs: DataFrame, places: DataFrame, most: int = 200) -> DataFrame:
    """(query_id, doc_id, a, b): places with equal fingerprints. Fingerprints with more than ``most`` places in the
    candidate are stop grams (the operator's rule, which bounds what one place can match)."""
    qa = pairs.join(places.select(F.col("doc_id").alias("query_id"), "fp", F.col("pos").alias("a")), "query_id")
    many = Window.partitionBy("doc_id", "fp")
    pb = places.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("n", F.count("*").over(many)).where(F.col("n") <= most)
    return qa.join(pb.select("doc_id", "fp", F.col("pos").alias("b")), ["doc_id", "fp"]).select("query_id", "doc_id", "a", "b")


def runs(found: DataFrame, n: int = 8, bucket: int = 8, gap: int = 8, least: int = 5) -> DataFrame:
    """(query_id, doc_id, diagonal, start, end, src_start, src_end, grams): runs of anchors along a diagonal.

    Anchors are bucketed by floor((a - b) / bucket) and ordered; a step of more than ``gap`` on either side ends a run;
    runs of fewer than ``least`` anchors are dropped.
    """
    keys = ["query_id", "doc_id", "diagonal"]
    lined = found.withColumn("diagonal", F.floor((F.col("a") - F.col("b")) / float(bucket)).cast("long"))
    order = Window.partitionBy(*keys).orderBy("a", "b")
    step = (F.col("a") - F.lag("a").over(order) > gap) | (F.col("b") - F.lag("b").over(order) > gap)
    marked = lined.withColumn("new", F.coalesce(step.cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy(*keys, "run").agg(F.min("a").alias("start"), (F.max("a") + n).alias("end"), F.min("b").alias("src_start"), (F.max("b") + n).alias("src_end"), F.count("*").alias("grams"))
    return out.where(F.col("grams") >= least).drop("run")


_MATCH = "query_id long, doc_id long, start int, end int, src_start int, src_end int, grams long"


def _fold(gap: int, span: int, keep: float):
    def one(frame: pd.DataFrame) -> pd.DataFrame:
        """Drops runs mostly inside longer ones, then joins neighbours that go on together on both sides."""
        frame = frame.assign(size=frame["end"] - frame["start"]).sort_values(["size", "start", "src_start"], ascending=[False, True, True])
        kept: list[tuple] = []
        for r in frame.itertuples():
            if not any(min(r.end, k[1]) - max(r.start, k[0]) >= keep * r.size for k in kept):
                kept.append((r.start, r.end, r.src_start, r.src_end, r.grams))
        kept.sort()
        out: list[list] = []
        for a, b, c, d, g in kept:
            last = out[-1] if out else None
            if last and a - last[1] <= gap and -gap <= c - last[3] <= gap and max(b, last[1]) - last[0] <= span:
                last[1], last[3], last[4] = max(last[1], b), max(last[3], d), last[4] + g
            else:
                out.append([a, b, c, d, g])
        first = frame.iloc[0]
        return pd.DataFrame([(first.query_id, first.doc_id, *m) for m in out], columns=["query_id", "doc_id", "start", "end", "src_start", "src_end", "grams"])

    return one


def merge_runs(found: DataFrame, gap: int = 20, span: int = 1600, keep: float = 0.8) -> DataFrame:
    """Runs of a pair folded in order: those covered to ``keep`` by a longer one are dropped, and neighbours at most
    ``gap`` apart on both sides joined, up to ``span``. A fold in order: one group for each pair, after recall has cut
    the pairs to a few for each query."""
    ship(found.sparkSession)
    return found.select("query_id", "doc_id", F.col("start").cast("int"), F.col("end").cast("int"), F.col("src_start").cast("int"), F.col("src_end").cast("int"), "grams").groupBy("query_id", "doc_id").applyInPandas(_fold(gap, span, keep), _MATCH)


def pair_scores(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query_id, doc_id, raw_chars, covered, share, level): matched characters over the query's length.

    sizes: (query_id, total). Both the plain sum and the length of the union are given; the level goes by the union.
    """
    raw = matches.groupBy("query_id", "doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("raw_chars"))
    net = union_length(matches, ["query_id", "doc_id"]).select("query_id", "doc_id", F.col("covered").cast("long").alias("covered"))
    share = F.least(F.lit(1.0), F.col("covered") / F.col("total"))
    return raw.join(net, ["query_id", "doc_id"]).join(sizes, "query_id").select("query_id", "doc_id", "raw_chars", "covered", share.alias("share"), F.when(share >= 0.8, "high").when(share >= 0.5, "medium").otherwise("low").alias("level"))


def ratios(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs with sequence_ratio, block_ratio and aligned: Ratcliff-Obershelp measures of short texts, in Arrow batches.

    aligned: the larger of both, times the ratio of the shorter to the longer text. Null or empty texts give 0.
    """
    import difflib

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for x, y in zip(frame[a], frame[b], strict=True):
                if not x or not y:
                    out.append((0.0, 0.0, 0.0))
                    continue
                matcher = difflib.SequenceMatcher(None, x, y)
                ratio, block = matcher.ratio(), sum(m.size for m in matcher.get_matching_blocks()) / min(len(x), len(y))
                out.append((ratio, block, max(ratio, block) * min(len(x), len(y)) / max(len(x), len(y))))
            yield frame.assign(**{name: [o[i] for o in out] for i, name in enumerate(("sequence_ratio", "block_ratio", "aligned"))})

    ship(pairs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(measure, f"{fields}, sequence_ratio double, block_ratio double, aligned double")


def longest_shared(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pairs with shared and shared_share: the length of their longest common part, and that over the shorter text's.

    In Arrow batches, for short texts. Null or empty texts give 0.
    """
    import difflib

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            sizes = [difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size if x and y else 0 for x, y in zip(frame[a], frame[b], strict=True)]
            yield frame.assign(shared=sizes, shared_share=[n / min(len(x), len(y)) if n else 0.0 for n, x, y in zip(sizes, frame[a], frame[b], strict=True)])

    ship(pairs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return pairs.mapInPandas(measure, f"{fields}, shared long, shared_share double")
