"""From runs to verdicts: growth over sentences, merging on one source and over sources, final selection, and why a pair counts.

All folds go in order within one pair or one document, over the few matches that recall has left of it.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.intervals import union_length
from foliant.session import ship

_COLUMNS = ("query_id", "doc_id", "start", "end", "src_start", "src_end", "grams")
_MATCH = "query_id long, doc_id long, start int, end int, src_start int, src_end int, grams long"
#: Matches of one pair or document that a fold takes at most; recall and stop grams leave far fewer.
FOLD = 200_000


def _plain(matches: DataFrame) -> DataFrame:
    ship(matches.sparkSession)
    return matches.select("query_id", "doc_id", *(F.col(c).cast("int").alias(c) for c in _COLUMNS[2:6]), F.col("grams").cast("long").alias("grams"))


def _checked(frame: pd.DataFrame) -> pd.DataFrame:
    if len(frame) > FOLD:
        raise ValueError(f"more than {FOLD} matches in one group")
    return frame


def merge_same_source(matches: DataFrame, gap: int = 25, back: int = 12) -> DataFrame:
    """Matches of a pair in order of their start, joined while the next begins at most ``gap`` after the last on both sides
    and goes back at most ``back`` in the source."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = []
        for r in _checked(frame).sort_values(["start", "end", "src_start", "src_end"]).itertuples(index=False):
            last = rows[-1] if rows else None
            if last and r.start - last[3] <= gap and -back <= r.src_start - last[5] <= gap:
                last[3], last[5], last[6] = max(last[3], r.end), max(last[5], r.src_end), last[6] + r.grams
            else:
                rows.append([r.query_id, r.doc_id, r.start, r.end, r.src_start, r.src_end, r.grams])
        return pd.DataFrame([(a, b, s, e, c, d, g) for a, b, s, e, c, d, g in rows], columns=list(_COLUMNS))

    return _plain(matches).groupBy("query_id", "doc_id").applyInPandas(fold, _MATCH)


def select_matches(matches: DataFrame, both: float = 0.85, one: float = 0.70, least: int = 30) -> DataFrame:
    """The best matches of a pair: by length and grams, each unless it is shorter than ``least``, or a better one covers
    ``both`` of its place, or ``one`` of its place and of its source."""

    def part(a: int, b: int, c: int, d: int) -> float:
        return max(0, min(b, d) - max(a, c)) / max(1, b - a)

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _checked(frame)
        frame = frame.assign(size=frame["end"] - frame["start"]).sort_values(["size", "grams", "start", "src_start"], ascending=[False, False, True, True])
        kept: list = []
        for r in frame.itertuples(index=False):
            if r.size < least:
                continue
            here = [(part(r.start, r.end, k.start, k.end), part(r.src_start, r.src_end, k.src_start, k.src_end)) for k in kept]
            if not any(x >= both or (x >= one and y >= one) for x, y in here):
                kept.append(r)
        return pd.DataFrame([tuple(getattr(k, c) for c in _COLUMNS) for k in kept], columns=list(_COLUMNS))

    return _plain(matches).groupBy("query_id", "doc_id").applyInPandas(fold, _MATCH)


_STOP = re.compile(r"[^。！？；\r\n]+[。！？；]?")


def grow(matches: DataFrame, texts: DataFrame, neighbours: int = 6, least: float = 0.40, span: int = 1200) -> DataFrame:
    """(…, kind): matches grown over the sentences beside them, as far as each is like the next of the source (or the one
    after it), at most ``neighbours`` each way and ``span`` in all; those that grew are paraphrases, others exact.

    texts: (doc_id, text), positions counting its code points. Pairs without a text keep their matches.
    """
    body = texts.select("doc_id", "text").dropDuplicates(["doc_id"])
    both = _plain(matches).join(body.select(F.col("doc_id").alias("query_id"), F.col("text").alias("qt")), "query_id", "left").join(body.withColumnRenamed("text", "st"), "doc_id", "left")

    def alike(a: str, b: str) -> float:
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        head = _checked(frame).iloc[0]
        qs, ss = ([(m.start(), m.end(), m[0]) for m in _STOP.finditer(t or "")] for t in (head.qt, head.st))
        at = lambda parts, pos: next((i for i, p in enumerate(parts) if p[0] <= pos < p[1]), None)
        rows = []
        for r in frame.sort_values(["start", "src_start"]).itertuples(index=False):
            start, end, c, d, kind = r.start, r.end, r.src_start, r.src_end, "exact"
            for way, (q_pos, s_pos) in ((1, (end - 1, d - 1)), (-1, (start, c))):
                i, j = at(qs, q_pos), at(ss, s_pos)
                for _ in range(neighbours if i is not None and j is not None else 0):
                    i += way
                    if not 0 <= i < len(qs):
                        break
                    options = [k for k in (j + way, j + 2 * way) if 0 <= k < len(ss)]
                    best = max(options, key=lambda k: (alike(qs[i][2], ss[k][2]), -abs(k - j)), default=None)
                    if best is None or alike(qs[i][2], ss[best][2]) < least or max(end, qs[i][1]) - min(start, qs[i][0]) > span:
                        break
                    start, end, c, d, j, kind = min(start, qs[i][0]), max(end, qs[i][1]), min(c, ss[best][0]), max(d, ss[best][1]), best, "paraphrase"
            rows.append((r.query_id, r.doc_id, start, end, c, d, r.grams, kind))
        return pd.DataFrame(rows, columns=[*_COLUMNS, "kind"])

    return both.groupBy("query_id", "doc_id").applyInPandas(fold, _MATCH + ", kind string")


def source_groups(matches: DataFrame, span: int = 1600, overlap: float = 0.55, gap: int = 20, progress: int = 24) -> DataFrame:
    """(query_id, group_no, start, end, parts, sources, best_source): a document's matches in all sources, grouped where they lie
    together: the next overlaps ``overlap`` of the shorter or begins within ``gap``, the group stays within ``span``, and a
    source that the group has already goes on within ``progress`` of where it was."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        groups: list[dict] = []
        for r in _checked(frame).sort_values(["start", "end", "doc_id", "src_start"]).itertuples(index=False):
            g = groups[-1] if groups else None
            if g:
                common = min(g["end"], r.end) - max(g["start"], r.start)
                near = common >= overlap * min(g["end"] - g["start"], r.end - r.start) or 0 <= r.start - g["end"] <= gap
                goes_on = r.doc_id not in g["at"] or abs(r.src_start - g["at"][r.doc_id]) <= progress or common > 0
                if near and goes_on and max(g["end"], r.end) - g["start"] <= span:
                    g["end"], g["parts"] = max(g["end"], r.end), g["parts"] + 1
                    g["at"][r.doc_id] = max(g["at"].get(r.doc_id, 0), r.src_end)
                    g["size"][r.doc_id] = g["size"].get(r.doc_id, 0) + r.end - r.start
                    continue
            groups.append({"start": r.start, "end": r.end, "parts": 1, "at": {r.doc_id: r.src_end}, "size": {r.doc_id: r.end - r.start}})
        q = frame["query_id"].iloc[0]
        return pd.DataFrame([(q, n, g["start"], g["end"], g["parts"], len(g["size"]), min(g["size"], key=lambda d: (-g["size"][d], d))) for n, g in enumerate(groups)], columns=["query_id", "group_no", "start", "end", "parts", "sources", "best_source"])

    return _plain(matches).groupBy("query_id").applyInPandas(fold, "query_id long, group_no int, start int, end int, parts int, sources int, best_source long")


def pair_reason(pairs: DataFrame) -> DataFrame:
    """Pairs with ``reason``: why a pair doesn't count, by the first rule that holds; null if it counts.

    Columns: parts, template_parts, with_source, lexical (mean), covered, total, longest.
    """
    n = F.col
    reason = (
        F.when(n("parts") == 0, "no_parts")
        .when(n("with_source") / n("parts") < 0.8, "few_sources")
        .when(n("lexical") < 0.2, "unlike")
        .when(n("covered") < 30, "few_chars")
        .when(F.coalesce(F.try_divide(n("covered").cast("double"), n("total")), F.lit(0.0)) < 0.2, "small_share")
        .when(n("template_parts") / F.greatest(n("parts") + n("template_parts"), F.lit(1)) >= 0.7, "template")
        .when(n("longest") < 20, "short_parts")
    )
    return pairs.withColumn("reason", reason)


def pair_facts(matches: DataFrame, keys: Sequence[str], template: str, text: str, source: str, score: str) -> DataFrame:
    """What ``pair_reason`` needs, of matches with start and end: parts that are template text are counted apart."""
    real = ~F.col(template)
    sums = matches.groupBy(*keys).agg(
        F.count_if(real).alias("parts"), F.count_if(F.col(template)).alias("template_parts"), F.count_if(real & (F.col(source) != "")).alias("with_source"),
        F.avg(F.when(real, F.col(score))).alias("lexical"), F.max(F.when(real, F.length(text))).alias("longest"),
    )
    net = union_length(matches.where(real), keys).select(*keys, F.col("covered").cast("long").alias("covered"))
    return sums.join(net, list(keys), "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
