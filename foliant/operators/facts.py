"""Facts of a document: its profile by vocabularies, keyword windows, numbered headings, slices between headings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.intervals import islands
from foliant.session import spread

# Vocabularies of four kinds of projects; a parameter of profile().
VOCABULARIES = {
    "basic": ("机理", "规律", "理论", "揭示", "阐明"),
    "applied": ("技术", "工艺", "优化", "检测", "部署"),
    "industrial": ("装置", "产线", "示范", "推广", "设备"),
    "social": ("社区", "老年", "儿童", "康复", "临床"),
}


def profile(text: Column, vocabularies: dict[str, Sequence[str]] | None = None) -> tuple[Column, Column, Column]:
    """(kind, hits, confidence): the vocabulary with the most words in a text, the first of equals; none without a hit.

    confidence: .5 and half of the lead over the second, as a share of the hits.
    """
    vocab = vocabularies or VOCABULARIES
    counts = F.array(*(F.struct(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("kind")) for i, (name, words) in enumerate(vocab.items())))
    ordered = F.reverse(F.array_sort(counts))
    best, second = F.element_at(ordered, 1), F.element_at(ordered, 2)
    lead = F.coalesce(F.try_divide((best["n"] - second["n"]).cast("double"), best["n"]), F.lit(0.0))
    return F.when(best["n"] > 0, best["kind"]), best["n"], F.when(best["n"] > 0, 0.5 + 0.5 * lead).otherwise(0.0)


def hits(documents: DataFrame, word: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, pos): where a word begins in each text; occurrences don't overlap."""
    source = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null")).where(F.contains("text", F.lit(word)))
    parts = source.select("doc_id", F.length("text").alias("size"), F.posexplode(F.split("text", rf"\Q{word}\E", -1)).alias("i", "part"))
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = parts.withColumn("pos", F.sum(F.length("part") + len(word)).over(before) - len(word))
    return ends.where(F.col("pos") < F.col("size")).select("doc_id", "size", "pos")


def keyword_windows(documents: DataFrame, words: Sequence[str], context: int = 30, **columns: str) -> DataFrame:
    """(doc_id, start, end, parts): hits of any of the words with their context, merged where they touch."""
    found: DataFrame | None = None
    for word in words:
        one = hits(documents, word, **columns).select("doc_id", F.greatest(F.col("pos") - context, F.lit(0)).alias("start"), F.least(F.col("pos") + len(word) + context, F.col("size")).alias("end"))
        found = one if found is None else found.unionByName(one)
    return islands(found, ["doc_id"])


def numbered_runs(lines: DataFrame, pattern: str = r"^(\d{1,3})\.\d") -> DataFrame:
    """(doc_id, first_no, last_no, headings): the longest run of headings whose numbers go up by one; the first of equals.

    Gaps and islands: number minus its rank is constant within a run. lines: (doc_id, line_no, line).
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    numbers = lines.withColumn("n", F.regexp_extract("line", pattern, 1).try_cast("int")).where("n is not null").withColumn("r", F.row_number().over(order))
    runs = numbers.groupBy("doc_id", (F.col("n") - F.col("r")).alias("run")).agg(F.min("n").alias("first_no"), F.max("n").alias("last_no"), F.count("*").alias("headings"))
    best = runs.groupBy("doc_id").agg(F.min(F.struct((-F.col("headings")).alias("less"), "first_no", "last_no")).alias("m"))
    return best.select("doc_id", "m.first_no", "m.last_no", (-F.col("m.less")).alias("headings"))


def between(text: Column, start: str, end: str) -> Column:
    """What lies from the first match of ``start`` up to the next match of ``end``; '' where either is missing."""
    tail = F.regexp_extract(text, f"(?s)({start}.*)", 1)
    return F.regexp_extract(tail, f"(?s)^({start}.*?)(?:{end})", 1)
