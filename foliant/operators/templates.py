"""Sentences, template text and its reasons, and amounts that contradict each other."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import ROW_MARK, strip
from foliant.session import spread

# What marks headings, instructions and forms.
HEADING = r"^(#{1,6}\s|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+(\.\d+)*[ .、．])"
PHRASES = r"(填写说明|填表说明|单位盖章|法定代表人|年\s*月\s*日|参考表述|不得超过|请填写)"
REFERENCE = (r"\[\d+\]", r"\[[JMDCPR]\]", r"(?i)doi", r"\d{4}\s*[,，]\s*\d+\s*[（(]\d+[)）]", r"et al|等\.")
METRIC = r"(?:增加|提高|减少|降低|缩短)\d+(?:\.\d+)?(?:%|个|项|台|天|例|吨|公斤|毫米|万元|小时|批次|亩|倍)"


def sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, idx, sentence, start, end): runs up to a full stop or the end of a line, with their places.

    Sentences of white space alone are left out, but positions count all characters.
    """
    source = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    found = source.mapInArrow(_sentences, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, idx int, sentence string, start int, end int")
    return found.where(strip(F.col("sentence")) != "")


_SENTENCE = re.compile(r"[^。！？；\r\n]+[。！？；]?|[。！？；\r\n]+")


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over each text; idx counts the parts between, which aren't sentences, too."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows, owner = [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                for n, m in enumerate(_SENTENCE.finditer(text)):
                    if m[0][0] not in "。！？；\r\n":
                        rows.append((n, m[0], m.start(), m.end())), owner.append(i)
            yield pa.record_batch([part.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32())))], names=["doc_id", "idx", "sentence", "start", "end"])


def template_reason(sentence: Column) -> Column:
    """Why a sentence is template text, by the first rule that holds: table, heading, short, number, phrase; else content."""
    plain = strip(sentence)
    return (
        F.when(plain.rlike("^" + ROW_MARK), "table")
        .when(plain.rlike(HEADING) & (F.length(plain) <= 30), "heading")
        .when(F.length(plain) < 15, "short")
        .when(plain.rlike(r"^[\d\s.,%:：/\-]+$"), "number")
        .when(plain.rlike(PHRASES), "phrase")
        .otherwise("content")
    )


def reference_like(sentence: Column) -> Column:
    """Whether at least two of the marks of a reference occur."""
    return sum((sentence.rlike(p).cast("int") for p in REFERENCE[1:]), sentence.rlike(REFERENCE[0]).cast("int")) >= 2


def metric_conflicts(documents: DataFrame, tolerance: float = 0.05, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, name, unit, mentions, low, high, spread): amounts of one kind of change and unit in a document that differ by more than the tolerance."""
    source = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    found = source.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(METRIC), F.lit(0))).alias("m"))
    parsed = found.select(
        "doc_id",
        F.regexp_extract("m", r"^(增加|提高|减少|降低|缩短)", 1).alias("name"),
        F.regexp_extract("m", r"(%|个|项|台|天|例|吨|公斤|毫米|万元|小时|批次|亩|倍)$", 1).alias("unit"),
        F.regexp_extract("m", r"(\d+(?:\.\d+)?)", 1).cast("double").alias("value"),
    )
    out = parsed.groupBy("doc_id", "name", "unit").agg(F.count("*").alias("mentions"), F.min("value").alias("low"), F.max("value").alias("high"))
    spread_ = F.try_divide(F.col("high") - F.col("low"), F.col("low"))
    return out.where((F.col("low") > 0) & (spread_ > tolerance)).withColumn("spread", F.round(spread_, 6))
