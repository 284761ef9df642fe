"""Lines, sections carried forward, table rows, passages, and their search by intent."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ROW_MARK, grams, strip
from foliant.session import ship, spread

# Marks of lines.
HEADER = r"^(#{1,6}\s|第[一二三四五六七八九十\d]+[章节]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+(\.\d+)*[ .、．])"
INSTRUCTION = r"(填写说明|填表说明|请填写|注：)"
#: Words that tell what a question is after, and words of sections that answer it.
INTENTS = {
    "budget": (("经费", "预算", "资金", "费用"), ("预算", "经费")),
    "schedule": (("进度", "计划", "时间", "周期"), ("进度", "安排", "计划")),
    "goal": (("目标", "指标", "成果"), ("目标", "指标", "成果", "效益")),
    "team": (("团队", "人员", "负责人"), ("团队", "人员", "组织")),
    "risk": (("风险", "问题"), ("风险",)),
}


def lines(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line): trimmed lines, whatever ends them, blank ones included."""
    source = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    return source.select("doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line")).withColumn("line", strip(F.col("line")))


def line_kind(line: Column) -> Column:
    return (
        F.when(line == "", "blank")
        .when(line.rlike("^" + ROW_MARK) | (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2), "table")
        .when(line.rlike(INSTRUCTION), "instruction")
        .when((F.length(line) <= 40) & line.rlike(HEADER), "header")
        .otherwise("paragraph")
    )


def carry_section(rows: DataFrame) -> DataFrame:
    """Lines with the last header at or before each, '' before the first."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(F.when(line_kind(F.col("line")) == "header", F.col("line")), ignorenulls=True).over(order), F.lit("")))


def fill_down(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Empty and null cells take the last value above them (merged cells of a table)."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(window) for c in columns})


def table_rows(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_no, cell_no, cell): the cells of marked table rows, once each."""
    source = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    rows = source.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(ROW_MARK + r"[^\r\n\[]*"), F.lit(0))).alias("row"))
    cells = rows.select("doc_id", F.regexp_extract("row", r"\[表格行(\d+)\]", 1).cast("long").alias("row_no"), F.posexplode(F.split(F.regexp_replace("row", "^" + ROW_MARK, ""), r"\|")).alias("cell_no", "cell"))
    return cells.withColumn("cell", strip(F.col("cell"))).distinct()


_PASSAGE = "doc_id long, passage_no int, section string, kind string, text string"


def _build(most: int):
    import re

    header, row = re.compile(HEADER), re.compile(ROW_MARK)

    def of(text: str) -> Iterator[tuple[str, str, str]]:
        section, kind, parts = "", "", ""
        for line in re.split(r"\r\n|\r|\n", text):
            line = line.strip(" \t 　\f\v")
            if not line:
                if parts:
                    yield section, kind, parts
                    parts = ""
                continue
            now = "table" if row.match(line) else "header" if len(line) <= 40 and header.match(line) else "paragraph"
            joins = parts and now == kind == "paragraph" and not parts.endswith(("。", "！", "？", "；")) and len(parts) + len(line) <= most
            if parts and not joins:
                yield section, kind, parts
                parts = ""
            if now == "header":
                section = line
            parts, kind = parts + line, now
            while len(parts) > most:
                cut = max(parts.rfind(s, 0, most) for s in "。；！？，")
                cut = cut + 1 if cut >= most // 2 else most
                yield section, kind, parts[:cut]
                parts = parts[cut:]
        if parts:
            yield section, kind, parts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = [(doc, i, *p) for doc, text in zip(frame["doc_id"], frame["text"], strict=True) for i, p in enumerate(of(text))]
            yield pd.DataFrame(out, columns=["doc_id", "passage_no", "section", "kind", "text"])

    return run


def build_passages(documents: DataFrame, most: int = 220, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, passage_no, section, kind, text): wrapped lines of one kind merged, cut to ``most`` characters at a stop
    in the second half where there is one; headers and table rows stay apart."""
    ship(documents.sparkSession)
    source = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null"))
    return source.mapInPandas(_build(most), _PASSAGE)


def intent_of(question: str) -> str | None:
    """The intent with the most of its words in the question."""
    count = {name: sum(w in question for w in words) for name, (words, _) in INTENTS.items()}
    best = max(count, key=lambda name: (count[name], name))
    return best if count[best] else None


def search(passages: DataFrame, question: str, top: int = 8, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The best passages of each key for a question, by an additive score: shared bigrams, the section's words for the
    intent (+5), the question's words in the text (+1.5), table rows (-3), headers (-1), and fragments (-2.5)."""
    intent = intent_of(question)
    asked = F.array(*(F.lit(question[i : i + 2]) for i in range(len(question) - 1)))
    words, sections = INTENTS[intent] if intent else ((), ())
    shared = F.size(F.array_intersect(grams(F.col("text"), 2), F.array_distinct(asked))).cast("double")
    hit = lambda column, many: sum((F.contains(column, F.lit(w)).cast("int") for w in many), F.lit(0))
    score = shared + F.when(hit(F.col("section"), sections) > 0, 5.0).otherwise(0.0) + 1.5 * hit(F.col("text"), words) - F.when(F.col("kind") == "table", 3.0).when(F.col("kind") == "header", 1.0).otherwise(0.0) - F.when(F.length("text") < 8, 2.5).otherwise(0.0)
    scored = passages.withColumn("score", score).where("score > 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "passage_no")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
