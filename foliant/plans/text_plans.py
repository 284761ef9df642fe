"""Queries over documents: recall, windows, runs, templates, sections, keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import alignment, facts, intervals, passages, postings, templates
from foliant.plans.tables import table

# Queries are searched for the documents whose id is divisible by 100, against all.
ASKED = 100

SQL_SQUEEZE = r"regexp_replace(regexp_replace(text, '\[表格行\d+\]', '', 'g'), '[\s\x{00A0}\x{3000}]+', '', 'g')"
SQL_NORM = f"norm AS (SELECT doc_id, {SQL_SQUEEZE} AS n FROM documents WHERE text IS NOT NULL)"


def sql_grams(n: int, c: str = "n") -> str:
    return f"CASE WHEN length({c}) >= {n} THEN list_distinct(list_transform(range(1, length({c}) - {n - 2}), lambda i: substr({c}, i, {n}))) WHEN length({c}) > 0 THEN [{c}] ELSE [] END"


def gram_frequency(spark: SparkSession, folder: str) -> DataFrame:
    """How many grams occur in how many documents."""
    df = postings.gram_frequency(postings.postings(table(spark, folder, "documents")))
    return df.groupBy("df").agg(F.count("*").alias("grams"))


def _recalled(spark: SparkSession, folder: str) -> DataFrame:
    grams = postings.document_grams(table(spark, folder, "documents"))
    index = grams.select(F.explode("grams").alias("gram"), "doc_id")
    queries = grams.where(F.col("doc_id") % ASKED == 0).withColumnRenamed("doc_id", "query_id")
    return postings.coarse_recall(index, queries)


def coarse_recall(spark: SparkSession, folder: str) -> DataFrame:
    return _recalled(spark, folder).withColumn("score", F.round("score", 6))


SQL_RECALL = f"""
grams AS (SELECT doc_id, unnest({sql_grams(4)}) AS gram FROM norm),
asked AS (SELECT query_id, gram FROM (SELECT doc_id AS query_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY gram) AS r FROM grams WHERE doc_id % {ASKED} = 0) WHERE r <= 1200),
freq AS (SELECT gram, count(*) AS df FROM grams GROUP BY gram HAVING count(*) <= 80),
votes AS (SELECT a.query_id, g.doc_id, count(*) AS hits, sum(1.0 / f.df) AS score FROM asked a JOIN freq f USING (gram) JOIN grams g USING (gram) WHERE g.doc_id <> a.query_id GROUP BY ALL HAVING count(*) >= 8),
ranked AS (SELECT query_id, doc_id, hits, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, hits DESC, doc_id) AS rank FROM votes)"""


def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of every document: how many, where the last begins, and how long it is."""
    cut = alignment.sliding_windows(table(spark, folder, "documents").where("text is not null"))
    return cut.groupBy("doc_id").agg(F.count("*").alias("windows"), F.max("start").cast("long").alias("last_start"), F.max("end").cast("long").alias("last_end"), F.min(F.length("body")).cast("long").alias("shortest"))


def window_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Suspicion of each recalled pair, by how its document covers the query's windows."""
    documents = table(spark, folder, "documents").where("text is not null")
    pairs = _recalled(spark, folder).where("rank <= 8").select("query_id", "doc_id")
    windows = alignment.sliding_windows(documents.where(F.col("doc_id") % ASKED == 0))
    out = alignment.suspicion(alignment.window_coverage(windows, documents, pairs))
    return out.select("query_id", "doc_id", F.round("best", 6).alias("best"), F.round("mean3", 6).alias("mean3"), "hits", F.round("suspicion", 6).alias("suspicion"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").where("text is not null")
    pairs = _recalled(spark, folder).where("rank <= 8").select("query_id", "doc_id")
    met = pairs.select("doc_id").union(pairs.select("query_id")).distinct()
    places = alignment.positions(documents.join(met, "doc_id", "left_semi"))
    return alignment.runs(alignment.anchors(pairs, places))


def diagonal_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).select("query_id", "doc_id", "diagonal", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "src_start", "src_end", "grams")))


SQL_RUNS = f"""
pairs AS (SELECT query_id, doc_id FROM ranked WHERE rank <= 8),
met AS (SELECT doc_id FROM pairs UNION SELECT query_id FROM pairs),
eight AS (SELECT doc_id, unnest(range(0, length(n) - 7)) AS pos, n FROM norm JOIN met USING (doc_id) WHERE length(n) >= 8),
places AS (SELECT doc_id, pos, ('0x' || substr(md5(substr(n, pos + 1, 8)), 1, 8))::BIGINT AS fp FROM eight),
few AS (SELECT doc_id, fp, pos AS b FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, fp) AS c FROM places) WHERE c <= 200),
found AS (SELECT p.query_id, p.doc_id, q.pos AS a, f.b FROM pairs p JOIN places q ON q.doc_id = p.query_id JOIN few f ON f.doc_id = p.doc_id AND f.fp = q.fp),
lined AS (SELECT *, CAST(floor((a - b) / 8.0) AS BIGINT) AS diagonal FROM found),
marked AS (SELECT *, CASE WHEN a - lag(a) OVER w <= 8 AND b - lag(b) OVER w <= 8 THEN 0 ELSE 1 END AS new FROM lined WINDOW w AS (PARTITION BY query_id, doc_id, diagonal ORDER BY a, b)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY query_id, doc_id, diagonal ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM marked),
runs AS (SELECT query_id, doc_id, diagonal, min(a) AS start, max(a) + 8 AS "end", min(b) AS src_start, max(b) + 8 AS src_end, count(*) AS grams FROM numbered GROUP BY query_id, doc_id, diagonal, run HAVING count(*) >= 5)"""


def pair_levels(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id").alias("query_id"), F.length(T.squeeze(F.col("text"))).alias("total"))
    out = alignment.pair_scores(_runs(spark, folder), sizes)
    return out.withColumn("share", F.round("share", 6))


def merged_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs folded into matches, pair by pair (an ordered fold: no SQL; tested against a plain version)."""
    return alignment.merge_runs(_runs(spark, folder))


def template_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of all documents by why they are template text."""
    lines = templates.sentences(table(spark, folder, "documents"))
    return lines.withColumn("reason", templates.template_reason(F.col("sentence"))).groupBy("reason").agg(F.count("*").alias("sentences"), F.sum(F.length("sentence")).cast("long").alias("chars"))


def template_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is template text, by merged spans."""
    lines = templates.sentences(table(spark, folder, "documents")).withColumn("reason", templates.template_reason(F.col("sentence"))).where("reason <> 'content'")
    return intervals.union_length(lines, ["doc_id"]).select("doc_id", F.col("covered").cast("long").alias("covered"), "islands")


def line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    lines = passages.lines(table(spark, folder, "documents"))
    return lines.withColumn("kind", passages.line_kind(F.col("line"))).groupBy("doc_id", "kind").agg(F.count("*").alias("lines"))


def carried_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every line's section: the last heading at or before it."""
    out = passages.carry_section(passages.lines(table(spark, folder, "documents")))
    return out.groupBy("doc_id", "section").agg(F.count("*").alias("lines"), F.min("line_no").cast("long").alias("first_line"), F.sum(F.length("line")).cast("long").alias("chars"))


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of all table rows."""
    return passages.table_rows(table(spark, folder, "documents")).select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("cell_no").cast("long").alias("cell_no"), "cell")


def passages_built(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all documents (wrapped lines merged in order: no SQL; tested)."""
    return passages.build_passages(table(spark, folder, "documents"))


def passage_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best passages of each document for a question about budgets."""
    built = passages.build_passages(table(spark, folder, "documents"))
    return passages.search(built, "项目经费预算是多少", top=3)


def project_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords of projects and how many projects have each."""
    rows = table(spark, folder, "project_info").dropDuplicates(["id"])
    return rows.select("id", F.explode(F.array_distinct(T.keywords(F.col("gjc")))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("projects"))


def clean_briefs(spark: SparkSession, folder: str) -> DataFrame:
    """Briefs without mark-up."""
    rows = table(spark, folder, "project_info").where("xmjj is not null").select("id", "xmjj").distinct()
    return rows.select("id", T.clean_html(F.col("xmjj")).alias("brief"))


def project_years(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "project_info").select("id", "year").distinct()
    return rows.select("id", T.year_of(F.col("year")).alias("project_year")).groupBy("project_year").agg(F.count("*").alias("projects"))


def corpus_quality(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.agg(F.count("*").alias("documents"), F.count_if(F.coalesce(F.length(T.strip(F.col("text"))), F.lit(0)) == 0).alias("blank"), F.sum(F.length("text")).cast("long").alias("chars"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"), F.max(F.length("text")).cast("long").alias("longest"), F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"))


def metric_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts by what they measure within a document, where mentions differ."""
    return templates.metric_conflicts(table(spark, folder, "documents"))


def document_profiles(spark: SparkSession, folder: str) -> DataFrame:
    kind, found, confidence = facts.profile(F.col("text"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", kind.alias("kind"), found.cast("long").alias("hits"), F.round(confidence, 6).alias("confidence"))


WINDOW_WORDS = ("经费", "预算", "进度")


def keyword_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = facts.keyword_windows(table(spark, folder, "documents"), WINDOW_WORDS)
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "parts")))


def numbered_headings(spark: SparkSession, folder: str) -> DataFrame:
    return facts.numbered_runs(passages.lines(table(spark, folder, "documents"))).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("first_no", "last_no", "headings")))


def section_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The part on progress of each document, up to the next numbered section."""
    part = facts.between(F.col("text"), "进度安排", "[一二三四五六七八九十]、")
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.length(part).cast("long").alias("chars"), F.md5(part.cast("binary")).alias("digest")).where("chars > 0")


SQL_SENT = r"""sent AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？；\r\n]+[。！？；]?')) AS sentence FROM documents WHERE text IS NOT NULL)"""
SQL_REASON = r"""CASE WHEN regexp_matches(trimmed, '^\[表格行\d+\]') THEN 'table' WHEN regexp_matches(trimmed, '^(#{1,6}\s|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+(\.\d+)*[ .、．])') AND length(trimmed) <= 30 THEN 'heading' WHEN length(trimmed) < 15 THEN 'short' WHEN regexp_matches(trimmed, '^[\d\s.,%:：/\-]+$') THEN 'number' WHEN regexp_matches(trimmed, '(填写说明|填表说明|单位盖章|法定代表人|年\s*月\s*日|参考表述|不得超过|请填写)') THEN 'phrase' ELSE 'content' END"""
SQL_TRIM = r"regexp_replace(sentence, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g')"

SQL_LINES = r"""lined AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS raw, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, line_no, regexp_replace(raw, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g') AS line FROM lined)"""
SQL_KIND = r"""CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^\[表格行\d+\]') OR length(line) - length(replace(line, '|', '')) >= 2 THEN 'table' WHEN regexp_matches(line, '(填写说明|填表说明|请填写|注：)') THEN 'instruction' WHEN length(line) <= 40 AND regexp_matches(line, '^(#{1,6}\s|第[一二三四五六七八九十\d]+[章节]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+(\.\d+)*[ .、．])') THEN 'header' ELSE 'paragraph' END"""

QUERIES = {
    "gram_frequency": gram_frequency,
    "coarse_recall": coarse_recall,
    "window_counts": window_counts,
    "window_scores": window_scores,
    "diagonal_runs": diagonal_runs,
    "pair_levels": pair_levels,
    "merged_runs": merged_runs,
    "template_flags": template_flags,
    "template_share": template_share,
    "line_kinds": line_kinds,
    "carried_sections": carried_sections,
    "table_rows": table_rows,
    "passages_built": passages_built,
    "passage_search": passage_search,
    "project_keywords": project_keywords,
    "clean_briefs": clean_briefs,
    "project_years": project_years,
    "corpus_quality": corpus_quality,
    "metric_mentions": metric_mentions,
    "document_profiles": document_profiles,
    "keyword_windows": keyword_windows,
    "numbered_headings": numbered_headings,
    "section_slices": section_slices,
}

_WINDOWS = """body AS (SELECT doc_id, n, length(n) AS size FROM norm WHERE length(n) > 0),
starts AS (SELECT doc_id, n, size, unnest(range(0, size, 80)) AS start FROM body),
wins AS (SELECT doc_id, start // 80 AS win_no, start, least(start + 240, size) AS "end", n, size FROM starts WHERE start = 0 OR start + 160 < size),
windows AS (SELECT doc_id, win_no, start, "end", substr(n, start + 1, "end" - start) AS body FROM wins WHERE "end" - start >= 90 OR (size < 90 AND start = 0))"""

ORACLES = {
    "gram_frequency": f"WITH {SQL_NORM}, grams AS (SELECT doc_id, unnest({sql_grams(4)}) AS gram FROM norm) SELECT df, count(*) AS grams FROM (SELECT gram, count(*) AS df FROM grams GROUP BY gram) GROUP BY df",
    "coarse_recall": f"WITH {SQL_NORM}, {SQL_RECALL} SELECT query_id, doc_id, hits, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 32",
    "window_counts": f"""WITH {SQL_NORM}, {_WINDOWS} SELECT doc_id, count(*) AS windows, max(start)::BIGINT AS last_start, max("end")::BIGINT AS last_end, min(length(body))::BIGINT AS shortest FROM windows GROUP BY doc_id""",
    "window_scores": f"""WITH {SQL_NORM}, {SQL_RECALL}, pairs AS (SELECT query_id, doc_id FROM ranked WHERE rank <= 8), {_WINDOWS},
        sets AS (SELECT doc_id, {sql_grams(2)} AS d2, {sql_grams(4)} AS d4, {sql_grams(8)} AS d8 FROM norm WHERE doc_id IN (SELECT doc_id FROM pairs)),
        cut AS (SELECT doc_id AS query_id, win_no, {sql_grams(2, "b")} AS w2, {sql_grams(4, "b")} AS w4, {sql_grams(8, "b")} AS w8 FROM (SELECT doc_id, win_no, body AS b FROM windows WHERE doc_id % {ASKED} = 0)),
        scores AS (SELECT query_id, doc_id, win_no, 0.15::DOUBLE * len(list_intersect(w2, d2)) / len(w2) + 0.35::DOUBLE * len(list_intersect(w4, d4)) / len(w4) + 0.5::DOUBLE * len(list_intersect(w8, d8)) / len(w8) AS score FROM pairs JOIN sets USING (doc_id) JOIN cut USING (query_id)),
        top AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, win_no) AS r FROM scores WHERE round(score, 9) >= 0.12),
        agg AS (SELECT query_id, doc_id, max(score) AS best, avg(score) FILTER (r <= 3) AS mean3, count(*) AS hits FROM top WHERE r <= 6 GROUP BY query_id, doc_id),
        fin AS (SELECT *, 0.55::DOUBLE * best + 0.35::DOUBLE * mean3 + 0.10::DOUBLE * hits / 6 AS suspicion FROM agg)
        SELECT query_id, doc_id, round(best, 6) AS best, round(mean3, 6) AS mean3, hits, round(suspicion, 6) AS suspicion FROM fin WHERE round(suspicion, 9) >= 0.08""",
    "diagonal_runs": f'WITH {SQL_NORM}, {SQL_RECALL}, {SQL_RUNS} SELECT query_id, doc_id, diagonal, start::BIGINT AS start, "end"::BIGINT AS "end", src_start::BIGINT AS src_start, src_end::BIGINT AS src_end, grams::BIGINT AS grams FROM runs',
    "pair_levels": f"""WITH {SQL_NORM}, {SQL_RECALL}, {SQL_RUNS},
        m AS (SELECT query_id, doc_id, start, "end", max("end") OVER (PARTITION BY query_id, doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
        net AS (SELECT query_id, doc_id, sum("end" - start) AS raw_chars, sum(greatest(0, "end" - greatest(start, coalesce(before, 0)))) AS covered FROM m GROUP BY query_id, doc_id),
        s AS (SELECT net.*, least(1.0, covered::DOUBLE / length(n)) AS share FROM net JOIN norm ON norm.doc_id = net.query_id)
        SELECT query_id, doc_id, raw_chars::BIGINT AS raw_chars, covered::BIGINT AS covered, round(share, 6) AS share, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "template_flags": f"WITH {SQL_SENT} SELECT reason, count(*) AS sentences, sum(length(sentence))::BIGINT AS chars FROM (SELECT sentence, {SQL_REASON} AS reason FROM (SELECT sentence, {SQL_TRIM} AS trimmed FROM sent) WHERE trimmed <> '') GROUP BY reason",
    "line_kinds": f"WITH {SQL_LINES} SELECT doc_id, {SQL_KIND} AS kind, count(*) AS lines FROM lines GROUP BY ALL",
    "carried_sections": f"""WITH {SQL_LINES}, k AS (SELECT *, {SQL_KIND} AS kind FROM lines), c AS (SELECT doc_id, line_no, line, coalesce(last_value(CASE WHEN kind = 'header' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM k)
        SELECT doc_id, section, count(*) AS lines, min(line_no)::BIGINT AS first_line, sum(length(line))::BIGINT AS chars FROM c GROUP BY ALL""",
    "table_rows": r"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[表格行\d+\][^\r\n\[]*')) AS row FROM documents WHERE text IS NOT NULL),
        parts AS (SELECT doc_id, regexp_extract(row, '\[表格行(\d+)\]', 1)::BIGINT AS row_no, string_split(regexp_replace(row, '^\[表格行\d+\]', ''), '|') AS cells FROM found)
        SELECT DISTINCT doc_id, row_no, (unnest(range(0, len(cells))))::BIGINT AS cell_no, regexp_replace(unnest(cells), '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g') AS cell FROM parts""",
    "project_keywords": r"""WITH p AS (SELECT DISTINCT id, gjc FROM project_info WHERE gjc IS NOT NULL), k AS (SELECT DISTINCT id, regexp_replace(unnest(string_split_regex(gjc, '[;；,，、]')), '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g') AS keyword FROM p) SELECT keyword, count(*) AS projects FROM k WHERE keyword <> '' GROUP BY keyword""",
    "clean_briefs": r"""SELECT id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(xmjj, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[\s\x{00A0}\x{3000}]+', ' ', 'g'), '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g') AS brief FROM (SELECT DISTINCT id, xmjj FROM project_info WHERE xmjj IS NOT NULL)""",
    "project_years": r"""SELECT project_year, count(*) AS projects FROM (SELECT TRY_CAST(nullif(regexp_extract(translate(year, '０１２３４５６７８９', '0123456789'), '((19|20)\d{2})', 1), '') AS INT) AS project_year FROM (SELECT DISTINCT id, year FROM project_info)) GROUP BY project_year""",
    "corpus_quality": r"""SELECT count(*) AS documents, count(*) FILTER (coalesce(length(regexp_replace(text, '[\s\x{00A0}\x{3000}]+', '', 'g')), 0) = 0) AS blank, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 4) AS avg_chars, max(length(text))::BIGINT AS longest, count(DISTINCT source) AS sources, count(*) FILTER (n_chars <> length(text)) AS wrong_length FROM documents""",
    "metric_mentions": r"""WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:增加|提高|减少|降低|缩短)\d+(?:\.\d+)?(?:%|个|项|台|天|例|吨|公斤|毫米|万元|小时|批次|亩|倍)')) AS m FROM documents WHERE text IS NOT NULL),
        p AS (SELECT doc_id, regexp_extract(m, '^(增加|提高|减少|降低|缩短)', 1) AS name, regexp_extract(m, '(%|个|项|台|天|例|吨|公斤|毫米|万元|小时|批次|亩|倍)$', 1) AS unit, regexp_extract(m, '(\d+(?:\.\d+)?)', 1)::DOUBLE AS value FROM f)
        SELECT doc_id, name, unit, count(*) AS mentions, min(value) AS low, max(value) AS high, round((max(value) - min(value)) / min(value), 6) AS spread FROM p GROUP BY ALL HAVING min(value) > 0 AND (max(value) - min(value)) / min(value) > 0.05""",
    "document_profiles": "WITH v AS (SELECT doc_id, " + ", ".join(" + ".join(f"contains(text, '{w}')::INT" for w in words) + f" AS n{i}" for i, words in enumerate(facts.VOCABULARIES.values())) + " FROM documents WHERE text IS NOT NULL), u AS (" + " UNION ALL ".join(f"SELECT doc_id, n{i} AS n, {i} AS o, '{name}' AS kind FROM v" for i, name in enumerate(facts.VOCABULARIES)) + """), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, o) AS k FROM u)
        SELECT a.doc_id, CASE WHEN a.n > 0 THEN a.kind END AS kind, a.n::BIGINT AS hits, round(CASE WHEN a.n > 0 THEN 0.5 + 0.5 * (a.n - b.n)::DOUBLE / a.n ELSE 0 END, 6) AS confidence FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.k = 1 AND b.k = 2""",
    "keyword_windows": "WITH p AS (" + " UNION ALL ".join(f"SELECT doc_id, length(text) AS size, '{w}' AS w, unnest(string_split(text, '{w}')) AS part, generate_subscripts(string_split(text, '{w}'), 1) AS i FROM documents WHERE contains(text, '{w}')" for w in WINDOW_WORDS) + """),
        q AS (SELECT doc_id, size, w, sum(length(part) + length(w)) OVER (PARTITION BY doc_id, w ORDER BY i ROWS UNBOUNDED PRECEDING) - length(w) AS pos FROM p),
        spans AS (SELECT doc_id, greatest(pos - 30, 0) AS s, least(pos + length(w) + 30, size) AS e FROM q WHERE pos < size),
        m AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans),
        n AS (SELECT *, sum(CASE WHEN b IS NULL OR s > b THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT doc_id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*)::BIGINT AS parts FROM n GROUP BY doc_id, run""",
    "numbered_headings": f"""WITH {SQL_LINES}, n AS (SELECT doc_id, line_no, TRY_CAST(nullif(regexp_extract(line, '^(\\d{{1,3}})\\.\\d', 1), '') AS INT) AS n FROM lines), r AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM n WHERE n IS NOT NULL),
        g AS (SELECT doc_id, min(n) AS first_no, max(n) AS last_no, count(*) AS headings FROM r GROUP BY doc_id, run)
        SELECT doc_id, first_no::BIGINT AS first_no, last_no::BIGINT AS last_no, headings FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY headings DESC, first_no, last_no) AS k FROM g) WHERE k = 1""",
    "section_slices": """WITH t AS (SELECT doc_id, regexp_extract(regexp_extract(text, '(?s)(进度安排.*)', 1), '(?s)^(进度安排.*?)(?:[一二三四五六七八九十]、)', 1) AS part FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(part)::BIGINT AS chars, md5(part) AS digest FROM t WHERE length(part) > 0""",
}
