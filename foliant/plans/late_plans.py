"""Queries over late stages: verdicts on pairs, groups of sources, communities, clusters, chunks, profiles of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import graph, grouping, matches, passages, templates
from foliant.plans import text_plans
from foliant.plans.data_plans import _panel, _PANEL, _supplier_graph
from foliant.plans.tables import table


# --- from runs to verdicts -------------------------------------------------------------------------------------------
def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return matches.merge_same_source(text_plans.merged_runs(spark, folder))


def chosen_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Of the merged matches of each recalled pair those that no better one covers (an ordered fold: no SQL; tested)."""
    return matches.select_matches(_merged(spark, folder))


def _squeezed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", T.squeeze(F.col("text")).alias("text"))


def grown_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen matches grown over like sentences (no SQL; tested)."""
    return matches.grow(chosen_matches(spark, folder), _squeezed(spark, folder))


def source_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's matches in all its sources, grouped by place (no SQL; tested)."""
    return matches.source_groups(chosen_matches(spark, folder))


def alignment_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every recalled pair that has grown matches, and why it doesn't count, if so (rests on folds: no SQL; tested)."""
    grown = grown_matches(spark, folder)
    body = _squeezed(spark, folder)
    cut = grown.join(body.withColumnRenamed("doc_id", "query_id"), "query_id").withColumn("part", F.substr("text", F.col("start") + 1, F.col("end") - F.col("start")))
    flagged = cut.select("query_id", "doc_id", "start", "end", "part", (templates.template_reason(F.col("part")) != "content").alias("template"), F.lit("s").alias("source"), F.least(F.lit(1.0), F.col("grams") / (F.col("end") - F.col("start"))).alias("score"))
    facts = matches.pair_facts(flagged, ["query_id", "doc_id"], "template", "part", "source", "score")
    sizes = body.select(F.col("doc_id").alias("query_id"), F.length("text").alias("total"))
    return matches.pair_reason(facts.join(sizes, "query_id")).select("query_id", "doc_id", "parts", "template_parts", "covered", F.round("lexical", 6).alias("lexical"), "reason")


def pair_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The same rules over the stored segments of each document and source."""
    rows = table(spark, folder, "match_segments").where("doc_a is not null and source_doc is not null and end_pos > start_pos").select("match_id", "doc_a", "source_doc", "text", "start_pos", "end_pos", "source_start", "source_end", "similarity_score").distinct()
    flagged = rows.select(
        "doc_a", "source_doc", F.coalesce("text", F.lit("")).alias("text"), F.col("start_pos").alias("start"), F.col("end_pos").alias("end"),
        (templates.template_reason(F.coalesce("text", F.lit(""))) != "content").alias("template"), F.when(F.col("source_end") > F.col("source_start"), "s").otherwise("").alias("source"), F.nanvl("similarity_score", F.lit(None)).alias("score"),
    )
    facts = matches.pair_facts(flagged, ["doc_a", "source_doc"], "template", "text", "source", "score")
    sizes = table(spark, folder, "docs").groupBy(F.col("doc_id").alias("doc_a")).agg(F.max("char_count").alias("total"))
    out = matches.pair_reason(facts.join(sizes, "doc_a", "left"))
    return out.select("doc_a", "source_doc", "parts", "template_parts", "covered", F.round("lexical", 6).alias("lexical"), "reason")


# --- communities and clusters ----------------------------------------------------------------------------------------
def modular_communities(spark: SparkSession, folder: str) -> DataFrame:
    """Communities of the stronger supplier links by modularity, at the resolution whose number of them is nearest to 8 (moves in
    order: no SQL; tested)."""
    return graph.nearest_resolution(_supplier_graph(spark, folder).where("weight >= 8"), 8)[1]


def keyword_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Projects of each field clustered by their keywords (linkage: no SQL; tested)."""
    rows = table(spark, folder, "project_info").select("id", F.substring("ssxk1", 1, 3).alias("field"), T.keywords(F.coalesce("gjc", F.lit(""))).alias("words")).where("field is not null and size(words) > 0")
    first = rows.groupBy("field", "id").agg(F.min("words").alias("words"))
    return grouping.average_linkage(first, "field", "id", "words", 0.3)


def vector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of each label clustered by cosine (linkage: no SQL; tested). Labels with more members than linkage takes are split first."""
    e = table(spark, folder, "embeddings").where("embedding is not null and label is not null").select("vec_id", "embedding", F.col("label").cast("string").alias("cluster"))
    split = grouping.split_oversize(e, 500)
    return grouping.average_linkage(e.select("vec_id", "embedding").join(split, "vec_id").withColumnRenamed("cluster", "bucket"), "bucket", "vec_id", "embedding", 0.7, "vectors")


def balanced_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as groups of 10 to 60: larger ones split, members of smaller ones reassigned (rounds: no SQL; tested)."""
    e = table(spark, folder, "embeddings").where("embedding is not null and label is not null").select("vec_id", "embedding", F.col("label").cast("string").alias("cluster"))
    split = e.select("vec_id", "embedding").join(grouping.split_oversize(e, 60), "vec_id")
    return grouping.reassign_small(split, 10, 60)


def field_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of projects by the words of their first titles."""
    rows = table(spark, folder, "project_info").where("ssxk1 is not null").select("id", "xmmc", F.substring("ssxk1", 1, 3).alias("field")).distinct()
    rows = rows.groupBy("field", "id").agg(F.min("xmmc").alias("xmmc"))
    return grouping.group_titles(rows, "field", "xmmc", "id")


def field_group_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups of about 25 each field makes."""
    rows = table(spark, folder, "project_info").where("ssxk1 is not null").groupBy(F.substring("ssxk1", 1, 3).alias("field")).agg(F.countDistinct("id").alias("projects"))
    return rows.select("field", "projects", F.greatest(F.lit(1), F.floor(F.col("projects") / 25.0 + 0.5)).cast("long").alias("groups"))


# --- passages --------------------------------------------------------------------------------------------------------
SECTIONS = {"研究目标": "goal", "研究内容": "content", "技术路线": "method", "进度安排": "schedule", "经费预算": "budget", "预期成果": "result", "项目团队": "team"}


def section_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of documents by the section they open, number and marks aside."""
    lines = passages.lines(table(spark, folder, "documents")).where(passages.line_kind(F.col("line")) == "header")
    plain = F.regexp_replace(F.col("line"), r"^[#\s一二三四五六七八九十\d、.．（）()第章节]+", "")
    kind = F.coalesce(*(F.when(F.startswith(plain, F.lit(w)), name) for w, name in SECTIONS.items()), F.lit("other"))
    return lines.groupBy(kind.alias("kind")).agg(F.count("*").alias("headings"), F.countDistinct("doc_id").alias("documents"))


def section_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of lines under one heading, cut into chunks of 400 characters; a tail of under 80 stays with the chunk before."""
    lines = passages.carry_section(passages.lines(table(spark, folder, "documents"))).where("line <> ''")
    blocks = lines.groupBy("doc_id", "section").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])).alias("block"))
    size = F.length("block")
    count = F.greatest(F.lit(1), F.ceil(size / 400) - F.when((size % 400 > 0) & (size % 400 < 80), 1).otherwise(0)).cast("int")
    each = blocks.select("doc_id", "section", "block", count.alias("of"), F.explode(F.sequence(F.lit(0), count - 1)).alias("n"))
    chunk = F.when(F.col("n") < F.col("of") - 1, F.substr("block", F.col("n") * 400 + 1, F.lit(400))).otherwise(F.substr("block", F.col("n") * 400 + 1))
    return each.select("doc_id", F.md5("section").alias("section"), F.col("n").cast("long").alias("n"), F.length(chunk).cast("long").alias("chars"), F.md5(chunk).alias("digest"))


def diverse_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of each document, best first, without those whose source and first 60 characters were both seen before."""
    rows = table(spark, folder, "match_segments").where("doc_a is not null and text is not null and not isnan(similarity_score)").select("match_id", "doc_a", "source_doc", "text", "similarity_score").distinct()
    order = [F.desc("similarity_score"), F.col("match_id")]
    nth = lambda *keys: F.row_number().over(Window.partitionBy("doc_a", *keys).orderBy(*order))
    seen = rows.withColumn("s", nth("source_doc")).withColumn("p", nth(F.substring("text", 1, 60))).where("s = 1 or p = 1")
    return seen.withColumn("rank", nth().cast("long")).where("rank <= 5").select("doc_a", "match_id", "rank")


def keyword_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that hold most of the asked words (a top-k report)."""
    words = ("传感", "薄膜", "检测", "电极", "视频")
    hits = sum((F.contains("text", F.lit(w)).cast("long") for w in words), F.lit(0).cast("long"))
    return table(spark, folder, "documents").where("text is not null").select("doc_id", hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(10)


# --- graph profiles --------------------------------------------------------------------------------------------------
def relation_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of projects and of experts that meet in a unit: field – project – unit – expert – field."""
    p = table(spark, folder, "project_info").where("ssxk1 is not null and cddw_mc is not null").select(F.substring("ssxk1", 1, 3).alias("field"), "id", F.col("cddw_mc").alias("unit")).distinct()
    e = table(spark, folder, "expert_info").where("sxxk1 is not null and gzdw is not null and sxxk1 <> ''").select(F.substring("sxxk1", 1, 3).alias("other"), F.col("id").alias("expert"), F.col("gzdw").alias("unit")).distinct()
    # counted by unit on each side first, so that a hot unit's projects and experts never meet one by one
    pc = p.groupBy("field", "unit").agg(F.countDistinct("id").alias("projects"))
    ec = e.groupBy("other", "unit").agg(F.countDistinct("expert").alias("experts"))
    return pc.join(ec, "unit").groupBy("field", "other").agg(F.countDistinct("unit").alias("units"), F.sum(F.col("projects") * F.col("experts")).alias("chains"))


def graph_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the file graph, heaviest first, up to the projection's own 5,000; a weight that is missing is 1."""
    value = F.when(F.col("similarity").isNull() | F.isnan("similarity") | (F.col("similarity") < 0), 1.0).when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    rows = table(spark, folder, "document_similarity").where("doc_a is not null and doc_b is not null and doc_a <> doc_b").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), value.alias("w"))
    return rows.groupBy("a", "b").agg(F.max("w").alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(5000)


def graph_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes and edges by kind, and whether each kind is there in numbers (100 or more)."""
    d, s, p, e = (table(spark, folder, t) for t in ("docs", "document_similarity", "project_info", "expert_info"))
    parts = [
        d.select(F.lit("node").alias("part"), F.lit("file").alias("kind"), "doc_id"), p.select(F.lit("node"), F.lit("project"), "id"), e.select(F.lit("node"), F.lit("expert"), "id"),
        s.where("doc_b is not null").select(F.lit("edge"), F.coalesce("type", F.lit("?")), F.concat_ws("|", F.least("doc_a", "doc_b"), F.greatest("doc_a", "doc_b"))),
        p.where("cddw_mc is not null").select(F.lit("edge"), F.lit("undertakes"), F.concat_ws("|", "id", "cddw_mc")), e.where("gzdw is not null").select(F.lit("edge"), F.lit("works_at"), F.concat_ws("|", "id", "gzdw")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.groupBy("part", "kind").agg(F.countDistinct("doc_id").alias("n")).withColumn("ready", F.col("n") >= 100)


def conflict_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Files and the checks that contradict each other about them: pairs checked more than once with results on both sides of one half."""
    value = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    rows = table(spark, folder, "document_similarity").where("doc_a is not null and doc_b is not null and doc_a <> doc_b and not isnan(similarity) and similarity >= 0").select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"), (value >= 0.5).alias("alike"))
    conflicts = rows.groupBy("a", "b").agg(F.count_if("alike").alias("alike"), F.count_if(~F.col("alike")).alias("unlike")).where("alike > 0 and unlike > 0")
    ends = conflicts.select(F.concat_ws("|", "a", "b").alias("conflict"), F.explode(F.array("a", "b")).alias("file"), "alike", "unlike")
    return ends.select("file", "conflict", "alike", "unlike")


def topic_conversion(spark: SparkSession, folder: str) -> DataFrame:
    """Topics by applications and funding, with how their conversion differs from the mean of topics of 20 applications or more."""
    p = _panel(spark, folder).groupBy("topic").agg(F.sum("applications").alias("applications"), F.sum("funded").alias("funded"), F.sum("funding").alias("funding"))
    mean = p.where("applications >= 20").agg(F.avg(F.col("funded") / F.col("applications")).alias("mean"))
    order = Window.orderBy(F.desc("applications"), F.desc(F.round("funding", 2)), "topic")
    return p.crossJoin(F.broadcast(mean)).select("topic", "applications", F.round(F.col("funded") / F.col("applications") - F.col("mean"), 6).alias("above_mean"), F.row_number().over(order).cast("long").alias("rank"))


def quality_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of usable values of each field, against the least that is wanted."""
    rows = table(spark, folder, "project_info")
    want = {"xmmc": 0.95, "gjc": 0.9, "ssxk1": 0.9, "xmjj": 0.8, "cddw_mc": 0.9, "year": 0.9}
    sums = rows.agg(F.count("*").alias("n"), *(F.count_if(T.effective(F.col(c)) != "").alias(c) for c in want))
    each = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("usable"), F.lit(w).alias("least"), F.col("n").alias("rows")) for c, w in want.items()))).alias("x")).select("x.*")
    return each.select("field", "usable", "rows", F.round(F.col("usable") / F.col("rows"), 6).alias("share"), (F.col("usable") / F.col("rows") >= F.col("least")).alias("enough"))


def largest_impacts(spark: SparkSession, folder: str) -> DataFrame:
    """The three topics that gained most between the halves of the years, and the three that lost most."""
    p = _panel(spark, folder)
    half = p.groupBy("topic").agg(F.sum(F.when(F.col("year") > 1994, F.col("applications")).otherwise(0)).alias("after"), F.sum(F.when(F.col("year") <= 1994, F.col("applications")).otherwise(0)).alias("before"))
    delta = half.select("topic", (F.col("after") - F.col("before")).alias("delta"))
    up = F.row_number().over(Window.orderBy(F.desc("delta"), "topic"))
    down = F.row_number().over(Window.orderBy("delta", "topic"))
    return delta.withColumn("u", up).withColumn("d", down).where("u <= 3 or d <= 3").select("topic", "delta", F.when(F.col("u") <= 3, "gain").otherwise("loss").alias("side"))


QUERIES = {f.__name__: f for f in (
    chosen_matches, grown_matches, source_groups, alignment_verdicts, pair_verdicts, modular_communities, keyword_clusters, vector_clusters, balanced_groups, field_titles, field_group_counts,
    section_kinds, section_chunks, diverse_segments, keyword_documents, relation_chain, graph_projection, graph_profile, conflict_graph, topic_conversion, quality_snapshot, largest_impacts,
)}

_TRIM = r"regexp_replace(text, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g')"
_PLAIN_HEAD = r"regexp_replace(line, '^[#\s一二三四五六七八九十\d、.．（）()第章节]+', '')"
_WORDS = ("传感", "薄膜", "检测", "电极", "视频")

ORACLES = {
    "pair_verdicts": f"""WITH r AS (SELECT DISTINCT match_id, doc_a, source_doc, coalesce(text, '') AS text, start_pos AS s, end_pos AS e, source_start, source_end, CASE WHEN isnan(similarity_score) THEN NULL ELSE similarity_score END AS score FROM match_segments WHERE doc_a IS NOT NULL AND source_doc IS NOT NULL AND end_pos > start_pos),
        f AS (SELECT *, {text_plans.SQL_REASON} <> 'content' AS template FROM (SELECT *, {_TRIM} AS trimmed FROM r)),
        a AS (SELECT doc_a, source_doc, count(*) FILTER (NOT template) AS parts, count(*) FILTER (template) AS template_parts, count(*) FILTER (NOT template AND source_end > source_start) AS ws, avg(score) FILTER (NOT template) AS lexical, max(length(text)) FILTER (NOT template) AS longest FROM f GROUP BY ALL),
        m AS (SELECT doc_a, source_doc, s, e, max(e) OVER (PARTITION BY doc_a, source_doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM f WHERE NOT template),
        c AS (SELECT doc_a, source_doc, sum(greatest(0, e - greatest(s, coalesce(b, s))))::BIGINT AS covered FROM m GROUP BY ALL), z AS (SELECT doc_id AS doc_a, max(char_count) AS total FROM docs GROUP BY doc_id),
        j AS (SELECT a.*, coalesce(covered, 0) AS covered, total FROM a LEFT JOIN c USING (doc_a, source_doc) LEFT JOIN z USING (doc_a))
        SELECT doc_a, source_doc, parts, template_parts, covered, round(lexical, 6) AS lexical, CASE WHEN parts = 0 THEN 'no_parts' WHEN ws / parts < 0.8 THEN 'few_sources' WHEN lexical < 0.2 THEN 'unlike' WHEN covered < 30 THEN 'few_chars' WHEN coalesce(covered::DOUBLE / nullif(total, 0), 0) < 0.2 THEN 'small_share' WHEN template_parts / greatest(parts + template_parts, 1) >= 0.7 THEN 'template' WHEN longest < 20 THEN 'short_parts' END AS reason FROM j""",
    "field_titles": """WITH p AS (SELECT ssxk1[1:3] AS field, id, min(xmmc) AS t FROM project_info WHERE ssxk1 IS NOT NULL GROUP BY ALL), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY id) AS r FROM p) WHERE r <= 10),
        w AS (SELECT field, unnest(regexp_extract_all(coalesce(t, ''), '([一-鿿]{2,8})', 1)) AS w FROM f), n AS (SELECT field, w, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, w) AS r FROM w GROUP BY field, w) SELECT field, string_agg(w, '、' ORDER BY r) AS title FROM n WHERE r <= 2 GROUP BY field""",
    "field_group_counts": "SELECT ssxk1[1:3] AS field, count(DISTINCT id) AS projects, greatest(1, floor(count(DISTINCT id) / 25.0 + 0.5))::BIGINT AS groups FROM project_info WHERE ssxk1 IS NOT NULL GROUP BY 1",
    "section_kinds": f"WITH {text_plans.SQL_LINES}, h AS (SELECT doc_id, {_PLAIN_HEAD} AS p FROM lines WHERE {text_plans.SQL_KIND} = 'header') SELECT CASE " + " ".join(f"WHEN starts_with(p, '{w}') THEN '{k}'" for w, k in SECTIONS.items()) + " ELSE 'other' END AS kind, count(*) AS headings, count(DISTINCT doc_id) AS documents FROM h GROUP BY 1",
    "section_chunks": f"""WITH {text_plans.SQL_LINES}, k AS (SELECT *, {text_plans.SQL_KIND} AS kind FROM lines), c AS (SELECT doc_id, line_no, line, coalesce(last_value(CASE WHEN kind = 'header' THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS section FROM k),
        b AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY line_no) AS block FROM c WHERE line <> '' GROUP BY ALL), n AS (SELECT *, greatest(1, ceil(length(block) / 400.0) - (length(block) % 400 BETWEEN 1 AND 79)::INT)::INT AS many FROM b),
        e AS (SELECT doc_id, section, block, many, unnest(range(0, many)) AS n FROM n), t AS (SELECT doc_id, section, n, CASE WHEN n < many - 1 THEN substr(block, n * 400 + 1, 400) ELSE substr(block, n * 400 + 1) END AS t FROM e)
        SELECT doc_id, md5(section) AS section, n::BIGINT AS n, length(t)::BIGINT AS chars, md5(t) AS digest FROM t""",
    "diverse_segments": """WITH r AS (SELECT DISTINCT match_id, doc_a, source_doc, text, similarity_score AS s FROM match_segments WHERE doc_a IS NOT NULL AND text IS NOT NULL AND NOT isnan(similarity_score)),
        n AS (SELECT *, row_number() OVER (PARTITION BY doc_a, source_doc ORDER BY s DESC, match_id) AS a, row_number() OVER (PARTITION BY doc_a, substr(text, 1, 60) ORDER BY s DESC, match_id) AS b FROM r)
        SELECT doc_a, match_id, rank FROM (SELECT doc_a, match_id, row_number() OVER (PARTITION BY doc_a ORDER BY s DESC, match_id) AS rank FROM n WHERE a = 1 OR b = 1) WHERE rank <= 5""",
    "keyword_documents": "SELECT doc_id, " + " + ".join(f"contains(text, '{w}')::BIGINT" for w in _WORDS) + " AS hits FROM documents WHERE " + " OR ".join(f"contains(text, '{w}')" for w in _WORDS) + " ORDER BY hits DESC, doc_id LIMIT 10",
    "relation_chain": """WITH p AS (SELECT DISTINCT ssxk1[1:3] AS field, id, cddw_mc AS unit FROM project_info WHERE ssxk1 IS NOT NULL AND cddw_mc IS NOT NULL), e AS (SELECT DISTINCT sxxk1[1:3] AS other, id, gzdw AS unit FROM expert_info WHERE coalesce(sxxk1, '') <> '' AND gzdw IS NOT NULL)
        SELECT field, other, count(DISTINCT p.unit) AS units, count(*) AS chains FROM p JOIN e ON p.unit = e.unit GROUP BY ALL""",
    "graph_projection": """WITH r AS (SELECT least(doc_a, doc_b) AS a, greatest(doc_a, doc_b) AS b, CASE WHEN similarity IS NULL OR isnan(similarity) OR similarity < 0 THEN 1.0 WHEN similarity > 1 THEN similarity / 100 ELSE similarity END AS w FROM document_similarity WHERE doc_a IS NOT NULL AND doc_b IS NOT NULL AND doc_a <> doc_b)
        SELECT a, b, max(w) AS weight FROM r GROUP BY a, b ORDER BY weight DESC, a, b LIMIT 5000""",
    "graph_profile": """WITH x AS (SELECT 'node' AS part, 'file' AS kind, doc_id AS k FROM docs UNION ALL SELECT 'node', 'project', id FROM project_info UNION ALL SELECT 'node', 'expert', id FROM expert_info UNION ALL SELECT 'edge', coalesce(type, '?'), least(doc_a, doc_b) || '|' || greatest(doc_a, doc_b) FROM document_similarity WHERE doc_b IS NOT NULL
        UNION ALL SELECT 'edge', 'undertakes', id || '|' || cddw_mc FROM project_info WHERE cddw_mc IS NOT NULL UNION ALL SELECT 'edge', 'works_at', id || '|' || gzdw FROM expert_info WHERE gzdw IS NOT NULL) SELECT part, kind, count(DISTINCT k) AS n, count(DISTINCT k) >= 100 AS ready FROM x GROUP BY ALL""",
    "conflict_graph": """WITH r AS (SELECT least(doc_a, doc_b) AS a, greatest(doc_a, doc_b) AS b, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END >= 0.5 AS alike FROM document_similarity WHERE doc_a IS NOT NULL AND doc_b IS NOT NULL AND doc_a <> doc_b AND NOT isnan(similarity) AND similarity >= 0),
        c AS (SELECT a, b, count(*) FILTER (alike) AS alike, count(*) FILTER (NOT alike) AS unlike FROM r GROUP BY ALL HAVING count(*) FILTER (alike) > 0 AND count(*) FILTER (NOT alike) > 0) SELECT unnest([a, b]) AS file, a || '|' || b AS conflict, alike, unlike FROM c""",
    "topic_conversion": f"""WITH {_PANEL}, t AS (SELECT topic, sum(applications)::BIGINT AS applications, sum(funded) AS funded, sum(funding) AS funding FROM p GROUP BY topic), m AS (SELECT avg(funded / applications) AS mean FROM t WHERE applications >= 20)
        SELECT topic, applications, round(funded / applications - mean, 6) AS above_mean, row_number() OVER (ORDER BY applications DESC, round(funding, 2) DESC, topic) AS rank FROM t, m""",
    "quality_snapshot": "WITH f AS (SELECT count(*) AS n" + "".join(f", count(*) FILTER (lower(regexp_replace(coalesce({c}, ''), '^[\\s\\x{{00A0}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{3000}}]+$', '', 'g')) NOT IN (" + ", ".join(f"'{w}'" for w in T.DUMMY) + f")) AS {c}" for c in ("xmmc", "gjc", "ssxk1", "xmjj", "cddw_mc", "year")) + " FROM project_info), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS usable, n AS rows, {w} AS least FROM f" for c, w in (("xmmc", 0.95), ("gjc", 0.9), ("ssxk1", 0.9), ("xmjj", 0.8), ("cddw_mc", 0.9), ("year", 0.9))) + ") SELECT field, usable, rows, round(usable / rows, 6) AS share, usable / rows >= least AS enough FROM u",
    "largest_impacts": f"""WITH {_PANEL}, d AS (SELECT topic, (coalesce(sum(applications) FILTER (y > 1994), 0) - coalesce(sum(applications) FILTER (y <= 1994), 0))::BIGINT AS delta FROM p GROUP BY topic), r AS (SELECT *, row_number() OVER (ORDER BY delta DESC, topic) AS u, row_number() OVER (ORDER BY delta, topic) AS l FROM d)
        SELECT topic, delta, CASE WHEN u <= 3 THEN 'gain' ELSE 'loss' END AS side FROM r WHERE u <= 3 OR l <= 3""",
}
