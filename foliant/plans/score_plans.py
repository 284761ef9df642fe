"""Queries that score, rank and average what other queries find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import alignment
from foliant.plans import data_plans, text_plans
from foliant.plans.tables import table


def expert_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Matched experts by research (likeness of bigrams, half), subject (.3) and history (.2, of which nothing is known: one half),
    without those whose unit shares a word of four characters or more with the project's."""
    p = table(spark, folder, "project_info").groupBy(F.col("id").alias("project_id")).agg(F.min(F.concat(F.coalesce("gjc", F.lit("")), F.lit(" "), F.coalesce("xmmc", F.lit("")))).alias("a"), F.min("cddw_mc").alias("pu"))
    e = table(spark, folder, "expert_info").groupBy(F.col("id").alias("expert_id")).agg(F.min(F.coalesce("yjly", F.lit(""))).alias("b"), F.min("gzdw").alias("eu"))
    both = data_plans.expert_matches(spark, folder).select("project_id", "expert_id", "score").join(p, "project_id").join(e, "expert_id")
    words = lambda c: F.filter(T.unit_words(F.coalesce(c, F.lit(""))), lambda w: F.length(w) >= 4)
    free = both.where(~F.arrays_overlap(words(F.col("pu")), words(F.col("eu"))))
    research = T.jaccard(T.grams(T.squeeze(F.col("a")), 2), T.grams(T.squeeze(F.col("b")), 2))
    value = F.round(100 * (0.5 * research + 0.3 * F.col("score") + 0.2 * 0.5) + 1e-9, 4)
    return free.select("project_id", "expert_id", value.alias("points")).withColumn("band", F.when(F.col("points") >= 60, "strong").when(F.col("points") >= 40, "fair").otherwise("weak"))


def images_top(spark: SparkSession, folder: str) -> DataFrame:
    """The eight nearest images of each asked one (a top-k report), ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "image_id")
    return data_plans.images_near(spark, folder).withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 8")


def evidence_places(spark: SparkSession, folder: str) -> DataFrame:
    """Where the first 60 characters of each segment stand in its document's text, if they do."""
    s = table(spark, folder, "match_segments").where("text is not null and length(text) >= 20").select("match_id", F.col("doc_a").alias("file"), F.substring("text", 1, 60).alias("head")).distinct()
    files = table(spark, folder, "docs").select(F.col("doc_id").alias("file"), F.col("text_id").alias("doc_id")).dropna().distinct()
    d = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    at = F.when(F.contains("text", "head"), F.expr("locate(head, text)"))
    found = s.join(files, "file").join(d, "doc_id").select("match_id", (at - 1).cast("long").alias("place"))
    return found.groupBy("match_id").agg(F.min("place").alias("place"))


def first_year_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Funding of each topic's first year over all of its funding, where both are known."""
    p = data_plans._panel(spark, folder)
    sums = p.groupBy("topic").agg(F.min_by("funding", "year").alias("first"), F.sum("funding").alias("total")).where("first > 0 and total > 0")
    return sums.select("topic", F.round(F.col("first") / F.col("total"), 6).alias("ratio"))


def balance_variants(spark: SparkSession, folder: str) -> DataFrame:
    """How even sources are by number and by mean length: one less the coefficient of variation, at least 0."""
    d = table(spark, folder, "documents").where("n_chars is not null").groupBy(F.coalesce("source", F.lit("?")).alias("s")).agg(F.count("*").cast("double").alias("n"), F.avg("n_chars").alias("m"))
    even = lambda c: F.round(F.greatest(F.lit(0.0), 1 - F.stddev_pop(c) / F.avg(c)), 6)
    return d.agg(F.count("*").alias("sources"), even("n").alias("by_number"), even("m").alias("by_length"))


def impact_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Mean effects of the shocks over topics that have any, and how many there are."""
    e = data_plans.shock_effects(spark, folder)
    return e.agg(F.count_if(F.col("effect") != 0).alias("topics"), F.round(F.avg("direct"), 4).alias("direct"), F.round(F.avg("spillover"), 4).alias("spillover"), F.round(F.avg(F.abs("effect")), 4).alias("size"))


def topic_words(spark: SparkSession, folder: str) -> DataFrame:
    """The first eight words of keyword fields, and how many projects have each there."""
    rows = table(spark, folder, "project_info").where("gjc is not null").select("id", "gjc").distinct()
    return rows.select("id", F.explode(T.topic_tokens(F.col("gjc"))).alias("word")).groupBy("word").agg(F.countDistinct("id").alias("projects"))


def paraphrase_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The longest part that a paraphrase has in common with its source (no SQL; tested)."""
    s = table(spark, folder, "match_segments").where("text <> '' and source_text <> ''").select("match_id", F.col("text").alias("a"), F.col("source_text").alias("b")).distinct()
    return alignment.longest_shared(s).select("match_id", "shared", F.round("shared_share", 6).alias("shared_share"))


QUERIES = {f.__name__: f for f in (expert_scores, images_top, evidence_places, first_year_ratio, balance_variants, impact_averages, topic_words, paraphrase_shares)}

_SPLIT = r"string_split_regex(coalesce({c}, ''), '[()（）\s,，、\-]|股份有限公司|有限责任公司|有限公司|集团')"
_WORDS = "list_filter(" + _SPLIT + ", lambda w: length(w) >= 4)"
_SQUEEZE = text_plans.SQL_SQUEEZE
_O = data_plans.ORACLES

ORACLES = {
    "expert_scores": f"""WITH m AS ({_O['expert_matches']}), p AS (SELECT id AS project_id, min(coalesce(gjc, '') || ' ' || coalesce(xmmc, '')) AS text, min(cddw_mc) AS pu FROM project_info GROUP BY id), e AS (SELECT id AS expert_id, min(coalesce(yjly, '')) AS text, min(gzdw) AS eu FROM expert_info GROUP BY id),
        pg AS (SELECT project_id, pu, {text_plans.sql_grams(2)} AS ga FROM (SELECT *, {_SQUEEZE} AS n FROM p)), eg AS (SELECT expert_id, eu, {text_plans.sql_grams(2)} AS gb FROM (SELECT *, {_SQUEEZE} AS n FROM e)),
        j AS (SELECT project_id, expert_id, score, coalesce(len(list_intersect(ga, gb))::DOUBLE / nullif(len(list_distinct(ga || gb)), 0), 0) AS r FROM m JOIN pg USING (project_id) JOIN eg USING (expert_id) WHERE NOT list_has_any({_WORDS.format(c='pu')}, {_WORDS.format(c='eu')})),
        v AS (SELECT project_id, expert_id, round(100 * (0.5::DOUBLE * r + 0.3::DOUBLE * score + 0.2::DOUBLE * 0.5) + 1e-9, 4) AS points FROM j) SELECT *, CASE WHEN points >= 60 THEN 'strong' WHEN points >= 40 THEN 'fair' ELSE 'weak' END AS band FROM v""",
    "images_top": f"SELECT query_id, image_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, image_id) AS rank FROM ({_O['images_near']})) WHERE rank <= 8",
    "evidence_places": """WITH s AS (SELECT DISTINCT match_id, doc_a, substr(text, 1, 60) AS head FROM match_segments WHERE text IS NOT NULL AND length(text) >= 20), f AS (SELECT DISTINCT doc_id AS file, text_id FROM docs WHERE text_id IS NOT NULL)
        SELECT match_id, min(nullif(instr(text, head), 0) - 1)::BIGINT AS place FROM s JOIN f ON file = doc_a JOIN documents ON documents.doc_id = text_id WHERE text IS NOT NULL GROUP BY match_id""",
    "first_year_ratio": f"WITH {data_plans._PANEL}, t AS (SELECT topic, arg_min(funding, y) AS first, sum(funding) AS total FROM p GROUP BY topic) SELECT topic, round(first / total, 6) AS ratio FROM t WHERE first > 0 AND total > 0",
    "balance_variants": "WITH d AS (SELECT coalesce(source, '?') AS s, count(*)::DOUBLE AS n, avg(n_chars) AS m FROM documents WHERE n_chars IS NOT NULL GROUP BY 1) SELECT count(*) AS sources, round(greatest(0, 1 - stddev_pop(n) / avg(n)), 6) AS by_number, round(greatest(0, 1 - stddev_pop(m) / avg(m)), 6) AS by_length FROM d",
    "impact_averages": f"SELECT count(*) FILTER (effect <> 0) AS topics, round(avg(direct), 4) AS direct, round(avg(spillover), 4) AS spillover, round(avg(abs(effect)), 4) AS size FROM ({_O['shock_effects']})",
    "topic_words": r"SELECT word, count(DISTINCT id) AS projects FROM (SELECT id, unnest(list_filter(string_split_regex(lower(gjc), '[\s\x{3000},，、;；/|·\-_()（）]+'), lambda x: length(x) >= 2)[1:8]) AS word FROM (SELECT DISTINCT id, gjc FROM project_info WHERE gjc IS NOT NULL)) GROUP BY word",
    # what field_plans has without SQL of its own, as it rests on other queries
    "match_statistics": f"WITH m AS ({_O['expert_matches']}), t AS (SELECT count(DISTINCT id) AS projects FROM project_info), g AS (SELECT count(DISTINCT expert_id) AS experts, round(avg(score), 6) AS avg_score, count(DISTINCT project_id) AS covered FROM m) SELECT experts, avg_score, covered, projects, round(covered::DOUBLE / projects, 6) AS coverage FROM g, t",
    "rare_grams": f"""WITH {text_plans.SQL_NORM}, d AS (SELECT doc_id, n FROM norm WHERE length(n) >= 4), q AS (SELECT doc_id, length(n) AS size, unnest(range(0, length(n) - 3)) AS pos, n FROM d WHERE doc_id % 100 = 0), f AS (SELECT doc_id, substr(n, pos + 1, 4) AS gram, min(pos) AS pos, any_value(size) AS size FROM q GROUP BY ALL),
        g AS (SELECT gram, count(*) AS df FROM (SELECT doc_id, unnest({text_plans.sql_grams(4)}) AS gram FROM d) SEMI JOIN (SELECT DISTINCT gram FROM f) USING (gram) GROUP BY gram), p AS (SELECT doc_id, gram, df, floor(pos * 4 / (size - 3))::BIGINT AS quarter FROM f JOIN g USING (gram)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, quarter ORDER BY df, gram) AS r FROM p) SELECT doc_id, quarter, count(*) AS grams, max(df) AS highest_df, min(df) AS lowest_df FROM r WHERE r <= 40 GROUP BY ALL""",
}
