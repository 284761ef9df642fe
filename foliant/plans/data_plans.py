"""Queries over spans, vectors, images, graphs, panels, comparisons, matching and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import diff, graph, grouping, images, intervals, matching, panel, vectors
from foliant.plans.tables import table
from foliant.streaming import ingest


# --- spans -----------------------------------------------------------------------------------------------------------
def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "match_segments").where("end_pos > start_pos").select("doc_a", "source_doc", "match_type", "similarity_score", F.col("start_pos").alias("start"), F.col("end_pos").alias("end")).distinct()


def segment_union(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.union_length(_spans(spark, folder), ["doc_a"]).select("doc_a", F.col("covered").cast("long").alias("covered"), "islands")


def source_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """What each source contributes to each document."""
    spans = _spans(spark, folder)
    net = intervals.union_length(spans, ["doc_a", "source_doc"])
    top = spans.groupBy("doc_a", "source_doc").agg(F.max("similarity_score").alias("best"))
    return net.join(top, net["doc_a"].eqNullSafe(top["doc_a"]) & net["source_doc"].eqNullSafe(top["source_doc"])).select(net["doc_a"], net["source_doc"], F.col("covered").cast("long").alias("covered"), F.col("islands").alias("parts"), "best")


def uncovered_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Paraphrases that begin outside all exact spans of their document."""
    spans = _spans(spark, folder)
    points = spans.where("match_type = 'paraphrase'").select("doc_a", "source_doc", "start").withColumnRenamed("start", "pos").distinct()
    return intervals.outside(points, spans.where("match_type = 'exact'").select("doc_a", "start", "end"), ["doc_a"])


SQL_SPANS = 'spans AS (SELECT DISTINCT doc_a, source_doc, match_type, similarity_score, start_pos AS s, end_pos AS e FROM match_segments WHERE end_pos > start_pos)'


# --- vectors ---------------------------------------------------------------------------------------------------------
def _neighbours(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return vectors.cosine_top(e, e.where("vec_id % 100 = 0"), 10)


def cosine_top(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder)


def similarity_graph(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    same = (F.col("a_label") == F.col("b_label")).cast("double")
    return vectors.knn_graph(_neighbours(spark, folder), e, "vec_id", same, (0.9, 0.1), 0.1).withColumn("weight", F.round("weight", 5))


def label_centres(spark: SparkSession, folder: str) -> DataFrame:
    c = vectors.mean_vectors(table(spark, folder, "embeddings"), "label")
    return c.select("label", F.posexplode("center").alias("place", "x")).select("label", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


#: The reference's bound; it ends as soon as the centres are stable.
KMEANS_ROUNDS = 100


def kmeans_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Balance and purity of spherical k-means groups (iterative: no SQL; tested by its invariants)."""
    e = table(spark, folder, "embeddings")
    return grouping.balance(grouping.spherical_kmeans(e, 8, rounds=KMEANS_ROUNDS).join(e.select("vec_id", "label"), "vec_id"))


def source_balance(spark: SparkSession, folder: str) -> DataFrame:
    """How even sources are, and how far one language prevails in each."""
    d = table(spark, folder, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), F.lower(F.coalesce("lang", F.lit("?"))).alias("lang"))
    out = grouping.balance(d, "source", "lang")
    return out.select("groups", *(F.round(c, 6).alias(c) for c in ("balance", "purity", "score")))


def dominant_languages(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.coalesce("source", F.lit("?")).alias("source"), F.lower("lang").alias("lang"))
    return grouping.dominant_subject(d, "source", "lang")


def risk_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label", (F.col("vec_id") % 7).alias("subject"), "embedding")
    flagged = grouping.risk_flags(e, vectors.mean_vectors(e, "label"), "label", "subject")
    return flagged.select("label", F.explode("flags").alias("flag")).groupBy("label", "flag").agg(F.count("*").alias("members"))


# --- images ----------------------------------------------------------------------------------------------------------
def _images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "image_features").select("image_id", "doc_id", "sha256_norm", "phash_hex", "width", "height").distinct()


def _asked_images(spark: SparkSession, folder: str) -> DataFrame:
    return _images(spark, folder).where(F.substring("image_id", -2, 2) == "00")


def images_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Equal images in other documents: one row for each class of equal content, and how far it is spread."""
    return _images(spark, folder).where("sha256_norm is not null").groupBy("sha256_norm").agg(F.countDistinct("image_id").alias("images"), F.countDistinct("doc_id").alias("docs"), F.min("image_id").alias("first")).where("images > 1")


def images_near(spark: SparkSession, folder: str) -> DataFrame:
    return images.hamming_join(_images(spark, folder), _asked_images(spark, folder), DECISION_RADIUS)


#: Differing bits up to which the decision lets a pair count (images.decide).
DECISION_RADIUS = 18


def image_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Near images of the queries by level of the decision."""
    all_images, asked = _images(spark, folder), _asked_images(spark, folder)
    near = images.hamming_join(all_images, asked, DECISION_RADIUS)
    a = all_images.select(F.col("image_id").alias("query_id"), F.col("doc_id").alias("qd"), F.col("sha256_norm").alias("qs"))
    b = all_images.select("image_id", "doc_id", "sha256_norm")
    pairs = near.join(a, "query_id").join(b, "image_id")
    score, level = images.decide(F.coalesce(F.col("qd") == F.col("doc_id"), F.lit(False)), F.coalesce(F.col("qs") == F.col("sha256_norm"), F.lit(False)), F.col("distance"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    return pairs.select("query_id", "image_id", "distance", F.round(score, 6).alias("score"), level.alias("level")).distinct()


def not_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return images.pruned(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "docs").select(F.col("text_id").alias("doc_id")))


def latest_index(spark: SparkSession, folder: str) -> DataFrame:
    """Of each file the last time it was indexed."""
    return ingest.latest_rows(table(spark, folder, "docs").select("doc_id", "indexed_at", "text_id").distinct(), "doc_id", "indexed_at")


# --- graphs ----------------------------------------------------------------------------------------------------------
def _supplier_graph(spark: SparkSession, folder: str) -> DataFrame:
    return graph.cooccurrence(table(spark, folder, "lineitem"), "l_orderkey", "l_suppkey")


def supplier_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return _supplier_graph(spark, folder)


def supplier_hops(spark: SparkSession, folder: str) -> DataFrame:
    strong = _supplier_graph(spark, folder).where("weight >= 12")
    return graph.neighbourhood(strong, spark.createDataFrame([(1,)], "node long"), 2).withColumn("hop", F.col("hop").cast("long"))


#: Rounds of PageRank, and a bound for labels, which settle or swing between two states before.
RANK_ROUNDS, LABEL_ROUNDS = 20, 100


def supplier_rank(spark: SparkSession, folder: str) -> DataFrame:
    ranks = graph.pagerank(graph.both_ways(_supplier_graph(spark, folder)), RANK_ROUNDS)
    return ranks.select("node", F.round("score", 8).alias("score"))


def part_communities(spark: SparkSession, folder: str) -> DataFrame:
    return graph.label_propagation(_supplier_graph(spark, folder), LABEL_ROUNDS, settle=True)


def community_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return graph.community_summary(part_communities(spark, folder)).select("label", "size", "members", F.col("rank").cast("long").alias("rank"))


def topic_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of projects that go on under other codes, by shared keywords of two windows of years."""
    from foliant.functions.text import keywords, year_of

    rows = table(spark, folder, "project_info").select("id", "ssxk1", "gjc", "year").distinct().where("ssxk1 is not null")
    words = rows.select(F.substring("ssxk1", 1, 3).alias("community"), F.explode(keywords(F.col("gjc"))).alias("keyword"), year_of(F.col("year")).alias("y"))
    return graph.migration_links(words.where("y <= 2021").select("community", "keyword"), words.where("y > 2021").select("community", "keyword")).withColumn("jaccard", F.round("jaccard", 6))


# --- panels ----------------------------------------------------------------------------------------------------------
def _panel(spark: SparkSession, folder: str) -> DataFrame:
    o, c, n = (table(spark, folder, t) for t in ("orders", "customer", "nation"))
    facts = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("topic"), F.year("o_orderdate").alias("year"), "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))
    return panel.yearly(facts, "topic", "year", F.col("o_orderstatus") == "F", F.col("amount").cast("double"))


def topic_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _panel(spark, folder).select("topic", F.col("year").cast("long").alias("year"), "applications", "funded", F.round("funding", 2).alias("funding"), F.round("requested", 2).alias("requested"))


def topic_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return panel.baseline(_panel(spark, folder), "topic").select("topic", F.col("applications").cast("long").alias("applications"), *(F.round(c, 5).alias(c) for c in ("funded_ratio", "avg_award", "growth", "recent_share", "scale")))


def topic_spans(spark: SparkSession, folder: str) -> DataFrame:
    return panel.span_stats(_panel(spark, folder), "topic").select("single_year", "multi_year", F.round("avg_years", 6).alias("avg_years"), "max_years")


def topic_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings over the two halves of the years."""
    p = _panel(spark, folder)
    half = lambda cond: p.where(cond).groupBy("topic").agg(F.sum("applications").alias("applications"), F.sum("funded").alias("funded"))
    both = panel.two_windows(half("year <= 1994"), half("year > 1994"), "topic", ["applications", "funded"])
    ratio = lambda w: F.try_divide(F.col(f"funded_{w}").cast("double"), F.col(f"applications_{w}"))
    rules = [
        ("shrinking", "medium", F.col("applications_after") < F.col("applications_before")),
        ("growing", "low", F.col("applications_after") > F.col("applications_before") * 1.1),
        ("conversion_drop", "high", ratio("after") < ratio("before") - 0.02),
        ("conversion_gain", "low", ratio("after") > ratio("before") + 0.02),
    ]
    return panel.findings(both, "topic", rules)


def shock_effects(spark: SparkSession, folder: str) -> DataFrame:
    states = panel.baseline(_panel(spark, folder), "topic")
    shocks = spark.createDataFrame([("s1", "NATION_1", 0.2, 0), ("s2", "NATION_3", -0.1, 2), ("s3", None, 0.05, 6)], "shock_id string, target string, strength double, lag int")
    return panel.apply_shocks(states, shocks, "topic", least=0.9, neighbours=50).select("topic", *(F.round(c, 5).alias(c) for c in ("direct", "spillover", "effect")))


# --- comparisons -----------------------------------------------------------------------------------------------------
def budget_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Two sides of a budget by type, compared."""
    items = table(spark, folder, "lineitem").join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    side = lambda flag: items.where(F.col("l_returnflag") == flag).groupBy("p_brand").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"))
    out = diff.compare_items(side("A"), side("R"), ["p_brand"])
    return out.select("p_brand", *(F.round(c, 2).alias(c) for c in ("left_amount", "right_amount", "delta")), "level")


def largest_lines(spark: SparkSession, folder: str) -> DataFrame:
    return diff.largest_by_type(table(spark, folder, "lineitem"), ["l_orderkey", "l_returnflag"], "l_extendedprice")


def total_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    details = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"))
    totals = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("total"))
    return diff.total_conflicts(totals, details, "o_orderkey", "total", "amount", 100000.0).select("o_orderkey", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in ("total", "details", "delta")))


def project_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Of each title the project that fits best: a given unit and year, else a year, else any (progressive relaxation)."""
    rows = table(spark, folder, "project_info").select("id", F.trim("xmmc").alias("title"), "cddw_mc", "year").where("xmmc is not null and trim(xmmc) <> ''").distinct()
    dummy = F.coalesce(F.col("cddw_mc"), F.lit("")).isin("", "-", "无", "暂无", "待定")
    out = diff.first_match(rows, "title", [~dummy & F.col("year").rlike(r"^\d{4}$"), F.col("year").rlike(r"^\d{4}$"), F.lit(True)], ["id"])
    return out.select("title", "id", F.col("level").cast("long").alias("level"))


# --- matching --------------------------------------------------------------------------------------------------------
def subject_counts(spark: SparkSession, folder: str) -> DataFrame:
    return matching.expert_subjects(table(spark, folder, "expert_info")).groupBy("code").agg(F.countDistinct("id").alias("experts"), F.min("slot").cast("long").alias("first_slot"))


def expert_matches(spark: SparkSession, folder: str) -> DataFrame:
    experts = table(spark, folder, "expert_info")
    subjects = matching.expert_subjects(experts).join(experts.select("id", "gzdw").distinct(), "id").select(F.col("id").alias("expert_id"), "code", F.col("gzdw").alias("unit"))
    projects = table(spark, folder, "project_info").select(F.col("id").alias("project_id"), F.trim("ssxk1").alias("code"), F.col("cddw_mc").alias("unit")).distinct()
    return matching.match_by_subject(projects, subjects).withColumn("rank", F.col("rank").cast("long"))


def expert_hits(spark: SparkSession, folder: str) -> DataFrame:
    return matching.hit_search(table(spark, folder, "expert_info"), "光伏薄膜检测", "yjly", "id", 25).withColumn("rank", F.col("rank").cast("long")).withColumn("hits", F.col("hits").cast("long"))


# --- streams ---------------------------------------------------------------------------------------------------------
def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.stream_counts(spark, folder).withColumn("value_sum", F.round("value_sum", 4))


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.sessions(table(spark, folder, "events")).withColumn("session_no", F.col("session_no").cast("long"))


QUERIES = {f.__name__: f for f in (
    segment_union, source_ranking, uncovered_paraphrases, cosine_top, similarity_graph, label_centres, kmeans_groups, source_balance, dominant_languages, risk_counts,
    images_equal, images_near, image_levels, not_indexed, latest_index, supplier_pairs, supplier_hops, supplier_rank, part_communities, community_sizes, topic_migration,
    topic_panel, topic_baseline, topic_spans, topic_findings, shock_effects, budget_diff, largest_lines, total_conflicts, project_latest,
    subject_counts, expert_matches, expert_hits, event_windows, event_sessions,
)}

_ISLANDS = "m AS (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM spans)"
_COVER = "sum(CASE WHEN b IS NULL OR s > b THEN e - s ELSE greatest(0, e - b) END)::BIGINT AS covered, count(*) FILTER (b IS NULL OR s > b)"
_UNIT = "u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_TOP = f"{_UNIT}, t AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_cosine_similarity(q.v, u.v), 6) AS cosine FROM u q JOIN u ON q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank FROM t)"
_IMG = "i AS (SELECT DISTINCT image_id, doc_id, sha256_norm, lower(phash_hex) AS h FROM image_features), v AS (SELECT *, ('0x' || h[1:8])::BIGINT AS hi, ('0x' || h[9:16])::BIGINT AS lo FROM i WHERE regexp_matches(h, '^[0-9a-f]{16}$'))"
_NEAR = f"{_IMG}, n AS (SELECT DISTINCT a.image_id AS query_id, b.image_id, (bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)))::INT AS distance FROM v a JOIN v b ON right(a.image_id, 2) = '00' AND a.image_id <> b.image_id WHERE bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 18)"
_EDGES = "mem AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), edges AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS weight FROM mem a JOIN mem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL), arrows AS MATERIALIZED (SELECT a AS src, b AS dst, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"


def _rank_sql() -> str:
    out = f"WITH {_EDGES}, nodes AS MATERIALIZED (SELECT DISTINCT src AS node FROM arrows), cnt AS (SELECT count(*)::DOUBLE AS c FROM nodes), tot AS (SELECT src, sum(weight)::DOUBLE AS t FROM arrows GROUP BY src), r0 AS (SELECT node, 1.0::DOUBLE / c AS score FROM nodes, cnt)"
    for i in range(RANK_ROUNDS):
        out += f", r{i + 1} AS MATERIALIZED (SELECT a.dst AS node, 0.15::DOUBLE / max(c) + 0.85::DOUBLE * sum(r.score * a.weight / t.t) AS score FROM arrows a JOIN r{i} r ON r.node = a.src JOIN tot t ON t.src = a.src, cnt GROUP BY a.dst)"
    return out + f" SELECT node, round(score, 8) AS score FROM r{RANK_ROUNDS}"


def _labels_sql(rounds: int) -> str:
    out = f"WITH {_EDGES}, around AS MATERIALIZED (SELECT src, dst, weight FROM arrows UNION ALL SELECT src, src, max(weight) FROM arrows GROUP BY src), l0 AS (SELECT DISTINCT src AS node, src AS label FROM arrows)"
    for i in range(rounds):
        out += f", l{i + 1} AS MATERIALIZED (SELECT src AS node, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY sum(weight) DESC, label) AS r FROM around JOIN l{i} ON node = dst GROUP BY src, label) WHERE r = 1)"
    return out


_PANEL = "facts AS (SELECT n_name AS topic, year(o_orderdate) AS y, o_orderstatus = 'F' AS f, o_totalprice AS amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT topic, y, count(*) AS applications, count(*) FILTER (f) AS funded, sum(CASE WHEN f THEN amount ELSE 0 END) AS funding, sum(amount) AS requested FROM facts GROUP BY ALL)"
_BASE = f"""{_PANEL}, ends AS (SELECT topic, arg_min(applications, y)::DOUBLE AS a0, arg_max(applications, y)::DOUBLE AS a1, arg_min(funding, y) AS f0, arg_max(funding, y) AS f1 FROM p GROUP BY topic),
 agg AS (SELECT topic, sum(applications)::BIGINT AS applications, sum(funded)::BIGINT AS funded, sum(funding) AS funding, sum(applications) FILTER (y > (SELECT max(y) FROM p) - 2) AS recent FROM p GROUP BY topic),
 base AS (SELECT topic, applications, funded::DOUBLE / applications AS funded_ratio, coalesce(funding / nullif(funded, 0), 0) AS avg_award,
  0.6 * greatest(-1, least(1, coalesce((a1 - a0) / nullif(a0, 0), 0))) + 0.4 * greatest(-1, least(1, coalesce((f1 - f0) / nullif(f0, 0), 0))) AS growth,
  coalesce(recent, 0)::DOUBLE / applications AS recent_share, ln(1 + applications) / ln(1 + (SELECT max(applications) FROM agg)) AS scale FROM agg JOIN ends USING (topic))"""

ORACLES = {
    "segment_union": f"WITH {SQL_SPANS}, {_ISLANDS.format(k='doc_a')} SELECT doc_a, {_COVER} AS islands FROM m GROUP BY doc_a",
    "source_ranking": f"WITH {SQL_SPANS}, {_ISLANDS.format(k='doc_a, source_doc')} SELECT doc_a, source_doc, {_COVER} AS parts, max(similarity_score) AS best FROM m GROUP BY doc_a, source_doc",
    "uncovered_paraphrases": f"WITH {SQL_SPANS} SELECT DISTINCT doc_a, source_doc, s AS pos FROM spans p WHERE match_type = 'paraphrase' AND NOT EXISTS (SELECT 1 FROM spans x WHERE x.match_type = 'exact' AND x.doc_a IS NOT DISTINCT FROM p.doc_a AND p.s >= x.s AND p.s < x.e)",
    "cosine_top": f"WITH {_TOP} SELECT query_id, vec_id, cosine, rank FROM r WHERE rank <= 10",
    "similarity_graph": f"WITH {_TOP}, e AS (SELECT least(query_id, r.vec_id) AS a, greatest(query_id, r.vec_id) AS b, max(0.9 * cosine + 0.1 * (x.label = y.label)::INT) AS weight FROM r JOIN u x ON x.vec_id = query_id JOIN u y ON y.vec_id = r.vec_id WHERE rank <= 10 GROUP BY ALL) SELECT a, b, round(weight, 5) AS weight FROM e WHERE round(weight, 9) >= 0.1",
    "label_centres": "SELECT label, (place - 1)::BIGINT AS place, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings WHERE label IS NOT NULL) GROUP BY ALL",
    "source_balance": "WITH d AS (SELECT coalesce(source, '?') AS s, lower(coalesce(lang, '?')) AS l, count(*) AS n FROM documents GROUP BY ALL), g AS (SELECT s, sum(n)::DOUBLE AS size, max(n)::DOUBLE AS top FROM d GROUP BY s), o AS (SELECT count(*) AS groups, greatest(0, 1 - stddev_pop(size) / avg(size)) AS balance, avg(top / size) AS purity FROM g) SELECT groups, round(balance, 6) AS balance, round(purity, 6) AS purity, round((balance + purity) / 2, 6) AS score FROM o",
    "dominant_languages": "SELECT source, lang, members FROM (SELECT source, lang, members, row_number() OVER (PARTITION BY source ORDER BY members DESC, lang) AS r FROM (SELECT coalesce(source, '?') AS source, lower(lang) AS lang, count(*) AS members FROM documents WHERE lang IS NOT NULL GROUP BY ALL)) WHERE r = 1",
    "risk_counts": f"""WITH {_UNIT}, c AS (SELECT label, list(x ORDER BY place) AS center FROM (SELECT label, place, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM u) GROUP BY ALL) GROUP BY label),
        w AS (SELECT vec_id, u.label, v, center, count(*) OVER (PARTITION BY u.label) AS size, count(*) OVER (PARTITION BY u.label, vec_id % 7) AS same FROM u JOIN c USING (label)),
        f AS (SELECT label, unnest([CASE WHEN same < size THEN 'mixed_subjects' END, CASE WHEN same = 1 THEN 'singleton_subject' END, CASE WHEN round(list_cosine_similarity(v, center), 6) < 0.45 THEN 'outlier' END, CASE WHEN size NOT BETWEEN 3 AND 60 THEN 'size_exception' END]) AS flag FROM w)
        SELECT label, flag, count(*) AS members FROM f WHERE flag IS NOT NULL GROUP BY ALL""",
    "images_equal": "SELECT sha256_norm, count(DISTINCT image_id) AS images, count(DISTINCT doc_id) AS docs, min(image_id) AS first FROM image_features WHERE sha256_norm IS NOT NULL GROUP BY sha256_norm HAVING count(DISTINCT image_id) > 1",
    "images_near": f"WITH {_NEAR} SELECT query_id, image_id, distance FROM n",
    "image_levels": f"""WITH {_NEAR}, s AS (SELECT DISTINCT query_id, n.image_id, distance, CASE WHEN coalesce(a.doc_id = b.doc_id, false) THEN 0.0 WHEN coalesce(a.sha256_norm = b.sha256_norm, false) THEN 1.0 ELSE 0.6 * (1 - distance / 64.0) END::DOUBLE AS score FROM n JOIN i a ON a.image_id = query_id JOIN i b ON b.image_id = n.image_id)
        SELECT query_id, image_id, distance, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'high' WHEN score >= 0.72 THEN 'medium' WHEN score > 0 THEN 'low' ELSE 'none' END AS level FROM s""",
    "not_indexed": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT text_id FROM docs WHERE text_id IS NOT NULL)",
    "latest_index": "SELECT doc_id, max(indexed_at) AS indexed_at, arg_max(text_id, indexed_at) AS text_id FROM docs GROUP BY doc_id",
    "supplier_pairs": f"WITH {_EDGES} SELECT a, b, weight FROM edges",
    "supplier_hops": f"WITH {_EDGES}, s AS (SELECT src, dst FROM arrows WHERE weight >= 12), h1 AS (SELECT DISTINCT dst AS node FROM s WHERE src = 1), h2 AS (SELECT DISTINCT s.dst AS node FROM s JOIN h1 ON s.src = h1.node) SELECT node, min(hop)::BIGINT AS hop FROM (SELECT 1 AS node, 0 AS hop UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node",
    "supplier_rank": _rank_sql(),
    "part_communities": _labels_sql(LABEL_ROUNDS) + f" SELECT node, label FROM l{LABEL_ROUNDS}",
    "community_sizes": _labels_sql(LABEL_ROUNDS) + f" SELECT label, count(*) AS size, array_to_string(list(node ORDER BY node)[1:8], ',') AS members, row_number() OVER (ORDER BY count(*) DESC, label) AS rank FROM l{LABEL_ROUNDS} GROUP BY label",
    "topic_migration": r"""WITH w AS (SELECT DISTINCT ssxk1[1:3] AS community, regexp_replace(unnest(string_split_regex(gjc, '[;；,，、]')), '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g') AS keyword, TRY_CAST(nullif(regexp_extract(translate(year, '０１２３４５６７８９', '0123456789'), '((19|20)\d{2})', 1), '') AS INT) AS y FROM (SELECT DISTINCT id, ssxk1, gjc, year FROM project_info WHERE ssxk1 IS NOT NULL)),
        b AS (SELECT DISTINCT community, keyword FROM w WHERE keyword <> '' AND y <= 2021), a AS (SELECT DISTINCT community, keyword FROM w WHERE keyword <> '' AND y > 2021),
        s AS (SELECT b.community AS source, a.community AS target, count(*) AS shared FROM b JOIN a USING (keyword) GROUP BY ALL),
        j AS (SELECT source, target, shared, shared::DOUBLE / (nb + na - shared) AS jaccard FROM s JOIN (SELECT community AS source, count(*) AS nb FROM b GROUP BY 1) USING (source) JOIN (SELECT community AS target, count(*) AS na FROM a GROUP BY 1) USING (target)),
        l AS (SELECT CASE WHEN max(jaccard) >= 0.05 THEN 0.05 WHEN max(jaccard) >= 0.005 THEN 0.005 ELSE 0 END AS level FROM j) SELECT source, target, shared, round(jaccard, 6) AS jaccard FROM j, l WHERE jaccard >= level""",
    "topic_panel": f"WITH {_PANEL} SELECT topic, y::BIGINT AS year, applications, funded, round(funding, 2) AS funding, round(requested, 2) AS requested FROM p",
    "topic_baseline": f"WITH {_BASE} SELECT topic, applications, round(funded_ratio, 5) AS funded_ratio, round(avg_award, 5) AS avg_award, round(growth, 5) AS growth, round(recent_share, 5) AS recent_share, round(scale, 5) AS scale FROM base",
    "topic_spans": f"WITH {_PANEL}, a AS (SELECT topic, count(DISTINCT y) AS years FROM p GROUP BY topic) SELECT count(*) FILTER (years = 1) AS single_year, count(*) FILTER (years > 1) AS multi_year, round(avg(years), 6) AS avg_years, max(years) AS max_years FROM a",
    "topic_findings": f"""WITH {_PANEL}, h AS (SELECT topic, coalesce(sum(applications) FILTER (y <= 1994), 0) AS ab, coalesce(sum(applications) FILTER (y > 1994), 0) AS aa, coalesce(sum(funded) FILTER (y <= 1994), 0) AS fb, coalesce(sum(funded) FILTER (y > 1994), 0) AS fa FROM p GROUP BY topic),
        r AS (SELECT *, fa::DOUBLE / nullif(aa, 0) AS ra, fb::DOUBLE / nullif(ab, 0) AS rb FROM h)
        SELECT topic, 'shrinking' AS finding, 'medium' AS severity FROM r WHERE aa < ab UNION ALL SELECT topic, 'growing', 'low' FROM r WHERE aa > ab * 1.1 UNION ALL SELECT topic, 'conversion_drop', 'high' FROM r WHERE ra < rb - 0.02 UNION ALL SELECT topic, 'conversion_gain', 'low' FROM r WHERE ra > rb + 0.02""",
    "shock_effects": f"""WITH {_BASE}, k(id, target, strength, lag) AS (VALUES ('s1', 'NATION_1', 0.2::DOUBLE, 0), ('s2', 'NATION_3', -0.1::DOUBLE, 2), ('s3', NULL, 0.05::DOUBLE, 6)), x AS (SELECT *, strength * greatest(0.35, 1 - 0.15 * lag) AS eff FROM k),
        d AS (SELECT b.topic, eff FROM x JOIN base b ON x.target IS NULL OR x.target = b.topic),
        l AS (SELECT a.topic AS ta, b.topic AS tb, 0.5 * (1 - abs(a.scale - b.scale)) + 0.5 * (1 - abs(a.funded_ratio - b.funded_ratio)) AS lk FROM base a JOIN base b ON a.topic <> b.topic),
        s AS (SELECT tb AS topic, sum(eff * lk * 0.3) AS sp FROM d JOIN l ON d.topic = l.ta WHERE round(lk, 9) >= 0.9 GROUP BY tb), t AS (SELECT topic, sum(eff) AS di FROM d GROUP BY topic)
        SELECT b.topic, round(coalesce(di, 0), 5) AS direct, round(coalesce(sp, 0), 5) AS spillover, round(coalesce(di, 0) + coalesce(sp, 0), 5) AS effect FROM base b LEFT JOIN t USING (topic) LEFT JOIN s USING (topic)""",
    "budget_diff": """WITH i AS (SELECT p_brand, l_returnflag AS f, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS amount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), j AS (SELECT coalesce(a.p_brand, r.p_brand) AS p_brand, coalesce(a.amount, 0) AS l, coalesce(r.amount, 0) AS r FROM (SELECT * FROM i WHERE f = 'A') a FULL JOIN (SELECT * FROM i WHERE f = 'R') r ON a.p_brand = r.p_brand)
        SELECT p_brand, round(l, 2) AS left_amount, round(r, 2) AS right_amount, round(r - l, 2) AS delta, CASE WHEN coalesce(abs(r - l) / nullif(abs(l), 0), CASE WHEN r = l THEN 0 ELSE 1 END) > 0.2 THEN 'RED' WHEN coalesce(abs(r - l) / nullif(abs(l), 0), CASE WHEN r = l THEN 0 ELSE 1 END) > 0.01 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM j""",
    "largest_lines": "SELECT l_orderkey, l_returnflag, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL",
    "total_conflicts": "SELECT o_orderkey, round(o_totalprice, 2) AS total, round(d::DOUBLE, 2) AS details, round((d - o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS delta FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2)) AS d FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey WHERE abs(d - o_totalprice::DECIMAL(18,2)) > 100000",
    "project_latest": r"""WITH r AS (SELECT DISTINCT id, trim(xmmc) AS title, cddw_mc, year FROM project_info WHERE xmmc IS NOT NULL AND trim(xmmc) <> ''), l AS (SELECT title, id, CASE WHEN coalesce(cddw_mc, '') NOT IN ('', '-', '无', '暂无', '待定') AND regexp_matches(year, '^\d{4}$') THEN 0 WHEN regexp_matches(year, '^\d{4}$') THEN 1 ELSE 2 END AS level FROM r)
        SELECT title, id, level::BIGINT AS level FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY level, id) AS k FROM l) WHERE k = 1""",
    "subject_counts": " UNION ALL ".join(f"SELECT id, {i} AS slot, trim(sxxk{i}) AS code FROM expert_info" for i in range(1, 6)).join(("SELECT code, count(DISTINCT id) AS experts, min(slot)::BIGINT AS first_slot FROM (", ") WHERE coalesce(code, '') <> '' GROUP BY code")),
    "expert_matches": "WITH s AS (SELECT DISTINCT id AS eid, code, gzdw FROM (" + " UNION ALL ".join(f"SELECT id, gzdw, trim(sxxk{i}) AS code FROM expert_info" for i in range(1, 6)) + """) WHERE coalesce(code, '') <> ''),
        p AS (SELECT DISTINCT id AS pid, trim(ssxk1) AS code, cddw_mc FROM project_info WHERE ssxk1 IS NOT NULL),
        j AS (SELECT pid, eid, max(CASE WHEN p.code = s.code THEN 1.0 WHEN length(p.code) >= 7 AND length(s.code) >= 7 AND p.code[1:7] = s.code[1:7] THEN 0.9 ELSE 0.55 END)::DOUBLE AS score FROM p JOIN s ON (p.code = s.code OR (length(p.code) >= 5 AND length(s.code) >= 5 AND p.code[1:5] = s.code[1:5])) AND (cddw_mc IS NULL OR gzdw IS NULL OR cddw_mc <> gzdw) GROUP BY ALL)
        SELECT pid AS project_id, eid AS expert_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY score DESC, eid) AS rank FROM j) WHERE rank <= 5""",
    "expert_hits": "WITH h AS (SELECT id, max(" + " + ".join(f"contains(coalesce(yjly, ''), '{c}')::BIGINT" for c in sorted(set("光伏薄膜检测"))) + ")::BIGINT AS hits FROM expert_info GROUP BY id) SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) AS rank FROM h WHERE hits > 0 ORDER BY hits DESC, id LIMIT 25",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value_sum FROM events GROUP BY ALL",
    "event_sessions": "WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM m) SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS \"begin\", max(ts) AS finish, count(*) AS n FROM s GROUP BY ALL",
}
