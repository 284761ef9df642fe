"""Queries over the fields of projects, experts, units and documents: scans, joins with dimensions, derived fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import images, matching, passages
from foliant.plans.tables import table

CODES = ("410", "460", "520", "560")
SPACES = r"[\s\x{00A0}\x{3000}]"


def _projects(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "project_info").select("id", *columns).distinct()


def _experts(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "expert_info").select("id", *columns).distinct()


# --- scans and dimensions --------------------------------------------------------------------------------------------
def projects_by_code(spark: SparkSession, folder: str) -> DataFrame:
    """Projects of some fields with their unit's dimension row, where it is registered."""
    units = table(spark, folder, "work_unit").select(F.col("unit_name").alias("cddw_mc"), "unit_id", "unit_kind")
    rows = _projects(spark, folder, "xmmc", "ssxk1", "cddw_mc").where(F.substring("ssxk1", 1, 3).isin(*CODES))
    return rows.join(units, "cddw_mc", "left").select("id", "xmmc", "ssxk1", "cddw_mc", "unit_id", "unit_kind")


def projects_registered(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a condition on the dimension, which makes the left join an inner one."""
    return projects_by_code(spark, folder).where("unit_kind is not null").select("id", "unit_id")


def first_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The first 50 projects by id with a usable brief (a top-k report)."""
    rows = _projects(spark, folder, "xmjj").where(T.effective(F.col("xmjj")) != "").groupBy("id").agg(F.max(F.length("xmjj")).cast("long").alias("chars"))
    return rows.orderBy("id").limit(50)


def project_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Of asked ids, whether there is such a project, and how many rows it has."""
    asked = table(spark, folder, "project_info").select("id").where("id is not null").distinct().where(F.substring("id", -2, 2) == "00").union(spark.createDataFrame([("missing",)], "id string"))
    rows = table(spark, folder, "project_info").select("id", F.lit(1).alias("one"))
    return asked.join(rows, "id", "left").groupBy("id").agg(F.count("one").alias("rows"), (F.count("one") > 0).alias("found"))


def unit_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Registered units with how many experts and projects name them as they are."""
    count = lambda rows, c, name: rows.groupBy(F.col(c).alias("unit_name")).agg(F.countDistinct("id").alias(name))
    units = table(spark, folder, "work_unit")
    out = units.join(count(_experts(spark, folder, "gzdw"), "gzdw", "experts"), "unit_name", "left").join(count(_projects(spark, folder, "cddw_mc"), "cddw_mc", "projects"), "unit_name", "left")
    return out.select("unit_id", "unit_name", "city", F.coalesce("experts", F.lit(0)).alias("experts"), F.coalesce("projects", F.lit(0)).alias("projects"))


def files_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the files indexed for it at their own time: a left join on two keys."""
    d = table(spark, folder, "documents").select("doc_id", "file_mtime")
    f = table(spark, folder, "docs").select(F.col("text_id").alias("doc_id"), "file_mtime", F.col("doc_id").alias("file")).distinct()
    return d.join(f, ["doc_id", "file_mtime"], "left").groupBy("doc_id").agg(F.count("file").alias("files"), F.min("file").alias("first_file"))


def typed_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Files, projects and experts as one table of targets by type, with what each type calls its title."""
    parts = [
        table(spark, folder, "docs").select(F.lit("file").alias("kind"), F.col("doc_id").alias("key"), F.col("path").alias("title")),
        _projects(spark, folder, "xmmc").select(F.lit("project"), "id", "xmmc"),
        _experts(spark, folder, "xm").select(F.lit("expert"), "id", "xm"),
    ]
    out = parts[0].union(parts[1]).union(parts[2]).where("key is not null").distinct()
    return out.groupBy("kind").agg(F.count("*").alias("targets"), F.count_if(T.effective(F.col("title")) == "").alias("untitled"), F.countDistinct("key").alias("keys"))


def unit_cities(spark: SparkSession, folder: str) -> DataFrame:
    """Projects whose unit isn't registered, with the smallest registered city its name contains: a join on containment, by
    the characters a city begins with."""
    names = _projects(spark, folder, "cddw_mc").where("cddw_mc is not null").select("cddw_mc").distinct()
    units = table(spark, folder, "work_unit")
    open_ = names.join(units.select(F.col("unit_name").alias("cddw_mc")), "cddw_mc", "left_anti")
    cities = units.select("city").where("length(city) >= 2").distinct().withColumn("two", F.substring("city", 1, 2))
    pairs = open_.select("cddw_mc", F.explode(F.array_distinct(T.gram_list(F.col("cddw_mc"), 2))).alias("two")).join(cities, "two").where(F.contains("cddw_mc", "city"))
    return pairs.groupBy("cddw_mc").agg(F.min("city").alias("city"), F.countDistinct("city").alias("cities"))


def missing_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What each project lacks of what is required."""
    need = {"title": "xmmc", "keywords": "gjc", "subject": "ssxk1", "brief": "xmjj", "unit": "cddw_mc"}
    rows = _projects(spark, folder, *need.values())
    present = F.array_compact(F.array(*(F.when(T.effective(F.col(c)) != "", name) for name, c in need.items())))
    lacking = F.array_except(F.array(*map(F.lit, sorted(need))), present)
    return rows.select("id", F.concat_ws(",", F.array_sort(lacking)).alias("missing")).where("missing <> ''").distinct()


def images_same(spark: SparkSession, folder: str) -> DataFrame:
    """Images of other documents with the content of each asked one."""
    rows = table(spark, folder, "image_features").select("image_id", "doc_id", "sha256_norm").distinct()
    return images.same_content(rows, rows.where(F.substring("image_id", -1, 1) == "0"))


# --- derived fields --------------------------------------------------------------------------------------------------
def weighted_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text that stands for a project: subject three times, keywords five times, title, 200 characters of the brief."""
    rows = _projects(spark, folder, "xmmc", "gjc", "ssxk1", "xmjj")
    text = T.weighted_text([(F.col("ssxk1"), 3), (F.col("gjc"), 5), (F.col("xmmc"), 1), (F.substring(T.effective(F.col("xmjj")), 1, 200), 1)])
    return rows.select("id", text.alias("text")).distinct()


ALIASES = {"设备费用": "设备费", "仪器设备费": "设备费", "测试加工费": "测试费", "人工费": "劳务费"}


def canonical_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Keywords in canonical form: how many spellings and projects each has."""
    words = _projects(spark, folder, "gjc").select("id", F.explode(T.keywords(F.col("gjc"))).alias("k"))
    return words.select("id", "k", T.canonical(F.col("k"), ALIASES).alias("keyword")).groupBy("keyword").agg(F.countDistinct("k").alias("spellings"), F.countDistinct("id").alias("projects"))


QUANTITY = r"(\d+(?:\.\d+)?(?:%|个|项|台|天|例|吨|公斤|毫米|万元|小时|批次|亩|倍))"


def split_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with several quantities, a row for each quantity."""
    lines = passages.lines(table(spark, folder, "documents"))
    found = lines.select("doc_id", "line_no", F.regexp_extract_all("line", F.lit(QUANTITY), F.lit(1)).alias("q")).where("size(q) > 1")
    each = found.select("doc_id", "line_no", F.posexplode("q").alias("part", "quantity"))
    return each.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("line_no", "part")), F.regexp_extract("quantity", r"^([\d.]+)", 1).cast("double").alias("value"), F.regexp_extract("quantity", r"([^\d.]+)$", 1).alias("unit"))


def repaired_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null")
    return rows.select("doc_id", T.repaired(F.col("text")).alias("t")).select("doc_id", F.length("t").cast("long").alias("chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def phrase_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Key phrases of project briefs that segments of other texts hold, most covered first: for each brief the best segment by
    the share of its phrases."""
    briefs = _projects(spark, folder, "xmjj").select("id", T.key_phrases(F.coalesce("xmjj", F.lit(""))).alias("phrases")).where("size(phrases) > 0").distinct()
    asked = briefs.select("id", F.size("phrases").alias("of"), F.explode("phrases").alias("phrase"))
    segments = table(spark, folder, "match_segments").where("text is not null").select(F.col("match_id").alias("key"), "text").distinct()
    hit = asked.join(matching.contained(asked, segments), "phrase").select("id", F.col("key").alias("match_id"), "phrase", "of").distinct()
    shares = hit.groupBy("id", "match_id", "of").agg(F.count("*").alias("n")).select("id", "match_id", (F.col("n") / F.col("of")).alias("share"))
    best = shares.groupBy("id").agg(F.max_by("match_id", F.struct("share", -F.col("match_id"))).alias("match_id"), F.max("share").alias("share"))
    return best.select("id", "match_id", F.round("share", 6).alias("share"))


def unit_word_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _experts(spark, folder, "gzdw").where("gzdw is not null")
    return rows.select("id", F.explode(T.unit_words(F.col("gzdw"))).alias("word")).groupBy("word").agg(F.countDistinct("id").alias("experts"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The tokens under which segments are found as passages: how many each has, and how many distinct there are of a word."""
    rows = table(spark, folder, "match_segments").where("text is not null").select("match_id", "text").distinct()
    tokens = rows.select("match_id", T.passage_tokens(F.col("text"), 1_000_000).alias("tokens"))
    return tokens.select("match_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.countDistinct("match_id").alias("segments"))


def title_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Terms of titles as questions: years and parts of runs of ideographs."""
    rows = _projects(spark, folder, "xmmc").where("xmmc is not null")
    return rows.select("id", F.explode(T.question_terms(F.col("xmmc"))).alias("term")).groupBy("term").agg(F.countDistinct("id").alias("projects"))


def simple_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that are one after simplification, and their key as a topic."""
    rows = _projects(spark, folder, "xmmc").where("xmmc is not null").select("id", T.simple_title(F.col("xmmc")).alias("title"), T.topic_key(F.col("xmmc")).alias("topic"))
    return rows.groupBy("title").agg(F.countDistinct("id").alias("projects"), F.countDistinct("topic").alias("topics"), F.min("topic").alias("first_topic"))


def order_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Periods written out, from the month of each order to that of its last shipping, read back: months, and dates named."""
    last = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderdate").join(last, "o_orderkey").where("shipped >= o_orderdate")
    said = F.format_string("执行期：%d年%d月至%d年%d月。", *(f(c) for c in ("o_orderdate", "shipped") for f in (F.year, F.month)))
    texts = rows.select("o_orderkey", said.alias("text"))
    return texts.select("o_orderkey", T.period_months(F.col("text")).cast("long").alias("months"), F.concat_ws(",", T.milestones(F.col("text"))).alias("dates"))


def order_ages(spark: SparkSession, folder: str) -> DataFrame:
    """Lines by whole years between order and shipping, whichever came first, and by tens of their quantity."""
    rows = table(spark, folder, "orders").join(table(spark, folder, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    a, b = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    age = F.floor(T.years_between(F.least(a, b), F.greatest(a, b)))
    return rows.select(age.cast("long").alias("years"), T.tens(F.col("l_quantity")).cast("long").alias("quantity_tens")).groupBy("years", "quantity_tens").agg(F.count("*").alias("lines"))


def table_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Table rows as fields: each key with the value beside it, the first of a key in a row."""
    cells = passages.table_rows(table(spark, folder, "documents"))
    rows = cells.groupBy("doc_id", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "cell"))), lambda c: c["cell"]).alias("cells"))
    fields = rows.select("doc_id", "row_no", F.explode(T.row_fields(F.col("cells"))).alias("key", "value"))
    return fields.groupBy("key").agg(F.count("*").alias("rows"), F.countDistinct("value").alias("values"), F.min("value").alias("first_value"))


def event_fields(spark: SparkSession, folder: str) -> DataFrame:
    """JSON of events read safely: what isn't an object gives null; objects in fences are found."""
    wrapped = F.concat(F.lit("```json\n"), F.coalesce("props", F.lit("")), F.lit("\n```"))
    rows = table(spark, folder, "events").select("event_type", F.from_json(T.fenced_object(wrapped), "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count("p.k").alias("with_k"), F.sum("p.k").alias("k_sum"))


def valid_contacts(spark: SparkSession, folder: str) -> DataFrame:
    """Contacts derived from ids, checked: mail, phone, identity number (every order number padded to 17 digits, with each check)."""
    o = table(spark, folder, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 17, "1").alias("base"))
    each = o.select("o_orderkey", "base", F.explode(F.split(F.lit("0,1,2,X"), ",")).alias("c"))
    checked = each.select("c", T.valid_identity(F.concat("base", "c")).cast("int").alias("identity"), T.valid_phone(F.concat(F.lit("13"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))).cast("int").alias("phone"), T.valid_mail(F.concat(F.lit("u"), F.col("c"), F.when(F.col("o_orderkey") % 2 == 0, "@a.example").otherwise("@a"))).cast("int").alias("mail"))
    return checked.groupBy("c").agg(*(F.sum(c).cast("long").alias(c) for c in ("identity", "phone", "mail")))


# --- statistics ------------------------------------------------------------------------------------------------------
def score_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Mean, median, deviation, extremes and tens of segment similarities, by match type."""
    rows = table(spark, folder, "match_segments").select("match_id", F.coalesce("match_type", F.lit("?")).alias("kind"), (F.col("similarity_score") * 100).alias("s")).distinct().where("s is not null and not isnan(s)")
    stats = rows.groupBy("kind").agg(F.count("*").alias("n"), *(F.round(f("s"), 6).alias(name) for name, f in (("mean", F.avg), ("median", F.median), ("deviation", F.stddev_pop), ("low", F.min), ("high", F.max))))
    tens = rows.groupBy("kind", T.tens(F.col("s")).alias("t")).agg(F.count("*").alias("c")).groupBy("kind").agg(F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("t").cast("string"), 3, "0"), F.col("c").cast("string")))).alias("h"))
    return stats.join(tens, "kind").select("kind", "n", "mean", "median", "deviation", "low", "high", F.concat_ws(",", "h").alias("tens"))


def subject_histograms(spark: SparkSession, folder: str) -> DataFrame:
    """Second subjects within each first subject, as a map in order of its keys."""
    rows = _projects(spark, folder, "ssxk1", "ssxk2").where("ssxk1 is not null")
    counted = rows.groupBy(F.substring("ssxk1", 1, 3).alias("subject"), F.coalesce(F.substring("ssxk2", 1, 3), F.lit("?")).alias("second")).agg(F.count("*").alias("n"))
    return counted.groupBy("subject").agg(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws("=", "second", F.col("n").cast("string"))))).alias("seconds"), F.sum("n").alias("projects"))


def weighted_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Weighted score of each order over its lines (weight: quantity), its confidence (mean weight), grade; an order without
    lines has 5."""
    l = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_discount") * 100).alias("s"), F.col("l_quantity").cast("double").alias("w"))
    sums = l.groupBy("o_orderkey").agg(F.sum(F.col("s") * F.col("w")).alias("sw"), F.sum("w").alias("w"), F.avg("w").alias("confidence"))
    out = table(spark, folder, "orders").select("o_orderkey").join(sums, "o_orderkey", "left").withColumn("score", F.round(F.coalesce(F.try_divide("sw", "w"), F.lit(5.0)) + 1e-9, 2))
    return out.select("o_orderkey", "score", F.round("confidence", 6).alias("confidence"), T.grade(F.col("score")).alias("grade"))


def grade_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All five grades with how many orders have them, present or not, and the mean and median score of each."""
    spine = spark.createDataFrame([(g,) for g in "ABCDE"], "grade string")
    have = weighted_scores(spark, folder).groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.median("score"), 6).alias("median"))
    return spine.join(have, "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("orders"), "mean", "median")


def match_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """How far experts cover projects: distinct experts, mean score, projects covered."""
    from foliant.plans.data_plans import expert_matches

    m = expert_matches(spark, folder)
    total = table(spark, folder, "project_info").select(F.countDistinct("id").alias("projects"))
    got = m.agg(F.countDistinct("expert_id").alias("experts"), F.round(F.avg("score"), 6).alias("avg_score"), F.countDistinct("project_id").alias("covered"))
    return got.crossJoin(F.broadcast(total)).select("experts", "avg_score", "covered", "projects", F.round(F.try_divide(F.col("covered").cast("double"), F.col("projects")), 6).alias("coverage"))


def pair_status(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of file pairs by type and state, most frequent first: what dominates, and its share."""
    rows = table(spark, folder, "document_similarity").distinct()
    value = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.col("similarity"))
    state = F.when(F.col("doc_b").isNull(), "open").when(value.isNull() | F.isnan(value) | (value < 0), "failed").when(value >= 0.5, "similar").otherwise("different")
    counted = rows.groupBy(F.coalesce("type", F.lit("?")).alias("type"), state.alias("state")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("type").orderBy(F.desc("n"), "state")
    return counted.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("type")), 6))


def best_segment_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """The best match of each document and source, and the three best sources of each document."""
    rows = table(spark, folder, "match_segments").where("doc_a is not null and source_doc is not null and not isnan(similarity_score)").select("match_id", "doc_a", "source_doc", "similarity_score", "ngram_count").distinct()
    best = rows.groupBy("doc_a", "source_doc").agg(F.max_by(F.struct("match_id", "similarity_score"), F.struct("similarity_score", F.coalesce("ngram_count", F.lit(-1)), -F.col("match_id"))).alias("b")).select("doc_a", "source_doc", "b.*")
    order = Window.partitionBy("doc_a").orderBy(F.desc("similarity_score"), "source_doc")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where("rank <= 3")


def common_grams(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of eight characters that all segments of a document have in common (documents with two segments or more)."""
    rows = table(spark, folder, "match_segments").where("doc_a is not null and text is not null").select("doc_a", "match_id", "text").distinct()
    sizes = rows.groupBy("doc_a").agg(F.countDistinct("match_id").alias("of")).where(F.col("of") > 1)
    grams = rows.select("doc_a", "match_id", F.explode(F.array_distinct(T.gram_list(F.col("text"), 8))).alias("g"))
    shared = grams.groupBy("doc_a", "g").agg(F.countDistinct("match_id").alias("n")).join(sizes, "doc_a").where("n = of")
    return shared.groupBy("doc_a", F.col("of").alias("segments")).agg(F.count("*").alias("common"))


def rare_grams(spark: SparkSession, folder: str) -> DataFrame:
    """Of each quarter of an asked document the 40 rarest grams (the selection's own budget), and how rare they are."""
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", T.squeeze(F.col("text")).alias("t")).where("length(t) >= 4")
    asked = docs.where("doc_id % 100 = 0").select("doc_id", F.length("t").alias("size"), F.posexplode(T.gram_list(F.col("t"), 4)).alias("pos", "gram"))
    first = asked.groupBy("doc_id", "gram").agg(F.min("pos").alias("pos"), F.first("size").alias("size"))
    every = docs.select("doc_id", F.explode(T.grams(F.col("t"), 4)).alias("gram")).join(first.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    placed = first.join(every, "gram").withColumn("quarter", F.floor(F.col("pos") * 4 / (F.col("size") - 3)).cast("long"))
    order = Window.partitionBy("doc_id", "quarter").orderBy("df", "gram")
    few = placed.withColumn("r", F.row_number().over(order)).where("r <= 40")
    return few.groupBy("doc_id", "quarter").agg(F.count("*").alias("grams"), F.max("df").alias("highest_df"), F.min("df").alias("lowest_df"))


QUERIES = {f.__name__: f for f in (
    projects_by_code, projects_registered, first_projects, project_lookup, unit_dimension, files_of_documents, typed_targets, unit_cities, missing_fields, images_same,
    weighted_texts, canonical_keywords, split_metrics, repaired_texts, phrase_matches, unit_word_counts, token_counts, title_terms, simple_titles, order_periods, order_ages, table_fields, event_fields, valid_contacts,
    score_statistics, subject_histograms, weighted_scores, grade_summary, match_statistics, pair_status, best_segment_by_source, common_grams, rare_grams,
)}


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def _effective(c: str) -> str:
    words = ", ".join(f"'{w}'" for w in T.DUMMY)
    plain = _strip(f"coalesce({c}, '')")
    return f"CASE WHEN lower({plain}) IN ({words}) THEN '' ELSE {plain} END"


_KEYWORDS = f"list_filter(list_transform(string_split_regex(gjc, '[;；,，、]'), lambda x: {_strip('x')}), lambda x: x <> '')"
_BY_CODE = "p AS (SELECT DISTINCT id, xmmc, ssxk1, cddw_mc FROM project_info WHERE ssxk1[1:3] IN ('410', '460', '520', '560')), j AS (SELECT p.*, unit_id, unit_kind FROM p LEFT JOIN work_unit ON unit_name = cddw_mc)"
_ALIAS = "CASE k WHEN " + " WHEN ".join(f"'{a}' THEN '{b}'" for a, b in ALIASES.items()) + " ELSE k END"
_SCORES = """l AS (SELECT l_orderkey, sum(l_discount * 100 * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE) AS s, avg(l_quantity::DOUBLE) AS c FROM lineitem GROUP BY l_orderkey),
        w AS (SELECT o_orderkey, round(coalesce(s, 5.0) + 1e-9, 2) AS score, round(c, 6) AS confidence FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        g AS (SELECT *, CASE WHEN score >= 9 THEN 'A' WHEN score >= 8 THEN 'B' WHEN score >= 6 THEN 'C' WHEN score >= 4 THEN 'D' ELSE 'E' END AS grade FROM w)"""
_RUNS = lambda n: f"list_transform(range(1, greatest(length(t) - {n - 2}, 1)), lambda i: substr(t, i, {n}))"

ORACLES = {
    "projects_by_code": f"WITH {_BY_CODE} SELECT id, xmmc, ssxk1, cddw_mc, unit_id, unit_kind FROM j",
    "projects_registered": f"WITH {_BY_CODE} SELECT id, unit_id FROM j WHERE unit_kind IS NOT NULL",
    "first_projects": f"SELECT id, max(length(xmjj))::BIGINT AS chars FROM project_info WHERE {_effective('xmjj')} <> '' GROUP BY id ORDER BY id LIMIT 50",
    "project_lookup": "WITH a AS (SELECT DISTINCT id FROM project_info WHERE right(id, 2) = '00' UNION ALL SELECT 'missing') SELECT a.id, count(p.id) AS rows, count(p.id) > 0 AS found FROM a LEFT JOIN project_info p ON p.id = a.id GROUP BY a.id",
    "unit_dimension": "SELECT unit_id, unit_name, city, (SELECT count(DISTINCT id) FROM expert_info WHERE gzdw = unit_name) AS experts, (SELECT count(DISTINCT id) FROM project_info WHERE cddw_mc = unit_name) AS projects FROM work_unit",
    "files_of_documents": "SELECT d.doc_id, count(f.doc_id) AS files, min(f.doc_id) AS first_file FROM documents d LEFT JOIN (SELECT DISTINCT text_id, file_mtime, doc_id FROM docs) f ON f.text_id = d.doc_id AND f.file_mtime = d.file_mtime GROUP BY d.doc_id",
    "typed_targets": f"SELECT kind, count(*) AS targets, count(*) FILTER ({_effective('title')} = '') AS untitled, count(DISTINCT key) AS keys FROM (SELECT DISTINCT * FROM (SELECT 'file' AS kind, doc_id AS key, path AS title FROM docs UNION ALL SELECT 'project', id, xmmc FROM project_info UNION ALL SELECT 'expert', id, xm FROM expert_info) WHERE key IS NOT NULL) GROUP BY kind",
    "unit_cities": "WITH n AS (SELECT DISTINCT cddw_mc FROM project_info WHERE cddw_mc IS NOT NULL AND cddw_mc NOT IN (SELECT unit_name FROM work_unit)), c AS (SELECT DISTINCT city FROM work_unit WHERE length(city) >= 2) SELECT cddw_mc, min(city) AS city, count(DISTINCT city) AS cities FROM n JOIN c ON contains(cddw_mc, city) GROUP BY cddw_mc",
    "missing_fields": "SELECT DISTINCT id, missing FROM (SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN {_effective(c)} = '' THEN '{n}' END" for n, c in (("brief", "xmjj"), ("keywords", "gjc"), ("subject", "ssxk1"), ("title", "xmmc"), ("unit", "cddw_mc"))) + ") AS missing FROM project_info) WHERE missing <> ''",
    "images_same": "WITH i AS (SELECT DISTINCT image_id, doc_id, sha256_norm FROM image_features) SELECT DISTINCT q.image_id AS query_id, o.image_id FROM i q JOIN i o ON q.sha256_norm = o.sha256_norm AND right(q.image_id, 1) = '0' AND q.image_id <> o.image_id AND q.doc_id IS DISTINCT FROM o.doc_id",
    "weighted_texts": f"WITH e AS (SELECT DISTINCT id, nullif({_effective('ssxk1')}, '') AS s, nullif({_effective('gjc')}, '') AS g, nullif({_effective('xmmc')}, '') AS t, nullif({_effective('substr(' + _effective('xmjj') + ', 1, 200)')}, '') AS b FROM project_info) SELECT DISTINCT id, concat_ws(' ', s, s, s, g, g, g, g, g, t, b) AS text FROM e",
    "canonical_keywords": f"WITH w AS (SELECT id, unnest({_KEYWORDS}) AS raw FROM (SELECT DISTINCT id, gjc FROM project_info WHERE gjc IS NOT NULL)), c AS (SELECT id, raw, regexp_replace(regexp_replace(raw, '{T.NUMBERING}', ''), '{SPACES}+', '', 'g') AS k FROM w) SELECT {_ALIAS} AS keyword, count(DISTINCT raw) AS spellings, count(DISTINCT id) AS projects FROM c GROUP BY 1",
    "split_metrics": rf"""WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS line, (generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1)::BIGINT AS line_no FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, line_no, regexp_extract_all(line, '{QUANTITY}', 1) AS q FROM l),
        e AS (SELECT doc_id, line_no, (generate_subscripts(q, 1) - 1)::BIGINT AS part, unnest(q) AS x FROM q WHERE len(q) > 1) SELECT doc_id, line_no, part, regexp_extract(x, '^([\d.]+)', 1)::DOUBLE AS value, regexp_extract(x, '([^\d.]+)$', 1) AS unit FROM e""",
    "repaired_texts": r"""SELECT doc_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([A-Za-z])-\r?\n([a-z])', '\1\2', 'g'), '[ \t]+(\r?\n)', '\1', 'g'), '(\r?\n){3,}', chr(10) || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)""",
    "phrase_matches": rf"""WITH b AS (SELECT DISTINCT id, list_filter(list_transform(string_split_regex(coalesce(xmjj, ''), '[；;。\r\n]'), lambda x: {_strip('x')}), lambda x: length(x) >= 6)[1:6] AS phrases FROM project_info),
        a AS (SELECT DISTINCT id, len(phrases) AS n, unnest(phrases) AS phrase FROM b WHERE len(phrases) > 0), s AS (SELECT DISTINCT match_id, text FROM match_segments WHERE text IS NOT NULL),
        h AS (SELECT DISTINCT id, n, match_id, phrase FROM a JOIN s ON contains(text, phrase)), c AS (SELECT id, match_id, count(*)::DOUBLE / n AS share FROM h GROUP BY id, match_id, n)
        SELECT id, match_id, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY share DESC, match_id) AS r FROM c) WHERE r = 1""",
    "unit_word_counts": r"SELECT word, count(DISTINCT id) AS experts FROM (SELECT id, unnest(string_split_regex(gzdw, '[()（）\s,，、\-]|股份有限公司|有限责任公司|有限公司|集团')) AS word FROM expert_info WHERE gzdw IS NOT NULL) WHERE length(word) >= 2 GROUP BY word",
    "token_counts": rf"""WITH s AS (SELECT DISTINCT match_id, text AS t FROM match_segments WHERE text IS NOT NULL), w AS (SELECT match_id, unnest(string_split_regex(lower(t), '[\s\x{{3000}}，。；：、！？,.;:!?()（）\[\]【】|/]+')) AS token FROM s UNION ALL SELECT match_id, unnest({_RUNS(2)}) FROM s)
        SELECT token, count(DISTINCT match_id) AS segments FROM (SELECT match_id, token FROM w WHERE token <> '' AND (length(token) <> 2 OR regexp_matches(token, '^[一-鿿]{{2}}$') OR (match_id, token) IN (SELECT match_id, unnest(string_split_regex(lower(t), '[\s\x{{3000}}，。；：、！？,.;:!?()（）\[\]【】|/]+')) FROM s))) GROUP BY token""",
    "title_terms": rf"""WITH s AS (SELECT DISTINCT id, xmmc AS t FROM project_info WHERE xmmc IS NOT NULL), w AS (SELECT id, unnest(regexp_extract_all(t, '((?:19|20)\d{{2}})', 1)) AS term FROM s UNION ALL SELECT id, unnest(regexp_extract_all(t, '([一-鿿]{{2,}})', 1)) FROM s
        UNION ALL SELECT id, x FROM (SELECT id, unnest({_RUNS(4)}) AS x FROM s) WHERE regexp_full_match(x, '[一-鿿]{{4}}') UNION ALL SELECT id, x FROM (SELECT id, unnest({_RUNS(3)}) AS x FROM s) WHERE regexp_full_match(x, '[一-鿿]{{3}}') UNION ALL SELECT id, x FROM (SELECT id, unnest({_RUNS(2)}) AS x FROM s) WHERE regexp_full_match(x, '[一-鿿]{{2}}'))
        SELECT term, count(DISTINCT id) AS projects FROM w GROUP BY term""",
    "simple_titles": r"""WITH r AS (SELECT DISTINCT id, regexp_replace(regexp_replace(lower(regexp_replace(xmmc, '[^\p{L}\p{N}]', '', 'g')), '^(关于|基于|面向)', ''), '(的研究|研究|的应用|应用)$', '') AS title, lower(regexp_replace(regexp_replace(xmmc, '[:：(（].*$', ''), '[\s\x{3000}_\-·]+', '', 'g')) AS topic FROM project_info WHERE xmmc IS NOT NULL)
        SELECT title, count(DISTINCT id) AS projects, count(DISTINCT topic) AS topics, min(topic) AS first_topic FROM r GROUP BY title""",
    "order_periods": """WITH r AS (SELECT o_orderkey, o_orderdate AS a, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey) AS b FROM orders)
        SELECT o_orderkey, ((year(b) - year(a)) * 12 + month(b) - month(a) + 1)::BIGINT AS months, CASE WHEN strftime(a, '%Y-%m') = strftime(b, '%Y-%m') THEN strftime(a, '%Y-%m') ELSE strftime(a, '%Y-%m') || ',' || strftime(b, '%Y-%m') END AS dates FROM r WHERE b >= a""",
    "order_ages": "SELECT floor(datesub('month', least(o_orderdate::DATE, l_shipdate::DATE), greatest(o_orderdate::DATE, l_shipdate::DATE)) / 12.0)::BIGINT AS years, (floor(l_quantity / 10) * 10)::BIGINT AS quantity_tens, count(*) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL",
    "table_fields": rf"""WITH found AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\[表格行\d+\][^\r\n\[]*')) AS row FROM documents WHERE text IS NOT NULL),
        parts AS (SELECT DISTINCT doc_id, regexp_extract(row, '\[表格行(\d+)\]', 1)::BIGINT AS row_no, string_split(regexp_replace(row, '^\[表格行\d+\]', ''), '|') AS cells FROM found),
        c AS (SELECT DISTINCT doc_id, row_no, unnest(range(0, len(cells))) AS no, {_strip('unnest(cells)')} AS cell FROM parts), o AS (SELECT doc_id, row_no, list(cell ORDER BY no, cell) AS cells FROM c GROUP BY ALL),
        f AS (SELECT doc_id, row_no, unnest(range(0, len(cells) // 2)) AS i, cells FROM o), k AS (SELECT doc_id, row_no, cells[2 * i + 1] AS key, arg_min(cells[2 * i + 2], i) AS value FROM f WHERE cells[2 * i + 1] <> '' GROUP BY ALL)
        SELECT key, count(*) AS rows, count(DISTINCT value) AS values, min(value) AS first_value FROM k GROUP BY key""",
    "event_fields": "SELECT event_type, count(*) AS events, count(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS with_k, sum(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY event_type",
    "valid_contacts": """WITH o AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 17, '1') AS b, unnest(['0', '1', '2', 'X']) AS c FROM orders), s AS (SELECT o_orderkey, b, c, list_sum(list_transform(range(1, 18), lambda i: substr(b, i, 1)::INT * ((2 ** (18 - i))::INT % 11))) AS t FROM o)
        SELECT c, count(*) FILTER (substr('10X98765432', (t % 11)::INT + 1, 1) = c) AS identity, count(*) FILTER (regexp_full_match('13' || lpad(o_orderkey::VARCHAR, 9, '0'), '1[3-9][0-9]{9}')) AS phone, count(*) FILTER (o_orderkey % 2 = 0) AS mail FROM s GROUP BY c""",
    "score_statistics": """WITH r AS (SELECT DISTINCT match_id, coalesce(match_type, '?') AS kind, similarity_score * 100 AS s FROM match_segments WHERE similarity_score IS NOT NULL AND NOT isnan(similarity_score)), t AS (SELECT kind, lpad((floor(s / 10) * 10)::INT::VARCHAR, 3, '0') || ':' || count(*) AS h FROM r GROUP BY kind, floor(s / 10)),
        h AS (SELECT kind, string_agg(h, ',' ORDER BY h) AS tens FROM t GROUP BY kind) SELECT r.kind, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(stddev_pop(s), 6) AS deviation, round(min(s), 6) AS low, round(max(s), 6) AS high, any_value(tens) AS tens FROM r JOIN h USING (kind) GROUP BY r.kind""",
    "subject_histograms": "WITH r AS (SELECT ssxk1[1:3] AS subject, coalesce(ssxk2[1:3], '?') AS second, count(*) AS n FROM (SELECT DISTINCT id, ssxk1, ssxk2 FROM project_info WHERE ssxk1 IS NOT NULL) GROUP BY ALL) SELECT subject, string_agg(second || '=' || n, ',' ORDER BY second || '=' || n) AS seconds, sum(n)::BIGINT AS projects FROM r GROUP BY subject",
    "weighted_scores": f"WITH {_SCORES} SELECT o_orderkey, score, confidence, grade FROM g",
    "grade_summary": f"WITH {_SCORES}, h AS (SELECT grade, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median FROM g GROUP BY grade) SELECT s.grade, coalesce(n, 0) AS orders, mean, median FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS grade) s LEFT JOIN h USING (grade)",
    "pair_status": """WITH v AS (SELECT DISTINCT * FROM document_similarity), s AS (SELECT coalesce(type, '?') AS type, doc_b, CASE WHEN similarity > 1 AND NOT isnan(similarity) THEN similarity / 100 ELSE similarity END AS x FROM v), c AS (SELECT type, CASE WHEN doc_b IS NULL THEN 'open' WHEN x IS NULL OR isnan(x) OR x < 0 THEN 'failed' WHEN x >= 0.5 THEN 'similar' ELSE 'different' END AS state, count(*) AS n FROM s GROUP BY ALL)
        SELECT type, state, n, row_number() OVER (PARTITION BY type ORDER BY n DESC, state) AS rank, round(n / sum(n) OVER (PARTITION BY type), 6) AS share FROM c""",
    "best_segment_by_source": """WITH r AS (SELECT DISTINCT match_id, doc_a, source_doc, similarity_score, ngram_count FROM match_segments WHERE doc_a IS NOT NULL AND source_doc IS NOT NULL AND NOT isnan(similarity_score)),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_a, source_doc ORDER BY similarity_score DESC, coalesce(ngram_count, -1) DESC, match_id) AS k FROM r) WHERE k = 1)
        SELECT doc_a, source_doc, match_id, similarity_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_a ORDER BY similarity_score DESC, source_doc) AS rank FROM b) WHERE rank <= 3""",
    "common_grams": """WITH r AS (SELECT DISTINCT doc_a, match_id, text AS t FROM match_segments WHERE doc_a IS NOT NULL AND text IS NOT NULL), s AS (SELECT doc_a, count(DISTINCT match_id) AS n FROM r GROUP BY doc_a HAVING count(DISTINCT match_id) > 1),
        g AS (SELECT doc_a, match_id, unnest(CASE WHEN length(t) >= 8 THEN list_distinct(list_transform(range(1, length(t) - 6), lambda i: substr(t, i, 8))) WHEN length(t) > 0 THEN [t] ELSE [] END) AS g FROM r),
        c AS (SELECT doc_a, g, count(DISTINCT match_id) AS k FROM g GROUP BY ALL) SELECT doc_a, n AS segments, count(*) AS common FROM c JOIN s USING (doc_a) WHERE k = n GROUP BY ALL""",
}
