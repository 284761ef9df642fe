"""The queries of this subpackage, by name; __spark_entry__.py adds them where the subpackage is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.components import connected_groups, similarity_links
from foliant.llm.confusables import not_plain, values_of
from foliant.llm.increment import repeated_texts
from foliant.llm.leakage import leaked_items, leaked_spans
from foliant.llm.mixing import mixture
from foliant.llm.names import named_units, variant_pairs
from foliant.llm.neighbours import similar_vectors
from foliant.llm.pieces import split_texts
from foliant.llm.residue import grouped_values, residue_records
from foliant.llm.spans import shared_share, shared_spans


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(_table(spark, folder, "match_segments"))


def p1_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each segment is found elsewhere, all segments included."""
    segments = _table(spark, folder, "match_segments")
    return shared_share(segments, shared_spans(segments)).withColumn("shared_share", F.round("shared_share", 6))


#: Full length of each embedding model's vectors.
MODEL_DIMS = {"visemb-plus-a2": 512, "visemb-plus-a1": 512, "visemb-base-a1": 256}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = similar_vectors(_table(spark, folder, "image_features"), MODEL_DIMS)
    return found.select(F.col("a").alias("image_a"), F.col("b").alias("image_b"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    links = similarity_links(_table(spark, folder, "document_similarity"))
    return connected_groups(links).select(F.col("node").alias("doc_id"), "group_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    values = grouped_values({"text": (_table(spark, folder, "match_segments"), "match_id", "doc_a"), "xmjj": (_table(spark, folder, "project_info"), "id", "cddw_mc")})
    return residue_records(values).select("field_name", "record_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    values = values_of({"gzdw": (_table(spark, folder, "expert_info"), "id"), "cddw_mc": (_table(spark, folder, "project_info"), "id")})
    return named_units(values, _table(spark, folder, "work_unit"))


def p5_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling that is a variant of another, registered or not, with its group."""
    values = values_of({"gzdw": (_table(spark, folder, "expert_info"), "id"), "cddw_mc": (_table(spark, folder, "project_info"), "id")})
    return connected_groups(variant_pairs(values)).select(F.col("node").alias("spelling"), F.col("group_id").alias("group_spelling"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_texts(_table(spark, folder, "documents")).select("dup_of", "doc_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_plain(values_of({"xmmc": (_table(spark, folder, "project_info"), "id"), "gzdw": (_table(spark, folder, "expert_info"), "id")}))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where in the documents test items leak, and the longest match of each place."""
    return leaked_spans(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(_table(spark, folder, "documents"), _table(spark, folder, "source_weights"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(_table(spark, folder, "documents"), _table(spark, folder, "source_weights"))[1]


def p10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(_table(spark, folder, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_share": p1_share,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_variants": p5_variants,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_pieces": p10_pieces,
}

# SQL can't express what the other problems need: compatibility forms, decoded vectors, trained models, spellings. Their
# operators are tested against plain versions.

_SPANS = """s AS (SELECT DISTINCT match_id, doc_a, text FROM match_segments WHERE length(text) >= 60),
        w AS (SELECT match_id, doc_a, i, substr(text, i + 1, 60) AS g FROM (SELECT match_id, doc_a, text, unnest(range(0, length(text) - 59)) AS i FROM s)),
        h AS (SELECT g FROM w GROUP BY g HAVING count(DISTINCT doc_a) > 1), f AS (SELECT match_id, i FROM w SEMI JOIN h USING (g)),
        m AS (SELECT match_id, i, i - lag(i) OVER (PARTITION BY match_id ORDER BY i) AS step FROM f),
        n AS (SELECT match_id, i, sum(CASE WHEN step <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY match_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m),
        spans AS (SELECT match_id, min(i)::BIGINT AS span_start, max(i)::BIGINT + 60 AS span_end FROM n GROUP BY match_id, run)"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH {_SPANS} SELECT * FROM spans",
    "p1_share": f"""WITH {_SPANS}, sizes AS (SELECT match_id, max(coalesce(length(text), 0))::BIGINT AS n_chars FROM match_segments WHERE match_id IS NOT NULL GROUP BY match_id),
        sums AS (SELECT match_id, sum(span_end - span_start)::BIGINT AS shared_chars FROM spans GROUP BY match_id)
        SELECT match_id, n_chars, coalesce(shared_chars, 0) AS shared_chars, round(coalesce(shared_chars, 0)::DOUBLE / nullif(n_chars, 0), 6) AS shared_share FROM sizes LEFT JOIN sums USING (match_id)""",
    "p3_found": """WITH RECURSIVE v AS (SELECT doc_a AS a, doc_b AS b, CASE WHEN similarity > 1 THEN similarity / 100 ELSE similarity END AS s FROM document_similarity WHERE doc_a <> doc_b AND similarity IS NOT NULL AND NOT isnan(similarity)),
        e AS (SELECT DISTINCT a, b FROM v WHERE s >= 0.5), arrows AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(node, met) AS (SELECT a, a FROM arrows UNION SELECT r.node, arrows.b FROM r JOIN arrows ON r.met = arrows.a)
        SELECT node AS doc_id, min(met) AS group_id FROM r GROUP BY node""",
}
