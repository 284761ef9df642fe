"""Late stages against plain versions on small frames: folds of matches, communities by modularity, linkage, groups."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import graph, grouping, matches

_M = "query_id long, doc_id long, start int, end int, src_start int, src_end int, grams long"


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_merge_on_one_source(spark):
    m = spark.createDataFrame([(1, 2, 0, 50, 100, 150, 5), (1, 2, 70, 90, 140, 160, 2), (1, 2, 200, 230, 500, 530, 3), (1, 2, 240, 260, 400, 420, 3), (3, 2, 0, 10, 0, 10, 1)], _M)
    assert rows_of(matches.merge_same_source(m)) == [(1, 2, 0, 90, 100, 160, 7), (1, 2, 200, 230, 500, 530, 3), (1, 2, 240, 260, 400, 420, 3), (3, 2, 0, 10, 0, 10, 1)]
    assert matches.merge_same_source(m.limit(0)).count() == 0


def test_select_matches(spark):
    m = spark.createDataFrame([(1, 2, 0, 100, 0, 100, 9), (1, 2, 10, 95, 300, 385, 9), (1, 2, 60, 110, 70, 120, 9), (1, 2, 60, 120, 900, 960, 9), (1, 2, 400, 420, 0, 20, 9), (1, 2, 0, 100, 0, 100, 9)], _M)
    # covered by a longer one, twice; in a place of its own; too short; a repeat
    assert rows_of(matches.select_matches(m)) == [(1, 2, 0, 100, 0, 100, 9), (1, 2, 60, 120, 900, 960, 9)]


def test_growth_over_sentences(spark):
    a, b = "开头不同的话甲乙丙丁。光伏薄膜检测平台建设方案。高频传感器标定流程说明。尾声完全两样。", "另起一段的文字戊己庚。光伏薄膜检测平台建设方案。高频传感器的标定流程。别的收束句子。"
    at = a.index("光伏"), a.index("高频")
    src = b.index("光伏"), b.index("高频")
    texts = spark.createDataFrame([(1, a), (2, b), (5, None)], "doc_id long, text string")
    m = spark.createDataFrame([(1, 2, at[0], at[1], src[0], src[1], 4), (1, 5, 0, 5, 0, 5, 1)], _M)
    got = {r.doc_id: r for r in matches.grow(m, texts).collect()}
    assert (got[2].start, got[2].end, got[2].kind) == (at[0], a.index("尾声"), "paraphrase") and (got[2].src_start, got[2].src_end) == (src[0], b.index("别的"))
    assert (got[5].start, got[5].end, got[5].kind) == (0, 5, "exact")


def test_groups_of_sources(spark):
    m = spark.createDataFrame([(1, 2, 0, 100, 0, 100, 9), (1, 3, 20, 90, 500, 570, 9), (1, 2, 110, 150, 110, 150, 4), (1, 2, 160, 200, 900, 940, 4), (1, 4, 3000, 3050, 0, 50, 1)], _M)
    got = [(r.start, r.end, r.parts, r.sources, r.best_source) for r in sorted(matches.source_groups(m).collect(), key=lambda r: r.group_no)]
    assert got == [(0, 150, 3, 2, 2), (160, 200, 1, 1, 2), (3000, 3050, 1, 1, 4)]


def test_reasons(spark):
    columns = "parts long, template_parts long, with_source long, lexical double, covered long, total long, longest int"
    cases = [((0, 3, 0, None, 0, 100, None), "no_parts"), ((10, 0, 7, 0.9, 90, 100, 50), "few_sources"), ((1, 0, 1, 0.1, 90, 100, 50), "unlike"), ((1, 0, 1, 0.9, 29, 100, 29), "few_chars"), ((1, 0, 1, 0.9, 30, 1000, 30), "small_share"), ((1, 0, 1, 0.9, 90, None, 90), "small_share"), ((3, 7, 3, 0.9, 90, 100, 40), "template"), ((9, 0, 9, 0.9, 90, 100, 19), "short_parts"), ((1, 0, 1, 0.9, 90, 100, 90), None)]
    for values, reason in cases:
        assert matches.pair_reason(spark.createDataFrame([values], columns)).first().reason == reason


def modularity(edges, own, resolution=1.0):
    whole = sum(w for _, _, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    inside = sum(w for a, b, w in edges if own[a] == own[b]) / whole
    return inside - resolution * sum(sum(d for v, d in degree.items() if own[v] == c) ** 2 for c in set(own.values())) / (2 * whole) ** 2


def test_communities_by_modularity(spark):
    rng = random.Random(3)
    edges = [(a, b, 1.0) for g in range(4) for a, b in itertools.combinations(range(6 * g, 6 * g + 6), 2)] + [(5, 6, 1.0), (11, 12, 1.0), (17, 18, 1.0), (23, 0, 1.0)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long, weight double")
    own = {r.node: r.community for r in graph.louvain(frame).collect()}
    assert own == {v: 6 * (v // 6) for v in range(24)}
    assert modularity(edges, own) > max(modularity(edges, dict.fromkeys(own, 0)), modularity(edges, {v: v for v in own}))
    assert graph.nearest_resolution(frame, 4)[1].select("community").distinct().count() == 4
    small = [(1, 2, 3.0), (2, 3, 1.0), (3, 4, 3.0), (4, 5, 1.0), (5, 6, 3.0), (1, 6, 1.0)]
    got = {r.node: r.community for r in graph.louvain(spark.createDataFrame(small, "a long, b long, weight double")).collect()}
    best = max(modularity(small, dict(zip(range(1, 7), p, strict=True))) for p in itertools.product(range(3), repeat=6))
    assert modularity(small, got) == pytest.approx(best)
    with pytest.raises(ValueError):
        graph.louvain(frame, limit=3)
    assert graph.louvain(frame.limit(0)).count() == 0


def plain_linkage(words, least):
    own = {k: [k] for k in sorted(words)}
    like = lambda a, b: len(words[a] & words[b]) / len(words[a] | words[b]) if words[a] | words[b] else 0.0
    while True:
        pairs = [(-round(sum(like(x, y) for x in own[a] for y in own[b]) / len(own[a]) / len(own[b]), 9), a, b) for a, b in itertools.combinations(sorted(own), 2)]
        if not pairs or -min(pairs)[0] < least:
            return {x: c for c, xs in own.items() for x in xs}
        _, a, b = min(pairs)
        own[a] += own.pop(b)


def test_average_linkage(spark):
    rng = random.Random(5)
    words = {f"k{i:02d}": {rng.choice("甲乙丙丁戊己") for _ in range(rng.randrange(1, 4))} for i in range(25)}
    frame = spark.createDataFrame([("x", k, sorted(w)) for k, w in words.items()] + [("y", "solo", None), (None, "z", ["甲"])], "bucket string, key string, w array<string>")
    got = {(r.bucket, r.key): r.cluster for r in grouping.average_linkage(frame, "bucket", "key", "w", 0.3).collect()}
    assert got == {**{("x", k): c for k, c in plain_linkage(words, 0.3).items()}, ("y", "solo"): "solo"}
    vectors = spark.createDataFrame([("x", i, [float(i % 2), 1.0 - i % 2, 0.01 * i]) for i in range(8)], "bucket string, key long, v array<double>")
    assert {r.key: r.cluster for r in grouping.average_linkage(vectors, "bucket", "key", "v", 0.7, "vectors").collect()} == {i: i % 2 for i in range(8)}
    assert grouping.average_linkage(frame.limit(0), "bucket", "key", "w", 0.3).count() == 0


def test_linkage_of_large_buckets(spark):
    rng = random.Random(15)
    parts = [{f"k{p:03d}{i}": {f"{p}{rng.choice('甲乙丙丁戊')}" for _ in range(rng.randrange(1, 4))} for i in range(10)} for p in range(310)]
    assert sum(map(len, parts)) > grouping.LINKAGE
    frame = spark.createDataFrame([("x", k, sorted(w)) for part in parts for k, w in part.items()], "bucket string, key string, w array<string>")
    got = {r.key: r.cluster for r in grouping.average_linkage(frame, "bucket", "key", "w", 0.3).collect()}
    assert got == {k: c for part in parts for k, c in plain_linkage(part, 0.3).items()}


def test_groups_split_and_filled(spark):
    rng = random.Random(6)
    rows = [(i, [rng.random(), rng.random()], "a") for i in range(200)] + [(300 + i, [9.0, 9.0], "b") for i in range(30)] + [(400 + i, [0.5, 0.5 + i], "c") for i in range(3)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    split = grouping.split_oversize(frame, 40).collect()
    sizes = {}
    for r in split:
        sizes[r.cluster] = sizes.get(r.cluster, 0) + 1
    assert len(split) == len(rows) and max(sizes.values()) <= 40
    equal = spark.createDataFrame([(i, [1.0], "e") for i in range(50)], "vec_id long, embedding array<double>, cluster string")
    assert max(r["count"] for r in grouping.split_oversize(equal, 20).groupBy("cluster").count().collect()) <= 20
    moved = grouping.reassign_small(frame.where("cluster <> 'a'"), 10, 32).groupBy("cluster").count().collect()
    assert {r.cluster: r["count"] for r in moved} == {"b": 32, "c": 1}
    assert [grouping.group_count(n) for n in (0, 1, 37, 38, 100)] == [0, 1, 1, 2, 4]


def test_more_text_functions(spark):
    def one(value, make):
        return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y

    assert one(" 暂无 ", T.effective) == "" and one(None, T.effective) == "" and one(" 实 ", T.effective) == "实"
    assert one("（一）设备 费用", lambda c: T.canonical(c, {"设备费用": "设备费"})) == "设备费"
    assert one("110101199003074514", T.valid_identity) is True and one("110101199003074515", T.valid_identity) is False and one(None, T.valid_identity) is False
    assert one("13812345678", T.valid_phone) and not one("12345", T.valid_phone) and one("a.b@c.example", T.valid_mail) and not one("a@b", T.valid_mail)
    assert one("短；足够长的短语；另一个足够长的", T.key_phrases) == ["足够长的短语", "另一个足够长的"] or one("短；足够长的短语；另一个足够长的", T.key_phrases) == ["另一个足够长的"]
    assert one("执行期2021年3月至2022年2月", T.period_months) == 12 and one("为期18个月", T.period_months) == 18 and one("无", T.period_months) is None
    assert one("2022年2月及2021年11月，2022年2月", T.milestones) == ["2021-11", "2022-02"]
    assert one("```json\n{\"a\": 1}\n```", T.fenced_object) == '{"a": 1}' and one("x", T.fenced_object) == ""
    assert one("关于光伏的研究", T.simple_title) == "光伏" and one("光伏（一期）", T.topic_key) == "光伏"
    assert one("a|b|a|c|d", lambda c: T.row_fields(F.split(c, r"\|"))) == {"a": "b"}
    assert one("well-\nknown  \n\n\n\nx", T.repaired) == "wellknown\n\nx"


def test_longest_shared_part(spark):
    from foliant.operators import alignment

    rows = [(1, "光伏薄膜检测", "新光伏薄膜厂"), (2, "甲", "乙"), (3, None, "x"), (4, "", ""), (5, "a" * 300 + "b", "a" * 299)]
    got = {r.id: (r.shared, r.shared_share) for r in alignment.longest_shared(spark.createDataFrame(rows, "id long, a string, b string")).collect()}
    assert got == {1: (4, 4 / 6), 2: (0, 0.0), 3: (0, 0.0), 4: (0, 0.0), 5: (299, 1.0)}
    assert spark.createDataFrame([("光伏、Ab；c；电极",)], "x string").select(T.topic_tokens(F.col("x")).alias("t")).first().t == ["光伏", "ab", "电极"]


def test_numbers_over_ranges(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(5)) for i in range(400)]
    got = {r.i: r.n for r in graph.numbered(spark.createDataFrame(rows, "i long, s long"), [F.desc("s"), F.col("i")], "n").collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
