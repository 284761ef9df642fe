"""Core operators on small frames against plain versions, with nulls, ties, empty tables and order-dependence."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import alignment, diff, graph, grouping, images, intervals, matching, panel, passages, postings, templates, vectors
from foliant.plans import data_plans
from foliant.sources import documents as sources
from foliant.streaming import ingest


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, "[表格行3] a　b\n c", "string", T.squeeze) == "abc"
    assert one(spark, "　 一、Ab-c 1。", "string", T.compare_form) == "abc1"
    assert one(spark, "abca", "string", lambda c: T.gram_list(c, 2)) == ["ab", "bc", "ca"]
    assert one(spark, "aaaa", "string", lambda c: T.grams(c, 2)) == ["aa"] and one(spark, "a", "string", lambda c: T.grams(c, 2)) == ["a"] and one(spark, "", "string", lambda c: T.grams(c, 2)) == []
    assert one(spark, "a\nbc", "string", lambda c: T.gram_list(c, 3)) == ["a\nb", "\nbc"]
    assert one(spark, "<p>a&nbsp;&lt;b</p>", "string", T.clean_html) == "a <b"
    assert one(spark, " a;；b,,c ", "string", T.keywords) == ["a", "b", "c"]
    assert one(spark, "项目经费12.5亿元", "string", T.amount_in_ten_thousands) == 125000.0 and one(spark, "无", "string", T.amount_in_ten_thousands) is None
    assert str(one(spark, "2024年3月5日", "string", T.parse_date)) == "2024-03-05" and one(spark, "x", "string", T.parse_date) is None
    assert one(spark, "２０２１年", "string", T.year_of) == 2021 and one(spark, None, "string", T.year_of) is None
    assert [one(spark, s, "double", T.grade) for s in (9.0, 8.0, 6.0, 4.0, 3.9)] == list("ABCDE")
    assert one(spark, ["a", "b"], "array<string>", lambda c: T.jaccard(c, F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert one(spark, [], "array<string>", lambda c: T.overlap(c, c)) == 0.0
    assert one(spark, "12345", "string", lambda c: T.prefix_similarity(c, F.lit("12399"))) == pytest.approx(0.6)
    assert [one(spark, "1234567", "string", lambda c, o=o: T.subject_similarity(c, F.lit(o))) for o in ("1234567", "12345670", "12345", "123", "1", "9")] == [1.0, 0.9, 0.55, 0.2, 0.15, 0.0]
    assert one(spark, "ffffffffffffffff", "string", lambda c: T.hamming(c, F.lit("fffffffffffffffe"))) == 1 and one(spark, "ff", "string", lambda c: T.hamming(c, c)) == 64
    assert one(spark, [1.0, 0.0], "array<double>", lambda c: T.cosine(c, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, "abc", "string", lambda c: T.phrase_similarity(c, F.lit("xabcx"))) == 0.98


def test_postings_and_recall(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("甲乙丙丁戊己庚辛") for _ in range(60)) for _ in range(5)]
    docs = [(i, base[i % 5][: 30 + i] + str(i)) for i in range(20)] + [(90, None), (91, ""), (92, "短")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    grams = {d: {t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set() for d, t in docs}
    index = postings.postings(frame)
    df = {}
    for g in grams.values():
        for x in g:
            df[x] = df.get(x, 0) + 1
    assert {r.gram: r.df for r in postings.gram_frequency(index).collect()} == df
    queries = postings.document_grams(frame.where("doc_id < 3")).withColumnRenamed("doc_id", "query_id")
    got = {(r.query_id, r.doc_id): r.hits for r in postings.coarse_recall(index, queries, max_df=6, min_hits=3, top=50).collect()}
    want = {(q, d): n for q in range(3) for d in grams if d != q and (n := sum(df[g] <= 6 for g in grams[q] & grams[d])) >= 3}
    assert got == want
    merged = postings.merge_frequency(postings.gram_frequency(index), index.where("doc_id = 1"), index.where("doc_id = 92"))
    assert "短" not in {r.gram for r in merged.collect()}
    assert postings.coarse_recall(index.limit(0), queries).count() == 0


def test_intervals(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), a, a + rng.randrange(-2, 30)) for a in (rng.randrange(300) for _ in range(80))] + [("c", None, 5)]
    frame = spark.createDataFrame(rows, "k string, start int, end int")
    covered = {}
    for k, a, b in rows:
        if a is not None:
            covered.setdefault(k, set()).update(range(a, b))
    assert {r.k: r.covered for r in intervals.union_length(frame, ["k"]).collect()} == {k: len(v) for k, v in covered.items() if v}
    points = spark.createDataFrame([(k, p) for k in ("a", "b", None, "z") for p in range(0, 330, 3)], "k string, pos int")
    assert {tuple(r) for r in intervals.outside(points, frame, ["k"], cell=16).collect()} == {(k, p) for k in ("a", "b", None, "z") for p in range(0, 330, 3) if p not in covered.get(k, ())}
    assert {tuple(r) for r in intervals.inside(points, frame, ["k"], cell=16).collect()} == {(k, p) for k in ("a", "b", None) for p in range(0, 330, 3) if p in covered.get(k, ())}
    assert intervals.islands(frame.limit(0), ["k"]).count() == 0
    assert spark.createDataFrame([("abcdef", [(1, 3), (4, 6)])], "t string, s array<struct<start:int,end:int>>").select(intervals.mask(F.col("t"), F.col("s")).alias("m")).first().m == "a  d  "


def test_alignment_is_metamorphic(spark):
    rng = random.Random(3)
    body = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(900))
    other = "".join(chr(0x6000 + rng.randrange(2000)) for _ in range(900))
    docs = spark.createDataFrame([(1, body), (2, "页眉" + body), (3, other), (4, body[:300] + other[:300])], "doc_id long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (2, 1)], "query_id long, doc_id long")
    runs = alignment.runs(alignment.anchors(pairs, alignment.positions(docs)))
    merged = alignment.merge_runs(runs)
    sizes = docs.select(F.col("doc_id").alias("query_id"), F.length("text").alias("total"))
    got = {(r.query_id, r.doc_id): r for r in alignment.pair_scores(merged, sizes).collect()}
    assert got[1, 2].share == 1.0 and got[1, 2].level == "high" and (1, 3) not in got and got[1, 4].covered == 300 and got[2, 1].covered == 900
    wins = alignment.sliding_windows(docs)
    assert wins.where("doc_id = 1").count() == 10 and wins.agg(F.min(F.length("body"))).first()[0] >= 90
    scores = alignment.suspicion(alignment.window_coverage(wins.where("doc_id = 1"), docs, pairs.where("query_id = 1")))
    assert {r.doc_id: round(r.best, 6) for r in scores.collect()} == {2: 1.0, 4: 1.0}
    text = spark.createDataFrame([("甲乙丙丁", "甲乙丙丁"), ("甲乙", None), ("", "x")], "a string, b string")
    assert [round(r.aligned, 3) for r in alignment.ratios(text).collect()] == [1.0, 0.0, 0.0]


def test_templates_and_passages(spark):
    doc = "一、项目概况\n填写说明：请填写。\n本项目研究光伏薄膜在高温条件下的稳定性，\n并提出改进方法。\n[表格行1] a | b | \n\n2.1 经费预算\n设备费增加12.5%，材料费增加13%，又增加99%。"
    frame = spark.createDataFrame([(1, doc), (2, None), (3, "")], "doc_id long, text string")
    sent = templates.sentences(frame).collect()
    assert all(doc[r.start : r.end] == r.sentence for r in sent)
    rows = {r.line_no: (r.kind, r.section) for r in passages.carry_section(passages.lines(frame.where("doc_id = 1"))).withColumn("kind", passages.line_kind(F.col("line"))).collect()}
    assert rows[0] == ("header", "一、项目概况") and rows[4][0] == "table" and rows[7] == ("paragraph", "2.1 经费预算")
    built = passages.build_passages(frame).collect()
    assert "".join(r.text for r in built).replace(" ", "") == doc.replace("\n", "").replace(" ", "") and "本项目研究光伏薄膜在高温条件下的稳定性，并提出改进方法。" in {r.text for r in built}
    assert passages.search(passages.build_passages(frame), "经费预算是多少", 1).first().section == "2.1 经费预算"
    assert {(r.name, r.unit, r.mentions) for r in templates.metric_conflicts(frame).collect()} == {("增加", "%", 3)}
    table = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (1, 2, None), (1, 3, "b"), (2, 0, None)], "t int, n int, c string")
    assert [r.c for r in passages.fill_down(table, ["t"], "n", ["c"]).orderBy("t", "n").collect()] == ["a", "a", "a", "b", None]


def test_vectors_and_grouping(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) + 4 * (i % 3 == j) for j in range(3)], i % 3) for i in range(90)] + [(100, None, 0), (101, [0.0, 0.0, 0.0], None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vectors.cosine_top(frame, frame.where("vec_id < 4"), 3).collect()
    import numpy as np

    x = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in x.items()}
    for q in range(4):
        want = sorted(((-round(float(unit[q] @ unit[i]), 6), i) for i in x if i != q))[:3]
        assert [(-r.cosine, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == want
    labels = {r.vec_id: r.cluster for r in grouping.spherical_kmeans(frame, 3).collect()}
    assert len(labels) == 91
    b = grouping.balance(grouping.spherical_kmeans(frame, 3).join(frame.select("vec_id", "label"), "vec_id")).first()
    assert b.groups == 3 and b.purity > 0.75
    dealt = grouping.interleave(spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id int, q double"), 4, "q", "id").collect()
    order = sorted(range(50), key=lambda i: (-(i % 7), i))
    assert {r.id: r.group for r in dealt} == {i: n % 4 for n, i in enumerate(order)}
    assert grouping.spherical_kmeans(frame.limit(0), 3).count() == 0 and vectors.cosine_top(frame, frame.limit(0)).count() == 0


def test_graph(spark):
    members = spark.createDataFrame([(g, i) for g in range(4) for i in range(g, g + 3)] + [(None, 1), (0, None), (0, 1)], "g int, i long")
    edges = graph.cooccurrence(members, "g", "i")
    want = {}
    for g in range(4):
        for a in range(g, g + 3):
            for b in range(a + 1, g + 3):
                want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.weight for r in edges.collect()} == want
    hops = {r.node: r.hop for r in graph.neighbourhood(edges, spark.createDataFrame([(0,)], "node long"), 2).collect()}
    assert hops == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    ranks = graph.pagerank(spark.createDataFrame([("a", "b", 1.0), ("c", "b", 1.0), ("b", "a", 1.0), ("a", "d", 1.0)], "src string, dst string, weight double"), 30)
    score = {r.node: r.score for r in ranks.collect()}
    plain = dict.fromkeys("abcd", 0.25)
    for _ in range(30):
        lost = plain["d"] / 4  # d leads nowhere
        plain = {n: 0.15 / 4 + 0.85 * (got + lost) for n, got in {"a": plain["b"], "b": plain["a"] / 2 + plain["c"], "c": 0, "d": plain["a"] / 2}.items()}
    assert score == pytest.approx(plain, abs=1e-9) and sum(score.values()) == pytest.approx(1)
    two = spark.createDataFrame([(a, b, 1) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)], "a long, b long, weight long")
    labels = {r.node: r.label for r in graph.label_propagation(two, 4).collect()}
    assert len({labels[i] for i in range(4)}) == 1 and len(set(labels.values())) == 2
    assert graph.pagerank(graph.both_ways(two.limit(0))).count() == 0
    before = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "community int, keyword string")
    assert {(r.source, r.target, r.shared) for r in graph.migration_links(before, before).collect()} == {(1, 1, 2), (2, 2, 1)}


def plain_labels(edges, rounds):
    around = {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    for v, near in around.items():
        near.append((v, max(w for _, w in near)))
    label = {v: v for v in around}
    for _ in range(rounds):
        fresh = {}
        for v, near in around.items():
            votes = {}
            for u, w in near:
                votes[label[u]] = votes.get(label[u], 0) + w
            fresh[v] = min(votes, key=lambda x: (-votes[x], x))
        label = fresh
    return label


def test_labels_settle(spark):
    rng = random.Random(6)
    chain = [(i, i + 1, 40 - i) for i in range(30)]  # a label walks down it, one node a round
    two = [(100, 101, 1), (100, 102, 1), (101, 103, 1), (102, 103, 1)]
    mixed = sorted({(200 + min(p), 200 + max(p), 1 + sum(p) % 3) for p in (rng.sample(range(40), 2) for _ in range(70))})
    for edges in (chain, two, mixed, chain + two + mixed):
        frame = spark.createDataFrame(edges, "a long, b long, weight long")
        assert {r.node: r.label for r in graph.label_propagation(frame, 101, settle=True).collect()} == plain_labels(edges, 101)
    assert plain_labels(chain, 101) != plain_labels(chain, 3)


def test_iterations_are_whole(spark, monkeypatch):
    import numpy as np

    members = spark.createDataFrame([(o, s) for o in range(300) for s in (o % 40, (o * 7 + o // 40) % 40, (o % 40 + 1) % 40)], "l_orderkey long, l_suppkey long")
    monkeypatch.setattr(data_plans, "_supplier_graph", lambda *_: graph.cooccurrence(members, "l_orderkey", "l_suppkey"))
    edges = [tuple(r) for r in data_plans._supplier_graph().collect()]
    labels = plain_labels(edges, data_plans.LABEL_ROUNDS)
    assert {r.node: r.label for r in data_plans.part_communities(spark, "").collect()} == labels
    assert {r.label: r["size"] for r in data_plans.community_sizes(spark, "").collect()} == {x: list(labels.values()).count(x) for x in labels.values()}
    weight = {}
    for a, b, w in edges:
        weight[a, b] = weight[b, a] = w
    total = {v: sum(w for (a, _), w in weight.items() if a == v) for v, _ in weight}
    score = dict.fromkeys(total, 1 / len(total))
    for _ in range(20):
        score = {v: 0.15 / len(total) + 0.85 * sum(score[a] * w / total[a] for (a, b), w in weight.items() if b == v) for v in total}
    assert {r.node: r.score for r in data_plans.supplier_rank(spark, "").collect()} == pytest.approx(score, abs=2e-8)

    kept = []
    real = grouping.spherical_kmeans
    monkeypatch.setattr(grouping, "spherical_kmeans", lambda *a, **k: kept.append(real(*a, **k)) or kept[-1])
    data_plans.kmeans_groups(spark, "/root/testdata/sf0.01").collect()
    cluster = {r.vec_id: r.cluster for r in kept[0].collect()}
    x = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding is not None}
    unit = {i: v / (np.linalg.norm(v) or 1) for i, v in x.items()}
    centres = {c: sum(unit[i] for i in cluster if cluster[i] == c) for c in set(cluster.values())}
    centres = {c: v / np.linalg.norm(v) for c, v in centres.items()}
    assert all(max(centres, key=lambda c: (round(float(unit[i] @ centres[c]), 9), -c)) == cluster[i] for i in cluster)


@pytest.mark.parametrize("radius", [3, 7, 10])
def test_hamming_join(spark, radius):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    rows = [(f"i{n}", f"{b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(12))) & (2**64 - 1):016x}") for n, b in enumerate(base * 6)] + [("bad", "xyz"), ("null", None), ("i0", None)]
    frame = spark.createDataFrame(rows, "image_id string, phash_hex string")
    good = {i: int(h, 16) for i, h in rows if h and len(h) == 16}
    got = {(r.query_id, r.image_id): r.distance for r in images.hamming_join(frame, frame, radius).collect()}
    assert got == {(a, b): n for a in good for b in good if a != b and (n := (good[a] ^ good[b]).bit_count()) <= radius}


@pytest.mark.parametrize("radius", [16, 18, 30])
def test_hamming_join_beyond_bands(spark, radius):
    test_hamming_join(spark, radius)


def test_image_queries_of_the_whole_decision(spark):
    folder = "/root/testdata/sf0.01"
    rows = {tuple(r) for r in spark.read.parquet(f"{folder}/image_features.parquet").select("image_id", "doc_id", "sha256_norm", "phash_hex").collect()}
    good = [(i, d, s, int(h, 16)) for i, d, s, h in rows if h and len(h) == 16]
    near, levels = set(), set()
    for a, da, sa, ha in good:
        for b, db, sb, hb in good if a and a[-2:] == "00" else []:
            n = (ha ^ hb).bit_count()
            if a != b and n <= 18:
                near.add((a, b, n))
                score = 0.0 if da and da == db else 1.0 if sa and sa == sb else 0.6 * (1 - n / 64)
                levels.add((a, b, n, round(score, 6), "high" if score >= 0.9 else "medium" if score >= 0.72 else "low" if score > 0 else "none"))
    assert {tuple(r) for r in data_plans.images_near(spark, folder).collect()} == near
    got = {tuple(r) for r in data_plans.image_levels(spark, folder).collect()}
    assert {r[:3] for r in got} == near and got == levels and max(n for _, _, n in near) > 10


def test_images_changed(spark):
    listed = spark.createDataFrame([("a", 1, 1.0), ("b", 2, None), ("c", 3, 1.0)], "doc_id string, file_size int, file_mtime double")
    stored = spark.createDataFrame([("a", 1, 1.0), ("b", 2, None), ("c", 4, 1.0), ("d", 1, 1.0)], "doc_id string, file_size int, file_mtime double")
    assert {r.doc_id for r in images.changed_documents(listed, stored).collect()} == {"c"}
    assert {r.doc_id for r in images.pruned(stored, listed).collect()} == {"d"}


def test_panel_and_diff(spark):
    facts = spark.createDataFrame([("t", 2020, "F", 5.0), ("t", 2021, "F", 10.0), ("t", 2021, "O", 1.0), ("u", 2021, "O", 2.0)], "topic string, year int, s string, amount double")
    p = panel.yearly(facts, "topic", "year", F.col("s") == "F", F.col("amount"))
    base = {r.topic: r for r in panel.baseline(p, "topic").collect()}
    assert base["t"].growth == 1.0 and base["u"].growth == 0.0 and base["t"].funded_ratio == pytest.approx(2 / 3) and base["u"].avg_award == 0
    steps = spark.createDataFrame([("a", 2, -0.5), ("a", 1, 0.5), ("b", 1, -2.0), ("b", 2, 1.0)], "k string, o int, r double")
    assert {r.k: r.value for r in panel.compounded(steps, "k", "o", "r").collect()} == {"a": 0.75, "b": 0.0}
    left, right = (spark.createDataFrame(x, "k string, amount double") for x in ([("a", 100.0), ("b", 10.0)], [("a", 101.0), ("c", 5.0)]))
    assert {r.k: r.level for r in diff.compare_items(left, right, ["k"]).collect()} == {"a": "GREEN", "b": "RED", "c": "RED"}
    a = spark.createDataFrame([("p", "m", 1, 10.0), ("p", "m", 2, 20.0), ("p", "n", 3, 1.0), ("p", "m", 9, None)], "pair string, name string, id long, value double")
    b = spark.createDataFrame([("p", "m", 7, 19.0), ("p", "m", 8, 12.0)], "pair string, name string, id long, value double")
    assert {(r.left_id, r.right_id, r.gap) for r in diff.match_metrics(a, b).collect()} == {(2, 7, 1.0), (1, 8, 2.0)}
    rows = spark.createDataFrame([("k", 1, "", "x"), ("k", 2, "a", None), ("k", 3, "b", "y")], "k string, o int, c string, d string")
    assert tuple(diff.first_nonempty(rows, "k", "o", ["c", "d"]).first()) == ("k", "a", "x")


def test_match_by_subject(spark):
    rng = random.Random(6)
    codes = ["1234567", "1234568", "12345", "1299999", "777"]
    projects = [(f"p{i}", rng.choice([*codes, None]), rng.choice(["u1", "u2", None])) for i in range(30)]
    experts = [(f"e{i:03d}", rng.choice(codes), rng.choice(["u1", "u1", "u2", None])) for i in range(150)]
    got = {(r.project_id, r.expert_id, r.score) for r in matching.match_by_subject(spark.createDataFrame(projects, "project_id string, code string, unit string"), spark.createDataFrame(experts, "expert_id string, code string, unit string")).collect()}

    def score(a, b):
        return 1.0 if a == b else 0.9 if len(a) >= 7 <= len(b) and a[:7] == b[:7] else 0.55 if len(a) >= 5 <= len(b) and a[:5] == b[:5] else 0

    want = set()
    for p, c, u in projects:
        best = sorted((-score(c, d), e) for e, d, v in experts if c and score(c, d) and not (u and v and u == v))[:5]
        want |= {(p, e, -s) for s, e in best}
    assert got == want


def test_phrases_contained(spark):
    rng = random.Random(31)
    chars = "甲乙丙丁𠀀"
    texts = [(i // 2, "".join(rng.choice(chars) for _ in range(rng.choice([0, 5, 6, 40, 200])))) for i in range(60)] + [(None, "甲乙丙丁甲乙丙"), (90, None), (91, "x" * 100)]
    phrases = sorted({t[a : a + n] for _, t in texts if t for n in (6, 7, 12, 17, 18, 36, 50) for a in (0, 3, len(t) - n) if 0 <= a <= len(t) - n} | {"甲" * 37, "x" * 99})
    got = matching.contained(spark.createDataFrame([(p,) for p in [*phrases, *phrases[:3], None]], "phrase string"), spark.createDataFrame(texts, "key long, text string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(k, p) for k, t in texts for p in phrases if t and p in t}
    assert "Generate" not in plan  # before, each position of a text was a row that held the whole text
    assert matching.contained(spark.createDataFrame([], "phrase string"), spark.createDataFrame(texts, "key long, text string")).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(1, "a", 1), (2, "b", 1), (1, "c", 2), (3, None, None)]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows[:2], "id long, v string, t int").coalesce(1).write.parquet(folder)
    run = lambda: {(r.id, r.v) for r in ingest.ingest(spark, folder, str(tmp_path / "out"), str(tmp_path / "ck"), "id", "t").collect()}
    assert run() == {(1, "a"), (2, "b")}
    spark.createDataFrame(rows[2:], "id long, v string, t int").coalesce(1).write.mode("append").parquet(folder)
    assert run() == {(1, "c"), (2, "b"), (3, None)} == run()


def test_sources(spark, tmp_path):
    import zipfile

    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>第一段</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>名称</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>值</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>末段</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "b.html").write_text("<html><head><title>题</title><style>x</style></head><body><p>正 文</p></body></html>")
    (tmp_path / "c.txt").write_text("纯文本")
    (tmp_path / "d.docx").write_bytes(b"broken")
    got = {r.doc_id: (r.kind, r.text) for r in sources.read_documents(spark, str(tmp_path)).collect()}
    assert got["a"] == ("docx", "第一段\n[表格行1] 名称 | 值\n末段") and got["b"] == ("html", "题\n正 文") and got["c"] == ("text", "纯文本") and got["d"] == ("docx", None)
    frame = spark.createDataFrame([("g1", 1), ("g2", 2)], "gram string, doc_id int")
    sources.write_bucketed(frame, "foliant_test_postings", "gram", 4)
    assert spark.table("foliant_test_postings").count() == 2
    spark.sql("DROP TABLE foliant_test_postings")
    target = str(tmp_path / "live")
    sources.replace_table(frame, target)
    sources.replace_table(frame.limit(1), target)
    assert sources.current_table(spark, target).count() == 1
