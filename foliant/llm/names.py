"""Variant spellings of registered names: suffix blocking, then longest common subsequences and the edits between.

Registered names enter in the forms in which people shorten and reorder them, typed ones in the readings that set off a
department. Both sides are indexed by their suffixes and meet by a shuffled join on them; a suffix that is too common is
only dropped where it stands alone, after it has been refined by the characters of the name's place. Every pair that
meets is compared by the ratio of the longest common subsequence and by its slips, which must leave the distinguishing
characters (place and proper name) in place; the best unit over all pairs must be the only one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.confusables import give, plain_form, prototypes
from foliant.session import spread

#: Shortest suffix that is indexed, and how many forms may share one before it only counts refined.
SUFFIX, COMMON = 2, 40
#: Provinces in a register at most; they are the only part of it that the driver sees.
PROVINCES = 10_000
#: Least ratio of the longest common subsequence.
RATIO = 0.72

# Kinds of institutions, legal forms, and how departments end.
SCHOOLS = ("大学", "学院")
INSTITUTES = ("研究院", "研究所")
LEGAL = ("股份有限公司", "有限责任公司", "有限公司", "股份公司", "公司")
ORDINALS = "一二三四五六七八九十"
DEPARTMENT = re.compile(r"(?:(?:[^\s()]{1,6}(?:学院|院区|中心|实验室|研究室|办公室|教研室))|(?:[^\s()]{1,5}[办室部科所系馆区组处队]))$")
#: Traditional characters common in names of institutions, and their simplified forms.
SIMPLIFIED = str.maketrans(
    "學師範業醫農環電財經濟術國際數質檢驗實護藥劑動機設計測試產發展責任樂員團業節資訊車東華萬與興廣區縣鎮鄉衛療養體聯協會書館處總務辦類應運輸氣築園藝紡織絲綢鋼鐵鐵銅鋁陽陰長門開關問間聞難離雲電預防頭題額風飛飲飯館馬驗鳥魚麥黃龍齊",
    "学师范业医农环电财经济术国际数质检验实护药剂动机设计测试产发展责任乐员团业节资讯车东华万与兴广区县镇乡卫疗养体联协会书馆处总务办类应运输气筑园艺纺织丝绸钢铁铁铜铝阳阴长门开关问间闻难离云电预防头题额风飞饮饭馆马验鸟鱼麦黄龙齐",
)
DUMMY = frozenset(("", "-", "无", "暂无", "待定", "—", "——", "/", "N/A"))


def clean(name: str) -> str:
    """Plain form, simplified characters, no spaces at the ends."""
    return plain_form(name).translate(SIMPLIFIED).strip()


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; the subsequence by bit-parallel rows."""
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def slips(form: str, guarded: frozenset[str], text: str, most: int) -> int:
    """Edits (substitution, omission, repetition or insertion, swap of neighbours) from form to text; above ``most``: most + 1.

    A guarded character may be left out, repeated or swapped, but not replaced: that would be another place or name.
    """
    n, m = len(form), len(text)
    if abs(n - m) > most:
        return most + 1
    before: list[int] = []
    row = list(range(m + 1))
    for i in range(1, n + 1):
        now = [i] + [0] * m
        low = i
        for j in range(1, m + 1):
            if form[i - 1] == text[j - 1]:
                cost = row[j - 1]
            else:
                cost = min(row[j], now[j - 1]) + 1
                if form[i - 1] not in guarded:
                    cost = min(cost, row[j - 1] + 1)
                if i > 1 and j > 1 and form[i - 1] == text[j - 2] and form[i - 2] == text[j - 1]:
                    cost = min(cost, before[j - 2] + 1)
            now[j] = cost
            low = min(low, cost)
        if low > most:
            return most + 1
        before, row = row, now
    return min(row[m], most + 1)


def _allowed(size: int) -> int:
    return 0 if size < 4 else 1 if size < 8 else 2 if size < 13 else 3


def block_keys(text: str, slips: bool = True) -> set[str]:
    """Suffixes refined by each of the first three characters, where a name has its place; for texts in which slips are looked
    for, suffixes by themselves, and the beginning with each of the last three characters."""
    keys = {f"{text[-SUFFIX:]}|{c}" for c in text[:3]}
    if slips:
        keys.update(text[-size:] for size in range(SUFFIX, min(len(text), 5) + 1))
        head = text[:4]
        pairs = {"".join(sorted(head[i : i + 2])) for i in range(max(0, min(2, len(head) - 1)))}
        keys.update(f"^{pair}|{c}" for pair in pairs for c in text[-3:])
    return keys


def name_forms(name: str, city: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(form, guarded characters, whether slips are looked for, whether it is weak) of a registered name.

    Schools: place, subject and type, each of which may be cut; institutes: subject by every other character and type by
    its last; hospitals: by their number; firms: with the place before, in brackets or left out, the trade or the legal
    form left out or changed.
    """
    name = clean(name)
    city = clean(city)
    places = (city, city + "市") if city else ("",)
    body = name
    bracket = f"({city})"
    if bracket in name:
        body = name.replace(bracket, "")
    elif name.startswith(city + "市"):
        body = name[len(city) + 1 :]
    elif name.startswith(city):
        body = name[len(city) :]
    else:
        yield name, name, True, False
        return
    hospital = re.fullmatch(rf"第([{ORDINALS}]+)人民医院", body)
    legal = next((x for x in LEGAL if body.endswith(x)), None)
    school = next((x for x in SCHOOLS if body.endswith(x)), None)
    institute = next((x for x in INSTITUTES if body.endswith(x)), None)
    if hospital:
        for place in places:
            for rest in (body, f"第{hospital[1]}医院", f"{hospital[1]}院", f"{hospital[1]}医院", f"{hospital[1]}人民医院"):
                yield place + rest, city + hospital[1], rest == body or rest == f"第{hospital[1]}医院", False
        yield f"{body}({city})", city + hospital[1], True, False
    elif legal:
        trunk = body[: -len(legal)]
        group = trunk.endswith("集团")
        stem = trunk[:-2] if group else trunk
        found = re.fullmatch(r"(..)([A-Za-z0-9]*)(.*)", stem)
        brand, latin, trade = found.groups() if found else (stem, "", "")
        guarded = city + brand
        endings = {legal, *LEGAL, ""} if not group else {legal, *LEGAL, "", *("集团" + x for x in LEGAL), "集团"}
        own = ("集团" if group else "") + legal
        for code in {latin, ""}:
            for line in {trade, ""}:
                core = brand + code + line
                for ending in endings:
                    full, weak = line == trade, ending not in (own, "") or code != latin
                    for place in places:
                        yield place + core + ending, guarded, full, weak
                    if line or ending == own:
                        yield core + ending, guarded, full and bool(ending), weak
                    yield f"{core}({city}){ending}", guarded, full, weak
                    yield f"{brand}({city}){code}{line}{ending}", guarded, full, weak
                    yield f"{core}{ending}({city})", guarded, full, weak
    elif school:
        subject = body[: -len(school)]
        for place in (*places, city[0]):
            for topic in {subject, subject[0]}:
                for kind in {school, school[0]} | ({""} if topic == subject else set()) | ({school[1]} if school == "学院" else set()):
                    yield place + topic + kind, city, place != city[0] and topic == subject and kind == school, False
        yield f"{body}({city})", city, True, False
    elif institute:
        subject = body[: -len(institute)]
        for place in (*places, city[0]):
            for topic in {subject, subject[::2], subject[:2], subject[:3]}:
                for kind in {institute, institute[-1], "研究" + institute[-1]}:
                    yield place + topic + kind, city, place != city[0] and topic == subject, False
        for topic in {subject, subject[::2]}:
            for kind in {institute, institute[-1]}:
                yield f"{topic}{kind}({city})", city, topic == subject, False
    else:
        for place in places:
            yield place + body, city, True, False


def _forms(seen: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(form, unit, guarded, full, fuzzy, weak) of registered names. weak: the form has another legal form than the name; it
    only counts if no other name has the form as its own."""
    give(seen)
    for batch in batches:
        rows: dict[tuple[str, int], list] = {}
        for unit, name, city in zip(*(batch.column(c).to_pylist() for c in ("unit_id", "unit_name", "city")), strict=True):
            full = clean(name)
            for form, guarded, fuzzy, weak in (*name_forms(name, city), (full, clean(city) or full, True, False)):
                if len(form) >= 3:
                    row = rows.setdefault((form, unit), [guarded, full, False, True])
                    row[2], row[3] = row[2] or fuzzy, row[3] and weak
        yield pa.record_batch([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int64()), *(pa.array([r[i] for r in rows.values()], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.bool_())))], names=["form", "unit", "guarded", "full", "fuzzy", "weak"])


def _form_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [sorted(block_keys(f, z)) for f, z in zip(batch.column("form").to_pylist(), batch.column("fuzzy").to_pylist(), strict=True)]
        take = pa.array([i for i, k in enumerate(keys) for _ in k], pa.int64())
        yield pa.record_batch([pa.array([x for k in keys for x in k], pa.string()), *(batch.column(c).take(take) for c in ("form", "fuzzy", "units"))], names=["key", "form", "fuzzy", "units"])


def _cores(text: str, provinces: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(core, department) readings of a text: whole, or with a department set off by signs on either side."""
    seen = set()
    options = [(text, "")]
    for sign in ("-", "/", ",", " "):
        if sign in text:
            head, _, tail = text.partition(sign)
            options += [(head.strip(), tail.strip()), (tail.strip(), head.strip())]
            head, _, tail = text.rpartition(sign)
            options += [(head.strip(), tail.strip()), (tail.strip(), head.strip())]
    for shape, core, rest in ((r"([^()]+)\((.+)\)", 2, 1), (r"(.+)\(([^()]+)\)", 1, 2), (r"\(([^()]+)\)(.+)", 2, 1), (r"\((.+)\)([^()]+)", 1, 2)):
        if found := re.fullmatch(shape, text):
            options += [(found[core].strip(), found[rest].strip()), (found[rest].strip(), found[core].strip())]
    for core, rest in options:
        for province in ("", *provinces):
            if province and not core.startswith(province):
                continue
            short = core[len(province) :].replace(" ", "")
            if short and (short, rest) not in seen:
                seen.add((short, rest))
                yield short, rest


def _is_department(text: str) -> bool:
    return not text or bool(DEPARTMENT.fullmatch(text))


def readings(value: str, provinces: frozenset[str]) -> set[tuple[str, int, bool]]:
    """(part, characters left to a department, whether slips are looked for): what of a text may be a unit's name."""
    text = clean(value)
    out: set[tuple[str, int, bool]] = set()
    if text in DUMMY:
        return out
    for core, rest in _cores(text, provinces):
        if not _is_department(rest):
            continue
        if len(core) >= 3:
            out.add((core, len(rest), len(core) >= 4))
        for size in range(3, len(core) - 1):  # a department that follows without a sign
            if _is_department(core[size:]):
                out.add((core[:size], len(rest) + len(core) - size, not rest and size >= 4))
    return out


def _plain(seen: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give(seen)
    for batch in batches:
        yield pa.record_batch([batch.column("value"), pa.array([plain_form(v) for v in batch.column("value").to_pylist()], pa.string())], names=["value", "plain"])


def _part_keys(seen: dict[str, str], provinces: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give(seen)
        for batch in batches:
            rows = [(v, *r, k) for v in batch.column("value").to_pylist() for r in sorted(readings(v, provinces)) for k in sorted(block_keys(r[0], r[2]))]
            types = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["value", "part", "left", "slips", "key"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value, slips, left, unlike, unit) of the pairs that may be the same name, and whether they are so to the letter."""
    for batch in batches:
        rows = []
        for value, part, left, loose, form, fuzzy, units in zip(*(batch.column(c).to_pylist() for c in ("value", "part", "left", "slips", "form", "fuzzy", "units")), strict=True):
            if part == form:
                rows += [(value, True, 0, left, 0.0, u["unit"]) for u in units]
            if not (loose and fuzzy) or lcs_ratio(form, part) < RATIO:
                continue
            most = _allowed(len(form))
            for u in units:
                if (count := slips(form, frozenset(u["guarded"]), part, most)) <= most:
                    rows.append((value, False, count, left, -lcs_ratio(u["full"], part), u["unit"]))
        types = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["value", "exact", "count", "left", "unlike", "unit"])


def _met(parts: DataFrame, forms: DataFrame) -> DataFrame:
    """Pairs with a key in common that are equal, or near enough for slips: by length, then by edits, of which a swap is two."""
    most = F.when(F.length("form") < 4, 0).when(F.length("form") < 8, 1).when(F.length("form") < 13, 2).otherwise(3)
    near = (F.abs(F.length("form") - F.length("part")) <= most) & F.levenshtein("part", "form", 6).between(0, 2 * most)
    return parts.join(forms, "key").where((F.col("part") == F.col("form")) | F.col("slips") & F.col("fuzzy") & near).drop("key").distinct()


def named_units(values: DataFrame, register: DataFrame) -> DataFrame:
    """(field_name, record_id, unit_id) of records that name a registered unit, or a department of one, in another spelling.

    values: field_name, record_id, value. register: unit_id, unit_name, city, province. Every different spelling is resolved once,
    so a hot unit costs no more than others. A value whose plain form is a registered name is no case; nor are null and
    dummy values, names that are not registered, and spellings that fit several units equally well. Of two rows with one
    unit_id both names count. Without a register nothing is found.
    """
    seen = prototypes()
    units = register.select(F.col("unit_id").cast("long").alias("unit_id"), "unit_name", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("province", F.lit("")).alias("province")).dropna().distinct()
    provinces = frozenset(r.province for r in units.select("province").distinct().limit(PROVINCES + 1).collect() if r.province)
    if len(provinces) > PROVINCES:
        raise ValueError(f"a register of more than {PROVINCES} provinces")
    listed = spread(units).mapInArrow(lambda it: _forms(seen, it), "form string, unit long, guarded string, full string, fuzzy boolean, weak boolean")
    forms = listed.groupBy("form").agg(F.max("fuzzy").alias("fuzzy"), F.min("weak").alias("none"), F.collect_set(F.struct("unit", "guarded", "full", "weak")).alias("units"))
    forms = forms.select("form", "fuzzy", F.transform(F.filter("units", lambda u: F.col("none") | ~u["weak"]), lambda u: F.struct(u["unit"].alias("unit"), u["guarded"].alias("guarded"), u["full"].alias("full"))).alias("units"))
    keyed = forms.mapInArrow(_form_keys, "key string, form string, fuzzy boolean, units array<struct<unit:long,guarded:string,full:string>>")
    refined = F.col("key").contains("|")
    common = keyed.where(~refined).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("key")
    keyed = keyed.join(common, "key", "left_anti")
    spelled = values.select("value").dropna().distinct()
    typed = spread(spelled).mapInArrow(lambda it: _plain(seen, it), "value string, plain string").join(units.select(F.col("unit_name").alias("plain")).distinct(), "plain", "left_anti")
    parts = typed.select("value").mapInArrow(_part_keys(seen, provinces), "value string, part string, left int, slips boolean, key string")
    met = _met(parts, keyed).mapInArrow(_compared, "value string, exact boolean, count int, left int, unlike double, unit long")
    first, last = (F.min(F.struct("count", "left", "unlike", (F.col("unit") * sign).alias("unit"))) for sign in (1, -1))
    best = met.groupBy("value", "exact").agg(first.alias("a"), last.alias("b")).where(F.col("a.unit") == -F.col("b.unit"))
    # what fits several to the letter may fit one of them better as a slip
    links = best.groupBy("value").agg(F.max_by("a.unit", "exact").alias("unit_id"))
    return values.select("field_name", "record_id", "value").dropna().join(links, "value").select("field_name", "record_id", "unit_id").distinct()


def _whole(seen: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give(seen)
    for batch in batches:
        rows = [(v, c, k) for v in batch.column("value").to_pylist() if len(c := clean(v).replace(" ", "")) >= 4 for k in sorted(block_keys(c)) if "|" in k]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["value", "text", "key"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ratio = [lcs_ratio(a, b) if slips(a, frozenset(a[:2]), b, _allowed(len(a))) <= _allowed(len(a)) else 0.0 for a, b in zip(batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)]
        yield pa.record_batch([batch.column("ta"), batch.column("tb"), pa.array(ratio, pa.float64())], names=["ta", "tb", "ratio"])


def variant_pairs(values: DataFrame, least: float = 0.8) -> DataFrame:
    """(a, b, ratio), a < b: different spellings, registered or not, that differ only by slips, by suffix blocks of the spellings.

    Spellings are compared in clean form, of which each enters once; those of one clean form are paired with its smallest
    only, so that their group follows without all pairs. Null, dummy and very short ones (under 4 characters) have none.
    """
    seen = prototypes()
    keyed = spread(values.select("value").dropna().distinct()).mapInArrow(lambda it: _whole(seen, it), "value string, text string, key string")
    low = keyed.groupBy("text").agg(F.min("value").alias("low"))
    texts = keyed.select("text", "key").distinct()
    left, right = texts.select(F.col("text").alias("ta"), "key"), texts.select(F.col("text").alias("tb"), "key")
    most = F.when(F.length("ta") < 8, 1).when(F.length("ta") < 13, 2).otherwise(3)
    near = (F.abs(F.length("ta") - F.length("tb")) <= most) & F.levenshtein("ta", "tb", 6).between(0, 2 * most)
    pairs = left.join(right, "key").where((F.col("ta") < F.col("tb")) & near).select("ta", "tb").distinct().mapInArrow(_alike, "ta string, tb string, ratio double").where(F.col("ratio") >= least)
    found = pairs.join(low.select(F.col("text").alias("ta"), F.col("low").alias("x")), "ta").join(low.select(F.col("text").alias("tb"), F.col("low").alias("y")), "tb").select("x", "y", "ratio")
    same = keyed.select("value", "text").distinct().join(low, "text").where("value <> low").select(F.col("low").alias("x"), F.col("value").alias("y"), F.lit(1.0).alias("ratio"))
    both = found.unionByName(same)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "ratio")
