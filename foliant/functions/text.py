"""Text as columns: normal forms, grams, fingerprints, similarities, parsed amounts and dates. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as both Spark's and other engines' regular expressions should see it.
SPACE = r"[\s 　]"
ROW_MARK = r"\[表格行\d+\]"


def squeeze(text: Column) -> Column:
    """For retrieval: table-row marks and all white space removed."""
    return F.regexp_replace(F.regexp_replace(text, ROW_MARK, ""), SPACE + "+", "")


def strip(text: Column) -> Column:
    """White space of any kind removed at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def compare_form(text: Column, prefix: str = r"^(?:[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+[.、．])") -> Column:
    """For comparison: a leading number of a heading dropped, letters, ideographs and digits kept, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(strip(text), prefix, ""), r"[^\p{L}\p{N}]", ""))


def gram_list(text: Column, n: int) -> Column:
    """All n-grams of characters in order; the whole text if it is shorter, none if it is empty.

    One scan with a look-ahead that consumes nothing. A lambda over positions would hold the text's whole expression
    and evaluate it again for each of them.
    """
    many = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    size = F.length(text)
    return F.when(size >= n, many).when(size > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def grams(text: Column, n: int) -> Column:
    """Distinct n-grams, by first occurrence."""
    return F.array_distinct(gram_list(text, n))


def fingerprint32(text: Column) -> Column:
    """The first 32 bits of the MD5 digest as a number."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def high_half(hex64: Column) -> Column:
    return F.conv(F.substring(hex64, 1, 8), 16, 10).cast("long")


def low_half(hex64: Column) -> Column:
    return F.conv(F.substring(hex64, 9, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes in hexadecimal; 64 where either isn't one."""
    valid = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    count = F.bit_count(high_half(a).bitwiseXOR(high_half(b))) + F.bit_count(low_half(a).bitwiseXOR(low_half(b)))
    return F.when(valid, count).otherwise(F.lit(64)).cast("int")


def clean_html(text: Column) -> Column:
    """Tags dropped, the five common entities replaced, runs of space squeezed, ends trimmed."""
    out = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return strip(F.regexp_replace(out, SPACE + "+", " "))


def keywords(text: Column, separators: str = "[;；,，、]") -> Column:
    """The trimmed, non-empty parts between separators."""
    return F.filter(F.transform(F.split(text, separators), strip), lambda x: x != "")


def title_words(text: Column, stop: Sequence[str] = (), most: int = 5) -> Column:
    """Runs of 2 to 8 ideographs that aren't stop words, the first few."""
    found = F.regexp_extract_all(text, F.lit(r"[一-鿿]{2,8}"), F.lit(0))
    return F.slice(F.filter(found, lambda x: ~x.isin(list(stop))) if stop else found, 1, most)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over those of the smaller set; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y))), F.lit(0.0))


def phrase_similarity(a: Column, b: Column) -> Column:
    """0.7 × Jaccard of bigrams + 0.3 × Jaccard of characters; 0.98 where one holds the other; 0 if either is empty."""
    chars = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    mixed = 0.7 * jaccard(grams(a, 2), grams(b, 2)) + 0.3 * jaccard(chars(a), chars(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.98).otherwise(mixed)


def prefix_similarity(a: Column, b: Column) -> Column:
    """Leading characters two codes share, over the longer code's length."""
    longest = F.greatest(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), acc + 1).otherwise(acc))
    return F.when(longest > 0, F.when(F.least(F.length(a), F.length(b)) > 0, same / longest).otherwise(0.0)).otherwise(0.0)


def subject_prefixes(code: Column) -> Column:
    """The levels of a subject code: its first 3, 5 and 7 digits, as far as it goes."""
    return F.array_distinct(F.filter(F.array(*(F.when(F.length(code) >= n, F.substring(code, 1, n)) for n in (3, 5, 7))), lambda x: x.isNotNull()))


def subject_similarity(a: Column, b: Column) -> Column:
    """A ladder by shared levels: equal 1, seven digits .9, five .55, three .2, one .15, else 0."""
    same = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.substring(a, 1, n) == F.substring(b, 1, n))
    return F.when(a == b, 1.0).when(same(7), 0.9).when(same(5), 0.55).when(same(3), 0.2).when(same(1), 0.15).otherwise(0.0)


def grade(score: Column) -> Column:
    return F.when(score >= 9, "A").when(score >= 8, "B").when(score >= 6, "C").when(score >= 4, "D").otherwise("E")


def amount_in_ten_thousands(text: Column) -> Column:
    """The first amount of money in a text, in units of ten thousand; null if there is none."""
    number = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(亿元|万元|元)", 1)
    unit = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*(亿元|万元|元)", 2)
    value = F.try_to_number(number, F.lit("999999999999.999999")).cast("double")
    return F.when(unit == "亿元", value * 10000).when(unit == "万元", value).when(unit == "元", value / 10000)


def month_ordinal(year: Column, month: Column) -> Column:
    return year * 12 + month - 1


def parse_date(text: Column, formats: Sequence[str] = ("yyyy-MM-dd", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日", "yyyyMMdd", "yyyy-MM")) -> Column:
    """The date in the first format that fits."""
    return F.coalesce(*(F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats))


def year_of(text: Column) -> Column:
    """A year between 1900 and 2099 in any spelling, full-width digits included."""
    plain = F.translate(text, "０１２３４５６７８９", "0123456789")
    return F.regexp_extract(plain, r"((?:19|20)\d{2})", 1).try_cast("int")


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers; 0 where either is all zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


#: What people type where they have nothing to say.
DUMMY = ("", "无", "暂无", "待定", "-", "—", "——", "/", "n/a", "null", "none")
#: A number of a heading or list item, in front of what it numbers.
NUMBERING = r"^[（(]?[一二三四五六七八九十\d]+[）)、.．]\s*"


def effective(text: Column) -> Column:
    """The trimmed text, empty where it is null or only stands for nothing."""
    plain = strip(F.coalesce(text, F.lit("")))
    return F.when(F.lower(plain).isin(*DUMMY), "").otherwise(plain)


def canonical(label: Column, aliases: dict[str, str]) -> Column:
    """A label without its number and white space; of several spellings of one thing the first form."""
    plain = F.regexp_replace(F.regexp_replace(strip(label), NUMBERING, ""), SPACE + "+", "")
    known = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), plain)


def weighted_text(parts: Sequence[tuple[Column, int]]) -> Column:
    """Parts joined by spaces, each as often as it weighs; empty ones leave no trace."""
    return F.concat_ws(" ", F.filter(F.flatten(F.array(*(F.array_repeat(effective(c), n) for c, n in parts))), lambda x: x != ""))


def repaired(text: Column) -> Column:
    """Words broken at line ends joined again, blank lines reduced to one, spaces before a line end dropped."""
    out = F.regexp_replace(text, r"([A-Za-z])-\r?\n([a-z])", "$1$2")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+(\r?\n)", "$1"), r"(\r?\n){3,}", "\n\n")


def valid_mail(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), F.lit(False))


def valid_phone(text: Column) -> Column:
    """A mobile number, or a landline with its area code."""
    return F.coalesce(text.rlike(r"^(1[3-9]\d{9}|0\d{2,3}-?\d{7,8})$"), F.lit(False))


def valid_identity(text: Column) -> Column:
    """An 18-digit identity number with the right check character."""
    weights = F.array(*(F.lit(2 ** (17 - i) % 11) for i in range(17)))
    digits = F.transform(F.sequence(F.lit(1), F.lit(17)), lambda i: F.substr(text, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.zip_with(digits, weights, lambda d, w: d * w), F.lit(0), lambda a, x: a + x)
    check = F.substr(F.lit("10X98765432"), (total % 11) + 1, F.lit(1))
    return F.coalesce(F.when(text.rlike(r"^\d{17}[\dXx]$"), check == F.upper(F.substring(text, 18, 1))), F.lit(False))


def key_phrases(text: Column, least: int = 6, most: int = 6) -> Column:
    """The first trimmed parts between stops that are long enough."""
    return F.slice(F.filter(F.transform(F.split(text, r"[；;。\r\n]"), strip), lambda x: F.length(x) >= least), 1, most)


def coverage(phrases: Column, text: Column) -> Column:
    """Share of phrases that a text contains; 0 without phrases."""
    return F.coalesce(F.try_divide(F.size(F.filter(phrases, lambda x: F.contains(text, x))).cast("double"), F.size(phrases)), F.lit(0.0))


def unit_words(name: Column) -> Column:
    """The parts of a unit's name between brackets, signs and legal forms, of at least two characters."""
    parts = F.split(name, r"[()（）\s,，、\-]|股份有限公司|有限责任公司|有限公司|集团")
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) >= 2))


def passage_tokens(text: Column, most: int = 120) -> Column:
    """Distinct words between separators and bigrams of ideographs, words first, the first ``most``."""
    words = F.filter(F.split(F.lower(text), r"[\s　，。；：、！？,.;:!?()（）\[\]【】|/]+"), lambda x: x != "")
    pairs = F.regexp_extract_all(text, F.lit(r"(?=([一-鿿]{2}))"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(words, pairs)), 1, most)


def question_terms(text: Column) -> Column:
    """Years, and runs of ideographs with their parts of four, three and two, longest first."""
    years = F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2})"), F.lit(1))
    runs = F.regexp_extract_all(text, F.lit(r"([一-鿿]{2,})"), F.lit(1))
    slices = [F.regexp_extract_all(text, F.lit(rf"(?=([一-鿿]{{{n}}}))"), F.lit(1)) for n in (4, 3, 2)]
    return F.array_distinct(F.concat(years, runs, *slices))


def topic_key(label: Column) -> Column:
    """A label as a key: without what follows a colon or bracket, white space and signs, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(label, r"[:：(（].*$", ""), r"[\s　_\-·]+", ""))


def simple_title(title: Column) -> Column:
    """A title for comparison: letters, ideographs and digits in lower case, without common openings and closings."""
    plain = F.lower(F.regexp_replace(title, r"[^\p{L}\p{N}]", ""))
    return F.regexp_replace(F.regexp_replace(plain, r"^(关于|基于|面向)", ""), r"(的研究|研究|的应用|应用)$", "")


def period_months(text: Column) -> Column:
    """Months of a period of execution: from one year and month to another, both included, else a stated number of years or months."""
    span = r"((?:19|20)\d{2})[年.\-/](\d{1,2})月?\s*(?:至|到|~|—|-|－)+\s*((?:19|20)\d{2})[年.\-/](\d{1,2})"
    part = lambda i: F.regexp_extract(text, span, i).try_cast("int")
    between = month_ordinal(part(3), part(4)) - month_ordinal(part(1), part(2)) + 1
    years = F.regexp_extract(text, r"(\d{1,2})\s*(?:年期|个?年(?:内|度)?完成)", 1).try_cast("int") * 12
    months = F.regexp_extract(text, r"(\d{1,3})\s*个月", 1).try_cast("int")
    return F.coalesce(between, years, months)


def milestones(text: Column) -> Column:
    """The year and month of every date in a text, as yyyy-mm, distinct and in order."""
    found = F.regexp_extract_all(text, F.lit(r"((?:19|20)\d{2}年\d{1,2}月)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.concat(F.substring(x, 1, 4), F.lit("-"), F.lpad(F.regexp_extract(x, r"年(\d{1,2})月", 1), 2, "0")))))


def years_between(begin: Column, finish: Column) -> Column:
    """Whole months between two dates, over 12."""
    return F.floor(F.months_between(finish, begin)) / 12.0


def tens(score: Column) -> Column:
    return (F.floor(score / 10) * 10).cast("int")


def row_fields(cells: Column) -> Column:
    """Cells of a table row as a map of keys and the values beside them; of a repeated key the first value counts."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(cells) / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.try_element_at(cells, 2 * i + 1).alias("key"), F.try_element_at(cells, 2 * i + 2).alias("value")))
    valid = F.filter(pairs, lambda p: (F.coalesce(p["key"], F.lit("")) != "") & p["value"].isNotNull())
    keys = F.array_distinct(F.transform(valid, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(valid, lambda p: p["key"] == k), 1)["value"].alias("value"))))


def fenced_object(text: Column) -> Column:
    """The first object of an answer that may stand in a code fence; empty if there is none."""
    inside = F.regexp_replace(text, r"```[A-Za-z]*", "")
    return F.regexp_extract(inside, r"(?s)(\{.*\})", 1)


def topic_tokens(label: Column, most: int = 8) -> Column:
    """The first words of a label between signs, of at least two characters."""
    return F.slice(F.filter(F.split(F.lower(label), r"[\s　,，、;；/|·\-_()（）]+"), lambda x: F.length(x) >= 2), 1, most)
