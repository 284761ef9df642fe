"""Visually identical text in one consistent form: script sets of tokens, look-alikes, and compatibility forms."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import spread

#: Scripts whose letters are seen as another's where a whole token looks so; of any other script only in mixed tokens.
CASED = frozenset(("CYRILLIC", "GREEK", "COPTIC", "ARMENIAN", "CHEROKEE", "LISU"))
#: A look-alike that the data lacks.
ADDED = {"Ԛ": "Q"}
#: Lower-case Greek letters that stand for a Latin one by themselves; others are symbols unless Latin letters are beside them.
GREEK_ALONE = frozenset("νοϳ")
#: Katakana that look like an ideograph.
KANA = dict(zip("エカタチトニハロメ", "工力夕千卜二八口乂", strict=True))
#: Letters that are content, whatever they look like.
CONTENT = frozenset("αβμ")
#: Hyphens, dashes and minus signs.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
#: Radicals of the supplement block and their ideographs; the older radicals have compatibility decompositions.
RADICALS = dict(
    zip(
        "⺁⺅⺉⺊⺌⺎⺖⺘⺙⺜⺝⺟⺠⺡⺣⺧⺨⺩⺫⺬⺭⺮⺰⺶⺹⺻⺽⺾⻁⻂⻄⻅⻆⻈⻉⻋⻌⻐⻑⻓⻔⻕⻗⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻭⻮⻯⻰⻱⻲⻳",
        "厂亻刂卜小兀忄扌攵日月母民氵灬牛犭王目示礻竹纟羊耂聿臼艹虎衤西见角讠贝车辶钅長长门阜雨青韦页风飞食马骨鬼鱼鸟卤麦黄黾齐歯齿竜龙龜亀龟",
        strict=True,
    )
)

_PLAIN = re.compile(r"[ -~一-鿿²³¹⁰⁴-⁹₀-₉αβμ、。《》“”‘’；！？·]*")
_RAISED = frozenset("²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉")
_TOKEN = re.compile(r"[^\W\d_⺀-鿿豈-﫿\U00020000-\U0003ffff](?:[^\W\d_⺀-鿿豈-﫿\U00020000-\U0003ffff]|[̀-ͯ])*")
_KANA_IN_HAN = re.compile(f"(?<=[一-鿿])[{''.join(KANA)}](?![ぁ-ヿ])|(?<![ぁ-ヿ])[{''.join(KANA)}](?=[一-鿿])")


def invisible(char: str) -> bool:
    """Format characters, variation selectors, fillers and controls other than white space."""
    point = ord(char)
    kind = unicodedata.category(char)
    return kind == "Cf" or (kind == "Cc" and char not in "\t\n\r\f\v") or 0xFE00 <= point <= 0xFE0F or 0xE0100 <= point <= 0xE01EF or 0x180B <= point <= 0x180F or point in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)


_given: dict[str, str] = {}


def give(table: dict[str, str]) -> None:
    """In a worker: the confusables data that the driver has read."""
    _given.update(table)


@cache
def prototypes() -> dict[str, str]:
    """What each character of the public Unicode confusables data looks like, read from the ICU library among Spark's jars,
    which the driver has; workers are given it.

    Layout: a header with the places of three tables; keys (code point, and length of what it looks like less one), then for
    each key a code unit, or where its string begins, then the strings; all big-endian.
    """
    if _given:
        return _given
    places = [*Path(pyspark.__file__).parents, Path(os.environ.get("SPARK_HOME", "/nowhere"))]
    jars = [jar for place in places for jar in sorted(place.glob("jars/icu4j-[0-9]*.jar"))]
    if not jars:
        raise FileNotFoundError("Spark's jars hold no icu4j, whose confusables data this needs")
    with zipfile.ZipFile(jars[-1]) as jar:
        raw = jar.read(next(n for n in jar.namelist() if n.endswith("/confusables.cfu")))
    body = raw[struct.unpack(">H", raw[:2])[0] :]
    keys_at, keys, index_at, _, text_at, units = struct.unpack(">6i", body[12:36])
    text = body[text_at : text_at + 2 * units]
    out = {}
    for key, unit in zip(struct.unpack(f">{keys}I", body[keys_at : keys_at + 4 * keys]), struct.unpack(f">{keys}H", body[index_at : index_at + 2 * keys]), strict=True):
        size = (key >> 24) + 1
        out[chr(key & 0xFFFFFF)] = chr(unit) if size == 1 else text[2 * unit : 2 * (unit + size)].decode("utf-16-be")
    return out


def script(char: str) -> str:
    """The script of a letter, by its Unicode name; Common for content and what is no letter."""
    if char in CONTENT or not char.isalpha():
        return "Common"
    return unicodedata.name(char, "OTHER").split(" ")[0]


@cache
def lookalikes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """(letter → the ASCII letter it looks like; ASCII letter → script → the letter of that script that looks like it).

    A look that several ASCII letters share (I, l) goes by case; caseless scripts have the looks of capitals.
    """
    seen = prototypes()
    ascii_of: dict[str, list[str]] = defaultdict(list)
    for x in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        ascii_of[seen.get(x, x)].append(x)
    latin: dict[str, str] = dict(ADDED)
    back: dict[str, dict[str, str]] = defaultdict(dict)
    letters = {c: p for c, p in seen.items() if c.isalpha() and p in ascii_of and not c.isascii() and not unicodedata.decomposition(c)}
    for c in sorted(letters):
        options = ascii_of[letters[c]]
        own = [x for x in options if x.islower() == c.islower()] or options
        kind = script(c)
        if kind in ("Common", "CJK", "HANGUL", "HIRAGANA", "KATAKANA") or kind == "LATIN" and ord(c) < 0x180 and c != "ı":
            continue
        latin[c] = own[0]
        if c.islower() == own[0].islower():
            back[own[0]].setdefault(kind, c)
    for point in (*range(0x1D00, 0x1D26), *range(0x0250, 0x02B0), 0xA730, 0xA731):  # small capitals, by their names
        name = unicodedata.name(chr(point), "")
        if re.fullmatch("LATIN LETTER SMALL CAPITAL [A-Z]", name):
            latin[chr(point)] = name[-1]
    return latin, dict(back)


def scripts_of(char: str) -> frozenset[str]:
    """The scripts in which a letter can be spelled with the same look: its own, and those of its look-alikes."""
    latin, back = lookalikes()
    own = script(char)
    out = {own}
    if char in latin:
        out.add("LATIN")
    return frozenset(out | set(back.get(latin.get(char, char), ())))


def _to_latin(char: str) -> str:
    latin, _ = lookalikes()
    return char if char in CONTENT else latin.get(char, char)


def consistent(token: str, elsewhere: bool = True) -> str:
    """The token in the one script that spells all of its letters: Latin where it can, else another of its own; as it is if none can.

    A mixed token becomes Latin, and so does one wholly in look-alikes, unless nothing ``elsewhere`` in its text is of
    another script. Marks and content letters go with any script.
    """
    letters = [c for c in token if not unicodedata.combining(c) and script(c) != "Common"]
    if not letters or token.isascii():
        return token
    own = {script(c) for c in letters}
    common = frozenset.intersection(*map(scripts_of, letters))
    if "LATIN" in common:
        if own == {"LATIN"} or len(own) > 1:
            return "".join(map(_to_latin, token))
        kind = next(iter(own))
        symbols = kind == "GREEK" and all(c.islower() and c not in GREEK_ALONE for c in letters)
        return "".join(map(_to_latin, token)) if elsewhere and kind in CASED and not symbols else token
    _, back = lookalikes()
    for name in sorted(common & own - {"LATIN"}):
        return "".join(c if script(c) in (name, "Common") else back.get(_to_latin(c), {}).get(name, c) for c in token)
    return token


@lru_cache(1 << 16)
def _plain_char(char: str) -> str:
    if char in _RAISED:
        return char
    if invisible(char):
        return ""
    if char in DASHES:
        return "-"
    if unicodedata.category(char) in ("Zs", "Zl", "Zp") or char in "\t\n\r\f\v":
        return " "
    if char in RADICALS:
        return RADICALS[char]
    parts = unicodedata.decomposition(char).split()
    if not parts:
        return char
    if parts[0].startswith("<"):
        parts = parts[1:]
    return "".join(_plain_char(chr(int(p, 16))) for p in parts)


def _elsewhere(token: str, text: str) -> bool:
    """Whether a text has letters of another script than a token's, and no word that only that script can spell."""
    own = {script(c) for c in token if script(c) != "Common"}
    if len(own) != 1 or own == {"LATIN"}:
        return True
    latin, _ = lookalikes()
    kinds = {script(c) for c in text if c.isalpha() and c not in CONTENT}
    return bool(kinds - own) and not any(script(c) in own and c not in latin for c in text)


def plain_form(text: str) -> str:
    """The form that all spellings of one look share.

    Compatibility forms are replaced by what they stand for, raised and lowered digits excepted; invisible characters go;
    all spaces and dashes are the ASCII ones; look-alike letters take the script of their token, and a token wholly of look-alikes
    that of its surroundings; accents are composed.
    """
    if _PLAIN.fullmatch(text):
        return text
    text = "".join(map(_plain_char, text))
    parts = unicodedata.normalize("NFD", text)
    text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: consistent(m[0], _elsewhere(m[0], parts)), parts))
    return _KANA_IN_HAN.sub(lambda m: KANA[m[0]], text)


def _forms(seen: dict[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    give(seen)
    for batch in batches:
        names, ids, values = [], [], []
        for field, key, value in zip(*(batch.column(c).to_pylist() for c in ("field_name", "record_id", "value")), strict=True):
            plain = plain_form(value)
            if plain != value:
                names.append(field), ids.append(key), values.append(plain)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(values, pa.string())], names=["field_name", "record_id", "plain_form"])


def values_of(fields: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """{column: (table, id column)} → (field_name, record_id, value); rows repeated whole, null ids and null values left out."""
    out: DataFrame | None = None
    for column, (table, key) in fields.items():
        part = table.select(F.lit(column).alias("field_name"), F.col(key).cast("string").alias("record_id"), F.col(column).cast("string").alias("value")).dropna()
        out = part if out is None else out.unionByName(part)
    return out


def not_plain(values: DataFrame) -> DataFrame:
    """(field_name, record_id, plain_form) of the values that are not stored in plain form, once each.

    Empty values are plain. A record with several different values gives a row for each of them that isn't plain.
    """
    seen = prototypes()
    return spread(values).mapInArrow(lambda it: _forms(seen, it), "field_name string, record_id string, plain_form string").distinct()
