"""Form residue, filler and system messages: a regularised linear classifier on hashed n-grams of short windows.

Weak labels come from phrases. A bounded sample of labelled records trains a logistic regression whose features are
hashed character n-grams, n-grams of character classes, the record's length, and its beginning and end (marked, so that
titles and field names count by their place). The score of a record is that of its highest window, so residue in the
middle of a long text counts as much as a text that consists of it. The threshold is set on records of groups
(documents, units) that training never saw, and quality is measured on those of others that neither saw.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.text import U, code_points, pieces
from foliant.session import Stash, spread

#: Bounds of the sample that training reads, lowest hashes of the texts first: records without residue, records with it,
#: and records looked at for their weak label.
SAMPLE, SAMPLE_RESIDUE, LOOKED_AT = 12_000, 6_000, 200_000
#: Code points that a text gives to the sample at most: around its phrase, or at a place that follows from its hash.
EXCERPT = 4000
#: Code points in a window, bits of a feature's hash, share of groups held out to set the threshold, and to measure.
WINDOW, BITS, HELD_OUT, MEASURED = 16, 18, 0.15, 0.10
START, END = 2, 3

# Phrases of residue, as weak labels. Placeholders, hints and failed fields of forms and office documents:
PLACEHOLDERS = (
    r"\$\{\w+\}", r"\{\{\s*\w+\s*\}\}", r"\{%\s*\w+\s*%\}", r"<%=?\s*\w+\s*%>", r"@@\w+@@", r"%[A-Z][A-Z0-9_]+%", r"«[^»]{1,20}»", r"#[一-鿿]{2,6}#", r"MERGEFIELD", r"<!--[^>]{0,20}待补充",
    r"TODO[：:]", r"【请[^】]{1,16}】", r"\[在此[^\]]{1,16}\]", r"请在此(?:输入|填写|插入)", r"(?:单击|点击)此处", r"Click or tap", r"此处填写", r"填写时请删除", r"限\d+字以内", r"（必填）", r"_{2,}年_+月", r"(?<![A-Za-z])X{4}(?![A-Za-z])", r"XX市XX",
    r"×{3,}", r"某某(?:单位|部门)", r"错误[！!]\s*未(?:找到引用源|定义书签)", r"#(?:REF|VALUE|NAME|DIV/0|NULL|N/A)[!?]?", r"[：:](?:xxx|填写|待填|待补|……|（内容）)\d*(?:[；;]|$)",
)
#: Filler:
FILLER = (r"测试(?:一下|内容|数据)\d+", r"先占个位", r"随便写点", r"这里是正文这里", r"示例文字示例", r"文本占位文本", r"样例段落\d", r"段落\d+ 段落", r"(?P<char>[^\s_0-9.])(?P=char){7,}", r"(?:测试){4,}", r"(?:asdf){3,}", r"(?P<word>[一-鿿]{2,4})(?P=word){4,}", r"^x{5,}$", r"\b(?:sit|amet|sed|quis|magna|tempor|veniam|dolor|ipsum|lorem|aliqua|nostrud|eiusmod|consectetur)\b[a-z ,.]+\b(?:sit|amet|sed|quis|magna|tempor|veniam|dolor|ipsum|lorem|aliqua|nostrud|eiusmod|consectetur)\b", r"^[a-z]{1,12}(?: [a-z]{1,12}){5,} ?$")
#: Error and access messages, and notices that scripts or another client are needed:
MESSAGES = (
    r"HTTP Status \d", r"<title>\d{3} ", r"Bad Gateway|Gateway Time-?out|Internal Server Error|Service Unavailable|404 Not Found|403 Forbidden", r"Access denied", r"无法访问此网站", r"CONNECTION_RESET", r"Something went wrong", r"Exception at line", r"您要找的内容走丢了", r"接口返回为空", r"该链接已过期", r"SQLSTATE\[", r"您的请求过于频繁", r"您访问的页面不存在", r"登录已超时，", r"文档已加密，无法", r"文件可能已损坏", r"验证码已失效", r"附件转换超时", r"您没有权限",
    r"首页 > ", r"正文未能载入", r"系统繁忙", r"请稍后再试", r"OCR失败", r"JavaScript 支持", r"启用JavaScript", r"enable JavaScript", r"enable scripts", r"启用脚本", r"脚本支持", r"阻止了页面脚本", r"依赖脚本", r"Just a moment", r"版本过低", r"<noscript>", r"JavaScript is disabled", r"允许运行脚本", r"不支持脚本", r"正文未显示",
)

_PLAIN = re.compile(r"(?=[$&{<@%«#MT【\[请单点C此填限（_X×某错：:测先随这示文样段HBGISNFA无您登验附首正系O支启ea阻依J版不允该接脚E\d])(?:" + "|".join((*PLACEHOLDERS, *MESSAGES, *FILLER[:8])) + ")")
_MONOTONE = re.compile("|".join(FILLER[8:]))
_BLANK = frozenset(("", "无", "暂无", "待定", "-", "——", "/", "N/A", "null", "None"))


def weak_span(text: str) -> tuple[int, int] | None:
    """Where a phrase of residue lies, if any does. Repetitions are only sought in texts of few characters or in ASCII alone."""
    found = _PLAIN.search(text)
    if not found and (text.isascii() or len(set(text)) * 3 < len(text)):
        found = _MONOTONE.search(text)
    return found.span() if found else None


def _classes(points: np.ndarray) -> np.ndarray:
    """Characters by class: ideographs, lower and upper case and digits are one each, others stand for themselves."""
    out = points.copy()
    out[(points >= 0x4E00) & (points <= 0x9FFF)] = 0x4E00
    out[(points >= 97) & (points <= 122)] = 97
    out[(points >= 65) & (points <= 90)] = 65
    out[(points >= 48) & (points <= 57)] = 48
    return out


def features(points: np.ndarray) -> np.ndarray:
    """(4, n): the hashed features that begin at each position: n-grams of 1 to 3, and of 4 classes."""
    with np.errstate(over="ignore"):
        p = np.where((points >= 48) & (points <= 57), 48, points).astype(U)
        c = _classes(points).astype(U)
        n = len(points)
        pad = np.zeros(3, U)
        p, c = np.concatenate([p, pad]), np.concatenate([c, pad])
        a, b, d = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
        one = p[:n] + U(1 << 40)
        two = p[:n] * a + p[1 : n + 1] + U(2 << 40)
        three = (p[:n] * a + p[1 : n + 1]) * b + p[2 : n + 2] + U(3 << 40)
        four = ((c[:n] * a + c[1 : n + 1]) * b + c[2 : n + 2]) * d + c[3 : n + 3] + U(4 << 40)
        out = np.stack([one, two, three, four])
        out ^= out >> U(29)
        out *= U(0xBF58476D1CE4E5B9)
        return (out >> U(64 - BITS)).astype(np.int32)


#: How many features of each kind lie wholly within a window of WINDOW.
_REACH = (1, 2, 3, 4)


def _marked(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row between a start and an end mark, and filled up to a window with end marks."""
    sizes = np.diff(bounds)
    wide = np.maximum(sizes + 2, WINDOW)
    edges = np.concatenate([[0], np.cumsum(wide)])
    out = np.full(edges[-1], END, np.uint32)
    at = np.repeat(edges[:-1] + 1 - bounds[:-1], sizes) + np.arange(len(points))
    out[at] = points
    out[edges[:-1]] = START
    return out, edges


def _length_slot(sizes: np.ndarray) -> np.ndarray:
    return (1 << BITS) + np.minimum(np.log2(sizes + 1).astype(np.int64), 15)


@dataclass
class Residue:
    """The trained model: weights (the last 16 are of lengths), bias, threshold, and what it reached on unseen groups."""

    weights: np.ndarray
    bias: float
    threshold: float
    report: dict[str, float]

    def windows(self, points: np.ndarray) -> np.ndarray:
        """The score of the window at each position of marked text."""
        f = features(points)
        total = np.zeros(max(0, len(points) - WINDOW + 1))
        for kind, reach in enumerate(_REACH):
            run = np.concatenate([[0.0], np.cumsum(self.weights[f[kind]], dtype=np.float64)])
            take = WINDOW - reach + 1
            total += run[take : take + len(total)] - run[: len(total)]
        return total

    def scores(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of each row, and where in the marked rows its highest window begins."""
        if len(bounds) == 1:
            return np.zeros(0), np.zeros(0, np.int64)
        marked, edges = _marked(points, bounds)
        each = self.windows(marked)
        owner = np.repeat(np.arange(len(edges) - 1), np.diff(edges) - WINDOW + 1)
        starts = edges[:-1][owner] + np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(np.diff(edges) - WINDOW + 1)[:-1]]), np.diff(edges) - WINDOW + 1)
        order = np.lexsort((each[starts], owner))
        last = np.searchsorted(owner, np.arange(len(edges) - 1), "right") - 1
        best = starts[order[last]]
        return each[best] + self.bias + self.weights[_length_slot(np.diff(bounds))], best


def _window_features(marked: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    f = features(marked)
    cols = [f[kind][starts[:, None] + np.arange(WINDOW - reach + 1)] for kind, reach in enumerate(_REACH)]
    return np.concatenate([*cols, _length_slot(sizes)[:, None]], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, steps: int, ridge: float = 1e-5, rate: float = 0.15) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, classes weighted to balance, by adaptive gradient steps."""
    flat, width = x.ravel(), x.shape[1]
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum()))
    g2, gb2 = np.full(len(w), 1e-8), 1e-8
    for _ in range(steps):
        z = w[flat].reshape(-1, width).sum(1) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        grad = np.bincount(flat, np.repeat(error, width), len(w)) + ridge * w
        g2 += grad * grad
        gb2 += error.sum() ** 2
        w = w - rate * grad / np.sqrt(g2)
        b = b - rate * error.sum() / np.sqrt(gb2)
    return w, b


def _in_parts(model: Residue, points: np.ndarray, bounds: np.ndarray, size: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """The scores and best windows of many rows, a part at a time; windows by their place in all marked rows."""
    score, best, shift = [], [], 0
    for a in range(0, len(bounds) - 1, size):
        own = bounds[a : a + size + 1]
        s, w = model.scores(points[own[0] : own[-1]], own - own[0])
        score.append(s), best.append(w + shift)
        shift += int(np.maximum(np.diff(own) + 2, WINDOW).sum())
    return np.concatenate(score or [np.zeros(0)]), np.concatenate(best or [np.zeros(0, np.int64)])


def train(texts: list[str], groups: list[str], rounds: int = 3, steps: int = 40) -> Residue:
    """The model from weakly labelled texts; some groups are held out whole to set the threshold, and others to measure."""
    spans = [weak_span(t) for t in texts]
    if not any(spans):  # nothing to learn from: nothing is residue
        return Residue(np.zeros((1 << BITS) + 16), 0.0, float("inf"), {"held_out": 0, "residue": 0.0, "precision": 1.0, "recall": 1.0})
    y = np.array([s is not None for s in spans], float)
    place = np.array([zlib.crc32(g.encode()) % 1000 / 1000 for g in groups])
    held, measured = place < HELD_OUT, (place >= HELD_OUT) & (place < HELD_OUT + MEASURED)
    points, bounds = code_points(pa.array(texts, pa.string()))
    marked, edges = _marked(points, bounds)
    sizes = np.diff(bounds)
    model = Residue(np.zeros((1 << BITS) + 16), 0.0, 0.0, {})
    fit = np.flatnonzero(~held & ~measured)
    rng = np.random.default_rng(7)
    room = np.diff(edges) - WINDOW
    middle = np.array([(s[0] + s[1]) // 2 + 1 - WINDOW // 2 if s else 0 for s in spans])
    rows, starts = [], []
    for shift in (-4, 0, 4):  # a phrase is met at several places of a window
        pos = fit[y[fit] > 0]
        rows.append(pos), starts.append(edges[pos] + np.clip(middle[pos] + shift, 0, room[pos]))
    neg = fit[y[fit] == 0]
    for _ in range(2):
        rows.append(neg), starts.append(edges[neg] + (rng.random(len(neg)) * (room[neg] + 1)).astype(np.int64))
    w, b = model.weights, 0.0
    for _ in range(rounds):
        r, s = np.concatenate(rows), np.concatenate(starts)
        w, b = _fit(_window_features(marked, s, sizes[r]), y[r], w, b, steps)
        model = Residue(w, b, 0.0, {})
        best = _in_parts(model, points, bounds)[1] if len(texts) else np.zeros(0, np.int64)
        rows.append(neg), starts.append(best[neg])  # the windows most like residue in texts without any
    score = _in_parts(model, points, bounds)[0]
    test = np.flatnonzero(held) if held.any() and y[held].any() else np.arange(len(y))
    order = test[np.argsort(-score[test], kind="stable")]
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + y[order].sum())
    top = np.flatnonzero(f1 >= f1.max() - 1e-12) if len(f1) else np.zeros(1, int)
    cut = int(top[len(top) // 2]) if len(f1) else 0
    below = score[order[cut + 1]] if cut + 1 < len(order) else score[order[cut]] - 2
    model.threshold = float((score[order[cut]] + below) / 2)
    seen = np.flatnonzero(measured) if y[measured].any() else test
    hit = score[seen] > model.threshold
    model.report = {"held_out": len(seen), "residue": float(y[seen].sum()), "precision": float((y[seen] * hit).sum() / max(1, hit.sum())), "recall": float((y[seen] * hit).sum() / max(1, y[seen].sum()))}
    return model


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label, parts = [], []
        for h, text in zip(batch.column("h").to_pylist(), batch.column("value").to_pylist(), strict=True):
            span = weak_span(text)
            room = max(0, len(text) - EXCERPT)
            at = min(room, max(0, (span[0] + span[1] - EXCERPT) // 2)) if span else h % (room + 1)
            label.append(span is not None), parts.append(text[at : at + EXCERPT])
        yield pa.record_batch([pa.array(label, pa.bool_()), batch.column("h"), pa.array(parts, pa.string()), batch.column("grp")], names=["residue", "h", "value", "grp"])


def _score(model: Residue, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "value", 300_000):
        score, _ = model.scores(*code_points(batch.column("value")))
        hit = np.flatnonzero(score > model.threshold)
        take = pa.array(hit)
        yield pa.record_batch([batch.column("field_name").take(take), batch.column("record_id").take(take), pa.array(score[hit] - model.threshold)], names=["field_name", "record_id", "margin"])


def grouped_values(fields: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """{column: (table, id column, group column)} → field_name, record_id, value, grp. Null, blank and dummy values left out."""
    out: DataFrame | None = None
    for column, (table, key, group) in fields.items():
        part = table.select(F.lit(column).alias("field_name"), F.col(key).cast("string").alias("record_id"), F.col(column).alias("value"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp"))
        out = part if out is None else out.unionByName(part)
    return out.where(F.col("record_id").isNotNull() & F.col("value").isNotNull() & ~F.trim(F.regexp_replace("value", r"[\s 　]+", "")).isin(sorted(_BLANK)))


def fit_residue(values: DataFrame, stash: Stash | None = None) -> Residue:
    """Trains on a sample within the bounds above: texts whose hash is below a cut that follows from their number."""
    stash = stash or Stash(values.sparkSession)
    total = max(1, values.count())
    scale = 1 << 40
    hashed = spread(values.select("value", "grp").withColumn("h", F.pmod(F.xxhash64("value"), F.lit(scale))))
    looked = hashed.where(F.col("h") < int(scale * min(1.0, LOOKED_AT / total)))
    labelled = stash.keep(looked.mapInArrow(_label, "residue boolean, h long, value string, grp string").distinct(), "labelled")
    rows = []
    for label, limit in ((True, SAMPLE_RESIDUE), (False, SAMPLE)):
        own = labelled.where(F.col("residue") == label)
        cut = int(scale * min(1.0, LOOKED_AT / total) * min(1.0, limit / max(1, own.count())))
        rows += own.where(F.col("h") < cut).select("value", "grp").collect()
    stash.drop(labelled)
    rows = sorted({(r.value, r.grp) for r in rows})
    return train([v for v, _ in rows], [g for _, g in rows])


def residue_records(values: DataFrame, model: Residue | None = None) -> DataFrame:
    """(field_name, record_id, margin) of records that hold residue, or consist of it. margin: how far beyond the threshold.

    Null, blank and dummy values are no cases; repeated rows count once; texts are scored whole, whatever their length.
    Without any labelled residue nothing is found.
    """
    model = model or fit_residue(values)
    shared = values.sparkSession.sparkContext.broadcast(model)
    found = spread(values.select("field_name", "record_id", "value")).mapInArrow(lambda it: _score(shared.value, it), "field_name string, record_id string, margin double")
    return found.groupBy("field_name", "record_id").agg(F.max("margin").alias("margin"))
