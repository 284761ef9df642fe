"""Oversized texts as ordered pieces under a token limit, cut at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.tokens import MULTILINGUAL, ByteTokens, load
from foliant.session import spread

#: What a piece may end at, strongest first; the end of the text is "end".
KINDS = ("heading", "paragraph", "table row", "sentence", "clause", "character")
#: Half-width of the window around a target in which the strongest boundary is sought first, as a share of the limit.
SNAP = 0.15

_FIRM = KINDS.index("sentence")
_LINE = re.compile(r"\r\n|\r|\n| | ")
_HEADING = re.compile(r"[\s　]*(?:#{1,6}\s|第[一二三四五六七八九十百\d]+[章节条部分]|[一二三四五六七八九十]+、|（[一二三四五六七八九十]+）|\d+(?:\.\d+)*[ .、．]\s*[^\d\s])")
_ROW = re.compile(r"[\s　]*\[表格行\d+\]")
_SENTENCE = re.compile(r"[。！？!?；;…]+[”’」』）)\]】》]*|\.(?=\s)")
_CLAUSE = re.compile(r"[，,、：:|]+|[\s　]+")
_LONG_HEADING = 60
#: Marks after which a text always splits before a letter.
_SAFE_AFTER = np.zeros(1 << 16, bool)
_SAFE_AFTER[[ord(c) for c in "\n，。；：、！？…（）《》【】“”|,.;:!?()[]{}<>/=+*%#"]] = True


def boundaries(text: str) -> np.ndarray:
    """For each place between characters the strongest kind of boundary there (an index of KINDS)."""
    kind = np.full(len(text) + 1, KINDS.index("character"), np.int8)
    for found in _CLAUSE.finditer(text):
        kind[found.end()] = KINDS.index("clause")
    for found in _SENTENCE.finditer(text):
        kind[found.end()] = KINDS.index("sentence")
    starts = [0, *(found.end() for found in _LINE.finditer(text)), len(text)]
    for a, b in zip(starts[1:-1], starts[2:], strict=True):
        line = text[a:b]
        row = _ROW.match(line)
        head = len(line.strip()) <= _LONG_HEADING and _HEADING.match(line) and not row
        kind[a] = KINDS.index("heading" if head else "table row" if row else "paragraph")
    kind[len(text)] = 0
    return kind


class Counter:
    """Tokens of any part of one text, without tokenizing it again: only from its two ends to the next safe places.

    A place is safe if whatever stands before it can't change how the text splits there: after a punctuation mark of a
    fixed set, or a line feed, and before an ideograph or an ASCII letter.
    """

    def __init__(self, text: str, tokenizer: ByteTokens):
        self.text, self.tokenizer = text, tokenizer
        self.before = tokenizer.tokens_before(text)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        left, right = points[:-1], points[1:]
        letter = (right >= 0x4E00) & (right <= 0x9FFF) | (right >= 65) & (right <= 90) | (right >= 97) & (right <= 122)
        self.safe = np.flatnonzero(_SAFE_AFTER[np.minimum(left, 0xFFFF)] & letter) + 1
        self.known: dict[str, int] = {}

    def _few(self, a: int, b: int) -> int:
        part = self.text[a:b]
        if part not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[part] = self.tokenizer.count([part])[0]
        return self.known[part]

    def count(self, start: int, end: int) -> int:
        i, j = np.searchsorted(self.safe, (start, end))
        if i >= j or self.safe[j - 1] <= start:
            return self._few(start, end)
        p, q = (start if start == 0 else int(self.safe[i])), int(self.safe[j - 1])
        if end == len(self.text):
            q = end
        return (self._few(start, p) if p > start else 0) + int(self.before[q] - self.before[p]) + (self._few(q, end) if q < end else 0)

    def reach(self, start: int, limit: int) -> int:
        """The farthest end at which the part from start has at most ``limit`` tokens; at least one character."""
        last = len(self.text)
        end = max(start + 1, int(np.searchsorted(self.before, self.before[start] + limit, "right")) - 1)
        while end > start + 1 and (over := self.count(start, end) - limit) > 0:
            end = max(start + 1, min(end - 1, int(np.searchsorted(self.before, self.before[end] - over, "left"))))
        while end < last and self.count(start, end + 1) <= limit:
            end += 1
        return end


def cut(text: str, limit: int, overlap: int, tokenizer: ByteTokens) -> list[tuple[int, int, int, str]]:
    """(start, end, tokens, kind of its end) of the pieces of a text that isn't blank.

    A piece ends at a sentence or something stronger wherever one ends in its new part. Under this rule the least number
    of pieces that the rest of the text needs is known for every such place; each end snaps to the strongest place near
    its equal target from which the rest still fits into the pieces that are left. Each piece begins where the last
    ``overlap`` tokens before its predecessor's end begin (at the next character, where a token splits one). Pieces hold
    the limit as they are, tokenized by themselves; where that makes more of them necessary, they are compared with
    those that end as far on as they can, and the fewer are taken.
    """
    if len(text) <= limit // 4:  # at most 4 bytes, and so at most 4 tokens, a character
        return [(0, len(text), tokenizer.count([text])[0], "end")]
    counter = Counter(text, tokenizer)
    before = counter.before
    total = int(before[-1])
    if total <= limit:
        return [(0, len(text), total, "end")]
    kind = boundaries(text)
    firm = np.flatnonzero(kind[1:] <= _FIRM) + 1
    clauses = np.flatnonzero(kind == KINDS.index("clause"))
    firm_tokens = before[firm].astype(np.int64)
    step = limit - overlap

    def after(base: int, known: np.ndarray) -> int:
        """Pieces from a start at ``base`` tokens on, if those after each firm end are known."""
        if total - base <= limit:
            return 1
        i = int(np.searchsorted(firm_tokens, base + limit, "right"))
        low = int(np.searchsorted(firm_tokens, base + overlap, "right"))
        if i > low:
            return 1 + int(known[i - 1])
        blank = max(1, -(-(int(firm_tokens[low]) - base - limit) // step))  # pieces without a firm end
        i = int(np.searchsorted(firm_tokens, base + blank * step + limit, "right"))
        return blank + 1 + int(known[max(i - 1, low)])

    rest = np.zeros(len(firm), np.int64)  # pieces needed after each firm end; the last is the end of the text
    far = np.searchsorted(firm_tokens, firm_tokens - overlap + limit, "right") - 1
    for b in range(len(firm) - 2, -1, -1):
        rest[b] = 1 + rest[far[b]] if far[b] > b else after(int(firm_tokens[b]) - overlap, rest)

    def walk(balanced: bool) -> list[tuple[int, int, int, str]]:
        out: list[tuple[int, int, int, str]] = []
        start = reach = 0
        left = fewest
        while reach < len(text):
            base = int(before[start])
            if total - base <= limit + 8 and (size := counter.count(start, len(text))) <= limit:
                out.append((start, len(text), size, "end"))
                break
            most = counter.reach(start, limit)
            if most <= reach:  # the overlap alone fills the limit
                start, most = reach, counter.reach(reach, limit)
            left = max(left, 2)
            want = base + (total - base + (left - 1) * overlap) / left
            low, high = np.searchsorted(firm, (reach, most), "right")
            if high > low:
                fits = np.arange(low, high)[rest[low:high] <= left - 1] if balanced else np.arange(0)
                if not len(fits):
                    fits = np.arange(high - 1, high)
                near = fits[np.abs(firm_tokens[fits] - want) <= SNAP * limit]
                best = near[kind[firm[near]] == kind[firm[near]].min()] if len(near) else fits
                pick = int(best[np.argmin(np.abs(firm_tokens[best] - want))])
                while pick > low and counter.count(start, int(firm[pick])) > limit:
                    pick -= 1
                end, left = int(firm[pick]), max(left - 1, int(rest[pick]))
            else:
                end = most
                if balanced:
                    some = clauses[np.searchsorted(clauses, reach, "right") : np.searchsorted(clauses, most, "right")]
                    some = some[np.abs(before[some] - want) <= SNAP * limit]
                    end = int(some[np.argmin(np.abs(before[some] - want))]) if len(some) else min(max(int(np.searchsorted(before, want)), reach + 1), most)
                    if after(int(before[end]) - overlap, rest) > left - 1:
                        end = most
                left = max(left - 1, after(int(before[end]) - overlap, rest))
            size = counter.count(start, end)
            while size > limit and end > reach + 1:
                end -= 1
                size = counter.count(start, end)
            out.append((start, end, size, KINDS[kind[end]]))
            reach = end
            start = int(np.searchsorted(before, before[end] - overlap)) if overlap else end
            start = min(max(start, out[-1][0] + 1), end)
        return out

    fewest = after(0, rest)
    out = walk(True)
    if len(out) > fewest:  # what tokens of its own a piece takes at its ends made it fail; the farthest ends need no more
        out = min(out, walk(False), key=len)
    return out


def _cut_all(path: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None or not text.strip("﻿ 　​\t\r\n\f\v ") or not text.strip():
                    continue
                for number, (start, end, tokens, kind) in enumerate(cut(text, limit, overlap, tokenizer)):
                    rows.append((key, number, start, end, tokens, kind, text[start:end]))
                    size += end - start
                if size > 500_000:
                    yield _batch(rows, batch.schema.field("doc_id").type)
                    rows, size = [], 0
            yield _batch(rows, batch.schema.field("doc_id").type)

    return run


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["doc_id", "piece_no", "start", "end", "n_tokens", "ends_at", "text"])


def split_texts(documents: DataFrame, limit: int = 512, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", tokenizer: str = MULTILINGUAL) -> DataFrame:
    """(doc_id, piece_no, start, end, n_tokens, ends_at, text): each text in order, in pieces of at most ``limit`` tokens.

    start and end are half-open places in code points. Texts within the limit are one piece; null and blank texts give none. A repeated
    row gives its pieces again; a null id is kept as it is. The tokenizer is a byte-level vocabulary (.tiktoken), as places of tokens are needed.
    Nothing is shuffled: a text is cut where it is read.
    """
    if not 0 <= overlap < limit or limit < 8:
        raise ValueError("the limit must be at least 8 tokens and more than the overlap")
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return spread(source).mapInArrow(_cut_all(tokenizer, limit, overlap), f"doc_id {kind}, piece_no int, start long, end long, n_tokens int, ends_at string, text string")
