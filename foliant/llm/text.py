"""Columnar text primitives: code points, folding, gram hashes. All work on whole Arrow batches with numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

U = np.uint64
SLOW = 0xFFFFFFFF
_LIMIT = 0x30000
_BASE = U(0x9E3779B97F4A7C15)


def fold_str(text: str) -> str:
    """Compatibility forms unified (NFKC), lower case, and only letters, ideographs and digits kept."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).lower() if c.isalnum())


@cache
def fold_table() -> np.ndarray:
    """What each code point folds to: a code point, 0 for none, SLOW if it depends on its neighbours or gives several."""
    table = np.zeros(_LIMIT + 1, np.uint32)
    for point in range(_LIMIT):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        if unicodedata.category(char)[0] == "M" or 0x1100 <= point < 0x1200:
            table[point] = SLOW
            continue
        kept = fold_str(char)
        table[point] = ord(kept) if len(kept) == 1 else SLOW if kept else 0
    table[_LIMIT] = SLOW
    return table


def code_points(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows end to end, and where each row begins (one more than rows). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return points, starts[bounds - bounds[0]]


def fold(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """fold_str of every row, on code points."""
    mapped = fold_table()[np.minimum(points, _LIMIT)]
    slow = mapped == SLOW
    if slow.any():
        rows = np.unique(np.searchsorted(bounds, np.flatnonzero(slow), "right") - 1)
        parts, at = [], 0
        sizes = None
        lens = np.diff(bounds)
        keep = (mapped != 0) & ~slow
        kept = np.concatenate([[0], np.cumsum(keep)])
        sizes = kept[bounds[1:]] - kept[bounds[:-1]]
        for row in rows:
            a, b = bounds[row], bounds[row + 1]
            parts.append(mapped[at:a][keep[at:a]])
            done = np.frombuffer(fold_str(points[a:b].tobytes().decode("utf-32-le")).encode("utf-32-le"), np.uint32)
            parts.append(done)
            sizes[row] = len(done)
            at = b
        parts.append(mapped[at:][keep[at:]])
        del lens
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
    keep = mapped != 0
    kept = np.zeros(len(points) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return mapped[keep], kept[bounds]


def gram_hash(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive code points (rows are not told apart; see whole())."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        have, size, out, done = points.astype(U) + U(1), 1, None, 0
        power = _BASE
        left = k
        while left:  # hashes of doubling length, put together by the bits of k
            if left & 1:
                part = have[done : done + n]
                out = part.copy() if out is None else out * power + part
                done += size
            left >>= 1
            if left:
                have = have[: len(have) - size] * power + have[size:]
                power = power * power
                size *= 2
        out ^= out >> U(31)
        out *= U(0xBF58476D1CE4E5B9)
        out ^= out >> U(27)
        out *= U(0x94D049BB133111EB)
        out ^= out >> U(31)
    return out


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each position."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def whole(bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions at which k code points of one row begin."""
    if not len(bounds) or bounds[-1] < k:
        return np.zeros(0, np.int64)
    ok = np.ones(bounds[-1] - k + 1, bool)
    lens = np.diff(bounds)
    ends = bounds[1:][lens > 0]
    tails = (ends[:, None] - np.arange(1, k)[None, :]).ravel()
    starts = np.repeat(bounds[:-1][lens > 0], k - 1)
    tails = tails[(tails >= starts) & (tails < len(ok))]
    ok[tails] = False
    return np.flatnonzero(ok)


def pieces(batches: Iterator[pa.RecordBatch], text: str, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about so many bytes of text, or one row. This bounds a worker's memory."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
        total = np.cumsum(sizes)
        at = 0
        while at < len(sizes):
            base = total[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(total, base + 3 * chars, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def spans_union(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each owner's half-open spans; spans that touch or overlap are one run."""
    if not len(owner):
        return owner, start, end
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    fresh = np.ones(len(owner), bool)
    group = np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
    shift = group * (int(end.max()) + 2)  # makes one running maximum serve all owners
    reach = np.maximum.accumulate(end + shift)
    fresh[1:] = (start[1:] + shift[1:]) > reach[:-1]
    heads = np.flatnonzero(fresh)
    return owner[heads], start[heads], (np.maximum.reduceat(end + shift, heads) - shift[heads])
