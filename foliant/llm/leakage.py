"""Held-out passages in a corpus: a generalised suffix automaton of the test items, over which documents are streamed."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.text import U, code_points, fold, fold_str, gram_hash, pieces, row_of, spans_union, whole
from foliant.session import spread

#: Bits of the bitmap that says which grams can begin a match. 2**22 bits are 512 KB as bytes packed by numpy.
BITMAP_BITS = 22
#: Folded code points of test items in one automaton. More items are split over several, all of them streamed over in one pass.
ITEM_CHARS = 200_000
#: Folded code points of all items at most; their automata take some 100 bytes for each in every worker.
ALL_CHARS = 8_000_000
#: A match this long is a leak by itself, whatever share of its item it is.
LONG = 50


@dataclass
class Automaton:
    """A suffix automaton over all items as arrays: transitions sorted by (state, code point), suffix links, lengths.

    ``gram_items`` lists, for each state that holds a string of ``k`` code points, the items it occurs in.
    """

    k: int
    keys: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    bitmap: np.ndarray
    item_start: np.ndarray
    item_list: np.ndarray
    item_ids: np.ndarray
    item_grams: np.ndarray

    def step(self, state: np.ndarray, matched: np.ndarray, point: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams one code point into each of many matches: the longest suffix of it that occurs in an item."""
        state, matched = state.copy(), matched.copy()
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) << 21 | point[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[todo[hit]] = self.targets[at[hit]]
            matched[todo[hit]] += 1
            todo = todo[~hit]
            root = state[todo] == 0
            matched[todo[root]] = 0
            todo = todo[~root]
            state[todo] = self.link[state[todo]]
            matched[todo] = self.length[state[todo]]
        return state, matched


def build_automaton(items: list[tuple[int, str]], k: int) -> Automaton:
    """The automaton of folded items. Items with fewer than k code points have no gram and can't leak."""
    link, length, nxt = [-1], [0], [{}]
    where: list[int] = []  # the state after each position of an item
    owner: list[int] = []
    for number, (_, text) in enumerate(items):
        last = 0
        for char in map(ord, text):
            if char in nxt[last]:  # another item had this prefix
                q = nxt[last][char]
                if length[q] == length[last] + 1:
                    last = q
                else:
                    clone = len(link)
                    link.append(link[q]), length.append(length[last] + 1), nxt.append(dict(nxt[q]))
                    link[q] = clone
                    p = last
                    while p >= 0 and nxt[p].get(char) == q:
                        nxt[p][char] = clone
                        p = link[p]
                    last = clone
            else:
                cur = len(link)
                link.append(0), length.append(length[last] + 1), nxt.append({})
                p = last
                while p >= 0 and char not in nxt[p]:
                    nxt[p][char] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][char]
                    if length[q] == length[p] + 1:
                        link[cur] = q
                    else:
                        clone = len(link)
                        link.append(link[q]), length.append(length[p] + 1), nxt.append(dict(nxt[q]))
                        link[q] = link[cur] = clone
                        while p >= 0 and nxt[p].get(char) == q:
                            nxt[p][char] = clone
                            p = link[p]
                last = cur
            where.append(last)
            owner.append(number)
    links, lengths = np.array(link, np.int64), np.array(length, np.int64)
    links[0] = 0
    pairs = sorted((s << 21 | c, t) for s, out in enumerate(nxt) for c, t in out.items())
    keys = np.array([p[0] for p in pairs] or [-1], np.int64)
    targets = np.array([p[1] for p in pairs] or [0], np.int64)
    # the items of each gram: walk every item again and note the state that holds its last k code points
    texts = [text for _, text in items]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    begins = whole(bounds, k)
    states = []
    for a in begins:
        s = 0
        for c in points[a : a + k]:
            s = nxt[s][int(c)]
        states.append(s)
    pair = np.unique(np.stack([np.array(states, np.int64), row_of(bounds)[begins]]), axis=1) if len(begins) else np.zeros((2, 0), np.int64)
    item_start = np.searchsorted(pair[0], np.arange(len(links) + 1))
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[(gram_hash(points, k)[begins] >> U(64 - BITMAP_BITS)).astype(np.int64)] = True
    grams = np.bincount(pair[1], minlength=len(items))
    return Automaton(k, keys, targets, links, lengths, np.packbits(bitmap), item_start, pair[1], np.array([i for i, _ in items], np.int64), grams)


def stream(auto: Automaton, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram state, position of its end, length) wherever the longest match is at least k code points long; length is that
    of the longest match that ends there.

    A match of k or more begins with k code points that are a gram of an item, so only runs of positions that the
    bitmap lets through are streamed; the bitmap may let others through, which the automaton then rejects.
    """
    none = np.zeros(0, np.int64)
    begins = whole(bounds, auto.k)
    if not len(begins):
        return none, none, none, none
    slots = (gram_hash(points, auto.k)[begins] >> U(64 - BITMAP_BITS)).astype(np.int64)
    begins = begins[np.unpackbits(auto.bitmap).view(bool)[slots]]
    if not len(begins):
        return none, none, none, none
    rows = np.searchsorted(bounds, begins, "right") - 1
    fresh = np.ones(len(begins), bool)
    fresh[1:] = (np.diff(begins) > 1) | (np.diff(rows) > 0)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(begins)]]) - 1
    start, size, row = begins[first], begins[last] - begins[first] + auto.k, rows[first]
    order = np.argsort(-size, kind="stable")
    start, size, row = start[order], size[order], row[order]
    state, matched = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    out = []
    for t in range(int(size[0])):
        live = int(np.searchsorted(-size, -t, "left"))  # runs longer than t
        state[:live], matched[:live] = auto.step(state[:live], matched[:live], points[start[:live] + t].astype(np.int64))
        hit = np.flatnonzero(matched[:live] >= auto.k)
        if len(hit):
            s = state[hit].copy()
            while (up := auto.length[auto.link[s]] >= auto.k).any():
                s[up] = auto.link[s[up]]
            out.append((row[hit], s, start[hit] + t + 1, matched[hit]))
    if not out:
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shares(auto: Automaton, row: np.ndarray, state: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of an item, part of its grams) of the rows that hold enough of an item."""
    seen = np.unique(row << 40 | state)
    row, state = seen >> 40, seen & ((1 << 40) - 1)
    many = auto.item_start[state + 1] - auto.item_start[state]
    at = np.repeat(auto.item_start[state] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    pair, count = np.unique(np.repeat(row, many) << 32 | auto.item_list[at], return_counts=True)
    row, item = pair >> 32, pair & 0xFFFFFFFF
    ok = count >= share * auto.item_grams[item] - 1e-9
    return row[ok], item[ok], (count / auto.item_grams[item])[ok]


def _leaks(automata: list[Automaton], batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        points, bounds = fold(*code_points(batch.column("text")))
        for auto in automata:
            row, state, _, _ = stream(auto, points, bounds)
            row, item, part = _shares(auto, row, state, share)
            if len(row):
                yield pa.record_batch({"doc_id": batch.column("doc_id").take(pa.array(row)), "item_id": pa.array(auto.item_ids[item], pa.int64()), "share": pa.array(part, pa.float64())})


def folded_places(text: str) -> np.ndarray:
    """Where each folded code point of a text comes from: the place of its cluster; at the end, the length of the text."""
    out: list[int] = []
    at = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and (unicodedata.category(text[end])[0] == "M" or 0x1100 <= ord(text[end]) < 0x1200):
            end += 1
        out += [at] * len(fold_str(text[at:end]))
        at = end
    return np.array([*out, len(text)], np.int64)


def _spans(automata: list[Automaton], batches: Iterator[pa.RecordBatch], share: float, long: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        points, bounds = fold(*code_points(batch.column("text")))
        rows, starts, ends, sizes = [], [], [], []
        for auto in automata:
            row, state, end, size = stream(auto, points, bounds)
            if not len(row):
                continue
            leaked_row, leaked_item, _ = _shares(auto, row, state, share)
            leaked = np.unique(leaked_row << 32 | leaked_item)
            many = auto.item_start[state + 1] - auto.item_start[state]
            at = np.repeat(auto.item_start[state] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            hit = np.repeat(np.arange(len(row)), many)
            take = size >= long
            take[hit[np.isin(row[hit] << 32 | auto.item_list[at], leaked)]] = True
            rows.append(row[take]), starts.append((end - size)[take]), ends.append(end[take]), sizes.append(size[take])
        if not rows or not sum(map(len, rows)):
            continue
        row, start, end, size = (np.concatenate(x) for x in (rows, starts, ends, sizes))
        owner, a, b = spans_union(row, start, end)
        order = np.lexsort((start, row))
        heads = np.searchsorted((row[order] << 40) | start[order], (owner << 40) | a)
        longest = np.maximum.reduceat(size[order], heads)
        texts, docs = batch.column("text"), []
        for r in np.unique(owner).tolist():
            body = texts[r].as_py()
            places = folded_places(body)
            for i in np.flatnonzero(owner == r).tolist():
                x, y = a[i] - bounds[r], b[i] - bounds[r]
                y = min(int(y), len(places) - 1)
                docs.append((r, int(places[x]), int(places[y - 1]) + 1, int(longest[i])))
        yield pa.record_batch([batch.column("doc_id").take(pa.array([d[0] for d in docs])), *(pa.array([d[i] for d in docs], pa.int64()) for i in (1, 2, 3))], names=["doc_id", "start", "end", "longest"])


def _prepared(documents: DataFrame, items: DataFrame, k: int, doc_id: str, text: str, item_id: str, item_text: str):
    """The documents' id and text, and the broadcast automata of the items."""
    wanted = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna().distinct()
    if (wanted.agg(F.sum(F.length("t"))).first()[0] or 0) > ALL_CHARS:
        raise ValueError(f"items of more than {ALL_CHARS} code points: find leaks in several calls")
    folded = sorted((r.i, fold_str(r.t)) for r in wanted.toLocalIterator())
    groups: list[list[tuple[int, str]]] = [[]]
    size = 0
    for one in folded:
        if size and size + len(one[1]) > ITEM_CHARS:
            groups.append([])
            size = 0
        groups[-1].append(one)
        size += len(one[1])
    source = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).dropna())
    return source, documents.sparkSession.sparkContext.broadcast([build_automaton(g, k) for g in groups])


def leaked_items(documents: DataFrame, items: DataFrame, k: int = 10, share: float = 0.3, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, share): documents that hold at least ``share`` of an item's distinct k-character sequences.

    Texts are folded (NFKC, lower case, letters, ideographs and digits only). Items are a bounded set (ALL_CHARS): they are
    built into automata of at most ITEM_CHARS code points, all of which each document is streamed over in one pass. Documents
    are never shuffled. Null or empty texts, and items shorter than k, give no row; rows repeated whole count once;
    a text given under several doc_ids is reported for each. Null ids are dropped. Other columns don't matter.
    """
    source, shared = _prepared(documents, items, k, doc_id, text, item_id, item_text)
    found = source.mapInArrow(lambda it: _leaks(shared.value, it, share), "doc_id long, item_id long, share double")
    return found.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def leaked_spans(documents: DataFrame, items: DataFrame, k: int = 10, share: float = 0.3, long: int = LONG, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, start, end, longest): where in the text as it stands test items leak; half-open places in code points.

    A span is a run of matches of k or more folded code points, each as long as it goes, that belong to an item of which
    the document holds at least ``share``, or are ``long`` by themselves; longest is the longest match in it. For other
    cases see ``leaked_items``; a repeated row gives its spans once, several texts of one id those of each.
    """
    source, shared = _prepared(documents, items, k, doc_id, text, item_id, item_text)
    return source.mapInArrow(lambda it: _spans(shared.value, it, share, long), "doc_id long, start long, end long, longest long").distinct()


def without_leaks(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, removed): every document with the spans of ``leaked_spans`` cut out, and how many code points went.

    Texts stay where they are read unless a document has spans; a null text stays null. Ids should be unique.
    """
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    source = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(cuts, "doc_id", "left")
    begin = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    kept = F.aggregate("cuts", begin, lambda acc, c: F.struct(F.concat(acc["kept"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int"))).alias("kept"), c["end"].alias("at")))
    rest = source.withColumn("_k", kept).withColumn("_t", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.concat("_k.kept", F.substr(F.col("text"), (F.col("_k.at") + 1).cast("int")))))
    return rest.select("doc_id", F.col("_t").alias("text"), (F.length("text") - F.length("_t")).cast("long").alias("removed"))
