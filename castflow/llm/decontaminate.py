"""Benchmark decontamination: spans of documents that are near an item of a benchmark.

A span counts if the weighted Jaccard similarity of its multiset of five-word shingles with the item's is at least
``least``, a shingle weighing its letters.  Such a span shares shingles of at least that share of the item's weight, so an
index of the items' shingles finds all of them: no window, fingerprint or radius decides.  Of each document and item with
enough shared weight all spans from a shared shingle to a shared shingle are measured; others are never the best.
An item of fewer words is one shingle and must stand there word by word.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castflow.llm import common as C

#: Items whose index a pass over the documents holds; more items take more passes.
MAX_ITEMS = 5000
#: Bits of a hash that a quick look-up knows.
QUICK = 22
#: Words are runs of letters and digits, once ``plain`` has made all other characters blanks; Han, Kana and Thai characters are words.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def plain(text: Column) -> Column:
    """Lower case, runs of anything but letters, their marks and digits of any script made one blank."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, length) of each word."""
    starts, ends, rows = C.word_spans(data, offsets, _APART)
    return C.hash_spans(data, starts, ends), rows, ends - starts


def shingles(hashes: np.ndarray, lengths: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, letters, first word) of each run of k words of a row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total, letters = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    for j in range(k):
        total += hashes[j : n + j] * C.salt(j)
        letters += lengths[j : n + j]
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return C.mix(total[at]), letters[at], at


class Index:
    """The shingles of some items, by the words of a shingle."""

    def __init__(self, items: list[tuple[int, str]], shingle_words: int):
        self.items, self.classes = [], {}
        found: dict[int, list] = {}
        for item_id, text in items:
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes, rows, lengths = _words(raw, np.array([0, len(raw)]))
            if not len(hashes):
                continue
            k = min(shingle_words, len(hashes))
            own: Counter = Counter()
            for h, letters in zip(*(x.tolist() for x in shingles(hashes, lengths, rows, k)[:2]), strict=True):
                own[h] += letters
            found.setdefault(k, []).extend((h, len(self.items)) for h in own)
            self.items.append((item_id, own, sum(own.values())))
        for k, pairs in found.items():
            values, item = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])
            order = np.argsort(values, kind="stable")
            there = np.zeros(1 << QUICK, bool)
            there[(values >> np.uint64(64 - QUICK)).astype(np.int64)] = True
            self.classes[k] = there, values[order], item[order]
        self.weights = np.array([w for _, _, w in self.items], np.int64)

    def shared(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which hash, item) of all hashes that are a shingle of an item."""
        there, values, item = self.classes[k]
        hit = np.flatnonzero(there[(hashes >> np.uint64(64 - QUICK)).astype(np.int64)])
        lo, hi = np.searchsorted(values, hashes[hit], "left"), np.searchsorted(values, hashes[hit], "right")
        return np.repeat(hit, hi - lo), item[np.arange(int((hi - lo).sum())) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]


def best_span(names: list[int], letters: list[int], before: list[int], after: list[int], own: Counter, weight: int, least: float) -> tuple[float, int] | None:
    """(similarity, which shared shingle comes first) of the best span between shared shingles of a document, the first of equals.

    before and after: the letters of all the document's shingles before each shared one, and up to its end.
    """
    best, n = None, len(names)
    left = np.cumsum([0, *letters]).tolist()
    end = 0
    for i in range(n):
        while end < n and after[end] - before[i] <= weight / least + 1e-6:
            end += 1
        if left[end] - left[i] < least * weight - 1e-6:  # not even all of them are enough
            continue
        seen: dict[int, int] = {}
        both = 0
        for j in range(i, end):
            had = seen.get(names[j], 0)
            seen[names[j]] = had + letters[j]
            both += min(own[names[j]], had + letters[j]) - min(own[names[j]], had)
            similarity = both / max(1, weight + after[j] - before[i] - both)
            if similarity >= least and (best is None or similarity > best[0]):
                best = similarity, i
    return best


def _matches(hashes: np.ndarray, rows: np.ndarray, lengths: np.ndarray, index: Index, least: float) -> dict[tuple[int, int], tuple[float, int]]:
    """(row, item) -> (similarity, first word) of the best place of each item in each row."""
    first = np.searchsorted(rows, np.arange(rows[-1] + 1))
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for k in index.classes:
        names, letters, at = shingles(hashes, lengths, rows, k)
        total = np.concatenate([[0], np.cumsum(letters)])
        which, item = index.shared(k, names)
        if not len(which):
            continue
        row = rows[at[which]]
        order = np.lexsort((which, item, row))
        which, item, row = which[order], item[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
        stop = np.append(start[1:], len(which))
        enough = np.add.reduceat(letters[which], start) >= least * index.weights[item[start]] - 1e-6
        for a, b in zip(start[enough].tolist(), stop[enough].tolist(), strict=True):
            some = which[a:b]
            _, own, weight = index.items[item[a]]
            found = best_span(names[some].tolist(), letters[some].tolist(), total[some].tolist(), total[some + 1].tolist(), own, weight, least)
            if found:
                best[int(row[a]), int(item[a])] = found[0], int(at[some[found[1]]] - first[row[a]])
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word): the items of benchmark(item_id, text) that docs(doc_id, text) hold, at their best place.

    Words are runs of letters and digits of any script, whatever marks stand between them; each Han, Kana or Thai character is
    a word.  Null and empty texts, of either table, and texts without letters or digits match nothing.  Rows without an id are
    left out.  Of rows that repeat an id or a pair the best place counts once.  The benchmark is read in slices of at most
    MAX_ITEMS items, each of which is compared with all documents.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), plain(F.col("text")).alias("text"))
    slices = max(1, -(-items.count() // MAX_ITEMS))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), plain(F.col("text")).alias("text"))
    found = None
    with C.Scratch(docs.sparkSession) as held:
        numbered = held.save(C.ranked(items, [], [F.col("item_id"), F.col("text")], held).select("rank", "item_id", "text"), "items")
        parts = [numbered.where((F.col("rank") >= k * MAX_ITEMS) & (F.col("rank") < (k + 1) * MAX_ITEMS)) for k in range(slices)]
        indexes = [Index([(r.item_id, r.text) for r in some.select("item_id", "text").collect()], shingle_words) for some in parts]  # at most MAX_ITEMS rows each
    for index in indexes:

        def run(batch, index=index):
            data, offsets = C.texts_of(batch.column("text"))
            ids = batch.column("doc_id")
            for row, end, part, at in C.chunks(data, offsets):
                hashes, of, lengths = _words(part, at)
                best = sorted(_matches(hashes, of, lengths, index, least).items()) if len(hashes) else []
                if best:
                    columns = [ids.take(pa.array([row + r for (r, _), _ in best])), pa.array([index.items[i][0] for (_, i), _ in best], pa.int64()), pa.array([s for _, (s, _) in best], pa.float64()), pa.array([w for _, (_, w) in best], pa.int64())]
                    yield pa.record_batch(columns, ["doc_id", "item_id", "similarity", "start_word"])

        more = C.per_batch(rows, run, "doc_id long, item_id long, similarity double, start_word long")
        found = more if found is None else found.unionByName(more)
    best = F.max(F.struct("similarity", (-F.col("start_word")).alias("place"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.place")).alias("start_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, least: float = 0.8) -> DataFrame:
    """docs without the rows whose document holds an item; all columns stay."""
    return docs.join(leaks(docs, benchmark, shingle_words, least).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
