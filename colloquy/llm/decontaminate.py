"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap.

Test items are indexed once: postings by term in item order, cut at the same
items for every term into blocks that carry their largest score.  An item's scores are divided by the score the item
gets for its own words, so one threshold fits all items.  Items are classed by
length: up to 64 words, 128, 256 and so on.  For each class every training text
is cut into passages of twice the class's length, half of each shared with the
next, so any item's worth of words lies whole in a passage; every passage is a
query.  How far apart an item's words may lie depends on its own length alone.  The block maxima of a passage's terms, added up by block for all passages
of a text at once, bound every score in the block; blocks under the threshold
are passed over, and within the others WAND, which skips by the terms' maxima
in the block, returns all items above it.  A hit counts
when the item's question (all but its last sentence; the first two thirds of a
single sentence) and its answer (the rest) both have at least ``overlap`` of
their word trigrams in the passage or the half passages beside it.

Statistics (number of items, document frequencies, mean length) are
those of all items, counted in Spark.  The index is sent to every task, so its
size is bounded: items with more than about ``max_postings`` postings in all are
dealt to several indexes, each of which reads the documents once; since the
statistics are shared, results don't depend on it.

Defined cases: null or empty texts and items match nothing; repeated items each
match; an item without an id matches under a null id; repeated rows each get
their rows; a null doc_id is a value like others; with no items nothing matches;
an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, strings

K1, B = 1.2, 0.75
#: Items in a block, unless the table of block maxima (terms by blocks) would pass MAX_CELLS.
BLOCK, MAX_CELLS = 4, 8_000_000
#: Words of the items of the first class; every further class holds items of up to twice as many.
FIRST_CLASS = 64
#: Postings of an index, which is sent to every task.
MAX_POSTINGS = 2_000_000
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    parts = [w for w in (WORD.findall(s.lower()) for s in SENTENCE.split(text.strip())) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    cut = (2 * len(words) + 2) // 3
    return words[:cut], words[cut:]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def stride_of(words: int) -> int:
    """Half a passage for an item of so many words: the length of its class."""
    return max(FIRST_CLASS, 1 << (words - 1).bit_length())


class Statistics:
    """Of all items that have words: their number, their mean length, and in how many each word occurs."""

    def __init__(self, items: int, mean: float, df: dict[str, int]):
        self.items, self.mean, self.df = items, mean, df


class ItemIndex:
    """Inverted index of items of one class, with block maxima and scores relative to an item's own.

    ``statistics`` covers more items where this index holds a part of them; by default it is that of the items given.
    A passage is as long as the longest of the items needs.
    """

    def __init__(self, items: list[tuple[int | None, str]], statistics: Statistics | None = None):
        split = [(i, *split_item(t or "")) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))]
        split = [x for x in split if x[1] or x[2]]
        self.ids = [x[0] for x in split]
        self.parts = [(grams(q), grams(a)) for _, q, a in split]
        tf = [Counter(q + a) for _, q, a in split]
        size = [sum(c.values()) for c in tf]
        if statistics is None:
            statistics = Statistics(len(tf), sum(size) / max(1, len(size)), Counter(w for c in tf for w in c))
        idf = {w: math.log(1 + (statistics.items - n + 0.5) / (n + 0.5)) for w, n in statistics.df.items()}
        raw = [{w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * s / statistics.mean)) for w, n in c.items()} for c, s in zip(tf, size)]
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, scores in enumerate(raw):
            own = sum(scores.values())
            for w, s in scores.items():
                postings[w].append((i, s / own))
        self.terms = {w: k for k, w in enumerate(sorted(postings))}
        self.items = [[i for i, _ in postings[w]] for w in self.terms]
        self.scores = [[s for _, s in postings[w]] for w in self.terms]
        self.size = max(BLOCK, -(-len(split) * (len(self.terms) + 1) // MAX_CELLS))
        self.maxima = np.zeros((len(self.terms) + 1, -(-len(split) // self.size)), np.float32)
        for k, (p, q) in enumerate(zip(self.items, self.scores)):
            for i, x in zip(p, q):
                # rounded up, so that the sum stays a bound
                self.maxima[k, i // self.size] = max(self.maxima[k, i // self.size], np.nextafter(np.float32(x), np.float32(np.inf)))
        self.most = np.append(self.maxima[:-1].max(1), np.float32(0)) if len(split) else np.zeros(1, np.float32)
        self.stride = stride_of(max(size, default=0))

    def wand(self, terms: list[int], threshold: float, block: int) -> list[tuple[int, float]]:
        """All items of the block whose score for the distinct terms is at least the threshold."""
        end, most = (block + 1) * self.size, self.maxima[:, block]
        at = {t: bisect_left(self.items[t], block * self.size) for t in terms if most[t] > 0}
        out = []

        def item(t):
            p = self.items[t]
            return p[at[t]] if at[t] < len(p) and p[at[t]] < end else end

        live = list(at)
        while True:
            live = sorted((t for t in live if item(t) < end), key=item)
            total, pivot = 0.0, None
            for t in live:
                total += most[t]
                if total >= threshold - 1e-9:
                    pivot = item(t)
                    break
            if pivot is None:
                return out
            if item(live[0]) == pivot:
                here = [t for t in live if item(t) == pivot]
                s = sum(self.scores[t][at[t]] for t in here)
                if s >= threshold - 1e-12:
                    out.append((pivot, s))
                for t in here:
                    at[t] += 1
            else:
                for t in live:
                    if item(t) < pivot:
                        at[t] = bisect_left(self.items[t], pivot, at[t])

    def passages(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int, np.ndarray]]:
        """(start, stop, blocks that can reach the threshold) of a text's passages, where there are such blocks."""
        starts = np.arange(0, max(1, len(ids) - self.stride), self.stride)
        stops = np.minimum(starts + 2 * self.stride, len(ids))
        reach = np.concatenate([[0.0], np.cumsum(self.most[ids], dtype=np.float64)])
        ok = reach[stops] - reach[starts] >= threshold - 1e-6
        starts, stops, out = starts[ok], stops[ok], []
        some = max(1, 2_000_000 // (2 * self.stride * max(1, self.maxima.shape[1])))
        none = len(self.terms)
        for a in range(0, len(starts), some):
            # (passage, term) pairs, each once
            pairs = np.unique(np.concatenate([ids[i:j][ids[i:j] != none] + (k << 32) for k, (i, j) in enumerate(zip(starts[a : a + some], stops[a : a + some]))]))
            of = pairs >> 32
            firsts = np.flatnonzero(np.diff(of, prepend=-1))
            bound = np.add.reduceat(self.maxima[pairs & 0xFFFFFFFF], firsts, axis=0)
            for row, n in zip(*np.nonzero(bound.max(1, keepdims=True) >= threshold - 1e-4)):
                k = a + int(of[firsts[row]])
                out.append((starts[k], stops[k], np.flatnonzero(bound[row] >= threshold - 1e-4)))
        return out

    def search(self, text: str, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        """(item id, score, overlap of question, of answer): the verified items, each with its best passage."""
        return self.search_words(WORD.findall(text.lower()), threshold, overlap)

    def search_words(self, words: list[str], threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
        none = len(self.terms)
        ids = np.fromiter((self.terms.get(w, none) for w in words), np.int64, len(words))
        if not len(ids) or not none:
            return []
        out: dict[int, tuple[float, float, float]] = {}
        for a, b, blocks in self.passages(ids, threshold):
            terms = [int(t) for t in np.unique(ids[a:b]) if t != none]
            found = [(i, x) for block in blocks for i, x in self.wand(terms, threshold, int(block))]
            if not found:
                continue
            near = words[max(0, a - self.stride) : b + self.stride]
            have = {n: {tuple(near[i : i + n]) for i in range(len(near) - n + 1)} for n in (1, 2, 3)}
            for i, x in found:
                shares = [sum(g in have[len(g)] for g in part) / len(part) if part else 1.0 for part in self.parts[i]]
                if min(shares) >= overlap:
                    out[i] = max(out.get(i, (0.0, 0.0, 0.0)), (x, *shares))
        return [(self.ids[i], *out[i]) for i in sorted(out)]


def search(indexes: list[ItemIndex], text: str, threshold: float, overlap: float) -> list[tuple[int, float, float, float]]:
    """What the indexes of all classes find in a text."""
    words = WORD.findall(text.lower())
    return [x for index in indexes for x in index.search_words(words, threshold, overlap)]


def indexes(benchmark: DataFrame, max_postings: int = MAX_POSTINGS) -> Iterator[list[ItemIndex]]:
    """An index for each class, with about ``max_postings`` postings together at most, built one lot at a time, over the statistics of all items."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")

    def cut(batches):
        for b in batches:
            said = [[w for part in split_item(t) for w in part] for t in strings(b["text"])]
            yield pa.RecordBatch.from_arrays([b["item_id"], b["text"], pa.array([len(x) for x in said], pa.int64()), pa.array([sorted(set(x)) for x in said], pa.list_(pa.string()))], names=["item_id", "text", "n", "terms"])

    items = stored(rows.mapInArrow(cut, "item_id long, text string, n long, terms array<string>").where("n > 0"))
    count, mean, postings = items.agg(F.count(F.lit(1)), F.avg("n"), F.sum(F.size("terms"))).first()
    parts = max(1, math.ceil((postings or 0) / max_postings))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    df = items.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    for k in range(parts if count else 0):
        mine = items.where(part == k)
        own = df if parts == 1 else df.join(mine.select(F.explode("terms").alias("w")).distinct(), "w", "left_semi")
        got, known = mine.select("item_id", "text", "n").toArrow(), own.toArrow()
        statistics, classes = Statistics(count, mean, dict(zip(known["w"].to_pylist(), known["df"].to_pylist()))), defaultdict(list)
        for i, t, n in zip(*(got[c].to_pylist() for c in ("item_id", "text", "n"))):
            classes[stride_of(n)].append((i, t))
        yield [ItemIndex(classes[stride], statistics) for stride in sorted(classes)]


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: every verified pair."""
    spark = documents.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
    for lot in indexes(benchmark, max_postings):
        shared = spark.sparkContext.broadcast(lot)

        def run(batches, shared=shared):
            for b in batches:
                rows = [(d, *x) for d, t in zip(b["doc_id"].to_pylist(), strings(b["text"])) for x in search(shared.value, t, threshold, overlap)]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.float64()) for c in cols[2:])], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = out.unionByName(found)
    return out


def keep_clean(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """The rows, all columns, that match no item; one pass for each index, without a shuffle."""
    spark = documents.sparkSession
    small_batches(spark)
    out = documents
    for lot in indexes(benchmark, max_postings):
        shared = spark.sparkContext.broadcast(lot)

        def run(batches, shared=shared):
            for b in batches:
                yield b.filter(pa.array([not search(shared.value, t, threshold, overlap) for t in strings(b["text"])], pa.bool_()))

        out = out.mapInArrow(run, documents.schema)
    return out
