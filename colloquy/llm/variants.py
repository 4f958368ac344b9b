"""Spelling variants grouped by deletion keys from rolling hashes.

A word is near another if one inserted, deleted or replaced code point turns it
into the other.  Its form is the commonest near word, if that is at least
``RATIO`` times as common; its root is where the forms lead.

1. One pass over whole texts counts the words of a partition before anything is
   shuffled; the sums by word are the vocabulary.
2. A word of length L has up to L + 1 keys: the polynomial hash of the word and
   of each result of deleting one code point.  Hashes of prefixes and suffixes
   give all of them at once, as arrays of integers.
3. Rows are partitioned by the high bits of the key (a radix) and sorted by key.
   In a run of equal keys the remaining strings are compared, so a collision of
   hashes never counts.  Words with the same rest by deleting place i differ by
   a replacement at i; the word that equals the rest differs from the others by
   an insertion.  A pair of near words shares exactly one such place, so counts
   add up without any pair being built: a word's row only says how many others
   share its rest and which of them is the commonest.
4. Forms lead to ever commoner words, so following them by doubling ends after
   a few joins.

A run has at most (alphabet) x (length + 1) rows, however common its words are.
Only short words travel with their keys: a long one is fetched for the runs in
which it meets another word, so rows grow with a word's length, bytes too.

Defined cases: null and empty texts have no words; a null id counts as an empty
one in the deletion rule; repeated rows count each time; ties go to the word that is
first in code-point order; an empty table gives an empty result; extra columns
don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in ``ODD`` of a document, by its crc32, loses a code point.
ODD = 97
LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
#: Distinct words that a task holds before it passes their counts on.
HELD_WORDS = 200_000
#: Texts longer than that are read match by match.
LONG_TEXT = 1 << 22
#: Words up to that length travel with their keys; longer ones are fetched where their keys meet others.
SHORT = 64
#: Code points whose keys are made at a time.
SLAB = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW = {c: c + 32 for c in range(65, 91)}


def words_of(doc_id: int | None, text: str | None) -> Counter:
    """The words of a document with their counts, after the deletion rule."""
    text = text or ""
    found = Counter(RUN.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in RUN.finditer(text)))
    name, out = ("" if doc_id is None else str(doc_id)).encode() + b":", Counter()
    head = zlib.crc32(name)
    for w, n in found.items():
        w = w.translate(_LOW)
        h = zlib.crc32(w.encode(), head)
        if h % ODD == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        if len(w) >= LEAST_LENGTH:
            out[w] += n
    return out


def vocabulary(documents: DataFrame) -> DataFrame:
    """word, n: the words that occur ``LEAST_COUNT`` times or more."""
    small_batches(documents.sparkSession)

    def table(counts):
        return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def run(batches):
        counts = Counter()
        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                for w, n in words_of(i, t).items():
                    counts[w] += n
                if len(counts) >= HELD_WORDS:
                    yield table(counts)
                    counts = Counter()
        if counts:
            yield table(counts)

    some = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, "word string, n long")
    return some.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in a row: keys, the word's number, first and last deleted place (-1: none).

    The hash of c0 c1 .. is the sum of ci * B^i.  Without place i it is the sum
    before i plus the sum behind i divided by B, which exists modulo 2^64.
    Equal neighbours leave the same rest, so they are one row.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    first = np.cumsum(sizes) - sizes
    number = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(c)) - first[number]
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(sizes.max(initial=0)), _BASE, np.uint64))])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c * powers[place], dtype=np.uint64)])
    start, end = sums[first], sums[first + sizes]
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    fresh = (place == 0) | np.concatenate([[True], c[1:] != c[:-1]])[: len(c)]
    at = np.flatnonzero(fresh)
    last = np.concatenate([at[1:], [len(c)]])[: len(at)] - 1
    own = number[at]
    rest = (sums[at] - start[own]) + (end[own] - sums[at + 1]) * inverse
    none = np.full(len(words), -1)
    return _mixed(np.concatenate([end - start, rest])), np.concatenate([np.arange(len(words)), own]), np.concatenate([none, place[at]]), np.concatenate([none, place[last]])


def _best(rows: list[tuple[str, int]]) -> tuple:
    """The commonest word (ties: first in order) and the next one."""
    top = sorted(rows, key=lambda x: (-x[1], x[0]))[:2]
    return top[0], top[1] if len(top) > 1 else None


def _nearby(rows: list[tuple[str, int, int, int]]) -> list[tuple]:
    """Of rows (word, n, first place, last place) with one key: (word, near words, commonest of them, its n)."""
    by_rest = {}
    for w, n, lo, hi in rows:
        by_rest.setdefault(w if lo < 0 else w[:lo] + w[lo + 1 :], []).append((w, n, lo, hi))
    out = []
    for rest in by_rest.values():
        if len(rest) < 2:
            continue
        by_place, longer, whole = {}, [], None
        for w, n, lo, hi in rest:
            if lo < 0:
                whole = (w, n)
                continue
            longer.append((w, n))
            for p in range(lo, hi + 1):
                by_place.setdefault(p, []).append((w, n))
        for same in by_place.values():
            if len(same) > 1:
                one, two = _best(same)
                out += [(w, len(same) - 1, *(two if w == one[0] else one)) for w, _ in same]
        if whole and longer:
            out.append((whole[0], len(longer), *_best(longer)[0]))
            out += [(w, 1, *whole) for w, _ in longer]
    return out


def _slabs(words: list[str]):
    """Ranges of words with about ``SLAB`` code points."""
    first = size = 0
    for k, w in enumerate(words):
        size += len(w)
        if size >= SLAB:
            yield first, k + 1
            first, size = k + 1, 0
    if first < len(words):
        yield first, len(words)


def _deal(batches):
    """The rows of every word: key, lo, hi, id, n and, of a short word, the word."""
    for b in batches:
        words = b["word"].to_pylist()
        for first, last in _slabs(words):
            keys, number, lo, hi = deletion_keys(words[first:last])
            at = pa.array(number + first)
            word = pa.array([w if len(w) <= SHORT else None for w in words], pa.string()).take(at)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.view(np.int64)), "lo": pa.array(lo, pa.int32()), "hi": pa.array(hi, pa.int32()), "id": b["id"].take(at), "n": b["n"].take(at), "word": word})


def _meet(batches):
    """Of rows sorted by key: what each word gains (``_GAINS``); rows that meet long words come out as they are, for another round with all words."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        keys = held["key"].to_numpy()
        cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if cut:
            yield _runs(held.slice(0, cut))
            held = held.slice(cut).combine_chunks()
    if held is not None and held.num_rows:
        yield _runs(held)


def _runs(t: pa.Table) -> pa.RecordBatch:
    keys = t["key"].to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    gains, left = [], []
    several = np.flatnonzero(np.diff(edge) > 1)
    if len(several):
        inside = np.zeros(len(keys), bool)
        for k in several:
            inside[edge[k] : edge[k + 1]] = True
        rows = list(zip(*(t.filter(pa.array(inside))[c].to_pylist() for c in ("word", "n", "lo", "hi", "key", "id"))))
        at = 0
        for size in np.diff(edge)[several]:
            run = rows[at : at + size]
            at += int(size)
            if all(r[0] is not None for r in run):
                gains += [(*g, None, None, None, None, None) for g in _nearby([r[:4] for r in run])]
            elif len({r[5] for r in run}) > 1:
                left += [(None, None, None, None, key, lo, hi, i, n) for _, n, lo, hi, key, i in run]
    cols = list(zip(*gains, *left)) if gains or left else [[]] * 9
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "n_near", "near", "near_n", "key", "lo", "hi", "id", "n"])


_ROWS = "key long, lo int, hi int, id long, n long, word string"
_GAINS = "word string, n_near long, near string, near_n long, key long, lo int, hi int, id long, n long"


def near(vocab: DataFrame) -> DataFrame:
    """word, n_near, near (the commonest near word), near_n of every word of ``vocab`` (id, word, n) that has a near one."""

    def met(rows: DataFrame) -> DataFrame:
        # the radix: the high bits choose the partition, the sort does the rest
        return rows.withColumn("radix", F.shiftrightunsigned("key", 48)).repartition("radix").sortWithinPartitions("key").drop("radix").mapInArrow(_meet, _GAINS)

    small_batches(vocab.sparkSession, 10_000)
    gains = materialize(met(vocab.mapInArrow(_deal, _ROWS)))
    left = gains.where("key is not null").select("key", "lo", "hi", "id", "n")
    parts = gains.where("key is null")
    if left.head(1):
        parts = parts.unionByName(met(left.join(vocab.select("id", "word"), "id").select("key", "lo", "hi", "id", "n", "word")))
    least = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", F.col("best.w").alias("near"), (-F.col("best.m")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word in ``forms`` (word, form): each round doubles how far a word has been followed."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        on = at.select(F.col("word").alias("w"), F.col("root").alias("r"))
        step = stored(at.join(on, at["root"] == on["w"], "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        at = step.select("word", "root")
        if not step.where("moved").head(1):
            return at


def groups(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary."""
    vocab = stored(vocabulary(documents).withColumn("id", F.monotonically_increasing_id()))
    found = materialize(vocab.join(near(vocab), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("near_n") >= RATIO * F.col("n"), F.col("near")).alias("form"), F.when(F.col("near_n") >= RATIO * F.col("n"), F.col("near_n")).alias("form_n")))
    to = roots(found.where("form is not null").select("word", "form"))
    return found.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
