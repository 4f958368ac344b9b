"""Near-duplicates by SimHash, found in a byte-position index with count filtering.

A text's shingles are its ``SHINGLE``-word runs, repeats included (the whole
sequence if it has fewer words); a fingerprint bit is 1 if it is set in over
half of their 64-bit hashes.  Fingerprints link at ``MOST_BITS`` differing bits
or fewer.

1. Equal fingerprints are one node, so a group of copies costs one row.
2. Differing bits touch three of the eight bytes at most, so a linked pair
   shares five positional bytes at least: that is the guaranteed count.  The
   index holds a fingerprint once for each choice of five of its (position,
   byte) pairs.  A pair whose count of shared positional bytes reaches five
   meets in a list, a pair below it in none, so no list of a single byte (one
   fingerprint in 256) is ever paired.
3. In a list the shared positional bytes of a pair are tallied and the pair is
   taken in the first list that it shares only; then its bits are compared.
   A list has at most 2^24 members, since three bytes are free.  Up to
   ``PAIRED`` members are compared with each other; a longer list looks up, for
   every member, the values at three or fewer flipped bits, so its cost grows
   with its length and not with the square.
4. Links are combined to stars before they leave a task; then components.

Defined cases: a null or empty text has fingerprint zero, which links like any
other; rows that share an id are one node, and each such row is returned; a row
without an id has a fingerprint and the component of that fingerprint (null if
no row with an id is in it); an empty table gives an empty result; extra columns
don't matter.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, stored
from .components import components

SHINGLE, SEED, MOST_BITS = 3, 42, 3
BYTES = 8
#: Positional bytes that a linked pair shares at least.
SHARED = BYTES - MOST_BITS
LISTS = list(combinations(range(BYTES), SHARED))
#: Members of a list that are compared with each other; longer lists look up flipped values.
PAIRED = 1024
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + PIECE)
        end = m.end() if m else len(text)
        yield text[at:end].split()
        at = end


def _bits(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set."""
    return np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """Bit i of the result is 1 if it is set in over half of the shingles' hashes."""
    counts, n, last = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for part in _pieces((text or "").encode("utf-8", "replace").lower()):  # bytes: A-Z only, and the six ASCII white spaces
        ws = last + part
        if len(ws) >= words:
            hashes = [digest(b" ".join(g), SEED) for g in zip(*(ws[k:] for k in range(words)))]
            counts += _bits(hashes)
            n += len(hashes)
            ws = ws[len(ws) - words + 1 :]
        last = ws
    if not n and last:
        return digest(b" ".join(last), SEED)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""
    small_batches(documents.sparkSession)

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "fp": pa.array(fps.view(np.int64), pa.int64())})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(1)
def _masks() -> tuple[np.ndarray, np.ndarray]:
    """Of each list its mask of five bytes; and of each pattern of shared bytes (bit p: byte p) the first list it meets in, or -1."""
    masks = np.array([sum(0xFF << 8 * p for p in c) for c in LISTS], np.uint64)
    own = [sum(1 << p for p in c) for c in LISTS]
    first = np.array([next((k for k, c in enumerate(own) if c & shared == c), -1) for shared in range(256)], np.int64)
    return masks, first


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as links of every node but the smallest of its component to that one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            break
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (up := root[root])[0] != root[0] or (up != root).any():
            root = up
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def _paired(fp: np.ndarray, lists: np.ndarray, run: np.ndarray):
    """Linked pairs (places) within runs of one list and key each, taken in the first list that they share."""
    _, first = _masks()
    size = np.bincount(run)
    left = np.flatnonzero(np.arange(len(fp)) < (np.cumsum(size) - 1)[run])
    d = 1
    while len(left):
        x = fp[left] ^ fp[left + d]
        shared = np.packbits(x.view(np.uint8).reshape(-1, 8) == 0, axis=1, bitorder="little")[:, 0]
        ok = (first[shared] == lists[left]) & (np.bitwise_count(x) <= MOST_BITS)
        yield left[ok], left[ok] + d
        d += 1
        left = left[left + d < len(fp)]
        left = left[run[left] == run[left + d]]


def _flipped(fp: np.ndarray, mask: int):
    """Linked pairs (places) of distinct values that agree on the bytes of ``mask``, by looking up flipped bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    at = np.zeros(len(fp), np.int64)
    for k, b in enumerate(free):
        at |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    place = np.full(1 << len(free), -1, np.int32)
    place[at] = np.arange(len(fp))
    for n in range(1, MOST_BITS + 1):
        for some in combinations(range(len(free)), n):
            other = place[at ^ sum(1 << k for k in some)]
            ok = np.flatnonzero(other > np.arange(len(fp)))
            if len(ok):
                yield ok, other[ok]


def _links(fp: np.ndarray, lists: np.ndarray, paired: int) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars within rows that are sorted by list and shared bytes; a run of equal list and bytes is whole."""
    masks, _ = _masks()
    part = fp & masks[lists]
    fresh = np.ones(len(fp), bool)
    fresh[1:] = (lists[1:] != lists[:-1]) | (part[1:] != part[:-1])
    run = np.cumsum(fresh) - 1
    size = np.bincount(run)
    few = np.flatnonzero((size[run] > 1) & (size[run] <= paired))
    a, b, held = [], [], 0

    def add(x, y):
        nonlocal a, b, held
        a.append(x)
        b.append(y)
        held += len(x)
        if held > 1 << 20:
            x, y = star(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], 0

    if len(few):
        own, starts = fp[few], np.unique(run[few], return_inverse=True)[1]
        for x, y in _paired(own, lists[few], starts):
            add(own[x], own[y])
    for r in np.flatnonzero(size > paired):
        s = np.flatnonzero(run == r)
        own = fp[s]
        for x, y in _flipped(own, int(masks[lists[s[0]]])):
            add(own[x], own[y])
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return star(np.concatenate(a), np.concatenate(b))


def near(fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """a, b: links between distinct fingerprints ``fp`` such that everything linked is connected."""

    def deal(batches):
        masks, _ = _masks()
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            lists = np.repeat(np.arange(len(LISTS), dtype=np.int8), len(fp))
            every = np.tile(fp, len(LISTS))
            yield pa.RecordBatch.from_pydict({"list": pa.array(lists), "part": pa.array((every & masks[lists]).view(np.int64)), "fp": pa.array(every.view(np.int64))})

    def run(batches):
        held_fp, held_list = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        masks, _ = _masks()
        for b in batches:
            fp = np.concatenate([held_fp, b["fp"].to_numpy().view(np.uint64)])
            lists = np.concatenate([held_list, b["list"].to_numpy().astype(np.int64)])
            if not len(fp):
                continue
            # the last run may go on in the next batch
            last = (lists == lists[-1]) & (fp & masks[lists] == fp[-1] & masks[lists[-1]])
            cut = len(fp) - int(last.sum())
            held_fp, held_list = fp[cut:], lists[cut:]
            if cut:
                yield _edges(*_links(fp[:cut], lists[:cut], paired))
        if len(held_fp):
            yield _edges(*_links(held_fp, held_list, paired))

    dealt = fps.select("fp").mapInArrow(deal, "list byte, part long, fp long")
    return dealt.repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(run, "a long, b long").distinct()


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})


def classes(documents: DataFrame, words: int = SHINGLE, paired: int = PAIRED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, n_same (rows with that fingerprint) of every row of ``documents``."""
    t = materialize(fingerprints(documents, words))
    fps = stored(t.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n_same")))
    several = t.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a <> last").select("doc_id", "a")
    tied = t.join(several, "doc_id").select("a", F.col("fp").alias("b")).where("a <> b")
    found = components(near(fps, paired).unionByName(tied))
    named = stored(fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n_same", F.coalesce("component", "fp").alias("component")))
    lowest = stored(named.groupBy("component").agg(F.min("low").alias("component_id")))
    of = stored(named.join(lowest, "component").select("fp", "component_id", "n_same"))
    return t.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_same")
