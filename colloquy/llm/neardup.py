"""Near-duplicates by HyperMinHash: compressed registers, banding, exact confirmation.

A document's set is its distinct ``words``-word shingles (the whole sequence if
it has fewer words, nothing if it has none).  Its sketch deals the shingles to
``REGISTERS`` buckets and keeps, of each bucket's least hash, the count of
leading zeros (6 bits) and the ``MANTISSA`` bits after the leading one.

1. Equal sets are one class with its smallest id as representative; only
   representatives go on, so a group of copies costs one sketch.
2. Four registers make a band; the representatives of a band's bucket are
   candidates.  Of the buckets' smallest members a document first tries the one
   with which it shares the most bands.
3. A candidate pair whose collision-corrected Jaccard estimate is more than
   five standard deviations under the threshold goes; every other is confirmed
   on the full sets, rebuilt from whole texts.
4. Components of the confirmed links.  Buckets that still hold several
   components have all pairs across components tried: small buckets
   by a join, large ones in blocks of rows where pairs already connected are
   skipped.  This is the exact way for what step 2 left.

A band is missed by a linked pair with probability 1 - t^4 at most, all of
``REGISTERS / 4`` of them at t = 0.85 in 4 of 10 million cases.

Defined cases: a null or empty text has an empty set, is linked with nothing
and is kept; a row without an id is kept, has no component and links nothing;
rows that share an id are one node (their links and copies join), and each such
row is returned; an empty table gives an empty result; extra columns don't
matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, packed, small_batches, stored, unpacked
from .components import components

REGISTERS, BAND, MANTISSA = 96, 4, 10
EMPTY = 0xFFFF
#: Expected share of equal registers of unrelated sets: about 0.17 in 2^MANTISSA.
COLLISION = 0.169919 / 2**MANTISSA
#: Buckets of up to so many rows are joined with themselves, larger ones go by blocks of rows.
SMALL_BUCKET, BLOCK = 48, 1024
#: Ids sent to every scan at most; above it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members that one leader meets in a task.
SALT_ROWS = 128

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of UTF-8 bytes."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, parts), np.uint64, n)
    if n < words:
        return _mix(np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64))
    h = np.zeros(n - words + 1, np.uint64)
    for k in range(words):
        # each place has its own multiplier and is mixed, so order counts
        h = _mix(h + w[k : n - words + 1 + k] * _ODD[k % len(_ODD)] + np.uint64(k + 1))
    return np.unique(h)


def registers(s: np.ndarray) -> np.ndarray:
    out = np.full(REGISTERS, EMPTY, np.uint16)
    if len(s):
        bucket = ((s >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        g = _mix(s ^ _ODD[1]) | np.uint64(1)
        least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, bucket.astype(np.int64), g)
        full = least != np.iinfo(np.uint64).max
        v = least[full]
        zeros = (64 - np.frexp((v >> np.uint64(11)).astype(np.float64))[1] - 11).astype(np.uint64)
        zeros = np.minimum(zeros, np.uint64(62))
        mantissa = (v << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[full] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    return out


def bands(r: np.ndarray) -> np.ndarray:
    """Keys of the bands that aren't empty, as signed 64-bit."""
    packed = r.view(np.uint64)
    keys = _mix(packed + np.arange(1, len(packed) + 1, dtype=np.uint64) * _ODD[0])
    return keys[packed != np.uint64(0xFFFFFFFFFFFFFFFF)].view(np.int64)


def jaccard_estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of register rows: the collision-corrected estimate, and the registers it rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    n = np.maximum(used.sum(-1), 1)
    equal = ((a == b) & used).sum(-1) / n
    return np.clip((equal - COLLISION) / (1 - COLLISION), 0, 1), n


def plausible(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    j, n = jaccard_estimate(a, b)
    t = percent / 100
    return j >= t - 5 * np.sqrt(t * (1 - t) / n)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def sketch(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set), regs, bands."""
    small_batches(documents.sparkSession)

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for t in b["text"].to_pylist():
                s = shingles((t or "").encode("utf-8", "replace"), words, hashes)
                r = registers(s)
                d = xxhash.xxh3_128_digest(s.tobytes())
                rows.append((len(s), *np.frombuffer(d, np.int64), r.tobytes(), bands(r)))
            n, d1, d2, regs, keys = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_shingles": pa.array(n, pa.int64()), "d1": pa.array(d1, pa.int64()), "d2": pa.array(d2, pa.int64()), "regs": pa.array(regs, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, regs binary, bands array<long>")


def _texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """id, z (packed whole text) of the documents in ``ids`` (id, distinct and materialized)."""
    few = ids.count() <= BROADCAST_IDS
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def pack(batches):
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_pydict({"id": b["id"], "z": pa.array([press.compress((t or "").encode("utf-8", "replace").lower()) for t in b["text"].to_pylist()], pa.binary())})

    # rows that share an id: any of their texts may link it, so all stay
    return docs.mapInArrow(pack, "id long, z binary")


def _unpack(z: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    return shingles(zstandard.ZstdDecompressor().decompress(z, max_output_size=1 << 31), words, hashes)


def _confirm(pairs: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked on full sets.

    A leader's text goes once to each of its salts, members are dealt over
    them, and a task reads them in order with one set in hand.
    """
    pairs = materialize(pairs.select("a", "b"))
    ids = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    texts = _texts(documents, ids)
    sizes = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    salts = sizes.select("a", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("id"))
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select("a", "salt", F.col("a").alias("id"))
    asked = members.withColumn("kind", F.lit(1)).unionByName(leaders.withColumn("kind", F.lit(0)))
    dealt = asked.join(texts, "id").repartition(F.col("a"), F.col("salt")).sortWithinPartitions("a", "salt", "kind", "id")

    def run(batches):
        hashes, at, sets = WordHashes(), None, []
        for b in batches:
            got = []
            for a, salt, kind, i, z in zip(*(b[c].to_pylist() for c in ("a", "salt", "kind", "id", "z"))):
                if at != (a, salt):
                    at, sets = (a, salt), []
                s = _unpack(z, words, hashes)
                if kind == 0:
                    sets.append(s)
                elif any(linked(x, s, percent) for x in sets):
                    got.append((a, i))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([x for _, x in got], pa.int64())})

    return materialize(dealt.mapInArrow(run, "a long, b long").distinct())


def _plausible_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    a = sketches.select(F.col("doc_id").alias("a"), F.col("regs").alias("ra"))
    b = sketches.select(F.col("doc_id").alias("b"), F.col("regs").alias("rb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", "ra", "rb")

    def run(batches):
        for x in batches:
            if x.num_rows:
                ra, rb = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                ok = pa.array(plausible(ra, rb, percent))
                yield x.select(["a", "b"]).filter(ok)

    return joined.mapInArrow(run, "a long, b long").distinct()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices over 4096 shingles at a time."""
    ids, counts = np.unique(np.concatenate(sets), return_counts=True)
    ids = ids[counts > 1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(ids), 4096):
        some = ids[at : at + 4096]
        m = np.zeros((len(sets), len(some)), np.float32)
        for k, s in enumerate(sets):
            own = s[np.searchsorted(s, some[0]) : np.searchsorted(s, some[-1], "right")]
            place = np.searchsorted(some, own)
            m[k, place[some[place] == own]] = 1.0
        out += m @ m.T
    return out


def _block_links(rows: DataFrame, sketches: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Links across components within large buckets: ``rows`` are key, doc_id, component, n (rows of the bucket).

    A bucket's rows fall into blocks of about BLOCK; every pair of blocks is a
    group of its own.  A pair is tried in the first bucket that it shares, and
    a group returns a link for each merger only, never all its pairs.
    """
    ids = materialize(rows.select(F.col("doc_id").alias("id")).distinct())
    texts = _texts(documents, ids).withColumnRenamed("id", "doc_id")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    # block x meets the blocks y >= x
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id", "component")
    full = met.join(sketches.select("doc_id", "regs"), "doc_id").join(texts, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        hashes, root = WordHashes(), {}

        def find(c):
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
        tags = _mix(regs.view(np.uint64) + np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64) * _ODD[0]).view(np.int64)
        # the band is that of the key; of an id with several texts only the registers that lie in the bucket count
        inside = tags == table["key"][0].as_py()
        here = inside.any(1)
        table, regs = table.filter(pa.array(here)), np.ascontiguousarray(regs[here])
        mine = int(inside[here].argmax(1).min()) if here.any() else 0
        ids, z = (table[c].to_pylist() for c in ("doc_id", "z"))
        comp = table["component"].to_numpy()
        packed = regs.view(np.uint64)
        asked = []
        for i in range(len(ids) - 1):
            at = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
            at = at[plausible(regs[i], regs[at], percent)]
            seen = (packed[at, :mine] == packed[i, :mine]) & (packed[i, :mine] != np.uint64(0xFFFFFFFFFFFFFFFF))
            at = at[~seen.any(1)]
            if len(at):
                asked.append((i, at))
        out = []
        if asked:
            need = sorted({i for i, _ in asked} | {int(j) for _, at in asked for j in at})
            sets = {k: _unpack(z[k], words, hashes) for k in need}
            every = sum(len(at) for _, at in asked) > 20 * len(need)
            if every:
                place = {k: n for n, k in enumerate(need)}
                both = _overlaps([sets[k] for k in need])
                sizes = np.array([len(sets[k]) for k in need])
            for i, at in asked:
                if every:
                    js = np.array([place[int(j)] for j in at])
                    n = both[place[i], js]
                    at = at[100 * n >= percent * (sizes[place[i]] + sizes[js] - n)]
                for j in at:
                    if find(comp[i]) != find(comp[j]) and (every or linked(sets[i], sets[j], percent)):
                        root[find(comp[j])] = find(comp[i])
                        out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return full.groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def classes(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents``."""
    t = materialize(sketch(documents, words))
    named = t.where("doc_id is not null and n_shingles > 0")
    members = named.select("doc_id", "d1", "d2", "n_shingles")
    # stored, so that the join of a large group of copies to its one row can be split
    reps = stored(members.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")))
    # an id with several sets ties their classes together
    ids = members.join(reps, ["d1", "d2"]).groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.collect_set("rep").alias("reps"))
    ids = materialize(ids)
    tied = ids.where("rep <> last").select(F.col("rep").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    alone = materialize(named.join(reps.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "doc_id"]).select("doc_id", "regs", "bands").dropDuplicates(["doc_id", "regs"]))
    keyed = alone.select("doc_id", F.explode("bands").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a <> last").select("key", "a"))
    shared = materialize(keyed.join(buckets, "key").select("key", "doc_id", "a"))
    # each document tries the leader with which it shares the most bands
    tried = (
        shared.where("doc_id <> a").groupBy("doc_id", "a").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("doc_id").agg(F.max_by("a", F.struct(F.col("n"), -F.col("a"))).alias("a"))
        .select("a", F.col("doc_id").alias("b"))
    )
    first = _confirm(_plausible_pairs(tried, alone, percent), documents, words, percent)
    links = first.unionByName(tied)
    found = materialize(components(links))

    # what is left: buckets that hold several components
    rows = shared.select("key", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = stored(rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi").select("key", "n"))
    left = materialize(rows.join(mixed, "key"))
    small = left.where(F.col("n") <= SMALL_BUCKET).select("key", "doc_id", "component")
    across = (
        small.select("key", F.col("doc_id").alias("a"), F.col("component").alias("ca"))
        .join(small.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb")), "key")
        .where("ca < cb").select("a", "b").distinct()
    )
    more = _confirm(_plausible_pairs(across, alone, percent), documents, words, percent)
    large = left.where(F.col("n") > SMALL_BUCKET)
    if large.head(1):
        more = more.unionByName(materialize(_block_links(large, alone, documents, words, percent)))
    found = materialize(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))

    named_ids = ids.select("doc_id", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("node"), F.coalesce("component", "rep").alias("component"))
    out = t.select("doc_id", "n_shingles").join(named_ids, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows, all columns, of each group's smallest id; of rows that share that id the one of least hash stays."""
    c = materialize(classes(documents, words, percent))
    docs = packed(documents, id=F.col("doc_id").cast("long"))
    gone = materialize(c.where("not kept").select(F.col("doc_id").alias("id")).distinct())
    few = gone.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "id", "left_anti")
    again = materialize(c.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("id")))
    if not again.head(1):
        return unpacked(kept)
    few = again.count() <= BROADCAST_IDS
    again = F.broadcast(again) if few else again
    order = Window.partitionBy("id").orderBy(F.xxhash64(*[F.col(f"row.`{x}`") for x in documents.columns]))
    one = kept.join(again, "id", "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1").select("id", "row")
    return unpacked(kept.join(again, "id", "left_anti").select("id", "row").unionByName(one))
