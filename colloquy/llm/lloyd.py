"""Centroid clustering by Delta Lloyd: whole numbers, and only what changed is compared.

Vectors become integers, centroids are integer quotients of integer sums, so
every round is exact and doesn't depend on order or partitions.

- The state (vector, owner, squared distance to it) is a table.  A round reads
  it once: a vector whose owner didn't move keeps its distance and is compared
  with the centroids that moved only; a vector whose owner moved is compared with
  all.  That is exact, since every other centroid was no nearer before and
  hasn't come nearer.
- A vector that changes hands is added to its new owner's sum and taken from
  the old one's.  These signed transfers are added within a task, then by
  centroid and component; the driver keeps k x dims sums and k counts.
- A round in which no centroid moved ends the loop: all further ones would
  change nothing.
- The table of a round goes when the next one is written.

Defined cases: a vector that is null, has another number of components, or
holds null or non-finite ones isn't kept and has no row; repeated rows count and
return each; a null id has the hash of an empty text behind the seed; equal
hashes are taken in the order of the vectors; with fewer than k vectors there are as many
centroids as vectors; empty centroids stay where they are.  Integers beyond
``LARGEST`` in size (components beyond 131,072 at a scale of 1,024) count as
that, so that a squared distance fits in a long; sums of distances beyond a
long's range count as its largest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, scratch, small_batches

K, DIMS, ROUNDS, SCALE, SEED = 8, 64, 10, 1024, 3
LARGEST = (1 << 27) - 1
_LONG = 2**63 - 1
_STATE = "vec_id long, v binary, cluster int, distance long, was int"


def kept(embeddings: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v: the vectors that count, as packed 32-bit integers."""
    small_batches(embeddings.sparkSession, 10_000)
    x = F.col("embedding")
    fits = (F.size(x) == dims) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(fits)

    def run(batches):
        for b in batches:
            flat = b["embedding"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(flat * float(scale)), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "v": pa.array([r.tobytes() for r in v], pa.binary())})

    return rows.mapInArrow(run, "vec_id long, v binary")


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as longs; sums may wrap on the way, the result doesn't."""
    return (v * v).sum(1)[:, None] - 2 * (v @ centroids.T) + (centroids * centroids).sum(1)[None, :]


def assign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances; ``moved`` marks the centroids that changed (an owner of -1 counts as moved)."""
    owner, distance = owner.copy(), distance.copy()
    whole = np.ones(len(v), bool)
    whole[owner >= 0] = moved[owner[owner >= 0]]
    if whole.any():
        d = _distances(v[whole], centroids)
        best = d.argmin(1)
        owner[whole], distance[whole] = best, d[np.arange(len(d)), best]
    some, rest = np.flatnonzero(moved), np.flatnonzero(~whole)
    if len(some) and len(rest):
        d = _distances(v[rest], centroids[some])
        best = d.argmin(1)
        new, to = d[np.arange(len(d)), best], some[best]
        better = (new < distance[rest]) | ((new == distance[rest]) & (to < owner[rest]))
        owner[rest[better]], distance[rest[better]] = to[better], new[better]
    return owner, distance


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches):
        for b in batches:
            if b.num_rows:
                owner, distance = b["cluster"].to_numpy().astype(np.int64), b["distance"].to_numpy()
                new, d = assign(_vectors(b["v"], dims), owner, distance, centroids, moved)
                yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "v": b["v"], "cluster": pa.array(new, pa.int32()), "distance": pa.array(d, pa.int64()), "was": pa.array(owner, pa.int32())})

    return state.select("vec_id", "v", "cluster", "distance").mapInArrow(run, _STATE)


def _transfers(state: DataFrame, k: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """What the vectors that changed hands add to each centroid's sums and count."""

    def run(batches):
        # the last column counts vectors
        sums = np.zeros((k, dims + 1), object)
        for b in batches:
            v = np.hstack([_vectors(b["v"], dims), np.ones((b.num_rows, 1), np.int64)])
            for column, sign in (("cluster", 1), ("was", -1)):
                who = b[column].to_numpy()
                for c in np.unique(who[who >= 0]):
                    sums[c] += sign * v[who == c].sum(0)
        c, p = np.nonzero(sums)
        if len(c):
            yield pa.RecordBatch.from_pydict({"c": pa.array(c, pa.int32()), "p": pa.array(p, pa.int32()), "s": pa.array([int(x) for x in sums[c, p]], pa.decimal128(38, 0))})

    got = state.where("cluster <> was").select("v", "cluster", "was").mapInArrow(run, "c int, p int, s decimal(38,0)").groupBy("c", "p").agg(F.sum("s").alias("s"))
    sums = np.zeros((k, dims + 1), object)
    for c, p, s in got.collect():  # k x (dims + 1) rows at most
        sums[c, p] = int(s)
    return sums[:, :dims], sums[:, dims]


def cluster(embeddings: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, cluster_size of every vector that is kept."""
    spark = embeddings.sparkSession
    old, path = None, scratch(spark, "lloyd")
    kept(embeddings, dims, scale).write.parquet(path)
    state = spark.read.schema("vec_id long, v binary").parquet(path).select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    centroids = np.array([np.frombuffer(r["v"], np.int32) for r in first], np.int64)
    k, moved = len(centroids), np.ones(len(centroids), bool)
    sums, counts = np.zeros((k, dims), object), np.zeros(k, object)
    for n in range(rounds + 1):
        old, path = path, scratch(spark, "lloyd")
        _round(state, centroids, moved).write.parquet(path)
        remove(spark, old)
        state = spark.read.schema(_STATE).parquet(path)
        if n == rounds:
            break
        more, changed = _transfers(state, k, dims)
        sums, counts = sums + more, counts + changed
        now = centroids.copy()
        for c in np.flatnonzero(counts):
            now[c] = [int(s) // int(counts[c]) for s in sums[c]]
        moved = (now != centroids).any(1)
        centroids = now
        if not moved.any():
            break
    held = {r["cluster"]: r for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()}  # k rows
    total = sum(int(r["s"]) for r in held.values())
    rows = [(c, min(int(r["s"]), _LONG), min(total, _LONG), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest(), r["n"]) for c, r in held.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, cluster_size long")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")
