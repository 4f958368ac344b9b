"""Approximate nearest neighbours by randomly rotated one-bit codes.

Rows are dealt to cells, the nearest of a few centres; a centre c is fitted on a
bounded sample, every row is indexed.  A row's residual o - c is scaled to
length 1, padded with zeros to at least ``BITS`` dimensions and rotated by a
random orthogonal matrix; its code is the signs, one packed bit for each of these
B dimensions, kept with the residual's length, its product with c and the
correction scalar s = <code, residual>.  Of a query q, with q' the rotated q - c,

    <o, q> = |o - c| * est + <o - c, c> + <q, c>,   est = <code, q'> / s

with an error of at most |o - c| |q - c| * EPS * sqrt((1 - s^2) / s^2 / (B - 1)),
but for one pair in about a thousand.  The padding is for short vectors, whose own
few bits leave bounds so wide that a quarter of all pairs would be reranked.
Estimate and bound of all queries and rows of a block are one matrix product.
The k-th product of a query with the rows of that sample is what its k-th product
can't fall below, wherever a task begins; that takes queries times a bounded number.
A cell is passed over where even a row of its largest residual in the query's
direction couldn't reach the query's k-th product so far; within a cell every
vector whose upper bound reaches it is reranked: products in single precision
choose, products in double precision, of the original vectors, decide.  A cell's
equal vectors are one vector with several ids.

The index is one pass and one shuffle of the rows, by ranges of (cell, id), so a
crowded cell is split.  Queries are sent to the rows, not rows to the queries:
a pass sends at most ``PASS_QUERIES`` queries and ``PASS_BYTES`` to every task,
which keeps the best k of each for its rows; these are merged by query.  So
shuffles grow with the rows and with queries times tasks, and neither a task nor
the driver holds an unbounded set.  The pairs compared by code grow with queries
times rows of the cells that bounds can't exclude.

Defined cases: vectors that are null, zero, or hold a null or non-finite
component take no part, nor do rows without an id; vectors meet those of the
same length only; rows with the query's own id aren't candidates; equal scores
go by the smaller id; rows of one id and score count once, other rows of
one id are candidates each; an id with several vectors asks with the
first of them in the order of arrays; with fewer than k candidates all are
returned; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows that centres and first bounds of the queries are fitted on at most, and rows of a cell that are searched at once.
SAMPLE_ROWS, ROW_BLOCK = 16_384, 8_192
#: Queries (and bytes of them) sent to every task at once, and queries compared at once.
PASS_QUERIES, PASS_BYTES, QUERY_BLOCK = 65_536, 64 << 20, 256
MAX_CELLS = 4_096
#: Components of pairs that are multiplied in double precision at once.
PAIR_VALUES = 1 << 20
#: Bits of a code at least; longer vectors have a bit for each dimension.
BITS = 256
#: Standard deviations of the error bound.
EPS = 3.2
SEED = 20_240


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """The first d rows of a random orthogonal matrix of at least BITS columns, which pads and rotates at once."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((max(d, BITS), d)))
    return (q * np.sign(np.diag(r))).T


def encode(x: np.ndarray, c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (rows of bytes); residual lengths; correction scalars; products with the centre."""
    r = x - c
    length = np.sqrt((r * r).sum(1))
    u = (r / np.where(length > 0, length, 1.0)[:, None]) @ p
    s = np.abs(u).sum(1) / math.sqrt(p.shape[1])
    return np.packbits(u >= 0, axis=1), length, np.where(length > 0, s, 1.0), (x * c).sum(1)


def signs(codes: np.ndarray, bits: int) -> np.ndarray:
    """Packed codes as entries of +-1 / sqrt(bits)."""
    return (np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(bits))


def query_side(q: np.ndarray, c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Of each query its rotated residual, 1, its product with the centre and the residual's length."""
    r = q - c
    return np.column_stack([r @ p, np.ones(len(q)), q @ c, np.sqrt((r * r).sum(1))])


def row_side(codes, length, s, with_centre, c: np.ndarray, p: np.ndarray, eps: float = EPS) -> np.ndarray:
    """Of each row, in columns, what ``query_side`` is multiplied by: without its last line that gives estimates, with it upper bounds."""
    bits = p.shape[1]
    spread = eps * length * np.sqrt(np.maximum(1 - s * s, 0) / (s * s) / max(bits - 1, 1))
    scaled = signs(codes, bits).T * (length / s).astype(np.float32)
    return np.vstack([scaled, np.stack([with_centre - c @ c, np.ones(len(s)), spread + single(bits) * length]).astype(np.float32)])


def estimate(codes, length, s, with_centre, q: np.ndarray, c: np.ndarray, p: np.ndarray, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """Of queries by rows: the estimated inner products and their error bounds."""
    a, b = query_side(q, c, p).astype(np.float32), row_side(codes, length, s, with_centre, c, p, eps)
    return a[:, :-1] @ b[:-1], np.outer(a[:, -1], b[-1])


def single(d: int) -> float:
    """Relative error allowed to products in single precision."""
    return 4e-6 + 1.2e-7 * d


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components, so equal vectors get equal scores."""
    return np.cumsum(x * q, axis=1)[:, -1]


def single_products(x: np.ndarray, at: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``at`` of x and ``of`` (ascending) of q in their precision, a query at once."""
    ends = np.searchsorted(of, np.arange(len(q) + 1))
    return np.concatenate([x.take(at[a:b], axis=0) @ v for v, a, b in zip(q, ends[:-1], ends[1:])])


def double_products(x: np.ndarray, at: np.ndarray, q: np.ndarray, of: np.ndarray) -> np.ndarray:
    """``products`` of the rows ``at`` of x and ``of`` of q, a bounded number at once."""
    step = max(1, PAIR_VALUES // x.shape[1])
    return np.concatenate([products(x[at[a : a + step]], q[of[a : a + step]]) for a in range(0, max(len(at), 1), step)])


def distinct(x: np.ndarray, ids: np.ndarray, most: int, *columns: np.ndarray) -> tuple:
    """The distinct vectors, their ``columns``, and of each its smallest ``most`` ids."""
    x = np.ascontiguousarray(x)
    mixed = (x.view(np.uint64) * np.random.default_rng(SEED).integers(1, 2**63, x.shape[1], np.int64).astype(np.uint64)).sum(1)
    order = np.lexsort((ids, mixed))
    x, ids = x[order], ids[order]
    fresh = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
    starts = np.append(np.flatnonzero(fresh), len(x))
    return x[fresh], *(c[order][fresh] for c in columns), [ids[a:b] if b - a == 1 else np.unique(ids[a:b])[:most] for a, b in zip(starts[:-1], starts[1:])]


class Best:
    """The best k of each query so far: scores and ids, best first; ``floor`` is what their k-th scores can't fall below."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.filled = np.zeros(len(ids), np.int64)

    def least(self, some: np.ndarray) -> np.ndarray:
        return np.maximum(np.where(self.filled[some] >= self.k, self.score[some, -1], -np.inf), self.floor[some])

    def add(self, some: np.ndarray, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """New candidates of the queries ``some``: of is a place in ``some``."""
        old = np.flatnonzero(self.filled[some] > 0)
        n = self.filled[some][old]
        rows = np.repeat(old, n)
        place = np.concatenate([np.arange(m) for m in n]) if len(n) else np.zeros(0, np.int64)
        of, ids, scores = np.concatenate([rows, of]), np.concatenate([self.found[some[rows], place], ids]), np.concatenate([self.score[some[rows], place], scores])
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
        of, ids, scores = of[new], ids[new], scores[new]
        starts = np.searchsorted(of, np.arange(len(some)))
        rank = np.arange(len(of)) - starts[of]
        keep = rank < self.k
        self.score[some[of[keep]], rank[keep]], self.found[some[of[keep]], rank[keep]] = scores[keep], ids[keep]
        self.filled[some] = np.bincount(of[keep], minlength=len(some))


def search_cell(best: Best, x: np.ndarray, ids: np.ndarray, codes, length, s, with_centre, c: np.ndarray, p: np.ndarray) -> None:
    """Let the rows of (a part of) a cell into the best of every query."""
    k, d = best.k, x.shape[1]
    x, codes, length, s, with_centre, owners = distinct(x, ids, k + 1, codes, length, s, with_centre)
    several = np.array([len(o) for o in owners])
    flat, offsets = np.concatenate(owners), np.concatenate([[0], np.cumsum(several)])
    scale, error = max(float(np.abs(x).max()), 1e-300), single(d)
    small = (x / scale).astype(np.float32)
    most = np.sqrt(((x / scale) ** 2).sum(1)).max()
    norm = np.sqrt((best.q * best.q).sum(1))
    # <o, q> = <c, q> + <o - c, q> with |<o - c, q>| <= |o - c| |q|
    reach = best.q @ c + norm * length.max()
    every = np.arange(len(best.ids))
    # in units of scale, and the queries' side of large queries in theirs, so that single precision can hold them
    rows = row_side(codes, length / scale, s, with_centre / scale / scale, c / scale, p)
    asked = every[~(reach + error * scale * most * norm < best.least(every))]
    # an own id is taken out of the best, in each of its vectors
    few = min(k + int(np.unique(flat, return_counts=True)[1].max()), len(x))
    for a in range(0, len(asked), QUERY_BLOCK):
        some = asked[a : a + QUERY_BLOCK]
        q = best.q[some]
        q_scale = np.maximum(np.abs(q).max(1), 1e-300)
        beyond = np.maximum(q_scale / scale, 1.0)
        sides = (query_side(q / scale, c / scale, p) / beyond[:, None]).astype(np.float32)
        q_small = (q / q_scale[:, None]).astype(np.float32)
        unit = scale * q_scale
        span = most * np.sqrt(((q / q_scale[:, None]) ** 2).sum(1))
        slack = error * span
        margin = 2 * slack * unit + np.finfo(float).tiny
        least = best.least(some)
        if not np.isfinite(least).all() and len(x) > few:
            # the products of the best estimates are a first bound of the k-th (one more, for the query itself)
            upper = sides[:, :-1] @ rows[:-1]
            top = np.argpartition(upper, len(x) - few, axis=1)[:, -few:]
            least = np.maximum(least, (np.einsum("qkd,qd->qk", small[top], q_small).min(1) - slack) * unit - np.finfo(float).tiny)
            upper += np.outer(sides[:, -1], rows[-1])
        else:
            upper = sides @ rows
        reached = (least - 4 * single(p.shape[1]) * span * unit) / scale / scale / beyond
        reaching = ~(upper < reached[:, None].astype(np.float32)) if len(x) > few else np.ones(upper.shape, bool)
        of, at = np.divmod(np.flatnonzero(reaching), len(x))
        near = single_products(small, at, q_small, of)
        # products in single precision that can't be among the best
        keep = ~(near * unit[of] < (least - margin)[of])
        of, at, near = of[keep], at[keep], near[keep]
        if not len(of):
            continue
        starts = np.searchsorted(of, np.arange(len(some)))
        sizes = np.diff(starts, append=len(of))
        # the few largest of each query, and what can't be told from them
        order = np.lexsort((-near, of))
        nth = order[np.minimum(starts + np.minimum(sizes, few) - 1, len(of) - 1)]
        floor = np.where(sizes > few, near[nth] - 2 * slack, -np.inf)
        keep = near >= floor[of]
        of, at = of[keep], at[keep]
        scores = double_products(x, at, q, of)
        n = several[at]
        of, scores = np.repeat(of, n), np.repeat(scores, n)
        got = flat[np.repeat(offsets[at] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(of))]
        other = got != best.ids[some][of]
        best.add(some, of[other], got[other], scores[other])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(embeddings: DataFrame) -> DataFrame:
    """id, v, d of the rows that take part."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite).where(F.exists("v", lambda x: x != 0)).select("id", "v", F.size("v").alias("d"))


def sample(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by length of the rows of smallest hash, at most SAMPLE_ROWS."""
    got = rows.orderBy(F.xxhash64(F.lit(SEED), "id"), "id").limit(SAMPLE_ROWS).toArrow().combine_chunks()
    ds, ids = got["d"].to_numpy(), got["id"].to_numpy()
    return {int(d): (ids[ds == d], np.array(got.filter(pa.array(ds == d))["v"].to_pylist(), float)) for d in np.unique(ds)}


def centres(sampled: dict[int, tuple[np.ndarray, np.ndarray]], n: int, rounds: int = 6) -> dict[int, np.ndarray]:
    """Centres by length, fitted on a sample: about sqrt(n) / 16 of them."""
    out = {}
    for d, (_, x) in sampled.items():
        k = int(min(MAX_CELLS, max(1, math.ceil(math.sqrt(n) / 16)), len(x)))
        c = x[np.random.default_rng(SEED).choice(len(x), k, False)] if k > 1 else x.mean(0, keepdims=True)
        for _ in range(rounds if k > 1 else 0):
            own = nearest_centre(x, c)
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            size = np.bincount(own, minlength=k)
            c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
        out[d] = c
    return out


def kth_product(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Of each query, what its k-th largest product with rows of ids other than its own can't fall below."""
    ids, first = np.unique(ids, return_index=True)
    if len(ids) <= k:
        return np.full(len(q), -np.inf)
    x = x[first]
    score = q @ x.T
    finite = np.isfinite(score).all(1)
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    there = np.flatnonzero(ids[at] == own)
    score[there, at[there]] = -np.inf
    error = single(x.shape[1]) * np.sqrt((x * x).sum(1).max()) * np.sqrt((q * q).sum(1)) + np.finfo(float).tiny
    least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k] - error
    return np.where(finite & np.isfinite(least), least, -np.inf)


def bounded(asked: DataFrame, sampled: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Queries with ``floor``, what their k-th score can't fall below."""
    room = {d: max(1, PASS_BYTES // (8 * d)) for d in sampled}
    shared = asked.sparkSession.sparkContext.broadcast({d: (ids[: room[d]], x[: room[d]]) for d, (ids, x) in sampled.items()})

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, QUERY_BLOCK):
                b = whole.slice(a, QUERY_BLOCK)
                ds, floor = b["d"].to_numpy(), np.full(b.num_rows, -np.inf)
                for d in map(int, np.unique(ds)):
                    if d in shared.value:
                        ids, x = shared.value[d]
                        mine = b.filter(pa.array(ds == d))
                        floor[ds == d] = kth_product(x, ids, _matrix(mine["v"], d), mine["id"].to_numpy(), k)
                yield pa.RecordBatch.from_arrays([b["id"], b["v"], b["d"], pa.array(floor)], names=["id", "v", "d", "floor"])

    return asked.mapInArrow(run, "id long, v array<double>, d int, floor double")


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1)[None, :] - 2 * x[a : a + 4096] @ c.T).argmin(1) for a in range(0, len(x), 4096)])


def encode_table(rows: DataFrame, c: dict[int, np.ndarray]) -> DataFrame:
    """id, d, cell, v, code, length, s, with_centre: the index.  A length that the sample lacks has one cell around 0."""
    shared = rows.sparkSession.sparkContext.broadcast(c)

    def run(batches):
        turned: dict[int, np.ndarray] = {}
        for b in batches:
            ds = b["d"].to_numpy()
            for d in map(int, np.unique(ds)):
                part = b.filter(pa.array(ds == d))
                p, c = turned.setdefault(d, rotation(d)), shared.value.get(d, np.zeros((1, d)))
                x = _matrix(part["v"], d)
                cell = nearest_centre(x, c)
                codes, length, s, w = encode(x, c[cell], p)
                yield pa.RecordBatch.from_arrays([part["id"], part["d"], pa.array(cell, pa.int32()), part["v"], pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(length), pa.array(s), pa.array(w)], names=["id", "d", "cell", "v", "code", "length", "s", "with_centre"])

    return rows.mapInArrow(run, "id long, d int, cell int, v array<double>, code binary, length double, s double, with_centre double")


def _search(index: DataFrame, c: dict[int, np.ndarray], asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """query_id, vec_id, score: of each partition the best k of each query."""
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast((c, asked))

    def cells(batches) -> Iterator[tuple[int, int, list[pa.RecordBatch]]]:
        """Runs of rows of one cell, a block at a time."""
        at, held, size = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            key = b["d"].to_numpy().astype(np.int64) << 32 | b["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1), len(key)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if held and (key[i] != at or size >= ROW_BLOCK):
                    yield at >> 32, at & 0xFFFFFFFF, held
                    held, size = [], 0
                at = int(key[i])
                held.append(b.slice(i, j - i))
                size += j - i
        if held:
            yield at >> 32, at & 0xFFFFFFFF, held

    def run(batches):
        c, asked = shared.value
        best, turned = {d: Best(ids, q, k, floor) for d, (ids, q, floor) in asked.items()}, {}
        for d, cell, held in cells(batches):
            if d not in best:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            col = lambda name: t[name].to_numpy()
            codes = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            search_cell(best[d], _matrix(t["v"].combine_chunks(), d), col("id"), codes, col("length"), col("s"), col("with_centre"), c.get(d, np.zeros((1, d)))[cell], turned.setdefault(d, rotation(d)))
        for b in best.values():
            full = np.arange(k)[None, :] < b.filled[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.ids, b.filled)), pa.array(b.found[full]), pa.array(b.score[full])], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(embeddings: DataFrame, queries: DataFrame | None = None, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product of each query.

    ``queries`` has columns vec_id and embedding; by default it is the rows whose id is divisible by ``every``.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    asked = (rows.where(F.col("id") % every == 0) if queries is None else usable(queries)).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n = rows.count()
    nq, longest = asked.agg(F.count(F.lit(1)), F.max("d")).first()
    sampled = sample(rows) if n else {}
    c, asked = centres(sampled, n), bounded(asked, sampled, k)
    size = max(1, min(PASS_QUERIES, PASS_BYTES // (8 * (longest or 1))))
    passes = max(1, math.ceil(nq / size))
    parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / 65_536))
    index = encode_table(rows, c).repartitionByRange(parts, "d", "cell", "id").sortWithinPartitions("d", "cell", "id")
    if passes > 1:
        index, asked = stored(index), stored(asked)
    out = None
    for turn in range(passes):
        mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn)
        # one pass of queries: bounded by PASS_QUERIES and PASS_BYTES
        got = mine.toArrow()
        ds, ids, floor = (got[name].to_numpy() for name in ("d", "id", "floor"))
        sent = {int(d): (ids[ds == d], np.array(got.filter(pa.array(ds == d))["v"].to_pylist(), float), floor[ds == d]) for d in np.unique(ds)}
        found = _search(index, c, sent, k)
        out = found if out is None else out.unionByName(found)
    # rows of one id and score, which two cells may hold, share a rank
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = out.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k)
    return best.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")
