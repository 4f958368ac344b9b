"""Vectors of speakers: centroids, nearest centroid, standard scores, MMR, clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V


def centroids(rows: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Mean vector by label: sums are combined by (label, place) before the shuffle."""
    flat = rows.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = flat.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return packed.select(label, F.transform("p", lambda r: r["x"]).alias("centroid"))


def cosine_to_centroid(rows: DataFrame, label: str, key: str, vec: str = "embedding") -> DataFrame:
    # labels are few: one centroid each
    joined = rows.join(centroids(rows, label, vec), label)
    return joined.select(key, label, V.cosine(F.col(vec), F.col("centroid")).alias("similarity"))


def nearest_centroid(rows: DataFrame, label: str, key: str, vec: str = "embedding", most_labels: int = 10_000) -> DataFrame:
    """The label of least cosine distance.

    Centroids are packed into blocks of ``most_labels`` at most.  One block is sent to every task; with more, every
    row meets each block by a join on the block's number and the least of the blocks counts.
    """
    c = centroids(rows, label, vec)
    blocks = max(1, -(-c.count() // most_labels))
    packed = c.groupBy(F.pmod(F.xxhash64(label), F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "centroid"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda x: F.struct(F.round(V.cosine_distance(F.col(vec), x["centroid"]), 9).alias("d"), x["l"].alias("l")))).alias("best")
    if blocks == 1:
        best = rows.join(F.broadcast(packed)).select(key, near)  # one row
    else:
        dealt = rows.select(key, vec, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        best = dealt.join(packed, "block").select(key, near).groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, F.col("best.l").alias("nearest"), F.col("best.d").alias("distance"))


def label_sizes(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def centroid_distances(rows: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    c = centroids(rows, label, vec)
    a, b = (c.select(F.col(label).alias(f"label_{k}"), F.col("centroid").alias(f"c_{k}")) for k in ("a", "b"))
    return a.join(b, F.col("label_a") < F.col("label_b")).select("label_a", "label_b", V.cosine_distance(F.col("c_a"), F.col("c_b")).alias("distance"))


def standard_scores(rows: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """(x - mean) / population std by place; a std of 0 reads as 1."""
    flat = rows.select(key, F.posexplode(vec).alias("pos", "x"))
    stats = flat.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return flat.join(F.broadcast(stats), "pos").select(key, "pos", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))


def mmr(rows: DataFrame, group: str, key: str, k: int = 5, weight: float = 0.6, vec: str = "embedding") -> DataFrame:
    """Maximal marginal relevance to the group's centroid (of the vectors as they are), in the rows' own order.

    ``rank`` is the place in that order, ``step`` when the row was chosen; k rows or fewer are all kept.  The k - 1
    steps depend on each other, so a group is a task.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        x = np.stack(g[vec].to_numpy()).astype(float)
        chosen = list(range(len(x)))
        if len(x) > k:
            c, length = x.mean(0), np.linalg.norm(x, axis=1)
            near = x @ c / (length * (np.linalg.norm(c) + 1e-8))
            like = lambda i: x @ x[i] / (length * length[i] + 1e-8)
            chosen = [int(near.argmax())]
            most = like(chosen[0])
            while len(chosen) < k:
                value = weight * near - (1 - weight) * most
                value[chosen] = -np.inf
                chosen.append(int(value.argmax()))
                most = np.maximum(most, like(chosen[-1]))
        step = {i: n + 1 for n, i in enumerate(chosen)}
        kept = sorted(chosen)
        return pd.DataFrame({group: g[group].iloc[0], "rank": range(1, len(kept) + 1), "step": [step[i] for i in kept], key: g[key].to_numpy()[kept]})

    kinds = dict(rows.dtypes)
    return rows.select(group, key, vec).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, rank long, step long, {key} {kinds[key]}")


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=-1, keepdims=True) + 1e-12)


def _agglomerate(x: np.ndarray, wanted: set[int], threshold: float) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Average linkage by cosine distance: labels at each wanted number of clusters, and where no pair is nearer than the threshold.

    Every cluster remembers its nearest other, so a merge looks at the rows that it changes.
    """
    n = len(x)
    u = _unit(x)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, label, at = np.ones(n), np.arange(n), d.argmin(1)
    near = d[np.arange(n), at]
    made: dict[int, np.ndarray] = {}
    stopped = None
    number = lambda: np.unique(label, return_inverse=True)[1]
    for left in range(n, 0, -1):
        i = int(near.argmin())
        if stopped is None and (left == 1 or not near[i] < threshold):
            stopped = number()
        if left in wanted:
            made[left] = number()
        if left == 1 or stopped is not None and left <= min(wanted, default=n):
            break
        j = int(at[i])
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        size[i] += size[j]
        label[label == j] = i
        near[j] = np.inf
        closer = d[i] < near
        at[closer], near[closer] = i, d[i][closer]
        for r in np.flatnonzero((at == i) | (at == j) | (np.arange(n) == i)):
            if r != j:
                at[r] = d[r].argmin()
                near[r] = d[r, at[r]]
    return made, stopped if stopped is not None else number()


def _kmeans(x: np.ndarray, k: int, seed: int = 42, starts: int = 10) -> np.ndarray:
    rng, best = np.random.default_rng(seed), (np.inf, np.zeros(len(x), int))
    for _ in range(starts):
        c = x[[int(rng.integers(len(x)))]]
        while len(c) < k:
            far = ((x[:, None] - c[None]) ** 2).sum(2).min(1)
            c = np.vstack([c, x[int(rng.choice(len(x), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(x)))]])
        label = np.full(len(x), -1)
        for _ in range(300):
            d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
            new = d.argmin(1)
            if (new == label).all():
                break
            label = new
            c = np.stack([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
        cost = float(((x - c[label]) ** 2).sum())
        if cost < best[0]:
            best = (cost, label)
    return np.unique(best[1], return_inverse=True)[1]


def _spectral(x: np.ndarray, k: int, neighbours: int) -> np.ndarray:
    """k-means over the leading eigenvectors of the normalised graph of nearest neighbours."""
    d = ((x[:, None] - x[None]) ** 2).sum(2) if len(x) <= 500 else (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)
    graph = np.zeros_like(d)
    np.put_along_axis(graph, np.argsort(d, axis=1, kind="stable")[:, :neighbours], 1.0, 1)
    graph = (graph + graph.T) / 2
    np.fill_diagonal(graph, 0.0)
    scale = 1 / np.sqrt(np.maximum(graph.sum(1), 1e-12))
    _, vectors = np.linalg.eigh(np.eye(len(x)) - scale[:, None] * graph * scale[None, :])
    return _kmeans(vectors[:, :k] * scale[:, None], k)


def _centroid_distances(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels in use, their sizes, and the cosine distances of their centroids (infinite to themselves)."""
    ids, at, n = np.unique(label, return_inverse=True, return_counts=True)
    c = np.zeros((len(ids), x.shape[1]))
    np.add.at(c, at, x)
    u = _unit(c / n[:, None])
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    return ids, n, d


class Speakers:
    """How a meeting's vectors become speakers.

    1. Columns are standardised.  2. ``method`` agglomerative (average linkage, cosine): ``k`` clusters if given, else
    the k of 2 to min(8, n / 2) with the best silhouette where n >= 8 and it is above .01, else all merges under
    ``threshold``; spectral and kmeans take k or min(8, n / 2).  3. One cluster if the vectors are nearly equal: mean
    cosine distance of at most 200 evenly spaced rows under ``alike`` (.08 under 40 rows; raw, then standardised with
    products cut to -1..1), or a mean deviation under .01.  4. One cluster if the centroids' mean distance is under
    ``collapse``, or the silhouette under ``least_silhouette`` where that is given.  5. Clusters under ``least`` rows
    go to the nearest centroid until none is left.  6. Pairs of centroids under ``threshold`` merge, nearest first, by
    the distances and labels before the first merge.  7. At most ten times the nearest pair under ``threshold`` merges
    while the silhouette doesn't fall or isn't negative.  8. Nearest pairs merge down to ``target`` clusters, if given.
    9. More than 20 clusters give way to k-means with min(12, max(2, n / 80)).
    """

    def __init__(self, threshold: float = 0.7, k: int | None = None, least: int = 2, method: str = "agglomerative", alike: float = 0.03, collapse: float = 0.15, least_silhouette: float | None = None, target: int | None = None):
        if method not in ("agglomerative", "spectral", "kmeans"):
            raise ValueError(f"unknown clustering method: {method}")
        self.threshold, self.k, self.least, self.method = threshold, k, least, method
        self.alike, self.collapse, self.least_silhouette, self.target = alike, collapse, least_silhouette, target

    def linked(self, z: np.ndarray, thresholds: tuple[float, ...] = ()) -> dict[float, np.ndarray]:
        """Labels of step 2 by threshold: the clustering itself is shared by all of them."""
        thresholds, n = thresholds or (self.threshold,), len(z)
        if self.method != "agglomerative":
            k = min(n, self.k or max(1, min(8, n // 2)))
            label = _kmeans(z, k) if self.method == "kmeans" else _spectral(z, k, min(10, n - 1))
            return dict.fromkeys(thresholds, label)
        if self.k is not None:
            return dict.fromkeys(thresholds, _agglomerate(z, {min(n, self.k)}, -np.inf)[0][min(n, self.k)])
        ks = set(range(2, min(8, max(2, n // 2)) + 1)) if n >= 8 else set()
        made, _ = _agglomerate(z, ks, -np.inf) if ks else ({}, None)
        best = max(((_silhouette(z, made[k]), -k) for k in sorted(ks)), default=(-1.0, 0))
        if best[0] > 0.01:
            return dict.fromkeys(thresholds, made[-best[1]])
        return {t: _agglomerate(z, set(), t)[1] for t in thresholds}

    def equal(self, x: np.ndarray, z: np.ndarray) -> bool:
        some = np.linspace(0, len(x) - 1, min(200, len(x))).astype(int)
        pairs = np.triu_indices(len(some), 1)
        mean = lambda v: float((1 - np.clip(v[some] @ v[some].T, -1, 1))[pairs].mean())
        return mean(_unit(x)) < (max(self.alike, 0.08) if len(x) < 40 else self.alike) or mean(z) < self.alike or z.std(0).mean() < 1e-2

    def settled(self, z: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Steps 4 to 9."""
        label = label.copy()
        ids, _, d = _centroid_distances(z, label)
        if len(ids) > 1 and d[np.triu_indices(len(ids), 1)].mean() < self.collapse:
            label[:] = 0
        if self.least_silhouette is not None and len(set(label)) > 1 and _silhouette(z, label) < self.least_silhouette:
            return np.zeros(len(z), int)
        while self.least > 1:
            ids, n, d = _centroid_distances(z, label)
            small = np.flatnonzero(n < self.least)
            if not len(small) or len(ids) < 2:
                break
            for i in small:
                label[label == ids[i]] = ids[d[i].argmin()]
        ids, _, d = _centroid_distances(z, label)
        i, j = np.triu_indices(len(ids), 1)
        for at in np.lexsort((j, i, d[i, j])):
            if d[i[at], j[at]] < self.threshold:
                label[label == ids[j[at]]] = ids[i[at]]
        before = _silhouette(z, label) if len(set(label)) > 1 else None
        for _ in range(10):
            new = self._merged(z, label, self.threshold)
            if new is None:
                break
            now = _silhouette(z, new) if len(set(new)) > 1 else 1.0
            if now < 0.0 and (before is None or now < before):
                break
            label, before = new, now
        while self.target is not None and len(set(label)) > max(1, self.target):
            new = self._merged(z, label, 1.0 + 1e-9)
            if new is None:
                break
            label = new
        if len(set(label)) > 20:
            label = _kmeans(z, min(12, max(2, len(z) // 80)))
        return np.unique(label, return_inverse=True)[1]

    @staticmethod
    def _merged(z: np.ndarray, label: np.ndarray, under: float) -> np.ndarray | None:
        """With the nearest pair of centroids as one; nothing if none is nearer than ``under``."""
        ids, _, d = _centroid_distances(z, label)
        if len(ids) < 2:
            return None
        i, j = divmod(int(d.argmin()), len(ids))
        return np.where(label == ids[max(i, j)], ids[min(i, j)], label) if d[i, j] < under else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 2:
            return np.zeros(len(x), int)
        z = standardised(x)
        label = self.linked(z)[self.threshold]
        return np.zeros(len(x), int) if self.equal(x, z) else self.settled(z, label)


def standardised(x: np.ndarray) -> np.ndarray:
    std = x.std(0)
    return (x - x.mean(0)) / np.where(std > 0, std, 1.0)


def cluster(rows: DataFrame, group: str, key: str, vec: str = "embedding", **how) -> DataFrame:
    """Speakers of each meeting's vectors; ``how`` are the parameters of :class:`Speakers`.

    A meeting holds a few thousand windows, so a meeting is a group; meetings run side by side.
    """
    speakers = Speakers(**how)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(key)
        label = speakers(np.stack(g[vec].to_numpy()).astype(float))
        return pd.DataFrame({group: g[group].iloc[0], key: g[key].to_numpy(), "speaker_id": [f"SPEAKER_{i:02d}" for i in label]})

    kinds = dict(rows.dtypes)
    return rows.select(group, key, vec).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, speaker_id string")


def compare_methods(rows: DataFrame, group: str, key: str, vec: str = "embedding", methods: tuple[str, ...] = ("agglomerative", "spectral"), **how) -> DataFrame:
    """Clusters and silhouette of each meeting by method: (meeting, method) is a group."""
    made = {m: Speakers(method=m, **how) for m in methods}

    def run(key_, g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g.sort_values(key)[vec].to_numpy()).astype(float)
        label = made[key_[1]](x)
        return pd.DataFrame({group: [key_[0]], "method": [key_[1]], "clusters": [len(set(label))], "silhouette": [_silhouette(standardised(x), label) if len(set(label)) > 1 else 0.0]})

    grid = rows.select(group, key, vec, F.explode(F.array(*map(F.lit, methods))).alias("method"))
    return grid.groupBy(group, "method").applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, method string, clusters int, silhouette double")


def mean_pairwise_distance(rows: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean cosine distance over all pairs of rows (the spread behind a collapse test), from sums of unit vectors.

    The similarities of all ordered pairs add up to |sum u|^2, those of rows with themselves to sum |u|^2; ``key``
    names the rows, whose number alone counts. Fewer than two vectors have no mean.
    """
    u = rows.select(key, V.unit(F.col(vec)).alias("u")).where("u is not null")
    own = u.agg(F.count(F.lit(1)).alias("n"), F.sum(V.dot(F.col("u"), F.col("u"))).alias("own"))
    total = u.select(F.posexplode("u").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("total"))
    pairs = F.col("n") * (F.col("n") - 1)
    return own.join(F.broadcast(total)).select(F.when(pairs > 0, 1 - (F.col("total") - F.col("own")) / pairs).alias("mean_distance"), (pairs / 2).cast("long").alias("pairs"))


def label_silhouette(rows: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """Mean silhouette (cosine) of each label: a row meets the sums of all labels, an array sent by label's number.

    Labels' sums meet the rows through a join on nothing only as one packed row, whose size grows with the labels; with
    more than 10,000 of them this raises.
    """
    e = rows.select(label, V.unit(F.col(vec)).alias("u"))
    flat = e.select(label, F.posexplode("u").alias("pos", "x")).groupBy(label, "pos").agg(F.sum("x").alias("x"))
    sums = flat.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"]).alias("s"))
    n = e.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    if n.count() > 10_000:
        raise ValueError("more than 10,000 labels; a silhouette against all of them isn't made")
    packed = sums.join(n, label).agg(F.collect_list(F.struct(F.col(label).alias("l"), "s", "n")).alias("all"))
    every = e.join(F.broadcast(packed))  # one row, bounded above
    far = lambda c: c["n"] - V.dot(F.col("u"), c["s"])
    a = F.element_at(F.transform(F.filter("all", lambda c: c["l"] == F.col(label)), lambda c: F.when(c["n"] > 1, far(c) / (c["n"] - 1)).otherwise(0.0)), 1)
    b = F.array_min(F.transform(F.filter("all", lambda c: c["l"] != F.col(label)), lambda c: far(c) / c["n"]))
    scored = every.select(label, a.alias("a"), b.alias("b")).select(label, ((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))
    return scored.groupBy(label).agg(F.avg("s").alias("silhouette"))


def _silhouette(x: np.ndarray, label: np.ndarray) -> float:
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    ids, n = np.unique(label, return_counts=True)
    if len(ids) < 2:
        return -1.0
    sums = np.stack([u[label == i].sum(0) for i in ids])
    d = n[None, :] - u @ sums.T  # summed distances to each cluster
    own = np.searchsorted(ids, label)
    rows = np.arange(len(x))
    a = np.where(n[own] > 1, d[rows, own] / np.maximum(n[own] - 1, 1), 0.0)
    other = d / n[None, :]
    other[rows, own] = np.inf
    b = other.min(1)
    return float(np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).mean())


def auto_tune(
    rows: DataFrame, group: str, key: str, thresholds: tuple[float, ...] = (0.95, 0.85, 0.7, 0.5, 0.3, 0.15), sizes: tuple[int, ...] = (1, 2, 3, 4),
    target: int | None = None, vec: str = "embedding",
) -> DataFrame:
    """Threshold and minimum size of each meeting with the best silhouette - .1 |k - target| - .02 k; the first of equals.

    Each cell goes through the whole of ``cluster``; one cluster has a silhouette of 0.  The cells of a meeting share
    its linkage, so a meeting is a group.
    """
    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(g.sort_values(key)[vec].to_numpy()).astype(float)
        best, z = None, standardised(x)
        alone = len(x) < 2 or Speakers().equal(x, z)
        linked = {} if alone else Speakers().linked(z, thresholds)
        for t in thresholds:
            for size in sizes:
                label = np.zeros(len(x), int) if alone else Speakers(t, least=size).settled(z, linked[t])
                k = len(set(label))
                score = (_silhouette(z, label) if k > 1 else 0.0) - (0.1 * abs(k - target) if target is not None else 0.0) - 0.02 * k
                if best is None or score > best[-1]:
                    best = (t, size, k, score)
        return pd.DataFrame([(g[group].iloc[0], *best)], columns=[group, "threshold", "min_size", "clusters", "score"])

    return rows.select(group, key, vec).groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, threshold double, min_size int, clusters int, score double")
