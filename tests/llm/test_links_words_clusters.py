"""SimHash links, spelling variants and Delta Lloyd against plain versions, and over odd rows."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

from colloquy.llm import lloyd, registry, simhash, variants

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- SimHash ---------------------------------------------------------------------------------


def plain_fingerprint(text):
    ws = regex.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_classes(rows):
    """(doc_id, fingerprint, component) of rows (doc_id, text) with ids, by comparing all pairs."""
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, f) in enumerate(fps):
        for j, g in fps[:k]:
            if (f ^ g).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, f"{f:016x}", find(i)) for i, f in fps)


def test_simhash_equals_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 30, 400]))]
        for _ in range(rng.randrange(1, 12)):
            t = list(base)
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
            rows.append((len(rows), " ".join(t).upper() if rng.random() < 0.3 else "\t".join(t)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \n "), (len(rows) + 3, "É é x \x0b q")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_classes(rows)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes(d).collect())
    assert got == want and len({c for _, _, c in want}) < len(rows) - 50


@needs_data
def test_simhash_over_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in registry.op11_simhash(spark, DATA).collect())
    assert got == plain_classes([tuple(r) for r in docs])


@pytest.mark.parametrize("paired", [1, 4, 1024])
def test_index_links_all_near_fingerprints(spark, paired):
    """Values around a few centres, at up to eight flipped bits: components equal those of all pairs, however long lists are worked."""
    rng = random.Random(paired)
    values = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(60):
            values.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))))
    values |= {0, 7, (1 << 64) - 1}
    fps = np.array(sorted(values), np.uint64)
    links = simhash.near(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), paired).collect()
    assert len(links) < len(fps) * len(simhash.LISTS)
    of = {int(x): int(x) for x in fps.view(np.int64)}
    edges = [(r["a"], r["b"]) for r in links]
    want = [(int(a), int(b)) for k, a in enumerate(fps.view(np.int64)) for b in fps.view(np.int64)[:k] if ((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() <= 3]

    def parts(pairs):
        root = dict(of)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        out = defaultdict(set)
        for x in of:
            out[find(x)].add(x)
        return sorted(map(sorted, out.values()))

    assert parts(edges) == parts(want) and len(want) > 50


def test_lists_reach_the_guaranteed_count():
    masks, first = simhash._masks()
    assert len(masks) == math.comb(8, 5)
    assert all((first[s] >= 0) == (s.bit_count() >= 5) for s in range(256))


def test_simhash_flipped_is_paired():
    rng = np.random.default_rng(3)
    mask = 0xFFFFFFFFFF
    fp = np.unique(np.uint64(rng.integers(1 << 40)) | (rng.integers(0, 1 << 9, 400).astype(np.uint64) << np.uint64(40)))
    got = {(int(a), int(b)) for x, y in simhash._flipped(fp, mask) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert got == want


def test_simhash_odd_rows(spark):
    long = "the cat sat on a mat and " * 100_000
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (2, "q", 1), (2, "totally other words here now", 1), (None, "q", 2), (None, "alone by itself without id", 2), (3, None, 3), (4, "", 3), (5, long, 3), (6, long.upper(), 3)]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp int, component string, low int")
    out = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes(d).collect()]
    assert len(out) == len(rows)
    by = defaultdict(set)
    for i, f, c in out:
        by[i].add((f, c))
    assert len(by[1]) == 1 and {c for _, c in by[2]} == {2} and len(by[2]) == 2
    assert {c for _, c in by[None]} == {2, None}
    assert by[3] == by[4] == {("0" * 16, 3)} and {c for _, c in by[5] | by[6]} == {5}
    assert simhash.classes(d.limit(0)).collect() == []


# --- spelling variants -----------------------------------------------------------------------


def plain_groups(rows):
    counts = Counter()
    for i, t in rows:
        for w in regex.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in vocab.items():
        others = [o for o in vocab if o != w and near(w, o)]
        best = min(others, key=lambda o: (-vocab[o], o), default=None)
        form[w] = best if best and vocab[best] >= 2 * n else None
        out[w] = (n, len(others))
    rows = []
    for w, (n, k) in out.items():
        r = w
        while form[r]:
            r = form[r]
        rows.append((w, form[w], r, n, k, vocab.get(form[w])))
    return sorted(rows, key=str)


def found_groups(d):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in variants.groups(d).collect()), key=str)


def test_variants_equal_all_pairs(spark):
    rng = random.Random(11)
    bases = ["aaaaa", "abcde", "müller", "zzzzzzzz", "colour", "center", "ÀÿÞßé"]
    rows = []
    for i in range(400):
        ws = []
        for _ in range(40):
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                p = rng.randrange(len(w) + 1)
                w[p : p + rng.randrange(2)] = rng.choice(["", "a", "z", "é"])
            w = "".join(w)
            ws.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", "-", "1", "×"]).join(ws)))
    rows += [(None, "colour center abcde"), (7, "abcde abcde"), (7, "abcde abcde"), (9, None), (10, "")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(6)
    want = plain_groups(rows)
    assert found_groups(d) == want and sum(r[1] is not None for r in want) > 100 and any(r[1] and r[1] != r[2] for r in want)


def test_variants_odd_rows(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "abcd abcd abcd"), (None, "1 2 3")], "doc_id long, text string")
    assert found_groups(d) == [] and found_groups(d.limit(0)) == []
    long = "x" * 50_000 + " "
    d = spark.createDataFrame([(k, long + long) for k in range(1, 4)] + [(9, ("hello " * 5 + "hallo ") * 300_000)], "doc_id long, text string")
    got = {(r[0][:5], r[1], r[3]) for r in found_groups(d)}
    assert ("hello", None, 1_500_000) in got and ("hallo", "hello", 300_000) in got and any(w == "xxxxx" for w, _, _ in got)


def test_deletion_keys_are_those_of_the_rest():
    words = ["abcde", "aab", "x", "éüé", "a" * 300]
    keys, number, lo, hi = variants.deletion_keys(words)
    rests = [words[k] if p < 0 else words[k][:p] + words[k][p + 1 :] for k, p in zip(number, lo)]
    again = {r: variants.deletion_keys([r])[0][0] for r in rests if r}
    assert len(rests) == 5 + 5 + 2 + 1 + 3 + 1 and (lo[-1], hi[-1]) == (0, 299)
    assert all(again[r] == k for r, k in zip(rests, keys) if r)
    assert all(len({words[k][:p] + words[k][p + 1 :] for p in range(a, b + 1)}) == 1 for k, a, b in zip(number, lo, hi) if a >= 0)


def test_colliding_keys_are_told_apart():
    """Rows of one key whose strings differ never meet."""
    rows = [("abcde", 5, -1, -1), ("abxde", 3, 2, 2), ("abcdef", 4, 5, 5), ("qwert", 9, 0, 0), ("zwert", 9, 0, 0), ("other", 1, -1, -1)]
    assert sorted(variants._nearby(rows)) == [("abcde", 1, "abcdef", 4), ("abcdef", 1, "abcde", 5), ("qwert", 1, "zwert", 9), ("zwert", 1, "qwert", 9)]


def test_long_words_meet_each_other_and_short_ones(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdef") for _ in range(64))
    words = [base, base[:-1], base + "x", base[:30] + "z" + base[30:], base[:40] + "q" + base[41:], base + "y", "x" + base + "y", "k" * 90, "k" * 91, "k" * 45 + "l" + "k" * 44]
    rows = [(i, " ".join(w for k, w in enumerate(words) for _ in range(3 + 4 * k))) for i in range(3)]
    want = plain_groups(rows)
    assert found_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == want and sum(r[4] for r in want) >= 14


# --- centroids -------------------------------------------------------------------------------


def plain_lloyd(rows, k=8, dims=64, rounds=10, scale=1024, seed=3):
    kept = [(i, [min(max(math.floor(scale * float(np.float32(x))), -lloyd.LARGEST), lloyd.LARGEST) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cs = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes()))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[nearest(v)[1]].append(v)
        cs = [[sum(x) // len(held[j]) for x in zip(*held[j])] if held[j] else c for j, c in enumerate(cs)]
    last = [(i, *nearest(v)) for i, v in kept]
    of = Counter()
    for _, d, c in last:
        of[c] += d
    return sorted(((i, c, d, of[c], sum(of.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in last), key=str)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def found_clusters(d, **other):
    return sorted((tuple(r[c] for c in COLUMNS) for r in lloyd.cluster(d, **other).collect()), key=str)


@pytest.mark.parametrize("rounds", [0, 1, 3, 10, 60])
def test_lloyd_equals_plain_rounds(spark, rounds):
    rng = np.random.default_rng(rounds)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(rng.integers(4), 1, 5)]) for i in range(400)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert found_clusters(d, dims=5, rounds=rounds) == plain_lloyd(rows, dims=5, rounds=rounds)


def test_lloyd_compares_what_moved_only():
    """An owner that stayed keeps its vectors unless a moved centroid is nearer, or as near with a smaller number."""
    v = np.array([[0, 0], [10, 0], [4, 0]], np.int64)
    owner, distance = np.array([1, 2, 1]), np.array([4, 100, 4])
    centroids, moved = np.array([[2, 0], [0, 2], [20, 0]], np.int64), np.array([True, False, False])
    new, d = lloyd.assign(v, owner, distance, centroids, moved)
    assert new.tolist() == [0, 0, 0] and d.tolist() == [4, 64, 4]
    new, d = lloyd.assign(v, owner, distance, centroids, np.zeros(3, bool))
    assert new.tolist() == owner.tolist() and d.tolist() == distance.tolist()


def test_lloyd_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [5.0, 5.0]), (8, [-0.0001, 3e38]), (9, [-3e38, 3e38]), (1, [2.0, 2.0])]
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    assert found_clusters(d, dims=2, k=3) == plain_lloyd(rows, k=3, dims=2)
    assert found_clusters(d, dims=2) == plain_lloyd(rows, dims=2)
    empty = lloyd.cluster(d.limit(0), dims=2)
    assert empty.collect() == [] and empty.columns == lloyd.cluster(d, dims=2).columns


def test_lloyd_ties_and_copies(spark):
    rows = [(i, [float(i % 4), 0.0]) for i in range(60)] + [(100 + i, [1.5, 0.0]) for i in range(30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)
    assert found_clusters(d, dims=2, k=4) == plain_lloyd(rows, k=4, dims=2)
