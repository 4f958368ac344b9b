"""The operators against brute force, planted cases and held-out labels."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, html, langid, licenses, lmscore, mixing, nearest, neardup, quality, registry, toxicity
from colloquy.llm.components import components

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- mixing ----------------------------------------------------------------------------------


def test_raking_meets_all_marginals(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, rng.randrange(1, 300))), rng.choice(["en", "en", "en", "fr", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(6)}") for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(d, langs={"en": 0.5, "fr": 0.3, "und": 0.2}).toPandas()
    out["w"] = out.n_tokens * out.weight
    total = out.n_tokens.sum()
    lang = out.groupby("lang").w.sum() / total
    assert np.allclose([lang["en"], lang["fr"], lang["und"]], [0.5, 0.3, 0.2], atol=1e-5)
    for c in ("source", "topic"):
        seen, got = out.groupby(c).n_tokens.sum() / total, out.groupby(c).w.sum() / total
        want = seen**0.7 / (seen**0.7).sum()
        assert np.allclose(got[want.index], want, atol=1e-5)
    # the cell weights are the fixed point that plain fitting over cells reaches
    cell = out.groupby(["source", "lang", "topic"]).n_tokens.sum().astype(float)
    t = cell.copy()
    goals = {"source": None, "lang": {"en": 0.5, "fr": 0.3, "und": 0.2}, "topic": None}
    for _ in range(200):
        for k, c in enumerate(goals):
            seen = cell.groupby(level=k).sum() / total
            want = seen**0.7 / (seen**0.7).sum() if goals[c] is None else {a: goals[c][a] for a in seen.index}
            now = t.groupby(level=k).sum() / total
            t = t * t.index.get_level_values(k).map(lambda a: want[a] / now[a])
    assert np.allclose((t / cell).sort_index(), out.groupby(["source", "lang", "topic"]).weight.first().sort_index(), rtol=1e-4)
    assert out.probability.max() <= 1 + 1e-12 and abs(out.probability.max() - 1) < 1e-9
    assert abs(out.kept.mean() - out.probability.mean()) < 0.08
    # at most a hundredth of the target mass lies in cells that are kept whole but ask for more
    over = out[out.weight > out[out.probability >= 1].weight.min() * (1 + 1e-12)]
    assert over.w.sum() <= 0.01 * total + 1e-6
    none = mixing.mix(d, slack=0.0).toPandas()
    assert np.allclose(none.probability, none.weight / none.weight.max())


def test_a_tiny_source_does_not_set_the_rate(spark):
    rows = [(i, " ".join(["w"] * 50), "en", f"s{i % 8}") for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    more = d.unionByName(spark.createDataFrame([(10**6, "w " * 20, "en", "tiny")], d.schema))
    a, b = (mixing.mix(x).where("source <> 'tiny'").agg(F.avg("probability")).first()[0] for x in (d, more))
    assert a > 0.95 and b > 0.9


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST_LEVELS, 3])
def test_every_level_meets_its_target(spark, monkeypatch, broadcast):
    """450 languages, one of them named other: half of all tokens for the smallest; with factors sent or joined."""
    monkeypatch.setattr(mixing, "BROADCAST_LEVELS", broadcast)
    rows = [(i, "w " * (20 + i % 7 if i % 450 else 3), "other" if i % 450 == 7 else f"l{i % 450}", f"s{i // 450 % 4}") for i in range(450 * 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langs = {"l0": 0.5, "other": 0.1} | {f"l{k}": 0.4 / 448 for k in range(1, 450) if k != 7}
    out = mixing.mix(d, langs=langs, topic=F.floor(F.col("doc_id") / 1800)).toPandas()
    out["w"] = out.n_tokens * out.weight
    got = out.groupby("lang").w.sum() / out.n_tokens.sum()
    assert len(out) == 5400 and len(got) == 450 and max(abs(got[k] - langs[k]) for k in langs) < 1e-5
    for of in ("source", "topic"):
        seen, now = out.groupby(of).n_tokens.sum() / out.n_tokens.sum(), out.groupby(of).w.sum() / out.n_tokens.sum()
        assert np.allclose(now, seen**0.7 / (seen**0.7).sum(), atol=1e-5)


# --- nearest ---------------------------------------------------------------------------------


@pytest.mark.parametrize("d", [16, 64, 100])
def test_nearest_against_all_pairs(spark, d):
    rng = np.random.default_rng(d)
    centres = rng.standard_normal((5, d))
    x = (centres[rng.integers(0, 5, 600)] + 0.7 * rng.standard_normal((600, d))).astype(np.float32)
    x[100:140] = x[100]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got: dict[int, list] = {}
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    found = total = 0
    for q in range(0, 600, 20):
        s = (x.astype(float) * x[q].astype(float)).sum(1)
        best = [j for j in np.lexsort((np.arange(600), -s)) if j != q][:20]
        found += len({v for v, _ in got[q]} & set(best))
        total += 20
        assert all(abs(score - s[v]) < 1e-9 for v, score in got[q])
    assert found / total >= 0.98


def test_estimate_lies_within_its_bound():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((500, 64)), rng.standard_normal((40, 64))
    c, p = x.mean(0), nearest.rotation(64)
    est, bound = nearest.estimate(*nearest.encode(x, c, p), q, c, p)
    wrong = np.abs(est - q @ x.T) > bound
    assert wrong.mean() < 0.005 and abs((est - q @ x.T).mean()) < 0.2


def test_nearest_keeps_large_repeated_and_equal_rows(spark):
    rng = np.random.default_rng(3)
    base = 2**53
    vectors = [rng.standard_normal(8).tolist() for _ in range(11)]
    rows = [(base + i, v) for i, v in enumerate(vectors)] * 3 + [(base + 3, vectors[4]), (base + 100, vectors[0]), (base + 101, vectors[0])]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=4).collect()
    for q in {i for i, _ in rows if i % 4 == 0}:
        asked = min(v for i, v in rows if i == q)
        want = sorted({(-float(nearest.products(np.array([v]), np.array([asked]))[0]), i) for i, v in rows if i != q})[:20]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_nearest_in_passes_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((700, 12))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, nearest.nearest(d).collect()))
    monkeypatch.setattr(nearest, "PASS_QUERIES", 9)
    monkeypatch.setattr(nearest, "ROW_BLOCK", 40)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, nearest.nearest(d).collect())) == whole and len(whole) == 700


def test_nearest_bounds_leave_few_pairs():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    q, c, p = x[::80], x.mean(0), nearest.rotation(64)
    est, bound = nearest.estimate(*nearest.encode(x, c, p), q, c, p)
    true = q @ x.T
    kth = np.sort(true, axis=1)[:, -21]
    reaching = est + bound >= kth[:, None]
    assert reaching.mean() < 0.15 and reaching[true >= kth[:, None]].mean() > 0.995


def test_nearest_first_bound_of_a_sample(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x, ids = rng.standard_normal((300, 16)), np.repeat(np.arange(150), 2)
    q, own = x[::10], ids[::10]
    floor = nearest.kth_product(x, ids, q, own, 20)
    for u, least in enumerate(floor):
        firsts, every = (sorted((f(x[ids == i] @ q[u]) for i in range(150) if i != own[u]), reverse=True) for f in (lambda s: s[0], max))
        assert firsts[19] - 0.01 < least <= firsts[19] <= every[19]
    assert np.isneginf(nearest.kth_product(x[:40], ids[:40], q, own, 20)).all()
    assert np.isneginf(nearest.kth_product(1e200 * x, ids, 1e200 * q, own, 20)).all()
    # a sample that holds few of the rows, and products that single precision can't hold
    monkeypatch.setattr(nearest, "SAMPLE_ROWS", 60)
    for size in (1.0, 3e19, 1e30, 1e-30):
        v = size * x
        d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
        got = [(r["query_id"], r["vec_id"]) for r in nearest.nearest(d).orderBy("query_id", "rank").collect()]
        assert got == [(i, j) for i in range(0, 300, 20) for j in [j for j in np.argsort(-(v @ v[i])) if j != i][:20]]


# --- toxicity, quality, language ---------------------------------------------------------------


def test_unseen_letters_have_no_say():
    m = toxicity.KneserNeyRatio({"idiot": (0, 30), "idiotic": (0, 5), "table": (40, 30), "tablet": (20, 20), "idea": (30, 10)})
    assert m.word("idiot") > 2 and m.word("idiots") > 1
    assert m.word("table") < 0.5 and abs(m.word("zzzz")) < 1.5


def plain_kneser_ney(counts, word, y, order, shared):
    """log P(word | class), by the definition, recursively over contexts."""
    from functools import lru_cache

    level = {k: {} for k in range(1, order + 1)}
    for w, by in counts.items():
        s = f"\x02{w}\x03"
        for i in range(1, len(s)):
            g = s[max(0, i - order + 1) : i + 1]
            c = level[len(g)].setdefault(g, [0, 0])
            c[0], c[1] = c[0] + by[0], c[1] + by[1]
    for k in range(order, 1, -1):
        for g, by in level[k].items():
            c = level[k - 1].setdefault(g[1:], [0, 0])
            c[0], c[1] = c[0] + (by[0] > 0), c[1] + (by[1] > 0)

    def count(g):
        c = level[len(g)].get(g, [0, 0])
        return sum(c) if len(g) <= shared else c[y]

    @lru_cache(None)
    def discount(k):
        n = [count(g) for g in level[k]]
        return max(0.1, min(0.95, n.count(1) / (n.count(1) + 2 * n.count(2)))) if n.count(1) else 0.75

    def p(g):
        if not g:
            return 1 / (len(level[1]) + 1)
        below = p(g[1:])
        after = [n for h, n in ((h, count(h)) for h in level[len(g)] if h[:-1] == g[:-1]) if n > 0]
        d = discount(len(g))
        return (max(count(g) - d, 0) + d * len(after) * below) / sum(after) if after else below

    s = f"\x02{word}\x03"
    return sum(math.log(p(s[max(0, i - order + 1) : i + 1])) for i in range(1, len(s)))


def test_ratios_equal_a_plain_model():
    rng = random.Random(8)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))): (rng.randrange(4), rng.randrange(4)) for _ in range(40)}
    counts = {w: c for w, c in counts.items() if sum(c)}
    m = toxicity.KneserNeyRatio(counts, order=4, shared=2)
    # the models differ above the shared orders only, so letters with shorter contexts have a ratio of 1
    for word in [*list(counts)[:12], "abcabc", "ccc", "a"]:
        want = plain_kneser_ney(counts, word, 1, 4, 2) - plain_kneser_ney(counts, word, 0, 4, 2)
        assert math.isclose(m.word(word), want, abs_tol=1e-9), word


def test_combining_marks_and_words_are_cut_alike(spark):
    rows = [(i, "e\u0301a हिन्दी ok" if i % 2 else "plain words", i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit(d, d.select("doc_id", "toxic"))
    x = toxicity.features("e\u0301a हिन्दी ok", toxicity.Ratios(m.ratio))
    assert m.score(np.array([x]))[0] > 0.5 > m.score(np.array([toxicity.features("plain words", toxicity.Ratios(m.ratio))]))[0]


def test_many_repeats_of_a_labelled_row_are_learnt_once(spark):
    d = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("ein Satz hier").alias("text"), F.lit("de").alias("lang"))
    d = d.unionByName(spark.createDataFrame([(i, f"some sentence {i}", "en") for i in range(2, 30)], d.schema))
    m = langid.fit(d, max_rows=20)
    assert set(m.names) <= {"de", "en"}
    la = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)], "doc_id long, quality int, toxic int")
    assert quality.fit(d, la, max_rows=20).grades and toxicity.fit(d, la, max_rows=20)


@needs_data
def test_toxicity_held_out(spark):
    d, la = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.classify(d, la).join(la, "doc_id").toPandas()
    h = r[r.held_out]
    assert (h.predicted == h.toxic).mean() > 0.9
    assert ((r.score >= 0) & (r.score <= 1)).all()


def test_ordinal_thresholds(spark):
    rng = random.Random(4)
    marks = ["awful", "poor", "fair", "great"]
    rows = [(i, " ".join(words(rng, 30) + [marks[i % 4]] * 5), i % 4) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = quality.fit(d, d.select("doc_id", "quality"))
    assert m.grades == [0, 1, 2, 3] and (np.diff(m.thresholds) > 0).all()
    out = quality.grade(d, d.select("doc_id", "quality")).join(d.select("doc_id", F.col("quality").alias("y")), "doc_id").toPandas()
    means = out.groupby("y").expected_grade.mean()
    assert means.is_monotonic_increasing and abs(out.expected_grade - out.y).mean() < 0.6
    assert ((out["tail"] >= 0) & (out["tail"] <= 1)).all()


def test_thresholds_equal_a_plain_fit():
    """One feature and three grades: gradient steps reach what a search over the same loss finds."""
    rng = np.random.default_rng(2)
    v = rng.uniform(-2, 2, 400)
    y = np.digitize(1.5 * v + rng.logistic(size=400), [-0.5, 1.0])
    m = quality.fit_ordinal([(np.array([7]), np.array([a])) for a in v], y, [0, 1, 2], bits=4, epochs=60, l2=0.0)

    def loss(w, t):
        p = np.concatenate([np.ones((400, 1)), 1 / (1 + np.exp(-(w * v[:, None] - np.array(t)[None, :]))), np.zeros((400, 1))], axis=1)
        return -np.log(np.maximum(p[np.arange(400), y] - p[np.arange(400), y + 1], 1e-12)).mean()

    best = min(((loss(w, (a, b)), w, a, b) for w in np.arange(0.9, 2.2, 0.05) for a in np.arange(-1.2, 0.4, 0.1) for b in np.arange(0.4, 1.9, 0.1)))
    assert loss(m.weights[7], m.thresholds) < best[0] + 0.01
    assert abs(m.weights[7] - best[1]) < 0.3 and np.abs(m.thresholds - best[2:]).max() < 0.35


@needs_data
def test_quality_held_out(spark):
    d, la = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    r = quality.grade(d, la).join(la, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert (r.kept == (r.quality == 1)).mean() > 0.9


def test_leader_equals_a_dense_one():
    """The sparse steps against the definition over whole matrices."""
    rng = np.random.default_rng(6)
    n, k, a, b, l1, l2 = 12, 3, 0.5, 1.0, 0.02, 0.1
    model = langid.FtrlSoftmax(n, k, a, b, l1, l2)
    z, s = np.zeros((n, k)), np.zeros((n, k))
    for _ in range(200):
        x = rng.random(n) * (rng.random(n) < 0.4)
        y = int(rng.integers(k))
        w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((b + np.sqrt(s)) / a + l2))
        g = np.outer(x, langid.softmax(x @ w) - np.eye(k)[y])
        z += g - (np.sqrt(s + g * g) - np.sqrt(s)) / a * w
        s += g * g
        at = np.flatnonzero(x)
        model.learn(at, x[at], y)
    assert np.allclose(model.z, z) and np.allclose(model.n, s)
    assert np.allclose(model.weights(slice(None)), np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((b + np.sqrt(s)) / a + l2)))


@needs_data
def test_language_held_out(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    m = langid.fit(d)
    assert 0 < (m.weights != 0).mean() < 0.5
    r = langid.identify(d, m).join(d.select("doc_id", "lang"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    assert (r.lang_pred == r.lang).mean() > 0.97
    # calibrated: the mean score is near the accuracy
    assert abs(r.score.mean() - (r.lang_pred == r.lang).mean()) < 0.05


def test_language_query_names_the_fold(spark, tmp_path):
    rows = [(i, "das ist ein Satz" if i % 2 else "this is a sentence", "de" if i % 2 else "en") for i in range(60)] + [(None, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = registry.op10_langid(spark, str(tmp_path))
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    held = {r["doc_id"]: r["held_out"] for r in out.collect()}
    assert held == {None: True} | {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)}
    assert 0 < sum(held.values()) < len(held)


# --- decontamination ---------------------------------------------------------------------------


def test_wand_returns_what_scoring_all_returns():
    rng = random.Random(2)
    items = [(i, " ".join(words(rng, rng.randrange(5, 40), 120))) for i in range(60)]
    index = decontaminate.ItemIndex(items)
    for _ in range(60):
        text = " ".join(words(rng, 80, 120))
        terms = sorted({index.terms[w] for w in text.split() if w in index.terms})
        for threshold in (0.2, 0.4, 0.6):
            plain = {i: s for i in range(len(index.ids)) if (s := sum(index.scores[t][index.items[t].index(i)] for t in terms if i in index.items[t])) >= threshold}
            got = {i: s for b in range(index.maxima.shape[1]) for i, s in index.wand(terms, threshold, b)}
            assert got.keys() == plain.keys() and all(math.isclose(got[i], plain[i]) for i in got)
            # the block bounds let all of them through
            asked = {int(b) for *_, blocks in index.passages(np.array([index.terms[w] for w in text.split() if w in index.terms]), threshold) for b in blocks}
            assert {i // index.size for i in plain} <= asked


def test_planted_leaks_and_clean_rows(spark):
    rng = random.Random(3)
    items = [(i, f"{' '.join(words(rng, 12, 5000))}. {' '.join(words(rng, 6, 5000))}.") for i in range(30)]
    docs = [(i, " ".join(words(rng, 400, 5000))) for i in range(60)]
    planted = {}
    for k in range(20):
        ws = docs[k][1].split()
        at = rng.randrange(len(ws))
        docs[k] = (k, " ".join(ws[:at] + items[k % 30][1].upper().split() + ws[at:]))
        planted[k] = k % 30
    docs.append((99, items[25][1].split(".")[0]))  # a question without its answer
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()}
    assert got == set(planted.items())
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b, max_postings=100).collect()} == got
    assert {r["doc_id"] for r in decontaminate.keep_clean(d, b).collect()} == {i for i, _ in docs} - set(planted)


def test_scores_are_those_of_all_items(spark):
    """However many indexes the items are dealt to; an item without an id matches too."""
    rng = random.Random(12)
    items = [(i if i else None, f"{' '.join(words(rng, rng.randrange(6, 30), 300))}. {' '.join(words(rng, 4, 300))}.") for i in range(25)]
    docs = [(k, " ".join(words(rng, 60, 300) + [w for w in items[k][1].split() if rng.random() < 0.9] + words(rng, 60, 300))) for k in range(25)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, *others = (sorted((tuple(r) for r in decontaminate.leaks(d, b, overlap=0.3, max_postings=n).collect()), key=str) for n in (10**6, 60, 150))
    assert len(one) >= 10 and any(r[1] is None for r in one) and all(x == one for x in others)
    # plain BM25 over every passage
    index = decontaminate.ItemIndex(items)
    split = {i: index.parts[n] for n, i in enumerate(index.ids)}
    assert index.stride == 64 and [decontaminate.stride_of(n) for n in (0, 1, 64, 65, 128, 4000)] == [64, 64, 64, 128, 128, 4096]
    want = []
    for k, text in docs:
        ws = text.replace(".", "").split()
        for n, i in enumerate(index.ids):
            best = None
            for a in range(0, max(1, len(ws) - index.stride), index.stride):
                z = min(a + 2 * index.stride, len(ws))
                score = sum(index.scores[t][index.items[t].index(n)] for w in set(ws[a:z]) if (t := index.terms.get(w)) is not None and n in index.items[t])
                near = decontaminate.grams(ws[max(0, a - index.stride) : z + index.stride])
                shares = [len(p & near) / len(p) for p in split[i]]
                if score >= 0.5 and min(shares) >= 0.3:
                    best = max(best or (0,), (score, *shares))
            if best:
                want.append((k, i, *best))
    assert [r[:2] for r in one] == [r[:2] for r in sorted(want, key=str)]
    assert np.allclose([r[2:] for r in one], [r[2:] for r in sorted(want, key=str)])


def test_a_long_item_changes_no_other_items_passages(spark):
    """A question, filler and its answer are no hit, whatever other items there are; a long item is found in a long text."""
    rng = random.Random(17)
    question, answer = words(rng, 20, 10**6), words(rng, 6, 10**6)
    items = [(1, f"{' '.join(question)}. {' '.join(answer)}."), (2, f"{' '.join(words(rng, 30, 10**6))}. {' '.join(words(rng, 9, 10**6))}.")]
    long = [words(rng, 20, 10**6) for _ in range(200)]
    docs = [
        (1, " ".join(question + words(rng, 3000, 10**6) + answer)), (2, " ".join(words(rng, 500, 10**6) + question + words(rng, 10, 10**6) + answer)),
        (3, " ".join(words(rng, 900, 10**6) + [w for s in long for w in s] + words(rng, 50, 10**6))), (4, " ".join(w for s in long[:60] for w in s)),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    few, more = (sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, spark.createDataFrame(b, "item_id long, text string")).collect()) for b in (items, [*items, (3, ". ".join(" ".join(s) for s in long))]))
    assert few == [(2, 1)] and more == [(2, 1), (3, 3)]


# --- licenses ----------------------------------------------------------------------------------


def test_license_places_and_merged_diagonals(spark):
    notice = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
    bent = notice.replace("of charge", "of any charge")  # a word more: two neighbouring diagonals
    rows = [(1, "MIT License, mit-license; the GENERAL public license"), (2, f"x y {notice.upper()} z"), (3, f"x {bent}"), (4, "permission is hereby granted to nobody"), (5, "mit\nlicenses mitlicense"), (6, "Licensed under CC BY-NC 4.0.")]
    out = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (out[1]["n_words"], out[1]["n_base"], out[1]["first_word"], out[1]["last_word"], out[1]["base_labels"]) == (8, 3, 0, 5, "gpl,mit")
    assert out[2]["labels"] == out[3]["labels"] == "mit-notice" and out[2]["score"] == 1.0 and 0.9 < out[3]["score"] < 1.0
    assert out[4]["labels"] == out[5]["labels"] == "" and out[4]["n_base"] == 0 and out[6]["labels"] == "cc-by-nc"
    s = {r["doc_id"]: (r["start"], r["end"]) for r in licenses.spans(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id in (2, 3)").collect()}
    assert s == {2: (2, 21), 3: (1, 21)}


# --- language models ---------------------------------------------------------------------------


def plain_words(text):
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}_]+", (text or "").lower())


def plain_losses(docs):
    """id -> (target, background) loss of (id, words, corpus) rows, by dictionaries."""
    from collections import Counter

    uni, bi = ({of: Counter(x for _, ws, o in docs if o == of for x in f(ws)) for of in (0, 1)} for f in (lambda ws: ws, lambda ws: zip(ws, ws[1:])))
    vocabulary, out = len(uni[0] | uni[1]), {}
    for i, ws, own in docs:
        losses = []
        for of in (1, 0):
            less_w, less_p = (Counter(ws), Counter(zip(ws, ws[1:]))) if own == of else (Counter(), Counter())
            n, loss = sum(uni[of].values()) - sum(less_w.values()), 0.0
            for k, w in enumerate(ws):
                p = (uni[of][w] - less_w[w] + lmscore.KAPPA) / (n + lmscore.KAPPA * (vocabulary + 1))
                lead, both = (uni[of][ws[k - 1]] - less_w[ws[k - 1]], bi[of][ws[k - 1], w] - less_p[ws[k - 1], w]) if k else (0, 0)
                loss -= math.log((both + lmscore.MU * p) / (lead + lmscore.MU))
            losses.append(loss / len(ws) if ws else 0.0)
        out[i] = tuple(losses)
    return out


@pytest.mark.parametrize("tokens,chunk", [(600_000, 1_500_000), (50, 40)])
def test_losses_equal_plain_counts(spark, monkeypatch, tokens, chunk):
    monkeypatch.setattr(lmscore, "BLOCK_TOKENS", tokens)
    rng = random.Random(6)
    odd = ["e\u0301a", "हिन्दी", "x²", "İz", "½", "a_b", "\x00q", "don't", "ß"]
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60), 80) + rng.sample(odd, 3)) + (" mark mark tone" if i % 3 == 0 else "")) for i in range(90)]
    rows += [(200, None), (201, "... !"), (202, "w1 " * 3000 + "z" * 200_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    la = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lmscore.score(d, la, chunk).collect()}
    docs = [(r["doc_id"], plain_words(r["text"]), r["of"]) for r in lmscore.corpora(d, la).collect()]
    want = plain_losses(docs)
    assert got.keys() == want.keys()
    for i, ws, _ in docs:
        assert got[i]["n_tokens"] == len(ws)
        assert math.isclose(got[i]["target_loss"], want[i][0], abs_tol=1e-9) and math.isclose(got[i]["background_loss"], want[i][1], abs_tol=1e-9)
    target, other = ([got[i]["score"] for i, ws, _ in docs if i < 90 and (i % 3 == 0) == wanted] for wanted in (True, False))
    assert np.mean(target) < np.mean(other)


# --- html --------------------------------------------------------------------------------------


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><div class="cookie-notice">We use <div>cookies</div></div>
    <article class="post"><header>Site</header><h1>Title &amp; more</h1><p>First<br>line <b>bold</p><p>Second &nbsp; one<script>var x = "</p>";</script></p><div id="comments"><p>me too</p></div><form><p>mail</p></form></article>
    <aside>side</aside><footer>&copy;</footer></body></html>"""
    assert html.lines_of(page) == (["Title & more", "First line bold", "Second one"], [False] * 3)
    assert html.lines_of("<div class=ad>buy<article><p>text</article> tail")[0] == ["text"]
    assert html.lines_of("<article><p>text</p><div>Loose</div></article>") == (["text", "Loose"], [False, True])
    assert html.lines_of("<p>a &am")[0] == ["a &am"]
    assert html.lines_of("<p>a</p><p>cut <b cl") == (["a", "cut"], [True, True])
    assert html.lines_of("1 < 2 <p title='a>b'>c<p title=\"d>e")[0] == ["1 < 2", "c", "e"]


@pytest.mark.parametrize("piece", ["<a ", '<a "', "<a \"x>\" ", "<a '\"", "</script ", "<!-- ", "<", "<a \">", "<div>", "<p class='x", "&", "<script>"])
def test_long_broken_markup_takes_no_longer_than_its_length(piece):
    import time

    html.lines_of(piece)
    took = []
    for n in (100_000, 400_000):
        began = time.perf_counter()
        html.lines_of(piece * (n // len(piece)))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5 and took[1] < 5


def test_blocks_equal_a_plain_stack_parser():
    """Well-formed pages: a parser that keeps a stack of open elements finds the same article."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.parts, self.out = [], [], []

        def flush(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text and "article" in [t for t, _ in self.stack] and not any(out for _, out in self.stack):
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in html.BLOCK:
                self.flush()
            if tag == "br":
                self.parts.append(" ")
            if tag not in html.VOID:
                a = dict(attrs)
                self.stack.append((tag, tag in html.NEVER or tag in html.RAW or (a.get("class") or "") in ("ad", "sidebar", "comments")))

        def handle_endtag(self, tag):
            if tag in html.BLOCK:
                self.flush()
            self.stack.pop()

        def handle_data(self, data):
            if not any(out for _, out in self.stack):
                self.parts.append(data)

    rng = random.Random(21)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["one &amp; two", " x\n y ", "ü &eacute; ", "a<br>b", "<!-- no > -->", "<script>if (a < b) {}</script>"])
        tag = rng.choice(["p", "div", "b", "i", "ul", "li", "section", "nav", "footer", "h2", "form", "div class='ad'", "div class=sidebar"])
        return f"<{tag}>{''.join(element(depth - 1) for _ in range(rng.randrange(1, 4)))}</{tag.split()[0]}>"

    for _ in range(200):
        page = f"<html><body><nav>menu</nav><article>{''.join(element(4) for _ in range(4))}</article><footer>f</footer></body></html>"
        plain = Plain()
        plain.feed(page)
        plain.close()
        if plain.out:
            assert html.lines_of(page)[0] == plain.out, page


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = html.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert len(got) == t[-1][-1] and got == sorted(set(got))
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in got)


def test_neighbours_delete_what_both_have(spark):
    page = lambda x: f"<div>Top of site</div><div>{x} text one</div><div>{x} text two</div><div>Bottom of site</div>"
    rows = [(i, f"http://h{i % 2}.org/a/{i:03d}?q=1", page(f"page {i}")) for i in range(40)] + [(90, "http://alone.org/", page("x")), (91, "http://h1.org/a/000z", page("page 1"))]
    rows += [(92, "http://h0.org/b", "<article><p>Top of site</p><p>Own</p></article>")]
    # in an article only loose lines go, and not by a copy but by the page behind it
    rows += [(i, f"http://h3.org/{i}", f"<article><div>Share this</div><p>Share this</p><p>story {i // 2}</p></article>") for i in (100, 101, 102)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    out = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    assert all(out[i] == f"page {i} text one\n\npage {i} text two" for i in range(2, 40))
    assert out[90].startswith("Top of site") and out[92] == "Top of site\n\nOwn"
    assert [out[i] for i in (100, 101, 102)] == ["Share this\n\nShare this\n\nstory 50", "Share this\n\nstory 50", "Share this\n\nstory 51"]
    # the order doesn't depend on partitions
    assert out == {r["page_id"]: r["text"] for r in html.extract(d.coalesce(1)).collect()}


# --- near-duplicates ---------------------------------------------------------------------------


def brute(docs, k, percent):
    hashes = neardup.WordHashes()
    sets = {i: set(neardup.shingles((t or "").encode(), k, hashes).tolist()) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(rng, n_groups=12, copies=12):
    docs = []
    for _ in range(n_groups):
        base = words(rng, rng.choice([1, 2, 3, 7, 20, 60, 200]), 3000)
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            docs.append((len(docs), rng.choice([" ", "\n", "\t "]).join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    return docs + [(len(docs) + i, " ".join(words(rng, 100, 3000))) for i in range(40)]


@pytest.mark.parametrize("k,percent,small", [(3, 85, 48), (5, 80, 48), (3, 85, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, k, percent, small):
    monkeypatch.setattr(neardup, "SMALL_BUCKET", small)
    monkeypatch.setattr(neardup, "BLOCK", 5 if small == 3 else 1024)
    docs = near_copies(random.Random(k * 100 + small))
    out = neardup.classes(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    want = brute(docs, k, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    for share in (0.5, 0.8, 0.95):
        b = np.unique(np.concatenate([a[: int(share * len(a))], rng.integers(0, 2**63, len(a) - int(share * len(a))).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est, n = neardup.jaccard_estimate(neardup.registers(a), neardup.registers(b))
        assert abs(float(est) - true) < 5 * math.sqrt(true * (1 - true) / n) + 0.01


def test_overlaps_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(30)]
    got = neardup._overlaps(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


# --- pipeline ----------------------------------------------------------------------------------


def test_pipeline_over_odd_rows(spark, tmp_path):
    """Nulls, repeats, clashing columns and no rows go through all stages; each stage does what its operator says."""
    import corpus_pipeline

    rng = random.Random(31)
    texts = [" ".join(words(rng, 60, 900)) for _ in range(40)]
    rows = [(i, t, "en", "s", len(t), 1.0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, 1.0), (100, texts[5], "en", "s", 1, 1.0), (None, texts[6], None, None, None, None), (101, None, None, None, None, None), (102, "", "en", "s", 0, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity double"
    benchmark = spark.createDataFrame([(1, f"{' '.join(texts[9].split()[:15])}. {' '.join(texts[9].split()[15:22])}.")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, part in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        benchmark.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept = [tuple(r) for r in out.collect()]
        assert set(kept) <= set(rows) and (name == "some") == bool(kept)
        ids = [r[0] for r in kept if r[0] is not None]
        # no copy, no repeat and no leaked item is left
        assert len(ids) == len(set(ids)) and 9 not in ids and 100 not in ids


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == d.columns and 0 < out.count() < d.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "neardup", "decontamination", "mixing"]
    b = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert decontaminate.leaks(out, b).count() == 0
    near = neardup.classes(out, 5, 80)
    assert near.where("not kept").count() == 0
