import pandas as pd
from pyspark.sql import functions as F

from colloquy.functions import numeric as N
from colloquy.functions import text as T
from colloquy.functions import vector as V
from colloquy.operators import evaluation as E
from colloquy.operators import signals as G
from colloquy.operators import summary as M
from colloquy.operators import vectors as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_text(spark):
    assert one(spark, "Halo, eh dunia!", lambda c: T.normalize_wer(c, fillers=True)) == "halo dunia"
    assert one(spark, "Été 12-x", T.normalize_ascii) == "t 12 x"
    assert one(spark, "a-b C.", T.normalize_dedup) == "ab c"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "kita kita kita pergi", T.collapse_repeats) == "kita pergi"
    assert one(spark, "halo <b>dunia</b> $$x$$. apa kabar", T.postprocess_asr) == "Halo dunia . Apa kabar."
    assert one(spark, "kirim ke a@b.co lalu example.com ya", T.sanitize_prompt) == "kirim ke lalu ya"
    assert one(spark, "Dr. Ana hadir. Ya. Rapat dimulai pagi!", lambda c: F.array_join(T.sentences(c), "|")) == "Dr. Ana hadir|Rapat dimulai pagi"
    assert one(spark, "x " * 200 + "end.", lambda c: F.size(T.sentences(c))) == 1


def test_repeats_collapse_to_the_fixpoint(spark):
    import random
    import re

    def plain(text):
        before = None
        while before != text:
            before, text = text, re.sub(r"(\b(?:\w+\s+){0,5}\w+\b)(?:\s+\1){1,}", r"\1", text, flags=re.IGNORECASE)
        return text

    rng = random.Random(5)
    texts = ["kata " * n for n in (2, 4, 13, 23, 100, 20_000)] + ["a b " * 30 + "c d c d " * 30, "", "Ya ya. YA", "sama\u00a0sama"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(2, 200))) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "id int, x string")
    out = d.select("id", T.collapse_repeats(F.col("x")).alias("y"), T.collapsed(F.col("x")).alias("z"), T.sentences(F.col("x")).alias("s")).collect()
    assert {r["id"]: r["y"] for r in out} == {r["id"]: r["z"] for r in out} == {-1: None} | {i: plain(t) for i, t in enumerate(texts)}
    got = {r["id"]: r["s"] for r in out}
    assert all(got[i] == [plain(t.strip())] for i, t in enumerate(texts) if 6 <= len(t.strip()) <= 300 and "." not in t)


def test_repeats_by_words_equal_the_pattern(spark):
    """Repetitions that end within a word, other white space, marks between words, letters whose lower case is longer."""
    import random
    import re

    from colloquy.functions.repeats import _fixed

    pattern = re.compile(r"(\b(?:\w+\s+){0,5}\w+\b)(?:\s+\1){1,}", re.IGNORECASE)
    rng = random.Random(2)
    for _ in range(8_000):
        text = "".join(rng.choice(["a", "A", "b", "ab", "abc", "\u00e9", "\u0130", "\u0303"]) + rng.choice(["  ", " ", " ", "\n", ",", "."]) for _ in range(rng.randrange(40)))
        want, before = text, None
        while before != want:
            before, want = want, pattern.sub(r"\1", want)
        assert _fixed(text) == want, text
    assert _fixed("ya " * 300_000) == "ya "


def test_predicates(spark):
    assert one(spark, "ini menjadi bagian", T.is_decision) and not one(spark, "ini menjadi bagian", T.is_strict_decision)
    assert one(spark, "Budi siapkan laporan", T.is_actionable) and not one(spark, "halo semua", T.is_actionable)
    assert one(spark, "Ok, sip", T.is_chatter)
    assert one(spark, "selesai 3 minggu lagi", T.due) == "3 minggu" and one(spark, "deadline: 12/5", T.due) == "12/5" and one(spark, None, T.due) == ""
    assert one(spark, "lalu Budi akan kirim", T.owner) == "Budi" and one(spark, "tidak ada", T.owner) is None
    assert one(spark, "a b a b a b a b a b a b", T.is_repetitive) and not one(spark, "a b c", T.is_repetitive)


def test_greedy_dedup_compares_with_kept_only(spark):
    got = one(spark, ["a b c d", "a b c e", "c e f g", "!!"], T.keep_distinct, "array<string>")
    assert got == ["a b c d", "c e f g"]


def test_times(spark):
    assert [one(spark, x, N.format_duration, "double") for x in (-1.0, 59.9, 3661.0)] == ["0:00", "0:59", "1:01:01"]
    assert [one(spark, x, N.format_timestamp, "double") for x in (-1.0, 59.9, 3661.0)] == ["00:00", "00:59", "01:01:01"]
    assert one(spark, "01:02:03", N.parse_timestamp) == 3723.0


def test_vectors(spark):
    d = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "a", [3.0, 0.0]), (2, "b", [0.0, 2.0])], "id int, label string, embedding array<double>")
    assert {r["label"]: r["centroid"] for r in X.centroids(d, "label").collect()} == {"a": [2.0, 0.0], "b": [0.0, 2.0]}
    assert {r["id"]: r["nearest"] for r in X.nearest_centroid(d, "label", "id").collect()} == {0: "a", 1: "a", 2: "b"}
    assert abs(one(spark, [3.0, 4.0], lambda c: V.norm(V.unit(c)), "array<double>") - 1) < 1e-9


def test_mean_distance_is_over_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 500):
        x = rng.standard_normal((n, 8)) + 0.5
        d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
        r = X.mean_pairwise_distance(d, "id").first()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        assert r["pairs"] == n * (n - 1) // 2
        assert r["mean_distance"] is None if n < 2 else abs(r["mean_distance"] - (1 - (u @ u.T)[np.triu_indices(n, 1)].mean())) < 1e-9


def test_tuning_searches_thresholds_and_sizes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    near = lambda c, n: np.array(c) + 0.01 * rng.standard_normal((n, 3))
    # two groups; two groups and a stray
    meetings = {0: [near([1, 0, 0], 8), near([0.6, 0.8, 0], 8)], 1: [near([1, 0, 0], 8), near([0, 1, 0], 8), np.array([[0.0, 0.0, 1.0]])]}
    rows = [(m, i, v.tolist()) for m, parts in meetings.items() for i, v in enumerate(np.concatenate(parts))]
    d = spark.createDataFrame(rows, "m int, id int, embedding array<double>")
    got = {r["m"]: r for r in X.auto_tune(d, "m", "id", target=2).collect()}
    # of equal cells the first one
    assert (got[0]["threshold"], got[0]["min_size"], got[0]["clusters"]) == (0.95, 1, 2)
    assert all(r["clusters"] in (2, 3) for r in got.values())
    # the cell's numbers are those of cluster() at that cell
    for m, r in got.items():
        labels = X.cluster(d.where(F.col("m") == m), "m", "id", threshold=r["threshold"], least=r["min_size"]).collect()
        assert len({x["speaker_id"] for x in labels}) == r["clusters"]


def test_errors_match_a_plain_table(spark):
    import random

    rng = random.Random(3)
    pairs = [([rng.choice("abc") for _ in range(rng.randrange(6))], [rng.choice("abc") for _ in range(rng.randrange(6))]) for _ in range(60)]

    def plain(a, b):
        t = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j - 1] + (a[i - 1] != b[j - 1]), t[i - 1][j] + 1, t[i][j - 1] + 1)
        return t[-1][-1]

    d = spark.createDataFrame([(" ".join(a), " ".join(b)) for a, b in pairs], "ref string, hyp string")
    scored = E.wer(d, preprocess=False).withColumn("d", E.word_distance(T.words(F.col("ref")), T.words(F.col("hyp")))).collect()
    for r in scored:
        a, b = r["ref"].split(), r["hyp"].split()
        assert r["d"] == plain(a, b)
        if a:
            assert r["substitutions"] + r["deletions"] + r["insertions"] == plain(a, b) and r["hits"] + r["substitutions"] + r["deletions"] == len(a)


def test_word_errors_equal_a_traced_table():
    """Side by side and row by row: the path from the end that prefers hit, substitution, deletion, insertion."""
    import random

    def plain(a, b):
        t = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                t[i][j] = min(t[i - 1][j - 1] + (a[i - 1] != b[j - 1]), t[i - 1][j] + 1, t[i][j - 1] + 1)
        i, j, s, d, k = len(a), len(b), 0, 0, 0
        while i or j:
            if i and j and a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
            elif i and j and t[i][j] == t[i - 1][j - 1] + 1:
                i, j, s = i - 1, j - 1, s + 1
            elif i and t[i][j] == t[i - 1][j] + 1:
                i, d = i - 1, d + 1
            else:
                j, k = j - 1, k + 1
        return [s, d, k]

    rng = random.Random(8)
    pairs = [([rng.randrange(4) for _ in range(rng.randrange(1, 12))], [rng.randrange(4) for _ in range(rng.randrange(12))]) for _ in range(400)]
    want = [plain(a, b) for a, b in pairs]
    assert E._side_by_side([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert [list(E._row_by_row(a, b)) for a, b in pairs] == want
    refs, hyps = (pd.Series([" ".join(f"v{x}" for x in p[k]) for p in pairs] + [None, "a b", "", " ".join(["x", "y"] * 300)]) for k in (0, 1))
    got = E.word_errors.func(refs, hyps)
    assert got.iloc[:400, :3].values.tolist() == want and got.iloc[400].tolist() == [0] * 6 and got.iloc[403].tolist() == [0, 0, 0, 600, 600, 600]


def test_empty_references(spark):
    d = spark.createDataFrame([("", "a b"), ("", ""), ("a", "")], "ref string, hyp string")
    assert [r["wer"] for r in E.wer(d).collect()] == [1.0, 0.0, 1.0]


def test_der(spark):
    ref = spark.createDataFrame([("m", "A", 0.0, 5.0), ("m", "B", 5.0, 10.0)], "meeting_id string, speaker_id string, start double, end double")
    r = E.der_grid(ref, ref).first()
    # speech within a collar counts as false alarm: a second of ten
    assert abs(r["false_alarm"] - 0.1) < 1e-6 and r["missed_speech"] == 0 and abs(r["der"] - 0.1) < 1e-6


def test_rouge(spark):
    d = spark.createDataFrame([("a b c d", "a c d e"), ("", "a")], "r string, h string")
    got = d.select(E.rouge_n(T.words(F.col("r")), T.words(F.col("h")), 1).alias("r1"), E.rouge_n(T.words(F.col("r")), T.words(F.col("h")), 2).alias("r2"), E.rouge_l("r", "h").alias("rl")).collect()
    assert [round(x, 4) for x in got[0]] == [0.75, 0.3333, 0.75] and list(got[1]) == [0.0, 0.0, 0.0]


def test_signals(spark):
    d = spark.createDataFrame([("k", i, float(x)) for i, x in enumerate((1, -4, 2, 0))], "key string, pos long, x double")
    assert [r["y"] for r in G.peak_normalize(d, "key").orderBy("pos").collect()] == [0.25, -1.0, 0.5, 0.0]
    assert [r["y"] for r in G.block_average(d, "key", 4, 2.0).orderBy("pos").collect()] == [-1.5, -1.5, 1.0, 1.0]
    frames = spark.createDataFrame([("k", i, b) for i, b in enumerate((False, True, True, False, True))], "key string, frame long, f boolean")
    assert sorted((r["start"], r["end"]) for r in G.true_regions(frames, "key", "f", 1.0).collect()) == [(1.0, 3.0), (4.0, 5.0)]


def test_actions(spark):
    s = spark.createDataFrame([(0, 0, "Budi akan kirim laporan besok"), (0, 1, "budi akan kirim laporan, besok"), (0, 2, "terima kasih akan semua"), (0, 3, "akan pergi")], "doc int, sent_idx int, sentence string")
    assert [(r["owner"], r["due"]) for r in M.action_items(s, "doc").collect()] == [("Budi", "besok")]


def test_duration_words_and_progress(spark):
    assert one(spark, 3723.9, N.duration_words, "double") == "1 jam 2 menit 3 detik"
    assert one(spark, 59.0, N.duration_words, "double") == "0 menit 59 detik"
    assert one(spark, 0.0, N.duration_words, "double") == "" and one(spark, None, N.duration_words, "double") == ""
    assert one(spark, 4, lambda c: N.percent_done(F.lit(1), c), "int") == 25.0
    assert one(spark, 0, lambda c: N.percent_done(F.lit(1), c), "int") == 0.0
    assert one(spark, 1, lambda c: N.remaining(F.lit(10.0), c, F.lit(5)), "int") == 40.0
    assert one(spark, 0, lambda c: N.remaining(F.lit(10.0), c, F.lit(5)), "int") is None


def test_patched_metrics(spark):
    got = one(spark, "WER: 12.5% CER: 3", lambda c: T.patched_metrics(c, F.lit('{"wer": 0.2, "der": "x"}')))
    assert (got["wer"], got["cer"], got["der"]) == (0.2, 3.0, None)
    assert one(spark, "WER: 12.5%", lambda c: T.patched_metrics(c, F.lit(None).cast("string")))["wer"] == 12.5


def test_greedy_distinct_equals_the_loop(spark):
    """1,000 items with ties, copies and chains, in one key; and nulls, blanks and keys of their own."""
    import random

    from colloquy.operators import summary as M

    rng = random.Random(9)
    bases = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 9))] for _ in range(120)]
    rows = []
    for i in range(1000):
        ws = list(rng.choice(bases))
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = f"w{rng.randrange(60)}"
        rows.append(("m", i, rng.choice(["", "!", ", "]).join(["", " ".join(ws)]).upper()))
    rows += [("n", 0, None), ("n", 1, " ?! "), ("n", 2, "a b"), ("n", 3, "b, A"), ("n", 4, "a b c d"), ("n", 5, "c d e f")]
    d = spark.createDataFrame(rows, "k string, o long, t string").repartition(5)
    for threshold in (0.5, 0.8):
        want = []
        for k in ("m", "n"):
            kept = []
            for _, o, t in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
                own = set("".join(c for c in (t or "").lower() if c.isalnum() or c == " ").split())
                if own and not any(len(own & x) >= threshold * len(own | x) for _, x in kept):
                    kept.append((o, own))
            want += [(k, o) for o, _ in kept]
        assert sorted((r["k"], r["o"]) for r in M.greedy_distinct(d, "k", "o", "t", threshold).collect()) == want


def test_greedy_distinct_sends_no_table_through_the_driver(spark, monkeypatch):
    from colloquy.operators import summary as M

    plans, cut = [], M.materialize

    def seen(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(M, "materialize", seen)
    d = spark.createDataFrame([(1, 0, "one two three"), (1, 1, "one two three four"), (1, 2, "five six"), (1, 3, "one two four nine"), (2, 0, "five six"), (2, 1, "?")], "k long, o long, t string")
    out = seen(M.greedy_distinct(d, "k", "o", "t"))
    assert sorted((r["k"], r["o"]) for r in out.collect()) == [(1, 0), (1, 2), (1, 3), (2, 0)]
    assert len(plans) > 4 and not [p for p in plans if "Broadcast" in p]


def test_keywords_count_words_in_place(spark):
    from collections import Counter

    from colloquy.operators import summary as M

    rows = [(1, "beta alpha beta Alpha gamma yang yang yang"), (2, None), (3, "no"), (None, "zeta delta zeta"), (4, "omega psi_ kappa omega"), (5, " ".join(f"word{'abcdefghij'[i % 7]}" for i in range(900)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    found = M.keywords(d, "doc_id", 2, pattern="[a-z]{4,}")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    # of one key, two rows' words count together, null keys too
    for more in ([], [(1, "gamma Gamma gamma"), (None, "delta delta")]):
        import re

        texts, want = {}, []
        for k, t in rows + more:
            texts[k] = texts.get(k, Counter()) + Counter(w for w in re.findall("[a-z]{4,}", (t or "").lower()) if w != "yang")
        for k, c in texts.items():
            want += [(k, rank, w, n) for rank, (w, n) in enumerate(sorted(c.items(), key=lambda x: -x[1])[:2], 1)]
        got = M.keywords(spark.createDataFrame(rows + more, "doc_id long, text string"), "doc_id", 2, pattern="[a-z]{4,}")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_topics_shuffle_no_words(spark):
    from colloquy import catalog

    plan = catalog.QUERIES["topics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_rouge_of_long_texts_takes_time_that_grows_with_the_words(spark):
    import random
    import time
    from collections import Counter

    from colloquy.operators import evaluation as E

    rng = random.Random(5)
    rows = [(i, [f"w{rng.randrange(900)}" for _ in range(4000)], [f"w{rng.randrange(900)}" for _ in range(4000)]) for i in range(40)]
    rows += [(100, None, ["a"]), (101, [], ["a"]), (102, ["a"], ["a"]), (103, ["a", "b", "a", "b"], ["a", "b"])]
    d = spark.createDataFrame(rows, "i long, r array<string>, h array<string>")
    began = time.perf_counter()
    got = {r["i"]: (r["r1"], r["r2"]) for r in d.select("i", E.rouge_n(F.col("r"), F.col("h"), 1).alias("r1"), E.rouge_n(F.col("r"), F.col("h"), 2).alias("r2")).collect()}
    assert time.perf_counter() - began < 30

    def f1(r, h, n):
        a, b = (Counter(tuple(w[k : k + n]) for k in range(len(w or []) - n + 1)) for w in (r, h))
        return 2.0 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0

    assert got == {i: (f1(r, h, 1), f1(r, h, 2)) for i, r, h in rows}
