"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from colloquy.functions import numeric as N
from colloquy.functions import text as T
from colloquy.operators import evaluation as E
from colloquy.operators import segments as S
from colloquy.operators import signals as G

TEXT = [
    (lambda c: T.normalize_wer(c), "Hello, World! How are you?", "hello world how are you"),
    (lambda c: F.size(T.sentences(c)), "Ini kalimat pertama. Ini kalimat kedua! Ini kalimat ketiga?", 3),
    (T.due, "menyiapkan laporan minggu depan", "1 minggu"), (T.due, "3 minggu", "3 minggu"), (T.due, "deadline: 12/01", "12/01"), (T.due, "besok minggu depan", "besok"),
    (T.owner, "Budi akan menyiapkan laporan", "Budi"),
    (T.collapse_repeats, "Jadi contohnya Jadi contohnya jadi contohnya ini", "Jadi contohnya ini"),
    (T.is_repetitive, "Setuju lah " * 20, True), (T.is_repetitive, "Rapat dimulai pukul sembilan pagi", False),
    (T.safe_filename, "Meeting: Test/File?Name", "Meeting_TestFileName"),
    (T.safe_speaker, "Ana B.", "Ana_B_"),
    (T.title_of, "rapat_tim-inti", "Rapat Tim Inti"),
    (T.xml_escape, "a<b & \"c\"", "a&lt;b &amp; &quot;c&quot;"),
]


@pytest.mark.parametrize("n", range(len(TEXT)))
def test_text(spark, n):
    f, value, want = TEXT[n]
    assert spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"] == want


def test_greedy_dedup(spark):
    d = spark.createDataFrame([(["Setuju lah", "Setuju", "Kita sepakat untuk melakukan evaluasi rutin."],)], "x array<string>")
    assert d.select(F.size(T.keep_distinct(F.col("x")))).first()[0] == 2


@pytest.mark.parametrize("ref,hyp,want", [
    ("the cat sat on the mat", "the cat sat on mat", (0, 1, 0, 5, 1 / 6)), ("hello world", "hello word", (1, 0, 0, 1, 0.5)), ("", "a b", (0, 0, None, 0, 1.0)),
])
def test_word_errors(spark, ref, hyp, want):
    r = E.wer(spark.createDataFrame([(ref, hyp)], "ref string, hyp string")).first()
    got = (r["substitutions"], r["deletions"], r["insertions"], r["hits"], r["wer"])
    assert all(w is None or g == pytest.approx(w) for g, w in zip(got, want))


def test_der_with_labels_swapped(spark):
    k = "meeting_id string, speaker_id string, start double, end double"
    ref, hyp = (spark.createDataFrame([("m", a, 0.0, 5.0), ("m", b, 5.0, 10.0)], k) for a, b in (("S0", "S1"), ("S1", "S0")))
    assert E.der_sweep(ref, hyp).first()["der"] == pytest.approx(0.10)


def test_merge_windows_chunks(spark):
    k = "meeting_id string, seg_idx long, speaker_id string, start double, end double"
    d = spark.createDataFrame([("m", 0, "A", 0.0, 2.0), ("m", 1, "A", 2.1, 4.0), ("m", 2, "B", 4.5, 6.0)], k)
    assert sorted((r["speaker_id"], r["start"], r["end"]) for r in S.merge_segments(d).collect()) == [("A", 0.0, 4.0), ("B", 4.5, 6.0)]
    regions = spark.createDataFrame([(0, 0.0, 5.0), (1, 6.0, 10.0), (2, 20.0, 22.0)], "r int, start double, end double")
    assert {r["r"]: r["count"] for r in S.analysis_windows(regions).groupBy("r").count().collect()} == {0: 7, 1: 5, 2: 1}
    c = S.chunks(spark.createDataFrame([(5.0,)], "duration double"), 2.0, 0.5)
    assert [(r["c_start"], r["c_end"]) for r in c.orderBy("c_start").collect()] == [(0.0, 2.0), (1.5, 3.5), (3.0, 5.0), (4.5, 5.0)]


def test_blocks_then_clean(spark):
    s = spark.createDataFrame([("m", 0, 0.0, 1.2), ("m", 1, 1.2, 3.5), ("m", 2, 3.5, 5.0)], "meeting_id string, seg_idx long, start double, end double")
    b = spark.createDataFrame([("m", 0, 0.0, 1.0, "halo dunia"), ("m", 1, 1.0, 2.5, "ini adalah tes"), ("m", 2, 2.5, 5.0, "suara")], "meeting_id string, block_idx int, start double, end double, text string")
    got = [r["t"] for r in S.map_blocks(s, b).orderBy("seg_idx").select(T.postprocess_asr(F.col("text")).alias("t")).collect()]
    assert got == ["Halo dunia ini adalah tes.", "Ini adalah tes suara.", "Suara."]


def test_times_and_durations(spark):
    d = spark.createDataFrame([(65.5, 125.3)], "a double, b double")
    assert tuple(d.select(N.format_duration(F.col("a")), N.format_range(F.col("a"), F.col("b"))).first()) == ("1:05", "01:05–02:05")
    u = spark.createDataFrame([("f", 0, 1, 8.0), ("f", 1, 3, 8.0)], "file_id string, i int, n_words int, total double")
    rows = S.cumulative_starts(S.proportional_durations(u), ["file_id"], ["i"]).orderBy("i").collect()
    assert [(r["duration"], r["start"]) for r in rows] == [(2.0, 0.0), (6.0, 2.0)]


def test_block_average_does_not_widen(spark):
    d = G.tone(spark, 0.1, 8000, 220.0).withColumnRenamed("audio_id", "key")
    out = G.block_average(d, "key", 8000, 7.5)
    a, b = out.agg(F.var_pop("x"), F.var_pop("y")).first()
    assert out.count() == d.count() and b <= a


def test_accuracy_and_counts(spark):
    d = spark.createDataFrame([("spk1", "spk1"), ("spk2", "spk1"), (None, "spk1")], "ref string, pred string")
    assert tuple(E.accuracy(d, "ref", "pred").first()) == (0.5, 2)
    assert {(r["ref"], r["pred"], r["n"]) for r in E.confusion(d, "ref", "pred").collect()} == {("spk1", "spk1", 1), ("spk2", "spk1", 1)}
