import io
import json
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy.sources import readers as R
from colloquy.sources import sinks as K
from colloquy.streaming import windows as W


def put(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")
    return str(folder / name)


def test_rttm_round_trip(spark, tmp_path):
    p = put(tmp_path, "a.rttm", "# note\n\nSPEAKER m 1 0.50 1.25 <NA> <NA> A <NA> <NA>\nLEXEME m 1 0 1 x y A z\nSPEAKER m 1 2 1\n")
    got = R.rttm(spark, p).collect()
    assert [tuple(r) for r in got] == [("m", "A", 0.5, 1.75)]
    assert K.rttm_lines(R.rttm(spark, p)).first()["value"] == "SPEAKER m 1 0.500 1.250 <NA> <NA> A <NA> <NA>"


def test_labelled_texts(spark, tmp_path):
    put(tmp_path, "a.txt", "lost\nAnn: hello\nthere\nBob: hi\n")
    put(tmp_path, "b.txt", "no labels\nat all\n")
    got = sorted((r["path"][-5:], r["utt_idx"], r["speaker_id"], r["text"]) for r in R.labelled_texts(spark, str(tmp_path)).collect())
    assert got == [("a.txt", 0, "Ann", "hello there"), ("a.txt", 1, "Bob", "hi"), ("b.txt", 0, "SPK_01", "no labels at all")]


def test_manifests_take_any_names(spark, tmp_path):
    p = put(tmp_path, "m.jsonl", json.dumps({"audio_filepath": "x/a.wav", "start": 1, "end": 3, "text": "", "transcript": "hi", "speaker_id": "S"}) + "\n")
    r = R.manifest(spark, p).first()
    assert (r["wav"], r["duration"], r["text"], r["speaker"]) == ("x/a.wav", 2.0, "hi", "S")
    c = put(tmp_path, "m.csv", "path,sentence\na.wav,halo\nb.wav,apa\n")
    have, missing = R.existing(R.manifest(spark, c, "csv"), spark.createDataFrame([("/z/a.wav",)], "path string"))
    assert [r["wav"] for r in have.collect()] == ["a.wav"] and [r["wav"] for r in missing.collect()] == ["b.wav"]


def test_predictions_raise_or_drop(spark, tmp_path):
    p = put(tmp_path, "p.jsonl", '{"ref": "a", "hyp": "b"}\n{bad\n')
    assert R.predictions(spark, p, "drop").select("ref", "hyp").count() >= 1
    with pytest.raises(Exception):
        R.predictions(spark, p).select("ref").collect()


def test_formats(spark, tmp_path):
    p = put(tmp_path, "t.txt", "SPEAKER_00 [00:01–01:02]: halo\nnoise\n")
    assert [tuple(r) for r in R.formatted_transcript(spark, p).collect()] == [("SPEAKER_00", 1.0, 62.0, "halo")]
    p = put(tmp_path, "i.txt", "[0.5,1.5] S1 male halo dunia\n")
    assert [tuple(r)[1:] for r in R.interval_corpus(spark, p).collect()] == [(0.5, 1.5, "S1", "halo dunia")]
    p = put(tmp_path, "c.txt", "[0.5,1.5]\tS1\tx\thalo\nbad\n")
    assert [tuple(r)[1:] for r in R.tab_corpus(spark, p).collect()] == [(0.5, 1.5, "S1", "halo")]
    assert [tuple(r) for r in R.speaker_map(spark, "S0: Ann\n# no\n").collect()] == [("S0", "Ann")]
    with pytest.raises(ValueError):
        R.speaker_map(spark, "[1]")


def test_words_xml(spark, tmp_path):
    put(tmp_path, "M1.A.words.xml", '<root><w starttime="1.0" endtime="1.5">hi</w><w starttime="2.0" endtime="2.5">you</w></root>')
    assert [tuple(r) for r in R.words_xml(spark, str(tmp_path)).orderBy("start").collect()] == [("M1", "A", "hi", 1.0, 1.5), ("M1", "A", "you", 2.0, 2.5)]


def test_wave_round_trip(spark, tmp_path):
    tone = spark.createDataFrame([("t", 0, [0.0, 0.5]), ("t", 1, [-0.5])], "audio_id string, chunk_idx long, samples array<float>")
    content = K.wave_files(tone, 8000).first()["content"]
    (tmp_path / "t.wav").write_bytes(content)
    (tmp_path / "x.wav").write_bytes(b"junk")
    info = {r["path"][-5:]: r["samples"] for r in R.audio_info(spark, str(tmp_path)).collect()}
    assert info == {"t.wav": 3, "x.wav": None}
    (tmp_path / "x.wav").unlink()
    s = R.audio_samples(spark, str(tmp_path), 2).orderBy("chunk_idx").collect()
    assert [round(x, 3) for r in s for x in r["samples"]] == [0.0, 0.5, -0.5]
    with wave.open(io.BytesIO(content)) as f:
        assert f.getframerate() == 8000


def test_documents(spark):
    rows = spark.createDataFrame([("m", 0, 0, "a & b"), ("m", 1, 0, "c")], "meeting_id string, section int, para int, text string")
    with zipfile.ZipFile(io.BytesIO(K.documents(rows).first()["content"])) as z:
        body = z.read("word/document.xml").decode()
    assert "a &amp; b" in body and body.index("a &amp;") < body.index(">c<")


def test_tables(spark):
    d = spark.createDataFrame([("x", 0.5), ("y", None)], "condition string, v double")
    assert [r["line"] for r in K.markdown_table(d, ["condition", "v"], "condition").orderBy("n").collect()][2:] == ["| x | 0.5 |", "| y |  |"]
    assert [tuple(r) for r in K.evaluation_csv(d, ["v"], ["condition"]).collect()] == [("x", "0.5000"), ("y", "")]
    assert K.speaker_colors(spark.createDataFrame([("m", "b"), ("m", "a")], "meeting_id string, speaker_id string")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i * 7 % 60:02d}:00", float(i)) for i in range(20)], "id int, t string, value double").select("id", F.to_timestamp("t").alias("ts"), "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = W.tumbling(stream, "ts", "10 minutes", "value").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, W.tumbling(rows, "ts", "10 minutes", "value").collect()))
    assert sorted(map(tuple, spark.table("tumbled").collect())) == want


def test_settings_and_archives(spark, tmp_path):
    import zipfile

    text = "asr:\n  model: small  # which\n  rate: 16000\n  deep:\n    on: true\nname: 'x'\n# no\n"
    assert R.settings(text) == {"asr": {"model": "small", "rate": 16000, "deep": {"on": True}}, "name": "x"}
    assert R.settings('{"a": {"b": 1.5}}') == {"a": {"b": 1.5}}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../words/M:1.xml", "<w/>")
        z.writestr("notes.txt", "n")
    got = R.archived(spark, str(tmp_path / "a.zip"), r"\.xml$").collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("words/M_1.xml", b"<w/>")]


def test_listings(spark):
    d = spark.createDataFrame([("/a/ES1.Array1-02.wav", "ES1.Array1-02"), ("/a/ES1.Array1-01.wav", "ES1.Array1-01"), ("/a/ES2.Mix.wav", "ES2.Mix"), ("/a/x_vibevoice.rttm", "x_vibevoice")], "path string, stem string")
    assert [(r["meeting"], r["array"]) for r in R.recordings(d, ["ES1"]).collect()] == [("ES1", "Array1-01"), ("ES1", "Array1-02")]
    c = spark.createDataFrame([("ES1",), ("ES1.Array1-02",), ("Q",)], "conv_id string")
    assert {r["conv_id"]: r["wav"] for r in R.first_recording(c, d).collect()} == {"ES1": "/a/ES1.Array1-01.wav", "ES1.Array1-02": "/a/ES1.Array1-02.wav", "Q": None}
    a = spark.createDataFrame([("x", None), ("y", "given")], "stem string, rttm string")
    assert {r["stem"]: r["rttm"] for r in R.with_annotation(a, d).collect()} == {"x": "/a/x_vibevoice.rttm", "y": "given"}


def test_stored_vectors(spark, tmp_path):
    w, calls = spark.range(3), []

    def make(d):
        calls.append(1)
        return d.withColumn("v", F.array(F.lit(1.0)))

    path = str(tmp_path / "v")
    assert R.cached_vectors(spark, path, w, make).count() == R.cached_vectors(spark, path, w, make).count() == 3 and len(calls) == 1
    assert R.cached_vectors(spark, path, spark.range(4), make).count() == 4 and len(calls) == 2


def test_vectors_are_known_by_their_windows(spark, tmp_path):
    """As many other windows are other windows; known ones are never made again; a failed run stores nothing."""
    path, made = str(tmp_path / "v"), []

    def make(d):
        made.append(sorted(r["audio_id"] for r in d.collect()))
        return d.withColumn("v", F.concat("audio_id", F.lit("!")))

    ask = lambda *ids: sorted((r["audio_id"], r["w_start"], r["v"]) for r in R.cached_vectors(spark, path, spark.createDataFrame([(i, s) for i, s in ids], "audio_id string, w_start double"), make).collect())
    assert ask(("a", 0.0), ("b", 0.0)) == [("a", 0.0, "a!"), ("b", 0.0, "b!")]
    assert ask(("x", 0.0), ("y", 0.0)) == [("x", 0.0, "x!"), ("y", 0.0, "y!")]
    assert ask(("a", 0.0), ("a", 1.0), ("y", 0.0), ("y", 0.0)) == [("a", 0.0, "a!"), ("a", 1.0, "a!"), ("y", 0.0, "y!"), ("y", 0.0, "y!")]
    assert ask(("a", 0.0), ("x", 0.0)) == [("a", 0.0, "a!"), ("x", 0.0, "x!")]
    assert made == [["a", "b"], ["x", "y"], ["a"]]
    with pytest.raises(Exception):
        R.cached_vectors(spark, path, spark.createDataFrame([("z", 0.0)], "audio_id string, w_start double"), lambda d: d.withColumn("v", F.raise_error(F.lit("broken"))))
    assert ask(("z", 0.0)) == [("z", 0.0, "z!")] and made[-1] == ["z"]


def test_reports_and_tables(spark):
    d = spark.createDataFrame([("s1", "bersih", 0.1, 0.2, 1, 2, 3, 4), ("s2", "noisy", 0.3, None, 1, 0, 0, 9)], "sample string, condition string, wer double, der double, substitutions int, deletions int, insertions int, hits int")
    t = K.evaluation_table(d).orderBy("Sample").collect()
    assert len(t[0]) == 23 and (t[0]["WER"], t[0]["DER"], t[1]["DER"], t[0]["Hits"], t[0]["ROUGEL_F"]) == ("0.1000", "0.2000", "", "4", "")
    lines = [r["value"] for r in K.evaluation_report(d, "uji").orderBy("n", "value").collect()]
    assert "   WER rata-rata      : 0.2000 (20.00%)" in lines and "   - s2: WER = 0.3000 (30.00%)" in lines and "   - s1: DER = 0.2000 (20.00%)" in lines
    assert "   Tidak ada data ringkasan untuk dievaluasi." in lines and lines.index("   - Substitutions    : 2") < lines.index("2. EVALUASI DIARIZATION (Diarization Error Rate)")
    e = spark.createDataFrame([("bersih", "x", 0.15, 0.15)], "condition string, description string, expected_wer double, expected_der double")
    lines = [r["value"] for r in K.condition_report(d, e).orderBy("n").collect()]
    assert "[BERSIH]" in lines and "    Status: ✓ MEETS EXPECTATION" in lines and "    Status: ✗ ABOVE EXPECTATION" in lines
    assert K.PALETTE[0] == "0066CC" and K.PALETTE[-1] == "99004C"


def test_summaries_written(spark):
    d = spark.createDataFrame([("m", "isi", ["satu", "dua"], ["putus"], [("Budi", "kirim \"x\"", "besok"), (None, "rapat", "")], ["a", "b"])], "meeting_id string, overview string, key_points array<string>, decisions array<string>, action_items array<struct<owner:string,task:string,due:string>>, topics array<string>")
    text = K.summary_text(d).first()["value"]
    assert "  2. dua" in text and '  1. [Budi] kirim "x" (Due: besok)' in text and "  2. [TBD] rapat" in text and text.endswith("Topik:\na, b")
    yaml = K.summary_yaml(d).first()["value"]
    assert 'overview: "isi"' in yaml and '- owner: "Budi"\n  task: "kirim \\"x\\""\n  due: "besok"' in yaml and "- owner: null" in yaml
    assert K.summary_json(d).first()["value"].startswith('{"overview":"isi"')
    o = K.result_objects(spark.createDataFrame([("m", 0, 0.0, [1.0])], "meeting_id string, seg_idx int, start double, embedding array<double>"), spark.createDataFrame([("m", 0, "t")], "meeting_id string, seg_idx int, text string"), d).first()
    assert o["metadata"]["diarization_segments"] == 1 and o["transcript"][0]["text"] == "t" and "embedding" not in o["diarization"][0]


def test_annotations_made(spark):
    u = spark.createDataFrame([("/g/rapat_gt.txt", 0, "A b", "satu dua tiga"), ("/g/rapat_gt.txt", 1, "C", "empat")], "path string, utt_idx int, speaker_id string, text string")
    texts, lines = K.converted_annotations(u, spark.createDataFrame([("/g/rapat_gt.txt", 8.0)], "path string, duration double"))
    assert tuple(texts.first()) == ("rapat", "satu dua tiga\nempat")
    assert [r["value"] for r in lines.orderBy("start").collect()] == ["SPEAKER rapat 1 0.000 6.000 <NA> <NA> A_b <NA> <NA>", "SPEAKER rapat 1 6.000 2.000 <NA> <NA> C <NA> <NA>"]
    # without a duration: four words at 3.5 a second
    _, lines = K.converted_annotations(u)
    assert lines.orderBy("start").collect()[0]["value"].startswith("SPEAKER rapat 1 0.000 0.857")
    w = spark.createDataFrame([("m", "A", "x", 0.0, 1.0), ("m", "A", "y", 1.0, 2.0), ("m", "B", "z", 2.0, 3.0)], "meeting_id string, speaker_id string, word string, start double, end double")
    b = {k: v.collect() for k, v in K.annotation_bundle(w).items()}
    assert b["transcript"][0]["text"] == "x y z" and b["speakers"][0]["value"] == "A: x y\nB: z" and len(b["rttm"]) == 2 and b["metadata"][0]["speakers"] == 2
    a = spark.createDataFrame([("s", "/a/s.wav", 65.5)], "stem string, path string, duration double")
    files = {r["name"]: r["value"] for r in K.annotation_templates(a).collect()}
    assert set(files) == {"s.txt", "s.rttm", "s_info.json"} and "1:05 (65.50 detik)" in files["s.txt"] and "SPEAKER s 1 0.00 0.00" in files["s.rttm"]
    assert '"output_dir":"o"' in K.batch_configuration(a, ["stem", "path"], "o").first()["value"]
