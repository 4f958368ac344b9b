"""Confidence of merged segments, summaries of nothing, dealt durations, descriptions, filtered resampling, beam search, models held by workers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy import models
from colloquy.operators import evaluation as E
from colloquy.operators import segments as S
from colloquy.operators import signals as G
from colloquy.operators import summary as M
from colloquy.sources import readers as R


def test_confidence_is_averaged_in_order(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for m in range(20):
        end, merged = 0.0, []
        for k in range(rng.randrange(1, 15)):
            start = round(end + rng.choice([0.1, 0.4, 0.9]), 3)
            who, c = rng.choice("ab"), rng.random()
            rows.append((m, k, who, start, start + 1, c))
            if merged and merged[-1][0] == who and start - end <= 0.5:
                merged[-1][1] = (merged[-1][1] + c) / 2
            else:
                merged.append([who, c, start])
            end = start + 1
        want |= {(m, w, s): c for w, c, s in merged}
    d = spark.createDataFrame(rows, "meeting_id int, seg_idx int, speaker_id string, start double, end double, confidence double")
    got = {(r.meeting_id, r.speaker_id, r.start): r.confidence for r in S.merge_segments(d).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "confidence" not in S.merge_segments(d.drop("confidence")).columns


def test_summary_of_all_and_of_no_segments(spark):
    d = spark.createDataFrame([("a", "x y", 0.0, 30.0), ("b", "z", 30.0, 60.0), ("a", None, 60.0, 60.0)], "speaker_id string, text string, start double, end double")
    one = S.transcription_summary(d).first()
    assert (one.total_segments, one.total_words, one.total_duration, one.words_per_minute) == (3, 3, 60.0, 3.0)
    assert {k: tuple(v) for k, v in one.speakers.items()} == {"a": (2, 30.0, 2), "b": (1, 30.0, 1)}
    none = S.transcription_summary(d.limit(0)).collect()
    assert len(none) == 1 and (none[0].total_segments, none[0].total_words, none[0].total_duration, none[0].words_per_minute, none[0].speakers) == (0, 0, 0.0, 0.0, {})


def test_last_row_takes_what_rounding_left(spark):
    d = spark.createDataFrame([("f", i, n, 10.0) for i, n in enumerate([1, 3, 7, 0, 2])], "file_id string, i int, n_words int, total double")
    got = [r.duration for r in S.proportional_durations(d, order="i").orderBy("i").collect()]
    assert abs(sum(got) - 10.0) < 1e-12 and min(got) > 0


def test_describe_and_totals(spark):
    d = spark.createDataFrame([(1.0, 5, "x"), (2.0, 5, "x"), (4.0, None, "y")], "a double, b int, g string")
    got = {r.metric: r for r in E.describe(d, ["a", "b"]).collect()}
    assert got["a"]["count"] == 3 and got["a"].q1 == 1.5 and got["a"].median == 2.0 and got["a"].std == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert got["b"]["count"] == 2 and got["b"].std == 0 and got["b"].q3 == 5
    assert [tuple(r) for r in E.batch_totals(d, "g", F.col("a") > 1, "a").orderBy("g").collect()] == [("x", 2, 1, 3.0, 1.5), ("y", 1, 1, 4.0, 4.0)]


def signal(spark, x):
    return spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "key string, pos long, x double")


def values(d):
    return np.array([r.x for r in d.orderBy("pos").collect()])


def filtered(x, rate, to, zeros=16):
    cut = 0.9 * min(1, to / rate)
    out = []
    for j in range(math.ceil(len(x) * to / rate)):
        t = j * rate / to - np.arange(len(x))
        w = np.where(abs(t) <= zeros / cut, np.sinc(cut * t) * (0.42 + 0.5 * np.cos(np.pi * t * cut / zeros) + 0.08 * np.cos(2 * np.pi * t * cut / zeros)), 0)
        out.append((w * x).sum() / w.sum())
    return np.array(out)


def test_filtered_resampling(spark):
    x = np.random.default_rng(3).standard_normal(90)
    for to in (40, 60, 100, 250):
        got = values(G.resample_filtered(signal(spark, x), "key", 100, to))
        assert np.allclose(got, filtered(x, 100, to) if to != 100 else x, atol=1e-9)
    # constants stay, a tone under half the new rate stays, one above it falls by 60 dB
    assert np.allclose(values(G.resample_filtered(signal(spark, np.ones(50)), "key", 100, 30)), 1)
    at = np.arange(1_000)
    low = values(G.resample_filtered(signal(spark, np.sin(2 * np.pi * 5 * at / 100)), "key", 100, 40))[20:-20]
    high = values(G.resample_filtered(signal(spark, np.sin(2 * np.pi * 31 * at / 100)), "key", 100, 40))[40:-40]
    assert abs(low).max() > 0.99 and 20 * np.log10(abs(high).max()) < -60


def test_beam_of_prefixes_equals_all_paths(spark):
    import itertools

    rng = np.random.default_rng(8)
    rows, want = [(-1, None), (-2, [])], {-1: None, -2: ([], 0.0)}
    for i in range(40):
        n, tokens = int(rng.integers(1, 6)), int(rng.integers(2, 4))
        p = rng.dirichlet(np.ones(tokens), n)
        mass = {}
        for path in itertools.product(range(tokens), repeat=n):
            read = tuple(t for k, t in enumerate(path) if t and (k == 0 or path[k - 1] != t))
            mass[read] = mass.get(read, 0) + math.prod(p[k, t] for k, t in enumerate(path))
        best = max(mass, key=mass.get)
        rows.append((i, np.log(p).tolist()))
        want[i] = (list(best), math.log(mass[best]))
    d = spark.createDataFrame(rows, "id int, frames array<array<double>>")
    for r in d.select("id", models.beam_tokens(F.col("frames"), 1_000).alias("b")).collect():
        if want[r.id] is None:
            assert r.b is None
        else:
            assert r.b.tokens == want[r.id][0] and r.b.score == pytest.approx(want[r.id][1])
    # one frame's worth of blanks between two equal tokens keeps both; a beam of one is a single path's prefix
    sure = np.log(np.full((3, 2), 1e-9))
    sure[0, 1] = sure[1, 0] = sure[2, 1] = 0
    assert models._best_prefix(sure, 1, 0)[0] == [1, 1]


def test_a_worker_loads_a_model_once(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return 3

    double = models.column_model("threefold", load, lambda model, x: x * model, "long")
    models.register("test", "threefold", double)
    d = spark.range(0, 4_000, 1, 40)
    for _ in range(2):
        assert d.select(F.sum(models.get("test", "threefold")(F.col("id")))).first()[0] == 3 * sum(range(4_000))
    mapped = models.map_model(d, "threefold", load, lambda model, b: b.assign(id=b["id"] + model), "id long")
    assert mapped.agg(F.sum("id")).first()[0] == sum(range(4_000)) + 12_000
    pids = open(log).read().split()
    assert pids and len(pids) == len(set(pids)) < 40


def test_decisions_fall_back_to_key_sentences_and_like_ones_go(spark):
    found = spark.createDataFrame([("a", ["diputuskan rilis hari senin", "diputuskan rilis hari senin pagi", "anggaran naik sepuluh persen"]), ("b", [])], "meeting_id string, decisions array<string>")
    keys = spark.createDataFrame([("a", 1, "kita sepakat lain"), ("b", 4, "Kami sepakat memakai ruang dua"), ("b", 2, "cuaca cerah"), ("c", 0, "Jadi kita pindah")], "meeting_id string, sent_idx int, sentence string")
    got = {r.meeting_id: r.decisions for r in M.settled_decisions(found, keys, "meeting_id").collect()}
    assert got == {"a": ["diputuskan rilis hari senin", "anggaran naik sepuluh persen"], "b": ["Kami sepakat memakai ruang dua"], "c": ["Jadi kita pindah"]}


def test_manifest_with_files_and_lengths(spark, tmp_path):
    import wave

    for name, frames in (("a", 8_000), ("b", 4_000), ("d", 100)):
        (tmp_path / "audio").mkdir(exist_ok=True)
        with wave.open(str(tmp_path / "audio" / f"{name}.wav"), "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(8_000), f.writeframes(bytes(2 * frames))
    (tmp_path / "m.jsonl").write_text('{"wav": "x/a.wav", "text": "t"}\n{"wav": "b.wav", "duration": 9.0}\n{"wav": "c.wav"}\n')
    have, missing = R.corpus_manifest(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "audio"))
    assert sorted((r.wav, r.duration) for r in have.collect()) == [("b.wav", 9.0), ("x/a.wav", 1.0)]
    assert [r.wav for r in missing.collect()] == ["c.wav"]
