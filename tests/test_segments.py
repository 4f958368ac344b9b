import random

from colloquy.operators import segments as S

SCHEMA = "meeting_id string, seg_idx long, speaker_id string, start double, end double, text string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def make(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_merge_extends_within_gap_and_run(spark):
    d = make(spark, [("m", 0, "A", 0.0, 1.0, "a"), ("m", 1, "A", 1.5, 2.0, "b"), ("m", 2, "A", 2.6, 3.0, "c"), ("m", 3, "B", 3.0, 4.0, "d"), ("m", 4, "A", 4.0, 5.0, "e")])
    assert rows(S.merge_segments(d), "start", "end", "speaker_id", "merged") == [(0.0, 2.0, "A", 2), (2.6, 3.0, "A", 1), (3.0, 4.0, "B", 1), (4.0, 5.0, "A", 1)]


def test_merge_keeps_the_latest_end(spark):
    d = make(spark, [("m", 0, "A", 0.0, 9.0, "a"), ("m", 1, "A", 1.0, 2.0, "b"), ("m", 2, "A", 9.2, 10.0, "c")])
    assert rows(S.merge_segments(d), "start", "end") == [(0.0, 10.0)]


def test_smoothing_counts_earlier_changes(spark):
    d = make(spark, [("m", 0, "A", 0.0, 5.0, ""), ("m", 1, "B", 5.0, 5.5, ""), ("m", 2, "A", 5.5, 6.0, ""), ("m", 3, "C", 6.0, 6.4, ""), ("m", 4, "A", 6.4, 9.0, "")])
    assert [r["speaker_id"] for r in S.smooth_segments(d).orderBy("start").collect()] == ["A"] * 5


def test_overlap_needs_another_speaker_and_more_than_touching(spark):
    d = make(spark, [("m", 0, "A", 0.0, 1.0, ""), ("m", 1, "B", 1.0, 2.0, ""), ("m", 2, "B", 1.5, 3.0, ""), ("m", 3, "A", 2.9, 4.0, ""), ("n", 4, "C", 0.0, 9.0, "")])
    assert rows(S.detect_overlaps(d), "seg_idx", "is_overlap") == [(0, False), (1, False), (2, True), (3, True), (4, False)]


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(rng.choice("mn"), i, rng.choice("AB"), (a := round(rng.uniform(0, 50), 2)), a + round(rng.uniform(0.1, 3), 2), "") for i in range(150)]
    want = {(r[1], any(r[0] == o[0] and r[2] != o[2] and max(r[3], o[3]) < min(r[4], o[4]) for o in data)) for r in data}
    assert set(rows(S.detect_overlaps(make(spark, data)), "seg_idx", "is_overlap")) == want


def test_windows_of_short_and_long_regions(spark):
    d = spark.createDataFrame([(0, 0.0, 2.0), (1, 0.0, 3.2)], "r int, start double, end double")
    assert rows(S.analysis_windows(d), "r", "w_start", "w_end") == [(0, 0.0, 2.0), (1, 0.0, 1.5), (1, 0.75, 2.25), (1, 1.5, 3.0), (1, 2.25, 3.2)]


def test_chunks_stop_and_refuse_full_overlap(spark):
    import pytest

    d = spark.createDataFrame([("a", 10.0)], "a string, duration double")
    assert rows(S.chunks(d, 4.0, 1.0), "c_start", "c_end") == [(0.0, 4.0), (3.0, 7.0), (6.0, 10.0), (9.0, 10.0)]
    with pytest.raises(ValueError):
        S.chunks(d, 2.0, 2.0)


def test_turns_drop_marks_and_join(spark):
    d = make(spark, [("m", 0, "A", 0.0, 1.0, "nah, hello [NOISE]"), ("m", 1, "A", 1.0, 2.0, "there"), ("m", 2, "B", 2.0, 3.0, "[OVERLAP]"), ("m", 3, "A", 3.0, 4.0, "again")])
    out = S.speaker_turns(d).collect()
    assert [(r["speaker_id"], r["text"], r["indices"]) for r in out] == [("A", "hello there again", [0, 1, 3])]


def test_blocks_feed_several_segments_in_order(spark):
    s = make(spark, [("m", 0, "A", 0.0, 2.0, ""), ("m", 1, "B", 2.0, 4.0, "")])
    b = spark.createDataFrame([("m", 1, 1.5, 2.5, " two "), ("m", 0, 0.0, 1.0, "one"), ("m", 2, None, None, "x")], "meeting_id string, block_idx int, start double, end double, text string")
    assert rows(S.map_blocks(s, b), "seg_idx", "text") == [(0, "one two"), (1, "two")]
    assert rows(S.map_blocks(s, b, contained=True), "seg_idx", "text") == [(0, "one"), (1, "")]


def test_alignment_goes_on_behind_the_last_match(spark):
    u = spark.createDataFrame([("m", 0, "Ann B", "one two three"), ("m", 1, "C", "four five"), ("m", 2, "D", "zzz")], "meeting_id string, utt_idx long, speaker_id string, text string")
    s = make(spark, [("m", 0, "x", 0.0, 1.0, "one two"), ("m", 1, "x", 1.0, 2.0, "three"), ("m", 2, "x", 2.0, 3.0, "four five one two three")])
    assert rows(S.align_utterances(u, s), "utt_idx", "speaker_id", "start", "end") == [(0, "Ann_B", 0.0, 2.0), (1, "C", 2.0, 3.0)]


def test_renaming_keeps_what_was(spark):
    d = make(spark, [("m", 0, "S0", 0.0, 1.0, ""), ("m", 1, "S1", 0.0, 1.0, "")])
    names = spark.createDataFrame([("S0", "Ann"), ("S1", " ")], "label string, name string")
    assert rows(S.rename_speakers(d, names).na.fill("-"), "seg_idx", "speaker_id", "original_speaker") == [(0, "Ann", "S0"), (1, "S1", "-")]


def test_durations_add_up(spark):
    d = spark.createDataFrame([("f", i, n, 10.0) for i, n in enumerate((1, 0, 9))], "file_id string, i int, n_words int, total double")
    out = S.proportional_durations(d).collect()
    assert abs(sum(r["duration"] for r in out) - 10.0) < 1e-9 and min(r["duration"] for r in out) > 0.19


def test_blocks_meet_segments_without_shuffling_pairs(spark):
    """Segments and blocks of all lengths, nulls, repeated numbers; and each text is made where its blocks are."""
    import random

    rng = random.Random(4)
    span = lambda: (a := rng.randrange(4000) / 8, a + rng.choice([0, 1, 3, 40, 700]))
    s = [("m", i, *span()) for i in range(120)] + [("n", 0, 1.0, 2.0), (None, 7, 1.0, 2.0), ("m", 900, None, 3.0), ("m", 901, 3.0, None), ("m", 5, 10.0, 60.0)]
    b = [("m", i // 2, *span(), f" t{i} ") for i in range(150)] + [("m", 999, 3.0, 4.0, None), ("m", None, 3.0, 4.0, "x"), ("o", 1, 1.0, 2.0, "y")]
    segments = spark.createDataFrame(s, "meeting_id string, seg_idx long, start double, end double").repartition(3)
    blocks = spark.createDataFrame(b, "meeting_id string, block_idx int, start double, end double, text string").repartition(3)
    for contained in (False, True):
        want = {}
        for m, i, x, y in s:
            near = [] if m is None or x is None or y is None else [(k, t.strip()) for n, k, p, q, t in b if n == m and k is not None and t and (x <= p and q <= y if contained else p < y and q > x)]
            want.setdefault((m, i), []).extend(near)
        got = S.map_blocks(segments, blocks, contained, bucket=8.0)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(((m, i, " ".join(t for _, t in sorted(v))) for (m, i), v in want.items()), key=str)
    once = segments.where("seg_idx <> 5")
    plan = S.map_blocks(once, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
