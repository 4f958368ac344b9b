"""A meeting end to end as one graph of DataFrames: segments to a document and its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import segments as S
from ..operators import summary as M
from ..operators import vectors as X
from ..sources import sinks as K


def diarize(windows: DataFrame, meeting: str = "meeting_id", gap: float = 0.5, shortest: float = 0.3, threshold: float = 0.7) -> DataFrame:
    """Speaker segments of windows (meeting, seg_idx, start, end, embedding): cluster, merge, smooth, merge, drop the short, flag overlaps."""
    labels = X.cluster(windows, meeting, "seg_idx", threshold=threshold)
    rows = windows.drop("embedding", "speaker_id").join(labels, [meeting, "seg_idx"]).select(meeting, "seg_idx", "start", "end", "speaker_id")
    number = lambda d: d.withColumn("seg_idx", F.row_number().over(S.Window.partitionBy(meeting).orderBy("start", "end", "speaker_id")).cast("long"))
    merged = number(S.merge_segments(rows, gap, meeting))
    again = number(S.merge_segments(S.smooth_segments(merged, max(1.0, shortest), meeting), gap, meeting))
    return S.detect_overlaps(number(again.where(F.col("end") - F.col("start") >= shortest)), meeting)


def transcribe(segments: DataFrame, blocks: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Texts of full-recording blocks laid on segments, post-processed; empty ones go."""
    texts = S.map_blocks(segments, blocks, meeting=meeting)
    out = segments.join(texts, [meeting, "seg_idx"]).withColumn("text", T.postprocess_asr(F.col("text")))
    return out.where("length(trim(text)) > 0")


def summarize(transcript: DataFrame, meeting: str = "meeting_id", sentences: int = 5) -> dict[str, DataFrame]:
    """overview, decisions, actions and topics of each meeting."""
    turns = S.speaker_turns(transcript, meeting).withColumn("seg_idx", F.col("turn_idx").cast("long"))
    rows = M.document_similarity(M.meeting_sentences(transcript, meeting), meeting)
    rows = rows.withColumn("total", F.count(F.lit(1)).over(S.Window.partitionBy(meeting)))
    top = M.key_sentences(rows, M.heuristic_score(F.col("sent_idx"), F.col("total"), F.col("sentence"), F.col("similarity")), meeting, sentences)
    whole = turns.groupBy(meeting).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda r: r["text"]), " ").alias("text"))
    return {"overview": M.overview(top, meeting), "decisions": M.settled_decisions(M.decisions(rows, meeting), top, meeting), "actions": M.segment_actions(transcript, meeting), "points": M.key_points(top, meeting), "topics": M.keywords(whole, meeting, 5)}


def document(transcript: DataFrame, titles: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """meeting and content: a word-processor file of every meeting (titles: meeting, title)."""
    s = summarize(transcript, meeting)
    return K.documents(K.document_rows(titles.join(s["overview"], meeting, "left"), s["decisions"], s["actions"], transcript, meeting), meeting)


def evaluate(references: DataFrame, hypotheses: DataFrame, ref_segments: DataFrame, hyp_segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """Word and diarization errors of each meeting (references, hypotheses: meeting, text)."""
    pairs = references.select(meeting, F.col("text").alias("ref")).join(hypotheses.select(meeting, F.col("text").alias("hyp")), meeting, "full")
    return E.wer(pairs).join(E.der_grid(ref_segments, hyp_segments, meeting=meeting), meeting, "left")
