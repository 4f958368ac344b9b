"""The queries over the reference's operators, each with its SQL where SQL can express it.

Adapters give the driver's tables the roles of segments, regions, vectors and
results; every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..functions import vector as V
from ..operators import evaluation as E
from ..operators import sampling as C
from ..operators import segments as S
from ..operators import signals as G
from ..operators import summary as M
from ..operators import vectors as X
from ..operators.scans import numbered
from ..streaming import windows as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def talk(spark, sf_dir) -> DataFrame:
    """Conversations as segments: a turn lasts one second."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")


def spoken(spark, sf_dir) -> DataFrame:
    """Events as segments of a day: milliseconds of the day, length in value seconds, speaker by type."""
    e = table(spark, sf_dir, "events")
    ms = F.expr("timestampdiff(MILLISECOND, date_trunc('DAY', ts), ts)").cast("double") / 1000
    return e.select(F.date_format("ts", "yyyy-MM-dd").alias("meeting_id"), F.col("event_id").alias("seg_idx"), F.col("event_type").alias("speaker_id"), ms.alias("start"), F.round(ms + F.col("value"), 3).alias("end"), F.col("event_type").alias("text"), "user_id", "value")


SPOKEN = """spoken AS (SELECT strftime(ts, '%Y-%m-%d') AS meeting_id, event_id AS seg_idx, event_type AS speaker_id,
 date_diff('millisecond', date_trunc('day', ts), ts)::DOUBLE / 1000 AS "start",
 round(date_diff('millisecond', date_trunc('day', ts), ts)::DOUBLE / 1000 + value, 3) AS "end", event_type AS text, user_id, value FROM events)"""
WORDS = "len(list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> ''))"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- statistics ------------------------------------------------------------------------------


@query(f"SELECT conv_id AS meeting_id, role AS speaker_id, sum({WORDS.format('text')})::BIGINT AS word_count, count(*)::DOUBLE AS duration, count(*) AS segment_count, min(turn) AS first_seen FROM conversations GROUP BY 1, 2")
def speaker_stats(spark, sf_dir):
    return S.speaker_stats(talk(spark, sf_dir))


@query(f"SELECT conv_id AS meeting_id, count(*) AS total_segments, sum({WORDS.format('text')})::BIGINT AS total_words, count(*)::DOUBLE AS total_duration, count(DISTINCT role) AS num_speakers, round(sum({WORDS.format('text')}) / (count(*) / 60.0), 6) AS words_per_minute FROM conversations GROUP BY 1")
def transcription_stats(spark, sf_dir):
    return S.transcription_stats(talk(spark, sf_dir)).withColumn("words_per_minute", F.round("words_per_minute", 6))


@query(f"""WITH b AS (SELECT role, sum({WORDS.format('text')})::BIGINT AS w, count(*) AS n FROM conversations GROUP BY 1)
 SELECT sum(n)::BIGINT AS total_segments, sum(w)::BIGINT AS total_words, sum(n)::DOUBLE AS total_duration, round(sum(w) * 60.0 / sum(n), 6) AS words_per_minute,
 string_agg(role || ' ' || w || ' ' || n, ', ' ORDER BY role) AS speakers FROM b""")
def transcription_summary(spark, sf_dir):
    said = F.transform(F.map_entries("speakers"), lambda e: F.concat_ws(" ", e["key"], e["value"]["word_count"].cast("string"), e["value"]["segment_count"].cast("string")))
    return S.transcription_summary(talk(spark, sf_dir)).withColumns({"speakers": F.array_join(said, ", "), "words_per_minute": F.round("words_per_minute", 6)})


_OVERLAPS = f"""{SPOKEN}, marked AS (SELECT a.*, EXISTS (SELECT 1 FROM spoken b WHERE a.meeting_id = b.meeting_id AND a.speaker_id <> b.speaker_id
 AND greatest(a."start", b."start") < least(a."end", b."end")) AS is_overlap FROM spoken a)"""


@query(f"WITH {_OVERLAPS} SELECT meeting_id, seg_idx, is_overlap FROM marked")
def detect_overlaps(spark, sf_dir):
    return S.detect_overlaps(spoken(spark, sf_dir)).select("meeting_id", "seg_idx", "is_overlap")


@query(f"""WITH {_OVERLAPS} SELECT meeting_id, speaker_id, round(sum("end" - "start"), 3) AS total_duration, count(*) AS segment_count,
 round(sum(CASE WHEN is_overlap THEN "end" - "start" ELSE 0 END), 3) AS overlap_duration, round(avg("end" - "start"), 3) AS avg_duration FROM marked GROUP BY 1, 2""")
def speaker_overlap_stats(spark, sf_dir):
    out = S.overlap_stats(S.detect_overlaps(spoken(spark, sf_dir)))
    return out.select("meeting_id", "speaker_id", F.round("total_duration", 3).alias("total_duration"), "segment_count", F.round("overlap_duration", 3).alias("overlap_duration"), F.round("avg_duration", 3).alias("avg_duration"))


# --- turns, islands, windows -----------------------------------------------------------------


@query("""WITH a AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations WHERE trim(text) <> ''),
 c AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM a)
 SELECT conv_id AS meeting_id, g::BIGINT AS turn_idx, role AS speaker_id, min(turn)::DOUBLE AS "start", (max(turn) + 1)::DOUBLE AS "end", string_agg(t, ' ' ORDER BY turn) AS text, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS indices FROM c GROUP BY 1, 2, 3""")
def speaker_turns(spark, sf_dir):
    out = S.speaker_turns(talk(spark, sf_dir))
    return out.withColumn("turn_idx", F.col("turn_idx").cast("long")).withColumn("indices", F.array_join(F.col("indices").cast("array<string>"), ","))


@query("SELECT conv_id AS meeting_id, turn AS seg_idx, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def context_window(spark, sf_dir):
    return S.context(talk(spark, sf_dir)).select("meeting_id", "seg_idx", "context")


@query("SELECT conv_id AS meeting_id, string_agg('[' || lpad((turn // 60)::VARCHAR, 2, '0') || ':' || lpad((turn % 60)::VARCHAR, 2, '0') || '] ' || role || ': ' || trim(text, ' '), chr(10) ORDER BY turn) AS transcript FROM conversations WHERE length(trim(text, ' ')) > 0 GROUP BY 1")
def formatted_transcript(spark, sf_dir):
    return S.formatted(talk(spark, sf_dir))


@query(f"""WITH {SPOKEN}, a AS (SELECT *, lag(speaker_id) OVER (PARTITION BY meeting_id ORDER BY "start", seg_idx) AS b FROM spoken),
 c AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> speaker_id THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY "start", seg_idx) AS run FROM a),
 d AS (SELECT *, max("end") OVER (PARTITION BY meeting_id, run ORDER BY "start", seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
 e AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, run ORDER BY "start", seg_idx) AS g FROM d)
 SELECT meeting_id, speaker_id, min("start") AS "start", max("end") AS "end", count(*) AS merged FROM e GROUP BY meeting_id, run, g, speaker_id""")
def merge_segments(spark, sf_dir):
    return S.merge_segments(spoken(spark, sf_dir), gap=60.0)


@query(f"""WITH {SPOKEN}, a AS (SELECT *, seg_idx % 11 / 10.0::DOUBLE AS c, lag(speaker_id) OVER (PARTITION BY meeting_id ORDER BY "start", seg_idx) AS b FROM spoken),
 r AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> speaker_id THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY "start", seg_idx) AS run FROM a),
 d AS (SELECT *, max("end") OVER (PARTITION BY meeting_id, run ORDER BY "start", seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
 e AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, run ORDER BY "start", seg_idx) AS g FROM d)
 SELECT meeting_id, speaker_id, min("start") AS "start", count(*) AS merged, round(list_reduce(list(c ORDER BY "start", seg_idx), lambda x, y: (x + y) / 2), 6) AS confidence FROM e GROUP BY meeting_id, run, g, speaker_id""")
def merged_confidence(spark, sf_dir):
    rows = spoken(spark, sf_dir).withColumn("confidence", F.pmod("seg_idx", F.lit(11)) / 10.0)
    return S.merge_segments(rows, gap=60.0).select("meeting_id", "speaker_id", "start", "merged", r6(F.col("confidence"), "confidence"))


@query(f"""WITH {SPOKEN}, d AS (SELECT *, max("end") OVER (PARTITION BY meeting_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spoken),
 e AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM d)
 SELECT meeting_id, min("start") AS "start", max("end") AS "end" FROM e GROUP BY meeting_id, g""")
def merge_regions(spark, sf_dir):
    return S.merge_regions(spoken(spark, sf_dir).select("meeting_id", "start", "end"), 0.5, ["meeting_id"])


@query(f"""WITH RECURSIVE {SPOKEN}, o AS MATERIALIZED (SELECT meeting_id, "start", seg_idx, "end", speaker_id AS said, row_number() OVER w AS i, lead(speaker_id) OVER w AS after FROM spoken WINDOW w AS (PARTITION BY meeting_id ORDER BY "start", seg_idx)),
 f AS (SELECT meeting_id, i, said AS speaker_id FROM o WHERE i = 1 UNION ALL
 SELECT o.meeting_id, o.i, CASE WHEN o."end" - o."start" < 5.0 AND f.speaker_id = o.after THEN f.speaker_id ELSE o.said END FROM f JOIN o ON o.meeting_id = f.meeting_id AND o.i = f.i + 1)
 SELECT o.meeting_id, o."start", o.seg_idx, o."end", f.speaker_id FROM o JOIN f USING (meeting_id, i)""")
def smooth_segments(spark, sf_dir):
    return S.smooth_segments(spoken(spark, sf_dir), shortest=5.0)


@query(f"""WITH {SPOKEN}, a AS (SELECT seg_idx, "start", "end", unnest(generate_series(0, CASE WHEN "end" - "start" < 3.0 THEN 0 ELSE floor(("end" - "start") / 0.75)::BIGINT END)) AS k FROM spoken),
 b AS (SELECT seg_idx, k, "start" + k * 0.75 AS s, CASE WHEN "end" - "start" < 3.0 THEN "end" ELSE least("start" + k * 0.75 + 1.5, "end") END AS e FROM a)
 SELECT seg_idx, k AS window_idx, round(s, 3) AS w_start, round(e, 3) AS w_end FROM b WHERE e - s >= 0.3""")
def analysis_windows(spark, sf_dir):
    return S.analysis_windows(spoken(spark, sf_dir)).select("seg_idx", F.col("k").cast("long").alias("window_idx"), F.round("w_start", 3).alias("w_start"), F.round("w_end", 3).alias("w_end"))


@query("""WITH a AS (SELECT event_id, value AS d, unnest(generate_series(0, greatest(ceil(value / 25.0)::BIGINT - 1, 0))) AS k FROM events)
 SELECT event_id, k AS chunk_idx, round(k * 25.0, 6) AS c_start, round(least(k * 25.0 + 30.0, d), 6) AS c_end FROM a""")
def audio_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("duration"))
    return S.chunks(e, 30.0, 5.0).select("event_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), r6(F.col("c_start"), "c_start"), r6(F.col("c_end"), "c_end"))


def _blocks(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return s.where("seg_idx % 2 = 0"), s.where("seg_idx % 2 = 1").withColumnRenamed("seg_idx", "block_idx")


@query(f"""WITH {SPOKEN}, s AS (SELECT * FROM spoken WHERE seg_idx % 2 = 0), b AS (SELECT * FROM spoken WHERE seg_idx % 2 = 1)
 SELECT s.meeting_id, s.seg_idx, coalesce(string_agg(b.text, ' ' ORDER BY b.seg_idx), '') AS text FROM s LEFT JOIN b ON s.meeting_id = b.meeting_id AND b."start" < s."end" AND b."end" > s."start" GROUP BY 1, 2""")
def map_asr_to_segments(spark, sf_dir):
    return S.map_blocks(*_blocks(spark, sf_dir))


@query(f"""WITH {SPOKEN}, s AS (SELECT * FROM spoken WHERE seg_idx % 2 = 0), b AS (SELECT * FROM spoken WHERE seg_idx % 2 = 1)
 SELECT s.meeting_id, s.seg_idx, coalesce(string_agg(b.text, ' ' ORDER BY b.seg_idx), '') AS text FROM s LEFT JOIN b ON s.meeting_id = b.meeting_id AND b."start" >= s."start" AND b."end" <= s."end" GROUP BY 1, 2""")
def map_words_to_segments(spark, sf_dir):
    return S.map_blocks(*_blocks(spark, sf_dir), contained=True)


@query(f"""WITH {SPOKEN} SELECT meeting_id, seg_idx, round(coalesce(sum(value) OVER (PARTITION BY meeting_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS "start" FROM spoken""")
def cumulative_starts(spark, sf_dir):
    rows = spoken(spark, sf_dir).select("meeting_id", "seg_idx", F.col("value").alias("duration"))
    return S.cumulative_starts(rows, ["meeting_id"], ["seg_idx"]).select("meeting_id", "seg_idx", F.round("start", 4).alias("start"))


@query(f"""WITH a AS (SELECT conv_id, turn, {WORDS.format('text')} AS n FROM conversations), b AS (SELECT *, greatest(100.0 * n / greatest(sum(n) OVER (PARTITION BY conv_id), 1), 0.2) AS r FROM a)
 SELECT conv_id AS file_id, turn AS utt_idx, round(r * 100.0 / sum(r) OVER (PARTITION BY conv_id), 6) AS duration FROM b""")
def proportional_durations(spark, sf_dir):
    rows = talk(spark, sf_dir).select(F.col("meeting_id").alias("file_id"), F.col("seg_idx").alias("utt_idx"), T.word_count(F.col("text")).alias("n_words"), F.lit(100.0).alias("total"))
    return S.proportional_durations(rows).select("file_id", "utt_idx", r6(F.col("duration"), "duration"))


@query(f"""WITH {SPOKEN}, a AS (SELECT *, row_number() OVER (PARTITION BY meeting_id, speaker_id ORDER BY "end" - "start" DESC, seg_idx) AS n FROM spoken) SELECT meeting_id, speaker_id, round("start", 3) AS "start", round(least("end", "start" + 10), 3) AS "end" FROM a WHERE n = 1""")
def longest_segment(spark, sf_dir):
    return S.longest_segment(spoken(spark, sf_dir)).select("meeting_id", "speaker_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query()
def align_utterances(spark, sf_dir):
    t = talk(spark, sf_dir)
    return S.align_utterances(t.select("meeting_id", F.col("seg_idx").alias("utt_idx"), "speaker_id", "text"), t)


# --- speakers --------------------------------------------------------------------------------


@query("SELECT conv_id AS meeting_id, turn AS seg_idx, CASE role WHEN 'user' THEN 'Guest' WHEN 'assistant' THEN 'Host' ELSE role END AS speaker_id, CASE WHEN role IN ('user', 'assistant') THEN role END AS original_speaker FROM conversations")
def speaker_map_join(spark, sf_dir):
    names = spark.createDataFrame([("user", "Guest"), ("assistant", "Host")], "label string, name string")
    return S.rename_speakers(talk(spark, sf_dir), F.broadcast(names)).select("meeting_id", "seg_idx", "speaker_id", "original_speaker")


@query("SELECT speaker_id, row_number() OVER (ORDER BY speaker_id) - 1 AS dense_id FROM (SELECT DISTINCT user_id AS speaker_id FROM events)")
def dense_speaker_ids(spark, sf_dir):
    return S.dense_ids(table(spark, sf_dir, "events").select(F.col("user_id").alias("speaker_id")), "speaker_id")


@query("SELECT ch, row_number() OVER (ORDER BY ch) AS id FROM (SELECT DISTINCT ch FROM (SELECT unnest(string_split(lower(text), '')) AS ch FROM conversations) WHERE ch <> '')")
def char_vocab(spark, sf_dir):
    letters = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), "")).alias("ch")).where("ch <> ''")
    return S.dense_ids(letters, "ch", "id", 1)


@query("SELECT conv_id AS meeting_id, string_agg(DISTINCT role, ',' ORDER BY role) AS participants FROM conversations GROUP BY 1")
def participants(spark, sf_dir):
    return S.participants(talk(spark, sf_dir)).withColumn("participants", F.array_join("participants", ","))


@query("SELECT conv_id AS meeting_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1")
def plain_transcript(spark, sf_dir):
    return S.plain_words(talk(spark, sf_dir).withColumn("word", F.col("text")))


@query(f"""WITH {SPOKEN} SELECT seg_idx, round(greatest(0.0, "start" - 0.5), 3) AS a, round(least(86400.0, "end" + 0.5), 3) AS b FROM spoken""")
def padded_segments(spark, sf_dir):
    a, b = S.padded_range(F.col("start"), F.col("end"), F.lit(86400.0))
    return spoken(spark, sf_dir).select("seg_idx", F.round(a, 3).alias("a"), F.round(b, 3).alias("b"))


@query(f"""WITH {SPOKEN} SELECT s.meeting_id, s.seg_idx FROM spoken s WHERE NOT EXISTS (SELECT 1 FROM spoken m WHERE m.seg_idx % 2 = 0 AND m.meeting_id = s.meeting_id AND m."start" = s."start" AND m."end" = s."end")""")
def uncovered_segments(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return S.uncovered(s, s.where("seg_idx % 2 = 0")).select("meeting_id", "seg_idx")


@query("SELECT quality AS ref, list(toxic || ':' || n ORDER BY toxic) AS counts FROM (SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2) GROUP BY 1".replace("list(", "string_agg(").replace(" ORDER BY", ", ',' ORDER BY"))
def nested_confusion(spark, sf_dir):
    out = E.nested_counts(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("ref", F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",").alias("counts"))


@query("SELECT quality AS ref, toxic AS pred, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def speaker_confusion(spark, sf_dir):
    return E.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("SELECT round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def speaker_accuracy(spark, sf_dir):
    return E.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic").withColumn("accuracy", F.round("accuracy", 6))


# --- scores ----------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    """Orders' priority, status and date in two orders: short reference and hypothesis texts."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.concat_ws(" ", F.lower("o_orderpriority"), "o_orderstatus", F.date_format("o_orderdate", "yyyy MM dd")).alias("ref"), F.concat_ws(" ", F.lower("o_orderpriority"), F.date_format("o_orderdate", "yyyy dd MM")).alias("hyp"))


_PAIRS = "p AS (SELECT o_orderkey, lower(o_orderpriority) || ' ' || o_orderstatus || ' ' || strftime(o_orderdate, '%Y %m %d') AS ref, lower(o_orderpriority) || ' ' || strftime(o_orderdate, '%Y %d %m') AS hyp FROM orders)"


@query(f"WITH {_PAIRS} SELECT o_orderkey, round(levenshtein(replace(ref, ' ', ''), replace(hyp, ' ', ''))::DOUBLE / length(replace(ref, ' ', '')), 6) AS cer FROM p")
def simple_cer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", r6(E.simple_cer(F.col("ref"), F.col("hyp")), "cer"))


# words as letters: each distinct word of a pair has its own, so a distance of letters is one of words
_LETTERED = f"""{_PAIRS}, w AS (SELECT o_orderkey, string_split(ref, ' ') AS a, string_split(hyp, ' ') AS b FROM p), u AS (SELECT *, list_concat(a, b) AS every FROM w),
 d AS (SELECT o_orderkey, len(a) AS n, levenshtein(list_aggregate(list_transform(a, lambda x: chr((64 + list_position(every, x))::INT)), 'string_agg', ''), list_aggregate(list_transform(b, lambda x: chr((64 + list_position(every, x))::INT)), 'string_agg', '')) AS distance FROM u)"""


@query(f"WITH {_LETTERED} SELECT o_orderkey, distance::INTEGER AS distance FROM d")
def word_edit_distance(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("o_orderkey", E.word_distance(F.split("ref", " "), F.split("hyp", " ")).alias("distance"))


@query(f"WITH {_LETTERED.replace('ref, hyp FROM p', 'ref, hyp FROM p')} SELECT o_orderkey, round(distance::DOUBLE / n, 6) AS wer FROM d".replace("string_split(ref, ' ')", "string_split(lower(ref), ' ')").replace("string_split(hyp, ' ')", "string_split(lower(hyp), ' ')"))
def simple_wer(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", r6(E.simple_wer(F.col("ref"), F.col("hyp")), "wer"))


# the cells of the table of errors as one number each: cost, preference, substitutions, deletions, insertions
_CELL = f"(least(acc[j[1]] + CASE WHEN hid[j[1]] = x[1] THEN 0 ELSE {E._COST + E._SUB} END, acc[j[1] + 1] + {E._COST + E._DEL + E._SECOND}, r[len(r)] + {E._COST + E._INS + 2 * E._SECOND}) & {E._PLAIN})"
_TABLE = f"list_reduce(rid, lambda acc, x: list_reduce(list_transform(range(1, len(hid) + 1), lambda j: [j]), lambda r, j: list_append(r, {_CELL}), [acc[1] + {E._COST + E._DEL}]), list_transform(range(0, len(hid) + 1), lambda j: j * {E._COST + E._INS}))"
_COUNTED = f"""{_PAIRS}, t AS (SELECT o_orderkey, trim(regexp_replace(replace(ref, '-', ' '), '\\s+', ' ', 'g')) AS ref, trim(regexp_replace(replace(lower(hyp), '-', ' '), '\\s+', ' ', 'g')) AS hyp FROM (SELECT o_orderkey, lower(ref) AS ref, hyp FROM p)),
 w AS (SELECT *, string_split(ref, ' ') AS a, string_split(hyp, ' ') AS b FROM t), i AS (SELECT *, list_transform(a, lambda x: [list_position(list_concat(a, b), x)::BIGINT]) AS rid, list_transform(b, lambda x: list_position(list_concat(a, b), x)::BIGINT) AS hid FROM w),
 c AS (SELECT *, {_TABLE} AS last FROM i), e AS (SELECT *, last[len(last)] AS z FROM c),
 n AS (SELECT *, ((z >> 32) & 65535)::INTEGER AS substitutions, ((z >> 16) & 65535)::INTEGER AS deletions, (z & 65535)::INTEGER AS insertions, len(a)::INTEGER AS reference_length, len(b)::INTEGER AS hypothesis_length FROM e),
 h AS (SELECT *, reference_length - substitutions - deletions AS hits, substitutions + deletions + insertions AS wrong FROM n)"""


@query(f"""WITH {_COUNTED} SELECT o_orderkey, round(wrong::DOUBLE / reference_length, 6) AS wer, round(wrong::DOUBLE / (hits + wrong), 6) AS mer, round(1 - (hits::DOUBLE / reference_length) * (hits::DOUBLE / hypothesis_length), 6) AS wil,
 round(levenshtein(ref, hyp)::DOUBLE / length(ref), 6) AS cer, substitutions, deletions, insertions, hits, reference_length, hypothesis_length FROM h""")
def wer_counts(spark, sf_dir):
    out = E.wer(_pairs(spark, sf_dir)).drop("ref", "hyp")
    return out.withColumns({c: F.round(c, 6) for c in ("wer", "mer", "wil", "cer")})


@query()
def wer_benchmark(spark, sf_dir):
    """Each benchmark item against the next one: whole texts of several sentences."""
    b = table(spark, sf_dir, "benchmark")
    refs, hyps = b.select(F.col("item_id").alias("n"), F.col("text").alias("ref")), b.select((F.col("item_id") - 1).alias("n"), F.col("text").alias("hyp"))
    return E.wer(refs.join(hyps, "n")).drop("ref", "hyp")


@query(f"WITH {_LETTERED} SELECT round(sum(distance)::DOUBLE / sum(n), 6) AS micro_wer, round(avg(distance::DOUBLE / n), 6) AS macro_wer, round(stddev_pop(distance::DOUBLE / n), 6) AS std_wer, round(min(distance::DOUBLE / n), 6) AS min_wer, round(max(distance::DOUBLE / n), 6) AS max_wer, count(*) AS pairs FROM d".replace("string_split(ref, ' ')", "string_split(replace(lower(ref), '-', ' '), ' ')").replace("string_split(hyp, ' ')", "string_split(replace(lower(hyp), '-', ' '), ' ')").replace("FROM p), u", "FROM (SELECT o_orderkey, trim(regexp_replace(ref, '\\s+', ' ', 'g')) AS ref, trim(regexp_replace(hyp, '\\s+', ' ', 'g')) AS hyp FROM (SELECT o_orderkey, replace(ref, '-', ' ') AS ref, replace(hyp, '-', ' ') AS hyp FROM p))), u"))
def wer_micro_macro(spark, sf_dir):
    out = E.wer_totals(E.wer(_pairs(spark, sf_dir)))
    return out.select(*[r6(F.col(c), c) for c in ("micro_wer", "macro_wer", "std_wer", "min_wer", "max_wer")], "pairs")


@query()
def wer_benchmark(spark, sf_dir):
    """Each benchmark item against the next one: whole texts of several sentences."""
    b = table(spark, sf_dir, "benchmark")
    refs, hyps = b.select(F.col("item_id").alias("n"), F.col("text").alias("ref")), b.select((F.col("item_id") - 1).alias("n"), F.col("text").alias("hyp"))
    return E.wer(refs.join(hyps, "n")).drop("ref", "hyp")


@query("SELECT item_id, text AS ref, concat(text, '!') AS hyp FROM benchmark")
def zipped_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return E.zipped(b.select("item_id", F.col("text").alias("ref")), b.select("item_id", F.concat("text", F.lit("!")).alias("hyp")), "item_id")


@query(f"""WITH {_PAIRS}, w AS (SELECT o_orderkey, string_split(ref, ' ') AS a, string_split(hyp, ' ') AS b FROM p),
 g AS (SELECT o_orderkey, a, b, list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) AS a2, list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1]) AS b2 FROM w)
 SELECT o_orderkey, round(2.0 * list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x)))))::DOUBLE / (len(a) + len(b)), 6) AS rouge1,
 round(2.0 * list_sum(list_transform(list_distinct(a2), lambda x: least(len(list_filter(a2, lambda y: y = x)), len(list_filter(b2, lambda y: y = x)))))::DOUBLE / (len(a2) + len(b2)), 6) AS rouge2 FROM g""")
def rouge_scores(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    a, b = F.split("ref", " "), F.split("hyp", " ")
    return p.select("o_orderkey", r6(E.rouge_n(a, b, 1), "rouge1"), r6(E.rouge_n(a, b, 2), "rouge2"))


@query(f"""WITH {_PAIRS}, w AS (SELECT o_orderkey, string_split(ref, ' ') AS a, string_split(hyp, ' ') AS b FROM p),
 i AS (SELECT *, list_transform(a, lambda x: [list_position(list_concat(a, b), x)::BIGINT]) AS rid, list_transform(b, lambda x: list_position(list_concat(a, b), x)::BIGINT) AS hid FROM w),
 t AS (SELECT *, list_reduce(rid, lambda acc, x: list_reduce(list_transform(range(1, len(hid) + 1), lambda j: [j]), lambda r, j: list_append(r, CASE WHEN hid[j[1]] = x[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[len(r)]) END), [0::BIGINT]), list_transform(range(0, len(hid) + 1), lambda j: 0::BIGINT)) AS last FROM i)
 SELECT o_orderkey, round(2.0::DOUBLE * last[len(last)] / (len(a) + len(b)), 6) AS "rougeL" FROM t""")
def rouge_longest(spark, sf_dir):
    return _pairs(spark, sf_dir).select("o_orderkey", r6(E.rouge_l("ref", "hyp"), "rougeL"))


# --- text ------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM documents")
def normalize_wer_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_wer(F.col("text"))).alias("h"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}\\p{Pc}]+'))::BIGINT AS n FROM documents")
def word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_tokens(F.col("text")).alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM documents")
def normalize_ascii(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize_ascii(F.col("text"))).alias("h"))


@query("SELECT page_id, md5(trim(regexp_replace(trim(regexp_replace(html, '\\s+', ' ', 'g')), '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g'))) AS h FROM pages")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean(F.col("html"))).alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS t FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text")).alias("t"))


@query()
def sanitize_prompt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize_prompt(F.col("text"))).alias("h"))


@query()
def postprocess_asr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.postprocess_asr(F.col("html"))).alias("h"))


@query()
def split_sentences(spark, sf_dir):
    return M.sentence_rows(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("sent_idx").cast("long").alias("sent_idx"), "sentence")


@query(f"SELECT doc_id, {WORDS.format('text')}::BIGINT AS n FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).alias("n"))


_KEYWORDS = """WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') AS ws FROM documents)),
 c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS f FROM w WHERE word NOT IN ({0}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS rank FROM c) SELECT doc_id, rank, word, n FROM r WHERE rank <= {1}"""


def _stop():
    return ", ".join(f"'{w}'" for w in M.STOPWORDS)


@query(_KEYWORDS.format(_stop(), 5))
def topics(spark, sf_dir):
    return M.keywords(table(spark, sf_dir, "documents"), "doc_id", 5, pattern="[a-z]{4,}").withColumn("rank", F.col("rank").cast("long"))


@query(_KEYWORDS.format(_stop(), 8))
def keywords(spark, sf_dir):
    return M.keywords(table(spark, sf_dir, "documents"), "doc_id", 8, pattern="[a-z]{4,}").withColumn("rank", F.col("rank").cast("long"))


#: Fixed by turn: a sentence of a meeting before the whole text of the turn, so that every rule of decisions and actions is met.
_WORD = "regexp_extract(text, '[a-zA-Z]+', 0)"
_NAME = "CASE (turn + conv_id) % 4 WHEN 0 THEN 'Budi' WHEN 1 THEN 'Siti' WHEN 2 THEN 'Andi' ELSE 'Rina' END"
_MINUTES = """concat(CASE (conv_id * 7 + turn) % 8 WHEN 0 THEN concat('Oke, pertama kita sepakat memakai ', w, ' sebagai dasar. Kedua anggaran rapat ', turn, ' disetujui penuh. ')
 WHEN 1 THEN concat(who, ' akan menyiapkan laporan ', w, ' minggu depan. ') WHEN 2 THEN concat('Saya akan membuat daftar ', w, ' besok. Terima kasih semua. ')
 WHEN 3 THEN concat('Deadline: 12/0', turn % 9 + 1, ' untuk ', w, ' dan kita harus selesaikan segera. ') WHEN 4 THEN concat('Kesimpulan rapat: ', w, ' dipilih. 1. Tim menulis dokumen ', w, ' 2. Tim menguji hasil rapat itu. ')
 WHEN 5 THEN '' WHEN 6 THEN concat('Pertama itu yang mau kita bahas, ', w, '. ') ELSE concat('[NOISE] Nah, dua minggu lagi kita perlu evaluasi ', w, ' bersama, lalu ', who, ' siapkan data. ') END, text)"""
MINUTES = f"minutes AS (SELECT conv_id, turn, role, {_MINUTES} AS text FROM (SELECT *, {_WORD} AS w, {_NAME} AS who FROM conversations))"


def minutes(spark, sf_dir) -> DataFrame:
    """Conversations as meetings in which decisions are taken and tasks are given."""
    c = table(spark, sf_dir, "conversations").withColumns({"w": F.expr(_WORD), "who": F.expr(_NAME)})
    c = c.withColumn("text", F.expr(_MINUTES))
    return c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("seg_idx"), F.col("role").alias("speaker_id"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text")


_LIKE = " OR ".join(f"contains(lower(text), '{w}')" for w in T.DECISION_WORDS) + f" OR regexp_matches(lower(text), '{T.ORDINAL_START}')"


@query(f"WITH {MINUTES} SELECT conv_id, turn FROM minutes WHERE {_LIKE}")
def decision_sentences(spark, sf_dir):
    return minutes(spark, sf_dir).where(T.is_decision(F.col("text"))).select(F.col("meeting_id").alias("conv_id"), F.col("seg_idx").alias("turn"))


_NAMED = T.NAMED_COMMITMENT.replace(r"(?=", "(?:")
_OWNED = r"\b([A-Z][a-z]{2,})(?:\s+akan|\s+siapkan|\s+tolong|\s+bisa|\s+bertanggung)"


@query(f"""WITH {MINUTES} SELECT conv_id, turn, regexp_matches(lower(text), '{T.COMMITMENT}') OR regexp_matches(text, '{_NAMED}') OR {' OR '.join(f"contains(lower(text), '{w}')" for w in T.DUE_MARKS)} AS actionable,
 regexp_matches(lower(text), '{'|'.join(T.CHATTER)}') AS chatter, regexp_matches(lower(text), '{T.STRICT_DECISION.replace("(?iu)", "")}') AS decided FROM minutes""")
def sentence_flags(spark, sf_dir):
    t = F.col("text")
    return minutes(spark, sf_dir).select(F.col("meeting_id").alias("conv_id"), F.col("seg_idx").alias("turn"), T.is_actionable(t).alias("actionable"), T.is_chatter(t).alias("chatter"), T.is_strict_decision(t).alias("decided"))


@query()
def action_sentences(spark, sf_dir):
    return M.action_items(M.meeting_sentences(minutes(spark, sf_dir)), "meeting_id")


@query()
def meeting_actions(spark, sf_dir):
    return M.segment_actions(minutes(spark, sf_dir))


@query()
def committed_actions(spark, sf_dir):
    return M.sentence_actions(M.meeting_sentences(minutes(spark, sf_dir)), "meeting_id")


@query()
def meeting_decisions(spark, sf_dir):
    return M.decisions(M.meeting_sentences(minutes(spark, sf_dir)), "meeting_id").withColumn("decisions", F.array_join("decisions", " | "))


@query()
def context_decisions(spark, sf_dir):
    return M.context_decisions(M.meeting_sentences(minutes(spark, sf_dir)), "meeting_id").withColumn("decisions", F.array_join("decisions", " | "))


def _keyed(spark, sf_dir):
    s = M.document_similarity(M.meeting_sentences(minutes(spark, sf_dir)), "meeting_id")
    s = s.withColumn("total", F.count(F.lit(1)).over(S.Window.partitionBy("meeting_id")))
    return M.key_sentences(s, M.heuristic_score(F.col("sent_idx"), F.col("total"), F.col("sentence"), F.round("similarity", 9)), "meeting_id", 7)


@query()
def key_sentences(spark, sf_dir):
    return M.overview(_keyed(spark, sf_dir), "meeting_id")


@query()
def key_points(spark, sf_dir):
    return M.key_points(_keyed(spark, sf_dir), "meeting_id").withColumn("key_points", F.array_join("key_points", " | "))


@query(f"WITH {MINUTES} SELECT conv_id, turn, CASE WHEN contains(lower(text), 'besok') THEN 'besok' WHEN contains(lower(text), 'segera') OR contains(lower(text), 'secepat') OR contains(lower(text), 'sekarang') THEN 'segera' WHEN contains(lower(text), 'minggu depan') THEN '1 minggu' WHEN regexp_matches(lower(text), '\\d+\\s*minggu') THEN regexp_extract(lower(text), '(\\d+)\\s*minggu', 1) || ' minggu' WHEN contains(lower(text), 'dua minggu') THEN '2 minggu' WHEN contains(lower(text), 'deadline') THEN coalesce(nullif(regexp_extract(lower(text), 'deadline\\s*[:\\-\\s]*([\\w\\-./]+)', 1), ''), 'TBD') ELSE '' END AS due FROM minutes")
def due_dates(spark, sf_dir):
    return minutes(spark, sf_dir).select(F.col("meeting_id").alias("conv_id"), F.col("seg_idx").alias("turn"), T.due(F.col("text")).alias("due"))


@query(f"WITH {MINUTES} SELECT conv_id, turn, nullif(regexp_extract(text, '{_OWNED}', 1), '') AS owner FROM minutes")
def owners(spark, sf_dir):
    return minutes(spark, sf_dir).select(F.col("meeting_id").alias("conv_id"), F.col("seg_idx").alias("turn"), T.owner(F.col("text")).alias("owner"))


@query()
def persons(spark, sf_dir):
    return minutes(spark, sf_dir).select(F.col("meeting_id").alias("conv_id"), F.col("seg_idx").alias("turn"), F.array_join(T.persons(F.col("text")), "|").alias("persons"))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY 2")
def exact_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    return M.exact_dedup(d, F.col("h"), ["doc_id"])


_BARE = "list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]+', '', 'g'), '\\s+'), lambda x: x <> ''))"


@query(f"""WITH a AS (SELECT conv_id, turn, {_BARE} AS w FROM conversations), b AS (SELECT conv_id, list([w] ORDER BY turn) AS items FROM a GROUP BY 1),
 c AS (SELECT conv_id, list_reduce(items, lambda kept, x: CASE WHEN len(x[1]) = 0 OR len(list_filter(kept, lambda k: len(list_intersect(k, x[1])) >= 0.5 * len(list_distinct(list_concat(k, x[1]))))) > 0 THEN kept ELSE list_concat(kept, x) END, []::VARCHAR[][]) AS kept FROM b)
 SELECT conv_id AS meeting_id, len(kept)::BIGINT AS kept FROM c WHERE len(kept) > 0""")
def jaccard_dedup(spark, sf_dir):
    return M.greedy_distinct(talk(spark, sf_dir), "meeting_id", "seg_idx", "text").groupBy("meeting_id").agg(F.count(F.lit(1)).alias("kept"))


@query()
def collapse_repeats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapsed(F.col("text"))).alias("h"), T.is_repetitive(F.col("text")).alias("repetitive"))


@query("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def file_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("""SELECT event_id, CASE WHEN value > 0 THEN CASE WHEN floor(value * 60)::BIGINT >= 3600 THEN (floor(value * 60)::BIGINT // 3600)::VARCHAR || ' jam ' ELSE '' END
 || (floor(value * 60)::BIGINT % 3600 // 60)::VARCHAR || ' menit ' || (floor(value * 60)::BIGINT % 60)::VARCHAR || ' detik' ELSE '' END AS t FROM events""")
def duration_words(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", N.duration_words(F.col("value") * 60).alias("t"))


@query("""WITH c AS (SELECT conv_id, max(turn) + 1 AS total FROM conversations GROUP BY 1)
 SELECT conv_id, turn, round((turn + 1) / total::DOUBLE * 100, 6) AS percent, round((turn + 1.0)::DOUBLE / (turn + 1) * (total - turn - 1), 6) AS seconds_left FROM conversations JOIN c USING (conv_id)""")
def progress(spark, sf_dir):
    """Share of a conversation's turns done after each turn, and seconds left, a turn lasting one."""
    c = table(spark, sf_dir, "conversations")
    done = F.col("turn") + 1
    rows = c.join(c.groupBy("conv_id").agg((F.max("turn") + 1).alias("total")), "conv_id")
    return rows.select("conv_id", "turn", F.round(N.percent_done(done, F.col("total")), 6).alias("percent"), F.round(N.remaining(done.cast("double"), done, F.col("total")), 6).alias("seconds_left"))


@query("SELECT event_id, (value::BIGINT * 0 + floor(value * 60)::BIGINT // 3600) AS h, CASE WHEN floor(value * 60)::BIGINT >= 3600 THEN (floor(value * 60)::BIGINT // 3600)::VARCHAR || ':' || lpad((floor(value * 60)::BIGINT % 3600 // 60)::VARCHAR, 2, '0') ELSE (floor(value * 60)::BIGINT // 60)::VARCHAR END || ':' || lpad((floor(value * 60)::BIGINT % 60)::VARCHAR, 2, '0') AS t FROM events")
def format_duration(spark, sf_dir):
    s = F.col("value") * 60
    return table(spark, sf_dir, "events").select("event_id", F.expr("cast(floor(value * 60) as bigint) div 3600").alias("h"), N.format_duration(s).alias("t"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_join_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_manifest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


# --- tables by condition ---------------------------------------------------------------------


def results(spark, sf_dir) -> DataFrame:
    """Orders as results: condition by priority, sample by status, metric by price."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("condition"), F.col("o_orderstatus").alias("sample"), (F.col("o_totalprice") / 1000).alias("metric"), F.year("o_orderdate").alias("epoch"), "o_orderkey", (F.col("o_custkey") % 97 / 97.0).alias("cer"))


_RESULTS = "r AS (SELECT o_orderpriority AS condition, o_orderstatus AS sample, o_totalprice / 1000 AS metric, year(o_orderdate) AS epoch, o_orderkey, o_custkey % 97 / 97.0 AS cer FROM orders)"
_STATS = ("mean", "std", "min", "max")


@query(f"WITH {_RESULTS} SELECT condition, count(metric) AS n, round(avg(metric), 5) AS mean, round(stddev_samp(metric), 5) AS std, round(min(metric), 5) AS min, round(max(metric), 5) AS max FROM r GROUP BY 1")
def condition_summary(spark, sf_dir):
    return E.condition_summary(results(spark, sf_dir), "metric").select("condition", "n", *[F.round(c, 5).alias(c) for c in _STATS])


@query(f"WITH {_RESULTS} SELECT condition, count(metric) AS n, round(avg(metric), 5) AS mean, round(stddev_pop(metric), 5) AS std, round(min(metric), 5) AS min, round(max(metric), 5) AS max FROM r GROUP BY 1")
def condition_components(spark, sf_dir):
    return E.condition_summary(results(spark, sf_dir), "metric", population=True).select("condition", "n", *[F.round(c, 5).alias(c) for c in _STATS])


@query(f"WITH {_RESULTS} SELECT coalesce(condition, 'ALL') AS condition, count(metric) AS n, round(avg(metric), 5) AS mean, round(stddev_samp(metric), 5) AS std, round(min(metric), 5) AS min, round(max(metric), 5) AS max FROM r GROUP BY GROUPING SETS ((condition), ())")
def overall_and_condition(spark, sf_dir):
    return E.overall_and_condition(results(spark, sf_dir), "metric").select("condition", "n", *[F.round(c, 5).alias(c) for c in _STATS])


@query(f"WITH {_RESULTS}, m AS (SELECT condition, avg(metric) AS m FROM r GROUP BY 1) SELECT arg_min(condition, m) AS best, arg_max(condition, m) AS worst FROM m")
def best_worst_condition(spark, sf_dir):
    return E.best_and_worst(results(spark, sf_dir), "metric")


@query(f"WITH {_RESULTS} SELECT condition, round(arg_min(metric, o_orderkey) FILTER (sample = 'F'), 5) AS f, round(arg_min(metric, o_orderkey) FILTER (sample = 'O'), 5) AS o, round(arg_min(metric, o_orderkey) FILTER (sample = 'P'), 5) AS p FROM r GROUP BY 1")
def metric_pivot(spark, sf_dir):
    return E.pivot_metric(results(spark, sf_dir), "metric", "condition", "sample", ["F", "O", "P"], "o_orderkey").select("condition", *[F.round(c, 5).alias(c.lower()) for c in "FOP"])


@query(f"WITH {_RESULTS} SELECT condition, round(min(metric), 5) AS min, round(quantile_cont(metric, 0.25), 5) AS q1, round(quantile_cont(metric, 0.5), 5) AS median, round(quantile_cont(metric, 0.75), 5) AS q3, round(max(metric), 5) AS max FROM r GROUP BY 1")
def box_stats(spark, sf_dir):
    return E.box_stats(results(spark, sf_dir), "metric").select("condition", *[F.round(c, 5).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query(f"WITH {_RESULTS} SELECT epoch::VARCHAR AS epoch, round(avg(metric), 4) AS wer, round(avg(cer), 4) AS cer, count(*) AS count FROM r GROUP BY 1")
def epoch_summary(spark, sf_dir):
    r = results(spark, sf_dir).select("epoch", F.col("metric").alias("wer"), "cer")
    return E.epoch_summary(r).select("epoch", F.round("wer", 4).alias("wer"), F.round("cer", 4).alias("cer"), "count")


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_shipmode = 'RAIL') DESC, contains(l_shipmode, 'AIR') DESC, l_shipmode, l_linenumber) AS n FROM (SELECT *, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)) SELECT l_orderkey, l_shipmode FROM a WHERE n = 1".replace("'RAIL'", "'RF'").replace("'AIR'", "'O'"))
def preferred_recording(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"))
    return E.preferred(rows, "l_orderkey", "l_shipmode", "RF", "O")


@query("SELECT l_returnflag AS meeting, count(*) AS files, round(sum(l_quantity), 2) AS size FROM lineitem GROUP BY 1")
def files_per_meeting(spark, sf_dir):
    return E.files_per_group(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "meeting"), "meeting", "l_quantity").withColumn("size", F.round("size", 2))


@query("SELECT count(*) AS files, count(*) FILTER (o_orderstatus <> 'F') AS ok, round(count(*) FILTER (o_orderstatus <> 'F') * 100.0 / count(*), 6) AS success_rate, round(sum(o_totalprice), 2) AS total_time, round(avg(o_totalprice), 4) AS avg_time FROM orders")
def run_totals(spark, sf_dir):
    out = E.run_totals(table(spark, sf_dir, "orders"), F.col("o_orderstatus") != "F", "o_totalprice")
    return out.select("files", "ok", r6(F.col("success_rate"), "success_rate"), F.round("total_time", 2).alias("total_time"), F.round("avg_time", 4).alias("avg_time"))


def _evaluated(spark, sf_dir) -> DataFrame:
    """Line items as evaluations: a sample a line, condition by flag."""
    item = table(spark, sf_dir, "lineitem")
    return item.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("sample"), F.col("l_returnflag").alias("condition"), F.col("l_discount").alias("wer"), F.col("l_tax").alias("der"),
        F.col("l_linenumber").alias("substitutions"), F.col("l_quantity").cast("long").alias("deletions"), F.lit(0).alias("insertions"), (F.col("l_discount") / 2).alias("missed_speech"), (F.col("l_tax") / 2).alias("false_alarm"), F.lit(0.25).alias("speaker_confusion"),
    )


_EVALUATED = "v AS (SELECT l_orderkey || '-' || l_linenumber AS sample, l_returnflag AS condition, l_discount AS wer, l_tax AS der, l_linenumber AS substitutions, trunc(l_quantity)::BIGINT AS deletions, 0 AS insertions, l_discount / 2 AS missed_speech, l_tax / 2 AS false_alarm, 0.25 AS speaker_confusion FROM lineitem)"


@query(f"WITH {_EVALUATED} SELECT condition, round(avg(missed_speech), 6) AS avg_missed_speech, round(avg(false_alarm), 6) AS avg_false_alarm, round(avg(speaker_confusion), 6)::DOUBLE AS avg_speaker_confusion, sum(substitutions)::BIGINT AS total_substitutions, sum(deletions)::BIGINT AS total_deletions, sum(insertions)::BIGINT AS total_insertions FROM v GROUP BY 1")
def component_means(spark, sf_dir):
    out = E.component_means(_evaluated(spark, sf_dir))
    return out.select("condition", *[r6(F.col(c).cast("double"), c) for c in ("avg_missed_speech", "avg_false_alarm", "avg_speaker_confusion")], "total_substitutions", "total_deletions", "total_insertions")


@query(f"WITH {_EVALUATED} SELECT round(avg(der), 6) AS avg_der, round(avg(missed_speech), 6) AS avg_missed_speech, round(avg(false_alarm), 6) AS avg_false_alarm, round(avg(speaker_confusion), 6)::DOUBLE AS avg_speaker_confusion, count(*) AS n FROM v")
def der_totals(spark, sf_dir):
    return E.der_totals(_evaluated(spark, sf_dir)).select(*[r6(F.col(f"avg_{c}"), f"avg_{c}") for c in ("der", "missed_speech", "false_alarm", "speaker_confusion")], "n")


@query(f"WITH {_EVALUATED} SELECT sample AS \"Sample\", condition AS \"Condition\", printf('%.4f', wer::DOUBLE) AS \"WER\", printf('%.4f', der::DOUBLE) AS \"DER\", substitutions::VARCHAR AS \"Substitutions\", deletions::VARCHAR AS \"Deletions\", '' AS \"MER\", '' AS \"ROUGE1_F\" FROM v")
def evaluation_rows(spark, sf_dir):
    from ..sources import sinks as K

    return K.evaluation_table(_evaluated(spark, sf_dir)).select("Sample", "Condition", "WER", "DER", "Substitutions", "Deletions", "MER", "ROUGE1_F")


@query(f"""WITH {SPOKEN} SELECT meeting_id, 'SPEAKER ' || meeting_id || ' 1 ' || printf('%.3f', "start") || ' ' || printf('%.3f', "end" - "start") || ' <NA> <NA> ' || speaker_id || ' <NA> <NA>' AS value FROM spoken""")
def rttm_lines(spark, sf_dir):
    from ..sources import sinks as K

    return K.rttm_lines(spoken(spark, sf_dir)).select("meeting_id", "value")


@query("SELECT o_orderstatus AS status, count(*) AS files, count(*) FILTER (o_totalprice > 1000) AS ok, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 5) AS mean FROM orders GROUP BY 1")
def batch_totals(spark, sf_dir):
    out = E.batch_totals(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status", F.col("o_totalprice") > 1000, "o_totalprice")
    return out.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 5)})


@query("""WITH v AS (SELECT 'price' AS metric, o_totalprice::DOUBLE AS v FROM orders UNION ALL SELECT 'status', CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0 END FROM orders)
 SELECT metric, count(v) AS "count", round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS "min", round(quantile_cont(v, 0.25), 4) AS q1,
 round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS q3, round(max(v), 4) AS "max" FROM v GROUP BY 1""")
def run_describe(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("price"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("status"))
    out = E.describe(runs, ["price", "status"])
    return out.select("metric", "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q1", "median", "q3", "max")])


@query("SELECT n_name, coalesce(round(sum(c_acctbal), 2), 0) AS total FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY 1")
def ordered_dimension_join(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    sums = c.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("total"))
    return n.join(sums, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_name", F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total")).orderBy("n_name")


# --- vectors ---------------------------------------------------------------------------------

_CENTROIDS = """u AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
 m AS (SELECT label, p, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY p) AS c FROM m GROUP BY 1)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query(f"WITH {_CENTROIDS} SELECT vec_id, e.label AS label, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS similarity FROM embeddings e JOIN c ON e.label = c.label")
def cosine_to_centroid(spark, sf_dir):
    return X.cosine_to_centroid(vectors(spark, sf_dir), "label", "vec_id").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_CENTROIDS}, d AS (SELECT vec_id, c.label, round(1 - list_cosine_similarity(embedding::DOUBLE[], c), 9) AS d FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, label) AS n FROM d) SELECT vec_id, label AS nearest, round(d, 6) AS distance FROM r WHERE n = 1")
def nearest_centroid(spark, sf_dir):
    return X.nearest_centroid(vectors(spark, sf_dir), "label", "vec_id").withColumn("distance", F.round("distance", 6))


@query(f"WITH {_CENTROIDS} SELECT a.label AS label_a, b.label AS label_b, round(1 - list_cosine_similarity(a.c, b.c), 6) AS distance FROM c a JOIN c b ON a.label < b.label")
def centroid_distances(spark, sf_dir):
    return X.centroid_distances(vectors(spark, sf_dir), "label").withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))), 6) AS total FROM embeddings")
def row_normalize(spark, sf_dir):
    u = V.unit(F.col("embedding"))
    return vectors(spark, sf_dir).select("vec_id", r6(F.aggregate(u, F.lit(0.0), lambda s, x: s + x), "total"))


@query("WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings), s AS (SELECT p, avg(x) AS m, stddev_pop(x) AS d FROM u GROUP BY 1) SELECT vec_id, u.p AS pos, round((x - m) / CASE WHEN d > 0 THEN d ELSE 1 END, 5) AS z FROM u JOIN s ON u.p = s.p")
def zscore(spark, sf_dir):
    return X.standard_scores(vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>")), "vec_id").select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("z", 5).alias("z"))


@query()
def mmr_select(spark, sf_dir):
    return X.mmr(vectors(spark, sf_dir), "label", "vec_id", k=10)


@query()
def cluster_embeddings(spark, sf_dir):
    return X.cluster(vectors(spark, sf_dir).withColumn("meeting", (F.col("vec_id") / 500).cast("long")), "meeting", "vec_id")


_UNIT = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-12)) AS u FROM e),
 x AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM u)"""


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def label_sizes(spark, sf_dir):
    return X.label_sizes(vectors(spark, sf_dir), "label")


@query(f"""WITH {_UNIT}, s AS (SELECT label, list(t ORDER BY p) AS s, any_value(n) AS n FROM (SELECT label, p, sum(x) AS t, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
 d AS (SELECT vec_id, u.label AS own, s.label AS other, n, n - list_dot_product(u, s) AS d FROM u, s),
 a AS (SELECT vec_id, own, CASE WHEN n > 1 THEN d / (n - 1) ELSE 0 END AS a FROM d WHERE own = other), b AS (SELECT vec_id, own, min(d / n) AS b FROM d WHERE own <> other GROUP BY 1, 2)
 SELECT a.own AS label, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM a JOIN b USING (vec_id) GROUP BY 1""")
def silhouette(spark, sf_dir):
    """Mean silhouette by cosine distance of each label's vectors, from sums alone: linear in the rows."""
    return X.label_silhouette(vectors(spark, sf_dir), "label").withColumn("silhouette", F.round("silhouette", 6))


@query(f"WITH {_UNIT}, n AS (SELECT count(*) AS n, sum(list_dot_product(u, u)) AS own FROM u), t AS (SELECT sum(s * s) AS total FROM (SELECT p, sum(x) AS s FROM x GROUP BY 1)) SELECT round(1 - (total - own) / (n * (n - 1)), 6) AS mean_distance, (n * (n - 1) // 2)::BIGINT AS pairs FROM n, t")
def collapse_test(spark, sf_dir):
    return X.mean_pairwise_distance(vectors(spark, sf_dir), "vec_id").withColumn("mean_distance", F.round("mean_distance", 6))


@query()
def method_comparison(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("meeting", (F.col("vec_id") / 250).cast("long"))
    return X.compare_methods(rows, "meeting", "vec_id").withColumn("silhouette", F.round("silhouette", 6))


# --- signals ---------------------------------------------------------------------------------


def signal(spark, sf_dir):
    """Events' values as samples of a signal for each type."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_type").alias("key"), "event_id", F.col("value").alias("x"))
    return numbered(rows, ["key"], ["event_id"], "pos").select("key", "pos", "x")


_SIGNAL = "s AS (SELECT event_type AS key, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, value AS x FROM events)"


@query(f"WITH {_SIGNAL} SELECT key, pos, round(avg(x) OVER (PARTITION BY key, pos // 20), 6) AS y FROM s")
def cst_block_average(spark, sf_dir):
    return G.block_average(signal(spark, sf_dir), "key", 100, 5.0).select("key", "pos", r6(F.col("y"), "y"))


@query(f"WITH {_SIGNAL}, r AS (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY key) AS n, stddev_pop(x) OVER (PARTITION BY key) AS d FROM s) SELECT key, round(x + 0.5 * d, 6) AS threshold FROM r WHERE r = floor(n * 0.3)")
def adaptive_threshold(spark, sf_dir):
    return G.adaptive_threshold(signal(spark, sf_dir), "key", "x").select("key", r6(F.col("threshold"), "threshold"))


@query(f"WITH {_SIGNAL} SELECT key, pos, round(sum(CASE WHEN x > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30.0, 6) AS smooth FROM s")
def moving_average(spark, sf_dir):
    out = G.moving_average(signal(spark, sf_dir), "key", F.when(F.col("x") > 50, 1).otherwise(0))
    return out.select("key", "pos", r6(F.col("smooth"), "smooth"))


@query(f"WITH {_SIGNAL} SELECT key, pos, round(x / max(abs(x)) OVER (PARTITION BY key), 6) AS y FROM s")
def peak_normalize(spark, sf_dir):
    return G.peak_normalize(signal(spark, sf_dir), "key").select("key", "pos", r6(F.col("y"), "y"))


@query(f"WITH {_SIGNAL} SELECT key, round(avg(x * x), 4) AS power, round(max(abs(x)), 4) AS peak FROM s GROUP BY 1")
def signal_power(spark, sf_dir):
    return G.power(signal(spark, sf_dir), "key").select("key", F.round("power", 4).alias("power"), F.round("peak", 4).alias("peak"))


@query(f"WITH {_SIGNAL}, f AS (SELECT key, unnest(generate_series(0, (SELECT max(pos) // 4 FROM s))) AS frame FROM (SELECT DISTINCT key FROM s)), j AS (SELECT f.key, frame, count(*) AS n, avg(x * x) AS a FROM f JOIN s ON s.key = f.key AND pos >= frame * 4 AND pos < frame * 4 + 10 GROUP BY 1, 2) SELECT key, frame, round(sqrt(a + 1e-10), 6) AS energy FROM j WHERE n = 10")
def energy_frames(spark, sf_dir):
    return G.energy_frames(signal(spark, sf_dir), "key", 10, 4).select("key", "frame", r6(F.col("energy"), "energy"))


@query(f"WITH {_SIGNAL}, a AS (SELECT *, x > 20 AS f, lag(x > 20) OVER (PARTITION BY key ORDER BY pos) AS b FROM s), c AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> f THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY pos) AS g FROM a) SELECT key, round(min(pos) * 0.01, 4) AS \"start\", round((max(pos) + 1) * 0.01, 4) AS \"end\" FROM c WHERE f GROUP BY key, g")
def speech_regions(spark, sf_dir):
    frames = signal(spark, sf_dir).select("key", F.col("pos").alias("frame"), (F.col("x") > 20).alias("speech"))
    return G.true_regions(frames, "key", "speech", 0.01).select("key", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"))


@query(f"WITH {_SIGNAL} SELECT key, pos // 2 AS pos, round(avg(x), 6) AS y FROM s GROUP BY 1, 2")
def mono_signal(spark, sf_dir):
    two = signal(spark, sf_dir).select("key", F.expr("pos div 2").alias("pos"), (F.col("pos") % 2).alias("channel"), "x")
    return G.mono(two, "key").select("key", "pos", r6(F.col("x"), "y"))


@query(f"WITH {_SIGNAL} SELECT key, pos - 100 AS pos, round(x, 6) AS y FROM s WHERE pos >= 100 AND pos < 250")
def sliced_signal(spark, sf_dir):
    return G.time_slice(signal(spark, sf_dir), "key", 100, 1.0, 2.5).select("key", "pos", r6(F.col("x"), "y"))


@query(f"WITH {_SIGNAL} SELECT key, round((max(pos) + 1) / 100.0, 4)::DOUBLE AS duration FROM s GROUP BY 1")
def signal_duration(spark, sf_dir):
    return G.duration(signal(spark, sf_dir), "key", 100).select("key", F.round("duration", 4).alias("duration"))


@query(f"WITH {_SIGNAL}, a AS (SELECT key, pos, x, coalesce(lead(x) OVER (PARTITION BY key ORDER BY pos), x) AS y FROM s), j AS (SELECT key, x, y, pos, unnest(generate_series(ceil(pos * 160 / 100.0)::BIGINT, ceil((pos + 1) * 160 / 100.0)::BIGINT - 1)) AS j FROM a) SELECT key, j AS pos, round(x + (j * 100.0::DOUBLE / 160 - pos) * (y - x), 5) AS y FROM j")
def resampled_signal(spark, sf_dir):
    return G.resample(signal(spark, sf_dir), "key", 100, 160).select("key", "pos", F.round("x", 5).alias("y"))


@query(f"""WITH {_SIGNAL}, n AS (SELECT key, ceil((max(pos) + 1) * 40 / 100.0)::BIGINT AS n FROM s GROUP BY 1),
 j AS (SELECT key, pos, x, unnest(generate_series(greatest(ceil((pos - 16 / 0.36::DOUBLE) * 40 / 100), 0)::BIGINT, floor((pos + 16 / 0.36::DOUBLE) * 40 / 100)::BIGINT)) AS j FROM s),
 t AS (SELECT key, x, j, j * 2.5::DOUBLE - pos AS t FROM j),
 w AS (SELECT key, x, j, CASE WHEN abs(t) < 1e-9 THEN 1.0::DOUBLE ELSE sin(pi() * 0.36 * t) / (pi() * 0.36 * t) END * (0.42 + 0.5 * cos(pi() * t * 0.36 / 16) + 0.08 * cos(2 * pi() * t * 0.36 / 16)) AS w FROM t)
 SELECT w.key AS key, j AS pos, round(sum(w * x) / sum(w), 5) AS y FROM w JOIN n ON n.key = w.key WHERE j < n GROUP BY 1, 2""")
def filtered_signal(spark, sf_dir):
    return G.resample_filtered(signal(spark, sf_dir), "key", 100, 40).select("key", "pos", F.round("x", 5).alias("y"))


@query(f"WITH {_SIGNAL}, n AS (SELECT pos, x FROM s WHERE key = (SELECT min(key) FROM s) AND pos < 50), c AS (SELECT avg(x * x) AS p FROM n), l AS (SELECT key, sqrt(avg(x * x) / any_value(p) / 10) AS l FROM s, c GROUP BY 1) SELECT s.key, s.pos, round(s.x + n.x * l, 5) AS y FROM s JOIN n ON s.pos % 50 = n.pos JOIN l ON l.key = s.key")
def ambient_signal(spark, sf_dir):
    s = signal(spark, sf_dir)
    first = s.agg(F.min("key")).first()[0]
    noise = s.where((F.col("key") == first) & (F.col("pos") < 50)).select("pos", "x")
    return G.ambient_noise(s, "key", noise, 10.0).select("key", "pos", F.round("y", 5).alias("y"))


@query()
def noisy_signal(spark, sf_dir):
    return G.reverb(G.white_noise(signal(spark, sf_dir), "key", 20.0).select("key", "pos", F.col("y").alias("x")), "key", 100)


# --- batch forms of the streaming queries ----------------------------------------------------


@query("SELECT event_type, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS w_start, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def tumbling_stream(spark, sf_dir):
    out = W.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "value", ["event_type"])
    return out.select("event_type", F.date_format("w_start", "yyyy-MM-dd HH:mm:ss").alias("w_start"), "n", r6(F.col("mean"), "mean"))


@query("WITH a AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w FROM events) SELECT event_type, strftime(w, '%Y-%m-%d %H:%M:%S') AS w_start, count(*) AS n, round(sum(value), 4) AS total FROM a GROUP BY 1, 2")
def sliding_stream(spark, sf_dir):
    out = W.sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", "value", ["event_type"])
    return out.select("event_type", F.date_format("w_start", "yyyy-MM-dd HH:mm:ss").alias("w_start"), "n", F.round("total", 4).alias("total"))


@query("""WITH a AS (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS b FROM events), c AS (SELECT *, sum(CASE WHEN b IS NULL OR ts - b > INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g FROM a)
 SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, count(*) AS n FROM c GROUP BY event_type, g""")
def session_stream(spark, sf_dir):
    out = W.sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["event_type"])
    f = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("event_type", f("first_ts"), f("last_ts"), "n")


# --- compositions ----------------------------------------------------------------------------


@query()
def enumerated_decisions(spark, sf_dir):
    s = M.meeting_sentences(minutes(spark, sf_dir))
    return s.select("meeting_id", "sent_idx", F.explode(T.enumerated(F.col("sentence"))).alias("clause"))


@query()
def action_candidates(spark, sf_dir):
    return M.regex_actions(M.meeting_sentences(minutes(spark, sf_dir)), "meeting_id")


@query()
def semantic_dedup(spark, sf_dir):
    """Turns of each conversation, like ones once: by vectors of words, and by words where that merges nothing."""
    return M.semantic_distinct(minutes(spark, sf_dir), "meeting_id", "seg_idx", "text")


@query()
def speaker_digests(spark, sf_dir):
    return M.speaker_digests(talk(spark, sf_dir))


@query()
def chunk_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_idx", "chunk")).select("doc_id", "chunk_idx", F.length("chunk").alias("n"))


@query()
def diarize_events(spark, sf_dir):
    """Vectors stand for windows of a recording: 500 windows to a meeting, half a hop apart."""
    from . import meeting as P

    e = vectors(spark, sf_dir)
    at = (F.col("vec_id") % 500) * 0.75
    w = e.select((F.col("vec_id") / 500).cast("long").alias("meeting_id"), F.col("vec_id").cast("long").alias("seg_idx"), at.alias("start"), (at + 1.5).alias("end"), "embedding")
    return P.diarize(w)


def _merged(side: str, where: str, shrink: str) -> str:
    return f"""{side}0 AS (SELECT meeting_id, speaker_id, round(("start" + {shrink}) * 1000000)::BIGINT AS s, round(("end" - {shrink}) * 1000000)::BIGINT AS e FROM spoken WHERE {where}),
 {side}1 AS (SELECT *, max(e) OVER (PARTITION BY meeting_id, speaker_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {side}0 WHERE e > s),
 {side}2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id, speaker_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM {side}1),
 {side} AS (SELECT meeting_id, min(s) AS s, max(e) AS e FROM {side}2 GROUP BY meeting_id, speaker_id, g)"""


def _der_sql(seconds: str) -> str:
    return f"""WITH {SPOKEN}, {_merged('r', 'seg_idx % 2 = 0', '0.25')}, {_merged('h', 'seg_idx % 2 = 1', '0.0')},
 x AS (SELECT meeting_id, s AS t, 1 AS r, 0 AS h FROM r UNION ALL SELECT meeting_id, e, -1, 0 FROM r UNION ALL SELECT meeting_id, s, 0, 1 FROM h UNION ALL SELECT meeting_id, e, 0, -1 FROM h),
 y AS (SELECT meeting_id, t, sum(r) AS r, sum(h) AS h FROM x GROUP BY 1, 2),
 z0 AS (SELECT meeting_id, t, sum(r) OVER w AS r, sum(h) OVER w AS h, lead(t) OVER w AS u FROM y WINDOW w AS (PARTITION BY meeting_id ORDER BY t)),
 b AS (SELECT meeting_id, round(min("start") * 1000000)::BIGINT AS t0 FROM spoken GROUP BY 1),
 z AS (SELECT meeting_id, r, h, {seconds} AS d FROM z0 JOIN b USING (meeting_id) WHERE u IS NOT NULL),
 c AS (SELECT meeting_id, sum(d) FILTER (r > 0 AND h = 0) AS m, sum(d) FILTER (r = 0 AND h > 0) AS f, sum(d * abs(r - h) / greatest(r, h)) FILTER (r > 0 AND h > 0 AND r <> h) AS k FROM z GROUP BY 1),
 t AS (SELECT meeting_id, sum("end" - "start") AS d, count(DISTINCT speaker_id) AS n FROM spoken WHERE seg_idx % 2 = 0 GROUP BY 1),
 v AS (SELECT meeting_id, count(DISTINCT speaker_id) AS n FROM spoken WHERE seg_idx % 2 = 1 GROUP BY 1),
 e AS (SELECT coalesce(t.meeting_id, v.meeting_id) AS meeting_id, coalesce(d, 0)::DOUBLE AS d, coalesce(t.n, 0) AS nr, coalesce(v.n, 0) AS nh FROM t FULL JOIN v ON t.meeting_id = v.meeting_id)
 SELECT meeting_id, round(d, 3) AS total_duration, CASE WHEN d > 0 THEN round(coalesce(m, 0) / d, 6) ELSE 0 END AS missed_speech, CASE WHEN d > 0 THEN round(coalesce(f, 0) / d, 6) ELSE 0 END AS false_alarm,
 CASE WHEN d > 0 THEN round(coalesce(k, 0) / d, 6) ELSE 0 END AS speaker_confusion, CASE WHEN d > 0 THEN round(least(1.0, (coalesce(m, 0) + coalesce(f, 0) + coalesce(k, 0)) / d), 6) ELSE 0 END AS der,
 nr::BIGINT AS num_speakers_ref, nh::BIGINT AS num_speakers_hyp FROM e LEFT JOIN c USING (meeting_id)"""


def _der_columns(out: DataFrame) -> DataFrame:
    return out.select("meeting_id", F.round("total_duration", 3).alias("total_duration"), *[r6(F.col(c), c) for c in ("missed_speech", "false_alarm", "speaker_confusion", "der")], *[F.col(c).cast("long").alias(c) for c in ("num_speakers_ref", "num_speakers_hyp")])


@query(_der_sql("(greatest(ceil((u - t0 - 5000) / 10000.0), 0) - greatest(ceil((t - t0 - 5000) / 10000.0), 0)) * 0.01::DOUBLE"))
def der_grid(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return _der_columns(E.der_grid(s.where("seg_idx % 2 = 0"), s.where("seg_idx % 2 = 1")))


@query(_der_sql("(u - t) / 1000000.0::DOUBLE"))
def der_sweep(spark, sf_dir):
    s = spoken(spark, sf_dir)
    return _der_columns(E.der_sweep(s.where("seg_idx % 2 = 0"), s.where("seg_idx % 2 = 1")))


@query()
def auto_tune(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("meeting", (F.col("vec_id") / 250).cast("long"))
    return X.auto_tune(rows, "meeting", "vec_id", target=5).withColumn("score", F.round("score", 6))


@query("""WITH a AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS b FROM events), c AS (SELECT *, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turn FROM a)
 SELECT user_id AS meeting_id, turn::BIGINT AS turn, event_type AS speaker_id, string_agg(event_type, ' ' ORDER BY ts) AS text FROM c GROUP BY 1, 2, 3""")
def words_to_turns(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("meeting_id"), F.col("event_type").alias("speaker_id"), F.col("event_type").alias("word"), F.col("ts").alias("start"), F.col("ts").alias("end"))
    return C.words_to_turns(e).select("meeting_id", "turn", "speaker_id", "text")
