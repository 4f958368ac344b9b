"""Sinks: JSON lines, CSV, RTTM, text reports, LaTeX and Markdown tables, minimal documents, wave files."""

from __future__ import annotations

import io
import wave
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import xml_escape

# Colours of speakers, by rank.
PALETTE = ["0066CC", "CC3300", "009933", "993399", "CC6600", "009999", "666600", "99004C"]


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def rttm_lines(segments: DataFrame, places: int = 3, meeting: str = "meeting_id") -> DataFrame:
    """One ``value`` for each segment, in the order of the meeting."""
    f = f"%.{places}f"
    line = F.format_string(f"SPEAKER %s 1 {f} {f} <NA> <NA> %s <NA> <NA>", F.col(meeting).cast("string"), F.col("start"), F.col("end") - F.col("start"), F.col("speaker_id"))
    return segments.select(meeting, "start", line.alias("value"))


def write_rttm(segments: DataFrame, path: str, meeting: str = "meeting_id") -> None:
    """A folder for each meeting, its lines in order."""
    rttm_lines(segments, meeting=meeting).repartition(meeting).sortWithinPartitions(meeting, "start").drop("start").write.partitionBy(meeting).text(path)


def evaluation_csv(results: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Numbers with four places, blanks for nulls."""
    return results.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in texts], *[F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", F.col(c).cast("double"))).alias(c) for c in numbers])


def markdown_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """``line`` rows of a Markdown table, numbered."""
    body = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(columns) + " |"), (1, "|" + " --- |" * len(columns))], "n int, line string")
    return head.unionByName(rows.select((F.row_number().over(Window.orderBy(order)) + 1).alias("n"), body.alias("line")))


def latex_table(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    body = F.concat(F.concat_ws(" & ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(r" \\"))
    head = rows.sparkSession.createDataFrame([(0, rf"\begin{{tabular}}{{{'l' * len(columns)}}}"), (1, " & ".join(columns) + r" \\ \hline"), (1 << 30, r"\end{tabular}")], "n int, line string")
    return head.unionByName(rows.select((F.row_number().over(Window.orderBy(order)) + 1).alias("n"), body.alias("line")))


def speaker_colors(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    w = Window.partitionBy(meeting).orderBy("speaker_id")
    rank = F.row_number().over(w) - 1
    return segments.select(meeting, "speaker_id").distinct().withColumn("color", F.element_at(F.array(*map(F.lit, PALETTE)), (rank % len(PALETTE) + 1).cast("int")))


def report_line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}: "), F.format_string("%.4f", value.cast("double")))


def pass_or_fail(measured: DataFrame, expected: DataFrame, by: str = "condition") -> DataFrame:
    """Mean against what is expected of the condition."""
    return measured.join(expected, by, "left").withColumn("verdict", F.when(F.col("mean") <= F.col("expected"), "PASS").when(F.col("mean").isNull() | F.col("expected").isNull(), "N/A").otherwise("FAIL"))


def document_rows(meetings: DataFrame, decisions: DataFrame, actions: DataFrame, segments: DataFrame, key: str = "meeting_id") -> DataFrame:
    """meeting, section, para, style, text of a document: title, overview, decisions, actions, transcript.

    ``meetings`` has title and overview; decisions an array; actions item, owner, task, due.
    """
    row = lambda df, section, para, style, text: df.select(key, F.lit(section).alias("section"), para.cast("long").alias("para"), F.lit(style).alias("style"), text.alias("text"))
    numbered = decisions.select(key, F.posexplode("decisions").alias("n", "d"))
    task = F.concat_ws(" | ", "owner", "task", F.when(F.col("due") == "", "-").otherwise(F.col("due")))
    line = F.concat(F.col("speaker_id"), F.lit(": "), F.col("text"))
    return (
        row(meetings, 0, F.lit(0), "title", F.col("title")).unionByName(row(meetings, 1, F.lit(0), "body", F.col("overview")))
        .unionByName(row(numbered, 2, F.col("n"), "list", F.concat((F.col("n") + 1).cast("string"), F.lit(". "), F.col("d"))))
        .unionByName(row(actions, 3, F.col("item"), "table", task)).unionByName(row(segments, 4, F.col("seg_idx"), "line", line))
        .where("text is not null and trim(text) not in ('', '-')")
    )


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def documents(paragraphs: DataFrame, key: str = "meeting_id") -> DataFrame:
    """key and content (a word-processor file) of each meeting's ordered paragraphs."""
    kind = dict(paragraphs.dtypes)[key]
    rows = paragraphs.withColumn("x", xml_escape(F.col("text")))
    packed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "para", "x"))), lambda r: r["x"]).alias("ps"))

    def run(batches):
        for b in batches:
            out = []
            for ps in b["ps"]:
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{p}</w:t></w:r></w:p>' for p in ps)
                z = io.BytesIO()
                with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
                    f.writestr("[Content_Types].xml", _TYPES)
                    f.writestr("_rels/.rels", _RELS)
                    f.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
                out.append(z.getvalue())
            yield pd.DataFrame({key: b[key], "content": out})

    return packed.mapInPandas(run, f"{key} {kind}, content binary")


def wave_files(audio: DataFrame, rate: int = 16_000) -> DataFrame:
    """audio_id and content (16-bit mono wave) of chunks of samples."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate(g.sort_values("chunk_idx")["samples"].to_list()) if len(g) else np.zeros(0)
        z = io.BytesIO()
        with wave.open(z, "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
            f.writeframes((np.clip(x, -1, 1) * 32767).astype(np.int16).tobytes())
        return pd.DataFrame({"audio_id": [g["audio_id"].iloc[0]], "content": [z.getvalue()]})

    return audio.groupBy("audio_id").applyInPandas(run, "audio_id string, content binary")


#: Columns of the evaluation table, how each is written, and where it comes from.
EVALUATION = [
    ("Sample", "%s", "sample"), ("Condition", "%s", "condition"), ("WER", "%.4f", "wer"), ("MER", "%.4f", "mer"), ("WIL", "%.4f", "wil"), ("CER", "%.4f", "cer"),
    ("Substitutions", "%d", "substitutions"), ("Deletions", "%d", "deletions"), ("Insertions", "%d", "insertions"), ("Hits", "%d", "hits"),
    ("Ref_Words", "%d", "reference_length"), ("Hyp_Words", "%d", "hypothesis_length"), ("DER", "%.4f", "der"), ("Missed_Speech", "%.4f", "missed_speech"),
    ("False_Alarm", "%.4f", "false_alarm"), ("Speaker_Confusion", "%.4f", "speaker_confusion"), ("ROUGE1_F", "%.4f", "rouge1_f"), ("ROUGE2_F", "%.4f", "rouge2_f"),
    ("ROUGEL_F", "%.4f", "rougel_f"), ("BERTScore_F1", "%.4f", "bertscore_f1"), ("Duration_Sec", "%.2f", "total_duration"), ("Num_Speakers_Ref", "%d", "num_speakers_ref"),
    ("Num_Speakers_Hyp", "%d", "num_speakers_hyp"),
]


def evaluation_table(results: DataFrame) -> DataFrame:
    """The 23 text columns of an evaluation; blank where a value or its column is missing."""
    kind = {"%s": "string", "%d": "long"}

    def cell(name: str, form: str, source: str) -> Column:
        if source not in results.columns:
            return F.lit("").alias(name)
        return F.coalesce(F.when(F.col(source).isNotNull(), F.format_string(form, F.col(source).cast(kind.get(form, "double")))), F.lit("")).alias(name)

    return results.select(*[cell(*c) for c in EVALUATION])


def _lines(spark, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, None, r) for n, r in enumerate(rows)], "n int, sample string, value string")


def evaluation_report(results: DataFrame, condition: str = "-", stamp: str = "") -> DataFrame:
    """n, sample, value: the lines of a report, in the order of n and sample, over wide results (sample, word and diarization errors, ROUGE); a row for each sample besides the totals."""
    has = lambda c: c if c in results.columns else "cast(null as double)"
    sums = results.selectExpr(*[f"{has(c)} as {c}" for c in ("wer", "der", "missed_speech", "false_alarm", "speaker_confusion", "substitutions", "deletions", "insertions", "hits", "rouge1_f", "rouge2_f", "rougel_f", "bertscore_f1")])
    t = sums.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("wer", "der") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("n", F.count))],
        *[F.avg(c).alias(f"mean_{c}") for c in ("missed_speech", "false_alarm", "speaker_confusion")], *[F.sum(c).alias(f"sum_{c}") for c in ("substitutions", "deletions", "insertions", "hits")],
        *[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"mean_{c}") for c in ("rouge1_f", "rouge2_f", "rougel_f", "bertscore_f1")], F.count("rouge1_f").alias("n_summary"),
    ).first()
    # The report's lines
    both = lambda v: "-" if v is None else f"{v:.4f} ({v * 100:.2f}%)"
    head = ["=" * 70, "LAPORAN EVALUASI SISTEM NOTULENSI RAPAT OTOMATIS", f"Kondisi: {condition}", f"Timestamp: {stamp}", "=" * 70, "", "1. EVALUASI ASR (Word Error Rate)", "-" * 50]
    asr = [
        f"   Jumlah sampel      : {t['n_wer']}", f"   WER rata-rata      : {both(t['mean_wer'])}", f"   Standar deviasi    : {t['std_wer']:.4f}", f"   WER minimum        : {both(t['min_wer'])}",
        f"   WER maksimum       : {both(t['max_wer'])}", "", "   Detail Error Total:", f"   - Substitutions    : {t['sum_substitutions']}", f"   - Deletions        : {t['sum_deletions']}",
        f"   - Insertions       : {t['sum_insertions']}", f"   - Correct (Hits)   : {t['sum_hits']}",
    ] if t["n_wer"] else ["   Tidak ada data WER untuk dievaluasi."]
    der = [
        f"   Jumlah sampel      : {t['n_der']}", f"   DER rata-rata      : {both(t['mean_der'])}", f"   Standar deviasi    : {t['std_der']:.4f}", "", "   Komponen Error (rata-rata):",
        f"   - Missed Speech    : {both(t['mean_missed_speech'])}", f"   - False Alarm      : {both(t['mean_false_alarm'])}", f"   - Speaker Confusion: {both(t['mean_speaker_confusion'])}",
    ] if t["n_der"] else ["   Tidak ada data DER untuk dievaluasi."]
    summary = [
        f"   Jumlah sampel      : {t['n_summary']}", f"   ROUGE-1 F1 (avg)   : {t['mean_rouge1_f']:.4f}", f"   ROUGE-2 F1 (avg)   : {t['mean_rouge2_f']:.4f}", f"   ROUGE-L F1 (avg)   : {t['mean_rougel_f']:.4f}",
        f"   BERTScore F1 (avg) : {t['mean_bertscore_f1']:.4f}",
    ] if t["n_summary"] else ["   Tidak ada data ringkasan untuk dievaluasi."]

    def samples(metric: str, at: int) -> DataFrame:
        line = F.format_string(f"   - %s: {metric.upper()} = %.4f (%.2f%%)", F.col("sample").cast("string"), F.col(metric), F.col(metric) * 100)
        return results.where(F.col(metric).isNotNull()).select(F.lit(at).alias("n"), F.col("sample").cast("string").alias("sample"), line.alias("value"))

    parts = [*head, *asr, *(["", "   Detail per Sampel:"] if t["n_wer"] else [])]
    out = _lines(results.sparkSession, parts)
    if t["n_wer"]:
        out = out.unionByName(samples("wer", len(parts)))
    second = ["", "2. EVALUASI DIARIZATION (Diarization Error Rate)", "-" * 50, *der, *(["", "   Detail per Sampel:"] if t["n_der"] else [])]
    out = out.unionByName(_lines(results.sparkSession, second).withColumn("n", F.col("n") + len(parts) + 1))
    at = len(parts) + 1 + len(second)
    if t["n_der"]:
        out = out.unionByName(samples("der", at))
    third = ["", "3. EVALUASI RINGKASAN (Ringkasan/Abstraksi)", "-" * 50, *summary, ""]
    return out.unionByName(_lines(results.sparkSession, third).withColumn("n", F.col("n") + at + 1))


def condition_report(results: DataFrame, expected: DataFrame, stamp: str = "") -> DataFrame:
    """n, value: totals, then each condition (description, expected_wer, expected_der given) with means and whether they meet what is expected."""
    stat = lambda c: [F.avg(c).alias(f"mean_{c}"), F.stddev_samp(c).alias(f"std_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.count(c).alias(f"n_{c}")]
    t = results.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("condition")).alias("conditions"), *stat("wer"), *stat("der")).first()
    # The report's lines
    lines = ["=" * 80, "LAPORAN EVALUASI SISTEM NOTULENSI RAPAT OTOMATIS", "=" * 80, "", f"Timestamp: {stamp}", f"Total samples evaluated: {t['n']}", f"Conditions tested: {', '.join(t['conditions'])}", "", "-" * 80, "RINGKASAN KESELURUHAN", "-" * 80]
    for m in ("wer", "der"):
        if t[f"n_{m}"]:
            lines += ["", f"{m.upper()} Keseluruhan:", f"  Mean: {t[f'mean_{m}']:.4f} ({t[f'mean_{m}'] * 100:.2f}%)", f"  Std:  {t[f'std_{m}'] or 0.0:.4f}", f"  Min:  {t[f'min_{m}']:.4f}", f"  Max:  {t[f'max_{m}']:.4f}"]
    lines += ["", "-" * 80, "DETAIL PER KONDISI", "-" * 80]
    by = results.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), *stat("wer"), *stat("der")).join(expected, "condition").orderBy("condition")
    for r in by.toLocalIterator():  # a row for each condition that is described
        lines += ["", f"[{r['condition'].upper()}]", f"  Deskripsi: {r['description']}", f"  Expected WER: {r['expected_wer']}", f"  Expected DER: {r['expected_der']}", f"  Samples: {r['n']}"]
        for m in ("wer", "der"):
            if r[f"n_{m}"]:
                met = r[f"mean_{m}"] <= r[f"expected_{m}"]
                lines += ["", f"  {m.upper()} Results:", f"    Mean: {r[f'mean_{m}']:.4f}", f"    Std:  {r[f'std_{m}'] or 0.0:.4f}", f"    Status: {'✓ MEETS EXPECTATION' if met else '✗ ABOVE EXPECTATION'}"]
    return _lines(results.sparkSession, lines)


def result_objects(diarization: DataFrame, transcript: DataFrame, summary: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """One object a meeting: metadata counts, its ordered diarization and transcript segments, and its summary."""
    def packed(d: DataFrame, name: str) -> DataFrame:
        fields = [c for c in d.columns if c != meeting and c != "embedding"]
        first = [c for c in ("seg_idx", "start") if c in fields]
        return d.groupBy(meeting).agg(F.array_sort(F.collect_list(F.struct(*first, *[c for c in fields if c not in first]))).alias(name))

    s = summary.select(meeting, F.struct(*[c for c in summary.columns if c != meeting]).alias("summary"))
    both = packed(diarization, "diarization").join(packed(transcript, "transcript"), meeting, "full").join(s, meeting, "full")
    return both.withColumn("metadata", F.struct(F.coalesce(F.size("diarization"), F.lit(0)).alias("diarization_segments"), F.coalesce(F.size("transcript"), F.lit(0)).alias("transcript_segments")))


def summary_json(summary: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    return summary.select(meeting, F.to_json(F.struct(*[c for c in summary.columns if c != meeting])).alias("value"))


def summary_text(summary: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """meeting, value: overview, key_points, decisions, action_items (owner, task, due) and topics as numbered text."""
    numbered = lambda c, f: F.transform(c, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), f(x)))
    part = lambda head, c, f, tail: F.when(F.size(c) > 0, F.concat(F.array(F.lit(head)), numbered(c, f), F.array(*map(F.lit, tail)) if tail else F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    task = lambda a: F.concat(F.lit("["), F.coalesce(a["owner"], F.lit("TBD")), F.lit("] "), F.coalesce(a["task"], F.lit("")), F.when(F.coalesce(a["due"], F.lit("")) != "", F.concat(F.lit(" (Due: "), a["due"], F.lit(")"))).otherwise(""))
    topics = F.when(F.size("topics") > 0, F.array(F.lit(""), F.lit("Topik:"), F.array_join("topics", ", "))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        F.array(F.lit("=== RINGKASAN RAPAT ===\n"), F.concat(F.lit("Overview:\n"), F.coalesce("overview", F.lit("")), F.lit("\n"))), part("Poin-Poin Penting:", "key_points", lambda x: x, [""]),
        part("Keputusan:", "decisions", lambda x: x, [""]), part("Action Items:", "action_items", task, []), topics,
    )
    return summary.select(meeting, F.array_join(lines, "\n").alias("value"))


def summary_yaml(summary: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """meeting, value: the fields by name, lists of texts or of flat objects as items; texts are quoted as in JSON, which is YAML too."""
    quote = lambda c: F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", ""))
    out = []

    def flat(names: list[str]):
        lines = lambda x: [F.concat(F.lit(f"{'- ' if n == 0 else '  '}{name}: "), F.coalesce(quote(x[name]), F.lit("null"))) for n, name in enumerate(names)]
        return lambda x: F.array_join(F.array(*lines(x)), "\n")

    for f in sorted((f for f in summary.schema.fields if f.name != meeting), key=lambda f: f.name):
        inner = getattr(f.dataType, "elementType", None)
        c = F.col(f.name)
        if inner is None:
            out.append(F.concat(F.lit(f"{f.name}: "), F.coalesce(quote(c), F.lit("null"))))
            continue
        names = [g.name for g in getattr(inner, "fields", [])]
        item = flat(names) if names else lambda x: F.concat(F.lit("- "), quote(x))
        out.append(F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"{f.name}:\n"), F.array_join(F.transform(c, item), "\n"))).otherwise(F.lit(f"{f.name}: []")))
    return summary.select(meeting, F.concat_ws("\n", *out).alias("value"))


def annotation_templates(audio: DataFrame, speakers: int = 2) -> DataFrame:
    """name, value of three files for each recording (stem, path, duration): a transcript and an annotation to fill in, and what is known of it."""
    from ..functions.numeric import format_duration

    name = F.regexp_extract("path", r"([^/]+)$", 1)
    length = F.concat(format_duration(F.col("duration")), F.format_string(" (%.2f detik)", F.col("duration")))
    bar = "# ============================================"
    text = F.concat_ws("\n", F.concat(F.lit("# Ground Truth Transcript untuk: "), name), F.concat(F.lit("# Durasi audio: "), length), F.lit("#"), F.lit("# Mulai transkripsi di bawah baris ini:"), F.lit(bar), F.lit(""), F.lit("[Tulis transkripsi di sini...]"), F.lit(""))
    rttm = F.concat_ws(
        "\n", F.lit("# Ground Truth Diarization (RTTM Format)"), F.concat(F.lit("# File: "), name), F.concat(F.lit("# Durasi: "), length), F.lit(f"# Estimasi speakers: {speakers}"), F.lit("#"), F.lit("# Mulai anotasi di bawah:"), F.lit(bar), F.lit(""),
        F.concat(F.lit("SPEAKER "), F.col("stem"), F.lit(" 1 0.00 0.00 <NA> <NA> SPEAKER_00 <NA> <NA>")), F.lit(""),
    )
    info = F.to_json(F.struct(name.alias("file"), F.col("duration"), F.lit(speakers).alias("num_speakers")))
    files = F.array(*[F.struct(F.concat(F.col("stem"), F.lit(end)).alias("name"), v.alias("value")) for end, v in ((".txt", text), (".rttm", rttm), ("_info.json", info))])
    return audio.select(F.explode(files).alias("f")).select("f.name", "f.value")


def converted_annotations(utterances: DataFrame, durations: DataFrame | None = None, pace: float = 3.5) -> tuple[DataFrame, DataFrame]:
    """From labelled texts (path, utt_idx, speaker_id, text): (name, value) of the plain texts, and (name, start, value) of the annotation lines.

    A file's time is dealt by words over its utterances; without a duration (path, duration) it is words / ``pace``, a second at least.
    """
    from ..functions.text import safe_speaker, word_tokens
    from ..operators.segments import cumulative_starts, proportional_durations

    prefix = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), "(?i)_gt$", "")
    rows = utterances.withColumns({"name": prefix, "n_words": F.greatest(word_tokens(F.col("text")), F.lit(1))})
    texts = rows.where("trim(text) <> ''").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("utt_idx", "text"))).alias("p")).select("name", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("value"))
    estimated = F.greatest(F.lit(1.0), F.sum("n_words").over(Window.partitionBy("path")) / pace)
    timed = rows.withColumn("total", estimated) if durations is None else rows.join(durations.select("path", F.col("duration").alias("__d")), "path", "left").withColumn("total", F.coalesce("__d", estimated)).drop("__d")
    dealt = cumulative_starts(proportional_durations(timed, keys=["path"]), ["path"], ["utt_idx"])
    segments = dealt.select("name", safe_speaker(F.col("speaker_id")).alias("speaker_id"), "start", (F.col("start") + F.col("duration")).alias("end"))
    return texts, rttm_lines(segments, meeting="name")


def annotation_bundle(words: DataFrame, meeting: str = "meeting_id") -> dict[str, DataFrame]:
    """Of timed words (meeting, speaker_id, word, start, end): plain transcript, annotation lines, transcript by turns and counts."""
    from ..operators.sampling import words_to_turns
    from ..operators.segments import plain_words

    turns = words_to_turns(words, meeting)
    line = F.concat(F.col("speaker_id"), F.lit(": "), F.col("text"))
    spoken = turns.withColumn("line", line).groupBy(meeting).agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("p")).select(meeting, F.array_join(F.transform("p", lambda x: x["line"]), "\n").alias("value"))
    counts = words.groupBy(meeting).agg(F.count(F.lit(1)).alias("words"), F.countDistinct("speaker_id").alias("speakers"), F.max("end").alias("duration"))
    return {"transcript": plain_words(words, meeting), "rttm": rttm_lines(turns, meeting=meeting), "speakers": spoken, "metadata": counts}


def batch_configuration(files: DataFrame, columns: list[str], output: str) -> DataFrame:
    """One ``value``: a JSON object of the output folder and a sample object for each file, in order of the columns."""
    return files.agg(F.to_json(F.struct(F.lit(output).alias("output_dir"), F.array_sort(F.collect_list(F.struct(*columns))).alias("samples"))).alias("value"))


def resampled_manifest(manifest: DataFrame, listing: DataFrame, folder: str, rate: int = 16_000) -> DataFrame:
    """Rows whose file is listed, with its new place under ``folder`` and its new rate; the samples go through ``signals.resample``."""
    from .readers import existing

    there, _ = existing(manifest, listing)
    return there.withColumns({"wav": F.concat(F.lit(folder.rstrip("/") + "/"), F.regexp_extract("wav", r"([^/]+)$", 1)), "sample_rate": F.lit(rate)})


def small_manifests(manifest: DataFrame, train: str, valid: str) -> None:
    """The first two rows (by file) as a manifest each, for a trial run."""
    rows = manifest.orderBy("wav", "start").limit(2).collect()
    for row, path in zip([rows[0], rows[-1]] if rows else [], (train, valid)):
        manifest.sparkSession.createDataFrame([row], manifest.schema).write.mode("overwrite").json(path)


def as_objects(rows: DataFrame, left_out: tuple[str, ...] = ("embedding", "metadata", "language")) -> DataFrame:
    """Rows as JSON objects, without what isn't written."""
    return rows.select(F.to_json(F.struct(*[c for c in rows.columns if c not in left_out])).alias("value"))


def batch_rows(results: DataFrame) -> DataFrame:
    """file, status (success, or the error), processing_time and duration (two places) of a batch's runs."""
    return results.select("file", F.when(F.col("error").isNull(), "success").otherwise(F.concat(F.lit("error: "), F.col("error"))).alias("status"), F.round("processing_time", 2).alias("processing_time"), F.round("duration", 2).alias("duration"))


def run_metadata(segments: DataFrame, settings: dict, meeting: str = "meeting_id") -> DataFrame:
    """meeting and a map of texts: counts of the run, and its settings by name (nested names joined by a stop)."""
    def flat(d: dict, head: str = "") -> list[tuple[str, str]]:
        return [x for k, v in d.items() for x in (flat(v, f"{head}{k}.") if isinstance(v, dict) else [(f"{head}{k}", str(v))])]

    given = [F.lit(x) for pair in flat(settings) for x in pair]
    counts = segments.groupBy(meeting).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("speaker_id").alias("s"), F.sum(F.col("end") - F.col("start")).alias("d"))
    own = [F.lit("segments"), F.col("n").cast("string"), F.lit("speakers"), F.col("s").cast("string"), F.lit("speech"), F.format_string("%.2f", F.col("d"))]
    return counts.select(meeting, F.create_map(*own, *given).alias("metadata"))
