"""Sources: listings, annotations, labelled texts, manifests, predictions, XML, audio."""

from __future__ import annotations

import io
import json
import uuid
import wave

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import parse_timestamp

AUDIO = ["wav", "mp3", "flac", "m4a", "ogg", "webm", "mp4"]
# Formats of annotation lines.
LABEL = r"^\s*([^:]{1,80}):\s*(.*)$"
FORMATTED = r"^(\S+)\s+\[(\d+:\d+(?::\d+)?)\s*[–-]\s*(\d+:\d+(?::\d+)?)\]:\s*(.*)$"
INTERVAL = r"^\[([\d.]+),\s*([\d.]+)\]\s+(\S+)\s+\S+\s+(.*)$"


def path_column() -> Column:
    return F.col("_metadata.file_path")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def list_audio(spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """path, stem, size_mb of audio files; only names and lengths are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length")
    return rows.where(extension(F.col("path")).isin(extensions or AUDIO)).select("path", stem(F.col("path")).alias("stem"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), "length")


def validate(paths: DataFrame, allowed: list[str]) -> DataFrame:
    """Raises on a path whose extension isn't allowed."""
    return paths.withColumn("path", F.when(extension(F.col("path")).isin(allowed), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), F.col("path")))))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(path_column().alias("path"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"))


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id, speaker_id, start, end of SPEAKER lines with at least eight fields."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").select(p.alias("p")).where((F.size("p") >= 8) & (F.col("p")[0] == "SPEAKER"))
    start, length = F.col("p")[3].try_cast("double"), F.col("p")[4].try_cast("double")
    return rows.select(F.col("p")[1].alias("meeting_id"), F.col("p")[7].alias("speaker_id"), start.alias("start"), (start + length).alias("end")).where("start is not null and end is not null")


def labelled_texts(spark: SparkSession, path: str, fallback: str = "SPK_01") -> DataFrame:
    """path, utt_idx, speaker_id, text: a label starts an utterance, other lines go on with it.

    A file without any label is one utterance of ``fallback``.  Files are read whole, so lines keep their order.
    """
    files = spark.read.text(path, wholetext=True).select(path_column().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    rows = files.select("path", F.posexplode("lines").alias("n", "line"))
    w = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumn("label", F.col("line").rlike(LABEL)).withColumn("utt", F.sum(F.col("label").cast("int")).over(w))
    said = F.when(F.col("label"), F.regexp_extract("line", LABEL, 2)).otherwise(F.trim("line"))
    rows = rows.withColumns({"who": F.when(F.col("label"), F.trim(F.regexp_extract("line", LABEL, 1))), "said": said, "labels": F.max("utt").over(Window.partitionBy("path"))})
    rows = rows.where("utt > 0 or labels = 0")
    out = rows.groupBy("path", "utt").agg(F.max("who").alias("who"), F.transform(F.filter(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda r: r["said"] != ""), lambda r: r["said"]).alias("parts"))
    return out.select("path", F.greatest(F.col("utt") - 1, F.lit(0)).alias("utt_idx"), F.coalesce("who", F.lit(fallback)).alias("speaker_id"), F.array_join("parts", " ").alias("text"))


def formatted_transcript(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    g = lambda k: F.regexp_extract(v, FORMATTED, k)
    return spark.read.text(path).where(v.rlike(FORMATTED)).select(g(1).alias("speaker_id"), parse_timestamp(g(2)).alias("start"), parse_timestamp(g(3)).alias("end"), g(4).alias("text"))


def interval_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``[start,end] speaker sex text`` lines."""
    v = F.col("value")
    g = lambda k: F.regexp_extract(v, INTERVAL, k)
    return spark.read.text(path).where(v.rlike(INTERVAL)).select(stem(path_column()).alias("meeting_id"), g(1).cast("double").alias("start"), g(2).cast("double").alias("end"), g(3).alias("speaker_id"), g(4).alias("text"))


def tab_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``[start,end]<tab>speaker<tab>info<tab>text`` lines; lines that don't parse are left out."""
    p = F.split("value", "\t", 4)
    t = F.split(F.regexp_replace(p[0], r"[\[\]]", ""), ",")
    return spark.read.text(path).where(F.size(p) == 4).select(stem(path_column()).alias("meeting_id"), F.get(t, F.lit(0)).try_cast("double").alias("start"), F.get(t, F.lit(1)).try_cast("double").alias("end"), p[1].alias("speaker_id"), F.trim(p[3]).alias("text")).where("start is not null and end is not null and text <> ''")


def first_given(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there and neither null nor empty."""
    given = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*given) if given else F.lit(None).cast("string")


def manifest(spark: SparkSession, path: str, kind: str = "jsonl") -> DataFrame:
    """wav, start, end, duration, text, speaker from any of the manifest variants (json, jsonl, csv, tsv)."""
    if kind in ("csv", "tsv"):
        raw = spark.read.csv(path, header=True, sep="\t" if kind == "tsv" else ",", quote='"', escape='"')
    else:
        raw = spark.read.json(path, multiLine=kind == "json", mode="FAILFAST")
    d = lambda *n: first_given(raw, *n).try_cast("double")
    return raw.select(
        first_given(raw, "wav", "audio_filepath", "path", "filename", "file").alias("wav"), d("start").alias("start"), d("end").alias("end"),
        F.coalesce(d("duration"), d("end") - d("start")).alias("duration"), first_given(raw, "text", "sentence", "transcript", "transcription").alias("text"),
        first_given(raw, "speaker", "speaker_id", "client_id").alias("speaker"),
    )


def existing(rows: DataFrame, listing: DataFrame, key: str = "wav") -> tuple[DataFrame, DataFrame]:
    """Rows whose file is listed, and the rest for a warning."""
    names = listing.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("__f")).distinct()
    own = F.regexp_extract(key, r"([^/]+)$", 1) == F.col("__f")
    return rows.join(names, own, "left_semi"), rows.join(names, own, "left_anti")


def corpus_manifest(spark: SparkSession, path: str, folder: str, kind: str = "jsonl") -> tuple[DataFrame, DataFrame]:
    """A manifest's rows whose file lies in ``folder``, with the length from the file's header where no duration is given, and the rows without a file.

    Files are known by their names; headers are read only of files that a row without a duration names.
    """
    rows = manifest(spark, path, kind)
    have, missing = existing(rows, spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path"))
    name = F.regexp_extract("wav", r"([^/]+)$", 1)
    lengths = audio_info(spark, folder, have.where("duration is null").select(name.alias("name")))
    lengths = lengths.groupBy(F.regexp_extract("path", r"([^/]+)$", 1).alias("__f")).agg(F.min("duration").alias("__d"))
    out = have.join(lengths, name == F.col("__f"), "left").withColumn("duration", F.coalesce("duration", "__d"))
    return out.drop("__f", "__d"), missing


def predictions(spark: SparkSession, path: str, bad_lines: str = "raise") -> DataFrame:
    """wav, start, end, ref, hyp, speaker, pred_spk, epoch; ``bad_lines`` is raise or drop."""
    schema = "wav string, start double, end double, ref string, hyp string, speaker string, pred_spk string, epoch int"
    return spark.read.schema(schema).json(path, mode="FAILFAST" if bad_lines == "raise" else "DROPMALFORMED")


def speaker_map(spark: SparkSession, text: str) -> DataFrame:
    """label, name of a JSON or ``label: name`` mapping; anything else raises."""
    try:
        got = json.loads(text)
    except ValueError:
        got = {k.strip().strip("'\""): v.strip().strip("'\"") for k, c, v in (x.partition(":") for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")) if c}
    if not isinstance(got, dict) or not got:
        raise ValueError("a speaker map is a mapping of labels to names")
    return spark.createDataFrame([(str(k), str(v)) for k, v in got.items()], "label string, name string")


def words_xml(spark: SparkSession, path: str) -> DataFrame:
    """meeting_id, speaker_id, word, start, end of ``w`` elements; ids from names like ``MEET.A.words.xml``."""
    schema = "_VALUE string, _starttime double, _endtime double, _start double, _end double, _punc string"
    rows = spark.read.format("xml").option("rowTag", "w").schema(schema).load(path)
    name = F.regexp_extract(path_column(), r"([^/]+)$", 1)
    return rows.select(
        F.split_part(name, F.lit("."), F.lit(1)).alias("meeting_id"), F.split_part(name, F.lit("."), F.lit(2)).alias("speaker_id"), F.trim("_VALUE").alias("word"),
        F.coalesce("_starttime", "_start").alias("start"), F.coalesce("_endtime", "_end").alias("end"),
    ).where("word <> '' and start is not null")


def segments_xml(spark: SparkSession, path: str) -> DataFrame:
    schema = "_transcriber_start double, _transcriber_end double, _starttime double, _endtime double, _start double, _end double"
    rows = spark.read.format("xml").option("rowTag", "segment").schema(schema).load(path)
    name = F.regexp_extract(path_column(), r"([^/]+)$", 1)
    return rows.select(
        F.split_part(name, F.lit("."), F.lit(1)).alias("meeting_id"), F.split_part(name, F.lit("."), F.lit(2)).alias("speaker_id"),
        F.coalesce("_transcriber_start", "_starttime", "_start").alias("start"), F.coalesce("_transcriber_end", "_endtime", "_end").alias("end"),
    ).where("start is not null and end is not null")


def audio_info(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """path, duration, sample_rate, channels, samples of wave files (of the file names given); null where a header doesn't parse."""
    def run(batches):
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    with wave.open(io.BytesIO(content)) as f:
                        out.append((path, f.getnframes() / f.getframerate(), f.getframerate(), f.getnchannels(), f.getnframes()))
                except Exception:
                    out.append((path, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "duration", "sample_rate", "channels", "samples"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(names is not None).lower()).load(folder).select("path", "content")
    if names is not None:
        files = files.join(names.distinct(), F.regexp_extract("path", r"([^/]+)$", 1) == F.col("name"), "left_semi")
    return files.mapInPandas(run, "path string, duration double, sample_rate int, channels int, samples long")


def audio_samples(spark: SparkSession, folder: str, chunk: int = 16_000) -> DataFrame:
    """audio_id, sample_rate, chunk_idx, samples (mono, -1..1): never one array for an hour-long file."""
    import numpy as np

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                with wave.open(io.BytesIO(content)) as f:
                    width, n, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
                    k = 0
                    while raw := f.readframes(chunk):
                        x = np.frombuffer(raw, {1: np.uint8, 2: np.int16, 4: np.int32}[width]).astype(np.float32)
                        x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
                        yield pd.DataFrame({"audio_id": [path], "sample_rate": [rate], "chunk_idx": [k], "samples": [x.reshape(-1, n).mean(1)]})
                        k += 1

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInPandas(run, "audio_id string, sample_rate int, chunk_idx long, samples array<float>")


def settings(text: str) -> dict:
    """Nested settings of a JSON object, or of ``key: value`` lines nested by indentation; comments go, numbers and truth values are read."""
    try:
        got = json.loads(text)
        if isinstance(got, dict):
            return got
    except ValueError:
        pass
    out: dict = {}
    levels: list[tuple[int, dict]] = [(-1, out)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#") or ":" not in line:
            continue
        depth = len(line) - len(line.lstrip())
        name, _, value = line.strip().partition(":")
        while levels[-1][0] >= depth:
            levels.pop()
        if value.strip():
            levels[-1][1][name] = _scalar(value.strip())
        else:
            levels[-1][1][name] = {}
            levels.append((depth, levels[-1][1][name]))
    return out


def _scalar(text: str):
    plain = {"true": True, "false": False, "null": None, "~": None}
    if text.lower() in plain:
        return plain[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text.strip("'\"")


def archived(spark: SparkSession, path: str, wanted: str = ".*") -> DataFrame:
    """archive, name (letters that file names can't have become low lines), content of the members of zip files whose name matches."""
    import re
    import zipfile

    def run(batches):
        for b in batches:
            for archive, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.infolist():
                        if not member.is_dir() and re.search(wanted, member.filename):
                            yield pd.DataFrame({"archive": [archive], "name": ["/".join(re.sub(r'[<>:"\\|?*]', "_", part) for part in member.filename.split("/") if part not in ("", ".", ".."))], "content": [z.read(member)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, content binary")


def results_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def cached_results(spark: SparkSession, path: str) -> DataFrame:
    """path, seg_idx and the fields of each transcript segment of stored result objects."""
    return spark.read.json(path, multiLine=True).select(path_column().alias("path"), F.posexplode("transcript").alias("seg_idx", "s")).select("path", "seg_idx", "s.*")


def cached_vectors(spark: SparkSession, path: str, windows: DataFrame, make, keys: list[str] | None = None) -> DataFrame:
    """All columns of ``windows`` and what ``make`` adds to them, made only for windows that no run has stored at ``path`` yet.

    A window is known by the hash of its ``keys`` (by default all its columns: audio, start, end, content), never by its
    place or by how many there are.  What a run makes appears in one rename, so a run that fails leaves nothing behind;
    if two runs make the same window, one of the results counts.
    """
    keys = keys or windows.columns
    asked = windows.withColumn("window_hash", F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256))
    found = _stored_vectors(spark, path)
    missing = asked if found is None else asked.join(found.select("window_hash"), "window_hash", "left_anti")
    missing = missing.dropDuplicates(["window_hash"])
    if not missing.isEmpty():
        new, done = f"{path}/_new-{uuid.uuid4().hex}", f"{path}/added-{uuid.uuid4().hex}"
        make(missing).write.parquet(new)
        name = spark._jvm.org.apache.hadoop.fs.Path
        if not name(path).getFileSystem(spark._jsc.hadoopConfiguration()).rename(name(new), name(done)):
            raise OSError(f"{new} could not be renamed to {done}")
        found = _stored_vectors(spark, path)
    if found is None:
        return make(missing).drop("window_hash")
    more = found.select("window_hash", *[c for c in found.columns if c not in asked.columns]).dropDuplicates(["window_hash"])
    return asked.join(more, "window_hash").drop("window_hash")


def _stored_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/added-*")
    except AnalysisException:
        return None


def recordings(listing: DataFrame, meetings: list[str] | None = None) -> DataFrame:
    """meeting and array of names like ``MEET.Array1-01``, of the wanted meetings, each file once, by meeting and array."""
    rows = listing.withColumns({"meeting": F.split_part("stem", F.lit("."), F.lit(1)), "array": F.when(F.col("stem").contains("."), F.regexp_extract("stem", r"\.(.*)$", 1)).otherwise("")})
    rows = rows if meetings is None else rows.where(F.col("meeting").isin(meetings))
    return rows.dropDuplicates(["path"]).orderBy("meeting", "array")


def first_recording(conversations: DataFrame, listing: DataFrame, key: str = "conv_id", prefix: int = 4) -> DataFrame:
    """Each conversation with the first listed file (by path) whose stem begins with its id; the join's key is a prefix of both."""
    c = conversations.withColumn("__k", F.substring(F.col(key).cast("string"), 1, prefix))
    f = listing.select(F.col("stem").alias("__s"), F.col("path").alias("__p"))
    by_length = f.withColumn("__k", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(prefix)), lambda n: F.substring("__s", F.lit(1), n)))))
    hit = c.join(by_length, "__k").where(F.startswith("__s", F.col(key).cast("string"))).groupBy(key).agg(F.min("__p").alias("wav"))
    return conversations.join(hit, key, "left")


def with_annotation(rows: DataFrame, listing: DataFrame, suffix: str = "_vibevoice", given: str = "rttm") -> DataFrame:
    """The annotation given, else the listed one named ``<stem><suffix>``."""
    found = listing.select(F.regexp_replace("stem", f"{suffix}$", "").alias("stem"), F.col("path").alias("__r")).where(F.col("__r").contains(suffix))
    return rows.join(found, "stem", "left").withColumn(given, F.coalesce(given, "__r")).drop("__r")
