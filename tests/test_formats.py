import io
import zipfile

import pytest
from pyspark.sql import functions as F

from colloquy.sources import formats, readers
from colloquy.sources.sinks import documents


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    formats.register(spark)


def spoken(spark, n=5_000):
    i = F.col("id")
    return spark.range(n).select(F.concat(F.lit("m"), i % 3).alias("meeting_id"), F.concat(F.lit("s"), i % 7).alias("speaker_id"), (i * 0.5).alias("start"), (i * 0.5 + 0.25).alias("end"))


def test_rttm_there_and_back_in_small_splits(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spoken(spark)
    rows.repartition(3).write.format("rttm").mode("append").save(path)
    assert not [p for p in (tmp_path / "r").iterdir() if p.name.startswith("_")]
    want = sorted(map(tuple, rows.collect()))
    for split in (97, 1_000, 1 << 26):
        back = spark.read.format("rttm").option("splitBytes", split).load(path)
        assert sorted(map(tuple, back.collect())) == want
    assert sorted(map(tuple, readers.rttm(spark, path).collect())) == want
    # a second writing adds, one that overwrites replaces
    rows.limit(10).write.format("rttm").mode("append").save(path)
    assert spark.read.format("rttm").load(path).count() == len(want) + 10
    rows.limit(10).write.format("rttm").mode("overwrite").save(path)
    assert spark.read.format("rttm").load(path).count() == 10


def test_a_meeting_is_picked_while_reading(spark, tmp_path):
    path = str(tmp_path / "r")
    spoken(spark).write.format("rttm").mode("append").save(path)
    (tmp_path / "r" / "odd.rttm").write_bytes(b"\n# note\nSPEAKER m1 1 x 2 a b c\nSPEAKER m1 1\nSPEAKER m1 1 1.0 2.0 <NA> <NA> last")
    one = spark.read.format("rttm").load(path).where("meeting_id = 'm1'")
    assert one.count() == 1_667 + 1 and one.where("speaker_id = 'last' and end = 3.0").count() == 1
    # the equality is the reader's: Spark's own filter has no more than the test for null
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(meeting_id" in plan and "= m1" not in plan


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = tmp_path / "r"
    bad = spoken(spark, 100).withColumn("end", F.when(F.col("start") == 20.0, F.raise_error(F.lit("lost"))).otherwise(F.col("end")))
    with pytest.raises(Exception, match="lost"):
        bad.repartition(4, "start").write.format("rttm").mode("append").save(str(path))
    assert not path.exists() or not list(path.rglob("*"))


def test_files_of_documents(spark, tmp_path):
    path = tmp_path / "d"
    paragraphs = spark.createDataFrame([(m, 0, k, f"line {k} of {m}") for m in ("a", "b") for k in range(3)], "meeting_id string, section int, para long, text string")
    made = documents(paragraphs).select(F.concat("meeting_id", F.lit("/notes.docx")).alias("name"), "content")
    made.write.format("files").mode("append").save(str(path))
    assert sorted(p.relative_to(path).as_posix() for p in path.rglob("*") if p.is_file()) == ["a/notes.docx", "b/notes.docx"]
    with zipfile.ZipFile(io.BytesIO((path / "b" / "notes.docx").read_bytes())) as z:
        assert "line 2 of b" in z.read("word/document.xml").decode()
    # two rows of one name, and names that lead out of the folder, write nothing
    for names in (["x", "x"], ["../x", "y"]):
        with pytest.raises(Exception, match="file name"):
            spark.createDataFrame([(n, "t") for n in names], "name string, content string").write.format("files").mode("append").save(str(tmp_path / "e"))
        assert not (tmp_path / "e").exists() or not [p for p in (tmp_path / "e").rglob("*") if p.is_file()]
