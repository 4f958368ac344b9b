"""Every operator over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, html, langid, licenses, lmscore, mixing, nearest, neardup, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, id string, kept int, component_id string"
LABELS = "doc_id long, quality int, toxic int, text string"


def documents(spark, empty=False):
    long = "the cat sat on a mat and " * 20_000
    rows = [
        (1, "you are an idiot and a moron", "en"), (2, "the cat sat on the mat today", "en"), (2, "the cat sat on the mat today", "en"), (3, None, None),
        (4, "", "en"), (5, long, "en"), (6, "le chat dort sur la table", "fr"), (None, "a row without an id", None), (7, "a", None), (8, "!!! ???", "xx"),
        (9, "Released under the MIT License.", "en"), (10, "one line \x00 odd ퟿", None),
    ]
    return spark.createDataFrame([] if empty else [(i, t, la, None if k % 3 else "s", None, 1.0, "k", "x", 1, "c") for k, (i, t, la) in enumerate(rows)], DOCS)


def labels(spark, empty=False):
    return spark.createDataFrame([] if empty else [(i, i % 2, int(i == 1), "t") for i in range(12)] + [(None, 1, 1, "t"), (2, None, None, "t")], LABELS)


def benchmark(spark, empty=False):
    return spark.createDataFrame([] if empty else [(1, "the cat sat on the mat today"), (2, None), (3, ""), (None, "x"), (4, "!!")], "item_id long, text string")


RUNS = {
    "mixing": lambda s, d, la, b: mixing.mix(d),
    "toxicity": lambda s, d, la, b: toxicity.classify(d, la),
    "decontaminate": lambda s, d, la, b: decontaminate.leaks(d, b),
    "licenses": lambda s, d, la, b: licenses.scan(d),
    "quality": lambda s, d, la, b: quality.grade(d, la),
    "lmscore": lambda s, d, la, b: lmscore.score(d, la),
    "neardup": lambda s, d, la, b: neardup.classes(d, 3, 85),
    "langid": lambda s, d, la, b: langid.identify(d, langid.fit(d)),
}
FEWER = {"decontaminate"}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, name):
    d = documents(spark)
    out = RUNS[name](spark, d, labels(spark), benchmark(spark)).collect()
    if name not in FEWER:
        assert len(out) == d.count()
        twice = [tuple(r) for r in out if r["doc_id"] == 2]
        assert len(twice) == 2 and twice[0] == twice[1]
    else:
        assert [(r["doc_id"], r["item_id"]) for r in out] == [(2, 1), (2, 1)]


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, name):
    assert RUNS[name](spark, documents(spark, True), labels(spark, True), benchmark(spark, True)).collect() == []
    without = RUNS[name](spark, documents(spark), labels(spark, True), benchmark(spark, True)).collect()
    assert len(without) == (0 if name in FEWER else documents(spark).count())


STAGES = {
    "toxicity": lambda d, la, b: toxicity.keep_ordinary(d, la),
    "quality": lambda d, la, b: quality.keep_good(d, la),
    "neardup": lambda d, la, b: neardup.keep_one(d),
    "decontaminate": lambda d, la, b: decontaminate.keep_clean(d, b),
    "mixing": lambda d, la, b: mixing.sample(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    d = documents(spark)
    out = STAGES[name](d, labels(spark), benchmark(spark))
    assert out.columns == d.columns and out.dtypes == d.dtypes
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in d.collect()}
    e = STAGES[name](documents(spark, True), labels(spark, True), benchmark(spark, True))
    assert e.columns == d.columns and e.collect() == []


CLASHES = "row struct<row:int>, id string, tokens int, source_ string, topic string, weight double, probability double, kept boolean, draw int, place int, toxicity double, tail int, __source string, __tokens int, __lang string, __topic string, __weight double, __p double, __kept boolean, __id string, __grade double, __tail double, __toxicity double, of_lang double, level string, factor double, b int, c int"


@pytest.mark.parametrize("name", [*STAGES, "pipeline"])
def test_stages_carry_clashing_columns(spark, name):
    """Columns with the names that an operator could want for itself come out as they went in."""
    import corpus_pipeline

    d = documents(spark).drop("id", "kept")
    own = spark.createDataFrame([], CLASHES).schema
    for f in own:
        value = F.struct(F.lit(5).alias("row")) if f.name == "row" else F.lit(f.name) if f.dataType.simpleString() == "string" else F.lit(1)
        d = d.withColumn(f.name, value.cast(f.dataType))
    if name == "pipeline":
        out = d
        for run in (STAGES[n] for n in ("toxicity", "quality", "neardup", "decontaminate", "mixing")):
            out = run(out, labels(spark), benchmark(spark))
        assert len(corpus_pipeline.STAGES) == 5
    else:
        out = STAGES[name](d, labels(spark), benchmark(spark))
    assert out.columns == d.columns and out.dtypes == d.dtypes
    rows, all_rows = (sorted(map(str, x.collect())) for x in (out, d))
    assert rows and set(rows) <= set(all_rows)


def test_defined_results(spark):
    d = documents(spark)
    lic = {(r["doc_id"], r["n_words"], r["base_labels"], r["first_word"]) for r in licenses.scan(d).collect()}
    assert (9, 5, "mit", 3) in lic and (3, 0, "", None) in lic and (8, 0, "", None) in lic
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(d, 3, 85).collect()}
    assert near[3] == (0, 3, True) and near[4] == (0, 4, True) and near[7] == (1, 7, True) and near[None][1] is None and near[None][2]
    lang = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d, langid.fit(d)).collect()}
    assert lang[3] == lang[4] == lang[8] == ("und", 0.0)
    lm = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in lmscore.score(d, labels(spark)).collect()}
    assert lm[3] == lm[4] == (0, 0.0)
    kept = neardup.keep_one(d).where("doc_id = 2").count()
    assert kept == 1


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (9, []), (20, [0.0, 1.0]), (1, [0.5, 0.5])]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nearest.nearest(d).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 0, 0.0)]
    assert nearest.nearest(d.limit(0)).collect() == []


def test_pages(spark):
    d = spark.createDataFrame([(1, None, None, "t"), (2, "http://a/x", "", "t"), (3, "http://a/y", "<p>one", "t"), (3, "http://a/y", "<p>one", "t"), (None, "http://a/z", "plain <b>text", "t")], "page_id long, url string, html string, text string")
    out = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html.extract(d).collect())
    assert out == [(0, "plain text", 10), (1, "", 0), (2, "", 0), (3, "one", 3), (3, "one", 3)]
    assert html.extract(d.limit(0)).collect() == []
