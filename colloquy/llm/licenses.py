"""License scans by diagonal voting, in DataFrame operations only.

Templates are short public license notices and the base phrases.  Every pair of
neighbouring words of every text is hashed and joined to the pairs of the
templates; a hit votes for the diagonal (place in the text less place in the
template).  Votes are combined by diagonal before the shuffle, neighbouring
diagonals are merged (a word may be missing or added), and a span is verified
by the words themselves: the join compares them besides the hash, and the share
of the template's pairs found must reach ``coverage``.  A base phrase counts
where all its pairs lie on one diagonal, which is where its words stand
consecutively.

The templates are a constant of this module, so the side that is sent to every
task is bounded by it.

Defined cases: a null or empty text has no words, no places, empty labels,
null first and last word and score 0; repeated rows and rows with one id and
different texts are told apart by a hash of id and text and each returned once
for each row; a null id is a value like others; extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands between words: fixed by the contract of the query.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The opening words of public license notices, lower-cased, and labels of our own.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-notice"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("licensed under the gnu general public license version 3", "gpl-notice"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc"),
)
#: Share of a notice's word pairs that a span must hold, and how far apart merged diagonals may lie.
COVERAGE, GAP = 0.7, 2


def words_of(text: Column) -> Column:
    """The words, with an empty string before a leading and after a trailing separator."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def word_count(words: Column) -> Column:
    n = F.size(words)
    return (n - (F.get(words, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(words, n - 1) == "")).cast("int")).cast("long")


def template_pairs(spark, base=BASE, notices=NOTICES) -> DataFrame:
    """tid, label, base, place, grams (pairs of the template), u, v (its words)."""
    rows = []
    for tid, (text, label, is_base) in enumerate([(t, n, True) for t, n in base] + [(t, n, False) for t, n in notices]):
        w = text.split()
        if not 2 <= len(w) <= 60:
            raise ValueError("a template has 2 to 60 words")
        rows += [(tid, label, is_base, i, len(w) - 1, w[i], w[i + 1]) for i in range(len(w) - 1)]
    return spark.createDataFrame(rows, "tid int, label string, base boolean, place int, grams int, u string, v string")


def spans(documents: DataFrame, coverage: float = COVERAGE, gap: int = GAP, base=BASE, notices=NOTICES) -> DataFrame:
    """key, doc_id, label, base, start and end (words from 0, end inclusive), share: every verified span."""
    t = template_pairs(documents.sparkSession, base, notices).withColumn("h", F.xxhash64("u", "v"))
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", words_of(F.col("text")).alias("words"))
    placed = docs.select("key", "doc_id", "words", F.posexplode("words").alias("pos", "w"))
    after = F.get("words", F.col("pos") + 1)
    grams = placed.select("key", "doc_id", (F.col("pos") - (F.get("words", F.lit(0)) == "").cast("int")).alias("at"), "w", after.alias("x"), F.xxhash64("w", after).alias("h"))
    hits = grams.join(F.broadcast(t), "h").where("w = u and x = v")
    votes = hits.groupBy("key", "doc_id", "tid", "label", "base", "grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask")
    )
    phrase = votes.where("base").where("bit_count(mask) = grams").select("key", "doc_id", "label", "base", F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("grams")).alias("end"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("key", "doc_id", "tid").orderBy("diagonal")
    runs = (
        votes.where("not base")
        .withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"))
        .withColumn("run", F.sum(F.coalesce("new", F.lit(1))).over(order))
    )
    low = F.expr("bit_count((mask & -mask) - 1)")
    high = F.expr("length(bin(mask)) - 1")
    notice = (
        runs.groupBy("key", "doc_id", "tid", "label", "base", "grams", "run")
        .agg(F.bit_or("mask").alias("mask"), F.min(F.col("diagonal") + low).alias("start"), F.max(F.col("diagonal") + high + 1).alias("end"))
        .select("key", "doc_id", "label", "base", "start", "end", (F.bit_count("mask") / F.col("grams")).alias("share"))
        .where(F.col("share") >= coverage)
    )
    return phrase.unionByName(notice)


def scan(documents: DataFrame, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    found = (
        spans(documents, coverage, gap)
        .groupBy("key", "doc_id")
        .agg(
            F.count_if("base").alias("n_base"),
            F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("share").alias("score"),
        )
        .withColumnRenamed("key", "__key").withColumnRenamed("doc_id", "__id")
    )
    docs = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", word_count(words_of(F.col("text"))).alias("n_words"))
    out = docs.join(found, (F.col("key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
