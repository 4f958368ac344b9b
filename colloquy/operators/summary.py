"""Summaries: sentences, keywords, decisions, action items, de-duplication, overviews."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import materialize

# Words that are never a topic.
STOPWORDS = [
    "yang", "dan", "di", "ke", "dari", "ini", "itu", "dengan", "untuk", "pada", "adalah", "dalam", "tidak", "akan",
    "sudah", "juga", "saya", "kita", "kami", "mereka", "ada", "bisa", "atau", "seperti", "jadi", "kalau", "karena",
    "tapi", "ya", "apa", "bagaimana", "kenapa", "siapa", "kapan", "dimana", "nya", "kan", "dong", "sih", "kok", "deh",
    "loh", "lah",
]


def sentence_rows(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.sentences(F.col(text))).alias("sent_idx", "sentence"))


def keywords(docs: DataFrame, key: str, k: int = 5, stopwords: list[str] | None = None, pattern: str = r"\b[a-zA-Z]{4,}\b", text: str = "text") -> DataFrame:
    """The k most frequent words of each document; ties by first appearance.

    A row's words are counted in place, so only keys are shuffled, to find those of several rows; of these the words
    are counted together.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), 0)
    stop = stopwords or STOPWORDS
    several = docs.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__k")
    kind = dict(docs.select(key).dtypes)[key]
    schema = f"{key} {kind}, rank int, word string, n long"
    if not several.head(1):
        return docs.select(key, w.alias("w")).mapInArrow(_top_words(key, k, stop), schema)
    same = F.col(key).eqNullSafe(F.col("__k"))
    out = docs.join(several.hint("merge"), same, "left_anti").select(key, w.alias("w")).mapInArrow(_top_words(key, k, stop), schema)
    rows = docs.join(several.hint("merge"), same, "left_semi").select(key, F.posexplode(w).alias("pos", "word")).where(~F.col("word").isin(stop))
    counted = rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return out.unionByName(counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "word", "n"))


def _top_words(key: str, k: int, stop: list[str]):
    """Of rows (key, words): key, rank, word and n of the k most frequent words of each row, of equals the first."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words, row = part.column(1).flatten(), pc.list_parent_indices(part.column(1)).to_numpy()
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                kept = np.flatnonzero(~pc.is_in(names, pa.array(stop, names.type)).to_numpy(zero_copy_only=False)[code])
                pair, first, n = np.unique(row[kept].astype(np.int64) * len(names) + code[kept], return_index=True, return_counts=True)
                own = pair // len(names)
                # pairs by row, count and first place; then the place of each within its row
                order = np.lexsort((first, -n, own))
                own, pair, n = own[order], pair[order], n[order]
                rank = np.arange(len(own)) - np.searchsorted(own, own, "left") + 1
                best = np.flatnonzero(rank <= k)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own[best])), pa.array(rank[best], pa.int32()), names.take(pa.array(pair[best] % len(names))), pa.array(n[best], pa.int64())], names=[key, "rank", "word", "n"])

    return run


def meeting_sentences(segments: DataFrame, meeting: str = "meeting_id") -> DataFrame:
    """meeting, sent_idx, sentence, speaker_id, start: the sentences of each meeting's turns in order."""
    from .segments import speaker_turns

    turns = speaker_turns(segments, meeting)
    rows = turns.select(meeting, "turn_idx", "speaker_id", "start", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("sent_idx", (F.row_number().over(Window.partitionBy(meeting).orderBy("turn_idx", "pos")) - 1).cast("int")).drop("turn_idx", "pos")


def decisions(sentences: DataFrame, key: str, k: int = 7) -> DataFrame:
    """Sentences with a decision's word, then the clauses behind ordinals and numbers, near-repeats dropped, at most k."""
    s = F.col("sentence")
    made = lambda phase, pos, text: F.struct(F.lit(phase).alias("phase"), F.col("sent_idx"), pos.cast("int").alias("pos"), text.alias("s"))
    own = F.when(T.contains_any(s, T.DECISION_WORDS), F.array(made(0, F.lit(0), T.squeeze(s))))
    clauses = F.transform(T.enumerated(F.trim(s)), lambda c, i: made(1, i, c))
    rows = sentences.select(key, F.explode(F.when(own.isNull(), clauses).otherwise(F.concat(own, clauses))).alias("r"))
    packed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["s"]).alias("all"))
    return packed.select(key, F.slice(T.keep_distinct(F.array_distinct("all")), 1, k).alias("decisions"))


def context_decisions(sentences: DataFrame, key: str, most_words: int = 35) -> DataFrame:
    """Decision sentences (by word, or by an ordinal at the start) with a sentence on either side, without marks, at most 35 words; like ones once."""
    w = Window.partitionBy(key).orderBy("sent_idx")
    around = F.array_join(F.collect_list("sentence").over(w.rowsBetween(-1, 1)), " ")
    text = T.squeeze(F.regexp_replace(around, r"\[.*?\]", ""))
    cut = F.regexp_replace(F.array_join(F.slice(T.words(text), 1, most_words), " "), r"[ ,.;:]+$", "")
    rows = sentences.withColumn("text", cut).where(T.is_decision(T.squeeze(F.col("sentence"))) & (F.size(T.words(F.col("text"))) >= 3))
    packed = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "text"))), lambda r: r["text"]).alias("all"))
    return packed.select(key, T.distinct_by_words(F.array_distinct("all")).alias("decisions"))


def settled_decisions(decisions: DataFrame, keys: DataFrame, key: str, model: str | None = "default") -> DataFrame:
    """key, decisions: those found; in a meeting without any, its key sentences that hold a decision word; like ones (``semantic_distinct``) once.

    What one meeting decides is its group, so this takes decisions, never a meeting's sentences.
    """
    found = decisions.where(F.size("decisions") > 0).select(key, F.posexplode("decisions").alias("place", "text"))
    told = keys.where(T.contains_any(F.col("sentence"), T.DECISION_WORDS)).join(found.select(key).distinct(), key, "left_anti")
    items = found.select(key, F.col("place").cast("long").alias("place"), "text").unionByName(told.select(key, F.col("sent_idx").cast("long").alias("place"), F.col("sentence").alias("text")))
    once = items.groupBy(key, "text").agg(F.min("place").alias("place"))
    kept = semantic_distinct(once, key, "place", "text", model=model)
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda r: r["text"]).alias("decisions"))


def key_points(keys: DataFrame, key: str) -> DataFrame:
    """The chosen sentences in order, each as ``sentence (oleh speaker)``, repeats collapsed."""
    point = F.concat(T.squeeze(T.collapsed(F.col("sentence"))), F.lit(" (oleh "), F.col("speaker_id"), F.lit(")"))
    packed = keys.withColumn("point", point).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sent_idx", "point"))).alias("p"))
    return packed.select(key, F.transform("p", lambda r: r["point"]).alias("key_points"))


def _kept_actions(rows: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The first of each task's first 120 letters; no chatter, actionable, three words or more, no lone filler; distinct by normal form; at most k."""
    task = F.col("task")
    first = lambda by: Window.partitionBy(key, by).orderBy(*order)
    rows = rows.withColumn("seen", F.substring(F.lower(task), 1, 120)).withColumn("n", F.row_number().over(first("seen"))).where("n = 1")
    rows = rows.where(~T.is_chatter(task) & T.is_actionable(task) & (F.size(T.words(task)) >= 3) & ~F.lower(task).isin(T.SINGLE_FILLERS))
    rows = rows.withColumn("norm", F.substring(T.normalize_dedup(task), 1, 200)).withColumn("n", F.row_number().over(first("norm"))).where("n = 1")
    return rows.withColumn("item", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("item") <= k)


def action_items(sentences: DataFrame, key: str, k: int = 15) -> DataFrame:
    """Actionable sentences: owner by name (else TBD), task and due."""
    s = F.col("sentence")
    rows = sentences.where(T.is_actionable(s)).select(key, "sent_idx", F.coalesce(T.owner(s), F.lit("TBD")).alias("owner"), T.squeeze(s).alias("task"))
    return _kept_actions(rows, key, ["sent_idx"], k).select(key, "item", "owner", "task", T.due(F.col("task")).alias("due"))


def segment_actions(segments: DataFrame, meeting: str = "meeting_id", k: int = 15) -> DataFrame:
    """meeting, item, owner, task, timestamp, due: candidates by patterns from sentences first, then commitments and actionable segments."""
    sentences = meeting_sentences(segments, meeting)
    found = regex_actions(sentences, meeting).join(sentences.select(meeting, "sent_idx", "start"), [meeting, "sent_idx"])
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), T.MARKS, ""))
    said = segments.withColumn("text", text).where("text <> ''")
    c = F.col("text")
    committed = F.lower(c).rlike(T.COMMITTED)
    clause = F.regexp_replace(F.regexp_replace(c, T.BEFORE_SEGMENT_CLAUSE, ""), r"^[ .,:;-]+|[ .,:;-]+$", "")
    kept = said.where(committed | T.contains_any(c, T.ACTION_WORDS) & T.is_actionable(c))
    who = F.coalesce(T.owner(c), F.col("speaker_id"))
    own = kept.select(meeting, F.lit(1).alias("phase"), F.col("seg_idx").cast("long").alias("place"), who.alias("owner"), F.when(committed & (clause != ""), clause).otherwise(c).alias("task"), "start")
    every = found.select(meeting, F.lit(0).alias("phase"), F.col("sent_idx").cast("long").alias("place"), F.coalesce("owner", F.lit("TBD")).alias("owner"), F.trim("task").alias("task"), "start").unionByName(own)
    out = _kept_actions(every, meeting, ["phase", "place"], k)
    return out.select(meeting, "item", "owner", "task", F.format_string("%.1fs", F.col("start").cast("double")).alias("timestamp"), T.due(F.col("task")).alias("due"))


def sentence_actions(sentences: DataFrame, key: str, k: int = 15) -> DataFrame:
    """key, item, owner, task, timestamp: clauses of committed sentences, whole actionable ones; the speaker owns them."""
    s = F.trim(F.regexp_replace(F.col("sentence"), T.MARKS, ""))
    committed = s.rlike(T.COMMITTED)
    whole = T.squeeze(F.regexp_replace(s, T.LEADING_PRONOUN, ""))
    rows = sentences.where((s != "") & (committed | T.contains_any(s, T.ACTION_WORDS) & T.is_actionable(s)))
    rows = rows.withColumn("task", F.when(committed, T.action_clause(s)).otherwise(F.regexp_replace(whole, r"^[ .,:;-]+|[ .,:;-]+$", "")))
    rows = rows.where((F.size(T.words(F.col("task"))) >= 3) & ~F.lower("task").isin(T.SINGLE_FILLERS))
    first = Window.partitionBy(key, F.substring(F.lower("task"), 1, 120)).orderBy("sent_idx")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("item", F.row_number().over(Window.partitionBy(key).orderBy("sent_idx"))).where(F.col("item") <= k)
    return rows.select(key, "item", F.coalesce("speaker_id", F.lit("TBD")).alias("owner"), "task", F.format_string("%.1fs", F.col("start").cast("double")).alias("timestamp"))


def merge_actions(items: DataFrame, key: str) -> DataFrame:
    """Items of equal normal task become one: owners in order, first time, sorted dues."""
    rows = items.withColumn("norm", T.normalize_dedup(F.col("task")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("item", c))), lambda r: r[c])
    return rows.groupBy(key, "norm").agg(
        F.min_by("task", "item").alias("task"), F.array_join(F.array_distinct(ordered("owner")), " / ").alias("owner"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("due", F.lit("")))), ", ").alias("due"), F.min("item").alias("item"),
    ).drop("norm")


def key_sentences(sentences: DataFrame, score: Column, key: str, k: int) -> DataFrame:
    """The k best sentences of each document (rank); with k or fewer all are kept."""
    w = Window.partitionBy(key).orderBy(score.desc_nulls_last(), "sent_idx")
    return sentences.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def heuristic_score(position: Column, total: Column, sentence: Column, similarity: Column | None = None) -> Column:
    """Similarity .75, place .15 (high at both ends), length .10 (best at 20 words), and up to .3 for marked words."""
    place = F.when(total > 1, 1.0 - 0.6 * F.sin(F.pi() * position / (total - 1))).otherwise(1.0)
    length = 1.0 - F.least(F.abs(F.size(T.words(sentence)) - 20) / 30.0, F.lit(1.0))
    low, marks = F.lower(sentence), F.lit(0.0)
    for w in T.DECISION_WORDS + T.ACTION_WORDS:
        marks = marks + F.when(low.contains(w), 0.1).otherwise(0.0)
    return 0.75 * (F.lit(0.0) if similarity is None else similarity) + 0.15 * place + 0.10 * length + F.least(marks, F.lit(0.3))


def overview(keys: DataFrame, key: str, k: int = 3, empty: str = "Tidak ada ringkasan yang dapat dibuat.") -> DataFrame:
    """The first k chosen sentences in the order of the document, as one text."""
    packed = keys.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence"))), lambda r: T.squeeze(r["sentence"])).alias("s"))
    text = T.squeeze(F.array_join(F.slice("s", 1, k), " "))
    return packed.select(key, F.when(text == "", empty).otherwise(text).alias("overview"))


def document_similarity(sentences: DataFrame, key: str, model: str = "default") -> DataFrame:
    """Adds ``similarity``: the cosine of each sentence's vector with the mean vector of its document."""
    from ..functions import vector as V
    from ..models import get

    v = sentences.withColumn("__v", get("sentence_embedding", model)(F.col("sentence")))
    mean = v.select(key, F.posexplode("__v").alias("p", "x")).groupBy(key, "p").agg(F.avg("x").alias("x")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"))
    joined = v.join(mean.select(F.col(key).alias("__k"), F.transform("c", lambda r: r["x"]).alias("__c")), F.col(key) == F.col("__k"))
    return joined.withColumn("similarity", V.cosine(F.col("__v"), F.col("__c"))).drop("__v", "__c", "__k")


def exact_dedup(rows: DataFrame, norm: Column, order: list[str]) -> DataFrame:
    """The first row of each normal form."""
    w = Window.partitionBy("__norm").orderBy(*order)
    return rows.withColumn("__norm", norm).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__norm", "__n")


def greedy_distinct(items: DataFrame, key: str, order: str, text: str, threshold: float = 0.5, norm=T.normalize_dedup) -> DataFrame:
    """The rows that a pass in order keeps: an item goes if its words' Jaccard with a kept one of its key reaches ``threshold``, or if it has no words.

    No group holds all items of a key.  Equal word sets are one item, as only the first of them can stay.  Like
    sets are found by a prefix filter: sorted by how rare their words are, two sets that reach the threshold share
    one of their first ``size - ceil(threshold * size) + 1`` words, so only these are joined on, in narrow rows without
    the sets; sizes, and how many words can be shared from there on, are compared before words.  The pass itself is
    the lexicographically first independent set: in each round the items
    without an undecided like item before them stay, and what is like them goes; at least the first undecided item of
    a key is settled in a round, usually almost all.  All joins merge sorted sides: none is sent through the driver,
    however few bytes its shuffle takes.
    """
    words = F.array_sort(F.array_distinct(T.words(norm(F.col(text)))))
    sets = materialize(items.groupBy(F.col(key).alias("k"), words.alias("w")).agg(F.min(order).alias("o"))).where(F.size("w") > 0)
    said = sets.select("k", "o", F.explode("w").alias("x"))
    rarity = said.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = said.join(rarity.hint("merge"), "x").groupBy("k", "o").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("r"))
    size = F.size("r")
    first = F.slice("r", F.lit(1), (size - F.ceil(F.lit(threshold) * size - F.lit(1e-9)) + 1).cast("int"))
    keyed = ranked.select("k", "o", size.alias("n"), F.posexplode(F.transform(first, lambda r: r["x"])).alias("p", "x"))
    a, b = (keyed.select("k", "x", *[F.col(c).alias(c + end) for c in "onp"]) for end in "ab")
    sizes = F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - F.lit(1e-9)
    # of two like sets, the first word that they share leaves enough words behind it on either side
    ahead = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - F.lit(1e-6)
    near = a.join(b.hint("merge"), ["k", "x"]).where((F.col("oa") < F.col("ob")) & sizes & ahead).select("k", "oa", "ob").distinct()
    for end in "ab":
        near = near.join(sets.select("k", F.col("o").alias(f"o{end}"), F.col("w").alias(f"w{end}")).hint("merge"), ["k", f"o{end}"])
    links = materialize(near.where(T.jaccard(F.col("wa"), F.col("wb")) >= threshold).select("k", "oa", "ob"))
    kept, left = [], sets.select("k", "o")
    while True:
        blocked = links.select("k", F.col("ob").alias("o")).distinct()
        stay = materialize(left.join(blocked.hint("merge"), ["k", "o"], "left_anti"))
        kept.append(stay)
        if not links.head(1):
            break
        gone = materialize(links.join(stay.withColumnRenamed("o", "oa").hint("merge"), ["k", "oa"], "left_semi").select("k", F.col("ob").alias("o")).distinct())
        settled = stay.unionByName(gone)
        left = materialize(left.join(settled.hint("merge"), ["k", "o"], "left_anti"))
        for end in ("oa", "ob"):
            links = links.join(settled.withColumnRenamed("o", end).hint("merge"), ["k", end], "left_anti")
        links = materialize(links)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return items.join(out.select(F.col("k").alias("__k"), F.col("o").alias("__o")).hint("merge"), (F.col(key) == F.col("__k")) & (F.col(order) == F.col("__o")), "left_semi")


def semantic_distinct(items: DataFrame, key: str, order: str, text: str, cosine: float = 0.75, overlap: float = 0.45, model: str | None = "default") -> DataFrame:
    """The first of each group of like items, by the cosine of a model's vectors; by words where that merges nothing, or without a model.

    What is kept depends on what was kept before, so a meeting's items are a group; vectors are made before, side by side.
    """
    import numpy as np
    import pandas as pd

    from ..models import get

    rows = items.select(key, order, text, (F.lit(None).cast("array<double>") if model is None else get("sentence_embedding", model)(F.col(text))).alias("__v"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        import regex

        g = g.sort_values(order)
        said = [set(regex.findall(r"[\p{L}\p{M}\p{N}_]+", (t or "").lower())) for t in g[text]]
        kept = list(range(len(g)))
        if model is not None and len(g):
            x = np.stack(g["__v"].to_numpy()).astype(float)
            near = x @ x.T / (np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) + 1e-12)
            kept = []
            for i in range(len(g)):
                if not any(near[i, j] >= cosine for j in kept):
                    kept.append(i)
        if len(kept) == len(g):
            kept = []
            for i, own in enumerate(said):
                if not any(own and said[j] and len(own & said[j]) >= overlap * len(own | said[j]) for j in kept):
                    kept.append(i)
        return g.iloc[kept][[key, order, text]]

    kinds = dict(items.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {text} string")


def speaker_digests(segments: DataFrame, meeting: str = "meeting_id", k: int = 2) -> DataFrame:
    """The first k sentences of all that each speaker said, in order."""
    said = segments.groupBy(meeting, "speaker_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda r: r["text"]), " ").alias("said"))
    return said.select(meeting, "speaker_id", F.array_join(F.slice(T.sentences(F.col("said")), 1, k), ". ").alias("digest"))


def narrative(topics: Column, points: Column, decided: Column, actions: Column) -> Column:
    """A paragraph from arrays of topics, points, decisions and action structs (owner, task)."""
    bare = lambda a: F.transform(a, lambda x: F.regexp_replace(x, r"\.+$", ""))
    part = lambda head, body, tail: F.when(body != "", F.concat(F.lit(head), body, F.lit(tail)))
    todo = F.array_join(F.transform(actions, lambda a: F.concat(a["owner"], F.lit(" akan "), F.regexp_replace(a["task"], r"\.+$", ""), F.lit("."))), " ")
    return T.normalize_overview(F.concat_ws(
        " ", part("Topik utama yang dibahas meliputi: ", F.array_join(topics, ", "), "."), part("Beberapa poin penting termasuk: ", F.array_join(bare(F.slice(points, 1, 4)), "; "), "."),
        part("Keputusan utama yang dicapai termasuk: ", F.array_join(bare(decided), ", "), "."), part("Tindak lanjut yang disepakati di antaranya: ", todo, ""),
    ))


def regex_actions(sentences: DataFrame, key: str) -> DataFrame:
    """Action candidates by patterns: owned by the name before a verb, else by the speaker; the task is what follows, else the sentence itself."""
    s = F.col("sentence")
    name, task = (F.regexp_extract(s, T.NAME_ACTION, k) for k in (1, 3))
    phrase = F.regexp_extract(s, T.COMMIT_PHRASE, 1)
    trim = lambda c: F.regexp_replace(c, r"^[\s.,:;-]+|[\s.,:;-]+$", "")
    own = s.rlike(T.PRONOUN)
    whole = F.substring(F.trim(F.regexp_replace(s, r"(?i)^(oke|ya|nah|baik)\b[:,-]*", "")), 1, 300)
    rows = sentences.where(s.rlike(T.ACTION_GATE) | s.rlike(T.ACTION_GATE_EN)).select(
        key, "sent_idx", F.when(name != "", name).otherwise(F.col("speaker_id")).alias("owner"),
        F.when(name != "", trim(task)).when(own & (phrase != ""), trim(phrase)).otherwise(whole).alias("task"),
        F.when((name != "") | (own & (phrase != "")), 0.7).otherwise(0.5).alias("confidence"),
    )
    return rows.where(F.size(T.words(F.col("task"))) >= 3)
