"""LM scoring by cross-entropy difference of matched bigram models.

Target: documents whose label is good and not toxic.  Background: as many
letters' worth of the other documents, chosen by a hash of the id.  Both models
are bigram models with Dirichlet smoothing over one vocabulary, the words of
both corpora (V of them, and one unknown word):

    p(w) = (c(w) + kappa) / (N + kappa (V + 1))      p(w | v) = (c(v, w) + mu p(w)) / (c(v) + mu)

The score of a document is its loss per token under the target less that under
the background; low scores are like the target.  A document that is part of a
corpus is scored without its own counts.  Every count of both corpora takes
part, also of what was seen once; words are cut and hashed in one place
(:mod:`colloquy.llm.words`).

One way for every size, in three shuffles of packed arrays:

1. Each task packs its texts into blocks of about ``BLOCK_TOKENS`` tokens
   (distinct word hashes, and the tokens as places among them), written once.
2. A block asks for each of its distinct words and pairs once, so the commonest
   word costs one entry a block, and says how often either corpus has it there.
   Asks meet by range of the 64-bit key; ranges grow in number with the input
   and hold about ``CHUNK_KEYS`` asks.  A range adds up and answers its blocks.
3. Answers go back to their block, which scores its documents.

So what is gathered grows with the input, and nothing but three sums is sent to
the driver or to every task.

Defined cases: a null or empty text has no tokens, losses 0 and score 0; null
labels don't make a target; without labels or targets both models are the
uniform one; repeated rows get equal results (losses are rounded to 12 places);
a null doc_id is never part of the background sample; an empty table gives an
empty result; extra columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, strings
from .words import grouped, word_hashes

KAPPA, MU = 0.05, 30.0
#: Tokens in a block, and asks in a range of keys, about.
BLOCK_TOKENS, CHUNK_KEYS = 600_000, 1_500_000
#: Ids of targets sent to every scan at most; beyond it they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
WORDS, PAIRS, BLOCK = 0, 1, 2
_C = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first * _C[0]) ^ ((first * _C[0]) >> np.uint64(31))
    x = (x + second) * _C[1]
    return x ^ (x >> np.uint64(29))


def pack(x: np.ndarray) -> bytes:
    """Integers as compressed planes of bytes: the upper bytes are mostly zero."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(z, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(k := np.dtype(kind).itemsize, len(raw) // k).T).view(kind).ravel()


def corpora(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, of (1 target, 0 background, else null) of every row."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__id")).distinct()
    few = good.count() <= BROADCAST_IDS
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = docs.join(F.broadcast(good) if few else good, F.col("doc_id") == F.col("__id"), "left").withColumn("target", F.col("__id").isNotNull())
    sizes = marked.groupBy("target").agg(F.sum(F.length("text")).cast("double").alias("n")).collect()
    letters = {bool(r["target"]): r["n"] or 0.0 for r in sizes}
    share = min(1.0, letters.get(True, 0.0) / letters[False]) if letters.get(False) else 0.0
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    of = F.when(F.col("target"), 1).when(F.col("doc_id").isNotNull() & (draw < share), 0)
    return marked.select("doc_id", "text", of.alias("of"))


class Block:
    """Tokens of several documents: distinct words and pairs (sorted keys), and the place of every token among them."""

    def __init__(self, words: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, of: np.ndarray):
        self.sizes, self.of = sizes, of
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.word = words[order], rank[tokens]
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.first = np.ones(len(tokens), bool)
        np.not_equal(self.doc[1:], self.doc[:-1], out=self.first[1:])
        h, inner = words[tokens], np.flatnonzero(~self.first)
        self.inner = inner
        self.pairs, self.pair, self._order, self._starts = grouped(pair_keys(h[inner - 1], h[inner]))

    def counts(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, times in the background, times in the target) of this block's words and pairs."""
        of = self.of[self.doc]
        by_word = [np.bincount(self.word[of == k], minlength=len(self.words)) for k in (0, 1)]
        of = of[self.inner][self._order]
        by_pair = [np.add.reduceat((of == k).astype(np.int64), self._starts) if len(of) else np.zeros(0, np.int64) for k in (0, 1)]
        return [(WORDS, self.words, *by_word), (PAIRS, self.pairs, *by_pair)]

    def losses(self, words: np.ndarray, pairs: np.ndarray, vocabulary: int, total: np.ndarray) -> np.ndarray:
        """Mean loss of each document under (background, target); counts as (2, keys)."""
        own_word, own_pair = np.zeros(len(self.word)), np.zeros(len(self.pair))
        for own, places, docs, n in ((own_word, self.word, self.doc, len(self.words)), (own_pair, self.pair, self.doc[self.inner], len(self.pairs))):
            at = np.flatnonzero(self.of[docs] >= 0)
            if len(at):
                _, place, _, starts = grouped(docs[at] * n + places[at])
                own[at] = np.diff(starts, append=len(at))[place]
        out = np.zeros((2, len(self.sizes)))
        if not len(self.word):
            return out
        for of in (0, 1):
            mine = self.of[self.doc] == of
            w = words[of][self.word] - own_word * mine
            c = np.zeros(len(w))
            c[self.inner] = pairs[of][self.pair] - own_pair * mine[self.inner]
            n = total[of] - self.sizes * (self.of == of)
            p = (w + KAPPA) / (n + KAPPA * (vocabulary + 1))[self.doc]
            lead = np.concatenate([[0.0], w[:-1]])
            lead[self.first] = 0.0
            out[of] = np.bincount(self.doc, -np.log((c + MU * p) / (lead + MU)), len(self.sizes)) / np.maximum(self.sizes, 1)
        return out.round(12)


def blocks(marked: DataFrame) -> DataFrame:
    """block, n (tokens), and packed: ids, named (the id isn't null), sizes, of (-1: none), words (commonest first), tokens."""
    small_batches(marked.sparkSession)

    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal number, held, size
            hashes = np.concatenate([h for h, *_ in held])
            keys, place, _, starts = grouped(hashes)
            rank = np.argsort(-np.diff(starts, append=len(hashes)), kind="stable")
            back = np.empty(len(rank), np.uint32)
            back[rank] = np.arange(len(rank), dtype=np.uint32)
            joined = [np.concatenate([r[k] for r in held]) for k in (1, 2, 3, 4)]
            cols = [pa.array([(part << 32) + number], pa.int64()), pa.array([len(hashes)], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in (*joined, keys[rank], back[place]))]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(cols, names=["block", "n", "ids", "named", "sizes", "of", "words", "tokens"])

        for b in batches:
            if b.num_rows:
                h, sizes = word_hashes(strings(b["text"]))
                ids = b["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
                held.append((h, ids, b["doc_id"].is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), sizes, b["of"].fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int8)))
                size += len(h)
                if size >= BLOCK_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return marked.mapInArrow(run, "block long, n long, ids binary, named binary, sizes binary, of binary, words binary, tokens binary")


def _read(row: dict) -> Block:
    return Block(unpack(row["words"], np.uint64), unpack(row["tokens"], np.uint32), unpack(row["sizes"], np.int64), unpack(row["of"], np.int8))


def asks(packed: DataFrame, bits: int) -> DataFrame:
    """kind, chunk (upper bits of the key), block, keys (as differences) and n0, n1: what each block asks and counts."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("n0", pa.binary()), ("n1", pa.binary())])

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                for kind, keys, n0, n1 in _read(row).counts():
                    cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                    rows = [(kind, k, row["block"], *(pack(x) for x in (np.diff(keys[i:j], prepend=np.uint64(0)), n0[i:j].astype(np.uint32), n1[i:j].astype(np.uint32)))) for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if j > i]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return packed.select("block", "words", "tokens", "sizes", "of").mapInArrow(run, "kind int, chunk int, block long, keys binary, n0 binary, n1 binary")


def answers(asked: DataFrame) -> DataFrame:
    """kind, chunk, block, n0, n1 (packed, in the order of the asked keys); and under block -1 the number of known keys and the sums of both corpora."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "keys", "n0", "n1"]).to_pylist()
        keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        _, place, order, starts = grouped(np.concatenate(keys))
        n = [np.add.reduceat(np.concatenate([unpack(r[c], np.uint32) for r in rows])[order].astype(np.uint64), starts) for c in ("n0", "n1")]
        cuts = np.cumsum([0, *map(len, keys)])
        packed = [[pack(x[place[i:j]]) for i, j in zip(cuts[:-1], cuts[1:])] for x in n]
        more = len(rows) + 1
        return pa.table({
            "kind": pa.array([rows and table["kind"][0].as_py()] * more, pa.int32()), "chunk": pa.array([table["chunk"][0].as_py()] * more, pa.int32()),
            "block": pa.array([*(r["block"] for r in rows), -1], pa.int64()), "n0": pa.array([*packed[0], None], pa.binary()), "n1": pa.array([*packed[1], None], pa.binary()),
            "known": pa.array([*[0] * len(rows), int((n[0] + n[1] > 0).sum())], pa.int64()), "all0": pa.array([*[0] * len(rows), int(n[0].sum())], pa.int64()), "all1": pa.array([*[0] * len(rows), int(n[1].sum())], pa.int64()),
        })

    return asked.groupBy("kind", "chunk").applyInArrow(run, "kind int, chunk int, block long, n0 binary, n1 binary, known long, all0 long, all1 long")


def score(documents: DataFrame, labels: DataFrame, chunk_keys: int = CHUNK_KEYS) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row."""
    packed = stored(blocks(corpora(documents, labels)))
    tokens = packed.agg(F.sum("n")).first()[0] or 0
    answered = stored(answers(asks(packed, max(1, math.ceil(math.log2(max(1.0, 0.8 * tokens / chunk_keys)))))))
    got = answered.where((F.col("block") == -1) & (F.col("kind") == WORDS)).agg(F.sum("known"), F.sum("all0"), F.sum("all1")).first()
    vocabulary, total = got[0] or 0, np.array([got[1] or 0, got[2] or 0], float)
    own = packed.drop("n").withColumns({"kind": F.lit(BLOCK), "chunk": F.lit(0)})
    both = own.unionByName(answered.where("block <> -1").drop("known", "all0", "all1"), allowMissingColumns=True)

    def run(batches):
        held: list[list] = [[], []]
        for b in batches:
            for row in b.to_pylist():
                if row["kind"] != BLOCK:
                    held[row["kind"]].append([unpack(row[c], np.uint64) for c in ("n0", "n1")])
                    continue
                block = _read(row)
                n = [np.array([np.concatenate([x[k] for x in part]) if part else np.zeros(0) for k in (0, 1)], float) for part in held]
                held = [[], []]
                background, target = block.losses(n[WORDS], n[PAIRS], vocabulary, total)
                ids, named = unpack(row["ids"], np.int64), unpack(row["named"], np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=named == 0), pa.array(block.sizes), pa.array(target), pa.array(background), pa.array((target - background).round(12))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])

    # a block's answers, by kind and range, come before the block itself
    return both.repartition("block").sortWithinPartitions("block", "kind", "chunk").mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
