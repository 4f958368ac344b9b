"""What the operators share: checkpoints, folds, row keys and small models.

Everything here treats a table as a multiset of rows.  A row key is a 64-bit
hash of id and text, so repeated rows share a key and get equal results, and
rows with one id but different texts are kept apart.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch: whole texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 500, 32 << 20
#: Labelled rows with this remainder of crc32(id) are held out from learning.
HELD_OUT_FOLD, FOLDS = 0, 5


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows and bytes, so that a batch of long texts fits in a worker; settings of the session that only get smaller."""
    prefix = "spark.sql.execution.arrow.max"
    if not 0 < int(spark.conf.get(f"{prefix}RecordsPerBatch")) <= rows:
        spark.conf.set(f"{prefix}RecordsPerBatch", str(rows))
    spark.conf.set(f"{prefix}BytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        if not named:
            named = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
        # Spark makes a folder of its own for this application in it, which goes with the application
        own = spark._jvm.org.apache.hadoop.fs.Path(sc.getCheckpointDir())
        own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which a lost executor doesn't take along."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet in the checkpoint folder and read again.

    Unlike a checkpoint the result has a measured size and no partitioning, so
    a join on the key it was grouped by deals out both sides, and the adaptive
    planner can broadcast it or split a hot key of the other side.
    """
    spark = df.sparkSession
    path = scratch(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column) -> Column:
    """crc32(doc_id as text) mod 5; rows without an id count as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT_FOLD)).cast("int")


def row_key(*cols: str) -> Column:
    return F.xxhash64(*[F.col(c) for c in cols])


def packed(documents: DataFrame, **more: Column) -> DataFrame:
    """A column ``row`` with all columns of the table, and ``more``: no name of the table can clash with those of an operator."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def kept_rows(documents: DataFrame, keep) -> DataFrame:
    """The rows, all columns, for whose texts ``keep`` (list of texts -> list of booleans, made once in each task) says so."""
    small_batches(documents.sparkSession)

    def run(batches):
        judge = keep()
        for b in batches:
            yield b.filter(pa.array(judge(strings(b["text"])), pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """The n rows of smallest hash: a sample that depends on neither order nor partitions."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(n)


def one_text(df: DataFrame, *others: str) -> DataFrame:
    """Of rows (id, text, others) one for each id: that of the least text, so a bounded set of ids has a bounded set of rows."""
    best = F.min(F.struct("text", *others))
    return df.groupBy("id").agg(best.alias("r")).select("id", "r.text", *[f"r.{c}" for c in others])


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


class TokenIds(dict):
    """Token -> bucket by crc32, remembered; forgets all when it grows large."""

    def __init__(self, bits: int, limit: int = 400_000):
        super().__init__()
        self.mask, self.limit = (1 << bits) - 1, limit

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        # crc32 is linear, so its low bits are mixed before they choose a bucket
        x = zlib.crc32(token.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        self[token] = out = (x >> 24) & self.mask
        return out


def logistic_fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Newton's method for ridge logistic regression; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + l2 * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))
