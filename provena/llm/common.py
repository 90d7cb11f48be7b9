"""What several operators of this subpackage need: table reading, shared storage, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only in a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="provena-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result once to the shared folder and read it back.

    Later uses neither recompute it nor depend on the executors that made it, and an exchange above it
    reads rows as stored, so that adaptive execution can split a skewed join partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/provena/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete what materialize has written for these, once nothing that is still to run reads it."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(vars(df)["stored_at"])
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_MEMOS: dict[str, dict] = {}
_OWNER = [""]


def _give_back() -> None:
    """Return to the system what Arrow and the allocator keep of freed memory, where the system's library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def worker_memo(owner: str) -> dict:
    """What one operator remembers in this Python worker from task to task.

    Spark reuses workers, so that each of them comes to run every stage of a job; asking for a memo empties those
    of the other operators and gives their memory back, so that a worker holds one at a time.
    """
    if _OWNER[0] != owner:
        for other, memo in _MEMOS.items():
            if other != owner:
                memo.clear()
        _OWNER[0] = owner
        _give_back()
    return _MEMOS.setdefault(owner, {})


def doc_hash_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo a number; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def numbered_words(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """(distinct words, number of each word in order, words in each text, texts in bytes) of a block of texts.

    Words are maximal runs of bytes other than space and tab to carriage return, bytes.split's own set.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    split = [b.split() for b in raw]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((number[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    return list(number), flat, sizes, raw
