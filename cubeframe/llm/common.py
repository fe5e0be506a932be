"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a new one where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cubeframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, so that nothing before it runs twice.

    Executors may be lost at any time: the files hold everything that later steps need. They go with :func:`discard`, or
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._cubeframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing will read again."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._cubeframe_path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class WordHash(dict):
    """word (bytes) -> 64-bit hash, kept for the words seen last; ``trim`` bounds its size."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self, most: int = 300_000) -> None:
        if len(self) > most:
            self.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def shingle_hashes(words: list[bytes], size: int, seen: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
    width = min(size, n)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out + h[i : n - width + 1 + i])
    out.sort()
    keep = np.ones(len(out), bool)
    keep[1:] = out[1:] != out[:-1]
    return out[keep]


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose keys may be null (null matches null); the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    out = left.join(r, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], how)
    return out.drop(*[f"__r_{k}" for k in keys])
