"""Stored arrays, work lists and side files of runs."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrays(spark: SparkSession, folder: str) -> DataFrame:
    """path, shape, place (row-major, from 0), value: a row for each number of all .npy files below ``folder``.

    An array has to fit into a task; its rows go out a million at a time. Files with objects are not read: they fail.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", "true").load(folder).select("path", "content")

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                flat, shape = a.ravel().astype(float), list(a.shape)
                for at in range(0, len(flat), 1_000_000):
                    part = flat[at : at + 1_000_000]
                    yield pd.DataFrame({"path": path, "shape": [shape] * len(part), "place": np.arange(at, at + len(part)), "value": part})

    return files.mapInPandas(numbers, "path string, shape array<long>, place long, value double")


def manifest(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A work list in CSV with a header; a row that does not fit ``columns`` fails."""
    return spark.read.schema(columns).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def write_manifest(units: DataFrame, path: str, seq: str = "seq") -> None:
    """``units`` as CSV in the order of ``seq``: the files are in order, and so are the rows in each."""
    units.orderBy(seq).write.mode("overwrite").csv(path, header=True)


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """cube and the read intervals of all reads.jsonl below ``folder``."""
    kind = "file string, start double, end double, bytes long"
    some = spark.read.schema(kind).option("pathGlobFilter", "reads.jsonl").option("recursiveFileLookup", "true").json(folder)
    return some.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("cube"), "*")


def timings(spark: SparkSession, folder: str) -> DataFrame:
    """cube, phase, seconds of all timings.json below ``folder``."""
    kind = "total double, phases map<string, double>"
    some = spark.read.schema(kind).option("pathGlobFilter", "timings.json").option("recursiveFileLookup", "true").json(folder, multiLine=True)
    return some.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("cube"), F.explode("phases").alias("phase", "seconds"))
