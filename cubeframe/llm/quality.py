"""Quality scores by naive-Bayes support vectors.

Character n-gram indicators are scaled by the classes' log-count ratios (counted over all labelled rows); a linear
hinge-loss model is fitted by dual coordinate descent on about ``SAMPLE`` labelled rows of each class (a documented
bound); a logistic curve on a fifth of these turns margins into scores.

Defined results: null texts count as empty; without labels of both classes every score is the share of label 1 (0.5
without labels); labels without a document, null labels and null texts teach nothing; repeated labels of a document
count as often as they stand; rows with equal doc_id are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.ngrams import balanced, cells, codes_of

BITS, ORDERS, SAMPLE = 16, (1, 2, 3, 4), 1200
COST, EPOCHS = 1.0, 12
#: Labels that may be broadcast (16 bytes each); beyond that the join shuffles.
MOST_BROADCAST = 200_000


def indicators(text: str | None) -> np.ndarray:
    seen = np.zeros(1 << BITS, bool)
    seen[cells(codes_of(text or ""), ORDERS, BITS)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray  # ratio times weight, per cell
    bias: float
    slope: float
    shift: float

    def score(self, text: str | None) -> float:
        at = indicators(text)
        margin = self.weights[at].sum() / np.sqrt(max(1, len(at))) + self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


def descend(rows: list[tuple[int, np.ndarray]], ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge-loss weights and bias over scaled indicators by dual coordinate descent; ``rows``: (+1 or -1, cells)."""
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(rows))
    values = [ratio[at] / np.sqrt(max(1, len(at))) for _, at in rows]
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, at = rows[i]
            step = (y * (w[at] @ values[i] + bias) - 1.0) / norm[i]
            new = min(max(alpha[i] - step, 0.0), COST)
            if new != alpha[i]:
                d = (new - alpha[i]) * y
                w[at] += d * values[i]
                bias += d
                alpha[i] = new
    return w, bias


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """``labelled``: doc_id, text, label (0 or 1)."""
    rows = labelled.where("text IS NOT NULL AND label IN (0, 1)").select("doc_id", "text", F.col("label").cast("int").alias("label"))

    def count(batches):
        n, docs = np.zeros((2, 1 << BITS), np.int64), [0, 0]
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["label"].tolist(), strict=True):
                n[y, indicators(text)] += 1
                docs[y] += 1
        at = np.flatnonzero(n.any(0))
        yield pd.DataFrame({"cell": np.append(at, -1), "n0": np.append(n[0, at], docs[0]), "n1": np.append(n[1, at], docs[1])})

    got = rows.select("text", "label").mapInPandas(count, "cell long, n0 long, n1 long").groupBy("cell").agg(F.sum("n0"), F.sum("n1")).collect()
    n, docs = np.ones((2, 1 << BITS)), np.zeros(2)  # at most 2**BITS rows come
    for c, a, b in got:
        if c < 0:
            docs = np.array([a, b], float)
        else:
            n[:, c] += (a, b)
    if not docs.all():
        share = docs[1] / docs.sum() if docs.sum() else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    ratio = np.log(n[1] / (docs[1] + 2)) - np.log(n[0] / (docs[0] + 2))
    some, _ = balanced(rows, "label", "doc_id", sample)

    def features(batches):
        for pdf in batches:
            yield pd.DataFrame({"label": pdf["label"], "at": [indicators(t).astype("<u2").tobytes() for t in pdf["text"]]})

    known = sorted((2 * r[0] - 1, bytes(r[1])) for r in some.select("text", "label").mapInPandas(features, "label int, at binary").collect())
    known = [(y, np.frombuffer(a, "<u2").astype(np.int64)) for y, a in known]
    order = np.random.default_rng(3).permutation(len(known))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    w, bias = descend([known[i] for i in used], ratio)
    margins = np.array([(w * ratio)[known[i][1]].sum() / np.sqrt(max(1, len(known[i][1]))) + bias for i in held])
    y = np.array([(known[i][0] + 1) / 2 for i in held])
    slope, shift = 2.0, 0.0
    for _ in range(200 if len(held) > 10 else 0):  # Newton steps on the logistic loss, with a weak pull to the start
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        g = np.array([((p - y) * margins).sum() + 0.1 * (slope - 2.0), (p - y).sum() + 0.1 * shift])
        v = p * (1 - p)
        h = np.array([[(v * margins**2).sum() + 0.1, (v * margins).sum()], [(v * margins).sum(), v.sum() + 0.1]])
        slope, shift = np.array([slope, shift]) - np.clip(np.linalg.solve(h, g), -0.5, 0.5)
    return Model(w * ratio, bias, float(slope), float(shift))


def score(documents: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """``keep`` columns and score: one row for each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype=float)

    return documents.select(*keep, of("text").alias("score"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnt(documents: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    return fit(documents.where(~held_out()).select("doc_id", "text").join(known, "doc_id"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), F.col("doc_id"), held_out().alias("held_out"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
