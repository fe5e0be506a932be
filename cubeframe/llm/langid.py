"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all labelled rows; the weights are trained by follow-the-regularised-leader with
elastic-net penalties on about ``SAMPLE`` labelled rows of each language (a documented bound); a temperature fitted on
a fifth of these calibrates the scores.

Defined results: null texts and texts without a letter are ``und`` with score 0; rows with null lang teach nothing;
without any labelled row every text is ``und``; rows with equal doc_id are predicted each for itself; a null doc_id is
not learnt from and not held out; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeframe.llm.common import unused
from cubeframe.llm.ngrams import balanced, cells, codes_of

BITS, ORDERS, SAMPLE = 14, (1, 2, 3), 800
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 3
#: Letters, and some numerals that are none.
LETTER = re.compile(r"[^\W\d_]")
SPACE = re.compile(r"\s+")


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(cells(codes_of(SPACE.sub(" ", text.lower())), ORDERS, BITS), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


def _tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = _counts(text)
    v = np.log1p(n) * idf[at]
    return at, (v / (np.sqrt((v * v).sum()) or 1.0)).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(m[0].isalpha() for m in LETTER.finditer(text)):
            return "und", 0.0
        at, v = _tf_idf(text, self.idf)
        z = self.weights[:, at] @ v / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        return self.languages[int(p.argmax())], float(p.max())


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int) -> tuple[np.ndarray, float]:
    """Weights and temperature from (class, cells, values)."""
    z, n = np.zeros((classes, 1 << BITS)), np.zeros((classes, 1 << BITS))

    def weights(at) -> np.ndarray:
        zi = z[:, at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2))

    order = np.random.default_rng(5).permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    for _ in range(EPOCHS):
        for i in used:
            y, at, v = rows[i]
            w = weights(at)
            s = w @ v
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = p[:, None] * v
            ni = n[:, at]
            z[:, at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[:, at] = ni + g * g
    w = weights(slice(None))
    scores = [(rows[i][0], w[:, rows[i][1]] @ rows[i][2]) for i in (held if len(held) else used)]

    def loss(t: float) -> float:
        return sum(np.logaddexp.reduce(s / t) - s[y] / t for y, s in scores)

    return w.astype(np.float32), float(min(np.geomspace(0.05, 20, 60), key=loss)) if scores else 1.0


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """``labelled``: doc_id, text, lang; rows without text or lang teach nothing."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")

    def frequencies(batches):
        df, docs = np.zeros(1 << BITS, np.int64), 0
        for pdf in batches:
            for text in pdf["text"]:
                df[_counts(text)[0]] += 1
                docs += 1
        at = np.flatnonzero(df)
        yield pd.DataFrame({"cell": np.append(at, -1), "n": np.append(df[at], docs)})

    df = {r[0]: r[1] for r in rows.select("text").mapInPandas(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()}
    docs = df.pop(-1, 0)  # at most 2**BITS rows besides
    idf = np.log((1.0 + docs) / (1.0 + np.array([df.get(k, 0) for k in range(1 << BITS)]))) + 1.0
    some, languages = balanced(rows, "lang", "doc_id", sample)

    def features(batches):
        for pdf in batches:
            out = [(lang, at.astype("<u2").tobytes(), v.tobytes()) for lang, (at, v) in zip(pdf["lang"], (_tf_idf(t, idf) for t in pdf["text"]), strict=True)]
            yield pd.DataFrame(out, columns=["lang", "at", "v"])

    got = some.select("text", "lang").mapInPandas(features, "lang string, at binary, v binary").collect() if languages else []
    known = sorted((languages.index(r[0]), bytes(r[1]), bytes(r[2])) for r in got)  # in an order that no scheduling changes
    weights, temperature = train([(y, np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, np.float32)) for y, a, v in known], len(languages))
    return Model(languages, idf, weights, temperature)


def _predictor(documents: DataFrame, model: Model):
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats for each language

    @F.pandas_udf("lang_pred string, score double")
    def of(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in text], columns=["lang_pred", "score"])

    return of("text")


def predict(documents: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """``keep`` columns, lang_pred, score: one row for each document."""
    found = documents.select(*keep, _predictor(documents, model).alias("found"))
    return found.select(*found.columns[:-1], "found.lang_pred", "found.score")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnt(documents: DataFrame) -> Model:
    return fit(documents.where(~held_out() & F.col("doc_id").isNotNull()))


def accepted(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose language is recognised with at least that score."""
    at = unused(documents, "predicted")
    found = documents.withColumn(at, _predictor(documents, model))
    return found.where((F.col(f"{at}.lang_pred") != "und") & (F.col(f"{at}.score") >= least)).select(*documents.columns)


def op7_language(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learnt(docs), F.col("doc_id"), held_out().alias("held_out"))
