"""Language identification: multinomial logistic regression on character n-grams.

Texts are lower-cased, everything but letters becomes single spaces, and runs
of one to three characters are hashed to 2**16 features.  Inverse document
frequencies come from every labelled document that may be learned from.  The
weights are fitted by follow-the-regularised-leader with elastic-net penalties
on a bounded sample, ``SAMPLE_PER_LANGUAGE`` documents a language in
expectation; a fifth of it is left out of the fit and sets the temperature of
the scores.  The model (features x languages) is broadcast: its size does not
depend on the number of documents.  Every label is learned.

Learning reads only text and label; a prediction reads only text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is every text if nothing could be learned; equal scores go to the first
language by name; null labels are not learned from; texts are read whole, in
runs of bounded memory; repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scratch import give_back, leaving_nothing, small_batches

UNKNOWN = "und"
BITS, GRAMS = 16, 3
FEATURES = 1 << BITS
#: Documents of a language in the sample that the weights are fitted on.
SAMPLE_PER_LANGUAGE = 1500
EPOCHS, ALPHA, BETA, L1, L2 = 3, 2.0, 0.1, 1e-4, 1e-4
_RUN = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTERS: list[np.ndarray] = []


def _is_letter(codes: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0][codes]


def gram_counts(text: str) -> np.ndarray | None:
    """Occurrences of each hashed n-gram; None if the text has no letter."""
    counts, seen = None, False
    for at in range(0, len(text), _RUN):
        codes = np.frombuffer(text[max(0, at - GRAMS + 1) : at + _RUN].lower().encode("utf-32-le", "replace"), np.uint32)
        letter = _is_letter(codes)
        seen = seen or bool(letter.any())
        codes = np.where(letter, codes, np.uint32(32))
        codes = codes[np.r_[True, letter[1:] | letter[:-1]]]
        parts, mixed = [], np.zeros(len(codes), np.uint32)
        for n in range(min(GRAMS, len(codes))):
            mixed = (mixed[: len(codes) - n] * _MULTIPLIERS[0] + codes[n:]) * _MULTIPLIERS[1]
            parts.append((mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIERS[2] >> np.uint32(32 - BITS))
        found = np.bincount(np.concatenate(parts), minlength=FEATURES)
        counts = found if counts is None else counts + found
    return counts if seen else None


@dataclass
class Model:
    """Languages in order of name; weights[feature, language]; idf[feature]."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[index]
        norm = np.sqrt((x * x).sum())
        return x / norm if norm else x

    def logits(self, index: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(index, counts) @ self.weights[index]

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text and self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        index = np.flatnonzero(counts)
        p = _softmax(self.logits(index, counts[index]) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_weights(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Follow-the-regularised-leader over ``rows`` of (index, counts, label)."""
    shape = (FEATURES, len(model.languages))
    z, n = np.zeros(shape), np.zeros(shape)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    random = np.random.default_rng(7)
    ready = [(index, model.features(index, counts), label) for index, counts, label in rows]
    for _ in range(EPOCHS):
        for i in random.permutation(len(ready)):
            index, x, label = ready[i]
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            gg = ni + g * g
            z[index] = zi + g - (np.sqrt(gg) - np.sqrt(ni)) / ALPHA * w
            n[index] = gg
    model.weights = weights(z, n).astype(np.float32)


def fit_temperature(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """The temperature of least log loss on rows that the weights have not seen."""
    if not rows:
        return
    logits = np.array([model.logits(index, counts) for index, counts, _ in rows])
    labels = np.array([label for *_, label in rows])

    def loss(t: float) -> float:
        z = logits / t
        top = z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z - top).sum(axis=1)) + top[:, 0] - z[np.arange(len(z)), labels]).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found, total = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            total += 1
            counts = gram_counts(text.as_py() or "")
            if counts is not None:
                found += counts > 0
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[total, found[at]])], ["feature", "n"])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lang, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (counts := gram_counts(text or "")) is not None:
                index = np.flatnonzero(counts)
                rows.append((lang, key, index.astype(np.int32).tobytes(), counts[index].astype(np.int32).tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["lang", "key", "index", "counts"])


def learn(labelled: DataFrame) -> Model:
    """A model of the rows (lang, text, key); ``key`` only orders the sample."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and key is not null")
    sizes = labelled.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)))
    frequencies = labelled.select("text").mapInArrow(leaving_nothing(_frequencies), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    idf, total = np.zeros(FEATURES), 0
    for feature, n in frequencies.collect():
        if feature < 0:
            total = n
        else:
            idf[feature] = n
    idf = np.where(idf > 0, np.log((1 + total) / (1 + idf)) + 1, 0.0)
    million = 1_000_000
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(million, int(np.ceil(million * SAMPLE_PER_LANGUAGE / r["count"])))) for r in sizes], "lang string, share int")
    order = F.xxhash64("key", F.lit("sample"))
    # one row a language, as many as the model has columns
    sample = labelled.join(F.broadcast(shares), "lang").where(F.pmod(order, F.lit(million)) < F.col("share")).select("lang", "text", order.alias("key"))
    got = sample.mapInArrow(leaving_nothing(_sample_rows), "lang string, key long, index binary, counts binary").collect()
    at = {lang: i for i, lang in enumerate(languages)}
    rows = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["counts"], np.int32), at[r["lang"]]) for r in sorted(got, key=lambda r: (r["key"], r["lang"], r["index"], r["counts"]))]
    model = Model(languages, idf, np.zeros((FEATURES, len(languages)), np.float32))
    fit_weights(model, [r for i, r in enumerate(rows) if i % 5])
    fit_temperature(model, rows[::5])
    return model


_RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


def prediction(model: Model, text: Column, docs: DataFrame) -> Column:
    """A struct (lang_pred, score) for each text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(t.as_py()) for t in texts]
        give_back()
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["lang_pred", "score"])

    return F.arrow_udf(predict, _RESULT)(text)


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id as text leaves 1 when divided by 3."""
    left = F.crc32(doc_id.cast("string").cast("binary")) % 3
    return F.coalesce(left == 1, F.lit(False))


def learn_from(docs: DataFrame) -> Model:
    """A model of the documents that are not held out."""
    return learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text", F.col("doc_id").alias("key")))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), prediction(model, F.col("text"), docs).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is known with ``least_score`` or more."""
    found = prediction(model, F.col("text"), docs)
    return docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= least_score))
