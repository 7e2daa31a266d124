"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams over lower-cased
letters, other characters counting as one kind of gap. Document frequencies come
from every training document. The model is trained online by
follow-the-regularised-leader (proximal form, per-coordinate rates) with elastic-net
penalties, which keep most weights at exactly 0, and its scores are calibrated by
one temperature fitted on sampled rows that training doesn't see.

Training rows are a sample of a documented size: about
``LanguageParams.sample_per_language`` documents of each language, chosen by a hash
of id and text, rows that agree in both counting once. They fit one task. All other steps cover every document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageParams:
    buckets: int = 1 << 15  #: hashed features
    sample_per_language: int = 1000  #: expected training rows of a language
    epochs: int = 3
    alpha: float = 0.5  #: learning rate of a coordinate
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    calibration_share: float = 0.2  #: of the sample, held back for the temperature


class Features:
    """Hashed n-gram counts of texts; tables of letters are built once a task."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        limit = 0x32400  # beyond, code points count as gaps
        lower = np.zeros(limit, np.uint32)
        for c in range(limit):
            if (x := chr(c)).isalpha():
                lower[c] = ord(low) if len(low := x.lower()) == 1 else c
        self.lower = lower

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """(feature ids, counts) of a whole text; None if it has no letter."""
        if not text:
            return None
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = codes < len(self.lower)
        c = self.lower[codes] if known.all() else np.where(known, self.lower[np.where(known, codes, 0)], 0)
        if not c.any():
            return None
        c = np.concatenate([[0], c, [0]]).astype(np.uint32)
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # a run of gaps is one gap
        one = c * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B))) * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        shift = np.uint32(32 - int(math.log2(self.buckets)))
        found = np.bincount(np.concatenate([one, two, three]) >> shift, minlength=self.buckets)
        ids = np.flatnonzero(found)
        return ids, found[ids]


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf
    return x / math.sqrt(float(x @ x))


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, params: LanguageParams) -> np.ndarray:
    """Weights (buckets + 1, classes), the last row a bias, of FTRL-proximal over ``rows``
    of (feature ids, weights, class) in the order given."""
    z = np.zeros((params.buckets + 1, n_classes))
    n = np.zeros_like(z)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - params.l1, 0.0)
        return -shrunk / ((params.beta + np.sqrt(ni)) / params.alpha + params.l2)

    for _ in range(params.epochs):
        for ids, x, label in rows:
            at = np.append(ids, params.buckets)
            value = np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(value @ w)
            p[label] -= 1.0
            g = value[:, None] * p[None, :]
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / params.alpha * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """Temperature in [0.05, 20] of least negative log likelihood, by golden section
    on its logarithm; 1 without rows."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / math.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, found: tuple[np.ndarray, np.ndarray] | None) -> tuple[str, float]:
        if found is None or not self.languages:
            return UNDETERMINED, 0.0
        ids, counts = found
        x = tf_idf(counts, self.idf[ids])
        p = softmax((x @ self.weights[ids] + self.weights[-1]) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(texts: DataFrame, text_col: str, params: LanguageParams) -> tuple[np.ndarray, int]:
    """For each feature the documents that have it, over all rows, and the documents with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(params.buckets)
        df, docs = np.zeros(params.buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                if (found := features.counts(text.as_py())) is not None:
                    df[found[0]] += 1
                    docs += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], ["feature", "n"])

    parts = texts.select(text_col).mapInArrow(run, "feature long, n long")
    out, docs = np.zeros(params.buckets, np.int64), 0
    # At most one row per hashed feature, however large the corpus.
    for row in parts.groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if row.feature < 0:
            docs = row.n
        else:
            out[row.feature] = row.n
    return out, docs


def train(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, params: LanguageParams) -> LanguageModel:
    """Fit on rows of (id, text, language), languages not null."""
    counted = sorted((r[lang_col], r.n) for r in labelled.groupBy(lang_col).agg(F.count(F.lit(1)).alias("n")).collect())
    languages = tuple(name for name, _ in counted)
    df, docs = document_frequencies(labelled, text_col, params)
    idf = np.log((1 + docs) / (1 + df)) + 1.0
    if not languages:
        return LanguageModel((), idf, np.zeros((params.buckets + 1, 0)), 1.0)
    rows = labelled.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    unit = F.pmod(F.xxhash64("id", "h", F.lit("sample")), F.lit(1 << 30))
    chosen = F.lit(False)
    for name, n in counted:
        limit = min(1 << 30, int((1 << 30) * params.sample_per_language / n))
        chosen = chosen | ((F.col("lang") == name) & (unit < limit))
    # Repeated rows meet before the shuffle, so that the sample stays bounded however often a row comes.
    sample = rows.where(chosen).groupBy("id", "h", "lang").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        features = Features(params.buckets)
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                if (found := features.counts(r["text"])) is not None:
                    order = zlib.crc32(f"{r['id']}/{r['h']}/order".encode())
                    rows.append((order, f"{r['id']}/{r['h']}/{r['lang']}", found[0], tf_idf(found[1], idf[found[0]]), languages.index(r["lang"])))
        rows.sort(key=lambda r: r[:2])  # the order of arrival isn't fixed
        held = int(len(rows) * params.calibration_share)
        w = fit_ftrl([r[2:] for r in rows[held:]], len(languages), params)
        scores = np.array([x @ w[ids] + w[-1] for _, _, ids, x, _ in rows[:held]]).reshape(held, len(languages))
        t = fit_temperature(scores, np.array([r[4] for r in rows[:held]], int))
        yield pa.RecordBatch.from_pydict({"weights": [w.astype("<f4").tobytes()], "temperature": [t]})

    row = sample.repartition(1).mapInArrow(run, "weights binary, temperature double").head()
    shape = (params.buckets + 1, len(languages))
    if row is None:
        return LanguageModel(languages, idf, np.zeros(shape), 1.0)
    return LanguageModel(languages, idf, np.frombuffer(row.weights, "<f4").reshape(shape).astype(np.float64), row.temperature)


def annotate(docs: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` and the predicted language and its probability.

    A null text, or one without a letter, is `und` with score 0.
    """
    buckets = len(model.weights) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets)
        for batch in batches:
            got = [model.predict(features.counts(t.as_py())) for t in batch.column(text_col)]
            arrays = [*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str):
    """True for documents that training never reads: crc32 of the id as text, modulo 4, is 2.
    A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    params: LanguageParams = LanguageParams(),
) -> DataFrame:
    """Every row with its own columns and lang_pred and score.

    Learns from rows whose language is known and that aren't held out. Repeated rows
    get equal predictions; without any labelled row all are `und`. Columns of ``docs`` named
    like the two new ones are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull())
    model = train(labelled, id_col, text_col, lang_col, params)
    return annotate(docs, model, text_col)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(docs)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
