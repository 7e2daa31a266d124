"""The corpus pipeline: five stages from raw documents to packed training windows.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns a DataFrame that is
written as Parquet and read again for the next one. All but the last return the columns of
documents (doc_id, text, lang, source, n_chars); other columns are left out.

Any column may be null. A null text is empty: it has no language, so it goes in the first stage. A null lang trains
nothing, a null source is a source of its own, null ids are kept apart by their texts. Rows of one id and one text are
one document once near copies are dropped. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import language_id, mixing, ngram_join, packing, pii
from sextant.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.3  #: least probability of the predicted language


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or with an
    undecided prediction go."""
    docs = docs.select(*COLUMNS)
    labelled = docs.where(~language_id.held_out("doc_id") & F.col("lang").isNotNull())
    model = language_id.train(labelled, "doc_id", "text", "lang", language_id.LanguageParams())
    found = language_id.annotate(docs, model, "text", ("_lang", "_score"))
    return found.where((F.col("_lang") != language_id.UNDETERMINED) & (F.col("_score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near copies: five-word shingles,
    similarity 0.8 or more. Documents without words link with nothing and stay."""
    params = ngram_join.JoinParams(shingle_words=5, percent=80)
    return ngram_join.one_of_each(docs.select(*COLUMNS), params=params)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced by kinds in brackets, n_chars to fit."""
    clean = pii.redact_personal_data(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as often as the mix takes them (0 to 2 times)."""
    return mixing.take(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a window of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("language identification", keep_languages),
    ("near copies", drop_near_copies),
    ("personal data", redact),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Language models, EM and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
    return docs
