"""Ranked lexical search over postings.

``postings`` turns texts into a DataFrame of postings: term, its bucket, the text's row and how often the term
occurs there. A text's postings are made where the text lies, and each task's are sorted by bucket and term. Search
joins the items' terms with them on (bucket, term), scores each match in whole numbers, sums by item and
document, and keeps the first ranks of each item by a window.

The items' terms are broadcast while they are ITEM_TERMS rows or fewer; then postings of other terms
are left out, matches add up per (item, document) in the task that reads the document's postings, and only those sums
are shuffled. With more, both sides are shuffled on the term, frequent ones dealt over several tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, join_hot, table, text_slices, written

BUCKETS = 256
ITEM_TERMS = 1 << 18  #: (item, term) rows that are broadcast at most
TERM_BYTES = 1 << 25  #: of those terms at most
TOP = 10

# A-Z are lower-cased, other ASCII but letters and digits separates, all else belongs to terms.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or bytes([c]).isalnum() else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text in order: maximal runs of ASCII letters, digits and characters beyond
    ASCII, with only A-Z lower-cased."""
    return text.translate(_PLAIN).split() if text else []


def postings(docs: DataFrame, id_col: str, text_col: str, wanted: Broadcast | None = None) -> DataFrame:
    """(row, id, length, bucket, term, tf): a row for each text and distinct term of it, and one
    with a null term for each text. ``row`` numbers the texts, ``length`` counts a text's terms with repeats.

    With ``wanted`` (a set of terms) other terms have no postings. A null text has no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        chosen = None if wanted is None else wanted.value
        for batch in text_slices(batches, 1):
            lengths, found, tfs, sizes = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                every = terms(text)
                seen = Counter(every)
                own = list(seen) if chosen is None else list(seen.keys() & chosen)
                lengths.append(len(every))
                sizes.append(len(own) + 1)
                found.append(None)
                found += own
                tfs.append(None)
                tfs += map(seen.__getitem__, own)
            at = np.repeat(np.arange(batch.num_rows), sizes)
            columns = [
                pa.array(row + at),
                batch.column(0).take(pa.array(at)),
                pa.array(np.array(lengths, np.int64)[at]),
                pa.array(found, pa.binary()).cast(pa.string()),
                pa.array(tfs, pa.int64()),
            ]
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "length", "term", "tf"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"row long, id {kind}, length long, term string, tf long")
    return found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))


def index(docs: DataFrame, id_col: str, text_col: str, wanted: Broadcast | None = None) -> DataFrame:
    """The ``postings`` written to the shared folder, every file sorted by bucket and term."""
    return written(postings(docs, id_col, text_col, wanted).sortWithinPartitions("bucket", "term"), "search-postings")


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, bucket, term, q): how often an item holds a term. A repeated row counts once, texts of one id add up."""
    found = postings(items.select(id_col, text_col).distinct(), id_col, text_col).where("term is not null")
    return found.groupBy(F.col("id").alias("item"), "bucket", "term").agg(F.sum("tf").alias("q"))


def _bounded_terms(wanted: DataFrame, most: int) -> set[bytes] | None:
    """The distinct terms if ``wanted`` has at most ``most`` rows and TERM_BYTES, otherwise None."""
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b")).first()
    if size.n > most or (size.b or 0) > TERM_BYTES:
        return None
    return {r.term.encode("utf-8", "surrogatepass") for r in wanted.select("term").distinct().collect()}


def _gain(tf: Column, length: Column, n: int, total: int) -> Column:
    """Whole-number gain of a term that occurs ``tf`` times in a text of ``length`` terms, of n texts with ``total`` terms."""
    m = F.lit(100 - 75) + F.expr(f"(75L * length * {n}L) div {total}L")
    return F.call_function("div", tf * 1_000_000_000, tf * 1000 + m * 8)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    doc_cols: tuple[str, str] = ("doc_id", "text"),
    item_cols: tuple[str, str] = ("item_id", "text"),
    top: int = TOP,
    most: int = ITEM_TERMS,
) -> DataFrame:
    """(item, rank, doc, score): for each item its ``top`` documents of highest score above 0.

    Ties go by ascending document id, null ids last. Every row of ``docs`` is a document of its own, so repeated rows
    are ranked beside each other. Repeated items count once; texts under one item id, null included, are one item. Null and
    empty texts have no terms: as documents they are never found and don't count, as items they have no rows. Without
    items or documents the result is empty. Other columns are left out.
    """
    spark = docs.sparkSession
    wanted = written(item_terms(items, *item_cols), "search-items")
    chosen = _bounded_terms(wanted, most)
    shared = None if chosen is None else spark.sparkContext.broadcast(frozenset(chosen))
    table_ = index(docs, *doc_cols, wanted=shared)
    corpus = table_.where("term is null and length > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("l")).first()
    n, total = max(corpus.n, 1), corpus.l or 1

    matches = table_.where("term is not null")
    df = matches.groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln(F.lit(2.0 * n + 2) / (F.col("df") * 2 + 1)))
    weighted = wanted.join(df, ["bucket", "term"]).select("bucket", "term", "item", (weight * F.col("q")).alias("weight"))
    gained = matches.select("bucket", "term", "row", "id", _gain(F.col("tf"), F.col("length"), n, total).alias("gain"))
    if chosen is None:
        joined = join_hot(gained, weighted.drop("bucket"), "term", F.col("row"))
    else:
        joined = gained.join(F.broadcast(weighted), ["bucket", "term"])  # ``most`` rows at most
    sums = joined.groupBy("item", "id", "row").agg(F.sum(F.col("weight") * F.col("gain")).alias("score")).where("score > 0")
    first = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    kept = sums.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)
    out = written(kept.select("item", "rank", F.col("id").alias("doc"), "score"), "search-found")
    discard(wanted, table_)
    return out


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


#: Plain form of op13.
OP13_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT doc_id, count(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM sizes),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, corpus GROUP BY term, big_n),
item_terms AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // l))))::BIGINT AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores
WHERE score > 0 QUALIFY rank <= 10
"""
