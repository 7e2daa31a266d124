"""MinHash near-duplicates by one-permutation hashing with optimal densification.

A text's set of hashed word shingles is permuted once; the hash range is cut into ``bins``, and a bin holds the
least hash that falls into it. An empty bin takes the value of the first filled one in its own random order of all
bins, shared by all sets, so that two sets agree in any bin with their similarity as chance. ``rows`` bins
make a band, a band's content is a bucket.

Candidates are stars: the sets of a bucket are compared with one pivot, so a round has at most as many pairs as
buckets have rows. Candidates are confirmed on full sets, pivots leave their buckets, and what then still
shares a bucket across components gets new pivots and at last complete comparisons in blocks, as in ``ngram_join``,
so no link inside a bucket is lost. A pair at the threshold misses all 32 bands with a chance of about one in a million.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngram_join import SIGNATURE_BITS, JoinParams, jaccard_components, mix
from .shared import table

_SEED = np.uint64(0x51ED270B0F2A3C59)


@dataclass(frozen=True)
class MinHashParams(JoinParams):
    shingle_words: int = 4
    bins: int = 128  #: a power of two
    rows: int = 4  #: bins of a band

    def signatures(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Its bands' contents; a partner shares one at least. A set too small to have other partners than equal
        sets has none."""
        n = len(s)
        if n * 100 < self.percent * (n + 1) and (n - 1) * 100 < self.percent * n and (n - 1) * 100 < self.percent * (n + 1):
            return []
        values = minima(s, self.bins).reshape(-1, self.rows)
        h = mix(np.arange(len(values), dtype=np.uint64) + np.uint64(self.rows << 32))
        for i in range(self.rows):
            h = mix(h + values[:, i])
        return [(1, h >> np.uint64(64 - SIGNATURE_BITS))]


@cache
def _turns(bins: int) -> np.ndarray:
    """(bins, bins): at which place of bin i's random order of all bins bin j stands; its own is first."""
    grid = mix(np.arange(bins * bins, dtype=np.uint64) + _SEED).reshape(bins, bins)
    np.fill_diagonal(grid, 0)
    turns = np.empty((bins, bins), np.uint16)
    np.put_along_axis(turns, np.argsort(grid, axis=1), np.arange(bins, dtype=np.uint16)[None, :], axis=1)
    return turns


def minima(s: np.ndarray, bins: int) -> np.ndarray:
    """The densified signature of a set of hashes that isn't empty: a value for each bin."""
    h = np.sort(mix(s ^ _SEED))
    at = (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    filled, first = np.unique(at, return_index=True)
    return h[first][_turns(bins)[:, filled].argmin(axis=1)]


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MinHashParams = MinHashParams()) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links, its own included) and kept.

    Null or wordless texts have an empty set, link with nothing and are kept. Repeated rows and equal sets are one class;
    ids may repeat or be null: all rows of a component's least id are kept, a component of null ids only has a
    null id and keeps all its rows. An empty table gives an empty result; other columns are left out.
    """
    found = jaccard_components(docs, id_col, text_col, params)
    return found.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


#: Plain form: all pairs that share a shingle, and all that is reachable.
OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
