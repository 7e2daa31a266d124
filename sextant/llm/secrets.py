"""Secret scans with multipart credential linking (DataFrame functions only).

Base kinds are found by their patterns alone. Weak kinds, whose patterns fit much that is no
secret, are reported only with a complementary part close by: an interval join over
(row, position bin) brings parts within ``scope`` code points together.

* `weak_secret`: a run of 32 or more base64 characters with upper case, lower case and digits;
  its complements are access identifiers and endpoints.
* `endpoint`: an address that takes credentials (cloud, database or host=...); its
  complements are access identifiers and secrets, base or weak, of the row.
* `account`: a user or client id assignment; its complements are secrets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .shared import table, written

SCOPE = 400  #: code points between the near ends of linked parts

#: The contract's patterns (fixed values). Lengths of access and hex are part of the pattern:
#: their matches are maximal runs, so a shorter one hides no longer one.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
BASE_KINDS = ("assign", "access", "hex")

WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/]*+[A-Za-z])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?:https?|jdbc:[a-z]++|postgres|mysql|mongodb|redis|amqp)://[^\s\"'<>]++|(?<![A-Za-z0-9.-])[a-z0-9][a-z0-9.-]*?\.(?:amazonaws|azure|googleapis)\.com(?!\.?[a-z0-9-])"
ACCOUNT = r"""(?i:user(?:name)?|login|client_id|account_id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9_.@-]{3,}+"""
WEAK_KINDS = ("weak_secret", "endpoint", "account")
KINDS = BASE_KINDS + WEAK_KINDS

#: Which kinds complete a weak kind.
COMPLEMENTS = {
    "weak_secret": ("access", "endpoint", "account"),
    "endpoint": ("access", "assign", "weak_secret"),
    "account": ("assign", "weak_secret", "hex"),
}


def base_spans(text: Column) -> Column:
    assign = F.filter(S.find_hits(text, ASSIGN, "assign"), lambda s: F.length(F.regexp_extract(s.hit, ASSIGN, 1)) >= 12)
    access = S.find_hits(text, ACCESS, "access", F.contains(text, F.lit("AKIA")))
    hexes = S.find_hits(text, HEX, "hex")
    return S.by_start(S.located(F.concat(assign, access, hexes)), KINDS)


def weak_spans(text: Column) -> Column:
    """Weak candidates, whether or not a complement is near."""
    mixed = lambda s: F.regexp_like(s.hit, F.lit("[A-Z]")) & F.regexp_like(s.hit, F.lit("[a-z]")) & F.regexp_like(s.hit, F.lit("[0-9]"))
    secret = F.filter(S.find_hits(text, WEAK_SECRET, "weak_secret"), mixed)
    address = F.contains(text, F.lit("://")) | F.contains(text, F.lit(".com"))
    return S.located(F.concat(secret, S.find_hits(text, ENDPOINT, "endpoint", address), S.find_hits(text, ACCOUNT, "account")))


def _linked(rows: DataFrame, scope: int) -> DataFrame:
    """(row, linked): the weak spans of each row that a complement within ``scope`` supports."""
    parts = rows.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak")).alias("s"))
    parts = parts.select("row", "s.kind", "s.start", "s.end", F.floor(F.col("s.start") / scope).alias("bin"))
    pairs = rows.sparkSession.createDataFrame([(w, c) for w, cs in COMPLEMENTS.items() for c in cs], "weak string, kind string")
    # A part reaches the bins around both its ends; bins are as wide as the scope.
    reach = F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)
    others = parts.join(F.broadcast(pairs), "kind")
    others = others.select("row", "weak", F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(reach).alias("bin"))
    near = (F.col("o_start") - F.col("end") <= scope) & (F.col("start") - F.col("o_end") <= scope)
    apart = (F.col("o_end") <= F.col("start")) | (F.col("o_start") >= F.col("end"))
    weak = parts.where(F.col("kind").isin(*WEAK_KINDS)).withColumnRenamed("kind", "weak")
    weak = weak.select("row", "weak", "start", "end", F.explode(F.sequence("bin", F.floor(F.col("end") / scope))).alias("bin"))
    joined = weak.join(others, ["row", "weak", "bin"]).where(near & apart)
    span = F.struct(F.col("weak").alias("kind"), "start", "end")
    return joined.groupBy("row").agg(F.collect_set(span).alias("linked"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: id, ``base`` and ``found`` spans (base and linked weak ones), by start then kind.

    Base spans always stay; a weak span that overlaps one is left out. A null text has
    none. Repeated rows give equal spans, an empty table an empty result; ids may be null or repeat,
    and other columns are left out. A long text's parts are joined bin by bin, so its work grows with
    the parts in reach of each other. Spans that start alike go by kind as listed, then by end. The
    shared folder gets places of parts, never what they hold.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), base_spans(text).alias("base"), weak_spans(text).alias("weak"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    free = S.free_of(F.col("linked"), F.col("base"))
    joined = rows.join(_linked(rows, scope), "row", "left")
    found = F.when(F.col("linked").isNull(), F.col("base")).otherwise(S.by_start(F.concat("base", free), KINDS))
    return joined.select(id_col, "base", found.alias("found"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    counts = [S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, S.digest(F.col("base")).alias("base_sha256"), S.listed(F.col("found")).alias("spans"))
