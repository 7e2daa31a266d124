"""URL filters: host rules, and pattern rules indexed by their rarest literal token.

DataFrame functions only. Two kinds of rules decide on a URL:

* A host rule (host, path, verdict) fits its host and all subdomains if the URL's
  path starts with the rule's path; the longest fitting rule wins.
* A pattern rule (name, pattern, tokens, verdict) is a regular expression over the
  whole URL. ``tokens`` are literal words that any URL matching it must hold as
  whole tokens (maximal runs of a-z, 0-9 after lower-casing). Each rule is filed under
  the one of its tokens that the fewest URLs of the table hold; a URL's tokens
  fetch candidate rules and only those run their expression.

A few rules are an index within the row's expression; more than INLINE_RULES are a table that tokens and
host suffixes of the URLs are joined with. Both give the same rows.

A URL that no host rule fits gets the verdict of the patterns: `block` if a
blocking pattern matches and no allowing one does, otherwise `allow`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

INLINE_RULES = 64  #: rules that fit into an expression; more are joined


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str


#: The contract's host rules (fixed values).
HOST_RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)

#: Default patterns: trackers, session ids, feeds and binary downloads.
PATTERN_RULES = (
    PatternRule("tracker", r"[?&]utm_source=[^&#]+", ("utm", "source"), "block"),
    PatternRule("session", r"[?&](?i:sessionid)=[0-9A-Za-z]+", ("sessionid",), "block"),
    PatternRule("paged-ref", r"[?&]page=[0-9]+&ref=", ("page", "ref"), "block"),
    PatternRule("login", r"^[a-z]+://[^/?#]+/(?i:login)(?:[/?#]|$)", ("login",), "block"),
    PatternRule("archive", r"^[^?#]+\.(?i:zip)(?:[?#]|$)", ("zip",), "block"),
    PatternRule("printable", r"^[a-z]+://[^?#]+\.html$", ("html",), "allow"),
)


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z
    lower-cased. Path: from there up to `?`, `#` or the end. Both are empty for null
    or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return _lower_ascii(host), path


def url_tokens(url: Column) -> Column:
    """Distinct maximal runs of a-z, 0-9 of the URL, A-Z lower-cased; none for null."""
    return F.array_distinct(F.regexp_extract_all(_lower_ascii(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def index_rules(rules: tuple[PatternRule, ...], token_counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    """Rules by their rarest token, going by the URLs that hold each token (absent: 0).

    Ties go to the token that sorts first. A rule without tokens can't be indexed: an error.
    """
    if missing := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"pattern rules without literal tokens: {missing}")
    index: dict[str, list[PatternRule]] = {}
    for rule in sorted(rules, key=lambda r: r.name):
        index.setdefault(min(rule.tokens, key=lambda t: (token_counts.get(t, 0), t)), []).append(rule)
    return index


def _index_column(index: dict[str, list[PatternRule]]) -> Column:
    """The index as a constant map: token to array of struct(name, pattern, verdict)."""
    rule = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))
    parts = [x for token, rules in sorted(index.items()) for x in (F.lit(token), F.array(*map(rule, rules)))]
    return F.create_map(*parts)


def _longest_host_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """struct(size, name, verdict) of the longest fitting rule, or null; ties by name."""
    fits = [
        F.when(
            ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
            F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def _token_counts(rows: DataFrame, pattern_rules: tuple[PatternRule, ...]) -> dict[str, int]:
    """URLs that hold each literal token of the rules: one row a token at most, the rules being a
    parameter on the driver."""
    wanted = sorted({t for r in pattern_rules for t in r.tokens})
    if not wanted:
        return {}
    names = rows.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    held = rows.select(F.explode(url_tokens(F.col("_url"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return {r.token: r.n for r in held.join(F.broadcast(names) if len(wanted) <= 100_000 else names, "token", "left_semi").collect()}


def _inline(rows: DataFrame, host_rules: tuple[HostRule, ...], index: dict[str, list[PatternRule]]) -> DataFrame:
    """``rows`` with the matching patterns ``_m`` and the host rule ``_h``, by expressions over the row."""
    matching = F.array().cast("array<struct<name:string,pattern:string,verdict:string>>")
    if index:
        by_token = _index_column(index)
        known = F.array_intersect(url_tokens(F.col("_url")), F.array(*map(F.lit, sorted(index))))
        candidates = F.flatten(F.transform(known, lambda t: F.element_at(by_token, t)))
        matching = F.filter(candidates, lambda r: F.regexp_like(F.col("_url"), r.pattern))
    matching = F.transform(matching, lambda r: F.struct(r["name"].alias("name"), r.verdict.alias("verdict")))
    return rows.withColumn("_m", matching).withColumn("_h", _longest_host_rule(F.col("host"), F.col("path"), host_rules))


def _joined(rows: DataFrame, host_rules: tuple[HostRule, ...], index: dict[str, list[PatternRule]]) -> DataFrame:
    """As ``_inline``, by joins with the tables of rules. Only what matches is shuffled, and
    the rows once to meet it. Spark broadcasts a table of rules if it is below the session's threshold."""
    spark = rows.sparkSession
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "url-rows")
    filed = [(t, r.name, r.pattern, r.verdict) for t, rules in sorted(index.items()) for r in rules]
    patterns = spark.createDataFrame(filed, "token string, name string, pattern string, verdict string")
    held = rows.select("_row", "_url", F.explode(url_tokens(F.col("_url"))).alias("token")).join(patterns, "token")
    held = held.where(F.regexp_like("_url", F.col("pattern")))
    matched = held.groupBy("_row").agg(F.collect_set(F.struct("name", "verdict")).alias("_m"))
    hosts = spark.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in host_rules], "suffix string, start string, name string, verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = rows.select("_row", "path", F.explode(suffixes).alias("suffix")).join(hosts, "suffix").where(F.startswith("path", "start"))
    best = fitting.groupBy("_row").agg(F.max(F.struct(F.length("name").alias("size"), "name", "verdict")).alias("_h"))
    both = rows.join(matched, "_row", "left").join(best, "_row", "left").drop("_row")
    return both.withColumn("_m", F.coalesce("_m", F.array().cast("array<struct<name:string,verdict:string>>")))


def judge_urls(
    pages: DataFrame,
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    inline_rules: int = INLINE_RULES,
) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, patterns.

    ``rule`` is the winning host rule (`hostpath`) or null; ``patterns`` are the names
    of the matching pattern rules, sorted. A null or malformed URL has empty parts,
    no rule and is allowed. Repeated rows each keep their row, ids may be null, an empty table
    gives an empty result, and other columns are left out. URLs are taken whole, however long.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    index = index_rules(pattern_rules, _token_counts(rows, pattern_rules))
    few = len(host_rules) + len(pattern_rules) <= inline_rules
    judged = _inline(rows, host_rules, index) if few else _joined(rows, host_rules, index)
    blocked = F.exists("_m", lambda r: r.verdict == "block") & ~F.exists("_m", lambda r: r.verdict == "allow")
    return judged.select(
        id_col,
        "host",
        "path",
        F.col("_h.name").alias("rule"),
        F.coalesce(F.col("_h.verdict"), F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.array_join(F.array_sort(F.transform("_m", lambda r: r["name"])), ",").alias("patterns"),
    )


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


_HOSTS = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in HOST_RULES)
_PATTERNS = ", ".join(f"('{r.name}', '{r.pattern}', '{r.verdict}')" for r in PATTERN_RULES)

#: Plain form of the same judgement: every pattern runs on every URL.
OP9_SQL = f"""
WITH hosts(h, p, v) AS (VALUES {_HOSTS}),
patterns(n, e, v) AS (VALUES {_PATTERNS}),
parts AS (
  SELECT page_id, url, row_number() OVER () AS k,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, k,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fit AS (
  SELECT k, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM split, hosts
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
hit AS (
  SELECT k, string_agg(n, ',' ORDER BY n) AS names, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked
  FROM split, patterns WHERE regexp_matches(url, e) GROUP BY k)
SELECT page_id, host, path, rule,
  coalesce(fit.verdict, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(names, '') AS patterns
FROM split LEFT JOIN fit USING (k) LEFT JOIN hit USING (k)
"""
