"""Personal data by weak supervision (DataFrame functions on rows, closed forms on counts).

Candidate spans come from patterns. Labelers vote on each: a regular expression for the
strict form, gazetteers for known parts, and the words around for the context; a vote is
1 (personal), -1 (not) or 0 (abstains). The votes of all candidates are counted by
(kind, votes, features of the span), a table whose size depends on the number of kinds,
labelers and features only. Expectation-maximisation on the votes estimates how reliable each
labeler is and how often a kind is personal; a logistic span classifier is then trained on the
expected labels, again on counts. It sees the votes and the span's own features (length, share
of digits, what stands around it), and its score decides which candidates become spans.

Base kinds are found by their patterns alone; their spans vote along in the
estimation, and always stay.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans as S
from .shared import table, written

# The contract's patterns (fixed values). Repetitions that nothing follows are possessive, and
# starts inside a run that can't match are skipped, which leaves the matches as they are.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE_KINDS = ("email", "ip", "card", "phone")

#: Candidate patterns beyond the base kinds.
EXTRA = {
    "email_spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]++)++",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+() .-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])(?=(?:[A-Z0-9] ?){15})[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
KINDS = BASE_KINDS + tuple(EXTRA)

#: What makes a text worth scanning for a kind.
MARKS = {"email": "@", "phone": "+", "email_spelled": "at", "id_number": "-", "ip": "."}

#: The strict form of each kind, for the first labeler.
STRICT = {
    "email": r"^[^@]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}$",
    "card": r"^[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$",
    "phone": r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}$",
    "email_spelled": r"^[A-Za-z0-9._%+-]+ ?[\[(]?at[\])]? ?[A-Za-z0-9-]+(?: ?[\[(]?dot[\])]? ?[A-Za-z0-9-]+)* ?[\[(]?dot[\])]? ?[A-Za-z]{2,6}$",
    "id_number": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "local_phone": r"^(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}$",
    "account": r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,4})?$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    "person": r"^(?:Mr|Mrs|Ms|Dr|Prof)\.? \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
}

#: Gazetteers: parts that speak for a kind.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|de|fr|es|uk|io)$",
    "email_spelled": r"(?:com|org|net|edu|gov|de|fr|es|uk|io)$",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "account": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "person": r"(?:Anna|David|Emma|James|John|Juan|Laura|Maria|Marie|Mary|Michael|Paul|Peter|Robert|Sarah|Thomas)",
    "local_phone": r"^\(?(?:20[1-9]|21[2-9]|30[1-9]|31[2-9]|40[1-9]|41[2-9]|51[0-9]|61[0-9]|71[2-9]|80[1-8]|90[1-9])",
}

#: Words before or after a span, all lower case.
SPEAKS_FOR = r"\b(?:e-?mail|mail|contact|call|tel|phone|mobile|fax|card|visa|account|iban|ssn|social security|address|login from|client|telefon|correo|courriel)\b"
SPEAKS_AGAINST = r"\b(?:version|release|isbn|issn|order|invoice|ticket|serial|example of|section|chapter|figure|table|doi|build)\b"
LABELERS = ("strict", "gazetteer", "before", "after")
FEATURES = ("length", "digits", "left", "right")
THRESHOLD = 0.5  #: least score of a span beyond the base kinds
ROUNDS = 100


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _mark(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(MARKS[kind])) if kind in MARKS else F.lit(True)


def base_hits(text: Column) -> Column:
    """Hits of the four base kinds, by kind as listed, then by start."""
    digits = lambda s: F.regexp_replace(s.hit, "[^0-9]", "")
    find = lambda pattern, kind: S.find_hits(text, pattern, kind, _mark(text, kind), True)
    ip = F.filter(find(IP, "ip"), lambda s: F.regexp_like(s.hit, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")))
    card = F.filter(find(CARD, "card"), lambda s: F.when(F.length(digits(s)) <= 19, _luhn(digits(s))).otherwise(False))
    phone = F.filter(find(PHONE, "phone"), lambda s: F.length(digits(s)).between(9, 15))
    return F.concat(find(EMAIL, "email"), ip, card, phone)


def extra_hits(text: Column) -> Column:
    """Candidates of the other kinds."""
    return F.concat(*(S.find_hits(text, pattern, kind, _mark(text, kind), True) for kind, pattern in EXTRA.items()))


def _by_kind(kind: Column, patterns: dict[str, str], value: Column) -> Column:
    """1 where the kind's pattern is found in ``value``, -1 where not, 0 for other kinds."""
    vote = F.lit(0)
    for name, pattern in patterns.items():
        vote = F.when(kind == name, F.when(F.regexp_like(value, F.lit(pattern)), 1).otherwise(-1)).otherwise(vote)
    return vote


def _context(words: Column) -> Column:
    low = F.lower(words)
    return F.when(F.regexp_like(low, F.lit(SPEAKS_AGAINST)), -1).when(F.regexp_like(low, F.lit(SPEAKS_FOR)), 1).otherwise(0)


def _neighbour(c: Column) -> Column:
    """Class of a code point beside a span: none, space, letter or digit, other."""
    return F.when(c == "", "none").when(F.regexp_like(c, F.lit(r"\s")), "space").when(F.regexp_like(c, F.lit(r"[\p{L}0-9]")), "word").otherwise("other")


def _features(h: Column) -> list[Column]:
    """Of a hit, as listed in FEATURES: length class, quarters of digits, classes of its neighbours."""
    size = F.length(h.hit)
    length = F.when(size <= 12, "short").when(size <= 18, "middle").when(size <= 26, "long").otherwise("longer")
    digits = F.floor(F.length(F.regexp_replace(h.hit, "[^0-9]", "")) * 4 / size).cast("string")
    return [length, digits, _neighbour(F.substring(h.before, -1, 1)), _neighbour(F.substring(h.after, 1, 1))]


def voted(hits: Column) -> Column:
    """The hits as struct(span, pattern): pattern is `kind:vote:...:feature:...` in the order of
    LABELERS and FEATURES."""

    def one(h: Column) -> Column:
        votes = [_by_kind(h.kind, STRICT, h.hit), _by_kind(h.kind, GAZETTEER, h.hit), _context(h.before), _context(h.after)]
        pattern = F.concat_ws(":", h.kind, *(v.cast("string") for v in votes), *_features(h))
        return F.struct(F.struct(h.kind.alias("kind"), h.start.alias("start"), h["end"].alias("end")).alias("span"), pattern.alias("pattern"))

    return F.transform(hits, one)


@dataclass(frozen=True)
class Estimate:
    prior: dict[str, float]  #: share of personal candidates by kind
    reliability: dict[str, tuple[float, float]]  #: of a labeler: P(votes for | personal, votes), P(votes against | not, votes)
    posterior: dict[str, float]  #: by pattern


def expectation_maximisation(counts: dict[str, int], rounds: int = ROUNDS) -> Estimate:
    """Reliabilities of the labelers, from counts of vote patterns alone.

    Each labeler, where it votes, is right with its own two rates. Rates start at 0.8 and
    priors at 0.5; pseudo-counts keep them inside (0, 1).
    """
    rows = [(p, p.split(":")[0], _votes(p), n) for p, n in sorted(counts.items())]
    prior: dict[str, float] = {kind: 0.5 for _, kind, _, _ in rows}
    rates = [(0.8, 0.8)] * len(LABELERS)
    posterior: dict[str, float] = {}
    for _ in range(rounds):
        for pattern, kind, votes, _ in rows:
            log_odds = math.log(prior[kind] / (1 - prior[kind]))
            for (sensitive, specific), v in zip(rates, votes, strict=True):
                if v:
                    log_odds += math.log(sensitive / (1 - specific)) if v > 0 else math.log((1 - sensitive) / specific)
            posterior[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))
        for kind in prior:
            own = [(posterior[p], n) for p, k, _, n in rows if k == kind]
            prior[kind] = (sum(q * n for q, n in own) + 1) / (sum(n for _, n in own) + 2)
        for i in range(len(LABELERS)):
            yes = [sum(posterior[p] * n for p, _, v, n in rows if v[i] == s) for s in (1, -1)]
            no = [sum((1 - posterior[p]) * n for p, _, v, n in rows if v[i] == s) for s in (1, -1)]
            rates[i] = ((yes[0] + 4) / (sum(yes) + 5), (no[1] + 4) / (sum(no) + 5))
    return Estimate(prior, dict(zip(LABELERS, rates, strict=True)), posterior)


def _votes(pattern: str) -> list[int]:
    return [int(v) for v in pattern.split(":")[1 : 1 + len(LABELERS)]]


def _inputs(pattern: str) -> dict[str, float]:
    kind, *parts = pattern.split(":")
    votes, features = parts[: len(LABELERS)], parts[len(LABELERS) :]
    named = {f"{name}={v}": 1.0 for name, v in zip(LABELERS, votes, strict=True) if v != "0"}
    own = {f"{kind}/{name}={v}": 1.0 for name, v in zip(FEATURES, features, strict=False)}
    return {"bias": 1.0, f"kind={kind}": 1.0, **named, **own}


def train_classifier(counts: dict[str, int], labels: dict[str, float], steps: int = 300, l2: float = 1e-2) -> dict[str, float]:
    """Weights of a logistic model of the expected labels, by gradient steps on the counts."""
    total = sum(counts.values()) or 1
    rows = [(pattern, _inputs(pattern), n) for pattern, n in sorted(counts.items())]
    weights: dict[str, float] = defaultdict(float)
    for _ in range(steps):
        slope: dict[str, float] = defaultdict(float)
        for pattern, x, n in rows:
            miss = (_score(weights, x) - labels[pattern]) * n / total
            for name in x:
                slope[name] += miss
        for name, g in slope.items():
            weights[name] -= 2.0 * (g + l2 * weights[name])
    return dict(weights)


def _score(weights: dict[str, float], x: dict[str, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights.get(name, 0.0) * v for name, v in x.items())))))


@dataclass(frozen=True)
class SpanModel:
    estimate: Estimate
    weights: dict[str, float]
    accepted: tuple[str, ...]  #: vote patterns of extra kinds whose spans count as personal

    def score(self, pattern: str) -> float:
        return _score(self.weights, _inputs(pattern))


def fit(candidates: DataFrame, threshold: float = THRESHOLD) -> SpanModel:
    """Model from rows of (votes: array of struct(span, pattern)); empty without candidates.

    A pattern is accepted if the classifier scores it at ``threshold`` or more.
    """
    patterns = candidates.select(F.explode("votes.pattern").alias("pattern"))
    # One row per kind, combination of votes (3^4) and of features (4 * 5 * 4 * 4) at most.
    counts = {r.pattern: r.n for r in patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    estimate = expectation_maximisation(counts)
    weights = train_classifier(counts, estimate.posterior)
    extra = [p for p in sorted(counts) if p.split(":")[0] in EXTRA]
    return SpanModel(estimate, weights, tuple(p for p in extra if _score(weights, _inputs(p)) >= threshold))


def decided(base: Column, votes: Column, model: SpanModel) -> Column:
    """Base spans and the accepted others that overlap none of them, by kind then start."""
    if not model.accepted:
        return base
    accepted = F.create_map(*(x for p in model.accepted for x in (F.lit(p), F.lit(True))))
    extra = F.filter(votes, lambda v: v.span.kind.isin(*EXTRA) & F.coalesce(accepted[v.pattern], F.lit(False)))
    return F.concat(base, S.free_of(F.transform(extra, lambda v: v.span), base))


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` spans and ``votes`` on all candidate spans. A null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumns({"_base": base_hits(text), "_extra": extra_hits(text)})
    return found.withColumns({"base": S.located(F.col("_base")), "votes": voted(F.concat("_base", "_extra"))}).drop("_base", "_extra")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` spans and ``found`` spans (base ones and those of the method).

    Rows are scanned once; spans, without what they hold, go to the shared folder and the model
    comes from their votes. A null text has no spans, repeated rows have equal ones, an empty
    table gives none; ids may be null or repeat, and other columns are left out.
    """
    rows = written(candidates(docs.select(id_col, text_col), text_col).select(id_col, "base", "votes"), "personal-spans")
    return rows.select(id_col, "base", decided(F.col("base"), F.col("votes"), fit(rows)).alias("found"))


def redact_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each personal span of the text replaced by its kind in brackets.

    Other columns, and texts without spans, stay as they are. Texts are scanned twice: to fit the
    model, and to redact beside the text, so no text is shuffled.
    """
    model = fit(candidates(docs.select(text_col), text_col).select("votes"))
    # The row goes along as one struct, so that no column of it can clash with those made here.
    rows = candidates(docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text")))
    spans = S.disjoint(S.by_start(decided(F.col("base"), F.col("votes"), model), KINDS))
    text = F.col("text")
    clean = F.when(text.isNull(), text).otherwise(S.redact(text, F.col("spans")))
    done = rows.withColumn("spans", spans).withColumn("clean", clean)
    return done.select(*(F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, S.digest(F.col("base")).alias("base_sha256"), S.listed(F.col("found")).alias("spans"))
