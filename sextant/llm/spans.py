"""Spans of regular expressions in texts, by DataFrame functions alone.

A span is struct(kind, start, end): code points, end exclusive. Splitting a text at a
pattern gives what lies between the matches and extracting gives the matches; running
sums of their lengths are the positions. Both scan alike: leftmost, not overlapping.

Folds over a text's n matches go in blocks of about sqrt(n), since each step of a fold copies
what it has gathered: a text of very many matches costs n * sqrt(n), not n * n.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:string,start:int,end:int>>"
HITS = "array<struct<kind:string,start:int,end:int,hit:string,before:string,after:string>>"
AROUND = 40  #: code points of context beside a match, up to its kind's neighbouring match


def none() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """The array in pieces of about the root of its length; no pieces if it is empty."""

    def cut(a: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda b: F.slice(a, b * width + 1, width))

    return let(items, cut)


def running_sum(sizes: Column) -> Column:
    """Sums of the array<int> up to and with each element."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc.at + x).alias("at"), F.concat(acc.out, F.array(acc.at + x)).alias("out"))

    within = F.transform(_blocks(sizes), lambda b: F.aggregate(b, start, add, lambda acc: acc.out))

    def shifted(blocks: Column) -> Column:
        ends = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), start, add, lambda acc: acc.out)
        before = F.concat(F.array(F.lit(0)), ends)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), before.alias("s")), lambda z: F.transform(F.coalesce(z.b, F.array().cast("array<int>")), lambda x: x + z.s)))

    return let(within, shifted)


def find_hits(text: Column, pattern: str, kind: str, guard: Column | None = None, context: bool = False) -> Column:
    """All spans of ``pattern`` in ``text`` (not null), in order, with the text of the match and, with
    ``context``, the AROUND code points before and after it, up to the neighbouring matches.

    The pattern must not match the empty string. ``guard`` may rule texts out cheaply; texts
    without a match cost one scan.
    """
    beside = lambda gap, at: F.substring(gap, at, AROUND) if context else F.lit("")

    def found(gaps: Column, hits: Column) -> Column:
        sizes = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit))
        parts = F.arrays_zip(gaps.alias("gap"), F.slice(gaps, 2, F.size(hits)).alias("next"), hits.alias("hit"), running_sum(sizes).alias("end"))
        one = lambda p: F.struct(
            F.lit(kind).alias("kind"), (p["end"] - F.length(p.hit)).alias("start"), p["end"].alias("end"), p.hit.alias("hit"),
            beside(p.gap, -AROUND).alias("before"), beside(p.next, 1).alias("after"),
        )
        return F.transform(F.slice(parts, 1, F.size(hits)), one)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits")), lambda s: found(s.gaps, s.hits)).cast(HITS)
    wanted = F.regexp_like(text, F.lit(pattern))
    return F.when(wanted if guard is None else guard & wanted, spans).otherwise(F.array().cast(HITS))


def located(hits: Column) -> Column:
    """The spans alone, without the matched text."""
    return F.transform(hits, lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s["end"].alias("end")))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def listed(spans: Column) -> Column:
    """`kind:start:end` of the spans as they come, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> Column:
    return F.sha2(listed(spans).cast("binary"), 256)


def by_start(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Sorted by start, then by kind as listed, then by end."""
    order = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("a"), order[s.kind].alias("b"), s["end"].alias("c"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k.s)


def free_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``."""
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b.start < s["end"]) & (s.start < b["end"])))


def disjoint(spans: Column) -> Column:
    """Spans sorted by start, without those that overlap an earlier one that stays."""

    def step(acc: Column, s: Column) -> Column:
        grown = F.struct(s["end"].alias("at"), F.concat(acc.out, F.array(s)).alias("out"))
        return F.when(s.start >= acc.at, grown).otherwise(acc)

    def block(acc: Column, b: Column) -> Column:
        kept = F.aggregate(b, F.struct(acc.at.alias("at"), none().alias("out")), step)
        return let(kept, lambda k: F.struct(k.at.alias("at"), F.concat(acc.out, F.array(k.out)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return F.aggregate(_blocks(spans), start, block, lambda acc: F.flatten(acc.out))


def redact(text: Column, spans: Column) -> Column:
    """The text with each of the disjoint, sorted ``spans`` replaced by `[KIND]`.

    The text is cut at blocks of spans first, as finding a place in a text takes reading up to it.
    """

    def cleaned(marks: Column) -> Column:
        """Of array<struct<span, from>>, ``from`` being the end of the span before."""

        def of_block(b: Column) -> Column:
            low, high = b[0]["from"], F.element_at(b, -1).span["end"]

            def of_part(part: Column) -> Column:
                kept = lambda m: F.substring(part, m["from"] - low + 1, m.span.start - m["from"])
                return F.array_join(F.transform(b, lambda m: F.concat(kept(m), F.lit("["), F.upper(m.span.kind), F.lit("]"))), "")

            return let(F.substring(text, low + 1, high - low), of_part)

        rest = F.substring(text, F.element_at(marks, -1).span["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(_blocks(marks), of_block), ""), rest)

    def marked(s: Column) -> Column:
        ends = F.concat(F.array(F.lit(0)), F.transform(s, lambda x: x["end"]))
        return F.zip_with(s, F.slice(ends, 1, F.size(s)), lambda x, e: F.struct(x.alias("span"), e.alias("from")))

    return F.when(F.size(spans) > 0, let(let(spans, marked), cleaned)).otherwise(text)
