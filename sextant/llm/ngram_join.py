"""Exact Jaccard self-join of documents on word shingles by PartEnum signatures.

Equal shingle sets form one class, and everything after works on classes.

Signatures. Sizes are dealt into bands so wide that linked sets lie in one band or in
neighbours; a set joins the next band too if a partner could lie there. Sets linked
within a band differ in at most k elements, k from the band's largest size. The hashed
feature domain is dealt into n1 partitions of n2 parts each. Of the n1 partitions at
least n1 - k // (k2 + 1) hold k2 differences or fewer; for each partition all subsets of
n2 - k2 parts are enumerated, and their contents hashed to signatures, so any linked sets
share one signature for each of those partitions. ``levels`` picks (n2, k2) for each band from
its sizes and the threshold: all pairs of three parts, with a difference a partition, where
these pairs are seldom empty, and single partitions without differences where they would be.

With ``slack`` more partitions than needed, linked sets share several signatures. Empty
subsets say nothing and are left out where the guarantee allows it, and a set that
shares fewer signatures than guaranteed has no partner and drops out. Both rules lose no link.

Links. The sets of a bucket are compared with a pivot, exactly, and links are closed to
components; pivots leave their buckets, buckets that then hold one component are done, and the others
get new pivots for some rounds. What then still shares a bucket across components is compared in blocks of bounded
sets and elements, so that pairs are neither written nor shuffled. Pairs inside a component
are never needed.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Bitmap, discard, hot_keys, join_hot, release_shuffles, table, text_slices, with_members, written

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
SIGNATURE_BITS = 48  #: chance agreement only adds candidates; fewer bytes to shuffle
MOST_SEEN = 1 << 20  #: set keys a task remembers so as not to emit a set twice
RARE = 32  #: elements of a block in this many sets or fewer are counted pair by pair, others by a matrix product


@dataclass(frozen=True)
class JoinParams:
    shingle_words: int = 5
    percent: int = 80  #: two sets link when 100 * intersection >= percent * union
    slack: float = 0.25  #: partitions beyond the needed ones, as a share
    parts: int | None = None  #: n2, second-level parts of a partition; None: picked by ``levels``
    part_differences: int | None = None  #: k2, differences that a partition may hold; None: picked by ``levels``
    rounds: int = 3  #: rounds of pivots before blocks are compared
    block: int = 256  #: sets of a block
    block_elements: int = 1 << 20  #: elements of a block, more only if a single set has more
    passes: int = 4  #: shares of the signatures that are shuffled one after another, to save disk

    def signatures(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """For each band of the set: (signatures that a partner must share at least, signatures)."""
        return signatures(s, self)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text.

    A-Z are lower-cased; words are runs of characters other than space and \\t to \\r. With fewer
    words than ``width`` the whole sequence is one shingle; without words the set is empty.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    acc = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15)) + h[i : len(h) - width + 1 + i]
    return np.unique(mix(acc + np.uint64(width)))


def set_key(s: np.ndarray) -> int:
    """Signed 64-bit identity of a set; an empty set has none and gets 0."""
    if not len(s):
        return 0
    x = int(mix(np.array([mix(s ^ _M1).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64))[0])
    return (x or 1) - (1 << 64) * (x >= 1 << 63)


def bands(percent: int, size: int) -> list[tuple[int, int]]:
    """(band, largest size in it) for each band that a set of ``size`` joins."""
    band, low, high = 0, 1, 1
    while size > high:
        band, low = band + 1, high + 1
        high = max(low, low * 10_000 // (percent * percent))
    joined = [(band, high)]
    if size * 100 >= percent * (high + 1):
        low = high + 1
        joined.append((band + 1, max(low, low * 10_000 // (percent * percent))))
    return joined


def partitions(k: int, k2: int, slack: float) -> tuple[int, int]:
    """(n1, spare): first-level partitions for k differences, and how many of them are beyond need."""
    bad = k // (k2 + 1)
    spare = max(1, -(-int(slack * 100) * bad // 100))
    return bad + 1 + spare, spare


@lru_cache(maxsize=4096)
def levels(params: JoinParams, largest: int) -> tuple[int, int]:
    """(n2, k2) of the band whose largest size this is: (3, 1) where, at the band's least size, fewer
    than one partition in a hundred has two empty parts, otherwise (1, 0)."""
    if params.parts is not None and params.part_differences is not None:
        return params.parts, params.part_differences
    k = (100 - params.percent) * 2 * largest // (100 + params.percent)
    n1, _ = partitions(k, 1, params.slack)
    least = largest * params.percent * params.percent / 10_000
    return (3, 1) if 3 * math.exp(-2 * least / (3 * n1)) < 0.01 else (1, 0)


def signatures(s: np.ndarray, params: JoinParams) -> list[tuple[int, np.ndarray]]:
    """For each band of the set: (signatures that a partner must share at least, signatures)."""
    out = []
    for band, largest in bands(params.percent, len(s)):
        k = (100 - params.percent) * 2 * largest // (100 + params.percent)
        if k == 0:
            continue  # linked sets are equal
        n2, k2 = levels(params, largest)
        subsets = list(itertools.combinations(range(n2), n2 - k2))
        n1, spare = partitions(k, k2, params.slack)
        at = (mix(s + np.uint64(band)) % np.uint64(n1 * n2)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        used, first = np.unique(at[order], return_index=True)
        content, count = np.zeros(n1 * n2, np.uint64), np.bincount(at, minlength=n1 * n2).reshape(n1, n2)
        content[used] = np.add.reduceat(mix(s ^ _M2)[order], first)
        content = content.reshape(n1, n2)
        base = np.arange(n1, dtype=np.uint64) * np.uint64(len(subsets)) + np.uint64(band << 40)
        sigs = np.stack([mix(content[:, list(x)].sum(axis=1, dtype=np.uint64) + mix(base + np.uint64(i))) for i, x in enumerate(subsets)], axis=1) >> np.uint64(64 - SIGNATURE_BITS)
        empty = np.stack([count[:, list(x)].sum(axis=1) == 0 for x in subsets], axis=1)
        weak = int(empty.any(axis=1).sum())
        if weak <= spare:
            out.append((1 + spare - weak, sigs[~empty]))
        else:
            out.append((1, sigs.ravel()))
    return out


def _signed(docs: DataFrame, id_col: str, text_col: str, params: JoinParams) -> DataFrame:
    """(id, text_hash, row, n_shingles, key, needs, sigs_0, sigs_1, ...) of every row; row is its number.

    ``needs`` has an entry per band of the set: how many signatures a partner there shares at
    least. ``sigs_p`` has the band's signatures of pass p, so that a pass reads its own only.
    Signatures stand for the set: those of a set that the task has signed before are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        seen: set[int] = set()
        for batch in text_slices(batches, 1):
            sets = [shingles(t.as_py(), params.shingle_words) for t in batch.column(1)]
            keys = [set_key(s) for s in sets]
            found = []
            for s, key in zip(sets, keys, strict=True):
                found.append([] if key in seen else params.signatures(s))
                seen.add(key)
            if len(seen) > MOST_SEEN:
                seen.clear()
            per_set = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
            flat = [x for bands_ in found for _, x in bands_]
            turns = [x % np.uint64(params.passes) for x in flat]
            columns = []
            for p in range(params.passes):
                part = [x[t == p].view(np.int64) for x, t in zip(flat, turns, strict=True)]
                at = pa.array(np.cumsum([0, *map(len, part)], dtype=np.int32))
                values = pa.array(np.concatenate(part) if part else np.zeros(0, np.int64))
                columns.append(pa.ListArray.from_arrays(per_set, pa.ListArray.from_arrays(at, values)))
            needs = pa.array([need for bands_ in found for need, _ in bands_], pa.int32())
            arrays = [
                batch.column(0),
                batch.column(2),
                pa.array(np.arange(row, row + len(sets))),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(keys, pa.int64()),
                pa.ListArray.from_arrays(per_set, needs),
                *columns,
            ]
            row += len(sets)
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "text_hash", "row", "n_shingles", "key", "needs", *(f"sigs_{p}" for p in range(params.passes))])

    id_type = docs.schema[id_col].dataType.simpleString()
    parts = ", ".join(f"sigs_{p} array<array<long>>" for p in range(params.passes))
    rows = docs.select(id_col, text_col, _text_hash(text_col).alias("text_hash"))
    return rows.mapInArrow(run, f"{id_col} {id_type}, text_hash long, row long, n_shingles long, key long, needs array<int>, {parts}")


def _sets(docs: DataFrame, text_col: str, members: DataFrame, params: JoinParams) -> DataFrame:
    """(key, elements) of the sets among ``members`` (key), and a few besides.

    The texts of other documents are left out by a ``Bitmap``, so no text is shuffled.
    """
    bitmap = Bitmap(members, "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in text_slices(batches, 0):
            keys, sets = [], []
            every = [shingles(text.as_py(), params.shingle_words) for text in batch.column(0)]
            every_key = np.array([set_key(s) for s in every], np.int64)
            for s, key, wanted in zip(every, every_key.tolist(), bitmap.may_hold(every_key).tolist(), strict=True):
                if len(s) and wanted and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s.view(np.int64))
            if len(seen) > MOST_SEEN:
                seen.clear()
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "elements"])

    found = docs.select(text_col).mapInArrow(run, "key long, elements array<long>")
    return found.groupBy("key").agg(F.first("elements").alias("elements"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) for ``pairs`` (a, b, p), the pivot p being one of the two, by exact intersections."""
    pivots = sets.select(F.col("key").alias("p"), F.col("elements").alias("ep"))
    others = sets.select(F.col("key").alias("o"), F.col("elements").alias("eo"))
    common = F.size(F.array_intersect("ep", "eo"))
    linked = common * 100 >= (F.size("ep") + F.size("eo") - common) * percent
    pairs = pairs.withColumn("o", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    return join_hot(pairs, pivots, "p", F.col("o")).join(others, "o").select("a", "b", linked.alias("linked"))


def _close(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _merged(links: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels`` after joining the components that ``links`` (a, b) connect."""
    of = lambda end: labels.select(F.col("key").alias(end), F.col("label").alias(f"l{end}"))
    links = links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    found = components(links)
    joined = found.select(F.col("key").alias("label"), F.col("label").alias("new"))
    merged = written(labels.join(joined, "label", "left").select("key", F.coalesce("new", "label").alias("label")), "join-labels")
    discard(found)
    return merged


def open_rows(buckets: DataFrame, labels: DataFrame, turn: int, hot: list[tuple[int, int]]) -> DataFrame:
    """(bucket, key, n, rank, label, p, pn, pl): the rows of ``buckets`` (bucket, key, n, rank) that hold several
    components, with the bucket's pivot p, its size and label.

    The first pivot is the row of highest rank, later ones come from the bucket's smallest component. Once
    a pivot is compared with its bucket it may leave it: a bucket whose other rows are of one component
    is done, as any other pair of its has been compared. ``hot``: see ``join_hot``.
    """
    labelled = buckets.join(labels, "key")
    own = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("rank", "key", "n", "label")).alias("best"))
    first = F.struct(F.col("best.rank")) if turn == 0 else F.struct(-F.col("m"), F.col("best.rank"))
    state = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("components"), F.max_by("best", first).alias("p")).where("components > 1")
    pivots = state.select("bucket", F.col("p.key").alias("p"), F.col("p.n").alias("pn"), F.col("p.label").alias("pl"))
    return join_hot(labelled, pivots, "bucket", F.col("key"), hot)


def star_pairs(rows: DataFrame, checked: list[DataFrame], percent: int) -> DataFrame:
    """(a, b, p): pairs of a pivot p and another row of its bucket, in different components and of sizes that can
    link, that aren't among ``checked``."""
    star = rows.where((F.col("label") != F.col("pl")) & _close("n", "pn", percent))
    pairs = star.groupBy(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b")).agg(F.min("p").alias("p"))
    for done in checked:
        pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    return pairs


def _prefixes(rows: DataFrame, hot: list[tuple[int, int]]) -> DataFrame:
    """Of the open ``rows`` those that are still needed.

    Two sets that link and aren't compared yet share ``need`` open buckets or more. So a set in fewer has no
    partner, and of the others each can do without its last need - 1 buckets in an order common to
    all sets, the least crowded first: the first one that two partners share stays with both.
    """
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    sized = join_hot(rows.select("bucket", "key", "n", "pos", "need", "rank"), size, "bucket", F.col("key"), hot)
    own = Window.partitionBy("key", "pos")  # a set's own signatures in a band
    counted = sized.withColumns({"_held": F.count(F.lit(1)).over(own), "_at": F.row_number().over(own.orderBy("m", "bucket"))})
    return counted.where(F.col("_at") <= F.col("_held") - F.col("need") + 1).drop("m", "_held", "_at")


def _link(buckets: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """(key, label): components of the sets of ``buckets`` (bucket, key, n, pos, need) under exact links.

    The first pivot of a bucket is its most central set, the one whose buckets are fullest:
    in a group of copies, that is one close to the original.
    """
    sets = written(sets, "join-sets")
    hot = hot_keys(buckets, "bucket")
    size = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    central = join_hot(buckets, size, "bucket", F.col("key"), hot).groupBy("key").agg(F.sum("m").alias("rank"))
    plain, buckets = buckets, written(buckets.join(central, "key"), "join-central")
    discard(plain)
    labels = written(buckets.select("key", F.col("key").alias("label")).distinct(), "join-labels")
    checked: list[DataFrame] = []
    for turn in range(params.rounds + 1):
        release_shuffles(buckets.sparkSession)
        rows = written(open_rows(buckets, labels, turn, hot), "join-open")
        discard(buckets)
        if turn == params.rounds:
            break
        pairs = written(star_pairs(rows, checked, params.percent), "join-pairs")
        found = written(_verified(pairs, sets, params.percent), "join-checked")
        discard(pairs)
        checked.append(found)
        old, labels = labels, _merged(found.where("linked"), labels)
        discard(old)
        buckets = rows.where(F.col("key") != F.col("p")).select("bucket", "key", "n", "pos", "need", "rank")
        buckets.written_path = rows.written_path
    buckets = written(_prefixes(rows, hot), "join-prefixes")
    groups = open_rows(buckets, labels, 0, hot).select(F.col("p").alias("grp"), "key", "label", "n").distinct()
    rest = written(groups, "join-rest")
    discard(buckets)
    discard(rows, *checked)
    release_shuffles(rest.sparkSession)
    found = written(_across(rest, sets, params), "join-across")
    merged = _merged(found, labels)
    discard(sets, labels, rest, found)
    return merged


def _tasks(rest: DataFrame, params: JoinParams) -> DataFrame:
    """(grp, li, bi, lj, bj, first, key, label): the rows of ``rest`` for each comparison of two blocks.

    A group that exceeds a block is dealt into size levels, each so wide that linked sets lie in
    one level or in neighbours, and a level into blocks of about ``params.block`` sets and
    ``params.block_elements`` elements. Blocks meet those of their own and of the next level;
    ``first`` marks the rows of the block (li, bi).
    """
    width = math.log(100 / params.percent) * 1.0001 if params.percent < 100 else 1e9
    blocks = lambda m, e: F.greatest(F.ceil(m / params.block), F.ceil(e / params.block_elements)).cast("int")
    rest = rest.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / width).cast("int"))
    sizes = rest.groupBy("grp", "level").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("e"))
    # A group has as many levels as sizes have multiples of the threshold: some hundred.
    entries = F.map_from_entries(F.collect_list(F.struct("level", blocks(F.col("m"), F.col("e")))))
    groups = sizes.groupBy("grp").agg(entries.alias("counts"), blocks(F.sum("m"), F.sum("e")).alias("all"))
    groups = groups.select("grp", F.when(F.col("all") == 1, F.create_map(F.lit(0), F.lit(1))).otherwise(F.col("counts")).alias("counts"), "all")
    dealt = join_hot(rest, groups, "grp", F.col("key"))
    dealt = dealt.withColumn("level", F.when(F.col("all") == 1, 0).otherwise(F.col("level")))
    of = lambda level: F.coalesce(F.element_at("counts", level), F.lit(0))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), of(F.col("level"))).cast("int"))
    level, block = F.col("level"), F.col("block")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda li, bi, lj, bj, first: F.struct(li.alias("li"), bi.alias("bi"), lj.alias("lj"), bj.alias("bj"), first.alias("first"))
    within = F.transform(numbers(of(level)), lambda o: meet(level, F.least(block, o), level, F.greatest(block, o), block <= o))
    below = F.transform(numbers(of(level - 1)), lambda o: meet(level - 1, o, level, block, F.lit(False)))
    above = F.transform(numbers(of(level + 1)), lambda o: meet(level, block, level + 1, o, F.lit(True)))
    return dealt.select("grp", "key", "label", F.explode(F.concat(within, below, above)).alias("t")).select("grp", "t.*", "key", "label")


def overlaps(owner: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """(n, n) sizes of the intersections of n sets, of which set ``owner[i]`` has element ``code[i]``.

    Elements of RARE sets or fewer add up pair by pair, the others by products of incidence
    matrices, a slice of elements after the other.
    """
    alike = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    seen = np.diff(np.append(starts, len(code)))
    often = np.repeat(seen > RARE, seen)
    a, c = owner[~often], code[~often]
    for step in range(1, RARE):
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        pairs = np.bincount(a[same] * n + a[same + step], minlength=n * n).reshape(n, n)
        alike += pairs + pairs.T
    a, c = owner[often], np.repeat(np.arange((seen > RARE).sum()), seen[seen > RARE])
    width = 4096
    for low in range(0, int(c[-1]) + 1 if len(c) else 0, width):
        inside = slice(*np.searchsorted(c, [low, low + width]))
        x = np.zeros((n, width), np.float32)
        x[a[inside], c[inside] - low] = 1
        alike += x @ x.T
    return alike


def _across(rest: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): links across labels within each group of ``rest`` (grp, key, label, n), enough of
    them to connect what they connect.

    A task compares two blocks, see ``_tasks``: pairs are neither shuffled nor kept, and no task
    holds more than two blocks.
    """
    wanted = with_members(sets, rest.select("key").distinct(), F.col("key"))
    rows = _tasks(rest, params).join(wanted, "key").select("grp", "li", "bi", "lj", "bj", "first", "key", "label", "elements")
    percent = params.percent

    def compare(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        keys, labels, first = (part.column(c).to_numpy() for c in ("key", "label", "first"))
        lists = part.column("elements").combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        sizes = np.diff(offsets)
        order = np.argsort(flat)
        flat = flat[order]
        owner = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)[order]
        del order
        again = flat[1:] == flat[:-1]
        shared = np.concatenate([again, [False]]) | np.concatenate([[False], again]) if len(flat) else np.zeros(0, bool)
        code = np.cumsum(np.concatenate([[True], ~again]), dtype=np.int32)[shared] if len(flat) else np.zeros(0, np.int32)
        owner = owner[shared].astype(np.int64)
        del flat, again, shared
        alike = overlaps(owner, code, len(keys)).astype(np.float64)
        union = sizes[:, None] + sizes[None, :] - alike
        linked = (100 * alike >= percent * union) & (labels[:, None] != labels[None, :])
        if not first.all():
            linked &= first[:, None] != first[None, :]
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        out = []
        for a, b in np.argwhere(np.triu(linked, 1)):
            la, lb = root(int(labels[a])), root(int(labels[b]))
            if la != lb:
                parent[la] = lb
                out.append((int(keys[a]), int(keys[b])))
        ends = list(zip(*out, strict=True)) if out else [[], []]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    return rows.groupBy("grp", "li", "bi", "lj", "bj").applyInArrow(compare, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every end of ``links`` (a, b): the least key of its component.

    Each key goes up to its least neighbour if that is less, and on along such steps, which jumping halves, to a key without one; then
    links join what their ends went up to, and those within one are gone, until none is left. State is written to the shared folder each round.
    """
    ends = links.select(F.col("a").alias("key")).union(links.select(F.col("b").alias("key"))).distinct()
    labels = written(ends.select("key", F.col("key").alias("label")), "join-labels")
    edges = written(_between(links, F.col("a"), F.col("b")), "join-edges")
    while edges.limit(1).count():
        up = written(edges.groupBy(F.col("b").alias("key")).agg(F.min("a").alias("up")), "join-up")
        while True:
            over = up.select(F.col("key").alias("up"), F.col("up").alias("far"))
            new = up.join(over, "up", "left").select("key", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("changed"))
            new = written(new, "join-up")
            discard(up)
            up = new
            if not new.where("changed").limit(1).count():
                break
        of = lambda end: up.select(F.col("key").alias(end), F.col("up").alias(f"u{end}"))
        moved = edges.join(of("b"), "b").join(of("a"), "a", "left")  # b has a less neighbour
        fewer = written(_between(moved, F.coalesce("ua", "a"), F.col("ub")), "join-edges")
        merged = written(labels.join(of("label"), "label", "left").select("key", F.coalesce("ulabel", "label").alias("label")), "join-labels")
        discard(edges, labels, up)
        edges, labels = fewer, merged
    discard(edges)
    return labels


def _between(links: DataFrame, a: Column, b: Column) -> DataFrame:
    """(a, b), a < b: what ``links`` link, once."""
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, params: JoinParams) -> DataFrame:
    """Per row: id, text_hash, n_shingles, label of the component (null without words) and its least id."""
    signed = written(_signed(docs, id_col, text_col, params), "join-signed")
    classes = written(signed.select(id_col, "text_hash", "n_shingles", "key"), "join-classes")
    # Signatures are shuffled with a short number: twice the row's, plus the band's position.
    hot = []
    for p in range(params.passes):
        banded = signed.select("row", F.posexplode(f"sigs_{p}").alias("pos", "sigs"))
        rows = banded.select((F.col("row") * 2 + F.col("pos")).alias("at"), F.explode("sigs").alias("bucket"))
        shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
        hot.append(written(rows.join(shared, "bucket"), "join-hot"))
        del banded, rows, shared
        release_shuffles(docs.sparkSession)
    per_set = reduce(DataFrame.union, hot).groupBy("at").agg(F.collect_set("bucket").alias("buckets"))
    info = signed.select("row", "key", F.col("n_shingles").alias("n"), F.posexplode("needs").alias("pos", "need"))
    info = info.select((F.col("row") * 2 + F.col("pos")).alias("at"), "key", "n", "pos", "need")
    buckets = per_set.join(info, "at").where(F.size("buckets") >= F.col("need")).select(F.explode("buckets").alias("bucket"), "key", "n", "pos", "need").distinct()
    buckets = written(buckets, "join-buckets")
    del per_set, info
    discard(signed, *hot)
    release_shuffles(docs.sparkSession)
    labels = _link(buckets, _sets(docs, text_col, buckets.select("key").distinct(), params), params)

    least = classes.where("n_shingles > 0").groupBy("key").agg(F.min(id_col).alias("least"))
    named = least.join(labels, "key", "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    named = written(named, "join-named")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    by_key = named.join(names, "label").select("key", "label", "component_id")
    linked = join_hot(classes.where("n_shingles > 0"), by_key, "key", F.concat_ws(":", F.col(id_col).cast("string"), "text_hash"))
    linked = linked.select(id_col, "text_hash", "n_shingles", "label", "component_id")
    alone = classes.where("n_shingles = 0").select(id_col, "text_hash", "n_shingles", F.lit(None).cast("long").alias("label"), F.col(id_col).alias("component_id"))
    return linked.union(alone)


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    params: JoinParams = JoinParams(),
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id reachable by links, its own included).

    Null or wordless texts have an empty set and link with nothing. Repeated rows and equal
    sets are one class, and ids may repeat or be null (a component of null ids only has a null id). An
    empty table gives an empty result; other columns are left out.
    """
    return _components(docs, id_col, text_col, params).select(id_col, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component one row stays, that of the least id
    (null ids last), on ties of the least text hash. Rows without words link with nothing and all stay."""
    found = written(_components(docs, id_col, text_col, params), "join-found")
    own = F.struct(F.col(id_col).isNull().alias("unknown"), F.col(id_col).alias("id"), F.col("text_hash").alias("h"))
    first = found.where("label is not null").groupBy("label").agg(F.min(own).alias("f")).select(F.col("f.id").alias("_id"), F.col("f.h").alias("_h"))
    texts = found.where("label is not null").groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])
    first, texts = written(first, "join-first"), written(texts, "join-texts")
    dropped = texts.join(first, same(texts, first), "left_anti").select("_id", "_h")
    repeated = texts.where("_n > 1").join(first, same(texts, first), "left_semi").select("_id", "_h")
    hashed = docs.withColumns({"_id": F.col(id_col), "_h": _text_hash(text_col)})
    kept = hashed.join(dropped, same(hashed, dropped), "left_anti")
    if repeated.limit(1).count():
        once = kept.join(repeated, same(kept, repeated), "left_semi").groupBy("_id", "_h").agg(F.first(F.struct(*docs.columns)).alias("row"))
        kept = kept.join(repeated, same(kept, repeated), "left_anti").select(*docs.columns).union(once.select("row.*"))
    return kept.select(*docs.columns)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), params=JoinParams(shingle_words=3, percent=90))


#: Plain form: all pairs that share a shingle, and all that is reachable.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
