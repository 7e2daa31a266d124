"""Document fingerprints by a randomised edit embedding.

A text is walked along: step j emits the character under the pointer and advances the
pointer if a random bit of (j, character) is set, until the text's end. All texts share the
bits, so walks over similar texts fall into step again after an edit, and edit distance becomes
Hamming distance of what they emit. A fingerprint keeps a sample of the steps: about
``SAMPLES`` of the first 2^level. The level grows with the text's length, to three steps a
character or more, and further in the rare case that the walk hasn't reached the end by then. Samples
are nested: those of a higher level are among those of a lower one, so any two fingerprints
compare on the steps they share.

Near duplicates: what a walk meets at some steps, or bands of a fingerprint's samples, are the keys of
buckets. The texts of a bucket are compared with pivots by fingerprint, those that stay unlinked with each
other in blocks, and pairs that are alike are verified by edit distance.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ngram_join import JoinParams, _merged, _tasks, open_rows, star_pairs
from .shared import discard, hot_keys, join_hot, release_shuffles, spread_keys, table, text_slices, with_members, written

SAMPLES = 256
LEAST_LEVEL = 6
CYCLE = 1 << 62  #: steps for which there are random bits: more than any text takes
SEED = 0x5EED
END = 255  #: class of the end of a text, on which a walk rests
BUFFER_CHARS = 16_000_000  #: characters walked at once
BUFFER_ROWS = 8192  #: rows walked at once
PAIRS = 1 << 18  #: pairs of bags tested at once
VERIFIED = 512  #: pairs of texts compared at once
BAND_CELLS, BAND_CHARS = 1 << 15, 1 << 22  #: diagonals and characters of pairs that are compared together
STAGES = 16  #: lengths, or up to twice as many, of ends of a pair that are compared by their neighbouring characters
KIND_BITS = 9  #: of the number of kinds of neighbouring characters there
RUN = 128  #: characters of long equal runs compared at once
BLOCK_BYTES = 8 << 20  #: of texts in a block of neighbours, on average
BLOCK_ROWS = 1 << 16  #: documents of a block, on average and at most
MOST_BLOCKS = 20_000  #: beyond, blocks grow; they are walked as streams
CELL = 64  #: characters of a text that are walked before the window of steps is looked at
LEAP_STEPS = 4096  #: steps by which a window goes on
NEVER = (1 << 31) - 1  #: a step that no walk takes
WALK_CHARS = 1 << 23  #: characters of texts that walk together, more only if a single text has more
LEAST_BAG_BITS, MOST_BAG_BITS = 5, 12  #: of the number of classes of neighbours in a bag
LEAST_LENGTH = 600  #: of the texts of a class that is filed by passages; of shorter ones an edit may cost most of the walk
SITES = 20  #: steps of a walk at which the passage under the pointer is a key
PASSAGE = 24  #: characters of a passage, a multiple of 8
PASSES = 4  #: shares of the buckets that are shuffled one after another, to save disk
PIVOT_ROUNDS = 2  #: rounds of pivots before the texts of a bucket are compared in blocks


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Bits:
    """The random bits: one 64-bit hash of (step // 64, class) holds those of 64 steps."""

    @staticmethod
    def words(low: int, high: int, classes: np.ndarray) -> np.ndarray:
        """(high - low, classes) words of the steps from 64 * low to 64 * high."""
        cells = np.arange(low, high, dtype=np.uint64)[:, None] * np.uint64(256) + classes.astype(np.uint64)
        return _splitmix(cells ^ np.uint64(SEED << 40))

    def __getitem__(self, at: tuple[int, int]) -> int:
        word = int(self.words(at[0] >> 6, (at[0] >> 6) + 1, np.array([at[1]]))[0, 0])
        return 0 if at[1] == END else word >> (at[0] & 63) & 1


class Leaps:
    """For each class and step, how many steps on a pointer that is on such a character arrives at the next one: past the next set bit."""

    KEPT = 1 << 17  #: steps that are kept once made, as every text begins there

    def __init__(self) -> None:
        self.kept = np.zeros((END + 1, self.KEPT), np.uint8)
        self.made = 0

    @staticmethod
    def of(low: int, high: int) -> np.ndarray:
        """(classes, steps) of the steps from 64 * low to 64 * high. Two words without a bit in a row don't occur."""
        words = Bits.words(low, high + 2, np.arange(END + 1)).T
        ahead = (np.bitwise_count((words & (~words + np.uint64(1))) - np.uint64(1)) + 1).astype(np.uint8)  # from a block's first step on
        ahead[:, :-1] = np.where(words[:, :-1], ahead[:, :-1], 64 + ahead[:, 1:])
        words, after = words[:, :-2], ahead[:, 1:-1]
        out = np.empty((*words.shape, 64), np.uint8)
        for i in range(63, -1, -1):
            after = after * (~(words >> np.uint64(i)) & np.uint64(1)).astype(np.uint8) + np.uint8(1)
            out[:, :, i] = after
        return out.reshape(len(words), -1)

    def window(self, low: int, high: int) -> tuple[np.ndarray, int]:
        """The steps from ``low`` to ``high`` and some more, and the step that they begin at."""
        if high > self.KEPT:
            return self.of(low >> 6, (high + LEAP_STEPS >> 6) + 1), low & ~63
        while self.made < high:
            self.kept[:, self.made : self.made + LEAP_STEPS] = self.of(self.made >> 6, self.made + LEAP_STEPS >> 6)
            self.made += LEAP_STEPS
        return self.kept, 0


def level_of(n_chars: int) -> int:
    """Least level for a text of so many characters: a walk takes about two steps for each."""
    return max(LEAST_LEVEL, (3 * n_chars).bit_length())


def sampled_steps(level: int) -> np.ndarray:
    """Ascending steps below 2^level that a fingerprint of this level keeps."""
    steps = np.arange(1 << level, dtype=np.uint64)
    limit = min((1 << 64) - 1, (SAMPLES << 64) >> level)
    return np.flatnonzero(_splitmix(steps ^ np.uint64(0xF1A6)) <= np.uint64(limit))


@dataclass
class Stops:
    """Steps at which the walks of the rows from ``low`` to ``high``, those of a class of length, are looked at."""

    steps: list[int]
    low: int
    high: int
    keys: np.ndarray | None = None  #: (steps, rows) of the passages from there on
    whole: np.ndarray | None = None  #: whether the passage lies within the text

    def read(self, flat: np.ndarray, at: np.ndarray, rows: slice) -> None:
        """Take the passages at the places ``at`` (rows, steps) of the pointers of ``rows`` of the class."""
        if self.keys is None:
            shape = (len(self.steps), self.high - self.low)
            self.keys, self.whole = np.zeros(shape, np.uint64), np.zeros(shape, bool)
        chars = np.take(flat, at.T[..., None] + np.arange(PASSAGE), mode="clip")
        self.whole[:, rows] = (chars != END).all(axis=-1)
        keys = np.arange(len(self.steps), dtype=np.uint64)[:, None] + np.zeros(chars.shape[:2], np.uint64)
        words = chars.view("<u8")
        for w in range(words.shape[-1]):
            keys = _splitmix(keys ^ words[..., w])
        self.keys[:, rows] = keys


def _take(keys: list[list[np.ndarray]], rows: list[int], stops: dict[int, Stops]) -> None:
    """Add the keys that ``stops`` of classes have found to those of the texts, row r being of text ``rows[r]``."""
    for c, stop in stops.items():
        found = _splitmix(stop.keys ^ np.array(c).astype(np.uint64)).view(np.int64)
        for column, i in enumerate(rows[stop.low : stop.high]):
            keys[i].append(found[stop.whole[:, column], column])


class Embedder:
    """Fingerprints of many texts; what all walks share is made once a worker."""

    def __init__(self) -> None:
        self.bits, self.leaps = Bits(), Leaps()
        self.steps: dict[int, np.ndarray] = {}
        self.shared_steps: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    @cache
    def shared() -> Embedder:
        """One for all that a worker walks or compares."""
        return Embedder()

    def sampled(self, level: int) -> np.ndarray:
        if level not in self.steps:
            self.steps[level] = sampled_steps(level)
        return self.steps[level]

    def fingerprints(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """(level, samples) of each text: 0 past its end, otherwise 1 to 15 by character."""
        return self._embedded(texts, None)[0]

    def with_passages(self, texts: list[str], distance: float) -> tuple[list[tuple[int, np.ndarray]], list[np.ndarray]]:
        """``fingerprints`` and, of each text, the 64-bit keys of the passages that its walk meets at SITES steps of each of
        its classes of length, if that is of LEAST_LENGTH or more."""
        return self._embedded(texts, distance)

    def passages_back(self, texts: list[str], distance: float) -> list[np.ndarray]:
        """Keys of the passages that walks from the ends of texts meet in their last quarter, at half as many steps: where an edit
        near the start puts the other walks out of step for long, these still meet."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        keys: list[list[np.ndarray]] = [[] for _ in texts]
        stops = _stops([len(texts[i]) for i in order], distance, SITES // 2, 0.45)
        rows = order[: max((s.high for s in stops.values()), default=0)]
        if rows:
            # Walks take two steps a character, give or take few, so no stop is as far from the end as what is left out.
            ends = [texts[i][-(len(texts[i]) * 3 // 10 + 100) :] for i in rows]
            codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)[::-1] for t in ends]
            self._walk(codes, [level_of(len(c)) for c in codes], list(stops.values()), max(max(s.steps) for s in stops.values()) + 1)
            _take(keys, rows, {~c: stop for c, stop in stops.items()})
        return [np.concatenate([np.zeros(0, np.int64), *k]) for k in keys]

    def _embedded(self, texts: list[str], distance: float | None) -> tuple[list[tuple[int, np.ndarray]], list[np.ndarray]]:
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        out: list[tuple[int, np.ndarray]] = [(0, np.zeros(0, np.uint8))] * len(texts)
        keys: list[list[np.ndarray]] = [[] for _ in texts]
        rest = [(level_of(len(c)), i) for i, c in enumerate(codes)]
        stops: dict[int, Stops] = {}
        while rest:
            rest.sort(key=lambda r: (-r[0], -len(codes[r[1]])))
            if distance is not None:  # all texts, by falling length; later walks are the same and go further
                stops = _stops([len(codes[i]) for _, i in rest], distance, SITES, 1.8)
            samples, ended = self._walk([codes[i] for _, i in rest], [level for level, _ in rest], list(stops.values()))
            _take(keys, [i for _, i in rest], stops)
            distance, stops = None, {}
            for (level, i), found in zip(rest, samples, strict=True):
                out[i] = (level, found)
            rest = [(level + 1, i) for (level, i), whole in zip(rest, ended, strict=True) if not whole]
        return out, [np.concatenate([np.zeros(0, np.int64), *k]) for k in keys]

    def _walk(self, codes: list[np.ndarray], levels: list[int] | int, stops: list[Stops] | None = None, most: int = CYCLE) -> tuple[list[np.ndarray], np.ndarray]:
        """Samples of texts by falling level (or of one level) and length, and whether their walks reached the end. ``stops`` get the
        passages at their steps. Walks end at their level's last step, or soon after ``most`` steps."""
        levels = [levels] * len(codes) if isinstance(levels, int) else levels
        chars = np.cumsum([len(c) for c in codes])
        samples: list[np.ndarray] = []
        ended = np.zeros(len(codes), bool)
        low = 0
        while low < len(codes):
            high = max(low + 1, int(np.searchsorted(chars, (chars[low - 1] if low else 0) + WALK_CHARS, "right")))
            lengths = np.array([len(c) for c in codes[low:high]], np.int64)
            cells = lengths // CELL + 1  # each text has an end
            first = np.cumsum(cells) - cells
            flat = np.full((int(cells.sum()), CELL), END, np.uint8)
            plain = flat.reshape(-1)
            for c, cell in zip(codes[low:high], first.tolist(), strict=True):
                plain[cell * CELL : cell * CELL + len(c)] = (c * np.uint32(0x9E3779B1) >> np.uint32(24)) % END
            arrivals = self._arrivals(flat, first, lengths, min(1 << levels[low], most)).reshape(-1)
            starts = first * CELL
            own = [arrivals[at : at + n] for at, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            # The pointer is past as many characters as it has arrived after.
            places = lambda rows, steps: np.stack([np.searchsorted(own[r], steps, "right") for r in rows])
            for level, some in itertools.groupby(range(high - low), key=lambda r: levels[low + r]):
                rows = list(some)
                at = places(rows, self.sampled(level).astype(arrivals.dtype))
                under = plain[starts[rows][:, None] + at]
                samples += list(np.where(under == END, 0, 1 + under % 15).astype(np.uint8))
                ended[low + rows[0] : low + rows[-1] + 1] = [not len(own[r]) or own[r][-1] <= 1 << level for r in rows]
            for stop in stops or ():
                rows = range(max(stop.low, low) - low, min(stop.high, high) - low)
                if rows:
                    at = places(rows, np.array(stop.steps, arrivals.dtype))
                    stop.read(plain, starts[list(rows)][:, None] + at, slice(rows[0] + low - stop.low, rows[-1] + 1 + low - stop.low))
            low = high
        return samples, ended

    def _arrivals(self, flat: np.ndarray, first: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
        """The step at which each character's successor is arrived at, in the cells of ``flat`` (its texts, by falling length, begin at the
        cells ``first``). All walks advance a character at a time, from step to step by ``Leaps``; after ``most`` steps they may end."""
        kind = np.int32 if most < NEVER else np.int64
        out = np.full(flat.shape, np.iinfo(kind).max, kind)
        at = np.zeros(len(first), np.int64)
        held = np.empty((2 * CELL + 2) * len(first), np.int64)
        gaps = np.empty(len(first), np.uint8)
        table, base, end = np.zeros((END + 1, 0), np.uint8), 0, 0
        for cell in range(int(lengths[0]) // CELL + 1 if len(lengths) else 0):
            live = int(np.searchsorted(-lengths, -cell * CELL))  # those that have characters here
            if not live or (least := int(at[:live].min())) >= most:
                break
            index, steps, chars = np.split(held[: (2 * CELL + 2) * live].reshape(-1, live), [1, CELL + 2])
            index, gap = index[0], gaps[:live]
            need = int(at[:live].max()) + 8 * CELL
            while True:
                if least < base or need > end:
                    table, base = self.leaps.window(least, need)
                    end = self.leaps.made if table is self.leaps.kept else base + table.shape[1]
                ahead = table.reshape(-1)
                chars[:] = flat[first[:live] + cell].T
                chars *= table.shape[1]
                np.subtract(at[:live], base, out=steps[0])
                for i in range(CELL):
                    np.add(steps[i], chars[i], out=index)
                    ahead.take(index, out=gap, mode="clip")
                    np.add(steps[i], gap, out=steps[i + 1])
                if steps[-2].max() < end - base:  # else a walk ran out of the window
                    break
                need += LEAP_STEPS
            steps += base
            out[first[:live] + cell] = steps[1:].T
            at[:live] = steps[-1]
        return out

    def common(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """For samples of two levels: which of the lower one's steps the higher one has too, and which of the
        higher one's lie within the lower one's range."""
        if (low, high) not in self.shared_steps:
            inside = self.sampled(high) < (1 << low)
            self.shared_steps[low, high] = np.isin(self.sampled(low), self.sampled(high)[inside]), inside
        return self.shared_steps[low, high]

    def likeness(self, a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
        """Share of agreeing samples among the common steps at which either text goes on; 1
        for two empty texts."""
        (la, sa), (lb, sb) = (a, b) if a[0] <= b[0] else (b, a)
        if la != lb:  # the higher level's steps within the lower level's range
            shared, inside = self.common(la, lb)
            past = sb[~inside]
            sa, sb = sa[shared], sb[inside]
            beyond = int((past != 0).sum())
        else:
            beyond = 0
        going = (sa != 0) | (sb != 0)
        total = int(going.sum()) + beyond
        return float((sa[going] == sb[going]).sum() / total) if total else float(la == lb)


def as_text(fingerprint: tuple[int, np.ndarray]) -> str:
    """`level:samples`, a hexadecimal digit per sample."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    return f"{fingerprint[0]:02d}:" + digits[fingerprint[1]].tobytes().decode()


def from_text(text: str) -> tuple[int, np.ndarray]:
    level, _, digits = text.partition(":")
    return int(level), np.array([int(d, 16) for d in digits], np.uint8)


def bag(text: str) -> bytes:
    """How many of a text's characters fall into each of 15 classes, as 32-bit numbers, then how many of its pairs of
    neighbours into each of 2^k others, as bytes (255: or more), k growing with the length.

    An edit moves two of the first counts by one and four of the second at most, so the bags of texts within d edits differ
    by 2 * d and 4 * d in sum at most. What is no near copy almost always differs by more.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = (codes * np.uint32(0x9E3779B1) >> np.uint32(24)) % END
    bins = 1 << min(MOST_BAG_BITS, max(LEAST_BAG_BITS, (len(codes) // 32).bit_length()))
    pairs = ((classes[:-1] << np.uint32(8) | classes[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(16)) & np.uint32(bins - 1)
    counts = np.minimum(np.bincount(pairs, minlength=bins), 255)
    return np.bincount(classes % 15, minlength=15).astype("<i4").tobytes() + counts.astype(np.uint8).tobytes()


class Bags:
    """Bags of many texts, for tests of pairs."""

    def __init__(self, bags: list[bytes]) -> None:
        self.bags = bags
        self.single = np.frombuffer(b"".join(b[:60] for b in bags), "<i4").reshape(-1, 15)
        self.chars = self.single.sum(axis=1).astype(np.int64)
        self.bins = np.array([len(b) - 60 for b in bags], np.int64)

    def may_be_near(self, i: np.ndarray, j: np.ndarray, distance: float) -> np.ndarray:
        """Which of the pairs (i, j) can be within ``distance`` edits per character of the longer; no pair that is gets lost."""
        edits = (distance * np.maximum(np.maximum(self.chars[i], self.chars[j]), 1)).astype(np.int64)
        on = np.flatnonzero(np.abs(self.chars[i] - self.chars[j]) <= edits)
        on = on[np.abs(self.single[i[on]] - self.single[j[on]]).sum(axis=1) <= 2 * edits[on]]
        bins = np.minimum(self.bins[i[on]], self.bins[j[on]])
        out = np.zeros(len(i), bool)
        for b in np.unique(bins).tolist():
            of = on[bins == b]
            ends, at = np.unique(np.concatenate([i[of], j[of]]), return_inverse=True)
            # Counts of more bins add up to those of fewer.
            folded = np.stack([np.frombuffer(self.bags[v], np.uint8, offset=60).reshape(-1, b).sum(axis=0, dtype=np.int32) for v in ends.tolist()])
            for low in range(0, len(of), step := max(1, (1 << 21) // b)):
                part = slice(low, low + step)
                apart = np.abs(folded[at[: len(of)][part]] - folded[at[len(of) :][part]]).sum(axis=1)
                out[of[part]] = apart <= 4 * edits[of[part]]
        return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _order(key: object, tie: int) -> tuple:
    """What rows are ordered by: null ids first, then ids, then a hash of the text."""
    return (0, 0, tie) if key is None else (1, key, tie)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> list[tuple]:
    """The least ``_order`` of each block, ascending: neighbouring rows cut into blocks of about
    BLOCK_BYTES. One entry per block reaches the driver, MOST_BLOCKS at most."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    if not rows:
        return []
    blocks = min(MOST_BLOCKS, max(-(-(size or 0) // BLOCK_BYTES), -(-rows // BLOCK_ROWS), 1))
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for key, tie in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _order(key, tie) if found is None else min(found, _order(key, tie))
        own = [] if found is None else [found]
        yield pa.RecordBatch.from_arrays([pa.array([k if some else None for some, k, _ in own], batch.schema.field(0).type), pa.array([t for *_, t in own], pa.int64())], ["id", "tie"])

    def first_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = iter(batches)
        if (first := next(it, None)) is not None:
            yield from least(x for x in itertools.chain([first], it))

    if blocks == 1:
        least_row = keys.orderBy(F.col("id").asc_nulls_first(), "tie").first()
        return [_order(least_row["id"], least_row["tie"])]
    id_type = docs.schema[id_col].dataType.simpleString()
    found = keys.repartitionByRange(blocks, F.col("id").asc_nulls_first(), F.col("tie")).mapInArrow(first_only, f"id {id_type}, tie long").collect()
    return sorted({_order(r["id"], r["tie"]) for r in found})


FINGERPRINT_SCHEMA = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same string, bag binary"
)


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: NearParams | None = None) -> DataFrame:
    """Per row: id, n_chars, fingerprints of the text and of the text edited with the next row's (by
    ascending id; after the last the first), their likenesses, the text's md5 (``same``) and its ``bag``; for ``near``, also the keys of its ``buckets``.

    A null text is empty. Rows of equal ids go by a hash of the text, null ids come first. A single
    row is its own next; an empty table gives an empty result. Rows are dealt into blocks of
    neighbours once, compressed, and the first of each block goes to the block before too; equal rows of a task
    go as one with their number, so repeated rows don't fill a block. Ids may be of any type that sorts.
    """
    import zstandard  # noqa: F401  # fails here rather than on executors

    firsts = _blocks(docs, id_col, text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, {FINGERPRINT_SCHEMA}" + (", buckets array<long>" if near else "")
    if not len(firsts):
        return docs.sparkSession.createDataFrame([], schema)
    numbers = spread_keys(docs.sparkSession, len(firsts))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in text_slices(batches, 1):
            rows: dict[tuple, list] = {}
            for key, text, tie in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.setdefault(_order(key, tie), [key, text, 0])[2] += 1
            out: list[tuple] = []
            for order, (key, text, copies) in rows.items():
                packed = packer.compress((text or "").encode("utf-8", "surrogatepass"))
                block = max(0, bisect.bisect_right(firsts, order) - 1)
                out.append((numbers[block], False, key, order[-1], copies, packed))
                if firsts[block] == order:  # also the next of the block before
                    out.append((numbers[block - 1], True, key, order[-1], 0, packed))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            types = [pa.int64(), pa.bool_(), batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["block", "late", "id", "tie", "copies", "packed"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, embed = zstandard.ZstdDecompressor(), Embedder.shared()
        id_arrow = pa.int64()
        names = [id_col, *(f.split()[0] for f in FINGERPRINT_SCHEMA.split(", "))]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.binary()]

        def pairs() -> Iterator[tuple[object, str, str, int]]:
            """(id, text, next text, copies) of the rows that aren't copies of an edge; all copies but the
            last have their own text as next."""
            nonlocal id_arrow
            last: tuple[int, object, str, int] | None = None
            for batch in batches:
                id_arrow = batch.schema.field("id").type
                for block, late, key, copies, packed in zip(*(batch.column(n).to_pylist() for n in ("block", "late", "id", "copies", "packed")), strict=True):
                    text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
                    if last is not None and last[0] == block:
                        yield last[1], last[2], text, 1
                    if copies > 1:
                        yield key, text, text, copies - 1
                    last = None if late else (block, key, text, copies)

        def done(held: list[tuple[object, str, str, int]]) -> pa.RecordBatch:
            own = [t for _, t, _, _ in held]
            changed = [edited(t, n) for _, t, n, _ in held]
            wanted = {t: i for i, t in enumerate(dict.fromkeys([*own, *changed, *(n for _, _, n, _ in held)]))}
            prints, passages = embed.with_passages(list(wanted), near.distance) if near else (embed.fingerprints(list(wanted)), [])
            back = embed.passages_back(own, near.distance) if near else []
            a, b, c = ([prints[wanted[t]] for t in ts] for ts in (own, changed, [n for _, _, n, _ in held]))
            columns = [
                [len(t) for t in own],
                [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
                [as_text(f) for f in a],
                [as_text(f) for f in b],
                [embed.likeness(x, y) for x, y in zip(a, b, strict=True)],
                [embed.likeness(x, y) for x, y in zip(a, c, strict=True)],
                [_md5(t) for t in own],
                [bag(t) for t in own],
            ]
            arrays = [pa.array([k for k, _, _, _ in held], id_arrow), *(pa.array(v, t) for v, t in zip(columns, types, strict=True))]
            if near:
                arrays.append(_lists([filed(len(t), f, np.concatenate([passages[wanted[t]], b]), embed, near) for t, f, b in zip(own, a, back, strict=True)]))
            return pa.RecordBatch.from_arrays([*arrays, pa.array([n for _, _, _, n in held], pa.int64())], [*names, *(["buckets"] if near else []), "_copies"])

        held, chars = [], 0
        for row in pairs():
            held.append(row)
            chars += 2 * len(row[1])
            if chars >= BUFFER_CHARS or len(held) >= BUFFER_ROWS:
                yield done(held)
                held, chars = [], 0
        if held:
            yield done(held)

    rows = docs.select(id_col, text_col, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"))
    dealt = rows.mapInArrow(deal, f"block long, late boolean, id {id_type}, tie long, copies long, packed binary")
    sorted_rows = dealt.repartition(len(firsts), "block").sortWithinPartitions("block", "late", F.col("id").asc_nulls_first(), "tie")
    found = sorted_rows.mapInArrow(walk, f"{schema}, _copies long")
    every = found.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return every.drop("_copies", "_copy")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


# ---- near duplicates: bands, likeness, edit distance


def band_keys(fingerprint: tuple[int, np.ndarray], embed: Embedder, rows: int) -> list[str]:
    """Keys of the bands of ``rows`` samples, at the text's level and, as seen from the next
    one, at that too; bands past the text's end have none."""
    level, samples = fingerprint
    seen = samples[embed.common(level, level + 1)[0]]
    keys = []
    for at_level, s in ((level, samples), (level + 1, seen)):
        bands = s[: len(s) // rows * rows].reshape(-1, rows)
        digits = bands.tobytes().hex()[1::2]
        keys += [f"{at_level}:{i * rows}:{digits[i * rows : (i + 1) * rows]}" for i in np.flatnonzero(bands.all(axis=1)).tolist()]
    return keys


def _longest_partner(n: int, distance: float) -> int:
    """The most characters of a text that can be near one of ``n``."""
    return int(n / (1 - distance) + 1e-9) if distance < 1 else CYCLE


def _class_width(distance: float, times: int) -> float:
    return -times * math.log(1 - distance) * 1.0001 + 1e-9


def _length_classes(n: int, distance: float, times: int = 2) -> list[int]:
    """The classes of length that a text is filed under, so many times as wide as lengths of near texts are apart: its own
    and, near the upper end, the next. Two texts that can be near share one."""
    if distance >= 1:
        return [0]
    at = math.log(max(n, 1)) / _class_width(distance, times)
    return list(dict.fromkeys([math.floor(at), math.floor(at + 1 / times)]))


def _passage_classes(n: int, distance: float) -> list[tuple[int, float]]:
    """The classes of length in which a text's passages are compared, and their least lengths. They span about a sixth in
    length, or twice what near texts are apart."""
    if distance >= 1:
        return [(0, 0)]
    times = max(2, round(0.16 / _class_width(distance, 1)))
    return [(c, math.exp(c * _class_width(distance, times))) for c in _length_classes(n, distance, times)]


def _stops(lengths: list[int], distance: float, sites: int, upto: float) -> dict[int, Stops]:
    """The stops of each class of LEAST_LENGTH or more among texts by falling length: as many as ``sites``, spread over ``upto``
    steps for each character of its shortest texts. A walk takes about two."""
    out: dict[int, Stops] = {}
    for i, n in enumerate(lengths):
        for c, least in _passage_classes(n, distance):
            if least >= LEAST_LENGTH:
                out.setdefault(c, Stops([int((s + 0.5) / sites * upto * least) for s in range(sites)], i, i)).high = i + 1
    return out


def bucket_keys(fingerprint: tuple[int, np.ndarray], n: int, embed: Embedder, params: NearParams) -> list[int]:
    """64-bit keys of the buckets of a text of ``n`` characters: a band's, with a class of length. Near texts that share
    a band share a bucket. A text too short for a single edit to be near has no partner and no keys."""
    import xxhash

    if params.distance * _longest_partner(n, params.distance) + 1e-9 < 1:
        return []
    bands = band_keys(fingerprint, embed, params.rows)
    return [xxhash.xxh3_64_intdigest(f"{c}:{k}") - (1 << 63) for c in _length_classes(n, params.distance) for k in bands]


def filed(n: int, fingerprint: tuple[int, np.ndarray], passages: np.ndarray, embed: Embedder, params: NearParams) -> np.ndarray:
    """Keys of the buckets that a text of ``n`` characters is filed under: its passages in classes of LEAST_LENGTH or more,
    its bands if it has a shorter class. Near texts share a class, and both are filed the same way there."""
    if all(least >= LEAST_LENGTH for _, least in _passage_classes(n, params.distance)):
        return np.unique(passages)
    return np.unique(np.concatenate([passages, np.array(bucket_keys(fingerprint, n, embed, params), np.int64)]))


def edit_distance_within(a: str, b: str, most: int) -> int | None:
    """Edit distance of two texts if it is ``most`` or less."""
    found = int(edit_distances([(a, b)], np.array([most]))[0])
    return None if found < 0 else found


def edit_distances(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of texts, each if it is at its ``most`` or less, else -1. Pairs of like bounds are
    compared together, BAND_CELLS diagonals and BAND_CHARS characters at once or a single pair."""
    out = np.full(len(pairs), -1, np.int64)
    apart = np.array([abs(len(a) - len(b)) for a, b in pairs], np.int64)
    held: list[int] = []
    chars = 0
    for i in sorted(np.flatnonzero(apart <= most).tolist(), key=lambda i: int(most[i])):
        size = len(pairs[i][0]) + len(pairs[i][1])
        if held and ((len(held) + 1) * (2 * int(most[i]) + 3) > BAND_CELLS or chars + size > BAND_CHARS):
            out[held] = _by_diagonals([pairs[v] for v in held], most[held])
            held, chars = [], 0
        held.append(i)
        chars += size
    if held:
        out[held] = _by_diagonals([pairs[v] for v in held], most[held])
    return out


def _runs(flat: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many characters from each x on equal those from each y on; ends of texts equal nothing."""
    run, on = np.zeros(len(x), np.int64), np.arange(len(x))
    for width, times in ((1, 4), (16, 4), (RUN, -1)):  # most runs are short
        ahead = np.arange(width)
        while len(on) and times:
            at = run[on]
            same = flat[(x[on] + at)[:, None] + ahead] == flat[(y[on] + at)[:, None] + ahead]
            whole = same.all(axis=1)
            run[on] = at + np.where(whole, width, same.argmin(axis=1))
            on, times = on[whole], times - 1
    return run


@lru_cache(maxsize=256)
def _ends(text: str, w: int, stages: int) -> np.ndarray:
    """(stages + 1, kinds): how many pairs of neighbours of each kind the last 0, w, 2w ... characters hold."""
    end = np.frombuffer(text[-stages * w :].encode("utf-32-le", "surrogatepass"), np.uint32)
    at = (np.arange(stages * w - 1, 0, -1, dtype=np.uint32) + np.uint32(w)) // np.uint32(w)  # the first stage that has both characters
    kinds = (end[:-1] * np.uint32(0x9E3779B1) + end[1:]) * np.uint32(0x85EBCA6B) >> np.uint32(32 - KIND_BITS)
    counts = np.bincount(at << np.uint32(KIND_BITS) | kinds, minlength=(stages + 1) << KIND_BITS).astype(np.int32).reshape(stages + 1, -1)
    for before, count in itertools.pairwise(counts):
        count += before
    return counts


def _least_edits(pairs: list[tuple[str, str]], which: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(w, least) of the pairs ``which``, of others (1, 0): if a pair's last c * w characters are all still to be aligned, that takes
    ``least[c]`` / 4 edits or more.

    An exchanged character changes four of the counts of neighbouring pairs at most, one that is put in or left out three. Where the
    pointers are s characters out of step with the ends, s edits at least are of the latter kind, and s pairs more or fewer are counted.
    """
    widths, least = np.ones(len(pairs), np.int64), np.zeros((len(pairs), 2 * STAGES), np.int64)
    for i in which:
        n = min(map(len, pairs[i]))
        if n < 2 * STAGES:
            continue
        w = 1 << (n // STAGES).bit_length() - 1
        a, b = (_ends(text, w, n // w) for text in pairs[i])
        # A longer end holds the shorter ones.
        found = np.maximum.accumulate(np.abs(a - b).sum(axis=1))
        widths[i], least[i] = w, found[-1]
        least[i, : len(found)] = found[: 2 * STAGES]
    return widths, least


def _by_diagonals(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """See ``edit_distances``: for each number of edits all diagonals of all pairs advance at once, beside the comparison
    of equal runs; diagonals from which a pair's end is out of reach stop, and so do pairs of which what no diagonal has reached takes
    more edits than are left."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for pair in pairs for t in pair]
    sizes = np.array([len(c) for c in codes], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.full(int((sizes + 1).sum()) + RUN, 0xFFFFFFFF, np.uint32)
    for k, (c, start) in enumerate(zip(codes, starts.tolist(), strict=True)):
        flat[start : start + len(c)] = c
        flat[start + len(c)] = 0xFFFFFFF0 + k % 2  # the two ends of a pair differ, and from any character
    x, y, n, m = starts[::2], starts[1::2], sizes[::2], sizes[1::2]
    out = np.full(len(pairs), -1, np.int64)
    widths, least = _least_edits(pairs, np.flatnonzero(most >= STAGES // 2).tolist())
    live = np.flatnonzero(least[:, -1] <= 4 * most)
    if not len(live):
        return out
    wide = int(most.max())
    mid = wide + 1
    reach = np.full((len(live), 2 * wide + 3), -2, np.int64)
    reach[:, mid] = _runs(flat, x[live], y[live])
    furthest = reach[:, mid]
    for d in range(wide + 1):
        done = reach[np.arange(len(live)), mid + m[live] - n[live]] >= n[live]
        out[live[done]] = d
        # Whatever passes the furthest place takes an edit more than have been made.
        furthest = np.maximum(furthest, reach[:, mid - d : mid + d + 1].max(axis=1))
        stage = np.clip((n[live] - furthest - 1) // widths[live], 0, 2 * STAGES - 1)
        stay = ~done & (most[live] > d) & (least[live, stage] <= 4 * (most[live] - d - 1))
        if not stay.all():
            live, furthest = live[stay], furthest[stay]
            if not len(live):
                break
            inner = reach[stay, mid - d : mid + d + 1]
            reach = reach[: len(live)]
            reach[:, mid - d : mid + d + 1] = inner  # beyond, all are alike
        low, high = mid - d - 1, mid + d + 2
        k = np.arange(low, high) - mid
        before = reach[:, low - 1 : high - 1] if low else np.concatenate([np.full((len(live), 1), -2), reach[:, : high - 1]], axis=1)
        after = reach[:, low + 1 : high + 1]
        if after.shape[1] < high - low:
            after = np.concatenate([after, np.full((len(live), 1), -2)], axis=1)
        nl, ml = n[live][:, None], m[live][:, None]
        i = np.minimum(np.maximum(np.maximum(reach[:, low:high] + 1, before), after + 1), np.minimum(nl, ml - k))
        row, column = np.nonzero((i >= 0) & (i + k >= 0) & (np.abs(k - (ml - nl)) < most[live][:, None] - d))
        at = i[row, column]
        reach[:, low:high] = -2
        reach[row, low + column] = at + _runs(flat, x[live[row]] + at, y[live[row]] + at + k[column])
    return out


@dataclass(frozen=True)
class NearParams:
    rows: int = 6  #: samples of a band
    alike: float = 0.25  #: least likeness of fingerprints to compare texts; 99 of 100 unrelated pairs have less
    distance: float = 0.02  #: most edits per character of the longer text
    block: int = 1024  #: texts of a block
    block_chars: int = 1 << 21  #: characters of a block's texts, more only if a single text has more

    def sizes(self) -> JoinParams:
        """Blocks by length: of texts within ``distance`` the shorter has 1 - distance of the longer."""
        return JoinParams(percent=max(1, int((1 - self.distance) * 100)), block=self.block, block_elements=self.block_chars)


def _texts(keys: DataFrame, classes: DataFrame, own: DataFrame) -> DataFrame:
    """(key, text) of the ``keys`` (one column) alone, out of the rows ``own`` (same, text)."""
    members = written(keys.distinct().join(classes.select("key", "same"), "key"), "edit-members")
    whole = with_members(own, members.select(F.xxhash64("same").alias("h")), F.xxhash64("same"))
    texts = written(whole.groupBy("same").agg(F.first("text").alias("text")).join(members, "same").select("key", "text"), "edit-texts")
    discard(members)
    return texts


def _near(pairs: DataFrame, facts: DataFrame, own: DataFrame, params: NearParams) -> DataFrame:
    """(a, b, p, distance) of the ``pairs`` (a, b, p), p the pivot of the two, whose fingerprints are alike
    and whose texts are within the distance. Bags rule out for certain nearly all pairs that aren't, and only the texts
    of the others are fetched."""
    spark = pairs.sparkSession
    prints = facts.select("key", F.struct("fingerprint", "bag").alias("print"))
    pairs = pairs.withColumn("o", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    hot = hot_keys(pairs, "p")
    side = lambda rows, key, name: rows.select(F.col("key").alias(key), F.col(name).alias(f"{name[0]}{key}"))
    joined = join_hot(pairs, side(prints, "p", "print"), "p", F.col("o"), hot).join(side(prints, "o", "print"), "o")
    least, most = params.alike, params.distance
    joined = joined.select("a", "b", "p", "o", *(F.col(f"p{e}.{c}").alias(f"{c[0]}{e}") for e in "po" for c in ("fingerprint", "bag")))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Embedder.shared()
        for batch in batches:
            n = batch.num_rows
            bags = Bags(batch.column("bp").to_pylist() + batch.column("bo").to_pylist())
            keep = bags.may_be_near(np.arange(n), np.arange(n, 2 * n), most) if n else np.zeros(0, bool)
            of_p, of_o = batch.column("fp"), batch.column("fo")
            for i in np.flatnonzero(keep).tolist():
                keep[i] = embed.likeness(from_text(of_p[i].as_py()), from_text(of_o[i].as_py())) >= least
            yield batch.select(["a", "b", "p", "o"]).filter(pa.array(keep, pa.bool_()))

    close = written(joined.mapInArrow(alike, "a long, b long, p long, o long"), "edit-alike")
    schema = "a long, b long, p long, distance long"
    if not close.count():
        return spark.createDataFrame([], schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices([batch], batch.schema.get_field_index("to")):
                columns = part.to_pydict()
                found = _within(list(zip(columns["tp"], columns["to"], strict=True)), most)
                kept = np.flatnonzero(found >= 0)
                arrays = [part.column(c).take(pa.array(kept)) for c in ("a", "b", "p")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(found[kept], pa.int64())], ["a", "b", "p", "distance"])

    texts = _texts(close.select(F.explode(F.array("a", "b")).alias("key")), facts, own)
    whole = join_hot(close, side(texts, "p", "text"), "p", F.col("o"), hot).join(side(texts, "o", "text"), "o")
    found = written(whole.select("a", "b", "p", "tp", "to").mapInArrow(verify, schema), "edit-links")
    discard(close, texts)
    return found


def _thinned(links: DataFrame) -> DataFrame:
    """(a, b): what connects the ends that ``links`` (a, b, p) of pivots p connect. Each text keeps the link to its least pivot,
    and that pivot is linked with the text's others once for all such texts."""
    star = links.select("p", F.when(F.col("p") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("o"))
    least = star.withColumn("m", F.min("p").over(Window.partitionBy("o")))  # a text has as many pivots as buckets at most
    edges = least.select(F.when(F.col("p") == F.col("m"), F.col("o")).otherwise(F.col("p")).alias("a"), F.col("m").alias("b"))
    return edges.distinct()


def _within(pairs: list[tuple[str, str]], distance: float) -> np.ndarray:
    return edit_distances(pairs, np.array([int(distance * max(len(a), len(b), 1)) for a, b in pairs], np.int64))


def _spanning(part: pa.Table, params: NearParams, accept: Callable[[list[int], list[int]], np.ndarray]) -> list[tuple[int, int, int]]:
    """(a, b, result) of pairs of alike fingerprints across labels that ``accept`` takes (it gives -1 to others), enough to
    connect what all of them connect: pairs that others connect already are skipped."""
    keys, labels, first = (part.column(c).to_numpy() for c in ("key", "label", "first"))
    bags, embed = Bags(part.column("bag").to_pylist()), Embedder.shared()
    prints = [from_text(t) for t in part.column("fingerprint").to_pylist()]
    # By length, the partners of a text that aren't shorter are those that follow it, up to an end.
    order = np.argsort(bags.chars, kind="stable")
    chars = bags.chars[order]
    ends = np.searchsorted(chars, chars / (1 - params.distance) + 1e-6, "right") if params.distance < 1 else np.full(len(chars), len(chars))
    counts = ends - np.arange(1, len(chars) + 1)
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = v = parent[parent[v]]
        return v

    out: list[tuple[int, int, int]] = []
    upto = np.cumsum(counts)
    low = 0
    while low < len(chars):  # a slice of PAIRS pairs or of a single text
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, "right")))
        of = counts[low:high]
        x = np.repeat(np.arange(low, high), of)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(of) - of, of)
        i, j = order[x], order[y]
        across = labels[i] != labels[j]
        if not first.all():
            across &= first[i] != first[j]
        i, j = i[across], j[across]
        near = bags.may_be_near(i, j, params.distance)
        i, j = i[near], j[near]
        for some in range(0, len(i), VERIFIED):
            pairs = zip(i[some : some + VERIFIED].tolist(), j[some : some + VERIFIED].tolist(), strict=True)
            open_ = [(u, v) for u, v in pairs if root(int(labels[u])) != root(int(labels[v])) and embed.likeness(prints[u], prints[v]) >= params.alike]
            if not open_:
                continue
            us, vs = (list(ends) for ends in zip(*open_, strict=True))
            for u, v, d in zip(us, vs, accept(us, vs).tolist(), strict=True):
                la, lb = root(int(labels[u])), root(int(labels[v]))
                if d >= 0 and la != lb:
                    parent[la] = lb
                    out.append((min(int(keys[u]), int(keys[v])), max(int(keys[u]), int(keys[v])), d))
        low = high
    return out


def _table(rows: list[tuple[int, ...]], *names: str) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


_BLOCKS = ("grp", "li", "bi", "lj", "bj")


def _alike_in_blocks(rest: DataFrame, facts: DataFrame, params: NearParams) -> DataFrame:
    """(a, b): pairs of alike fingerprints across labels within each group of ``rest`` (grp, key, label, n), enough to connect
    what all of them connect. A task compares the fingerprints of two blocks; texts stay where they are."""
    rows = _tasks(rest, params.sizes()).join(facts.select("key", "fingerprint", "bag"), "key")

    def compare(part: pa.Table) -> pa.Table:
        return _table([(a, b) for a, b, _ in _spanning(part, params, lambda us, vs: np.zeros(len(us), np.int64))], "a", "b")

    return rows.groupBy(*_BLOCKS).applyInArrow(compare, "a long, b long").distinct()


def _near_in_blocks(rest: DataFrame, facts: DataFrame, own: DataFrame, params: NearParams) -> DataFrame:
    """(a, b, distance): links across labels within each group of ``rest`` (grp, key, label, n), enough
    of them to connect what they connect. A task compares two blocks of bounded texts and characters."""
    texts = _texts(rest.select("key"), facts, own)
    rows = _tasks(rest, params.sizes()).join(facts.select("key", "fingerprint", "bag"), "key").join(texts, "key")

    def compare(part: pa.Table) -> pa.Table:
        texts = part.column("text").to_pylist()

        def within(us: list[int], vs: list[int]) -> np.ndarray:
            return _within([(texts[u], texts[v]) for u, v in zip(us, vs, strict=True)], params.distance)

        return _table(_spanning(part, params, within), "a", "b", "distance")

    rows = rows.select(*_BLOCKS, "first", "key", "label", "fingerprint", "bag", "text")
    found = written(rows.groupBy(*_BLOCKS).applyInArrow(compare, "a long, b long, distance long"), "edit-links")
    discard(texts)
    return found


def near_links(prints: DataFrame, docs: DataFrame, id_col: str, text_col: str, params: NearParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes, links and labels of near duplicates among rows of ``prints`` (id, same, n_chars, fingerprint, bag,
    buckets), same being the text's md5.

    Classes (key, id, same, n) are distinct texts with their least id; links (a, b, distance) join keys of
    texts within the distance, enough to connect all that pairs sharing a bucket connect; labels (key, label) are the
    components of texts that share a bucket. Texts of a bucket meet a pivot for PIVOT_ROUNDS rounds; what then still shares a
    bucket across components is compared in blocks, all with all of near length. That grows with the
    square of a bucket's unlinked texts: nothing less proves that none of them links. Buckets hold texts of near length
    alone, and only texts whose bags and fingerprints let a pair through are shuffled.
    """
    grouped = prints.groupBy("same").agg(F.min(id_col).alias("id"), F.first("n_chars").alias("n"), F.first("buckets").alias("buckets"))
    keyed = written(grouped.select(F.monotonically_increasing_id().alias("key"), "id", "same", "n", "buckets"), "edit-keyed")
    release_shuffles(docs.sparkSession)
    # Nearly all buckets have a single text: they are shuffled in shares, and only the others are kept.
    kept = []
    for share in range(PASSES):
        rows = keyed.select(F.explode("buckets").alias("bucket"), "key", "n").where(F.pmod("bucket", F.lit(PASSES)) == share)
        shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("bucket")
        kept.append(written(rows.join(shared, "bucket"), "edit-shared"))
        del rows, shared
        release_shuffles(docs.sparkSession)
    classes = written(keyed.drop("buckets"), "edit-classes")
    discard(keyed)
    plain = reduce(DataFrame.union, kept)
    hot = hot_keys(plain, "bucket")
    # The most central text comes first as pivot: of a group of copies, one close to the original.
    size = plain.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    central = join_hot(plain, size, "bucket", F.col("key"), hot).groupBy("key").agg(F.sum("m").alias("rank"))
    buckets = written(plain.join(central, "key"), "edit-buckets")
    discard(*kept)
    labels = written(buckets.select("key", F.col("key").alias("label")).distinct(), "edit-labels")
    members = written(classes.join(labels, "key").select("key", "same"), "edit-members")
    looks = with_members(prints.select("same", "fingerprint", "bag"), members.select(F.xxhash64("same").alias("h")), F.xxhash64("same"))
    looks = looks.groupBy("same").agg(F.first("fingerprint").alias("fingerprint"), F.first("bag").alias("bag"))
    facts = written(members.join(looks, "same"), "edit-facts")
    discard(members)
    own = docs.select(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("same"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    del grouped, members, looks, plain, size, central
    release_shuffles(docs.sparkSession)
    checked: list[DataFrame] = []
    found: list[DataFrame] = []
    for turn in range(PIVOT_ROUNDS):
        rows = written(open_rows(buckets, labels, turn, hot), "edit-open")
        discard(buckets)
        checked.append(written(star_pairs(rows, checked, params.sizes().percent), "edit-pairs"))
        found.append(_near(checked[-1], facts, own, params))
        old, labels = labels, _merged(_thinned(found[-1]), labels)
        discard(old)
        buckets = rows.where(F.col("key") != F.col("p")).select("bucket", "key", "n", "rank")
        buckets.written_path = rows.written_path
        release_shuffles(docs.sparkSession)
    left = open_rows(buckets, labels, 0, hot)
    rest = written(left.select(F.col("p").alias("grp"), "key", "label", "n").distinct(), "edit-rest")
    discard(buckets)
    release_shuffles(docs.sparkSession)
    spanning = written(_alike_in_blocks(rest, facts, params), "edit-spanning")
    found.append(_near(spanning.withColumn("p", F.col("a")), facts, own, params))
    before, labels = labels, _merged(found[-1], labels)
    if found[-1].count() < spanning.count():  # alike but not near: other pairs may connect what these were to
        # They lie in components that such a pair was to hold together; in all others every candidate is settled.
        assumed = _merged(spanning, before).withColumnRenamed("label", "assumed")
        failed = spanning.join(found[-1].select("a", "b"), ["a", "b"], "left_anti").select(F.col("a").alias("key"))
        doubtful = failed.join(assumed, "key").select("assumed").distinct()
        # All pairs of alike texts lie within such a component: as a group of its own each is compared once, whatever buckets it shares.
        left = assumed.join(doubtful, "assumed").join(labels, "key").join(classes.select("key", "n"), "key")
        left = written(left.select(F.col("assumed").alias("grp"), "key", "label", "n"), "edit-left")
        found.append(_near_in_blocks(left, facts, own, params))
        discard(left)
        labels = _merged(found[-1], labels)
    discard(rest, spanning, facts, *checked)
    return classes, reduce(DataFrame.union, [f.select("a", "b", "distance") for f in found]), labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 4, alike: float = 0.5, distance: float = 0.1, block: int = 256
) -> DataFrame:
    """(id, near, distance): links of texts within ``distance`` edits per character of the longer
    one, enough to connect all that pairs sharing a bucket connect; see ``near_links``.

    Texts are reduced to distinct ones with their least id first, so repeated rows give no links. Null
    and empty texts link with nothing, an empty table gives an empty result, other columns are left out.
    """
    docs = docs.where(F.col(text_col).isNotNull())
    params = NearParams(rows, alike, distance, block)
    classes, links, _ = near_links(fingerprints(docs, id_col, text_col, params), docs, id_col, text_col, params)
    of = lambda end, name: classes.select(F.col("key").alias(end), F.col("id").alias(name))
    return links.join(of("a", id_col), "a").join(of("b", "near"), "b").select(id_col, "near", "distance")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, params: NearParams) -> DataFrame:
    """(id, same, n_chars, fingerprint, bag, buckets) of every row: the text's md5, code points, fingerprint, bag and the keys of
    its buckets, those of its bands alone. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = Embedder.shared()
        for batch in text_slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = embed.fingerprints(texts)
            columns = [pa.array([_md5(t) for t in texts]), pa.array([len(t) for t in texts], pa.int64()), pa.array([as_text(p) for p in prints], pa.string()), pa.array([bag(t) for t in texts], pa.binary())]
            buckets = _lists([np.unique(np.array(bucket_keys(p, len(t), embed, params), np.int64)) for t, p in zip(texts, prints, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, buckets], [id_col, "same", "n_chars", "fingerprint", "bag", "buckets"])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, same string, n_chars long, fingerprint string, bag binary, buckets array<long>")


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def fingerprint_and_link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: NearParams = NearParams()) -> DataFrame:
    """The columns of ``fingerprint_with_next`` and ``near_id``: the least id of the row's component of
    near duplicates, links being those of ``near_links`` and equal texts always together."""
    prints = written(fingerprint_with_next(docs, id_col, text_col, params), "edit-prints")
    classes, _, labels = near_links(prints, docs, id_col, text_col, params)
    named = classes.join(labels, "key", "left").select("same", "id", F.coalesce("label", "key").alias("label"))
    named = written(named, "edit-named")
    least = named.groupBy("label").agg(F.min("id").alias("near_id"))
    by_text = named.join(least, "label").select("same", "near_id")
    return join_hot(prints, by_text, "same", F.coalesce(F.col(id_col).cast("string"), F.lit(""))).drop("same", "bag", "buckets")


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_and_link(table(spark, sf_dir, "documents"))
