"""Packing documents into training windows by order-preserving dynamic programming.

The documents of a partition, in order, form one stream of token ids. The stream is
cut into windows of at most ``length`` ids so that

    sum of padding of each window + sum of penalties of each cut

is least over the candidate cuts: document ends (no penalty), sentence ends
(``sentence_penalty``) and, where neither comes for long, hard cuts
(``hard_penalty``). With f(i) the least cost of a stream ending at cut i at position
c(i), padding makes f(i) = min over j of (f(j) + c(j)) + length - c(i) + penalty(i): a
minimum over a sliding range of j, which a monotone queue gives in constant time. A
window whose size is a power of two isn't padded; those few sizes are looked up.

Windows are decided over blocks of ``block_windows`` windows, which may end within a document, so the
memory of cuts stays bounded; a block ends at its cheapest cut and the next one goes on from there. Partitions are packed
independently: no shuffle, and a lost task is redone alone from its own input.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import table

#: Texts up to this code point are tokenised by the faster of two libraries, which agree there.
FAST_UP_TO = 0x24F


@dataclass(frozen=True)
class PackingParams:
    length: int = 2048  #: most ids of a window
    end_id: int = 1  #: id appended to each document
    sentence_penalty: float = 12.0  #: cost of a cut at a sentence end, in padding ids
    hard_penalty: float = 48.0  #: cost of a cut elsewhere
    hard_grain: int = 64  #: spacing of hard cuts where no boundary comes
    block_windows: int = 64  #: windows decided at once
    power_sizes: tuple[int, ...] = (256, 512, 1024)  #: unpadded window sizes that are looked up
    vocabulary: str = "byte_bpe_50k"  #: name of the vocabulary's files, or a path without suffix


def _files(vocabulary: str) -> tuple[str, str]:
    if "/" in vocabulary:
        return f"{vocabulary}.json", f"{vocabulary}.tiktoken"
    import public_tokenizers

    return public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken")


class Encoder:
    """Token ids of texts as uint32 arrays.

    The ids are those of ``tokenizers`` with the JSON vocabulary, special tokens' strings being
    ordinary text. Texts without code points above FAST_UP_TO go through
    ``tiktoken`` with the same vocabulary, which is several times faster and gives the same ids.
    """

    def __init__(self, vocabulary: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        self._json, ranks_path = _files(vocabulary)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._exact = None
        ends = np.zeros(max(ranks.values()) + 2, bool)
        for piece, i in ranks.items():
            ends[i] = piece.rstrip(b"\"')] ").endswith((b".", b"!", b"?")) or b"\n" in piece
        self.sentence_end = ends

    def exact(self, text: str) -> np.ndarray:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._json)
            self._exact.encode_special_tokens = True
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not text.isascii() and np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).max() > FAST_UP_TO:
            return self.exact(text)
        return self._fast.encode_to_numpy(text, disallowed_special=())


def best_cuts(positions: np.ndarray, penalties: np.ndarray, start: int, params: PackingParams, last: bool) -> list[int]:
    """Cuts that minimise padding plus penalties over ``positions`` (ascending, > start).

    ``last``: the last position is the end of the stream and must be a cut. Otherwise
    the cheapest cut per covered id within the last window ends the block.
    Neighbouring positions must be at most ``params.length`` apart.
    """
    length, sizes = params.length, params.power_sizes
    pos = [start, *positions.tolist()]
    pen = [0.0, *penalties.tolist()]
    cost, came = [0.0] * len(pos), [0] * len(pos)
    at = {p: i for i, p in enumerate(pos)}
    queue: deque[tuple[float, int, int]] = deque([(float(start), start, 0)])  # (f(j) + c(j), c(j), j), keys ascending
    for i in range(1, len(pos)):
        c = pos[i]
        low = c - length
        while queue[0][1] < low:
            queue.popleft()
        key, _, best_j = queue[0]
        best = key + length - c
        for size in sizes:
            j = at.get(c - size)
            if j is not None and cost[j] < best:
                best, best_j = cost[j], j
        best += pen[i]
        cost[i], came[i] = best, best_j
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c, i))
    end = len(pos) - 1
    if not last:
        total = pos[-1] - start
        tail = [i for i in range(1, len(pos)) if pos[i] > pos[-1] - length] if total > length else [end]
        end = min(tail, key=lambda i: (cost[i] / (pos[i] - start), -pos[i]))
    cuts = []
    while end > 0:
        cuts.append(pos[end])
        end = came[end]
    return cuts[::-1]


def _candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, params: PackingParams) -> tuple[np.ndarray, np.ndarray]:
    """Ascending candidate cuts over a buffer of ids and their penalties."""
    sentence = np.flatnonzero(ends[ids]) + 1
    kind = np.full(len(ids) + 1, 2, np.int8)  # 0: document end, 1: sentence end, 2: neither
    kind[sentence] = 1
    kind[doc_ends] = 0
    known = np.flatnonzero(kind < 2)
    known = known[known > 0]
    bounds = np.concatenate([[0], known, [len(ids)]])
    wide = np.flatnonzero(np.diff(bounds) > params.hard_grain)
    hard = [np.arange(bounds[w] + params.hard_grain, bounds[w + 1], params.hard_grain) for w in wide]
    positions = np.unique(np.concatenate([known, *hard]))
    penalties = np.array([0.0, params.sentence_penalty, params.hard_penalty])[kind[positions]]
    return positions, penalties


def pack_stream(docs: Iterator[tuple[object, np.ndarray]], ends: np.ndarray, params: PackingParams) -> Iterator[list[tuple]]:
    """Windows of a stream of (document id, ids with the end id): each a list of pieces
    (document id, start in the document, ids of the piece, ids of the document)."""
    buffer: list[tuple[int, object, int, np.ndarray, int]] = []  # number, id, start, ids, size of the document
    held = 0
    least = params.length * params.block_windows

    def flush(last: bool) -> Iterator[list[tuple]]:
        nonlocal buffer, held
        ids = np.concatenate([b[3] for b in buffer])
        stops = np.cumsum([len(b[3]) for b in buffer])
        whole = np.array([start + len(part) == size for _, _, start, part, size in buffer])
        positions, penalties = _candidates(ids, stops[whole], ends, params)
        start, k, done = 0, 0, 0
        for cut in best_cuts(positions, penalties, 0, params, last):
            pieces, owner = [], -1
            while start < cut:
                number, key, offset, rest, size = buffer[k]
                first = start - (int(stops[k]) - len(rest))
                take = min(cut, int(stops[k])) - start
                part = rest[first : first + take]
                if number == owner:  # the document goes on in the next entry
                    key, began, before, size = pieces.pop()
                    pieces.append((key, began, np.concatenate([before, part]), size))
                else:
                    pieces.append((key, offset + first, part, size))
                owner = number
                start += take
                if start == stops[k]:
                    k += 1
            yield pieces
            done = cut
        left = buffer[k:]
        if left:
            number, key, offset, rest, size = left[0]
            skip = done - (int(stops[k]) - len(rest))
            left[0] = (number, key, offset + skip, rest[skip:], size)
        buffer, held = left, held - done

    for number, (key, ids) in enumerate(docs):
        for at in range(0, len(ids), least):
            part = ids[at : at + least]
            buffer.append((number, key, at, part, len(ids)))
            held += len(part)
            if held >= least:
                yield from flush(False)
    if held:
        yield from flush(True)


PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    params: PackingParams = PackingParams(),
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of a document in a window.

    Output: id, start (the document's ids before the piece), length, ids_crc32 (of the
    little-endian unsigned 32-bit ids), doc_tokens (with the end id), sequence_id, offset (in the
    window, gapless from 0) and, with ``with_ids``, the ids. A null or empty text is the end id
    alone. Repeated rows are packed as often as they come, null ids stay null, an empty
    table gives no rows, other columns are left out. Sequence ids are unique, not
    consecutive: the partition's number times 2^32 plus a counter.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(f.split()[0] for f in PIECE_SCHEMA.split(", ")), *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(params.vocabulary), np.array([params.end_id], np.uint32)
        first = TaskContext.get().partitionId() << 32
        id_arrow = None

        def stream() -> Iterator[tuple[object, np.ndarray]]:
            nonlocal id_arrow
            for batch in batches:  # one text at a time becomes a Python object
                id_arrow = batch.schema.field(0).type
                for key, text in zip(batch.column(0), batch.column(1), strict=True):
                    yield key.as_py(), np.concatenate([encode(text.as_py() or ""), end])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], id_arrow), *(pa.array(c, pa.int64()) for c in columns[1:7])]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.list_(pa.int64())) for c in columns[7:]], names)

        rows: list[tuple] = []
        for n, pieces in enumerate(pack_stream(stream(), encode.sentence_end, params)):
            offset = 0
            for key, start, ids, size in pieces:
                crc = zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
                rows.append((key, start, len(ids), crc, size, first + n, offset, *[ids.tolist()] * with_ids))
                offset += len(ids)
            if len(rows) >= 2000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    schema = f"{id_col} {id_type}, {PIECE_SCHEMA}" + ", ids array<long>" * with_ids
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def padding(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """One row: sequences, ids and padding of packed pieces."""
    from pyspark.sql import functions as F

    size = F.sum("length").alias("size")
    pad = F.when(F.col("size").bitwiseAND(F.col("size") - 1) == 0, 0).otherwise(length - F.col("size"))
    sequences = pieces.groupBy("sequence_id").agg(size)
    return sequences.agg(F.count(F.lit(1)).alias("sequences"), F.sum("size").alias("ids"), F.sum(pad).alias("padding"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
