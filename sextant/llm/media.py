"""Media columns: lossless 8-bit PCM storage and audio features.

A payload of bytes is stored as a mono 8-bit WAV file. Features come from the
stored bytes alone: polyphase resampling, overlapped log-mel filterbanks, and
energy segmentation with hysteresis. Frames go into a fixed-shape Arrow tensor
column with time spans.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_slices

STORED_HZ = 16000  #: sampling rate of the stored samples
FEATURE_HZ = 8000  #: rate after resampling
UP, DOWN = 1, 2  #: FEATURE_HZ / STORED_HZ
TAPS = 24  #: filter taps per phase
WINDOW, HOP, FFT = 200, 80, 256  #: 25 ms windows each 10 ms
MELS = 20
TENSOR_FRAMES = 32  #: frames of one tensor cell
ON_DB, OFF_DB = -18.0, -24.0  #: a segment starts at ON_DB and lasts until under OFF_DB
BLOCK = 1 << 18  #: samples resampled at once, a multiple of DOWN: bounds memory on long payloads


def to_payload(text: str | None) -> bytes:
    """UTF-8 bytes of ``text`` (null: none), padded by zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def store(payload: bytes) -> bytes:
    """A WAV file whose 8-bit samples are the bytes of ``payload``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(STORED_HZ)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    """The samples of a file made by ``store``."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _phases(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row of taps per phase; each row sums to 1."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    phases = h.reshape(TAPS, up).T[:, ::-1]
    return np.ascontiguousarray(phases / phases.sum(axis=1, keepdims=True), dtype=np.float32)


PHASES = _phases(UP, DOWN)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling by ``up / down``: output k takes phase (k * down) % up of the
    filter, so no zeros are inserted and no dropped output is computed."""
    phases = PHASES if (up, down) == (UP, DOWN) else _phases(up, down)
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(TAPS // 2 - 1, np.float32), x.astype(np.float32), np.zeros(TAPS // 2 + 1, np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    out = np.empty(n_out, np.float32)
    for phase in range(up):
        first = next(k for k in range(up) if (k * down) % up == phase)
        at = np.arange(first, n_out, up, dtype=np.int64) * down // up
        if len(at):
            step = at[1] - at[0] if len(at) > 1 else 1
            out[first::up] = windows[at[0] : at[-1] + 1 : step] @ phases[phase]
    return out


def resample_blocks(x: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """``resample`` of a signal of any length, ``block`` samples at once: a block is resampled with
    the neighbouring samples that its filter reaches, and their outputs are cut off."""
    reach, out = TAPS * DOWN, []
    for at in range(0, len(x), block):
        lead = min(at, reach)
        part = resample(x[at - lead : min(len(x), at + block + reach)])
        n_out = -(-min(block, len(x) - at) * UP // DOWN)
        out.append(part[lead * UP // DOWN :][:n_out])
    return np.concatenate(out)


def _mel_bank() -> np.ndarray:
    """(FFT // 2 + 1, MELS) triangular filters, evenly spaced on the mel scale."""
    mel = lambda hz: 2595.0 * np.log10(1.0 + hz / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(60.0), mel(FEATURE_HZ / 2), MELS + 2) / 2595.0) - 1.0)
    hz = np.linspace(0, FEATURE_HZ / 2, FFT // 2 + 1)
    rise = (hz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)).astype(np.float32)
MEL_BANK = _mel_bank()


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log-mel energies and the frames' energies in dB; the last window is
    padded with zeros, and a payload always has one frame at least."""
    frames = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + WINDOW, np.float32)
    padded[: min(len(x), len(padded))] = x[: len(padded)]
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    mels, energy = [], []
    for at in range(0, frames, 4096):
        part = windows[at : at + 4096] * HANN
        spectrum = np.fft.rfft(part, FFT)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ MEL_BANK + 1e-6, dtype=np.float32))
        energy.append(10 * np.log10(np.einsum("ij,ij->i", part, part) / WINDOW + 1e-9))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy_db: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames (end exclusive) that start at ON_DB or louder and last while OFF_DB
    or louder: a frame between both keeps the state of the frame before."""
    mark = np.where(energy_db >= ON_DB, 1, np.where(energy_db < OFF_DB, -1, 0))
    known = np.where(mark != 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(known)
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def features(media: bytes) -> dict:
    """Log-mel frames, energies and segments of a stored file."""
    x = np.frombuffer(load(media), np.uint8).astype(np.float32) / 128.0 - 1.0
    mels, energy = log_mel(resample_blocks(x))
    return {"mels": mels, "energy": energy, "segments": segments(energy)}


def tensor_cells(mels: np.ndarray) -> np.ndarray:
    """(cells, TENSOR_FRAMES, MELS): frames in fixed shapes, the last cell padded by zeros."""
    cells = -(-len(mels) // TENSOR_FRAMES)
    out = np.zeros((cells * TENSOR_FRAMES, MELS), np.float32)
    out[: len(mels)] = mels
    return out.reshape(cells, TENSOR_FRAMES, MELS)


def tensor_array(cells: np.ndarray) -> pa.Array:
    """The cells as a fixed-shape Arrow tensor array."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(cells))


def tensor_batch(media: bytes) -> pa.RecordBatch:
    """One row per tensor cell: time span in seconds, voiced frames in it, tensor."""
    f = features(media)
    cells = tensor_cells(f["mels"])
    n = len(f["mels"])
    first = np.arange(len(cells)) * TENSOR_FRAMES
    voiced = np.zeros(len(cells) * TENSOR_FRAMES, np.int32)
    for a, b in f["segments"]:
        voiced[a:b] = 1
    spans = first * HOP / FEATURE_HZ, (np.minimum(first + TENSOR_FRAMES, n) * HOP) / FEATURE_HZ
    columns = [pa.array(spans[0]), pa.array(spans[1]), pa.array(voiced.reshape(len(cells), -1).sum(axis=1), pa.int32()), tensor_array(cells)]
    return pa.RecordBatch.from_arrays(columns, ["start_s", "end_s", "voiced", "log_mel"])


def digest(media: bytes) -> str:
    """Short text of the features: frames, segments, voiced frames, mean level in each of
    the mel bands (tenths), and the crc32 of the Arrow tensors' values in tenths."""
    f = features(media)
    cells = tensor_cells(f["mels"])
    stored = tensor_array(cells).storage.flatten().to_numpy()
    voiced = sum(b - a for a, b in f["segments"])
    means = ",".join(str(int(round(float(v) * 10))) for v in f["mels"].mean(axis=0, dtype=np.float64))
    check = zlib.crc32(np.round(stored.astype(np.float64) * 10).astype("<i4").tobytes())
    return f"frames={len(f['mels'])};segments={len(f['segments'])};voiced={voiced};mel={means};crc={check}"


AUDIO_SCHEMA = "start_s double, end_s double, voiced int, log_mel array<float>"


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The feature table: one row per tensor cell with its time span.

    ``log_mel`` holds TENSOR_FRAMES * MELS floats, row-major; ``write_tensors`` stores
    them under the Arrow tensor type. A null or empty text gives the one cell of 64 zero samples, repeated
    rows repeat their cells, an empty table gives none; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            for key, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                part = tensor_batch(store(to_payload(text)))
                flat = part.column(3).storage.flatten()
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * TENSOR_FRAMES * MELS)
                ids = pa.array([key.as_py()] * part.num_rows, batch.schema.field(0).type)
                yield pa.RecordBatch.from_arrays(
                    [ids, part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(offsets, flat)],
                    [id_col, "start_s", "end_s", "voiced", "log_mel"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, {AUDIO_SCHEMA}")


def write_tensors(cells: DataFrame, path: str) -> None:
    """Write ``audio_features`` rows as Parquet whose Arrow schema types ``log_mel`` as a
    fixed-shape tensor; one file per partition, by pyarrow's own file systems.

    A file is named by its partition and moved into place when complete, so a task that runs twice
    leaves one file. ``path`` must not exist; without a scheme it is a local path, which only a local
    master can share with its tasks. A table without rows writes no file.
    """
    master = cells.sparkSession.sparkContext.master
    if "://" not in path and master != "local" and not master.startswith("local["):
        raise ValueError(f"{path} is local to each machine; give a path with a scheme")
    target = cells.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(cells.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(target):
        raise FileExistsError(path)
    shape = (TENSOR_FRAMES, MELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        kind, writer = pa.fixed_shape_tensor(pa.float32(), shape), None
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.parquet"
        draft = f"{root}/.{uuid.uuid4().hex}.tmp"
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("log_mel").flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            storage = pa.FixedSizeListArray.from_arrays(pa.array(values), shape[0] * shape[1])
            columns = [*(batch.column(n) for n in batch.schema.names if n != "log_mel"), pa.ExtensionArray.from_storage(kind, storage)]
            names = [*(n for n in batch.schema.names if n != "log_mel"), "log_mel"]
            tensors = pa.RecordBatch.from_arrays(columns, names)
            if writer is None:
                writer = pq.ParquetWriter(draft, tensors.schema, filesystem=fs)
            writer.write_batch(tensors)
            rows += batch.num_rows
        if writer is not None:
            writer.close()
            fs.move(draft, name)  # a task that dies leaves no file that a reader takes
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    cells.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()


DIGEST_SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: sizes and hashes of payload and stored file, and the features.

    A null text counts as empty: 64 zero samples. Repeated rows give equal values, an
    empty table an empty result; ids may be null or repeat, other columns are left out. Rows are
    independent: there is no shuffle, and memory is that of a slice of texts and of the longest
    one's features. Long texts are resampled in blocks, with the result of the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1):
            rows: list[tuple] = []
            for text in batch.column(1).to_pylist():
                n = len((text or "").encode("utf-8", "surrogatepass"))
                media = store(to_payload(text))
                back = load(media)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), digest(media)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *names])

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {id_type}, {DIGEST_SCHEMA}")


def op10_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
