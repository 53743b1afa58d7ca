"""Media columns: bytes kept as WAV, read by the ``wave`` module, and spectral-peak pair fingerprints.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of ``BLOCK``, are the samples
of a mono 8-bit WAV.  Reading decodes the stored WAV again; a short-time Fourier transform over the
read samples gives peaks, and pairs of close peaks give a fingerprint as an array of time-coded
integers: ``frame << 32 | bin of the first << 18 | bin of the second << 6 | frames between them``.

Cases: null text is empty; an empty text gives one block of filling; equal texts give equal values;
repeated rows are kept; an empty table gives an empty table.  Other columns are not read.
Both steps work row by row, so nothing is shuffled and memory is bounded by one batch of rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch_of, field, pick, raw, slices, struct, trimmed

BLOCK = 576
RATE = 8000
#: Frames of BLOCK samples start every HOP samples; so many peaks are kept in each.
HOP = BLOCK // 2
PEAKS = 3
#: The same for a payload of one block, in which longer frames would find no two to pair.
SHORT_HOP = 24
#: A peak is paired with the peaks of so many following frames.
REACH = 2
#: Frames that are transformed at once.
CHUNK = 2048


def pad(data: bytes, block: int = BLOCK) -> bytes:
    return data + b"\xff" * (-len(data) % block if data else block)


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono 8-bit WAV")
        return w.readframes(w.getnframes())


def spectrum_peaks(samples: np.ndarray, hop: int = HOP) -> np.ndarray:
    """Bins of the strongest local maxima of each frame, ascending; 0 stands for none. Shape (frames, PEAKS)."""
    halves = samples[: len(samples) // hop * hop].reshape(-1, hop)
    window = np.hanning(2 * hop).astype(np.float32)
    n = len(halves) - 1
    out = np.zeros((max(n, 0), PEAKS), np.int64)
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        frames = np.concatenate([halves[lo:hi], halves[lo + 1 : hi + 1]], axis=1).astype(np.float32)
        frames -= 128
        frames *= window
        x = np.fft.rfft(frames, axis=1)
        power = x.real**2 + x.imag**2
        mid = power[:, 1:-1]
        mid = np.where((mid > power[:, :-2]) & (mid >= power[:, 2:]), mid, 0)
        top = np.argpartition(mid, mid.shape[1] - PEAKS, axis=1)[:, -PEAKS:]
        out[lo:hi] = np.sort(np.where(np.take_along_axis(mid, top, axis=1) > 0, top + 1, 0), axis=1)
    return out


def peak_pairs(peaks: np.ndarray) -> np.ndarray:
    """Every peak with every peak of the next REACH frames, as time-coded integers in ascending order."""
    found = []
    for apart in range(1, REACH + 1):
        a, b = peaks[:-apart], peaks[apart:]
        if not len(a):
            break
        t = np.arange(len(a), dtype=np.int64)[:, None, None]
        code = (t << 32) | (a[:, :, None] << 18) | (b[:, None, :] << 6) | apart
        found.append(code[(a[:, :, None] > 0) & (b[:, None, :] > 0)])
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """The pairs of peaks; one block alone, between two silent hops, has frames of 2 * SHORT_HOP samples."""
    if len(samples) > BLOCK:
        return peak_pairs(spectrum_peaks(samples))
    silence = np.full(SHORT_HOP, 128, np.uint8)
    return peak_pairs(spectrum_peaks(np.concatenate([silence, samples, silence]), SHORT_HOP))


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``id_col``, ``n_bytes`` (before filling up) and ``media``, a WAV that holds the text without loss."""
    schema = struct((id_col, field(df, id_col)), ("n_bytes", "bigint"), ("media", "binary"))
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = raw(batch.column("text")).to_pylist()
            media = [write_wav(pad(x, block)) for x in texts]
            yield batch_of(arrow, **{id_col: batch.column("id"), "n_bytes": [len(x) for x in texts], "media": media})

    return pick(df, id=id_col, text=text_col).mapInArrow(trimmed(run), schema)


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored WAVs hold: sizes, digests, and ``fingerprint`` (array of time-coded peak pairs).

    ``payload`` columns are of the samples as read back, ``media`` columns of the stored form.
    """
    schema = struct(
        (id_col, field(media, id_col)), ("n_bytes", "bigint"), ("payload_bytes", "bigint"), ("payload_sha256", "string"),
        ("tail_crc32", "bigint"), ("media_bytes", "bigint"), ("media_sha256", "string"), ("fingerprint", "array<bigint>"),
    )
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows = {n: [] for n in arrow.names[2:]}
            for x in batch.column("media").to_pylist():
                payload = read_wav(x)
                rows["payload_bytes"].append(len(payload))
                rows["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                rows["tail_crc32"].append(zlib.crc32(payload[-32:]))
                rows["media_bytes"].append(len(x))
                rows["media_sha256"].append(hashlib.sha256(x).hexdigest())
                rows["fingerprint"].append(fingerprint(np.frombuffer(payload, np.uint8)))
            yield batch_of(arrow, **{id_col: batch.column("id"), "n_bytes": batch.column("n_bytes")}, **rows)

    return pick(media, id=id_col, n_bytes="n_bytes", media="media").mapInArrow(trimmed(run), schema)


def media_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``read_media(to_media(df))`` with a digest of the fingerprint as ``feature``: its length and 64-bit hash."""
    out = read_media(to_media(df, id_col, text_col), id_col)
    digest = F.concat_ws(":", F.size("fingerprint").cast("string"), F.lower(F.hex(F.xxhash64("fingerprint"))))
    return out.withColumn("feature", digest)
