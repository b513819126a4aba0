"""Media columns: texts stored as WAV samples, their spectra, and peak-pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, sub_batches, tidy

BLOCK = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Frequency bins of the bands; the strongest local maximum of each band of a frame is a peak.
BANDS = ((2, 8), (8, 20), (20, 48), (48, 128))
#: A peak is paired with the strongest peak of each of this many following frames.
FAN = 3
#: Frames transformed at once; bounds the memory of a very long text.
FRAMES_AT_ONCE = 4096


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """``payload`` as the samples of a mono 8-bit WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes of a text (null: none) with bytes 0 up to a positive multiple of BLOCK, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def stft_power(samples: np.ndarray, first: int, n: int) -> np.ndarray:
    """Power of frames ``first .. first + n`` of the short-time Fourier transform (Hann window)."""
    need = (first + n - 1) * HOP + FRAME
    part = samples[first * HOP : need].astype(np.float32) - np.float32(128)
    part = np.pad(part, (0, need - first * HOP - len(part)))
    frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP] * np.hanning(FRAME).astype(np.float32)
    spectrum = np.fft.rfft(frames, axis=1)
    return (spectrum.real**2 + spectrum.imag**2).astype(np.float32)


def n_frames(n_samples: int) -> int:
    return max(1, -(-(n_samples - FRAME) // HOP) + 1)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame and band the bin of the strongest local maximum (0: none) and its power."""
    total = n_frames(len(samples))
    bins, power = [], []
    for first in range(0, total, FRAMES_AT_ONCE):
        p = stft_power(samples, first, min(FRAMES_AT_ONCE, total - first))
        top = np.zeros_like(p)
        middle = p[:, 1:-1]
        top[:, 1:-1] = np.where((middle > p[:, :-2]) & (middle >= p[:, 2:]), middle, 0)
        at = np.stack([a + top[:, a:b].argmax(1) for a, b in BANDS], 1)
        val = np.take_along_axis(top, at, 1)
        bins.append(np.where(val > 0, at, 0))
        power.append(val)
    return np.concatenate(bins).astype(np.int32), np.concatenate(power)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs: frame numbers, and codes ``bin << 10 | other bin << 2 | frames between``."""
    bins, power = peaks(samples)
    strongest = np.take_along_axis(bins, power.argmax(1)[:, None], 1)[:, 0]
    times, codes = [], []
    for gap in range(1, FAN + 1):
        a, b = bins[:-gap], strongest[gap:, None]
        t, band = np.nonzero((a > 0) & (b > 0))
        times.append(t)
        codes.append(a[t, band] << 10 | b[t, 0] << 2 | gap)
    t, c = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    at = np.lexsort((c, t))
    return t[at], c[at]


def _media(keep_media: bool, texts: list[str | None]) -> list[dict]:
    out = []
    for text in texts:
        payload, n_bytes = padded(text)
        media = to_wav(payload)
        back = from_wav(media)
        t, c = fingerprint(np.frombuffer(back, np.uint8))
        out.append({
            "n_bytes": n_bytes, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
            "tail_crc32": zlib.crc32(back[-BLOCK:]), "media_bytes": len(media),
            "media_sha256": hashlib.sha256(media).hexdigest(), "n_pairs": len(c),
            "fingerprint_sha256": hashlib.sha256(t.tobytes() + c.tobytes()).hexdigest(),
            **({"media": media, "pair_time": t, "pair_code": c} if keep_media else {}),
        })
    return out


DIGEST = ("n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
          "media_sha256 string, n_pairs long, fingerprint_sha256 string")
MEDIA = ", media binary, pair_time array<int>, pair_code array<int>"
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def wav_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store each whole text as a WAV file and fingerprint the samples that are read back.

    Returns ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    n_pairs, fingerprint_sha256`` and, with ``keep_media``, the WAV file ``media`` and the time-coded
    fingerprint arrays ``pair_time`` (frame) and ``pair_code``.

    One row a row, no shuffle.  A null text counts as empty; an empty text has a payload of 64 zero
    bytes.  A text of one frame, or without a local maximum, has an empty fingerprint.  A very long
    text is transformed in runs of FRAMES_AT_ONCE frames.  Equal texts give equal values; null ids stay, other columns are not
    read, and no rows give no rows.
    """
    fields = [f.split() for f in (DIGEST + (MEDIA if keep_media else "")).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # media and fingerprints are as large as the texts, so large batches are handed on in parts
            for part in sub_batches(batch, 1, 4 << 20, 256):
                rows = _media(keep_media, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array([r[k] for r in rows], _ARROW[t]) for k, t in fields)],
                    ["doc_id", *(k for k, _ in fields)])

    src = id_and_text(docs, id_col, text_col)
    return src.mapInArrow(tidy(run), f"doc_id {src.schema[0].dataType.simpleString()}, {', '.join(map(' '.join, fields))}")
