"""WAV files and spectra: decoding and transforms run on batches of signals."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_wav(content: bytes, channel: int = 0, standardise: bool = True) -> tuple[int, np.ndarray]:
    """(rate, samples) of one channel of an 8, 16, 24 or 32 bit PCM file."""
    with wave.open(io.BytesIO(content)) as w:
        rate, width, channels = w.getframerate(), w.getsampwidth(), w.getnchannels()
        raw = w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float) - (128 if width == 1 else 0)
    x = x.reshape(-1, channels)[:, channel].astype(float)
    if standardise and len(x) and x.std() > 0:
        x = (x - x.mean()) / x.std()
    return rate, x


def read_wav(spark: SparkSession, path: str, channel: int = 0, standardise: bool = True) -> DataFrame:
    """path, rate, signal of each file."""

    def decode(batches):
        for pdf in batches:
            got = [decode_wav(c, channel, standardise) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "rate": [r for r, _ in got], "signal": [x for _, x in got]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(decode, "path string, rate int, signal array<double>")


def taper(size: int) -> np.ndarray:
    """Blackman window."""
    return np.blackman(size)


def spectra(df: DataFrame, key: str, signal: str, size: int, overlap: int, power: bool = True) -> DataFrame:
    """key, window, spectrum: tapered real FFT of overlapping windows; power is one-sided (inner bins doubled), relative to the window's energy."""
    step = max(1, size - overlap)
    kind = dict(df.dtypes)[key]

    def transform(batches):
        k = taper(size)
        for pdf in batches:
            keys, numbers, rows = [], [], []
            for name, x in zip(pdf["key"], pdf["x"], strict=True):
                x = np.asarray(x, float)
                if len(x) < size:
                    continue
                w = np.lib.stride_tricks.sliding_window_view(x, size)[::step]
                s = np.abs(np.fft.rfft(w * k, axis=1))
                if power:
                    s = s**2 / (k**2).sum()
                    s[:, 1 : (size + 1) // 2] *= 2
                keys += [name] * len(s)
                numbers += range(len(s))
                rows += list(s)
            yield pd.DataFrame({"key": pd.Series(keys, dtype=pdf["key"].dtype), "window": pd.Series(numbers, dtype="int32"), "spectrum": rows})

    rows = df.select(F.col(key).alias("key"), F.col(signal).cast("array<double>").alias("x"))
    return rows.mapInPandas(transform, f"key {kind}, window int, spectrum array<double>").withColumnRenamed("key", key)


def band_edges(bins: int, bands: int, least: int = 1) -> list[int]:
    """Edges of bands that are even on a logarithmic scale, from the first bin above zero frequency, with at least `least` bins each."""
    if bins - 1 < bands * least:
        raise ValueError("too few bins for the bands")
    room = least * np.arange(bands + 1)
    spare = np.rint(np.logspace(0, np.log10(bins), bands + 1)).astype(int) - room
    return (np.clip(np.maximum.accumulate(spare), 1, bins - room[-1]) + room).tolist()


def pool_bands(df: DataFrame, spectrum: str, edges: list[int]) -> DataFrame:
    """Mean of each band, as array expressions."""
    means = [F.aggregate(F.slice(spectrum, a + 1, b - a), F.lit(0.0), lambda acc, x: acc + x) / (b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return df.withColumn("bands", F.array(*means))


def hartley(x: np.ndarray) -> np.ndarray:
    f = np.fft.fft(x, axis=-1)
    return f.real - f.imag


def downsample(x: np.ndarray, factor: int) -> np.ndarray:
    """Every factor-th sample after a windowed-sinc low pass of 8 taps a step on each side."""
    n = np.arange(-8 * factor, 8 * factor + 1)
    h = np.sinc(n / factor) * np.hamming(len(n))
    return np.convolve(x, h / h.sum(), "same")[::factor]
