"""Sound features: mel cepstra, their differences, and histograms of quantized co-occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the features: coefficients, lags in order.
N_MFCC, LAGS = 13, (5, 2)


def mel_filters(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangles of unit area on the mel scale, which is linear to 1 kHz and logarithmic above."""
    to_mel = lambda f: np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))
    from_mel = lambda m: np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))
    edges = from_mel(np.linspace(0, to_mel(np.array(rate / 2)), n_mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / rate)
    up = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(samples: np.ndarray, rate: int, n: int = N_MFCC, n_fft: int = 2048, hop: int = 512, n_mels: int = 128) -> np.ndarray:
    """Cepstra (n x frames) of centred, Hann-weighted frames; power in decibels down to 80 below the peak."""
    x = np.pad(np.asarray(samples, float), n_fft // 2, mode="reflect" if len(samples) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(x, n_fft)[::hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    power = np.abs(np.fft.rfft(frames * window)) ** 2
    db = 10 * np.log10(np.maximum(1e-10, power @ mel_filters(rate, n_fft, n_mels).T))
    db = np.maximum(db, db.max(initial=-np.inf) - 80)
    k, m = np.arange(n)[:, None], np.arange(n_mels)
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * n_mels)) * np.where(k == 0, np.sqrt(1 / n_mels), np.sqrt(2 / n_mels))
    return basis @ db.T


def delta(x: np.ndarray, width: int = 9) -> np.ndarray:
    """Slope of a line through ``width`` frames around each, with the ends repeated."""
    half = width // 2
    d = np.arange(-half, half + 1)
    p = np.pad(x, ((0, 0), (half, half)), mode="edge")
    return sum(w * p[:, i : i + x.shape[1]] for i, w in enumerate(d)) / (d @ d)


def cooccurrences(codes: np.ndarray, n: int, lag: int) -> np.ndarray:
    if lag < 1:
        raise ValueError("lags start at 1")
    return np.bincount(codes[lag:] * n + codes[:-lag], minlength=n * n) if len(codes) > lag else np.zeros(n * n, np.int64)


def sound_histogram(samples: np.ndarray, rate: int, books: list[np.ndarray], lags=LAGS) -> np.ndarray:
    """Counts of lagged code pairs of cepstra, differences and second differences, each by its codebook (k x 13)."""
    c = mfcc(samples, rate)
    d = delta(c)
    out = []
    for x, book in zip((c, d, delta(d)), books, strict=True):
        codes = ((x.T[:, None] - book) ** 2).sum(2).argmin(1)
        out += [cooccurrences(codes, len(book), lag) for lag in lags]
    return np.concatenate(out)


def coded_frames(wavs: DataFrame, key: str, books: list[np.ndarray]) -> DataFrame:
    """``key, stream, t, code`` of ``wavs(key, rate, samples)``: each frame's code of cepstra, differences and second differences, a sound at a time."""
    kind = wavs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, rate, samples in zip(b[key], b["rate"], b["samples"], strict=True):
                c = mfcc(samples, int(rate))
                d = delta(c)
                for stream, (x, book) in enumerate(zip((c, d, delta(d)), books, strict=True)):
                    yield pd.DataFrame({key: name, "stream": stream, "t": np.arange(x.shape[1]), "code": ((x.T[:, None] - book) ** 2).sum(2).argmin(1)})

    return wavs.select(key, "rate", "samples").mapInPandas(run, f"{key} {kind}, stream int, t int, code long")


def sparse_histograms(wavs: DataFrame, key: str, books: list[np.ndarray], lags=LAGS) -> DataFrame:
    """``key, cell, n``: the cells of ``sound_histogram`` that aren't zero, counted by Spark from coded frames.

    What a sound has grows with its frames and not with the squares of the codebooks.
    """
    from ..operators.series import cooccurrences as counted

    frames, out, first = coded_frames(wavs, key, books).withColumn("__of", F.struct(key, "stream")), None, 0
    for stream, book in enumerate(books):
        part = counted(frames.filter(F.col("stream") == stream), "code", len(book), list(lags), "__of", "t")
        part = part.select(f"__of.{key}", (F.col("code") + first).alias("cell"), "n")
        out, first = part if out is None else out.unionByName(part), first + len(lags) * len(book) ** 2
    return out


def histograms(samples: Column, rate: Column, books: list[np.ndarray], lags=LAGS) -> Column:
    @F.pandas_udf("array<long>")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([sound_histogram(x, int(k), books, lags) for x, k in zip(s, r, strict=True)])

    return run(samples, rate)
