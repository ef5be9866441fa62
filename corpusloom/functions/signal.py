"""Measures of mono signals, in numpy over all frames at once, and as Arrow UDFs on sample arrays.

Samples enter as arrays of floats at ``RATE``; decoding a container is outside
this engine. A signal is one row, so a recording's length bounds the memory of
a task.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sample rate, frame, hop and number of bands of a print.
RATE, FRAME, HOP, BANDS = 11_025, 2048, 1024, 33
#: Lowest and highest frequency of the bands.
LOWEST, HIGHEST = 300.0, 2000.0
#: Probes, frame and range of the pitch search, share of the peak at which an earlier lag is taken.
PROBES, PITCH_FRAME, PITCH_LOW, PITCH_HIGH, EARLY = 240, 4096, 60, 400, 0.85
#: A pitch frame and its longest lag in a length that transforms fast, and probes transformed at once (they stay in cache).
PITCH_PADDED, PROBE_BLOCK = 4320, 16

MEASURES = "rms double, peak double, crest_db double, silence_ratio double, spectral_centroid_hz double, f0_median_hz double, f0_spread_hz double, f0_reliable boolean, voiced_frames int, hnr_db double, level_variation double, voiced_share double, brightness_hz double, brightness_spread_hz double"


@cache
def _window(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))


def band_edges() -> np.ndarray:
    """First bin of each band, log-spaced, and one more."""
    return np.floor(LOWEST * (HIGHEST / LOWEST) ** (np.arange(BANDS + 1) / BANDS) / (RATE / FRAME)).astype(int)


def _bands() -> list[tuple[int, int]]:
    e = band_edges()
    return [(a, max(b, a + 1)) for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        return np.zeros((0, size), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def _power(frames: np.ndarray, size: int | None = None) -> np.ndarray:
    spectrum = np.fft.rfft(frames, size, axis=1)
    return spectrum.real**2 + spectrum.imag**2


def band_energies(samples: np.ndarray) -> np.ndarray:
    """Energy of each band in each frame, in single precision as stores keep it."""
    x = np.asarray(samples, np.float32)
    power = _power(_frames(x, FRAME, HOP) * _window(FRAME).astype(np.float32))
    return np.stack([power[:, a:b].sum(axis=1) for a, b in _bands()], axis=1).astype(np.float32)


def prints(energies: np.ndarray) -> np.ndarray:
    """32 bits a frame from the second on: whether the step to the next band has grown since the frame before."""
    if len(energies) < 2:
        return np.zeros(0, np.uint32)
    across = np.diff(np.log1p(energies.astype(np.float64)).astype(np.float32), axis=1)
    grown = np.diff(across, axis=0) > 0
    return (grown.astype(np.uint64) << np.arange(BANDS - 1, dtype=np.uint64)).sum(axis=1).astype(np.uint32)


def loudness(samples: np.ndarray, energies: np.ndarray) -> dict:
    """Level, peak, crest, share of quiet frames and centroid of a signal of a second or more; else nothing."""
    x = np.asarray(samples, np.float32)
    if len(x) < RATE:
        return {}
    rms, peak = float(np.sqrt(np.mean((x * x).astype(np.float64)))), float(np.abs(x).max())
    e = energies.astype(np.float64)
    total = e.sum(axis=1)
    centre = np.array([(a + b - 1) / 2 * RATE / FRAME for a, b in _bands()])
    middle = np.divide(e @ centre, total, out=np.zeros(len(e)), where=total > 0)
    quiet = np.mean(total < np.percentile(total, 10) * 1.5)
    crest = round(20 * np.log10(peak / rms), 2) if rms > 0 else None
    return {"rms": round(rms, 5), "peak": round(peak, 4), "crest_db": crest, "silence_ratio": round(float(quiet), 3), "spectral_centroid_hz": round(float(middle.mean()), 1)}


def _probe(frames: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each frame that is loud and not silent: level, value at lag zero, highest value and lag taken of the autocorrelation, and the centroid (NaN without power or period)."""
    level = np.sqrt((frames * frames).astype(np.float64).mean(axis=1))
    loud = level >= 0.01
    frames, level = frames[loud], level[loud]
    frames = (frames - frames.astype(np.float64).mean(axis=1, keepdims=True).astype(np.float32)).astype(np.float64)
    low, high = RATE // PITCH_HIGH, RATE // PITCH_LOW
    own = np.fft.irfft(_power(frames, PITCH_PADDED), PITCH_PADDED, axis=1)[:, :high]
    zero, best = own[:, 0], own[:, low:].max(axis=1, initial=-np.inf)
    good = (zero > 0) & (best > 0)
    frames, level, own, zero, best = frames[good], level[good], own[good], zero[good], best[good]
    inner = np.arange(low + 1, high - 1)
    early = (own[:, inner] >= EARLY * best[:, None]) & (own[:, inner] >= own[:, inner - 1])
    lag = np.where(early.any(axis=1), inner[early.argmax(axis=1)] if len(early) else 0, low + own[:, low:].argmax(axis=1) if len(own) else 0)
    at_lag, bright = own[np.arange(len(own)), lag], np.full(len(own), np.nan)
    keep = np.flatnonzero(_periodic(best, zero) > 0.05)
    power = _power(frames[keep, :FRAME] * _window(FRAME))
    total = power.sum(axis=1)
    bright[keep[total > 0]] = (power @ (np.arange(FRAME // 2 + 1) * RATE / FRAME))[total > 0] / total[total > 0]
    return level, zero, best, lag, at_lag, bright


def _periodic(best: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return np.clip(best / zero, 0, 0.999)


def pitch_timbre(samples: np.ndarray) -> dict:
    """Pitch by autocorrelation and timbre over evenly spread probes; each part needs eight frames."""
    x = np.asarray(samples, np.float32)
    if len(x) < 2 * PITCH_FRAME:
        return {}
    at = (np.arange(PROBES) * (len(x) - PITCH_FRAME - 1) / (PROBES - 1)).astype(int)
    frames = np.lib.stride_tricks.sliding_window_view(x, PITCH_FRAME)
    parts = [_probe(frames[at[k : k + PROBE_BLOCK]]) for k in range(0, PROBES, PROBE_BLOCK)]
    level, zero, best, lag, at_lag, bright = (np.concatenate(c) for c in zip(*parts, strict=True))
    found = RATE / lag[at_lag / zero > 0.3]
    out: dict = {}
    if len(found) >= 8:
        q1, median, q3 = np.percentile(found, [25, 50, 75])
        spread = q3 - q1
        reliable = not (spread > max(40, 0.35 * median) or spread < 8 or median < 69 or median > 360)
        out |= {"f0_median_hz": round(float(median), 1), "f0_spread_hz": round(float(spread), 1), "f0_reliable": bool(reliable), "voiced_frames": len(found)}
    periodic = _periodic(best, zero)
    keep = periodic > 0.05
    if keep.sum() >= 8:
        ratio, level, bright = np.median(periodic[keep]), level[keep], bright[~np.isnan(bright)]
        out |= {"hnr_db": round(float(10 * np.log10(ratio / (1 - ratio))), 1), "level_variation": round(float(level.std() / max(level.mean(), 1e-9)), 3), "voiced_share": round(float(keep.sum() / PROBES), 3)}
        if len(bright):
            q1, median, q3 = np.percentile(bright, [25, 50, 75])
            out |= {"brightness_hz": round(float(median), 1), "brightness_spread_hz": round(float(q3 - q1), 1)}
    return out


def find_print(needle: np.ndarray, hay: np.ndarray, step: int = 1) -> tuple[float, float] | None:
    """Seconds into ``hay`` at which ``needle`` fits best, and the mean share of differing bits there; the first of equals."""
    n = len(needle)
    if n < 40 or len(hay) < n:
        return None
    best, at = np.inf, 0
    starts = np.arange(0, len(hay) - n + 1, max(1, step))
    view = np.lib.stride_tricks.sliding_window_view(np.asarray(hay, np.uint32), n)
    for k in range(0, len(starts), 4096):  # bounds the memory
        apart = np.bitwise_count(view[starts[k : k + 4096]] ^ np.asarray(needle, np.uint32)).sum(axis=1)
        if apart.min() < best:
            best, at = int(apart.min()), int(starts[k + apart.argmin()])
    return at * HOP / RATE, float(np.float32(best / n)) / 32


def identify_print(needle: np.ndarray, candidates: dict[str, np.ndarray], step: int = 1) -> dict | None:
    """The candidate that fits best, its runner-up's error (0.5 if alone) and the margin between them; ties by name."""
    found = sorted((m[1], name, m[0]) for name in sorted(candidates) if (m := find_print(needle, candidates[name], step)) is not None)
    if not found:
        return None
    error, name, offset = found[0]
    runner = found[1][0] if len(found) > 1 else 0.5
    return {"best": name, "offset": offset, "error": error, "runner_up": runner, "margin": runner - error}


def welch(samples: np.ndarray, size: int = 32_768) -> np.ndarray:
    """Mean power spectrum over half-overlapping windows."""
    x = np.asarray(samples, np.float64)
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return _power(_frames(x, size, size // 2) * _window(size)).mean(axis=0)


def peaks(spectrum: np.ndarray, most: int, apart: int) -> list[int]:
    """Bins of the largest values, each at least ``apart`` bins from all larger ones taken; ties to the lower bin."""
    left, out = np.array(spectrum, np.float64), []
    for _ in range(most):
        k = int(left.argmax()) if len(left) else 0
        if not len(left) or not left[k] > 0:
            break
        out.append(k)
        left[max(0, k - apart + 1) : k + apart] = 0
    return out


def drift(values: list[float], band: float = 0.05) -> str:
    """Whether the last of ordered values is above or below the first by more than a share of it."""
    if len(values) < 2 or abs(values[-1] - values[0]) <= band * abs(values[0]):
        return "steady"
    return "rising" if values[-1] > values[0] else "falling"


def measures(samples: Column | str) -> Column:
    """All measures of a sample array as a struct; what a signal is too short for is null."""

    def run(signals: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in MEASURES.split(", ")]
        rows = []
        for s in signals:
            x = np.asarray([] if s is None else s, np.float32)
            rows.append(loudness(x, band_energies(x)) | pitch_timbre(x))
        out = pd.DataFrame(rows, columns=names).astype(object)
        return out.where(out.notna(), None)

    return F.pandas_udf(run, MEASURES)(F.col(samples) if isinstance(samples, str) else samples)


def print_words(samples: Column | str) -> Column:
    """The print of a sample array, unsigned words as longs."""

    def run(signals: pd.Series) -> pd.Series:
        return signals.map(lambda s: prints(band_energies(np.asarray([] if s is None else s, np.float32))).astype(np.int64))

    return F.pandas_udf(run, "array<long>")(F.col(samples) if isinstance(samples, str) else samples)
