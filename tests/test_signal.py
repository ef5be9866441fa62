"""Signal measures against naive transforms and known signals."""

from __future__ import annotations

import numpy as np
import pytest

from corpusloom.functions import signal
from corpusloom.operators.signals import q_measures, tones

T = np.arange(signal.RATE * 8) / signal.RATE


@pytest.fixture(scope="module")
def voice():
    """A tone that swings around 135 Hz, with a little noise."""
    return (0.3 * np.sin(2 * np.pi * 135 * T + 10 * np.sin(2 * np.pi * 2 * T)) + 0.03 * np.random.default_rng(12345).standard_normal(len(T))).astype(np.float32)


def test_bands_against_a_plain_transform(voice):
    x = voice[: signal.FRAME + signal.HOP].astype(np.float64)
    got = signal.band_energies(x)
    edges = signal.band_edges()
    assert got.shape == (2, 33) and len(edges) == 34 and edges[0] == 55 and edges[-1] == 371
    for f in range(2):
        frame = x[f * signal.HOP : f * signal.HOP + signal.FRAME] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(signal.FRAME) / (signal.FRAME - 1)))
        for b in (0, 10, 32):
            bins = range(edges[b], max(edges[b + 1], edges[b] + 1))
            want = sum(abs(np.sum(frame * np.exp(-2j * np.pi * k * np.arange(signal.FRAME) / signal.FRAME))) ** 2 for k in bins)
            assert abs(got[f, b] - want) <= 1e-3 * max(want, 1e-3)


def test_prints():
    e = np.random.default_rng(1).random((5, 33)).astype(np.float32) * 100
    logs = np.log1p(e.astype(float)).astype(np.float32)
    got = signal.prints(e)
    for i in range(1, 5):
        want = sum(1 << j for j in range(32) if (logs[i, j + 1] - logs[i, j]) - (logs[i - 1, j + 1] - logs[i - 1, j]) > 0)
        assert got[i - 1] == want
    assert len(signal.prints(e[:1])) == 0


def test_measures(voice):
    loud, voiced = signal.loudness(voice, signal.band_energies(voice)), signal.pitch_timbre(voice)
    assert abs(loud["rms"] - np.sqrt(np.mean(voice.astype(float) ** 2))) < 1e-4 and abs(loud["crest_db"] - 20 * np.log10(np.abs(voice).max() / loud["rms"])) < 0.02
    assert 0 <= loud["silence_ratio"] <= 1 and 300 < loud["spectral_centroid_hz"] < 2000
    assert 110 < voiced["f0_median_hz"] < 165 and voiced["voiced_frames"] == 240 and voiced["voiced_share"] == 1.0 and voiced["hnr_db"] > 3
    pure = signal.pitch_timbre((0.3 * np.sin(2 * np.pi * 220 * T)).astype(np.float32))
    assert pure["f0_median_hz"] == round(signal.RATE / 46, 1)  # the first lag with 0.85 of the peak stands before it
    assert pure["f0_reliable"] is False and pure["level_variation"] < 0.01
    assert signal.loudness(voice[:100], signal.band_energies(voice[:100])) == {} == signal.pitch_timbre(voice[:8000])
    assert signal.pitch_timbre(np.zeros(20_000)) == {}


def test_find_print():
    rng = np.random.default_rng(2)
    hay = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    needle = hay[123:183].copy()
    needle[::7] ^= np.uint32(1)
    at, error = signal.find_print(needle, hay)
    assert abs(at - 123 * signal.HOP / signal.RATE) < 1e-9 and abs(error - np.bitwise_count(needle ^ hay[123:183]).mean() / 32) < 1e-6
    assert signal.find_print(hay[:39], hay) is None and signal.find_print(hay, hay[:100]) is None
    want = min(range(0, 441, 5), key=lambda i: (int(np.bitwise_count(needle ^ hay[i : i + 60]).sum()), i))
    assert abs(signal.find_print(needle, hay, 5)[0] - want * signal.HOP / signal.RATE) < 1e-9
    got = signal.identify_print(needle, {"b": rng.integers(0, 1 << 32, 200, dtype=np.uint32), "a": hay, "c": hay[:10]})
    assert got["best"] == "a" and got["margin"] > 0.3 and signal.identify_print(needle, {}) is None
    assert signal.identify_print(needle, {"a": hay})["runner_up"] == 0.5


def test_spectrum():
    x = np.sin(2 * np.pi * 200 * T) + 0.5 * np.sin(2 * np.pi * 208 * T)
    power = signal.welch(x)
    hz = np.array(signal.peaks(power, 2, 8)) * signal.RATE / 32_768
    assert abs(hz[0] - 200) < 0.5 and abs(hz[1] - 208) < 0.5
    assert signal.peaks(np.array([1.0, 5, 5, 4, 9]), 3, 2) == [4, 1] and signal.peaks(np.zeros(4), 2, 1) == []
    assert [signal.drift(v) for v in ([1.0], [100, 104], [100, 106], [100, 90])] == ["steady", "steady", "rising", "falling"]


def test_columns(spark):
    rows = spark.createDataFrame([(1, [0.5] * 64), (2, [0.0] * 64)], "vec_id long, embedding array<float>")
    t = tones(rows).unionByName(spark.createDataFrame([(3, None)], "vec_id long, samples array<float>"))
    got = {r["vec_id"]: r for r in t.select("vec_id", signal.measures("samples").alias("m"), signal.print_words("samples").alias("p")).collect()}
    assert got[1]["m"]["rms"] > 0 and len(got[1]["p"]) == 19 and got[2]["m"]["crest_db"] is None and got[3]["m"]["rms"] is None and got[3]["p"] == []


def test_lags_against_plain_sums():
    """The shorter transform wraps nothing onto the lags that are read, and blocks of probes make no difference."""
    frames = (0.2 * np.random.default_rng(5).standard_normal((20, signal.PITCH_FRAME))).astype(np.float32)
    level, zero, best, lag, at_lag, bright = signal._probe(frames)
    for k, x in enumerate(frames):
        y = (x - np.float32(x.astype(float).mean())).astype(float)
        sums = [float(y[: len(y) - n] @ y[n:]) for n in range(signal.RATE // signal.PITCH_LOW)]
        assert abs(sums[0] - zero[k]) < 1e-9 and abs(max(sums[signal.RATE // signal.PITCH_HIGH :]) - best[k]) < 1e-9 and abs(sums[lag[k]] - at_lag[k]) < 1e-9
    assert signal.PITCH_PADDED >= signal.PITCH_FRAME + signal.RATE // signal.PITCH_LOW - 1


def test_measures_are_dealt_to_all_cores(spark, sf_dir):
    """A small file of vectors is one partition, but each vector is a recording's work."""
    assert q_measures(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
