"""Numeric classes and rounding as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import c


def rounded(x: Column | str, digits: int) -> Column:
    """Half to even, on binary doubles."""
    return F.rint(c(x) * 10.0**digits) / 10.0**digits


def duration_tag(seconds: Column | str) -> Column:
    m = c(seconds) / 60
    low = F.floor(m / 10).cast("int") * 10
    return F.when(c(seconds) == 0, "").when(m < 10, "Duration: <10").when(m >= 120, "Duration: 120+").otherwise(F.format_string("Duration: %d-%d", low, low + 10))


def voice_from_pitch(f0: Column | str, reliable: Column) -> Column:
    p = c(f0)
    return F.when((p <= 0) | ~reliable, "").when(p < 135, "masc").when(p > 175, "fem").otherwise("")


def reliable_pitch(f0: Column | str, spread: Column | str) -> Column:
    p, s = c(f0), c(spread)
    return (s <= F.greatest(F.lit(40.0), 0.35 * p)) & (s >= 8) & (p >= 69) & (p <= 360)


def beat_band(hz: Column | str) -> Column:
    h = c(hz)
    return F.when(h < 0.3, "").when(h < 4, "delta").when(h < 8, "theta").when(h < 13, "alpha").when(h < 30, "beta").otherwise("gamma")


def tone_shape(purity: Column, low: Column, mid: Column, high: Column, beat: Column, steady: Column) -> Column:
    tonal = (purity >= 0.35) & (low + mid > 0.9)
    return (
        F.when(tonal & beat.isNotNull() & (beat >= 0.5) & (beat <= 40) & steady, "binaural pair")
        .when(tonal & beat.isNotNull() & (beat < 0.5), "single tone")
        .when(tonal, "tonal")
        .when(purity >= 0.15, "layered tones")
        .when(high > 0.15, "broadband")
        .otherwise("low-frequency wash")
    )


def alias_fold(hz: Column | str, rate: float) -> Column:
    """A frequency as it appears after sampling at ``rate``."""
    p = F.pmod(c(hz), F.lit(float(rate)))
    return F.when(p > rate / 2, rate - p).otherwise(p)


def dot(a: Column | str, b: Column | str) -> Column:
    """Over the shorter length."""
    n = F.least(F.size(c(a)), F.size(c(b)))
    return F.aggregate(F.zip_with(F.slice(c(a), 1, n), F.slice(c(b), 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of an even number."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
