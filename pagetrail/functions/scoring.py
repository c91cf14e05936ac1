"""Scores as column expressions, shared by batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column, *, variant: str = "strict") -> Column:
    """``strict``: 0 for unequal lengths or a zero vector; ``unit``: shorter length, as (x + 1) / 2; ``eps``: 1e-4 added below;
    ``pct13``: first 13 numbers, times 100. Vectors are arrays of doubles; null or empty ones give 0 (unit: 0.5)."""
    if variant == "strict":
        n = norm(a) * norm(b)
        return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n), F.lit(0.0))
    if variant == "eps":
        return F.coalesce(dot(a, b) / (norm(a) * norm(b) + 1e-4), F.lit(0.0))
    size = F.least(F.size(a), F.size(b)) if variant == "unit" else F.lit(13)
    a, b = F.slice(a, F.lit(1), size), F.slice(b, F.lit(1), size)
    n = norm(a) * norm(b)
    x = F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))
    return (x + 1) / 2 if variant == "unit" else 100 * x


def fingerprint_score(cos: Column, d_rms: Column, d_centroid: Column, *, profile: str, page: Column | None = None, current: Column | None = None, spectral: Column | None = None, rel_rms: Column | None = None) -> Column:
    """Scores of an observation against a fingerprint from their cosine and absolute differences.

    ``basic`` and ``live`` fall off exponentially; ``live`` rejects cosines under 0.3 and adds for pages near the current one; ``linear``
    weighs what is there; ``relative`` takes relative differences; ``spectral`` adds a spectral cosine.
    """
    zero = F.lit(0.0)
    if profile == "basic":
        return 0.6 * cos + 0.2 * F.exp(-100 * d_rms) + 0.2 * F.exp(-d_centroid / 50)
    if profile == "live":
        gap = F.abs(page - current) if page is not None else F.lit(99)
        near = F.when(gap <= 1, 0.15).when(gap <= 3, 0.05).otherwise(0.0)
        return F.when(cos < 0.3, zero).otherwise(F.least(F.lit(1.0), 0.7 * cos + 0.15 * F.exp(-50 * d_rms) + 0.15 * F.exp(-d_centroid / 100) + near))
    if profile == "linear":
        return (0.6 * cos + 0.2 * F.greatest(zero, 1 - d_rms * 10) + 0.1 * F.greatest(zero, 1 - d_centroid / 1000)) / 0.9
    if profile == "relative":
        return 0.7 * cos + 0.15 * F.greatest(zero, 1 - d_rms) + 0.15 * F.greatest(zero, 1 - d_centroid)
    if profile == "spectral":
        return 0.6 * cos + 0.3 * spectral + 0.1 * F.greatest(zero, 1 - rel_rms)
    raise ValueError(profile)


def temporal_tier(page: Column, current: Column) -> Column:
    d = F.abs(page - current)
    return F.when(current.isNull(), 1.0).when(d == 1, 1.0).when(d <= 3, 0.9).when(d <= 10, 0.7).otherwise(0.3)


def fuse(page: Column, word: Column, temporal: Column, *, weights: tuple[float, float, float] = (0.3, 0.5, 0.2)) -> Column:
    return weights[0] * page + weights[1] * word + weights[2] * temporal


def duration_factor(candidate: Column, expected: Column, *, variant: str = "difference") -> Column:
    if variant == "difference":
        r = F.abs(candidate - expected) / expected
        return F.when(expected.isNull() | (expected <= 0), 1.0).when(r > 0.5, 0.3).when(r > 0.3, 0.6).when(r > 0.15, 0.8).when(r < 0.05, 1.1).otherwise(1.0)
    r = candidate / expected
    return F.when(expected.isNull() | (expected <= 0), 1.0).when((r < 0.5) | (r > 2), 0.3).when((r < 0.7) | (r > 1.43), 0.6).otherwise(1.0)


def temporal_boost(prob: Column, *, default: float = 1e-5) -> Column:
    return 1 + 10 * F.coalesce(prob, F.lit(default))


def sequential_adjust(mfcc: Column, text: Column, gap: Column, *, boost: float = 0.1, max_jump: int = 5) -> Column:
    base = 0.6 * mfcc + 0.4 * text
    out = F.when(gap == 1, base + boost).when(gap == 2, base + boost / 2).when(gap < 0, base * 0.1).when(gap > max_jump, base * 0.3).when(gap >= 3, base * F.greatest(F.lit(0.3), 1 - 0.1 * gap)).otherwise(base)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), out))


def speaker_class(flux_var: Column, rms: Column, *, profile: str = "coarse") -> Column:
    high, low, quiet = (10.0, 2.0, 0.0005) if profile == "coarse" else (5.0, 1.5, 0.002)
    return F.when(rms < quiet, "silence").when(flux_var > high, "choir").when(flux_var > low, "deacon").otherwise("celebrant")


def feature_confidence(distance: Column, *, scale: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * (1 - distance / scale)))


def frame_distance(a: Column, b: Column, d_rms: Column, d_zcr: Column) -> Column:
    """Root of the weighted squares of coefficient differences (weight 1 over its place), with loudness and crossings."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(_sum(F.transform(sq, lambda x, i: x / (i + 1)))) + 10 * d_rms + 5 * d_zcr


def timing_score(elapsed: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.greatest(F.lit(0.0), 1 - F.abs(elapsed - expected) / expected)).otherwise(0.5)
