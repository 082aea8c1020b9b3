"""Numeric scalars of synthesis planning and playback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import policies as P
from lectern.functions import text as T


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def js_round(value: Column) -> Column:
    """Halves go up, also for negative numbers."""
    return F.floor(value + F.lit(0.5))


def clamp_rate(rate: Column) -> Column:
    bounded = F.least(F.greatest(rate, F.lit(P.MIN_RATE)), F.lit(P.MAX_RATE))
    return F.when(is_finite(rate), bounded).otherwise(F.lit(1.0))


def min_duration_s(text: Column, rate: Column, floor_s: float = P.MIN_AUDIO_SECONDS) -> Column:
    """Shortest plausible audio for a text: a quarter of the expected speaking time, never under the fixed floor."""
    tokens = T.estimate_tokens(text)
    expected = tokens / (F.lit(P.TOKENS_PER_SECOND) * clamp_rate(rate))
    return F.when(tokens <= 0, F.lit(floor_s)).otherwise(F.greatest(F.lit(floor_s), expected * P.DURATION_SAFETY))


def format_clock(seconds: Column) -> Column:
    whole = F.floor(seconds)
    text = F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))
    return F.when(is_finite(seconds) & (seconds > 0), text).otherwise("0:00")


def progress_percent(index: Column, count: Column) -> Column:
    ratio = F.least(F.greatest((index + 1) / count, F.lit(0.0)), F.lit(1.0))
    return F.when(count == 0, "0%").otherwise(F.concat(js_round(ratio * 100).cast("string"), F.lit("%")))


def char_at_ratio(played_s: Column, duration_s: Column, length: Column) -> Column:
    """Character reached after playing a part of the audio; null while the duration is unknown."""
    usable = is_finite(duration_s) & (duration_s > 0)
    ratio = F.least(F.greatest(F.try_divide(played_s, duration_s), F.lit(0.0)), F.lit(1.0))
    return F.when(usable, F.floor(ratio * length).cast("int"))


def seek_seconds(char_offset: Column, duration_s: Column, length: Column) -> Column:
    """Audio time of a character; null when it cannot be known."""
    usable = is_finite(duration_s) & (duration_s > 0) & (length > 0)
    return F.when(usable, F.least(duration_s, F.try_divide(char_offset, length) * duration_s))


def peak_memory_mb(used: Column, total: Column) -> Column:
    peak = F.greatest(F.coalesce(used, F.lit(0)), F.coalesce(total, F.lit(0)))
    return F.when(peak > 0, js_round(peak / F.lit(1048576.0) * 10) / 10)


def guard_repo_id(repo: Column) -> Column:
    return F.contains(repo, F.lit("/"))


def backoff_ms(attempt: Column, base: int) -> Column:
    """Delay after the given 1-based attempt, doubling each time."""
    return (F.lit(base) * F.pow(F.lit(2.0), attempt - 1)).cast("bigint")
