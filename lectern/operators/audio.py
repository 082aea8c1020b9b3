"""PCM tables. A clip is a row with `channels` (array of float arrays) and `sample_rate`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.operators.scan import BLOCK, running
from lectern.session import written


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def stitch_pcm(clips: DataFrame, block: int = BLOCK, folder: str | None = None) -> DataFrame:
    """Every clip resampled to its document's rate and channel count, with its place in the stitched sound.

    Output rows (doc_id, position, start_sample, n_samples, sample_rate, channels) are slices of one long sound: a
    document with any number of clips is never gathered into one row. Start positions come from a block-wise running
    sum, so a document that holds most of the clips still spreads over all tasks.

    Sizes are taken in one narrow pass; with a shared `folder` they are written there, and the samples are then read
    only once more, to be resampled.
    """
    # Sizes only: the samples themselves are shuffled once, by (doc_id, position), in the last join.
    duration = F.col("duration_s") if "duration_s" in clips.columns else F.size(F.get("channels", F.lit(0))) / F.col("sample_rate")
    narrow = clips.select("doc_id", "position", F.size("channels").alias("_n"), "sample_rate", duration.alias("_seconds"))
    narrow = written(narrow, folder and f"{folder}/sizes")
    target = narrow.groupBy("doc_id").agg(
        F.greatest(F.max("_n"), F.lit(1)).alias("_channels"), F.max("sample_rate").alias("_rate")
    )
    sized = narrow.drop("sample_rate").join(target, "doc_id").withColumn(
        "n_samples", F.ceil(F.col("_seconds") * F.col("_rate")).cast("int")
    )
    placed = running(sized, ["doc_id"], "position", {"start_sample": ("sum", F.col("n_samples"))}, block, inclusive=False)

    def resample(source: Column) -> Column:
        steps = F.greatest(F.lit(1), F.col("n_samples") - 1)
        last = F.size(source) - 1
        pick = lambda i: F.least(last, F.floor(i / steps * F.greatest(F.lit(0), last)).cast("int"))
        return F.transform(_positions(F.col("n_samples")), lambda i: F.coalesce(F.get(source, pick(i)), F.lit(0).cast("float")))

    spread = F.transform(
        _positions(F.col("_channels")),
        lambda c: resample(F.get("channels", F.least(c, F.size("channels") - 1))),
    )
    return clips.select("doc_id", "position", "channels").join(placed, ["doc_id", "position"]).select(
        "doc_id", "position", F.col("start_sample").cast("bigint").alias("start_sample"), "n_samples",
        F.col("_rate").alias("sample_rate"), spread.alias("channels"),
    )


def quantize_pcm(clips: DataFrame) -> DataFrame:
    """Adds `samples16`: channels interleaved as 16-bit integers."""

    def to_int(sample: Column) -> Column:
        x = F.least(F.greatest(sample.cast("double"), F.lit(-1.0)), F.lit(1.0))
        return N.js_round(F.when(x < 0, x * 32768).otherwise(x * 32767)).cast("int")

    length = F.coalesce(F.size(F.get("channels", F.lit(0))), F.lit(0))
    frames = F.transform(
        _positions(length), lambda i: F.transform("channels", lambda ch: to_int(F.coalesce(F.get(ch, i), F.lit(0).cast("float"))))
    )
    return clips.withColumn("samples16", F.flatten(frames))


def clip_stats(clips: DataFrame) -> DataFrame:
    """Adds n_samples over all channels, rms and duration_s."""
    energy = F.aggregate(F.flatten("channels"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n = F.aggregate("channels", F.lit(0), lambda a, ch: a + F.size(ch))
    return (
        clips.withColumn("n_samples", n)
        .withColumn("rms", F.sqrt(F.try_divide(energy, F.col("n_samples"))))
        .withColumn("duration_s", F.size(F.get("channels", F.lit(0))) / F.col("sample_rate"))
    )
