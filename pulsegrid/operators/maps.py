"""Masks of a recording: presses, body movement, sensor channels, sensation, and their combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv


def debounce(presses: DataFrame, lengths: DataFrame, r: int) -> DataFrame:
    """Press samples (rec, idx) to bounced-out intervals.

    A press is held until the next one if fewer than r idle samples lie between, else it is dropped; the last press
    of a recording is held to its end if that is as near. lengths has (rec, n).
    """
    order = Window.partitionBy("rec").orderBy("idx")
    held = presses.join(lengths, "rec").select("rec", F.col("idx").alias("start"), F.coalesce(F.lead("idx").over(order), "n").alias("end_excl"))
    return iv.merge(held.where(F.col("end_excl") - F.col("start") - 1 < r))


def thresholds(samples: DataFrame, factor: Column, cutoff: float, by: tuple[str, ...] = ("rec", "channel")) -> DataFrame:
    """Noise-adaptive threshold per channel: factor times the median magnitude of the lower quarter; infinite if null or below cutoff."""
    size = samples.select(*by, F.abs("x").alias("m"), factor.alias("_f"))
    quarter = size.groupBy(*by).agg(F.percentile("m", F.lit(0.25)).alias("lq"))
    low = size.join(quarter, [*by]).where("m <= lq").groupBy(*by).agg(F.percentile("m", F.lit(0.5)).alias("mid"), F.max("_f").alias("_f"))
    h = F.col("_f") * F.col("mid")
    return low.select(*by, F.when(h.isNull() | F.isnan(h) | (h < cutoff), F.lit(float("inf"))).otherwise(h).alias("h"))


def channel_masks(samples: DataFrame, thresholds_: DataFrame) -> DataFrame:
    """(rec, channel, start, end_excl) where a channel's magnitude reaches its threshold."""
    return iv.from_mask(samples.join(thresholds_, ["rec", "channel"]), F.abs("x") >= F.col("h"), ("rec", "channel"))


def movement_map(modalities: list[DataFrame], lengths: DataFrame, size: int) -> DataFrame:
    """Body movement: dilated modalities joined, without the first and the last sample of the recording."""
    wide = [iv.dilate(m.join(lengths, "rec"), size, F.col("n")) for m in modalities]
    joined = iv.union(*wide).join(lengths, "rec")
    return iv.clip(joined, F.lit(1), F.col("n") - 1)


def without_contaminated(segments: DataFrame, movement: DataFrame, by: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Segments, less every one that lies in a component of segments and movement in which the two share a sample."""
    movement = movement.select(*by, "start", "end_excl")
    parts = iv.union(segments, movement, by=by)
    shared = iv.intersect(iv.merge(segments, by), movement, by)
    bad = iv.overlapping(parts, shared, "left_semi", by)
    return iv.overlapping(segments, bad, "left_anti", by)


def sensation_map(presses: DataFrame, movement: DataFrame, lengths: DataFrame, back: int, ahead: int) -> DataFrame:
    """Windows around presses that no movement touches. Where windows overlap, the later press decides.

    presses are samples (rec, idx). A press rules from its window's start to the next press's window's start.
    """
    order = Window.partitionBy("rec").orderBy("idx")
    windows = presses.join(lengths, "rec").select("rec", "idx", F.greatest(F.lit(0), F.col("idx") - back).alias("start"), F.least(F.col("n"), F.col("idx") + ahead + 1).alias("end_excl"))
    clear = iv.overlapping(windows, movement, "left_anti").select("rec", "idx", F.lit(True).alias("clear"))
    ruled = windows.withColumn("end_excl", F.least("end_excl", F.coalesce(F.lead("start").over(order), "end_excl")))
    kept = ruled.join(clear, ["rec", "idx"]).where("start < end_excl")
    return iv.merge(kept)


def fuse(segments: DataFrame, channels: DataFrame, kind: str, least: int, kinds: DataFrame | None = None) -> DataFrame:
    """Components touched by at least `least` channels (kind 'number') or channel types (kind 'type').

    segments: (rec, start, end_excl) merged over channels; channels: (rec, channel, start, end_excl); kinds maps channel to type.
    """
    side = channels.join(F.broadcast(kinds), "channel").withColumnRenamed("type", "what") if kind == "type" else channels.withColumn("what", F.col("channel"))
    seen = iv.met(segments.select("rec", "start", "end_excl"), side.select("rec", "start", "end_excl", "what"))
    seen = seen.groupBy("rec", "start", "end_excl").agg(F.countDistinct("other.what").alias("k"))
    return seen.where(F.col("k") >= least).select("rec", "start", "end_excl")
