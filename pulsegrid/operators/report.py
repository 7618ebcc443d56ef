"""Reports over maps: confusion counts, metrics, bout statistics, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import iso_millis
from ..session import settled
from . import intervals as iv


def timed_events(tagged: DataFrame, start_ms: Column, fs: float, shift: int = 0) -> DataFrame:
    """(rec, event_type, start_t, end_t) of tagged intervals; shift is the number of samples trimmed off the front."""
    at = lambda c: iso_millis((start_ms + F.floor((F.col(c) + shift) * 1000.0 / fs)).cast("long"))
    return tagged.select("rec", F.col("map").alias("event_type"), at("start").alias("start_t"), at("end_excl").alias("end_t"))


def bout_meta(runs: DataFrame, lengths: DataFrame, fs: float, widened: float) -> DataFrame:
    """Kicks, minutes of movement (less half the widening per run), other minutes, onset gaps in seconds, by recording."""
    order = Window.partitionBy("rec").orderBy("start")
    r = runs.select("rec", "start", (F.col("end_excl") - F.col("start")).alias("size"), ((F.lead("start").over(order) - F.col("start")) / fs).alias("onset"))
    sums = r.groupBy("rec").agg(F.count("*").alias("kicks"), F.sum("size").alias("samples_in"), F.median("onset").alias("median_onset"), F.avg("size").alias("mean_size"))
    minutes = (F.col("samples_in") / fs - F.col("kicks") * (widened / 2)) / 60
    out = lengths.join(sums, "rec", "left").fillna(0, ["kicks", "samples_in"])
    out = out.withColumn("fm_minutes", minutes).withColumn("other_minutes", F.col("n") / fs / 60 - F.col("fm_minutes"))
    hours = F.col("n") / fs / 3600
    return out.select("rec", "kicks", "fm_minutes", "other_minutes", F.try_divide(F.col("kicks"), hours).alias("per_hour"), (F.col("mean_size") / fs).alias("mean_seconds"), "median_onset", F.try_divide(100 * F.col("samples_in"), F.col("n")).alias("active_percent"))


def onset_summary(runs: DataFrame, fs: float) -> DataFrame:
    """Count, mean, population deviation, least, greatest, median and quartiles of onset gaps; 0 where there are none."""
    order = Window.partitionBy("rec").orderBy("start")
    gaps = runs.select("rec", ((F.lead("start").over(order) - F.col("start")) / fs).alias("g"))
    q = F.percentile("g", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = gaps.groupBy("rec").agg(F.count("g").alias("n"), F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.min("g").alias("min"), F.max("g").alias("max"), q.alias("q"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.select("rec", "n", *(zero(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")), zero(F.get("q", F.lit(1))).alias("median"), zero(F.get("q", F.lit(0))).alias("p25"), zero(F.get("q", F.lit(2))).alias("p75"))


def confusion_counts(detections: DataFrame, press_runs: DataFrame, movement: DataFrame, lengths: DataFrame, back: int, ahead: int, least: int, window: int) -> DataFrame:
    """(rec, tp, fp, tn, fn) of detections against presses.

    A press window without movement is a hit if a detection overlaps it, else a miss. Detections that touch any press
    window, and all samples under press windows, are taken off the axis; what is left is numbered anew and cut into
    windows of `window` samples with one sample skipped between them: a window with `least` positives or more is a
    false positive, else a true negative.
    """
    detections, movement, lengths = settled(detections), settled(movement), settled(lengths)  # each is read several times
    around = press_runs.join(lengths, "rec").select("rec", F.greatest(F.lit(0), F.col("start") - back).alias("start"), F.least("n", F.col("end_excl") + ahead).alias("end_excl")).where("start < end_excl")
    free = settled(iv.overlapping(around, movement, "left_anti"))
    hit = iv.overlapping(free, detections, "left_semi").groupBy("rec").agg(F.count("*").alias("tp"))
    miss = iv.overlapping(free, detections, "left_anti").groupBy("rec").agg(F.count("*").alias("fn"))

    sensed = settled(iv.merge(free))
    taken = iv.union(iv.overlapping(detections, sensed, "left_semi"), sensed)
    left = iv.overlapping(detections, sensed, "left_anti")
    whole = lengths.select("rec", F.lit(0).cast("long").alias("start"), F.col("n").alias("end_excl")).where("n > 0")
    # stretches that stay, each with the number of samples that stay before it
    order = Window.partitionBy("rec").orderBy("start")
    stays = iv.subtract(whole, taken).withColumn("before", F.coalesce(F.sum(F.col("end_excl") - F.col("start")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stays = settled(stays)
    total = stays.groupBy("rec").agg(F.sum(F.col("end_excl") - F.col("start")).alias("m"))
    step = window + 1
    windows = total.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / step))).alias("w"))
    piece = lambda c: c - F.col("start") + F.col("before")
    inside = iv.met(stays, left.select("rec", "start", "end_excl"))
    inside = inside.select("rec", piece(F.greatest("other.start", "start")).alias("a"), piece(F.least("other.end_excl", "end_excl")).alias("b"))
    cut = inside.select("rec", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / step), F.floor((F.col("b") - 1) / step))).alias("w"))
    overlap = F.greatest(F.lit(0), F.least("b", F.col("w") * step + window) - F.greatest("a", F.col("w") * step))
    positives = cut.groupBy("rec", "w").agg(F.sum(overlap).alias("p"))
    judged = windows.join(positives, ["rec", "w"], "left").withColumn("fp", F.coalesce(F.col("p"), F.lit(0)) >= least)
    rest = judged.groupBy("rec").agg(F.count_if("fp").alias("fp"), F.count_if(~F.col("fp")).alias("tn"))
    out = lengths.select("rec").join(hit, "rec", "left").join(miss, "rec", "left").join(rest, "rec", "left")
    return out.select("rec", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")))


def match_presses(counts: DataFrame, press_runs: DataFrame, detections: DataFrame) -> DataFrame:
    """confusion_counts of predictions, with the numbers of presses and detections.

    A recording in which nothing was pressed says nothing of misses or of false alarms: its counts are all 0.
    """
    number = lambda d, name: d.groupBy("rec").agg(F.count("*").alias(name))
    out = counts.join(number(press_runs, "num_pressed"), "rec", "left").join(number(detections, "num_detections"), "rec", "left")
    out = out.fillna(0, ["num_pressed", "num_detections"])
    return out.select("rec", *(F.when(F.col("num_pressed") > 0, F.col(c)).otherwise(0).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")), "num_pressed", "num_detections")


def metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, sensitivity, precision, specificity, false positive rate, F1 and PABAK by recording and over all (rec null).

    A zero denominator gives null.
    """
    c = counts.groupingSets([["rec"], []], "rec").agg(*(F.sum(x).cast("double").alias(x) for x in ("tp", "fp", "tn", "fn")))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    acc = F.try_divide(tp + tn, tp + tn + fp + fn)
    named = {"accuracy": acc, "sensitivity": F.try_divide(tp, tp + fn), "precision": F.try_divide(tp, tp + fp), "specificity": F.try_divide(tn, tn + fp), "fp_rate": F.try_divide(fp, fp + tn), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "pabak": 2 * acc - 1}
    extra = {"sensation_calc": tp + fn, "sensor_calc": tp + fp + tn + fn, "ml_calc": tp + fp}
    return c.select("rec", *(v.cast("long").alias(k) for k, v in extra.items()), *(F.round(v, 6).alias(k) for k, v in named.items()))


def bouts(runs: DataFrame, gap: int, by: Sequence[str] = ("rec",)) -> DataFrame:
    """Bouts of runs of over one sample, a new one after a gap of over `gap`; samples with the gaps inside bouts."""
    w = runs.where("end_excl - start > 1").withColumn("gap", F.col("start") - F.lag("end_excl").over(Window.partitionBy(*by).orderBy("start")))
    size = F.col("end_excl") - F.col("start")
    short = F.coalesce(F.col("gap") <= gap, F.lit(False))
    return w.groupBy(*by).agg(F.count_if(~short).alias("bouts"), F.sum(size + F.when(short, F.col("gap")).otherwise(0)).alias("samples_in"), F.max(size).alias("longest"), F.min(size).alias("shortest"))


def bout_table(bouts_: DataFrame, hours: float) -> DataFrame:
    """Bouts of all recordings in one row, with their number by hour observed and their mean samples."""
    b, s = F.sum("bouts"), F.sum("samples_in")
    return bouts_.agg(b.alias("bouts"), s.alias("samples_in"), F.max("longest").alias("longest"), F.min("shortest").alias("shortest"), F.try_divide(b, F.lit(hours)).alias("per_hour"), F.try_divide(s, b).alias("mean_samples"))


def peak_levels(tall: DataFrame, windows: DataFrame, share: float) -> DataFrame:
    """(channel, level): the quantile `share` of the greatest magnitudes of a channel in each window.

    tall has rec, idx, channel and x; windows are disjoint intervals. A window without samples of a channel says nothing of it.
    """
    peaks = iv.held(tall, windows.select("rec", "start", "end_excl")).groupBy("rec", "start", "channel").agg(F.max(F.abs("x")).alias("peak"))
    return peaks.groupBy("channel").agg(F.percentile("peak", F.lit(share)).alias("level"))
