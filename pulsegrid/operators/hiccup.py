"""Hiccups: long rhythmic stretches of movement, found per modality and fused, to be taken out of a movement map.

Intervals are folded and joined as in intervals.py; peaks are found once per region and sensor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from . import intervals as iv
from .filters import distant, local_maxima, moving_average, zero_outliers


@dataclass(frozen=True)
class HiccupParameters:
    """Seconds unless said otherwise; the defaults of the detector."""

    fs: float = 1024.0
    period: float = 5.0
    body_gap: float = 2.0
    continuous: float = 150.0
    exceptions_per_minute: float = 2.0
    tolerance: float = 6.0
    peak_distance: int = 800  # samples
    y_shift: float = 0.5
    std_share: float = 0.15
    bout_gap: float = 10.0
    outlier: float = 5.0
    fusion: str = "piezo_sup"

    def samples(self, seconds: float) -> int:
        return round(seconds * self.fs)


#: Sensors of each modality.
MODALITIES = {"piezo": ("s3", "s6"), "aclm": ("s1", "s2"), "acstc": ("s4", "s5")}
FUSIONS = {
    "piezo_sup": lambda c: (c["piezo"] > 0) | ((c["aclm"] > 0) & (c["acstc"] > 0)),
    "any_type": lambda c: sum((F.when(x > 0, 1).otherwise(0) for x in c.values()), F.lit(0)) >= 1,
    "two_type": lambda c: sum((F.when(x > 0, 1).otherwise(0) for x in c.values()), F.lit(0)) >= 2,
    "three_type": lambda c: sum((F.when(x > 0, 1).otherwise(0) for x in c.values()), F.lit(0)) >= 3,
}


def candidate_regions(reduced: DataFrame, movement: DataFrame, lengths: DataFrame, p: HiccupParameters) -> DataFrame:
    """Regions long and continuous enough to be hiccups; each ends one sample before its interval does."""
    wide = iv.dilate(reduced.join(lengths, "rec"), p.samples(p.period), F.col("n"))
    joined = iv.fill_gaps_over(wide, movement, p.samples(p.body_gap))
    runs = iv.continuity(joined, p.samples(p.continuous), p.samples(60 / p.exceptions_per_minute), p.samples(p.tolerance))
    return iv.regions(runs)


def consistent(regions: DataFrame, samples: DataFrame, sensor: str, p: HiccupParameters, width: int) -> DataFrame:
    """Regions whose peaks on a sensor are of like height; a region without peaks counts as consistent.

    A peak reaches the moving average plus y_shift times the range of the outlier-free signal. samples: (rec, idx, <sensor>).
    """
    s = samples.select("rec", "idx", F.col(sensor).cast("double").alias("x"))
    median = s.groupBy("rec").agg(F.median("x").alias("med"))
    near = s.join(median, "rec")
    mad = near.groupBy("rec").agg(F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"))
    plain = near.join(mad, "rec").withColumn("y", zero_outliers(F.col("x"), F.col("med"), F.col("mad"), p.outlier))
    spread = plain.groupBy("rec").agg((F.max("y") - F.min("y")).alias("spread"))
    level = s.join(spread, "rec").withColumn("level", moving_average("x", width) + F.col("spread") * p.y_shift)
    inside = iv.held(level, regions.select("rec", "region", "start", "end_excl"))
    inside = inside.select("rec", "region", "idx", "x", "level")
    peaks = local_maxima(inside, "x", ("rec", "region")).join(inside.select("rec", "region", "idx", "level"), ["rec", "region", "idx"]).where("x >= level")

    kept = distant(peaks.select("rec", "region", "idx", "x"), p.peak_distance, ("rec", "region"))
    stats = kept.groupBy("rec", "region").agg(F.stddev_pop("x").alias("sd"), (F.max("x") - F.min("x")).alias("height"))
    judged = regions.join(stats, ["rec", "region"], "left")
    return judged.where(~(F.coalesce("sd", F.lit(0.0)) > F.lit(p.std_share) * F.coalesce("height", F.lit(0.0)))).select("rec", "start", "end_excl")


def detect_hiccups(reduced: DataFrame, movement: DataFrame, samples: DataFrame, lengths: DataFrame, p: HiccupParameters | None = None, width: int = 7168) -> DataFrame:
    """Hiccup map (rec, start, end_excl). No region gives no rows."""
    p = p or HiccupParameters()
    regions = settled(candidate_regions(reduced, movement, lengths, p))  # read once per sensor
    tagged = None
    for name, sensors in MODALITIES.items():
        for sensor in (s for s in sensors if s in samples.columns):
            part = iv.tag(consistent(regions, samples, sensor, p, width), name)
            tagged = part if tagged is None else tagged.unionByName(part)
    tagged = settled(iv.merge(tagged, ("rec", "map")))
    fused = iv.sweep(tagged, list(MODALITIES), FUSIONS[p.fusion])
    return iv.session_merge(fused, p.samples(p.bout_gap))


def without_hiccups(movement_map: DataFrame, hiccups: DataFrame) -> DataFrame:
    return iv.subtract(movement_map, hiccups)


def bouts_by_modality(tagged: DataFrame, fs: float, gap: float, hours: float = 31.0) -> DataFrame:
    """Per map: bouts, minutes in bouts (short gaps inside count), longest, shortest, mean, bouts per hour."""
    order = Window.partitionBy("rec", "map").orderBy("start")
    w = tagged.where("end_excl - start > 1").withColumn("gap", F.col("start") - F.lag("end_excl").over(order))
    short = F.coalesce(F.col("gap") <= gap * fs, F.lit(False))
    w = w.withColumn("bout", F.sum(F.when(short, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.sum(F.col("end_excl") - F.col("start") + F.when(short, F.col("gap")).otherwise(0)) / fs / 60
    each = w.groupBy("rec", "map", "bout").agg(size.alias("minutes"))
    return each.groupBy("map").agg(F.count("*").alias("bouts"), F.sum("minutes").alias("minutes"), F.max("minutes").alias("longest"), F.min("minutes").alias("shortest"), F.avg("minutes").alias("mean"), (F.count("*") / hours).alias("per_hour"))
