"""Recordings to detections and features: load, preprocess, segment, fuse, label, slice.

Stages are lazy; detect() writes down what several of them read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SENSORS, Base, Features, Fusion, Preprocess, Segment
from ..functions import arrays, scalar, spectral
from ..operators import align, filters, maps
from ..operators import intervals as iv
from ..session import settled

IMU = ("roll", "pitch", "yaw")


def load(raw: DataFrame) -> DataFrame:
    """Sample rows of sources.recordings to the wide table rec, idx, sensor_1..6, imu_acc, roll, pitch, yaw, press."""
    volt = lambda c, i: scalar.volts(F.get(c, F.lit(i)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    two = F.size("piezo") == 2  # the second format has two piezo channels, on sensors 3 and 6
    s = raw.select(
        "rec", "idx", F.coalesce("press", F.lit(0)).cast("tinyint").alias("press"),
        zero(scalar.norm(volt("accel", 0), volt("accel", 1), volt("accel", 2))).alias("sensor_1"),
        zero(scalar.norm(volt("accel", 3), volt("accel", 4), volt("accel", 5))).alias("sensor_2"),
        zero(volt("piezo", 0)).alias("sensor_3"),
        zero(F.when(~two, volt("piezo", 1))).alias("sensor_4"),
        zero(F.when(~two, volt("piezo", 2))).alias("sensor_5"),
        zero(F.when(two, volt("piezo", 1)).otherwise(volt("piezo", 3))).alias("sensor_6"),
        *((F.get("imu", F.lit(i)) / float(scalar.QUATERNION_COUNTS)).alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))),
        *((F.get("imu", F.lit(7 + i)) / float(scalar.ACCELERATION_COUNTS)).alias(c) for i, c in enumerate(("ax", "ay", "az"))),
    )
    imu = ("qw", "qx", "qy", "qz", "ax", "ay", "az")
    s = align.interpolated(s, {c: c for c in imu}).fillna(0.0, list(imu))
    s = s.withColumn("imu_acc", scalar.norm(F.col("ax"), F.col("ay"), F.col("az"))).drop("ax", "ay", "az")
    s = align.unit_quaternions(s)
    roll, pitch, yaw = scalar.euler_degrees(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    s = s.withColumn("roll", roll).withColumn("pitch", pitch).withColumn("yaw", yaw).drop("qw", "qx", "qy", "qz")
    empty = (F.col("roll") == 0) & (F.col("pitch") == 0) & (F.col("yaw") == 0)
    s = s.select(*(c for c in s.columns if c not in IMU), *(F.when(~empty, F.col(c)).alias(c) for c in IMU))
    return s.select("rec", "idx", *SENSORS, "imu_acc", "press", *(F.coalesce(align.filled(F.col(c)), F.lit(0.0)).alias(c) for c in IMU))


def preprocess(samples: DataFrame, p: Preprocess) -> tuple[DataFrame, DataFrame]:
    """Filtered and trimmed samples with rot1d, and debounced presses as samples (rec, idx)."""
    bands = dict.fromkeys(SENSORS, (1.0, 30.0)) | dict.fromkeys(("imu_acc", *IMU), (1.0, 10.0))
    s = align.trim_edges(filters.band_pass(samples, bands, p.sensor_freq), p.sensor_freq)
    s = filters.first_component(s, IMU, "rot1d")
    return s, pressed(s, p)


def pressed(s: DataFrame, p: Preprocess) -> DataFrame:
    """Press samples (rec, idx), debounced if asked."""
    presses = s.where("press = 1").select("rec", "idx")
    if p.resolve_debounce:
        presses = iv.to_mask(maps.debounce(presses, s.groupBy("rec").agg(F.count("*").alias("n")), p.debounce_samples))
    return presses


def body_movement(s: DataFrame, n: DataFrame, p: Segment) -> DataFrame:
    """Movement map of the modalities asked for. Where sensors vote, each is widened before the count."""
    size, masks = p.samples(p.imu_dilation), []
    if "imu_acceleration" in p.imu_modalities:
        masks.append(iv.from_mask(s, F.abs("imu_acc") >= p.imu_acceleration_threshold))
    if "imu_rotation" in p.imu_modalities:
        masks.append(iv.from_mask(s, (F.abs("roll") > p.imu_rotation_threshold) | (F.abs("yaw") > p.imu_rotation_threshold)))
    out = maps.movement_map(masks, n, size) if masks else None
    if "sensors" in p.imu_modalities:
        sensors = list(p.percentile_threshold)
        tall = channels(s, sensors).where(F.abs("x") >= F.element_at(F.create_map(*(F.lit(v) for c in sensors for v in (c, float(p.percentile_threshold[c])))), F.col("channel")))
        wide = iv.dilate(iv.from_mask(tall, F.lit(True), ("rec", "channel")).join(n, "rec"), size, F.col("n"), ("rec", "channel"))
        votes = iv.vote(wide.withColumnRenamed("channel", "map"), sensors, p.num_common_sensors_imu)
        votes = iv.clip(votes.join(n, "rec"), F.lit(1), F.col("n") - 1)
        out = votes if out is None else iv.union(out, votes)
    return out


def channels(s: DataFrame, sensors: list[str]) -> DataFrame:
    """(rec, idx, channel, x): one row per sample and sensor."""
    return s.select("rec", "idx", F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).alias("x")) for c in sensors))).alias("c")).select("rec", "idx", "c.channel", "c.x")


def segment(s: DataFrame, p: Segment) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(movement map, thresholds per channel, cleaned segments per channel)."""
    n = s.groupBy("rec").agg(F.count("*").alias("n"))
    movement = body_movement(s, n, p)
    tall = channels(s, p.sensors)
    factors = F.element_at(F.create_map(*(F.lit(v) for c in p.sensors for v in (c, p.factor(c)))), F.col("channel"))
    h = maps.thresholds(tall, factors, p.fm_signal_cutoff)
    key = ("rec", "channel")
    runs = iv.dilate(maps.channel_masks(tall, h).join(n, "rec"), p.samples(p.fm_dilation) + 1, F.col("n"), key)
    if p.remove_imu:
        per_channel = movement.crossJoin(F.broadcast(s.sparkSession.createDataFrame([(c,) for c in p.sensors], "channel string")))
        runs = maps.without_contaminated(runs, per_channel.select(*key, "start", "end_excl"), key)
    runs = iv.clip(runs.join(n, "rec"), F.lit(1), F.col("n") - 1, key)
    return movement, h, runs


def detections(runs: DataFrame, f: Fusion) -> DataFrame:
    """(rec, det_id, start, end_excl): components of all channels; the scheme counts only if every sensor type is selected."""
    joined = iv.merge(runs.select("rec", "start", "end_excl"))
    if f.all_types:
        kind, least = f.desired_scheme
        pairs = [(c, k) for k, cs in f.sensor_map.items() for c in cs]
        joined = maps.fuse(joined, runs, kind, int(least), runs.sparkSession.createDataFrame(pairs, "channel string, type string"))
    return iv.label(joined)


def labelled(dets: DataFrame, presses: DataFrame, movement: DataFrame, n: DataFrame, p: Segment) -> DataFrame:
    """Detections with label 1 if any sensation falls in them, else 0."""
    felt = maps.sensation_map(presses, movement, n, p.samples(p.maternal_dilation_backward), p.samples(p.maternal_dilation_forward))
    width = max(p.samples(60), 1)
    yes = iv.overlapping(dets, felt, "left_semi", width=width).withColumn("label", F.lit(1))
    return yes.unionByName(iv.overlapping(dets, felt, "left_anti", width=width).withColumn("label", F.lit(0)))


def slices(s: DataFrame, dets: DataFrame, names: list[str]) -> DataFrame:
    """(rec, det_id, start, end_excl, channel, x): the values of each channel in each detection, in order.

    An array is as long as its detection, never as its recording.
    """
    inside = iv.held(s, dets.select("rec", "det_id", "start", "end_excl"))
    rows = inside.groupBy("rec", "det_id", "start", "end_excl").agg(F.array_sort(F.collect_list(F.struct("idx", *names))).alias("v"))
    series = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(f"v.{c}").alias("x")) for c in names))).alias("c")
    return rows.select("rec", "det_id", "start", "end_excl", series).select("rec", "det_id", "start", "end_excl", "c.channel", "c.x")


def featurise(segments: DataFrame, h: DataFrame, f: Features) -> DataFrame:
    """A row of named features per segment and channel.

    A sensor's values are magnitudes less its threshold, and those above it; an IMU channel is taken as it is.
    """
    s = segments.join(h.withColumnRenamed("h", "_h"), ["rec", "channel"], "left")
    sensor = F.col("channel").startswith("sensor_")
    below = F.when(sensor, F.transform("x", lambda v: F.abs(v) - F.col("_h"))).otherwise(F.col("x"))
    s = s.withColumn("below", below).withColumn("above", F.when(sensor, F.filter("below", lambda v: v > 0)).otherwise(F.col("below")))
    b, a, fs = F.col("below"), F.col("above"), f.sensor_freq
    s = s.withColumns({"_bands": spectral.bands(b, fs), "_mode": spectral.mode(b, fs, f.freq_mode_threshold), "_hilbert": spectral.hilbert(b, fs), "_conv": arrays.convolved(b), "_haar": arrays.haar_approximation(b)})
    m, haar = arrays.moments(b), F.col("_haar")
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda t, v: t + v * v)
    named = {
        "max": F.array_max(b), "mean": m["m1"], "energy": square(b), "sd": F.sqrt(m["m2"]), "iqr": arrays.quantile(b, 0.75) - arrays.quantile(b, 0.25),
        "skew": F.try_divide(m["m3"], F.pow(m["m2"], F.lit(1.5))), "kurtosis": F.try_divide(m["m4"], m["m2"] * m["m2"]) - 3,
        "n_above": F.size(a).cast("double"), "mean_above": F.coalesce(arrays.mean(a), F.lit(0.0)), "energy_above": square(a), "freq_mode": F.col("_mode"),
    }
    named |= {f"band_{lo}_{hi}": F.get("_bands", F.lit(i)) for i, (lo, hi) in enumerate(f.freq_bands)}
    named |= {n: F.get("_hilbert", F.lit(i)) for i, n in enumerate(("inst_amp_mean", "inst_freq_mean", "inst_amp_std", "inst_freq_std", "inst_amp_range", "inst_freq_range"))}
    named |= {"haar_mean": arrays.mean(haar), "haar_median": arrays.quantile(haar, 0.5), "haar_std": F.sqrt(arrays.moments(haar)["m2"])}
    named |= {f"conv_{k}": v for k, v in arrays.convolution_stats(F.col("_conv")).items()}
    named |= {"num_atoms": F.lit(1.0), "tfmf": spectral.matched_filter(b), "min": F.array_min(b), "median": arrays.quantile(b, 0.5)} | arrays.morphology(b, 1 / fs)
    return s.select("rec", "det_id", "start", "end_excl", "channel", *(v.alias(k) for k, v in named.items()), (F.size("x") / fs).alias("duration"))


def feature_table(features: DataFrame, names: list[str]) -> DataFrame:
    """One row per detection: each channel's features side by side, in the order of `names`, and the duration."""
    columns = [c for c in features.columns if c not in ("rec", "det_id", "start", "end_excl", "channel", "duration")]
    wide = features.groupBy("rec", "det_id", "start", "end_excl").agg(*(F.max(F.when(F.col("channel") == ch, F.col(c))).alias(f"{ch}_{c}") for ch in names for c in columns), F.max("duration").alias("duration"))
    return wide


def detect(raw: DataFrame, config: dict[str, Base]) -> dict[str, DataFrame]:
    """All results by name. Filtered samples, maps and detections are computed; labels and features wait to be asked for."""
    s, _ = preprocess(load(raw), config["preprocess"])
    s = settled(s)  # every later stage reads the filtered samples
    presses = pressed(s, config["preprocess"])
    movement, h, runs = segment(s, config["segment"])
    movement, runs = settled(movement), settled(runs)
    dets = settled(detections(runs, config["fusion"]))
    n = s.groupBy("rec").agg(F.count("*").alias("n"))
    found = labelled(dets, presses, movement, n, config["segment"])
    names = [*config["extract_feat"].sensors, *(("rot1d", "imu_acc") if config["extract_feat"].add_imu_features else ())]
    features = featurise(slices(s, dets, names), h, config["extract_feat"])
    return {"samples": s, "presses": presses, "movement": movement, "thresholds": h, "runs": runs, "detections": found, "features": feature_table(features, names), "lengths": n}
