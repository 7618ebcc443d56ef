"""Feature queries over segments: each embedding row is a segment of 64 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, extended, spectral
from .mask_queries import query
from .tables import table

V = "v AS (SELECT vec_id, i, CAST(x AS DOUBLE) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings))"
G = " + ".join(f"coalesce({'lead' if k > 0 else 'lag'}(x, {abs(k)}) OVER (PARTITION BY vec_id ORDER BY i), 0) * exp(-{k * k} / 2.0) / sqrt(2 * pi())" if k else "x / sqrt(2 * pi())" for k in range(-3, 4))


def segments(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def spread(df, values: dict):
    return df.select("vec_id", *((F.round(v, 5) + 0.0).alias(k) for k, v in values.items()))  # + 0.0: no negative zero


@query(
    f"""WITH {V}, m AS (SELECT vec_id, avg(x) AS mu FROM v GROUP BY vec_id) SELECT v.vec_id, round(max(x), 5) AS max, round(avg(x), 5) AS mean, round(sum(x * x), 5) AS energy, round(stddev_pop(x), 5) AS sd,
round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 5) AS iqr, round(avg(power(x - mu, 3)) / power(var_pop(x), 1.5), 5) AS skew, round(kurtosis_pop(x), 5) AS kurtosis, count(*) FILTER (WHERE x > 0) AS n_above,
round(coalesce(avg(x) FILTER (WHERE x > 0), 0), 5) AS mean_above, round(coalesce(sum(x * x) FILTER (WHERE x > 0), 0), 5) AS energy_above, round(min(x), 5) AS min, round(median(x), 5) AS median FROM v JOIN m USING (vec_id) GROUP BY v.vec_id"""
)
def seg_time_feats(spark, sf_dir):
    """Order-free statistics by grouped aggregation: partial sums on the map side, no array held."""
    x = segments(spark, sf_dir).select("vec_id", F.explode("x").alias("x"))
    above = F.when(F.col("x") > 0, F.col("x"))
    out = x.groupBy("vec_id").agg(
        F.max("x").alias("max"), F.avg("x").alias("mean"), F.sum(F.col("x") * F.col("x")).alias("energy"), F.stddev_pop("x").alias("sd"), (F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25))).alias("iqr"), F.skewness("x").alias("skew"), F.kurtosis("x").alias("kurtosis"),
        F.count(above).alias("n_above"), F.coalesce(F.avg(above), F.lit(0.0)).alias("mean_above"), F.coalesce(F.sum(above * above), F.lit(0.0)).alias("energy_above"), F.min("x").alias("min"), F.median("x").alias("median"),
    )
    return out.select("vec_id", "n_above", *(F.round(c, 5).alias(c) for c in out.columns if c not in ("vec_id", "n_above")))


@query(f"WITH {V}, h AS (SELECT vec_id, i // 2 AS k, (max(x) FILTER (WHERE i % 2 = 0) + coalesce(max(x) FILTER (WHERE i % 2 = 1), max(x) FILTER (WHERE i % 2 = 0))) / sqrt(2) AS c FROM v GROUP BY vec_id, i // 2) SELECT vec_id, round(avg(c), 5) AS haar_mean, round(median(c), 5) AS haar_median, round(stddev_pop(c), 5) AS haar_std FROM h GROUP BY vec_id")
def seg_haar(spark, sf_dir):
    h = segments(spark, sf_dir).select("vec_id", arrays.haar_approximation(F.col("x")).alias("h"))
    return spread(h, {"haar_mean": arrays.mean(F.col("h")), "haar_median": arrays.quantile(F.col("h"), 0.5), "haar_std": F.sqrt(arrays.moments(F.col("h"))["m2"])})


@query(
    f"""WITH {V}, g AS (SELECT vec_id, i, {G} AS y FROM v), m AS (SELECT vec_id, avg(y) AS mu, count(*) AS n FROM g GROUP BY vec_id),
w AS (SELECT g.vec_id, i, y, mu, n, lag(y) OVER p AS l, lead(y) OVER p AS r FROM g JOIN m USING (vec_id) WINDOW p AS (PARTITION BY g.vec_id ORDER BY i))
SELECT vec_id, round(avg(y), 5) AS mean, round(stddev_pop(y), 5) AS std, round(max(y), 5) AS max, round(min(y), 5) AS min, round(max(y) - min(y), 5) AS ptp, round(max(abs(y)), 5) AS max_abs, round(sum(y * y), 5) AS sum_sq,
round(count(*) FILTER (WHERE l IS NOT NULL AND sign(y) <> sign(l)) / count(*), 5) AS zero_cross_rate, round(avg(CASE WHEN l IS NULL THEN r - y WHEN r IS NULL THEN y - l ELSE (r - l) / 2 END), 5) + 0.0 AS slope, round(max(y) - min(y), 5) AS ptb,
round(avg(power(y - mu, 3)) / power(var_pop(y), 1.5), 5) AS skew, round(kurtosis_pop(y), 5) AS kurtosis, round(sqrt(avg(y * y)), 5) AS rms, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 5) AS iq_rng, round(avg(abs(y - mu)), 5) AS mean_ad,
round(avg(abs(y)), 5) AS mean_abs, round(coalesce(sum(y) FILTER (WHERE y > 0), 0), 5) AS area_pos, round(coalesce(sum(y) FILTER (WHERE y < 0), 0), 5) AS area_neg,
round(count(*) FILTER (WHERE l IS NOT NULL AND sign(y - mu) <> sign(l - mu)) / count(*), 5) AS mean_cross_rate, round(max(abs(y)) / sqrt(avg(y * y)), 5) AS crest_factor FROM w GROUP BY vec_id"""
)
def seg_conv_stats(spark, sf_dir):
    """All but the entropy, which hangs on exactly equal doubles and is tested apart."""
    y = segments(spark, sf_dir).select("vec_id", arrays.convolved(F.col("x")).alias("y"))
    stats = arrays.convolution_stats(F.col("y"))
    stats.pop("entropy")
    return spread(y, stats)


SIMPSON = "(sum({y} * CASE WHEN {i} = 0 OR {i} = {last} THEN 1 WHEN {i} % 2 = 1 THEN 4 ELSE 2 END) FILTER (WHERE {i} <= {last}) / 3"


@query(
    f"""WITH {V}, a AS (SELECT vec_id, i, abs(x) AS y FROM v), d AS (SELECT vec_id, i, x - lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS y FROM v), d0 AS (SELECT vec_id, i - 1 AS i, y FROM d WHERE i > 0),
aa AS (SELECT vec_id, {SIMPSON.format(y='y', i='i', last=62)} + 5 / 12.0 * max(y) FILTER (WHERE i = 63) + 2 / 3.0 * max(y) FILTER (WHERE i = 62) - 1 / 12.0 * max(y) FILTER (WHERE i = 61)) / 1024 AS s FROM a GROUP BY vec_id),
dd AS (SELECT vec_id, {SIMPSON.format(y='y', i='i', last=62)}) / 1024 AS s, {SIMPSON.format(y='abs(y)', i='i', last=62)}) / 1024 AS sa FROM d0 GROUP BY vec_id)
SELECT vec_id, round(aa.s, 5) AS abs_area, round(100 * dd.s / aa.s, 5) AS relative_area, round(dd.sa, 5) AS diff_area FROM aa JOIN dd USING (vec_id)"""
)
def seg_morph(spark, sf_dir):
    return spread(segments(spark, sf_dir), arrays.morphology(F.col("x"), 1 / 1024))


DFT = f"""WITH {V}, f AS (SELECT vec_id, k, power(sum(x * cos(2 * pi() * k * i / 64)), 2) + power(sum(x * sin(2 * pi() * k * i / 64)), 2) AS p FROM v, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k)"""


@query(f"{DFT} SELECT vec_id, " + ", ".join(f"round(coalesce(sum(p) FILTER (WHERE k >= {a} AND k <= {b}), 0), 5) AS band_{a}_{b}" for a, b in spectral.BANDS) + " FROM f GROUP BY vec_id")
def seg_band_energy(spark, sf_dir):
    """At 64 Hz a segment's bins are 0 to 32 Hz."""
    b = segments(spark, sf_dir).select("vec_id", spectral.bands(F.col("x"), 64.0).alias("b"))
    return spread(b, {f"band_{lo}_{hi}": F.get("b", F.lit(i)) for i, (lo, hi) in enumerate(spectral.BANDS)})


@query(f"{DFT} SELECT vec_id, CAST(arg_max(k, p * CASE WHEN k = 32 THEN 0.25 ELSE 1 END) AS DOUBLE) AS mode FROM f WHERE k >= 2 GROUP BY vec_id")
def seg_freq_mode(spark, sf_dir):
    return segments(spark, sf_dir).select("vec_id", spectral.mode(F.col("x"), 64.0, 1.0).alias("mode"))


@query()
def seg_hilbert(spark, sf_dir):
    h = segments(spark, sf_dir).select("vec_id", spectral.hilbert(F.col("x"), 64.0).alias("h"))
    names = ("amp_mean", "freq_mean", "amp_std", "freq_std", "amp_range", "freq_range")
    return spread(h, {n: F.get("h", F.lit(i)) for i, n in enumerate(names)})


@query("SELECT vec_id, len(embedding) / 1024.0::DOUBLE AS duration, 1 AS num_atoms, 0.0::DOUBLE AS tfmf FROM embeddings")
def seg_constants(spark, sf_dir):
    """Duration in seconds, and the two features that are constant for segments of a quarter second or more."""
    return segments(spark, sf_dir).select("vec_id", (F.size("x") / 1024.0).alias("duration"), F.lit(1).alias("num_atoms"), F.lit(0.0).alias("tfmf"))


STFT = f"""WITH {V}, fr AS (SELECT vec_id, f AS frame, i - 8 * f AS j, x FROM v, (SELECT unnest(range(7)) AS f) WHERE i >= 8 * f AND i < 8 * f + 16),
ce AS (SELECT vec_id, frame, j, (x - avg(x) OVER (PARTITION BY vec_id, frame)) * (0.5 - 0.5 * cos(2 * pi() * j / 16)) AS y FROM fr),
po AS (SELECT vec_id, frame, bin, (power(sum(y * cos(2 * pi() * bin * j / 16)), 2) + power(sum(y * sin(2 * pi() * bin * j / 16)), 2)) / 384 * CASE WHEN bin IN (0, 8) THEN 1 ELSE 2 END AS power FROM ce, (SELECT unnest(range(9)) AS bin) GROUP BY vec_id, frame, bin)"""


@query(f"{STFT} SELECT vec_id, CAST(frame AS INT) AS frame, CAST(bin AS INT) AS bin, CAST((8.0 + 8 * frame) / 64 AS DOUBLE) AS time, CAST(bin * 4 AS DOUBLE) AS frequency, round(power, 6) + 0.0 AS power FROM po")
def stft_power(spark, sf_dir):
    """Frames of 16 samples every 8 at 64 Hz; the window's squares add up to 6."""
    out = spectral.stft(segments(spark, sf_dir), ["vec_id"], "x", window=16, hop=8, fs=64.0)
    return out.withColumn("power", F.round("power", 6) + 0.0)


@query(
    f"""{STFT}, a AS (SELECT vec_id, frame, sum(power) * power(2, 0.25) * exp(-pi() * power((8 + 8 * frame) / 64.0 - 0.5, 2)) AS g FROM po GROUP BY vec_id, frame), t AS (SELECT sqrt(power(sum(cos(2 * pi() * 4 * b * 0.03)), 2) + power(sum(sin(2 * pi() * 4 * b * 0.03)), 2)) AS s FROM (SELECT unnest(range(9)) AS b))
SELECT vec_id, round(sum(g) * max(s), 5) AS tfmf FROM a, t GROUP BY vec_id"""
)
def seg_matched_filter(spark, sf_dir):
    """An atom in the middle of the segment."""
    return spread(segments(spark, sf_dir), {"tfmf": spectral.matched_filter(F.col("x"), 16, 8, 64.0, time=0.5, frequency=0.03)})


@query()
def seg_extended(spark, sf_dir):
    """All features of functions/extended.py at 64 Hz."""
    e = segments(spark, sf_dir).select("vec_id", extended.extended(F.col("x"), 64.0).alias("e"))
    return spread(e, {n: F.col(f"e.{n}") for n in extended.NAMES})
