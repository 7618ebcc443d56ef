"""Queries of the load, filter and window stages, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import align, filters, maps
from .mask_queries import query
from .tables import CHANNELS, EV, lengths, samples, table

W = "OVER (PARTITION BY rec ORDER BY idx"


def rounded(df, *keys, digits=6):
    return df.select(*keys, *(F.round(c, digits).alias(c) for c in df.columns if c not in keys))


@query("SELECT event_id, round(value * 3.3 / 65535, 9) AS volts, round(value / 1000, 6) AS accel, round(sqrt(value * value + user_id * user_id + 4), 6) AS magnitude, CAST(event_type = 'purchase' AS TINYINT) AS press FROM events")
def scan_project_scale(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(scalar.volts(F.col("value")), 9).alias("volts"), F.round(F.col("value") / scalar.ACCELERATION_COUNTS, 6).alias("accel"), F.round(scalar.norm(F.col("value"), F.col("user_id").cast("double"), F.lit(2.0)), 6).alias("magnitude"), (F.col("event_type") == "purchase").cast("tinyint").alias("press"))


def sparse(s):
    return s.where("idx % 8 = 0").select("rec", "idx", "x")


@query(f"WITH {EV}, ax AS (SELECT rec, unnest(range(n)) AS idx FROM len), sp AS (SELECT rec, idx, x FROM ev WHERE idx % 8 = 0) SELECT ax.rec, ax.idx, coalesce(sp.x, 0) AS x FROM ax LEFT JOIN sp ON sp.rec = ax.rec AND sp.idx = ax.idx")
def dense_scatter(spark, sf_dir):
    s = samples(spark, sf_dir)
    return align.scatter(align.dense_axis(lengths(s)), sparse(s), "x")


@query(
    f"""WITH {EV}, g AS (SELECT rec, idx, CASE WHEN idx % 8 = 0 THEN x END AS v, CASE WHEN idx % 8 = 0 THEN idx END AS k FROM ev),
f AS (SELECT rec, idx, last_value(v IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS a, last_value(k IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING) AS ka,
first_value(v IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b, first_value(k IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS kb FROM g)
SELECT rec, idx, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL OR ka = kb THEN a ELSE a + (b - a) * (idx - ka) / (kb - ka) END, 6) AS y FROM f"""
)
def interp_linear(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("v", F.when(F.col("idx") % 8 == 0, F.col("x")))
    return rounded(align.interpolate(s, "v", "y").select("rec", "idx", "y"), "rec", "idx")


@query(
    f"""WITH {EV}, g AS (SELECT rec, idx, CASE WHEN kind IN ('click', 'view') THEN x END AS v FROM ev)
SELECT rec, idx, coalesce(last_value(v IGNORE NULLS) {W} ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y FROM g"""
)
def fill_forward_back(spark, sf_dir):
    v = F.when(F.col("kind").isin("click", "view"), F.col("x"))
    return samples(spark, sf_dir).select("rec", "idx", align.filled(v).alias("y"))


QUAT = """q AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
u AS (SELECT vec_id, a / r AS w, b / r AS x, c / r AS y, d / r AS z FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS r FROM q))"""


def quaternions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("rec"), F.col("vec_id").alias("idx"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(("qw", "qx", "qy", "qz"))))
    length = scalar.norm(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    return e.withColumn("r", length).select("rec", "idx", *((F.col(c) / F.col("r")).alias(c) for c in ("qw", "qx", "qy", "qz")))


@query(
    f"WITH {QUAT} SELECT vec_id AS idx, round(degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))), 6) AS roll, round(degrees(asin(least(greatest(2 * (w * y - z * x), -1.0), 1.0))), 6) AS pitch, round(degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), 6) AS yaw FROM u"
)
def euler_from_quat(spark, sf_dir):
    roll, pitch, yaw = scalar.euler_degrees(*(F.col(c) for c in ("qw", "qx", "qy", "qz")))
    return rounded(quaternions(spark, sf_dir).select("idx", roll.alias("roll"), pitch.alias("pitch"), yaw.alias("yaw")), "idx")


@query("WITH q AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE CAST(embedding[1] AS DOUBLE) END AS a, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE CAST(embedding[2] AS DOUBLE) END AS b FROM embeddings), u AS (SELECT vec_id, label_, a, b, r FROM (SELECT q.*, e.label AS label_, sqrt(a * a + b * b) AS r FROM q JOIN embeddings e USING (vec_id))), f AS (SELECT label_, arg_min(a / r, vec_id) AS fa, arg_min(b / r, vec_id) AS fb FROM u WHERE r > 0 GROUP BY label_) SELECT CAST(u.label_ AS BIGINT) AS rec, vec_id AS idx, round(CASE WHEN r > 0 THEN a / r ELSE coalesce(fa, 0) END, 6) AS qw, round(CASE WHEN r > 0 THEN b / r ELSE coalesce(fb, 0) END, 6) AS qx, 0.0::DOUBLE AS qy, 0.0::DOUBLE AS qz FROM u LEFT JOIN f USING (label_)")
def quat_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = lambda i: F.when(F.col("vec_id") % 5 == 0, 0.0).otherwise(F.get("embedding", F.lit(i)).cast("double"))
    s = e.select(F.col("label").cast("long").alias("rec"), F.col("vec_id").alias("idx"), part(0).alias("qw"), part(1).alias("qx"), F.lit(0.0).alias("qy"), F.lit(0.0).alias("qz"))
    return rounded(align.unit_quaternions(s), "rec", "idx")


@query("SELECT event_id, strftime(make_timestamp(1700000000123000 + event_id * 977000), '%Y-%m-%dT%H:%M:%S.%gZ') AS t FROM events")
def iso_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalar.iso_millis(F.lit(1_700_000_000_123) + F.col("event_id") * 977).alias("t"))


@query("SELECT event_id, event_id % 2 = 0 AS flag FROM events")
def str_to_bool(spark, sf_dir):
    word = F.when(F.col("event_id") % 2 == 0, F.element_at(F.array(F.lit("TRUE"), F.lit("yes"), F.lit("1")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise(F.element_at(F.array(F.lit("False"), F.lit("NO"), F.lit("0")), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", scalar.str2bool(word).alias("flag"))


@query(f"WITH {EV} SELECT rec, idx, round(idx / 0.5 / CASE WHEN n / 0.5 < 120 THEN 1.0 WHEN n / 0.5 < 7200 THEN 60.0 ELSE 3600.0 END, 6) AS t, CASE WHEN n / 0.5 < 120 THEN 'sec' WHEN n / 0.5 < 7200 THEN 'min' ELSE 'hour' END AS unit FROM ev JOIN len USING (rec)")
def time_axis(spark, sf_dir):
    s = samples(spark, sf_dir)
    t, unit = scalar.time_axis(F.col("idx"), F.col("n"), 0.5)
    return s.join(lengths(s), "rec").select("rec", "idx", F.round(t, 6).alias("t"), unit.alias("unit"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS bucket, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS key FROM pages")
def uri_split(spark, sf_dir):
    bucket, key = scalar.split_uri(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", bucket.alias("bucket"), F.coalesce(key, F.lit("")).alias("key"))


@query("SELECT CAST(label AS BIGINT) AS rec, round(covar_pop(embedding[1], embedding[1]), 8) AS c00, round(covar_pop(embedding[1], embedding[2]), 8) AS c01, round(covar_pop(embedding[1], embedding[3]), 8) AS c02, round(covar_pop(embedding[2], embedding[2]), 8) AS c11, round(covar_pop(embedding[2], embedding[3]), 8) AS c12, round(covar_pop(embedding[3], embedding[3]), 8) AS c22 FROM embeddings GROUP BY label")
def pca1_cov(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("rec"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)))
    return e.groupBy("rec").agg(*(F.round(F.covar_pop(f"v{i}", f"v{j}"), 8).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)))


@query()
def pca1_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("rec"), F.col("vec_id").alias("idx"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(3)))
    return filters.first_component(e, ["v0", "v1", "v2"], "score").select("rec", "idx", F.round("score", 6).alias("score"))


@query(f"WITH {EV} SELECT rec, idx, abs(x - 20) >= 8 AS by_size, abs(x) > 25 OR abs(x - 30) > 29 AS by_rotation FROM ev")
def imu_mask_threshold(spark, sf_dir):
    return samples(spark, sf_dir).select("rec", "idx", (F.abs(F.col("x") - 20) >= 8).alias("by_size"), ((F.abs("x") > 25) | (F.abs(F.col("x") - 30) > 29)).alias("by_rotation"))


@query(
    f"""WITH {EV}, q AS (SELECT rec, kind, quantile_cont(abs(x), 0.25) AS lq FROM ev WHERE kind IN ('click', 'view', 'signup') GROUP BY rec, kind),
m AS (SELECT ev.rec, ev.kind, median(abs(x)) AS mid FROM ev JOIN q ON q.rec = ev.rec AND q.kind = ev.kind AND abs(x) <= lq GROUP BY ev.rec, ev.kind)
SELECT rec, kind AS channel, round(CASE WHEN 4 * mid < 6 THEN 'inf'::DOUBLE ELSE 4 * mid END, 6) AS h FROM m"""
)
def adaptive_threshold(spark, sf_dir):
    s = samples(spark, sf_dir).where(F.col("kind").isin(*CHANNELS)).withColumnRenamed("kind", "channel")
    h = maps.thresholds(s, F.lit(4.0), cutoff=6.0)
    return h.select("rec", "channel", F.when(F.col("h") == float("inf"), F.col("h")).otherwise(F.round("h", 6)).alias("h"))


@query(f"WITH {EV}, m AS (SELECT rec, median(x) AS med FROM ev GROUP BY rec), d AS (SELECT rec, median(abs(x - med)) AS mad FROM ev JOIN m USING (rec) GROUP BY rec) SELECT rec, idx, CASE WHEN mad > 0 AND abs(x - med) / mad >= 5 THEN 0 ELSE x END AS y FROM ev JOIN m USING (rec) JOIN d USING (rec)")
def outlier_zero(spark, sf_dir):
    s = samples(spark, sf_dir)
    med = s.groupBy("rec").agg(F.median("x").alias("med"))
    near = s.join(med, "rec")
    mad = near.groupBy("rec").agg(F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"))
    return near.join(mad, "rec").select("rec", "idx", filters.zero_outliers(F.col("x"), F.col("med"), F.col("mad"), 5.0).alias("y"))


@query(f"WITH {EV} SELECT rec, idx // 20 AS bin, round(sum(x), 6) AS total FROM ev GROUP BY rec, idx // 20")
def tumbling_sum20(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("rec", F.floor(F.col("idx") / 20).alias("bin")).agg(F.round(F.sum("x"), 6).alias("total"))


@query(f"WITH {EV} SELECT rec, idx, round(sum(x) {W} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8, 6) AS y, round(sum(x) {W} ROWS BETWEEN 50 PRECEDING AND 49 FOLLOWING) / 100, 6) AS wide FROM ev")
def moving_average(spark, sf_dir):
    return samples(spark, sf_dir).select("rec", "idx", F.round(filters.moving_average("x", 8), 6).alias("y"), F.round(filters.moving_average("x", 100), 6).alias("wide"))


TAPS = " + ".join(f"coalesce({'lead' if k > 0 else 'lag'}(x, {abs(k)}) {W}), 0) * exp(-{k * k} / 2.0) / sqrt(2 * pi())" if k else "x / sqrt(2 * pi())" for k in range(-3, 4))


@query(f"WITH {EV} SELECT rec, idx, round({TAPS}, 6) AS y FROM ev")
def gaussian7(spark, sf_dir):
    from ..functions.arrays import GAUSSIAN7

    order = Window.partitionBy("rec").orderBy("idx")
    taps = [F.coalesce(F.lead("x", k).over(order) if k > 0 else F.lag("x", -k).over(order), F.lit(0.0)) * GAUSSIAN7[k + 3] if k else F.col("x") * GAUSSIAN7[3] for k in range(-3, 4)]
    return samples(spark, sf_dir).select("rec", "idx", F.round(sum(taps[1:], taps[0]), 6).alias("y"))


@query(f"WITH {EV}, n AS (SELECT rec, idx, x, lag(x) {W}) AS l, lead(x) {W}) AS r FROM ev), p AS (SELECT rec, idx, x FROM n WHERE x > l AND x > r) SELECT * FROM p UNION ALL SELECT a.rec, a.idx, a.x FROM n a JOIN n b ON a.rec = b.rec AND b.idx = a.idx + 1 AND a.x = b.x WHERE a.x > a.l AND b.x > b.r")
def peaks_local(spark, sf_dir):
    """Plateaus of two samples at most occur in this table, which is all that the SQL looks for."""
    return filters.local_maxima(samples(spark, sf_dir), "x")


@query()
def band_pass(spark, sf_dir):
    s = samples(spark, sf_dir).select("rec", "idx", "x")
    return rounded(filters.band_pass(s, {"x": (1.0, 30.0)}, fs=1024.0), "rec", "idx")


@query()
def peaks_distant(spark, sf_dir):
    """Peaks at least 4 samples apart, the highest first."""
    return filters.distant(filters.local_maxima(samples(spark, sf_dir), "x"), 4)
