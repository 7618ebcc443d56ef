"""Queries over masks and intervals, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, maps, report
from ..operators import intervals as iv
from ..session import settled
from .registry import ORACLES, QUERIES
from .tables import CHANNELS, EV, OUT, cells_sql, lengths, merge_sql, runs_sql, samples

#: Sizes in samples, scaled to recordings of some tens of events.
DILATE, ERODE, DEBOUNCE, GAP, BACK, AHEAD, HIGH = 5, 2, 4, 6, 3, 2, 20.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def parts(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s, lengths(s)


def settled_parts(spark, sf_dir):
    """For queries that read the samples many times."""
    s = settled(samples(spark, sf_dir))
    return s, lengths(s)


def high(s):
    return iv.from_mask(s, F.col("x") >= HIGH)


def movement(s, n):
    return maps.movement_map([iv.from_mask(s, F.col("kind") == "error")], n, DILATE)


def fm_channels(s, n):
    """Dilated runs of each sensor channel, not yet cleaned of movement."""
    runs = iv.from_mask(s.where(F.col("kind").isin(*CHANNELS)).withColumnRenamed("kind", "channel"), F.col("x") >= HIGH, ("rec", "channel"))
    return iv.dilate(runs.join(n, "rec"), 3, F.col("n"), ("rec", "channel"))


IMU = f"""{runs_sql('e0', "kind = 'error'")}, e1 AS (SELECT rec, greatest(0, s - 2) AS s, least(n, e + 2) AS e FROM e0 JOIN len USING (rec)), {merge_sql('e2', 'e1')},
imu AS (SELECT rec, greatest(s, 1) AS s, least(e, n - 1) AS e FROM e2 JOIN len USING (rec) WHERE greatest(s, 1) < least(e, n - 1))"""
FM = f"""evc AS (SELECT rec, kind AS channel, idx, x FROM ev WHERE kind IN ('click', 'view', 'signup')), {runs_sql('c0', 'x >= 20', 'evc', 'rec, channel')},
c1 AS (SELECT rec, channel, greatest(0, s - 1) AS s, least(n, e + 1) AS e FROM c0 JOIN len USING (rec)), {merge_sql('fm', 'c1', by='rec, channel')}"""
HI = runs_sql("hi", "x >= 20")
HI_DIL = f"{HI}, hd0 AS (SELECT rec, greatest(0, s - 2) AS s, least(n, e + 2) AS e FROM hi JOIN len USING (rec)), {merge_sql('hd', 'hd0')}"
CLEAN = f"""u0 AS (SELECT rec, s, e FROM fm UNION ALL SELECT rec, s, e FROM imu), {merge_sql('u1', 'u0')},
bad AS (SELECT DISTINCT u1.rec, u1.s, u1.e FROM u1 JOIN fm ON fm.rec = u1.rec AND fm.s < u1.e AND u1.s < fm.e JOIN imu ON imu.rec = fm.rec AND imu.s < fm.e AND fm.s < imu.e),
fmc AS (SELECT rec, channel, s, e FROM fm WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.rec = fm.rec AND bad.s < fm.e AND fm.s < bad.e)),
fms0 AS (SELECT rec, s, e FROM fmc), {merge_sql('fms', 'fms0')}"""
SENS = f"""pr AS (SELECT rec, idx, greatest(0, idx - {BACK}) AS s, least(n, idx + {AHEAD} + 1) AS e FROM ev JOIN len USING (rec) WHERE kind = 'purchase'),
prw AS (SELECT rec, idx, s, e, lead(s) OVER (PARTITION BY rec ORDER BY idx) AS nxt FROM pr),
sen0 AS (SELECT rec, s, least(e, coalesce(nxt, e)) AS e FROM prw p WHERE NOT EXISTS (SELECT 1 FROM imu WHERE imu.rec = p.rec AND imu.s < p.e AND p.s < imu.e) AND s < least(e, coalesce(nxt, e))), {merge_sql('sen', 'sen0')}"""


@query(f"WITH {EV}, d AS (SELECT rec, idx AS s, coalesce(lead(idx) OVER (PARTITION BY rec ORDER BY idx), n) AS e FROM ev JOIN len USING (rec) WHERE kind = 'purchase'), d1 AS (SELECT * FROM d WHERE e - s - 1 < {DEBOUNCE}), {merge_sql('d2', 'd1')} {OUT} d2")
def debounce_press(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    return maps.debounce(s.where("kind = 'purchase'"), n, DEBOUNCE)


@query(f"WITH {EV}, {HI} {OUT} hi")
def mask_rle(spark, sf_dir):
    return high(samples(spark, sf_dir))


@query(f"WITH {EV}, {HI} SELECT rec, s AS start, e AS end_excl, row_number() OVER (PARTITION BY rec ORDER BY s) AS det_id FROM hi")
def label_components(spark, sf_dir):
    return iv.label(high(samples(spark, sf_dir)))


@query(f"WITH {EV}, {HI_DIL} {OUT} hd")
def dilate_intervals(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    return iv.dilate(high(s).join(n, "rec"), DILATE, F.col("n"))


@query(f"WITH {EV}, {HI} SELECT rec, s + 1 AS start, e AS end_excl FROM hi WHERE e - s > {ERODE}")
def erode_intervals(spark, sf_dir):
    return iv.erode(high(samples(spark, sf_dir)), ERODE)


@query(f"WITH {EV}, {IMU} {OUT} imu")
def imu_map(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    return movement(s, n)


@query(f"WITH {EV}, {HI}, {runs_sql('er', chr(39).join(('kind = ', 'error', '')))}, u AS (SELECT * FROM hi UNION ALL SELECT * FROM er), {merge_sql('m', 'u')} {OUT} m")
def union_intervals(spark, sf_dir):
    s = samples(spark, sf_dir)
    return iv.union(high(s), iv.from_mask(s, F.col("kind") == "error"))


@query(f"WITH {EV}, {FM}, {cells_sql('cc', '(SELECT rec, channel, s, e FROM fm)').replace('SELECT DISTINCT rec,', 'SELECT DISTINCT rec, channel,')}, k AS (SELECT rec, idx FROM cc GROUP BY rec, idx HAVING count(*) >= 2), {runs_sql('r', 'true', 'k')} {OUT} r")
def sensor_vote_sweep(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    return iv.vote(fm_channels(s, n).withColumnRenamed("channel", "map"), CHANNELS, 2)


@query(f"WITH {EV}, {IMU}, {FM}, {CLEAN} {OUT} fms")
def fm_map_decontaminate(spark, sf_dir):
    s, n = settled_parts(spark, sf_dir)
    return iv.merge(cleaned(s, n).select("rec", "start", "end_excl"))


def cleaned(s, n):
    """Channels without the segments that share a sample with movement, judged over all channels together."""
    channels, moved = settled(fm_channels(s, n)), settled(movement(s, n))  # each is read several times
    return maps.without_contaminated(channels, moved)


@query(f"WITH {EV}, {IMU}, {SENS} {OUT} sen")
def sensation_map(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    return maps.sensation_map(s.where("kind = 'purchase'"), movement(s, n), n, BACK, AHEAD)


FUSE = f"WITH {EV}, {IMU}, {FM}, {CLEAN}, seen AS (SELECT f.rec, f.s, f.e, count(DISTINCT {{what}}) AS k FROM fms f JOIN fmc c ON c.rec = f.rec AND f.s < c.e AND c.s < f.e GROUP BY f.rec, f.s, f.e) {OUT} seen WHERE k >= 2"


@query(FUSE.format(what="c.channel"))
def fusion_number(spark, sf_dir):
    s, n = settled_parts(spark, sf_dir)
    c = settled(cleaned(s, n))
    return maps.fuse(iv.merge(c.select("rec", "start", "end_excl")), c, "number", 2)


@query(FUSE.format(what="CASE c.channel WHEN 'click' THEN 'a' WHEN 'view' THEN 'a' ELSE 'b' END"))
def fusion_type(spark, sf_dir):
    s, n = settled_parts(spark, sf_dir)
    c = settled(cleaned(s, n))
    kinds = spark.createDataFrame([("click", "a"), ("view", "a"), ("signup", "b")], "channel string, type string")
    return maps.fuse(iv.merge(c.select("rec", "start", "end_excl")), c, "type", 2, kinds)


TPFP = f"WITH {EV}, {IMU}, {SENS}, {HI_DIL} {OUT} hd WHERE {{no}} EXISTS (SELECT 1 FROM sen WHERE sen.rec = hd.rec AND sen.s < hd.e AND hd.s < sen.e)"


@query(TPFP.format(no=""))
def detections_tp(spark, sf_dir):
    return iv.overlapping(dilate_intervals(spark, sf_dir), sensation_map(spark, sf_dir), "left_semi", width=64)


@query(TPFP.format(no="NOT"))
def detections_fp(spark, sf_dir):
    return iv.overlapping(dilate_intervals(spark, sf_dir), sensation_map(spark, sf_dir), "left_anti", width=64)


@query(f"WITH {EV}, {HI}, {merge_sql('m', 'hi', GAP - 1)} {OUT} m")
def session_merge(spark, sf_dir):
    return iv.session_merge(high(samples(spark, sf_dir)), GAP)


BODY = f"""{HI}, nb AS (SELECT rec, e - 1 AS s, lead(s) OVER (PARTITION BY rec ORDER BY s) AS e FROM hi), er AS (SELECT rec, idx FROM ev WHERE kind = 'error'),
g AS (SELECT rec, s, e FROM nb WHERE e - s <= 4 AND EXISTS (SELECT 1 FROM er WHERE er.rec = nb.rec AND er.idx >= nb.s AND er.idx < nb.e) UNION ALL SELECT rec, s, e FROM hi), {merge_sql('m', 'g')}"""


@query(f"WITH {EV}, {BODY} {OUT} m")
def body_movement_merge(spark, sf_dir):
    s = samples(spark, sf_dir)
    return iv.fill_gaps_over(high(s), iv.from_mask(s, F.col("kind") == "error"), 4)


@query()
def continuity_filter(spark, sf_dir):
    return iv.continuity(high(samples(spark, sf_dir)), least=4, lapse=3, tolerance=2)


@query(f"WITH {EV}, {HI} SELECT rec, s AS start, e AS end_excl, max(e - s) OVER (PARTITION BY rec) AS longest FROM hi QUALIFY e - s > 2")
def long_runs(spark, sf_dir):
    return iv.longer(high(samples(spark, sf_dir)), 2)


@query(f"WITH {EV}, {HI} SELECT rec, min(s) AS start, min_by(e, s) - 1 AS end_excl FROM hi GROUP BY rec")
def first_run(spark, sf_dir):
    return iv.first_run(high(samples(spark, sf_dir)))


@query(f"WITH {EV}, {HI} SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY s) AS region, s AS start, e - 1 AS end_excl FROM hi WHERE e - s > 1")
def region_split(spark, sf_dir):
    return iv.regions(high(samples(spark, sf_dir)))


TWO = f"WITH {EV}, {HI_DIL}, {IMU}, {cells_sql('a', 'hd')}, {cells_sql('b', 'imu')}, k AS ({{how}}), {runs_sql('r', 'true', 'k')} {OUT} r"


@query(TWO.format(how="SELECT * FROM a EXCEPT SELECT * FROM b"))
def map_except(spark, sf_dir):
    return iv.subtract(dilate_intervals(spark, sf_dir), imu_map(spark, sf_dir))


@query(TWO.format(how="SELECT * FROM a INTERSECT SELECT * FROM b"))
def map_intersect(spark, sf_dir):
    return iv.intersect(dilate_intervals(spark, sf_dir), imu_map(spark, sf_dir))


@query(f"WITH {EV}, {FM}, {cells_sql('a', chr(40) + 'SELECT * FROM fm WHERE channel = ' + chr(39) + 'click' + chr(39) + chr(41))}, {cells_sql('b', chr(40) + 'SELECT * FROM fm WHERE channel = ' + chr(39) + 'view' + chr(39) + chr(41))}, {cells_sql('c', chr(40) + 'SELECT * FROM fm WHERE channel = ' + chr(39) + 'signup' + chr(39) + chr(41))}, k AS (SELECT * FROM a UNION (SELECT * FROM b INTERSECT SELECT * FROM c)), {runs_sql('r', 'true', 'k')} {OUT} r")
def map_fusion(spark, sf_dir):
    """One modality, or both of the others."""
    s, n = parts(spark, sf_dir)
    tagged = fm_channels(s, n).withColumnRenamed("channel", "map")
    return iv.sweep(tagged, CHANNELS, lambda c: (c["click"] > 0) | ((c["view"] > 0) & (c["signup"] > 0)))


BOUTS = f"""{HI}, w AS (SELECT rec, s, e, lag(e) OVER (PARTITION BY rec ORDER BY s) AS pe FROM hi WHERE e - s > 1),
bo AS (SELECT rec, count(*) FILTER (WHERE pe IS NULL OR s - pe > 6) AS bouts, sum(e - s + CASE WHEN s - pe <= 6 THEN s - pe ELSE 0 END) AS samples_in, max(e - s) AS longest, min(e - s) AS shortest FROM w GROUP BY rec)"""


@query(f"WITH {EV}, {BOUTS} SELECT rec, CAST(bouts AS BIGINT) AS bouts, CAST(samples_in AS BIGINT) AS samples_in, longest, shortest FROM bo")
def bout_counter(spark, sf_dir):
    return report.bouts(high(samples(spark, sf_dir)), GAP)


@query(f"WITH {EV}, {BOUTS} SELECT CAST(sum(bouts) AS BIGINT) AS bouts, CAST(sum(samples_in) AS BIGINT) AS samples_in, max(longest) AS longest, min(shortest) AS shortest, round(sum(bouts) / 31.0, 6) AS per_hour, round(sum(samples_in) / sum(bouts), 6) AS mean_samples FROM bo")
def bout_table(spark, sf_dir):
    """hours = 31"""
    out = report.bout_table(bout_counter(spark, sf_dir), hours=31.0)
    return out.withColumns({c: F.round(c, 6) for c in ("per_hour", "mean_samples")})


@query(
    f"WITH {EV}, {HI_DIL}, {IMU}, {SENS}, al AS (SELECT rec, s, e, 'detection' AS event_type FROM hd UNION ALL SELECT rec, s, e, 'movement' FROM imu UNION ALL SELECT rec, s, e, 'sensation' FROM sen)"
    " SELECT rec, event_type, strftime(make_timestamp(1700000000500000 + CAST(floor(s * 1000.0 / 1024) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS start_t, strftime(make_timestamp(1700000000500000 + CAST(floor(e * 1000.0 / 1024) AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS end_t FROM al"
)
def events_out(spark, sf_dir):
    tagged = iv.tag(dilate_intervals(spark, sf_dir), "detection").unionByName(iv.tag(imu_map(spark, sf_dir), "movement")).unionByName(iv.tag(sensation_map(spark, sf_dir), "sensation"))
    return report.timed_events(tagged, F.lit(1_700_000_000_500), 1024.0)


@query(f"WITH {EV} SELECT rec, idx - 5 AS idx, kind, x FROM ev JOIN len USING (rec) WHERE idx >= 5 AND idx < n - 5")
def edge_trim(spark, sf_dir):
    return align.trim_edges(samples(spark, sf_dir), fs=1.0)


@query("SELECT e.user_id AS rec, window_start, CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts) AS window_start FROM events) e GROUP BY ALL")
def tumbling_windows(spark, sf_dir):
    """The streaming form runs the same plan on a stream (tests/test_streaming.py)."""
    from ..streaming.bouts import tumbling
    from .tables import table

    out = tumbling(table(spark, sf_dir, "events").withColumnRenamed("user_id", "rec"), "ts", "value", "6 hours", "1 hour", "rec")
    return out.select("rec", F.col("start").alias("window_start"), "n", F.round("total", 6).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '8 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id AS rec, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_windows(spark, sf_dir):
    from ..streaming.bouts import sessions
    from .tables import table

    return sessions(table(spark, sf_dir, "events").withColumnRenamed("user_id", "rec"), "ts", "8 hours", "1 hour", "rec").select("rec", "start", "n")
