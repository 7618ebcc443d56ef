"""Queries of reports, machine learning and the hiccup detector, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ml import models, neighbours, prepare
from ..ml.ensemble import Ensemble
from ..operators import hiccup, maps, report
from ..operators.nearest import nearest
from ..operators import intervals as iv
from ..session import settled
from .mask_queries import DEBOUNCE, DILATE, EV, HI_DIL, IMU, dilate_intervals, high, movement, parts, query, settled_parts
from .signal_queries import rounded
from .tables import OUT, lengths, merge_sql, samples, table  # noqa: F401

DEB = f"db AS (SELECT rec, idx AS s, coalesce(lead(idx) OVER (PARTITION BY rec ORDER BY idx), n) AS e FROM ev JOIN len USING (rec) WHERE kind = 'purchase'), db1 AS (SELECT * FROM db WHERE e - s - 1 < {DEBOUNCE}), {merge_sql('pr', 'db1')}"
CONF = f"""WITH {EV}, {IMU}, {HI_DIL}, {DEB}, det AS (SELECT rec, s + 2 AS s, e - 2 AS e FROM hd WHERE e - s > 4),
aw AS (SELECT rec, greatest(0, s - 1) AS s, least(n, e + 1) AS e FROM pr JOIN len USING (rec)),
fr AS (SELECT *, EXISTS (SELECT 1 FROM det d WHERE d.rec = a.rec AND d.s < a.e AND a.s < d.e) AS hit FROM aw a WHERE NOT EXISTS (SELECT 1 FROM imu WHERE imu.rec = a.rec AND imu.s < a.e AND a.s < imu.e)),
sc AS (SELECT DISTINCT rec, unnest(range(s, e)) AS idx FROM fr), dl AS (SELECT rec, s, e, EXISTS (SELECT 1 FROM fr WHERE fr.rec = det.rec AND fr.s < det.e AND det.s < fr.e) AS touched FROM det),
tk AS (SELECT rec, idx FROM sc UNION SELECT rec, unnest(range(s, e)) FROM dl WHERE touched), pos AS (SELECT DISTINCT rec, unnest(range(s, e)) AS idx, 1 AS p FROM dl WHERE NOT touched),
cx AS (SELECT ev.rec, row_number() OVER (PARTITION BY ev.rec ORDER BY ev.idx) - 1 AS c, coalesce(p, 0) AS p FROM ev ANTI JOIN tk ON tk.rec = ev.rec AND tk.idx = ev.idx LEFT JOIN pos ON pos.rec = ev.rec AND pos.idx = ev.idx),
wi AS (SELECT rec, c // 6 AS w, sum(CASE WHEN c % 6 < 5 THEN p ELSE 0 END) >= 2 AS fp FROM cx GROUP BY rec, c // 6),
cnt AS (SELECT len.rec, (SELECT count(*) FROM fr WHERE fr.rec = len.rec AND hit) AS tp, (SELECT count(*) FROM wi WHERE wi.rec = len.rec AND fp) AS fp, (SELECT count(*) FROM wi WHERE wi.rec = len.rec AND NOT fp) AS tn, (SELECT count(*) FROM fr WHERE fr.rec = len.rec AND NOT hit) AS fn FROM len)"""


@query(CONF + " SELECT rec, tp, fp, tn, fn FROM cnt")
def confusion_counts(spark, sf_dir):
    s, n = settled_parts(spark, sf_dir)
    detections = iv.erode(iv.dilate(high(s).join(n, "rec"), DILATE, F.col("n")), 4)
    detections = detections.select("rec", "start", (F.col("end_excl") - 1).alias("end_excl")).where("start < end_excl")
    return report.confusion_counts(detections, maps.debounce(s.where("kind = 'purchase'"), n, DEBOUNCE), movement(s, n), n, back=1, ahead=1, least=2, window=5)


@query(
    CONF
    + """, g AS (SELECT rec, sum(tp) AS tp, sum(fp) AS fp, sum(tn) AS tn, sum(fn) AS fn FROM cnt GROUP BY GROUPING SETS ((rec), ()))
SELECT rec, CAST(tp + fn AS BIGINT) AS sensation_calc, CAST(tp + fp + tn + fn AS BIGINT) AS sensor_calc, CAST(tp + fp AS BIGINT) AS ml_calc, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy, round(tp / nullif(tp + fn, 0), 6) AS sensitivity,
round(tp / nullif(tp + fp, 0), 6) AS precision, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(fp / nullif(fp + tn, 0), 6) AS fp_rate, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(2 * (tp + tn) / nullif(tp + tn + fp + fn, 0) - 1, 6) AS pabak FROM g"""
)
def metrics_overall_filewise(spark, sf_dir):
    return report.metrics(confusion_counts(spark, sf_dir))


@query(
    f"""WITH {EV}, {HI_DIL}, o AS (SELECT rec, s, e - s AS size, (lead(s) OVER (PARTITION BY rec ORDER BY s) - s) / 2.0 AS onset FROM hd),
a AS (SELECT rec, count(*) AS kicks, sum(size) AS t, median(onset) AS median_onset, avg(size) AS mean_size FROM o GROUP BY rec)
SELECT len.rec, coalesce(kicks, 0) AS kicks, round((coalesce(t, 0) / 2.0 - coalesce(kicks, 0) * 0.5) / 60, 6) AS fm_minutes, round(n / 2.0 / 60 - (coalesce(t, 0) / 2.0 - coalesce(kicks, 0) * 0.5) / 60, 6) AS other_minutes, round(coalesce(kicks, 0) / (n / 2.0 / 3600), 6) AS per_hour,
round(mean_size / 2.0, 6) AS mean_seconds, round(median_onset, 6) AS median_onset, round(100 * coalesce(t, 0) / n, 6) AS active_percent FROM len LEFT JOIN a USING (rec)"""
)
def bout_meta_kpis(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    return rounded(report.bout_meta(dilate_intervals(spark, sf_dir), n, fs=2.0, widened=1.0), "rec", "kicks")


@query(
    f"""WITH {EV}, {HI_DIL}, o AS (SELECT rec, (lead(s) OVER (PARTITION BY rec ORDER BY s) - s) / 2.0 AS g FROM hd)
SELECT rec, count(g) AS n, round(coalesce(avg(g), 0), 6) AS mean, round(coalesce(stddev_pop(g), 0), 6) AS std, round(coalesce(min(g), 0), 6)::DOUBLE AS min, round(coalesce(max(g), 0), 6)::DOUBLE AS max, round(coalesce(median(g), 0), 6)::DOUBLE AS median, round(coalesce(quantile_cont(g, 0.25), 0), 6)::DOUBLE AS p25, round(coalesce(quantile_cont(g, 0.75), 0), 6)::DOUBLE AS p75 FROM o GROUP BY rec"""
)
def onset_stats(spark, sf_dir):
    return rounded(report.onset_summary(dilate_intervals(spark, sf_dir), fs=2.0), "rec", "n")


@query(
    f"""WITH {EV}, w0 AS (SELECT rec, greatest(0, idx - 3) AS s, least(n, idx + 2) AS e FROM ev JOIN len USING (rec) WHERE kind = 'purchase'), {merge_sql('w', 'w0')},
p AS (SELECT w.rec, w.s, kind, max(abs(x)) AS peak FROM w JOIN ev ON ev.rec = w.rec AND idx >= w.s AND idx < w.e WHERE kind IN ('click', 'view', 'signup') GROUP BY w.rec, w.s, kind)
SELECT kind AS channel, round(quantile_cont(peak, 0.1), 6) AS level FROM p GROUP BY kind"""
)
def percentile_peaks(spark, sf_dir):
    s, n = parts(spark, sf_dir)
    w = s.where("kind = 'purchase'").join(n, "rec").select("rec", F.greatest(F.lit(0), F.col("idx") - 3).alias("start"), F.least("n", F.col("idx") + 2).alias("end_excl"))
    c = s.where(F.col("kind").isin("click", "view", "signup")).withColumnRenamed("kind", "channel")
    return rounded(report.peak_levels(c, iv.merge(w), 0.1), "channel")


@query("SELECT round(count(*) FILTER (WHERE toxic = 0) / count(*) FILTER (WHERE toxic = 1), 6) AS weight_of_one FROM labels")
def class_weight(spark, sf_dir):
    return rounded(models.class_ratio(table(spark, sf_dir, "labels"), "toxic"))


@query("WITH r AS (SELECT l_suppkey AS rec, l_returnflag AS kind, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY q DESC, rec) AS rank FROM r) SELECT rec, kind, round(q, 2) AS q, rank FROM k WHERE rank <= 10")
def rank_topk(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("rec"), F.col("l_returnflag").alias("kind")).agg(F.sum("l_quantity").alias("q"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("q"), "rec"))
    return q.withColumn("rank", rank.cast("long")).where("rank <= 10").select("rec", "kind", F.round("q", 2).alias("q"), "rank")


RANKED = """x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS feature FROM embeddings),
s AS (SELECT feature, round(avg(v), 7) AS a, round(var_pop(v), 9) AS b, round(max(abs(v)), 7) AS c FROM x GROUP BY feature),
r AS (SELECT feature, row_number() OVER (ORDER BY a DESC, feature) AS ra, row_number() OVER (ORDER BY b DESC, feature) AS rb, row_number() OVER (ORDER BY c DESC, feature) AS rc FROM s)"""


@query(f"WITH {RANKED} SELECT feature, CAST((ra <= 21)::INT + (rb <= 21)::INT + (rc <= 21)::INT AS BIGINT) AS votes FROM r WHERE (ra <= 21)::INT + (rb <= 21)::INT + (rc <= 21)::INT >= 2")
def vote_k_of_n(spark, sf_dir):
    """Three rankers each name the best third of the features; two votes select one."""
    x = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("feature", "v")).withColumn("v", F.col("v").cast("double"))
    s = x.groupBy(F.col("feature").cast("long").alias("feature")).agg(F.round(F.avg("v"), 7).alias("a"), F.round(F.var_pop("v"), 9).alias("b"), F.round(F.max(F.abs("v")), 7).alias("c"))
    long = s.select("feature", F.explode(F.array(*(F.struct(F.lit(c).alias("ranker"), F.col(c).alias("score")) for c in "abc"))).alias("r")).select("feature", "r.ranker", "r.score")
    ranked = long.withColumn("rank", F.row_number().over(Window.partitionBy("ranker").orderBy(F.desc("score"), "feature"))).where("rank <= 21")
    return prepare.voted(ranked, 2)


@query("WITH m AS (SELECT avg(l_quantity) AS q, max(l_quantity) - min(l_quantity) AS rq, avg(l_tax) AS t, max(l_tax) - min(l_tax) AS rt FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - q) / rq, 6) AS quantity, round((l_tax - t) / rt, 6) AS tax FROM lineitem, m")
def normalise_meanrange(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    scaled = prepare.mean_range(lines, prepare.fit_mean_range(lines, ["quantity", "tax"]), keep=("l_orderkey", "l_linenumber"))
    return rounded(scaled, "l_orderkey", "l_linenumber")


@query("WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY (doc_id * 7919) % 104729, doc_id) - 1 AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels) SELECT doc_id, toxic, CAST(least(r // greatest(n // 5, 1), 4) AS INT) AS fold FROM r")
def kfold_assign(spark, sf_dir):
    """In the order of a multiplicative hash that SQL has too."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return prepare.stratified_folds(rows, "toxic", "doc_id", 5, order=F.col("doc_id") * 7919 % 104729, span=512)


@query()
def kfold_stratified(spark, sf_dir):
    return prepare.stratified_folds(table(spark, sf_dir, "labels").where("toxic is not null"), "toxic", "doc_id", 5)


KNN = """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), d AS (SELECT q.vec_id, e.vec_id AS near, e.label, round(list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS dist FROM q, embeddings e WHERE e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, near) AS k FROM d)"""


@query(f"{KNN} SELECT vec_id, near, dist, k FROM r WHERE k <= 5")
def knn_topk(spark, sf_dir):
    """Queries (every id divisible by 50) against all rows."""
    e = table(spark, sf_dir, "embeddings")
    return nearest(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query("WITH p AS (SELECT vec_id, label, (1 + sin(vec_id)) / 2 AS a, (1 + cos(vec_id * 2)) / 2 AS b, (1 + sin(vec_id * 3)) / 2 AS c FROM embeddings) SELECT vec_id, round((a + b + c) / 3, 6) AS score, CAST((a + b + c) / 3 >= 0.5 AS INT) AS prediction FROM p")
def soft_vote(spark, sf_dir):
    return rounded(models.soft_vote(member_scores(spark, sf_dir), ["vec_id"]), "vec_id", "prediction")


def member_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    members = F.array(*(F.struct(F.lit(m).alias("model"), s.alias("score")) for m, s in (("a", (1 + F.sin(v)) / 2), ("b", (1 + F.cos(v * 2)) / 2), ("c", (1 + F.sin(v * 3)) / 2))))
    return e.select("vec_id", "label", F.explode(members).alias("m")).select("vec_id", "label", "m.model", "m.score")


@query("WITH p AS (SELECT vec_id % 5 AS fold, label % 2 AS y, CAST((1 + sin(vec_id)) / 2 >= 0.5 AS INT) AS p FROM embeddings) SELECT CAST(fold AS INT) AS fold, round(avg((p = y)::INT), 6) AS accuracy, round(coalesce(2.0 * count(*) FILTER (WHERE p = 1 AND y = 1) / nullif(2 * count(*) FILTER (WHERE p = 1 AND y = 1) + count(*) FILTER (WHERE p <> y), 0), 0), 6) AS f1 FROM p GROUP BY fold")
def accuracy_f1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).cast("int").alias("fold"), (F.col("label") % 2).alias("label"), ((1 + F.sin("vec_id")) / 2 >= 0.5).cast("int").alias("prediction"))
    return rounded(models.scores(e), "fold")


def training_rows(spark, sf_dir):
    """Segments of two classes with weights, features and folds."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).cast("int").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(16)))
    e = models.class_weights(prepare.stratified_folds(e, "label", "vec_id", 3))
    return models.fourier_features(prepare.assembled(e, [f"f{i}" for i in range(16)]), 16)


@query()
def nca_rank(spark, sf_dir):
    """All columns by their weight in the first neighbourhood component of the rows' classes."""
    columns = [f"f{i}" for i in range(16)]
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") < 5).cast("int").alias("label"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(columns)))
    ranked = neighbours.rank_by_neighbours(rows, columns, "label", 16, components=4, rounds=15)
    return spark.createDataFrame(list(enumerate(ranked, 1)), "rank int, feature string")


@query()
def ensemble_oof(spark, sf_dir):
    """Out-of-fold scores of a soft-voting ensemble and of its members, all scored in one pass a fold."""
    rows, names = settled(training_rows(spark, sf_dir)), ("log-regression", "extra-trees", "nearest-rows")
    parts = []
    for fold in range(3):
        model = Ensemble({n: models.registry(16)[n] for n in names}).fit(rows.where(F.col("fold") != fold))
        parts.append(model.transform(rows.where(F.col("fold") == fold)))
    out = prepare.probability_of_one(reduce(DataFrame.unionByName, parts))
    return out.select("vec_id", "label", "fold", *(F.round(f"score_{n.replace('-', '_')}", 6).alias(n.replace("-", "_")) for n in names), F.round("score", 6).alias("score"), F.col("prediction").cast("int").alias("prediction"))


def _trainer(key: str):
    def run(spark, sf_dir):
        rows = settled(training_rows(spark, sf_dir))
        out = models.out_of_fold(rows, models.registry(16)[key], range(3))
        return out.select("vec_id", "label", "fold", F.col("prediction").cast("int").alias("prediction"), F.round("score", 6).alias("score"))

    run.__name__ = {"log-regression": "logreg_train", "random-forest": "rf_train", "extra-trees": "extra_trees_train", "adaboost": "adaboost_train", "gradient-boosting": "gbt_train", "neural-net": "mlp_train", "svm": "svm_rff_train"}[key]
    return query()(run)


for _key in ("log-regression", "random-forest", "extra-trees", "adaboost", "gradient-boosting", "neural-net", "svm"):
    _trainer(_key)


@query()
def hiccup_map(spark, sf_dir):
    """The detector at the scale of these recordings: hiccups of eight samples or more. How alike peaks must be is the detector's
    own share; no spread is over half its range, so that a share of 0.5 would let all pass."""
    s, n = settled_parts(spark, sf_dir)
    p = hiccup.HiccupParameters(fs=1.0, period=2, body_gap=2, continuous=8, exceptions_per_minute=20, tolerance=3, peak_distance=3, bout_gap=4, fusion="any_type")
    wide = s.select("rec", "idx", *(F.when(F.col("kind") == k, F.col("x")).otherwise(0.0).alias(c) for c, k in (("s1", "click"), ("s3", "view"), ("s4", "signup"))))
    return hiccup.detect_hiccups(iv.from_mask(s, F.col("x") >= 30), movement(s, n), wide, n, p, width=5)
