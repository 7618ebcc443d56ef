"""Inference as a batch over a table of requests: predictions to reports, events and JSON answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import hiccup, report
from ..operators import intervals as iv

REQUEST = "jobId string, requestTime string, s3Key string, removeHiccups boolean, includeFullIntervals boolean, extractEvents boolean"


def read_requests(spark, path: str) -> DataFrame:
    """Requests as JSON lines; what is not given takes its default."""
    raw = spark.read.schema(REQUEST).json(path)
    return raw.fillna({"removeHiccups": False, "includeFullIntervals": False, "extractEvents": True})


def movement_of(predictions: DataFrame, runs: DataFrame, movement: DataFrame, samples: DataFrame, lengths: DataFrame, p: hiccup.HiccupParameters | None = None) -> DataFrame:
    """Predicted movement inside the sensors' map, without hiccups if parameters for them are given."""
    ml = iv.intersect(iv.merge(predictions.select("rec", "start", "end_excl")), iv.merge(runs.select("rec", "start", "end_excl")))
    return ml if p is None else hiccup.without_hiccups(ml, hiccup.detect_hiccups(ml, movement, samples, lengths, p))


#: Event types of an answer, as clients know them.
META = ("numKicks", "totalFMDuration", "totalNonFMDuration", "per_hour", "median_onset", "active_percent", "onsetSummary")
KICKS, HICCUPS = "inferred_kick", "fetal_hiccups"
OTHERS = ("maternal_body_movement", "button_press_pre_debounce", "button_press_post_debounce", "maternally_sensed_kick")


def figures(ml: DataFrame, lengths: DataFrame, fs: float, widened: float) -> DataFrame:
    """(rec, meta, gaps): a struct of a recording's figures, and the onset gaps in seconds, in order."""
    order = Window.partitionBy("rec").orderBy("start")
    gaps = ml.select("rec", "start", ((F.lead("start").over(order) - F.col("start")) / fs).alias("g")).where("g is not null")
    gaps = gaps.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "g"))), lambda x: x["g"]).alias("gaps"))
    summary = F.struct("n", "mean", "std", "min", "max", "median", "p25", "p75").alias("onsetSummary")
    facts = report.bout_meta(ml, lengths, fs, widened).join(report.onset_summary(ml, fs).select("rec", summary), "rec", "left").join(gaps, "rec", "left")
    meta = F.struct(F.col("kicks").alias("numKicks"), F.col("fm_minutes").alias("totalFMDuration"), F.col("other_minutes").alias("totalNonFMDuration"), "per_hour", "median_onset", "active_percent", "onsetSummary")
    return facts.select("rec", meta.alias("meta"), F.coalesce("gaps", F.array().cast("array<double>")).alias("gaps"))


def answers(
    requests: DataFrame, ml: DataFrame, lengths: DataFrame, starts: DataFrame, fs: float, widened: float, model: str, hiccups: DataFrame | None = None, others: DataFrame | None = None, matches: DataFrame | None = None, shift: int = 0
) -> DataFrame:
    """(jobId, status, body): a Completed answer with the recording's figures, or a Failed one if it was not read.

    starts: (rec, start_ms); without start_ms there are no events. A request's recording is its s3Key. hiccups: (rec,
    start, end_excl); requests with removeHiccups also get the figures without them (post_hiccup), and the hiccups among
    the events. others: (rec, map, start, end_excl) with a map of OTHERS, listed as events. includeFullIntervals adds
    the onset gaps themselves. matches: report.match_presses, given where something was pressed. shift: samples trimmed
    off the front.
    """
    facts = figures(ml, lengths, fs, widened)
    after = figures(hiccup.without_hiccups(ml, hiccups), lengths, fs, widened) if hiccups is not None else facts.where("false")
    facts = facts.join(after.select("rec", F.col("meta").alias("post"), F.col("gaps").alias("post_gaps")), "rec", "left")
    tagged = iv.tag(ml, KICKS)
    for more in (iv.tag(hiccups, HICCUPS) if hiccups is not None else None, others.select("rec", "map", "start", "end_excl") if others is not None else None):
        tagged = tagged if more is None else tagged.unionByName(more)
    if "start_ms" in starts.columns:
        events = report.timed_events(tagged.join(starts, "rec"), F.col("start_ms"), fs, shift)
        listed = events.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("start_t", "end_t", "event_type"))).alias("events"))
        facts = facts.join(listed, "rec", "left")
    else:
        facts = facts.withColumn("events", F.lit(None).cast("array<struct<start_t:string,end_t:string,event_type:string>>"))
    counts = ("tp", "fp", "tn", "fn", "num_pressed", "num_detections")
    if matches is not None:
        facts = facts.join(matches.where("num_pressed > 0").select("rec", F.struct(*counts).alias("match")), "rec", "left")
    joined = requests.join(facts, requests["s3Key"] == facts["rec"], "left")
    removed, full = F.coalesce("removeHiccups", F.lit(False)), F.coalesce("includeFullIntervals", F.lit(False))
    wanted = F.filter("events", lambda e: removed | (e["event_type"] != HICCUPS))
    result = F.struct(
        F.lit(model).alias("model"), *(F.col(f"meta.{c}").alias(c) for c in META), F.when(full, F.col("gaps")).alias("onsetInterval"),
        F.when(removed, F.col("post")).alias("post_hiccup"), F.when(removed & full, F.col("post_gaps")).alias("post_hiccup_onsetInterval"),
        F.when(F.coalesce("extractEvents", F.lit(True)), wanted).alias("events"), *(("match",) if matches is not None else ()),
    )
    ok = F.col("rec").isNotNull()
    status = F.when(ok, "Completed").otherwise("Failed")
    body = F.struct("jobId", "requestTime", status.alias("status"), F.when(ok, result).alias("result"), F.when(~ok, F.concat(F.lit("no samples of "), "s3Key")).alias("error"))
    return joined.select("jobId", status.alias("status"), F.to_json(body).alias("body"))
