"""Binary masks as interval tables: (keys..., start, end_excl), disjoint and non-adjacent per key once merged.

Every operator is a window or a grouped aggregate over intervals, which are far fewer than samples. The keys are
named by `by`; masks of several kinds carry a further column `map`, named in `by` or swept over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REC = ("rec",)
#: Samples of one recording in one window partition; longer recordings are cut and joined at the cuts.
CHUNK = 1 << 20


def merge(intervals: DataFrame, by: Sequence[str] = REC, slack: int = 0) -> DataFrame:
    """Union of intervals: those that overlap, touch, or start at most `slack` after the furthest end so far are joined."""
    order = Window.partitionBy(*by).orderBy("start", "end_excl")
    furthest = F.max("end_excl").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") <= furthest + slack, 0).otherwise(1)
    marked = intervals.select(*by, "start", "end_excl", fresh.alias("_new"))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end_excl").alias("end_excl")).drop("_island")


def session_merge(intervals: DataFrame, gap: int, by: Sequence[str] = REC) -> DataFrame:
    """Join bouts whose next start is at most `gap` samples after the last sample of the one before."""
    return merge(intervals, by, slack=gap - 1)


def from_mask(samples: DataFrame, is_on: Column, by: Sequence[str] = REC, index: str = "idx") -> DataFrame:
    """Run-length encoding of a mask over dense sample rows.

    Runs are found within chunks of a recording, so that a long recording is many tasks, and joined at the cuts.
    """
    on = samples.where(is_on).select(*by, F.col(index).alias("_i"), F.floor(F.col(index) / CHUNK).alias("_chunk"))
    order = Window.partitionBy(*by, "_chunk").orderBy("_i")
    runs = on.withColumn("_run", F.col("_i") - F.row_number().over(order))
    runs = runs.groupBy(*by, "_chunk", "_run").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end_excl"))
    return merge(runs.select(*by, "start", "end_excl"), by)


def to_mask(intervals: DataFrame, by: Sequence[str] = REC, index: str = "idx") -> DataFrame:
    """A row per sample inside the intervals."""
    return intervals.select(*by, F.explode(F.sequence("start", F.col("end_excl") - 1)).alias(index))


def label(intervals: DataFrame, by: Sequence[str] = REC, name: str = "det_id") -> DataFrame:
    """Components numbered 1..K by position."""
    return intervals.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("start")).cast("long"))


def dilate(intervals: DataFrame, size: int, length: Column, by: Sequence[str] = REC) -> DataFrame:
    """Widen by size//2 before and size - size//2 - 1 after, inside [0, length), and join. Size 0 changes nothing."""
    if size <= 0:
        return intervals
    before = size // 2
    wide = intervals.select(*by, F.greatest(F.lit(0), F.col("start") - before).alias("start"), F.least(length, F.col("end_excl") + (size - before - 1)).alias("end_excl"))
    return merge(wide, by)


def erode(intervals: DataFrame, size: int, by: Sequence[str] = REC) -> DataFrame:
    """Narrow by the same amounts; an interval of `size` samples or fewer goes."""
    if size <= 0:
        return intervals
    kept = intervals.where(F.col("end_excl") - F.col("start") > size)
    return kept.select(*by, (F.col("start") + size // 2).alias("start"), (F.col("end_excl") - (size - size // 2 - 1)).alias("end_excl"))


def clip(intervals: DataFrame, low: Column, high: Column, by: Sequence[str] = REC) -> DataFrame:
    """What lies in [low, high)."""
    cut = intervals.select(*by, F.greatest("start", low).alias("start"), F.least("end_excl", high).alias("end_excl"))
    return cut.where("start < end_excl")


def sweep(tagged: DataFrame, maps: Sequence[str], keep: Callable[[dict[str, Column]], Column], by: Sequence[str] = REC) -> DataFrame:
    """Stretches where `keep` holds for the number of intervals of each map that cover them, joined.

    tagged has a column `map`. One sort per recording: +1 and -1 at the ends, running sums, next position.
    """
    delta = [F.sum(F.when(F.col("map") == m, F.col("d")).otherwise(0)).alias(f"d{i}") for i, m in enumerate(maps)]
    ends = tagged.select(*by, "map", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end_excl").alias("at"), F.lit(-1).alias("d")))).alias("e"))
    points = ends.select(*by, "map", "e.at", "e.d").groupBy(*by, "at").agg(*delta)
    order = Window.partitionBy(*by).orderBy("at")
    counts = [F.sum(f"d{i}").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(f"c{i}") for i in range(len(maps))]
    stretches = points.select(*by, F.col("at").alias("start"), F.lead("at").over(order).alias("end_excl"), *counts)
    held = stretches.where(F.col("end_excl").isNotNull() & keep({m: F.col(f"c{i}") for i, m in enumerate(maps)}))
    return merge(held.select(*by, "start", "end_excl"), by)


def tag(intervals: DataFrame, name: str, by: Sequence[str] = REC) -> DataFrame:
    return intervals.select(*by, F.lit(name).alias("map"), "start", "end_excl")


def subtract(a: DataFrame, b: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """a without b."""
    return sweep(tag(a, "a", by).unionByName(tag(b, "b", by)), ["a", "b"], lambda c: (c["a"] > 0) & (c["b"] == 0), by)


def intersect(a: DataFrame, b: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    return sweep(tag(a, "a", by).unionByName(tag(b, "b", by)), ["a", "b"], lambda c: (c["a"] > 0) & (c["b"] > 0), by)


def union(*masks: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    out = masks[0].select(*by, "start", "end_excl")
    for m in masks[1:]:
        out = out.unionByName(m.select(*by, "start", "end_excl"))
    return merge(out, by)


def vote(tagged: DataFrame, maps: Sequence[str], least: int, by: Sequence[str] = REC) -> DataFrame:
    """Where at least `least` of the maps are on."""

    def on(c: dict[str, Column]) -> Column:
        return sum((F.when(x > 0, 1).otherwise(0) for x in c.values()), F.lit(0)) >= least

    return sweep(tagged, maps, on, by)


def carried(rows: DataFrame, at: Column, marks: DataFrame, mark_at: Column, value: Column, name: str, by: Sequence[str] = REC, upto: bool = False) -> DataFrame:
    """rows with `name`: the greatest `value` of the marks of their keys before position `at`, or at it too with `upto`.

    One sort of both by keys and position and a running maximum, in place of a range join: the work grows with the rows
    whatever they overlap. No such mark, or a null key, gives null.
    """
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    ours = rows.select(*keys, at.alias("_at"), F.lit(int(upto)).alias("_side"), F.struct(*rows.columns).alias("_row"))
    theirs = marks.select(*keys, mark_at.alias("_at"), F.lit(int(not upto)).alias("_side"), value.alias("_value"))
    order = Window.partitionBy(*(f"_k{i}" for i in range(len(by)))).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.lit(True)
    for i in range(len(by)):
        known = known & F.col(f"_k{i}").isNotNull()
    seen = ours.unionByName(theirs, allowMissingColumns=True).withColumn("_best", F.when(known, F.max("_value").over(order)))
    return seen.where(F.col("_row").isNotNull()).select("_row.*", F.col("_best").alias(name))


def overlapping(a: DataFrame, b: DataFrame, how: str, by: Sequence[str] = REC, width: int | None = None) -> DataFrame:
    """left_semi or left_anti join of a with the intervals of b that share a sample with it.

    An interval of a meets one of b just if the furthest end of those that start before it ends lies past its start: a
    running maximum, in work that grows with the intervals. With `width`, both sides are dealt to buckets of that many
    samples instead, so that a long recording is many tasks.
    """
    if width is None:
        far = carried(a, F.col("end_excl"), b, F.col("start"), F.col("end_excl"), "_far", by)
        touched = F.coalesce(F.col("_far") > F.col("start"), F.lit(False))
        return far.where(touched if how == "left_semi" else ~touched).drop("_far")
    right = b.select(*(F.col(k).alias(f"_{k}") for k in by), F.col("start").alias("_s"), F.col("end_excl").alias("_e"))
    touch = (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end_excl"))
    for k in by:
        touch = touch & (F.col(k) == F.col(f"_{k}"))
    cells = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width)))
    left = a.select(*by, "start", "end_excl").distinct().withColumn("_cell", cells(F.col("start"), F.col("end_excl")))
    right = right.withColumn("_cell_r", cells(F.col("_s"), F.col("_e")))
    hit = left.join(right, touch & (F.col("_cell") == F.col("_cell_r"))).select(*by, "start", "end_excl").distinct()
    return a.join(hit, [*by, "start", "end_excl"], how)


def met(a: DataFrame, b: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Every pair of an interval of a, which are disjoint, and one of b that share a sample: a's columns, b's row as `other`.

    The intervals that one of b meets are neighbours: their numbers run from the number of those that end by its start
    to that of those that start before its end. Pairs are an equi-join by number; nothing but true pairs is joined.
    """
    numbered = label(a.where("start < end_excl"), by, "_k")
    low = carried(b.select(*by, "start", "end_excl", F.struct(*b.columns).alias("other")), F.col("start"), numbered, F.col("end_excl"), F.col("_k"), "_low", by, upto=True)
    both = carried(low, F.col("end_excl"), numbered, F.col("start"), F.col("_k"), "_high", by)
    first = F.coalesce("_low", F.lit(0)) + 1
    pairs = both.where(F.col("_high") >= first).select(*by, "other", F.explode(F.sequence(first, F.col("_high"))).alias("_k"))
    return numbered.join(pairs, [*by, "_k"]).select(*a.columns, "other")


def held(points: DataFrame, intervals: DataFrame, by: Sequence[str] = REC, index: str = "idx", cell: int = 1024) -> DataFrame:
    """Every pair of a point and an interval that holds it: columns of both, the keys once.

    Cells of `cell` samples are a key of the join, so a point meets the intervals of its cell only, and a long recording
    is many tasks.
    """
    at = lambda c: F.floor(c / cell)
    dealt = intervals.where("start < end_excl").withColumn("_cell", F.explode(F.sequence(at(F.col("start")), at(F.col("end_excl") - 1))))
    pairs = points.withColumn("_cell", at(F.col(index))).join(dealt, [*by, "_cell"])
    return pairs.where((F.col(index) >= F.col("start")) & (F.col(index) < F.col("end_excl"))).drop("_cell")


def longer(intervals: DataFrame, least: int, by: Sequence[str] = REC) -> DataFrame:
    """Intervals of over `least` samples, each with `longest`, the greatest size of its keys."""
    size = F.col("end_excl") - F.col("start")
    return intervals.withColumn("longest", F.max(size).over(Window.partitionBy(*by))).where(size > least)


def first_run(intervals: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """The earliest interval of each key; its end is its last sample."""
    return intervals.groupBy(*by).agg(F.min("start").alias("start"), (F.min_by("end_excl", "start") - 1).alias("end_excl"))


def regions(intervals: DataFrame, by: Sequence[str] = REC) -> DataFrame:
    """Intervals of over one sample, numbered by position as `region`; each ends at its last sample."""
    numbered = label(intervals.where("end_excl - start > 1"), by, "region")
    return numbered.select(*by, "region", "start", (F.col("end_excl") - 1).alias("end_excl"))


def fill_gaps_over(bouts: DataFrame, events: DataFrame, most: int, by: Sequence[str] = REC) -> DataFrame:
    """Join neighbouring bouts at most `most` samples apart if an event lies in [last sample, next start)."""
    order = Window.partitionBy(*by).orderBy("start")
    gaps = bouts.select(*by, (F.col("end_excl") - 1).alias("start"), F.lead("start").over(order).alias("end_excl"))
    gaps = gaps.where((F.col("end_excl") - F.col("start") <= most) & (F.col("end_excl") > F.col("start")))
    return union(bouts, overlapping(gaps, events, "left_semi", by), by=by)


def continuity(bouts: DataFrame, least: int, lapse: int, tolerance: int, by: Sequence[str] = REC) -> DataFrame:
    """Bouts of over `least` samples, and chains of shorter ones with small gaps that are as long together.

    A fold over a recording's bouts in order (they are few: the fold runs in `aggregate`). A short bout starts a chain
    only if it ends over `lapse` samples after the last one that failed; following bouts join while the gap is at
    most `tolerance`. The chain is kept if its span is over `least`.
    """
    bout = "struct<start:bigint,end_excl:bigint>"
    ordered = bouts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "end_excl"))).alias("_b"))

    def step(x: Column, i: Column) -> Column:
        b = F.get(F.col("_b"), i)
        later = F.slice(F.col("_b"), i + 2, F.size("_b"))
        chain = F.aggregate(later, F.struct(b["end_excl"].alias("to"), F.lit(1).alias("n"), F.lit(True).alias("on")), lambda c, y: F.when(c["on"] & (y["start"] - c["to"] <= tolerance), F.struct(y["end_excl"].alias("to"), (c["n"] + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(c["to"].alias("to"), c["n"].alias("n"), F.lit(False).alias("on"))))
        wide = b["end_excl"] - b["start"] > least
        tried = b["end_excl"] - x["last"] > lapse
        joined = tried & (chain["to"] - b["start"] > least)
        kept = F.array(F.struct(b["start"].alias("start"), F.when(wide, b["end_excl"]).otherwise(chain["to"]).alias("end_excl")))
        out = F.when(wide | joined, F.concat(x["out"], kept)).otherwise(x["out"])
        skip = F.when(wide | ~tried, i + 1).otherwise(i + chain["n"])  # a chain that fails is used up all the same
        last = F.when(wide, x["last"]).when(joined, chain["to"]).otherwise(b["end_excl"])
        return F.when(i < x["next"], x).otherwise(F.struct(out.alias("out"), last.cast("long").alias("last"), skip.cast("int").alias("next")))

    start = F.struct(F.array().cast(f"array<{bout}>").alias("out"), F.lit(-lapse).cast("long").alias("last"), F.lit(0).alias("next"))
    folded = ordered.select(*by, F.aggregate(F.sequence(F.lit(0), F.size("_b") - 1), start, step)["out"].alias("_out"))
    return merge(folded.select(*by, F.inline("_out")), by)
