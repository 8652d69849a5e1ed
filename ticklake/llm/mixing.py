"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1 (piecewise linear). Its integral is the
source's weight in the mix: weights share the wanted total, limited to ``most`` times what the source
has, the excess shared again by weight. A source's documents stand in one fixed random order
(by the MD5 of the id) and are gone through again from the start when they run out. The words
before a document are its cumulative demand; inverting the source's integrated schedule there gives
the training time at which the mix reaches it. Sorting all taken documents by that position is the
training order; a range partitioning puts it into files.

Documents are taken whole: a document belongs to the mix if its middle lies before the target, so a
source misses its target by half a document at most.

DataFrame functions only. The words before a document are summed inside (source, chunk), with one
carried total per chunk, so a source with a third of all rows is spread over many tasks. Only the
table of sources, one row each, is looked at as a whole.

Edge cases: a null text has size 0, and documents of size 0 are taken by the same rule without
adding words; a null source is a source of its own, the last one; null ids sort first in the order;
repeated rows are documents of their own; an empty table gives no rows; a source without words has
target 0; further columns are ignored. Reruns give the same rows, as all order is by hashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake.llm.common import WORD, join_same, numbered
from ticklake.session import cut

Schedule = Sequence[tuple[float, float]]

#: (time, weight) points of the schedules that sources take in turn. Their integrals are 5, 2 and 1: the heavy one
#: fades out over training, the light one fades in.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 6.25), (0.5, 5.0), (1.0, 3.75)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
SHARE, MOST = 1.5, 2.0


def area(schedule: Schedule) -> float:
    """Integral of a piecewise linear schedule."""
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def when_reached(share: Column, schedule: Schedule) -> Column:
    """The time at which ``share`` (0 to 1) of the schedule's integral is used up."""
    whole, used = area(schedule), 0.0
    out = F.lit(schedule[-1][0])
    parts = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        size = (t1 - t0) * (w0 + w1) / 2
        rest = share * whole - used
        slope = (w1 - w0) / (t1 - t0)
        x = rest / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(w0 * w0) + rest * (2 * slope), F.lit(0.0))) - w0) / slope
        parts.append((share * whole <= used + size, F.lit(t0) + x, size))
        used += size
    for inside, time, size in reversed(parts):
        out = F.when(inside, time).otherwise(out) if size else out
    return out


def targets(
    sources: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(source, source_size) -> source, source_size, kind, target.

    A source's weight is the integral of its schedule. The level at which the
    weights fill the wanted total, each source up to its limit, is the largest of the levels got by
    taking the k sources that are tightest for their weight as full.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("kind", F.pmod(number, F.lit(len(schedules))).cast("int"))
    weights = F.array(*[F.lit(float(area(s))) for s in schedules])
    ranked = ranked.withColumn("weight", F.element_at(weights, F.col("kind") + 1))
    ranked = ranked.withColumn("limit", F.col("source_size") * F.lit(most))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    wanted = F.sum("source_size").over(everything) * F.lit(share)
    levels = ranked.withColumn("level", (wanted - before) / left)
    level = F.max("level").over(everything)
    return levels.withColumn("target", F.least(F.col("limit"), level * F.col("weight"))).select(
        "source", "source_size", "kind", "target"
    )


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size in words)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(
    sized: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """(doc_id, source, size) -> with source_size, target, kind, before, times, taken; one row per document.

    ``before`` counts the words of the source that stand before the document in a pass, ``times`` how
    often the mix takes the document.
    """
    written = cut(sized.select("doc_id", "source", "size", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place")), "sized")
    chunk = F.substring("place", 1, 3)
    placed = numbered(written, ["source"], ["place", "doc_id", "size"], "before", F.col("size"), chunk)
    totals = written.groupBy("source").agg(F.sum("size").alias("source_size"))
    joined = join_same(placed, targets(totals, schedules, share, most), ["source"])
    middle = F.col("before") + F.col("size") / F.lit(2.0)
    times = sum(
        (F.when(middle + F.col("source_size") * F.lit(float(k)) < F.col("target"), 1).otherwise(0) for k in range(math.ceil(most))),
        F.lit(0),
    )
    out = joined.withColumn("times", times.cast("int")).drop("place")
    return out.withColumn("taken", F.col("size") * F.col("times"))


def position(copy: Column, schedules: Sequence[Schedule] = SCHEDULES) -> Column:
    """Training position (0 to 1) of a copy (from 0) of a planned document: where the middle of its words is reached."""
    demand = copy * F.col("source_size") + F.col("before") + F.col("size") / F.lit(2.0)
    share = F.when(F.col("target") > 0, F.least(demand / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
    out = F.lit(0.0)
    for kind, schedule in enumerate(schedules):
        out = F.when(F.col("kind") == kind, when_reached(share, schedule)).otherwise(out)
    return out


def positions(planned: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """One row per taken copy with its training position."""
    copies = planned.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return copies.withColumn("position", position(F.col("copy"), schedules))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents in training order: every taken copy with all columns of its document.

    The plan is made from sizes alone; texts are shuffled once, to their range of positions.
    """
    planned = positions(plan(sizes(docs), **options), options.get("schedules", SCHEDULES))
    taken = cut(planned.select("doc_id", "source", "size", "copy", "position"), "taken")
    # Repeated rows share id, source and size and take the same copies, so each is matched once.
    one = taken.groupBy("doc_id", "source", F.col("size").alias("_size"), F.col("copy").alias("_copy")).agg(
        F.min("position").alias("_position")
    )
    sized = docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    found = join_same(sized, one, ["doc_id", "source", "_size"])
    ordered = found.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id")
    return ordered.drop("_size", "_copy", "_position")
