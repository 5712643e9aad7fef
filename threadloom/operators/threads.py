"""Events of a thread in order, with turns and phases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions import times
from threadloom.operators.numbering import GROUP, by_size, number_in_order, number_large
from threadloom.operators.running import previous, running_sum
from threadloom.runtime import cut, latest

#: Phase of each event type; anything else is discussion. Fixed values.
PHASES = {"review": "initial_review", "rebuttal": "rebuttal", "comment": "discussion", "meta_review": "meta_review", "decision": "decision", "rating_update": "post_rebuttal"}


def valid_events(events: DataFrame) -> DataFrame:
    """The latest version of every event, its time in microseconds and its plain role."""
    rows = events.select("event_id", "submission_id", "fetched_at", times.usable_time(F.col("timestamp")).alias("t"), F.coalesce(F.lower(X.strip(F.col("role"))), F.lit("")).alias("role"), "actor_id", "event_type", "rating", "confidence")
    return latest(rows, ["event_id"], "fetched_at", ["event_id", "submission_id", "t", "role", "actor_id", "event_type", "rating", "confidence"])


def indexed(events: DataFrame) -> DataFrame:
    """valid_events with event_index from 0: by time, events without one first, then by event_id."""
    numbered = number_in_order(valid_events(events).where("submission_id is not null"), ["submission_id"], ["t", "event_id"], "event_index")
    return numbered.withColumn("event_index", F.col("event_index") - 1)


def _bump(kind: Column, role: Column, before: Column) -> Column:
    """Whether an event begins a turn by itself."""
    other = lambda who: ~before.eqNullSafe(who)
    bump = ((kind == "review") & other(F.lit("reviewer"))) | ((kind == "rebuttal") & other(F.lit("author"))) | ((kind == "comment") & other(role)) | kind.isin("meta_review", "decision")
    return F.coalesce(bump, F.lit(False)).cast("int")


def turns(events: DataFrame, most: int | None = None) -> DataFrame:
    """Indexed events with turn and phase.

    A turn begins with a review not after a reviewer, a rebuttal not after an author, a comment of another role than before,
    with every meta review and decision, and with the first event that is no rating update. A reviewer's comment after a
    rebuttal is post_rebuttal. Threads of up to `most` events go through windows in one shuffle, larger ones through blocks.
    """
    valid = cut(valid_events(events).where("submission_id is not null"), "valid")
    kind, role = F.col("event_type"), F.col("role")
    small, large = by_size(valid, ["submission_id"], GROUP if most is None else most)
    columns = ["submission_id", "event_id", "event_index", "event_type", "role", "actor_id", "bumps", "first_index", "bumps_there", "rebuttals"]
    parts = []
    if small is not None:
        thread = Window.partitionBy("submission_id")
        order = thread.orderBy("t", "event_id")
        so_far = order.rowsBetween(Window.unboundedPreceding, 0)
        at = small.withColumns({"event_index": F.row_number().over(order).cast("long") - 1, "bump": _bump(kind, role, F.lag("role").over(order))})
        plain = kind != "rating_update"
        at = at.withColumns({"bumps": F.sum("bump").over(so_far), "rebuttals": F.sum((kind == "rebuttal").cast("int")).over(so_far)})
        first = F.min(F.when(plain, F.struct("event_index", "bumps"))).over(thread)
        parts.append(at.withColumn("first", first).withColumns({"first_index": F.col("first.event_index"), "bumps_there": F.col("first.bumps")}).select(*columns))
    if large is not None:
        numbered = number_large(large, ["submission_id"], ["t", "event_id"], "event_index").withColumn("event_index", F.col("event_index") - 1)
        at = previous(cut(numbered, "indexed"), "submission_id", "event_index", {"before": "role"})
        sums = running_sum(at, "submission_id", "event_index", {"bumps": _bump(kind, role, F.col("before")), "rebuttals": F.coalesce(kind == "rebuttal", F.lit(False)).cast("int")})
        first = sums.where("event_type != 'rating_update'").groupBy("submission_id").agg(F.min(F.struct("event_index", "bumps")).alias("first"))
        parts.append(sums.join(first, "submission_id", "left").withColumns({"first_index": F.col("first.event_index"), "bumps_there": F.col("first.bumps")}).select(*columns))
    sums = reduce(DataFrame.union, parts)
    # the first plain event counts as a bump whether it is one or not; if it is none, none came before it
    extra = F.when((F.col("event_index") >= F.col("first_index")) & (F.col("bumps_there") == 0), 1).otherwise(0)
    phase = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in PHASES.items() for x in p]), kind), F.lit("discussion"))
    after = (kind == "comment") & (role == "reviewer") & (F.coalesce("rebuttals", F.lit(0)) > 0)
    return sums.select("submission_id", "event_id", "event_index", "event_type", "role", "actor_id", (F.col("bumps") + extra).alias("turn"), F.when(after, "post_rebuttal").otherwise(phase).alias("phase"))


def rating_changes(versions: DataFrame) -> DataFrame:
    """versions (event_id, fetched_at, rating, confidence): those that differ from the last known rating or confidence."""
    before = Window.partitionBy("event_id").orderBy("fetched_at", "rating", "confidence").rowsBetween(Window.unboundedPreceding, -1)
    known = versions.withColumns({"last_rating": F.last("rating", True).over(before), "last_confidence": F.last("confidence", True).over(before)})
    return known.where(F.col("last_rating").isNotNull() & (~F.col("rating").eqNullSafe(F.col("last_rating")) | ~F.col("confidence").eqNullSafe(F.col("last_confidence"))))


def first_per_actor(turned: DataFrame) -> DataFrame:
    """Each reviewer's first statement in a thread: in turn 1, else their first review, else their first event."""
    priority = F.when(F.col("turn") == 1, 0).when(F.col("event_type") == "review", 1).otherwise(2)
    mine = turned.where(F.col("role") == "reviewer").where("actor_id is not null")
    best = mine.groupBy("submission_id", "actor_id").agg(F.min(F.struct(priority.alias("p"), "event_index", "event_id")).alias("m"), F.sum((F.col("turn") > 1).cast("int")).alias("n_followups"))
    return best.select("submission_id", "actor_id", F.col("m.event_id").alias("first_event_id"), "n_followups")
