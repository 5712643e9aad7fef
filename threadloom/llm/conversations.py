"""Problem 3: rebuilding conversations from message rows by merging fragments that overlap.

Every event is exported with its reply link, a fragment of two message hashes: [answered, event]. Two fragments overlap
where the suffix of one (its last hash) is the prefix of the other (its first). An event answers one event at most, so
in this overlap graph the path towards the opener never forks and may be merged without doubt. All fragments merge at
once, each with the fragment that ends where it begins, which doubles their lengths: a path of n links is whole after
log2(n) rounds. A fragment that reaches an opener is done; one whose prefix no event has is a gap, one that bites its own
tail a circle, and both are dropped. A merged fragment needs only its ends, its number of links and its latest time.

Edges: of repeated rows of an event_id the one with the latest fetched_at counts (then the greatest row); null event_ids
and submission_ids belong to no discussion; blank means null, empty or only white space, no-break spaces or zero-width
characters; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.functions.times import speaker, usable_time
from threadloom.operators.numbering import number_in_order
from threadloom.runtime import cut, latest

def message_hash(submission: Column, event: Column) -> list[Column]:
    """96 bits, in two columns."""
    return [F.xxhash64(submission, event), F.hash(event, submission)]


def fragments(events: DataFrame) -> DataFrame:
    """One row per valid event: its hash (h, g), that of the answered one (ph, pg; null for openers) and what order and speakers need."""
    text = ~X.blank(F.col("text"))
    rows = events.select("event_id", "submission_id", "fetched_at", "reply_to_event_id", usable_time(F.col("timestamp")).alias("t"), text.alias("message"), speaker(F.col("role"), F.col("actor_id")).alias("speaker"))
    valid = latest(rows, ["event_id"], "fetched_at", ["event_id", "submission_id", "reply_to_event_id", "t", "message", "speaker"]).where("submission_id is not null")
    reply = X.strip(F.col("reply_to_event_id"))
    opener = X.blank(F.col("reply_to_event_id")) | (reply == F.col("submission_id"))
    h, g = message_hash(F.col("submission_id"), F.col("event_id"))
    ph, pg = message_hash(F.col("submission_id"), reply)
    return valid.select("event_id", h.alias("h"), g.alias("g"), F.when(~opener, ph).alias("ph"), F.when(~opener, pg).alias("pg"), "t", "message", "speaker")


def merge_paths(links: DataFrame) -> DataFrame:
    """links (h, g, ph, pg, t). Returns (h, g, rh, rg, links, t) of all events whose path ends at an opener (rh, rg).

    t becomes the latest time on the path, null where there is none.
    """
    state = ["h", "g", "ph", "pg", "links", "t"]
    start = links.select("h", "g", "ph", "pg", F.when(F.col("ph").isNull(), 0).otherwise(1).alias("links"), "t")
    done = [start.where("ph is null").select("h", "g", F.col("h").alias("ph"), F.col("g").alias("pg"), "links", "t")]
    todo = start.where("ph is not null")
    while True:
        whole = reduce(DataFrame.union, done).withColumn("done", F.lit(True))
        ends = whole.union(todo.withColumn("done", F.lit(False))).select(*[F.col(c).alias(f"_{c}") for c in [*state, "done"]])
        met = todo.join(ends, (F.col("ph") == F.col("_h")) & (F.col("pg") == F.col("_g")))
        merged = met.select("h", "g", F.col("_ph").alias("ph"), F.col("_pg").alias("pg"), (F.col("links") + F.col("_links")).alias("links"), F.greatest("t", "_t").alias("t"), F.col("_done").alias("done"))
        merged = cut(merged, "paths")
        counts = {r["done"]: r["count"] for r in merged.groupBy("done").count().collect()}
        done.append(merged.where("done").select(*state))
        todo = merged.where("not done").select(*state)
        if not counts.get(False) or not counts.get(True):  # all are done, or only gaps and circles remain
            return reduce(DataFrame.union, done).select("h", "g", F.col("ph").alias("rh"), F.col("pg").alias("rg"), "links", "t")


def discussions(events: DataFrame) -> DataFrame:
    """(opener_id, msg_no, event_id, speaker): every message of every kept discussion, in order."""
    rows = cut(fragments(events), "fragments")
    paths = merge_paths(rows.select("h", "g", "ph", "pg", "t"))
    what = rows.select("h", "g", "event_id", "message", "speaker")
    placed = cut(paths.join(what, ["h", "g"]), "placed")
    said = F.when(F.col("message"), F.col("speaker"))
    opener = (F.col("h") == F.col("rh")) & (F.col("g") == F.col("rg"))
    of = placed.groupBy("rh", "rg").agg(
        F.max(F.when(opener, F.col("message"))).alias("opened"),
        F.max(F.when(opener, F.col("event_id"))).alias("opener_id"),
        F.max(F.col("message") & F.col("speaker").isNull()).alias("unknown"),
        F.min(said).alias("one"), F.max(said).alias("other"),
    )
    kept = of.where("opened and not unknown and one != other").select("rh", "rg", "opener_id")
    lines = placed.where("message").join(kept, ["rh", "rg"]).select("opener_id", "t", "links", "event_id", "speaker")
    return number_in_order(lines, ["opener_id"], ["t", "links", "event_id"], "msg_no").select("opener_id", F.col("msg_no").cast("int"), "event_id", "speaker")
