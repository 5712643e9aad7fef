"""Thread queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import threads as T
from threadloom.plans import sql as S
from threadloom.runtime import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "thread_events")


def event_index(spark: SparkSession, d: str) -> DataFrame:
    return T.indexed(_events(spark, d)).select("submission_id", "event_id", "event_index")


def thread_turns(spark: SparkSession, d: str) -> DataFrame:
    return T.turns(_events(spark, d)).select("submission_id", "event_id", F.col("turn").cast("long").alias("turn"))


def thread_phase(spark: SparkSession, d: str) -> DataFrame:
    return T.turns(_events(spark, d)).groupBy("submission_id", "phase").agg(F.count("*").alias("n"))


def rating_updates(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as versions of a rating in steps of 50, with a missing one for each refund: those that differ from the last known."""
    rating = F.when(F.col("event_type") != "refund", F.floor(F.col("value") / 50))
    versions = table(spark, d, "events").select(F.col("user_id").alias("event_id"), F.col("ts").alias("fetched_at"), rating.alias("rating"), F.lit(None).cast("double").alias("confidence"))
    return T.rating_changes(versions).select("event_id", "fetched_at", "rating", "last_rating")


def initial_and_followups(spark: SparkSession, d: str) -> DataFrame:
    return T.first_per_actor(T.turns(_events(spark, d)))


def participants(spark: SparkSession, d: str) -> DataFrame:
    """Each actor of a thread once per role, with the number of valid events."""
    return T.valid_events(_events(spark, d)).where("actor_id is not null").groupBy("submission_id", "role", "actor_id").agg(F.count("*").alias("n_events"))


def event_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.valid_events(_events(spark, d)).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("actor_id").alias("n_actors"), F.count_if(F.col("rating").isNotNull()).alias("n_rated"), F.round(F.avg("rating"), 6).alias("mean_rating"))


def top_users(spark: SparkSession, d: str) -> DataFrame:
    """The ten users with most events; ties by user."""
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


def rating_parse(spark: SparkSession, d: str) -> DataFrame:
    """Number and label of a rating written as text, from labels made of the rating and the event type."""
    label = F.concat(F.lit(" "), F.col("rating").cast("int").cast("string"), F.lit(": "), F.col("event_type"))
    rows = _events(spark, d).where("rating is not null").select(label.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return rows.select("s", F.regexp_extract("s", PATTERN, 1).try_cast("double").alias("rating"), X.strip(F.regexp_extract("s", PATTERN, 3)).alias("label"), "n")


#: A number, perhaps a colon, and a label. A fixed value.
PATTERN = r"^\s*([0-9]+(\.[0-9]+)?)\s*[:：]?\s*(.*)"
_V = S.latest("thread_events", "event_id", "fetched_at", {"submission_id": "submission_id", "t": "epoch_us(TRY_CAST(timestamp AS TIMESTAMPTZ))", "role": f"lower(coalesce({S.strip('role')}, ''))", "actor_id": "actor_id", "event_type": "event_type", "rating": "rating", "confidence": "confidence"})
_INDEXED = f"SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY t NULLS FIRST, event_id) - 1 AS event_index FROM {_V} WHERE submission_id IS NOT NULL"
_TURNED = f"""
    i AS ({_INDEXED}),
    l AS (SELECT *, lag(role) OVER w AS before FROM i WINDOW w AS (PARTITION BY submission_id ORDER BY event_index)),
    f AS (SELECT *, min(CASE WHEN event_type <> 'rating_update' THEN event_index END) OVER (PARTITION BY submission_id) AS first_index FROM l),
    b AS (SELECT *, CASE WHEN (event_type = 'review' AND before IS DISTINCT FROM 'reviewer') OR (event_type = 'rebuttal' AND before IS DISTINCT FROM 'author') OR (event_type = 'comment' AND before IS DISTINCT FROM role)
        OR event_type IN ('meta_review', 'decision') OR event_index = first_index THEN 1 ELSE 0 END AS bump FROM f),
    z AS (SELECT *, CAST(sum(bump) OVER w AS BIGINT) AS turn, sum(CASE WHEN event_type = 'rebuttal' THEN 1 ELSE 0 END) OVER w AS rebuttals FROM b WINDOW w AS (PARTITION BY submission_id ORDER BY event_index))"""
_PHASE = "CASE WHEN event_type = 'comment' AND role = 'reviewer' AND rebuttals > 0 THEN 'post_rebuttal' " + " ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in T.PHASES.items()) + " ELSE 'discussion' END"
QUERIES = {
    "event_index": event_index, "thread_turns": thread_turns, "thread_phase": thread_phase, "rating_updates": rating_updates, "initial_and_followups": initial_and_followups,
    "participants": participants, "event_type_counts": event_type_counts, "top_users": top_users, "rating_parse": rating_parse,
}
SQL = {
    "event_index": f"SELECT submission_id, event_id, event_index FROM ({_INDEXED})",
    "thread_turns": f"WITH {_TURNED} SELECT submission_id, event_id, turn FROM z",
    "thread_phase": f"WITH {_TURNED} SELECT submission_id, {_PHASE} AS phase, count(*) AS n FROM z GROUP BY 1, 2",
    "rating_updates": """
        WITH v AS (SELECT user_id AS event_id, ts AS fetched_at, CASE WHEN event_type <> 'refund' THEN CAST(floor(value / 50) AS BIGINT) END AS rating FROM events),
        k AS (SELECT *, last_value(rating IGNORE NULLS) OVER (PARTITION BY event_id ORDER BY fetched_at, rating NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_rating FROM v)
        SELECT event_id, fetched_at, rating, last_rating FROM k WHERE last_rating IS NOT NULL AND rating IS DISTINCT FROM last_rating""",
    "initial_and_followups": f"""
        WITH {_TURNED}, m AS (SELECT *, CASE WHEN turn = 1 THEN 0 WHEN event_type = 'review' THEN 1 ELSE 2 END AS p FROM z WHERE role = 'reviewer' AND actor_id IS NOT NULL)
        SELECT submission_id, actor_id, arg_min(event_id, p * 1000000000 + event_index) AS first_event_id, CAST(count(*) FILTER (turn > 1) AS BIGINT) AS n_followups FROM m GROUP BY 1, 2""",
    "participants": f"SELECT submission_id, role, actor_id, count(*) AS n_events FROM {_V} WHERE actor_id IS NOT NULL GROUP BY 1, 2, 3",
    "event_type_counts": f"SELECT event_type, count(*) AS n, count(DISTINCT actor_id) AS n_actors, count(rating) AS n_rated, round(avg(rating), 6) AS mean_rating FROM {_V} GROUP BY 1",
    "top_users": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "rating_parse": r"""
        WITH r AS (SELECT ' ' || CAST(CAST(floor(rating) AS INTEGER) AS VARCHAR) || ': ' || event_type AS s, count(*) AS n FROM thread_events WHERE rating IS NOT NULL GROUP BY 1)
        SELECT s, CAST(regexp_extract(s, '^\s*([0-9]+(\.[0-9]+)?)\s*[:：]?\s*(.*)', 1) AS DOUBLE) AS rating, trim(regexp_extract(s, '^\s*([0-9]+(\.[0-9]+)?)\s*[:：]?\s*(.*)', 3)) AS label, n FROM r""",
}
