"""Times and speakers of thread events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import text as X

#: What the last part of an actor_id tells. Fixed values of the data.
ACTORS = {"reviewer": "^reviewer", "author": "^author", "area_chair": "^area_chair", "program_chair": "^program_chair"}


def usable_time(c: Column) -> Column:
    """ISO date and time, with or without fraction and offset (none: UTC), as microseconds; null for anything else."""
    s = F.upper(X.strip(c))
    iso = s.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$")
    zoned = F.when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & s.rlike(":.*(Z|[+-])"), s).otherwise(F.concat(s, F.lit("Z")))
    zoned = F.regexp_replace(zoned, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(iso, F.unix_micros(zoned.try_cast("timestamp")))


def speaker(role: Column, actor: Column) -> Column:
    """The role, or where it is blank or unknown what the actor_id tells; else null."""
    name = F.lower(X.strip(role))
    last = F.lower(F.regexp_extract(actor, r"([^/]*)/*\s*$", 1))
    told = F.lit(None).cast("string")
    for who, pattern in ACTORS.items():
        told = F.when(last.rlike(pattern), who).otherwise(told)
    return F.when(~X.blank(role) & (name != "unknown"), name).otherwise(told)


def iso(millis: Column) -> Column:
    """Epoch milliseconds as an ISO string in UTC; null for null and zero."""
    t = F.timestamp_millis(millis)
    return F.when(millis.isNotNull() & (millis != 0), F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'"))
