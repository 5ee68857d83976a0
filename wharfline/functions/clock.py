"""Times in the forms that archives, manifests and job logs hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1980-01-01, where DOS dates begin; seconds before each retry; retries there are.
DOS_START = 315532800
BACK_OFF = (5, 15, 60, 300)
RETRIES = 5

#: How a stamp goes on after its seconds: at most six digits of a fraction, and Z or an offset.
_AFTER_SECONDS = r"\A(?:[.][0-9]{1,6})?(Z|[-+][0-9:]{5})\z"


def utc_text(seconds: Column) -> Column:
    """YYYY-MM-DD hh:mm:ss in UTC of a Unix time, whatever the session's time zone; null stays."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))).cast("string")


def dos_datetime(seconds: Column) -> Column:
    """Struct of time and date of a zip entry, in steps of two seconds; earlier times are 1980's first, null stays."""
    at = F.greatest(F.lit(DOS_START), seconds).cast("long")
    second = F.pmod(at, F.lit(86400))
    day = F.date_add(F.lit("1970-01-01").cast("date"), ((at - second) / 86400).cast("int"))
    hour, minute, pair = (F.floor(F.pmod(second, F.lit(a)) / b) for a, b in ((86400, 3600), (3600, 60), (60, 2)))
    time = hour * 2048 + minute * 32 + pair
    date = (F.year(day) - 1980) * 512 + F.month(day) * 32 + F.dayofmonth(day)
    return F.when(seconds.isNotNull(), F.struct(time.cast("int").alias("time"), date.cast("int").alias("date")))


def is_stamp(text: Column) -> Column:
    """Whether a text is a manifest's ISO time, with Z or an offset, that exists on the calendar and in the world's zones; null isn't, nor is one with anything after it."""
    seconds = F.substring(text, 1, 19)
    zone = F.regexp_extract(F.substring(text, F.lit(20), F.length(text)), _AFTER_SECONDS, 1)
    judged = F.try_to_timestamp(F.concat(seconds, zone), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce((zone != "") & judged.isNotNull(), F.lit(False))


def retry_after(tries: Column) -> Column:
    """Seconds to wait before the next retry after so many (1 and more) failed tries; null when no retry is left."""
    waits = F.array(*map(F.lit, BACK_OFF))
    return F.when(tries.between(1, RETRIES), F.get(waits, F.least(tries.cast("int"), F.lit(len(BACK_OFF))) - 1))


def may_start(first: Column, left: Column, slowest: Column, margin: float = 1.5) -> Column:
    """Whether a unit of work starts in a tick: the first always, others if the time left covers the slowest of their kind with a margin. A kind never measured waits."""
    return first | F.coalesce((left > 0) & (left >= slowest * margin), F.lit(False))
