"""Events by instrument: business days since and until them, and restrictions that come into effect at dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_backward, asof_forward

#: A Monday.
_MONDAY = "1970-01-05"


def weekdays_before(date: Column) -> Column:
    """Weekdays from a fixed Monday up to a date, itself not included."""
    n = F.datediff(date, F.lit(_MONDAY).cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(start: Column, end: Column) -> Column:
    """Weekdays from start, included, to end, not included."""
    return (weekdays_before(end) - weekdays_before(start)).cast("double")


def days_since_event(panel: DataFrame, events: DataFrame) -> DataFrame:
    """panel with since: business days since the instrument's latest event (instrument, event_date) at or before a row; null without one."""
    out = asof_backward(panel, events.select("instrument", "event_date"), "instrument", "date", "event_date", ["event_date"])
    return out.withColumn("since", business_days(F.col("event_date"), F.col("date"))).drop("event_date")


def days_until_event(panel: DataFrame, events: DataFrame) -> DataFrame:
    """panel with until: business days until the instrument's next event at or after a row; null without one."""
    out = asof_forward(panel, events.select("instrument", "event_date"), "instrument", "date", "event_date", "event_date")
    return out.withColumn("until", business_days(F.col("date"), F.col("next_at"))).drop("next_at", "next_value")


def restricted(panel: DataFrame, changes: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """panel with restricted: whether the latest change (instrument, effective, frozen) at or before a row froze the instrument, or it is
    among always (instrument). Instruments without a change are free; of changes at one time a freeze wins."""
    out = asof_backward(panel, changes, "instrument", "date", "effective", ["frozen"])
    out = out.withColumn("restricted", F.coalesce("frozen", F.lit(False))).drop("frozen")
    if always is None:
        return out
    names = always.select("instrument", F.lit(True).alias("_always")).distinct()
    return out.join(names, "instrument", "left").withColumn("restricted", F.col("restricted") | F.coalesce("_always", F.lit(False))).select(*out.columns)
