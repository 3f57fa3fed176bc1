"""Day labels, and the address of a client behind proxies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def relative_day(label: Column, today: Column) -> Column:
    """The date of Today, Yesterday, a weekday (the last before today, never today itself), 'Mon d' (this year's, or last year's if that is still to come) or 'Mon d, yyyy'."""
    t = F.lower(F.trim(label))
    weekday = F.lit(None).cast("int")
    for i, name in enumerate(WEEKDAYS, 1):
        weekday = F.when(t == name, i).otherwise(weekday)
    back = F.pmod(F.dayofweek(today) - weekday, F.lit(7))
    back = F.when(back == 0, 7).otherwise(back)
    year = F.year(today)
    with_year = F.try_to_date(F.concat(F.trim(label), F.lit(", "), year.cast("string")), "MMM d, yyyy")
    past = F.when(with_year > today, F.add_months(with_year, -12)).otherwise(with_year)
    return F.when(t == "today", today).when(t == "yesterday", F.date_sub(today, 1)).when(weekday.isNotNull(), F.date_sub(today, back)).otherwise(F.coalesce(F.try_to_date(F.trim(label), "MMM d, yyyy"), past))


def client_address(hops: Column, direct: Column, trusted: int) -> Column:
    """The address that the last trusted proxy saw: the hop ``trusted`` before the end of the comma-separated list; the direct address without one."""
    parts = F.transform(F.split(hops, ","), lambda v: F.trim(v))
    return F.when(hops.isNull() | (F.size(parts) <= trusted), direct).otherwise(F.element_at(parts, -1 - trusted))
