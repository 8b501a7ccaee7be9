"""Dates, rates and remaining times."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_ELAPSED_S = 60.0


def compact_date(text: str | None) -> date | None:
    """2024-05-01 or 20240501; None for None; an error for anything else."""
    if text is None:
        return None
    m = re.fullmatch(r"(\d{4})-?(\d{2})-?(\d{2})", text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    return date(*map(int, m.groups()))


def between(column: Column, after: date | None, before: date | None) -> Column:
    """Both ends included, either open."""
    test = F.lit(True)
    if after is not None:
        test = test & (column >= F.lit(after))
    if before is not None:
        test = test & (column <= F.lit(before))
    return test


def per_hour(done: Column, elapsed_s: Column) -> Column:
    """Null before a minute has passed or while nothing is done."""
    return F.when((elapsed_s >= LEAST_ELAPSED_S) & (done > 0), done / (elapsed_s / 3600.0))


def eta_s(rate: Column, done: Column, target: Column) -> Column:
    """Seconds to the target; null without a rate or beyond the target."""
    return F.when((rate > 0) & (target > done), (target - done) / rate * 3600.0)


#: Fixed value: the form of an HTTP date, without the name of the day.
HTTP_DATE = "dd MMM yyyy HH:mm:ss 'GMT'"


def retry_after_s(header: Column, now: Column) -> Column:
    """Seconds to wait by a service's Retry-After header: a number of seconds, or a date in UTC less `now`; none less than zero. Null for anything else."""
    text = F.trim(header)
    seconds = F.when(text.rlike(r"^[0-9]{1,9}$"), F.try_to_number(text, F.lit("999999999")).cast("double"))
    moment = F.try_to_timestamp(F.regexp_replace(text, r"^[A-Z][a-z]{2}, ", ""), F.lit(HTTP_DATE))
    return F.coalesce(seconds, F.when(moment.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(moment) - F.unix_micros(now)) / 1e6)))
