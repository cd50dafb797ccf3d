"""Deadline parsing and date arithmetic. The clock is always an argument."""

from pyspark.sql import Column, functions as F

from .text import as_col, collapse, let, or_empty

# Accepted deadline shapes and the format that reads each.
DEADLINE_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"(?i)^(january|february|march|april|may|june|july|august|september|october|november|december) \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"(?i)^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"(?i)^\d{1,2} (january|february|march|april|may|june|july|august|september|october|november|december) \d{4}$", "d MMMM yyyy"),
    (r"(?i)^\d{1,2} (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec) \d{4}$", "d MMM yyyy"),
]


def parse_deadline(c, strip_lead: bool = False, extra_iso: bool = False) -> Column:
    """String to date by shape; anything else is null.

    `strip_lead` drops a leading "by" or "before"; `extra_iso` also reads ISO date-times.
    """
    v = collapse(or_empty(c))
    if strip_lead:
        v = F.regexp_replace(v, r"(?i)^(by|before) ", "")

    def read(x):
        out = None
        for shape, fmt in DEADLINE_FORMATS:
            hit = F.try_to_date(x, fmt)
            out = F.when(x.rlike(shape), hit) if out is None else out.when(x.rlike(shape), hit)
        if extra_iso:
            iso = x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
            out = out.when(iso, F.try_to_date(F.substring(x, 1, 10), "yyyy-MM-dd"))
        return out

    return let(v, read)


def format_date(c) -> Column:
    return F.date_format(as_col(c), "MMMM d, yyyy")


def as_date(as_of) -> Column:
    return F.lit(str(as_of)[:10]).cast("date")


def as_instant(as_of) -> Column:
    return F.lit(str(as_of)).cast("timestamp_ntz")


def days_until(date_col, as_of) -> Column:
    return F.datediff(as_col(date_col), as_date(as_of))


def micros(c) -> Column:
    """Timestamp without zone, read as UTC, to microseconds since the epoch."""
    return F.unix_micros(F.to_utc_timestamp(as_col(c).cast("timestamp"), F.current_timezone()))


def repair_deadline(deadline, candidates, as_of) -> Column:
    """Own future deadline reformatted; else earliest future candidate; else unchanged."""
    today = as_date(as_of)
    own = parse_deadline(deadline, strip_lead=True)
    future = F.filter(
        F.transform(as_col(candidates), lambda x: parse_deadline(x, strip_lead=True)), lambda d: d > today
    )
    return (
        F.when(own > today, format_date(own))
        .when(F.size(future) > 0, format_date(F.array_min(future)))
        .otherwise(as_col(deadline))
    )
