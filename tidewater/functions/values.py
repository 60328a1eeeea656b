"""Numbers, dates and flags from filed text; guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column) -> Column:
    """A number filed as text: thousands separators dropped, ``(x)`` negative, unreadable null."""
    plain = F.trim(F.regexp_replace(text, ",", ""))
    signed = F.when(plain.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(plain, r"[()]", ""))).otherwise(plain)
    return signed.try_cast("double")


def flag(text: Column) -> Column:
    """Text 'True', '1', 'yes' as true, other text as false, null as false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def loose_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "dd MMM yyyy", "dd-MMM-yyyy")) -> Column:
    """The first of several shapes that reads as a date; never a guess."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats])


def first_present(*columns: Column) -> Column:
    """The first column that is neither null nor blank."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where whole is null or not above zero."""
    return F.when(whole > 0, part / whole)


def growth(now: Column, before: Column) -> Column:
    """Change in percent from a positive base, else null."""
    return F.when(before > 0, (now / before - 1) * 100)


def fiscal_quarter(day: Column, first_month: int = 4) -> Column:
    """'FY2025Q1': quarters of years that begin with ``first_month`` and are named by the year they end in."""
    shifted = F.add_months(day, 13 - first_month) if first_month > 1 else day
    return F.concat(F.lit("FY"), F.year(shifted).cast("string"), F.lit("Q"), F.quarter(shifted).cast("string"))


def crossed(before: Column, after: Column, thresholds: tuple[int, ...]) -> Column:
    """The thresholds between two values: after the lower, up to the higher."""
    low, high = F.least(before, after), F.greatest(before, after)
    return F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: (t > low) & (t <= high))
