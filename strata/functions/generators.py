"""Random and derived scalar expressions (I1-I8, I18). All JVM-side.

Random values are counter-based: a value is a function of a seed and of the
row's id alone, so it is the same however the rows are partitioned, repeated
or read again, and any engine with MD5 can compute it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_DIGITS = 13                    # hex digits of the digest: 52 bits, exact in a double
_UNIT = float(1 << 4 * UNIT_DIGITS)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit(seed: int, at: Column | str = "id") -> Column:
    """Uniform double in [0, 1): the first 52 bits of the MD5 of ``seed:id``."""
    digest = F.md5(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(_c(at).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, UNIT_DIGITS), 16, 10).cast("long") / F.lit(_UNIT)


def uniform(k: float, seed: int, at: Column | str = "id") -> Column:
    """Uniform double in [0, k)."""
    return unit(seed, at) * F.lit(float(k))


def uniform_int(k: int, seed: int, at: Column | str = "id") -> Column:
    """Uniform integer in 1..k."""
    return (F.lit(1) + F.floor(unit(seed, at) * F.lit(k))).cast("long")


def letter_from_id(c: Column | str) -> Column:
    """chr(65 + id mod 26): 'A'..'Z' (I3)."""
    return F.char((F.lit(65) + F.pmod(_c(c), F.lit(26))).cast("long"))


def pick(values: Sequence[str], seed: int, at: Column | str = "id") -> Column:
    """Uniform choice from a fixed list (I4)."""
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.lit(1) + F.floor(unit(seed, at) * len(values))).cast("int"))


def date_in_span(start: str, end: str, seed: int, at: Column | str = "id") -> Column:
    """A whole day in [start, end) chosen uniformly."""
    span = F.datediff(F.to_date(F.lit(end)), F.to_date(F.lit(start)))
    return F.date_add(F.to_date(F.lit(start)), F.floor(unit(seed, at) * span).cast("int"))


def days_from_today(max_days: int, seed: int, at: Column | str = "id", today: Column | None = None) -> Column:
    """A day in [today, today + max_days) (I5); ``today`` is the clock, by default the real one."""
    return F.date_add(today if today is not None else F.current_date(), F.floor(unit(seed, at) * max_days).cast("int"))


def round2(c: Column) -> Column:
    """Round to 2 decimals."""
    return F.round(c, 2)


def email_from_name(name: Column, domain: Column) -> Column:
    """lower(name) with spaces as dots, '@', domain (I8)."""
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit(".")), F.lit("@"), domain)


def int_div(c: Column, d: int) -> Column:
    """Integer division toward zero, like shell arithmetic."""
    return F.call_function("div", c.cast("long"), F.lit(d))
