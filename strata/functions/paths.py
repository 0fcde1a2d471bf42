"""Path and key expressions (I11-I15, I20). Each is ``Column -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rtrim_slash(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "/+$", "")


def basename(c: Column | str) -> Column:
    """Last path component, trailing slashes ignored."""
    return F.element_at(F.split(rtrim_slash(c), "/"), -1)


def dirname(c: Column | str) -> Column:
    """Parent directory of a path (no trailing slash)."""
    return F.regexp_replace(rtrim_slash(c), "/[^/]*$", "")


def extension(c: Column | str) -> Column:
    """Text after the last dot of the basename, '' when there is none."""
    return F.regexp_extract(basename(c), r"\.([^.]*)$", 1)


def relative_to(c: Column | str, root: str) -> Column:
    """Path relative to ``root`` with ``\\`` turned into ``/`` (I12); NULL when
    the path is not under the root."""
    r = root.rstrip("/") + "/"
    norm = F.replace(_c(c), F.lit("\\"), F.lit("/"))
    return F.when(norm.startswith(r), F.substring(norm, len(r) + 1, 1 << 30))


def last_two_parts(c: Column | str) -> Column:
    """Identifier of a directory: its last two parts joined by ``_``.

    A one-part path yields that part (``slice`` of a short array would drop it).
    """
    parts = F.filter(F.split(_c(c), "/"), lambda p: p != "")
    n = F.size(parts)
    return F.when(n >= 2, F.array_join(F.slice(parts, -2, 2), "_")).otherwise(
        F.array_join(parts, "_")
    )


def object_key(*parts: Column | str) -> Column:
    """Object key built from a prefix and parts, joined by ``/``.

    Strings are taken as literals, Columns as values.
    """
    cols = [F.lit(p) if isinstance(p, str) else p for p in parts]
    return F.concat_ws("/", *cols)


def stamp_name(name: Column | str, ts: Column, suffix: str = "") -> Column:
    """``<name>_<yyyyMMdd_HHmmss><suffix>``."""
    return F.concat(_c(name), F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(suffix))


def minus_hours(ts: Column, hours: float) -> Column:
    """Timestamp minus hours (I16); fractional hours are kept to the microsecond."""
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(round(hours * 3600, 6)).cast("decimal(18,6)"))
