"""Text expressions: percent text and SQL text from relationship rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_text(c: Column, digits: int = 1) -> Column:
    """Ratio as percent text with half-even rounding, e.g. 0.8125 -> '81.2%' (I10)."""
    return F.format_string(f"%.{digits}f%%", F.bround(c * F.lit(100.0), digits))


# SQL templates generated per relationship (I21). Placeholders: {pt} parent
# table, {pc} parent column, {ct} child table, {cc} child column; in double
# quotes they are identifiers. The heading comments are fixed texts.
CHILDREN_PER_PARENT_SQL = (
    "-- How many {ct} per {pt}?\n"
    'SELECT p."{pc}", COUNT(c."{cc}") AS "cnt_{ct}" FROM "{pt}" p '
    'LEFT JOIN "{ct}" c ON c."{cc}" = p."{pc}" GROUP BY p."{pc}" '
    'ORDER BY "cnt_{ct}" DESC, p."{pc}" LIMIT 10'
)
ORPHANS_SQL = (
    "-- Orphaned {ct} (no matching {pt})\n"
    'SELECT c.* FROM "{ct}" c LEFT JOIN "{pt}" p ON c."{cc}" = p."{pc}" '
    'WHERE p."{pc}" IS NULL ORDER BY c."{cc}" LIMIT 10'
)
TOP_PARENTS_SQL = (
    "-- Top {pt} by number of {ct}\n"
    'SELECT p."{pc}", COUNT(*) AS total FROM "{pt}" p '
    'JOIN "{ct}" c ON c."{cc}" = p."{pc}" GROUP BY p."{pc}" '
    'ORDER BY total DESC, p."{pc}" LIMIT 5'
)
INSIGHT_TEMPLATES = (
    ("children_per_parent", CHILDREN_PER_PARENT_SQL),
    ("orphans", ORPHANS_SQL),
    ("top_parents", TOP_PARENTS_SQL),
)


def fill_template(template: str, pt: Column, pc: Column, ct: Column, cc: Column) -> Column:
    """Template text with the four placeholders replaced by column values; a
    double quote inside a name is doubled, as in any quoted identifier."""
    out = F.lit(template)
    for name, col in (("{pt}", pt), ("{pc}", pc), ("{ct}", ct), ("{cc}", cc)):
        out = F.replace(out, F.lit(name), F.replace(col, F.lit('"'), F.lit('""')))
    return out
