"""Insight operators over a parent/child key pair.

Child rows are aggregated to one row per key *before* the join, so neither
join side carries more than one row per key: a hot foreign key is reduced
map-side and cannot skew the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.text import INSIGHT_TEMPLATES, fill_template
from strata.operators.relationships import best_per_pair, relationship_order


def children_counts(parent: DataFrame, child: DataFrame, pk: str, fk: str,
                    name: str) -> DataFrame:
    """Every parent key with the number of matching children, 0 kept.

    Same result as ``parent LEFT JOIN child GROUP BY pk`` with
    ``COUNT(child.fk)``, including repeated parent keys.
    """
    kids = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(pk)).agg(
        F.count(F.lit(1)).alias("_kids")
    )
    parents = parent.groupBy(pk).agg(F.count(F.lit(1)).alias("_mult"))
    return parents.join(kids, pk, "left").select(
        pk, (F.col("_mult") * F.coalesce(F.col("_kids"), F.lit(0))).cast("long").alias(name)
    )


def children_per_parent(parent: DataFrame, child: DataFrame, pk: str, fk: str,
                        name: str, n: int = 10) -> DataFrame:
    """Top n parents by child count, key as tie-break."""
    return children_counts(parent, child, pk, fk, name).orderBy(F.col(name).desc(), F.col(pk)).limit(n)


def childless_parents(parent: DataFrame, child: DataFrame, pk: str, fk: str,
                      name: str) -> DataFrame:
    """Parents whose child count is 0 (D2 + HAVING)."""
    return children_counts(parent, child, pk, fk, name).where(F.col(name) == 0)


def orphans(parent: DataFrame, child: DataFrame, pk: str, fk: str,
            n: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Child rows without a parent, NULL keys included.

    ``n`` previews the first n by ``order`` (the key, by default); the default
    returns all orphans.
    """
    keys = parent.select(F.col(pk).alias(fk)).where(F.col(fk).isNotNull()).distinct()
    out = child.join(keys, fk, "left_anti")
    return out.orderBy(*(order or [fk])).limit(n) if n else out


def top_parents(parent: DataFrame, child: DataFrame, pk: str, fk: str,
                name: str = "total", n: int = 5) -> DataFrame:
    """Top n parents by matched children, inner join semantics."""
    return (
        children_counts(parent, child, pk, fk, name)
        .where(F.col(name) > 0)
        .orderBy(F.col(name).desc(), F.col(pk))
        .limit(n)
    )


def insight_queries(rel: DataFrame, top_n: int = 6) -> DataFrame:
    """Three SQL texts per table pair among the top-n relationships.

    Top n first, then the first row per (parent_table, child_table).
    """
    top = rel.orderBy(*relationship_order()).limit(top_n)
    best = best_per_pair(top)
    pt, pc, ct, cc = (F.col(c) for c in ("parent_table", "parent_col", "child_table", "child_col"))
    texts = F.array(*[
        F.struct(F.lit(kind).alias("kind"), fill_template(tpl, pt, pc, ct, cc).alias("sql"))
        for kind, tpl in INSIGHT_TEMPLATES
    ])
    return best.select(
        "parent_table", "parent_col", "child_table", "child_col", F.inline(texts)
    )
