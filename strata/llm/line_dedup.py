"""Cross-site boilerplate lines by distinct-site spread (operator 8).

A line (between line feeds, outer white space trimmed) that stands on
``MIN_SITES`` or more distinct sites is boilerplate and is removed from every
document. The number of sites of each line is a HyperLogLog sketch per line
hash, merged by aggregation; lines whose estimate is within ``MARGIN`` of the
threshold (five standard errors, one site at least) are counted exactly,
which decides.

Every aggregation combines inside the tasks first, so a line that stands in
every document is one row a task. Which lines of a text go is worked out on
(text hash, position) rows; whole texts are shuffled once.

Blank lines are neither counted nor removed. Null text has no lines; a null
site is a site of its own; repeated rows are each cleaned and add no sites.
An empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import text_sha

MIN_SITES = 8
PRECISION = 12           # 2 ** 12 registers: 1.6 % standard error
MARGIN = 0.08
SPACE = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def _key(line: Column) -> Column:
    """96 bits that stand for a line: two hashes of different kinds."""
    return F.struct(F.xxhash64(line).alias("a"), F.crc32(line.cast("binary")).alias("b"))


def line_rows(docs: DataFrame) -> DataFrame:
    """(site, key) of every line with a word of (text, site)."""
    return (docs.where("text IS NOT NULL").select("site", F.explode(_lines(F.col("text"))).alias("line"))
            .select("site", _trimmed(F.col("line")).alias("line")).where("line <> ''")
            .select("site", _key(F.col("line")).alias("key")))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(key) of the lines of (text, site) that stand on ``min_sites`` sites."""
    rows = line_rows(docs)
    spread = rows.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(PRECISION))).alias("sites"))
    margin = max(1.0, MARGIN * min_sites)
    sure = spread.where(F.col("sites") > min_sites + margin).select("key")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("key")
    exact = (rows.join(near, "key", "left_semi").groupBy("key", "site").count()
             .groupBy("key").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites).select("key"))
    return sure.union(exact)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
                min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, text (without boilerplate lines), sha (of the text before),
    n_lines, n_removed for every row of ``docs``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_sha(F.col(text_col)).alias("sha"),
        F.xxhash64(F.coalesce(F.concat(F.lit("0"), F.col(site_col).cast("string")), F.lit("1"))).alias("site"))
    places = (rows.where("text IS NOT NULL").select("sha", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
              .select("sha", "at", _key(_trimmed(F.col("line"))).alias("key")))
    # one row for each place of a text, however many rows repeat the text
    gone = (places.join(boilerplate(rows, min_sites), "key", "left_semi").groupBy("sha", "at").count()
            .groupBy("sha").agg(F.collect_list("at").alias("gone")))
    lines = F.coalesce(_lines(F.col("text")), F.array())
    # positions that stay by a set difference, then the lines there: linear in the lines (bound once by the outer function)
    kept = F.transform(F.array(lines), lambda all_: F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("gone")), lambda at: F.get(all_, at)))[0]
    return rows.join(gone, "sha", "left").select(
        "doc_id",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        "sha", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
