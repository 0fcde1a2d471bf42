"""Foreign-key discovery from value overlap.

All-pairs column comparison without comparing column pairs one by one:

1. every eligible column of every table gets a dense index and is unpivoted
   to ``(idx, v)``;
2. one shuffle on ``v``: per value, a bitmask of the columns holding it,
   built with ``bit_or`` over 64-bit words. It is a fixed-width declarative
   aggregate, so it runs in the Tungsten hash aggregate and combines
   map-side: a hot value costs one partial row per task;
3. a second, much smaller shuffle counts values per distinct bitmask
   ("signature");
4. each signature expands to its member columns and emits ordered column
   pairs of different tables, weighted by its value count — pairs of
   *columns*, bounded by the schema, never pairs of rows;
0. before that, one pass of statistics rules out columns that cannot be on
   either side of a relationship (``viable_columns``);
5. distinct counts per column fall out of the same signature table; row
   counts per table are plain counts.

This is the inclusion-dependency scheme of distributed IND discovery
(SINDY, Kruse et al.), with the uniqueness and overlap thresholds applied
on the small pair table.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import percent_text
from strata.session import materialize, release

ELIGIBLE_TYPES = (
    T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
    T.BooleanType, T.DateType,
)
WORD_BITS = 64
WORD_SHIFT = WORD_BITS.bit_length() - 1
# Values longer than this travel as a 65-character digest ("\x01" + sha-256 hex);
# plain values are at most this long, so the two forms never collide.
PLAIN_VALUE_CHARS = 64
SAMPLE = 16    # one in so many values, by hash, is looked at before the exact shuffle
DOUBT = 1e-12  # chance to rule out a relationship that there is
PRUNE_BYTES = 64 << 30

RELATIONSHIP_COLUMNS = [
    "parent_table", "parent_col", "child_table", "child_col",
    "confidence", "reason", "sample_overlap",
]


def eligible_columns(df: DataFrame) -> list[str]:
    """Columns whose values can act as keys: strings, integers, booleans,
    dates (C17). Floats, decimals, timestamps and nested types are excluded."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, ELIGIBLE_TYPES)]


def value_text(c: Column, is_string: bool = True) -> Column:
    """Value as text (I9); long texts as a digest of the whole text.

    Integers, booleans and dates are never longer than the plain limit, so
    only string columns pay for the length check.
    """
    s = c.cast("string")
    if not is_string:
        return s
    return F.when(F.length(s) > PLAIN_VALUE_CHARS, F.concat(F.lit("\u0001"), F.sha2(s, 256))).otherwise(s)


def catalog_rows(tables: Mapping[str, DataFrame]) -> list[tuple[int, int, str, str]]:
    """(idx, tid, table, column) for every eligible column — schema metadata only."""
    rows, idx = [], 0
    for tid, (t, df) in enumerate(tables.items()):
        for c in eligible_columns(df):
            rows.append((idx, tid, t, c))
            idx += 1
    return rows


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    return spark.createDataFrame(catalog_rows(tables), "idx int, tid int, table_name string, column_name string")


def column_values(tables: Mapping[str, DataFrame], keep: Collection[int] | None = None,
                  text: Callable[[Column, bool], Column] = value_text) -> DataFrame:
    """Unpivot every eligible column, or those of ``keep``, to ``(idx, v)``,
    NULLs dropped (C18). ``text`` makes the value of a column.

    ``unpivot`` plans as an ``Expand``, which stays inside whole-stage codegen.
    """
    parts, idx = [], 0
    for _, df in tables.items():
        cols = eligible_columns(df)
        types = {f.name: f.dataType for f in df.schema.fields}
        values = [
            text(F.col(c), isinstance(types[c], T.StringType)).alias(str(idx + k))
            for k, c in enumerate(cols) if keep is None or idx + k in keep
        ]
        idx += len(cols)
        if values:
            parts.append(df.unpivot([], values, "name", "v"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], "idx int, v string")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where(F.col("v").isNotNull()).select(F.col("name").cast("int").alias("idx"), "v")


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(idx, n_rows, n, low, high, short, long, least, most) per eligible
    column, one ungrouped aggregate per table: rows, values, bounds of the
    values' text (of its first ``PLAIN_VALUE_CHARS`` characters) and of its
    length, and the numeric range of integer columns."""
    parts, idx = [], 0
    for _, df in tables.items():
        types = {f.name: f.dataType for f in df.schema.fields}
        aggs, rows = [F.count(F.lit(1)).alias("n_rows")], []
        for c in eligible_columns(df):
            col, whole, none = F.col(f"`{c}`"), isinstance(types[c], INTEGERS), F.lit(None).cast("long")
            text = col.cast("string")
            least, most = (F.min(col).cast("long"), F.max(col).cast("long")) if whole else (none, none)
            if whole:  # texts of a numeric range: any digits, the longest of the two ends
                low, high = F.when(least < 0, "-").otherwise("0"), F.lit("9" * 20)
                short, long = F.lit(1), F.greatest(F.length(least.cast("string")), F.length(most.cast("string")))
            else:
                low, high = F.min(F.substring(text, 1, PLAIN_VALUE_CHARS)), F.max(F.substring(text, 1, PLAIN_VALUE_CHARS))
                short, long = F.min(F.length(text)), F.max(F.length(text))
            values = {"n": F.count(col), "low": low, "high": high, "short": short, "long": long, "least": least, "most": most}
            aggs += [v.alias(f"{name}_{idx}") for name, v in values.items()]
            rows.append(F.struct(F.lit(idx).alias("idx"), *[F.col(f"{name}_{idx}").alias(name) for name in values]))
            idx += 1
        if rows:
            parts.append(df.agg(*aggs).select("n_rows", F.inline(F.array(*rows))))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def sampled_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(idx, v) of the values whose hash falls into one of ``SAMPLE`` parts: the
    same values in every column that holds them."""
    plain = column_values(tables, text=lambda c, is_string: c.cast("string"))
    return plain.where(F.pmod(F.xxhash64("v"), F.lit(SAMPLE)) == 0).select("idx", value_text(F.col("v")).alias("v"))


def planned_bytes(tables: Mapping[str, DataFrame]) -> int:
    """Size of the tables by the optimizer's estimate."""
    return sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables.values())


def _unlikely(seen: np.ndarray, of: np.ndarray, share: float) -> np.ndarray:
    """Whether ``seen`` hits among ``of`` draws rule out a true share of at
    least ``share`` (Chernoff-Hoeffding, also for draws without replacement)."""
    q = seen / np.maximum(of, 1)
    p = min(max(share, 1e-12), 1 - 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(q > 0, q * np.log(q / p), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - p)), 0)
    return (q < p) & (of * kl > -np.log(DOUBT))


def viable_columns(tables: Mapping[str, DataFrame], min_overlap: float, min_uniqueness: float) -> set[int]:
    """Columns that can still be on a side of a relationship (D5, E8), from
    ``column_statistics`` and ``sampled_values``:

    * a parent's values are at least ``min_uniqueness`` of its rows: its count of
      values and its sampled distinct values must not rule that out;
    * ranges of a child and a parent (by text, by length, by number) must meet;
    * the sampled values that a child and a parent share must not rule out
      ``min_overlap``.

    Counts and ranges rule out with certainty; the sample does so only where the
    chance to see it with a true relationship is below ``DOUBT``. What comes to
    the driver is bounded by the schema: a row per column, and one per pair of
    columns that share a sampled value.
    """
    cat = catalog_rows(tables)
    k = len(cat)
    tid = np.array([r[1] for r in cat])
    stats = {r.idx: r for r in column_statistics(tables).collect()}
    of = lambda name, missing: np.array([missing if (v := stats[i][name]) is None else v for i in range(k)])
    n_rows, count, short, long = (of(name, 0).astype(float) for name in ("n_rows", "n", "short", "long"))
    least, most = of("least", 0), of("most", 0)
    whole = np.array([stats[i].least is not None for i in range(k)])
    sigs = materialize(signatures(sampled_values(tables), k), "sampled-signatures")
    distinct, shared = np.zeros(k), np.zeros((k, k))
    for r in sigs.select(F.explode("sig").alias("idx"), "n").groupBy("idx").agg(F.sum("n").alias("n")).collect():
        distinct[r.idx] = r.n
    for r in pair_overlaps(sigs, tid.tolist()).collect():
        shared[r.child, r.parent] = r.overlap
    release(sigs)
    # few distinct values for so many rows: a sampled share of 1 / SAMPLE would have shown more
    expected = min_uniqueness * n_rows / SAMPLE
    poor = (distinct < expected) & ((expected - distinct) ** 2 / (2 * np.maximum(expected, 1)) > -np.log(DOUBT))
    parent = (count >= min_uniqueness * n_rows) & (count > 0) & ~poor
    # bounds as ranks in byte order, as Spark compares texts
    low, high = ([(stats[i][name] or "").encode() for i in range(k)] for name in ("low", "high"))
    rank = {v: i for i, v in enumerate(sorted({*low, *high}))}
    first, last = (np.array([rank[v] for v in x]) for x in (low, high))
    keep: set[int] = set()
    for p in np.flatnonzero(parent):
        child = (tid != tid[p]) & (count > 0)
        if min_overlap > 0:
            child &= (first <= last[p]) & (last >= first[p]) & (short <= long[p]) & (long >= short[p])
            if whole[p]:
                child &= ~whole | ((least <= most[p]) & (most >= least[p]))
            child &= ~_unlikely(shared[:, p], distinct, min_overlap)
        if child.any():
            keep.update([int(p), *np.flatnonzero(child).tolist()])
    return keep


def table_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count per table, NULL rows included (E9 denominator)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(tid).alias("tid"), "n_rows")
        for tid, (_, df) in enumerate(tables.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def signatures(values: DataFrame, n_cols: int) -> DataFrame:
    """(sig array<int>, n long): how many distinct values are held by exactly
    that set of columns. ``n_cols`` is the number of eligible columns."""
    words = max(1, -(-n_cols // WORD_BITS))
    one = F.lit(1).cast("long")
    masks = [
        F.coalesce(F.bit_or(F.when(F.shiftright("idx", WORD_SHIFT) == w,
                                   F.call_function("shiftleft", one, F.col("idx").bitwiseAND(F.lit(WORD_BITS - 1))))), F.lit(0).cast("long")
                   ).alias(f"w{w}")
        for w in range(words)
    ]
    wcols = [f"w{w}" for w in range(words)]
    counted = values.groupBy("v").agg(*masks).groupBy(*wcols).agg(F.count(F.lit(1)).alias("n"))
    word_arr = F.array(*[F.col(c) for c in wcols])
    members = F.filter(
        F.sequence(F.lit(0), F.lit(max(n_cols - 1, 0))),
        lambda i: F.call_function(
            "shiftrightunsigned",
            F.element_at(word_arr, (F.floor(i / WORD_BITS) + 1).cast("int")), (i % WORD_BITS).cast("int"),
        ).bitwiseAND(F.lit(1)) == 1,
    )
    return counted.select(members.alias("sig"), "n")


def column_profile(spark: SparkSession, tables: Mapping[str, DataFrame],
                   sigs: DataFrame | None = None) -> DataFrame:
    """Per eligible column: distinct non-null values, table rows, uniqueness."""
    cat = catalog_rows(tables)
    # written first: else the filter that comes with explode is pushed below the
    # second aggregate and evaluated for every distinct value
    sigs = sigs if sigs is not None else materialize(signatures(column_values(tables), len(cat)), "signatures")
    catalog = column_catalog(spark, tables)
    distinct = (
        sigs.select(F.explode("sig").alias("idx"), "n")
        .groupBy("idx").agg(F.sum("n").alias("n_distinct"))
    )
    rows = table_rows(tables)
    # catalog and row counts are bounded by the schema (columns, tables)
    return (
        catalog.join(distinct, "idx", "left")
        .join(F.broadcast(rows), "tid")
        .select(
            "idx", "tid", "table_name", "column_name",
            F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
            F.col("n_rows").cast("long").alias("n_rows"),
            F.try_divide(F.coalesce("n_distinct", F.lit(0)), F.col("n_rows")).alias("uniqueness"),  # null in an empty table
        )
    )


def column_profile_approx(spark: SparkSession, tables: Mapping[str, DataFrame],
                          rsd: float = 0.02) -> DataFrame:
    """Approximate profile (E8 option): ``approx_count_distinct`` (HyperLogLog,
    relative error ``rsd``) per eligible column, one aggregate pass per table
    and no value shuffle — a cheap first look before the exact discovery."""
    parts = []
    for t, df in tables.items():
        cols = eligible_columns(df)
        if not cols:
            continue
        agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                     *[F.approx_count_distinct(F.col(c), rsd).alias(f"d{k}") for k, c in enumerate(cols)])
        stacked = agg.select("n_rows", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(f"d{k}").alias("n_distinct"))
            for k, c in enumerate(cols)
        ])).alias("x"))
        parts.append(stacked.select(F.lit(t).alias("table_name"), "x.column_name",
                                    F.col("x.n_distinct").cast("long").alias("n_distinct"),
                                    F.col("n_rows").cast("long").alias("n_rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("uniqueness", F.least(F.lit(1.0), F.try_divide("n_distinct", "n_rows")))


def pair_overlaps(sigs: DataFrame, table_of: list[int], parents: list[int] | None = None) -> DataFrame:
    """(child idx, parent idx, overlap) for column pairs of different tables.

    ``table_of[idx]`` is the table index of each column (schema metadata).
    ``parents`` limits the parent side to these columns before any pair is
    made, so a signature of k columns gives k times its parents, not k * k.
    """
    tables = F.array(*[F.lit(t) for t in table_of])
    tab = lambda c: F.element_at(tables, F.col(c) + 1)
    multi = sigs.where(F.size("sig") > 1).withColumn("up", F.col("sig"))
    if parents is not None:
        multi = multi.withColumn("up", F.array_intersect("sig", F.array(*[F.lit(p) for p in parents]).cast("array<int>")))
    return (
        multi.where(F.size("up") > 0).select(F.explode("sig").alias("child"), "up", "n")
        .select("child", F.explode("up").alias("parent"), "n")
        .where(tab("child") != tab("parent"))
        .groupBy("child", "parent").agg(F.sum("n").alias("overlap"))
    )


def name_match(child_col: Column, parent_col: Column) -> Column:
    """1 when two column names agree — equal, or equal after a ``<prefix>_``
    table prefix (``o_custkey`` / ``c_custkey``) — else 0."""
    strip = lambda c: F.regexp_replace(c, r"^[^_]+_", "")
    return F.when((child_col == parent_col) | (strip(child_col) == strip(parent_col)), 1).otherwise(0)


def infer_relationships(spark: SparkSession, tables: Mapping[str, DataFrame],
                        min_overlap: float = 0.8, min_uniqueness: float = 0.9,
                        name_hint: bool = False, prune: bool | None = None) -> DataFrame:
    """Candidate foreign keys child.col -> parent.col with confidence.

    overlap_ratio = |child values in parent| / |child values|;
    uniqueness = |parent values| / parent rows; both thresholds inclusive;
    confidence = overlap_ratio * uniqueness. Sorted by confidence, ties by
    child table, child column, parent table, parent column. ``name_hint``
    adds a ``name_match`` column and ranks agreeing names first among equal
    confidences; it never removes a candidate. ``prune`` looks for columns to
    leave out of the value shuffle first (``viable_columns``), which reads the
    tables once more; by default, where they are planned to hold ``PRUNE_BYTES``.
    """
    cat = catalog_rows(tables)
    # columns that statistics rule out never reach the exact value shuffle
    if prune is None:
        prune = planned_bytes(tables) >= PRUNE_BYTES
    keep = viable_columns(tables, min_overlap, min_uniqueness) if prune else None
    # the signature table is small (one row per distinct column set) and is
    # read twice below: materialize it once, reliably, in the checkpoint dir
    sigs = materialize(signatures(column_values(tables, keep), len(cat)), "signatures")
    prof = column_profile(spark, tables, sigs)
    # one row per column: only those unique enough can be parents
    unique = [r.idx for r in prof.where(F.col("uniqueness") >= min_uniqueness).select("idx").collect()]
    child = prof.select(
        F.col("idx").alias("child"), F.col("table_name").alias("child_table"),
        F.col("column_name").alias("child_col"), F.col("n_distinct").alias("child_distinct"),
    )
    parent = prof.select(
        F.col("idx").alias("parent"), F.col("table_name").alias("parent_table"),
        F.col("column_name").alias("parent_col"), F.col("uniqueness"),
    )
    scored = (
        pair_overlaps(sigs, [r[1] for r in cat], unique)
        .join(F.broadcast(child), "child")
        .join(F.broadcast(parent), "parent")
        .withColumn("overlap_ratio", F.col("overlap") / F.col("child_distinct"))
        .where((F.col("overlap_ratio") >= min_overlap) & (F.col("uniqueness") >= min_uniqueness))
        .withColumn("confidence", F.col("overlap_ratio") * F.col("uniqueness"))
    )
    out = scored.select(
        "parent_table", "parent_col", "child_table", "child_col", "confidence",
        F.concat(
            percent_text(F.col("overlap_ratio"), 1), F.lit(" values exist in parent, "),
            percent_text(F.col("uniqueness"), 1), F.lit(" unique"),
        ).alias("reason"),
        F.col("overlap").cast("long").alias("sample_overlap"),
        "overlap_ratio", "uniqueness",
    )
    if name_hint:
        out = out.withColumn("name_match", name_match(F.col("child_col"), F.col("parent_col")))
        return out.orderBy(F.col("confidence").desc(), F.col("name_match").desc(), *relationship_order()[1:])
    return out.orderBy(*relationship_order())


def relationship_order() -> list[Column]:
    return [
        F.col("confidence").desc(), F.col("child_table"), F.col("child_col"),
        F.col("parent_table"), F.col("parent_col"),
    ]


def column_overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """Number of distinct non-null values (as text) two columns share."""
    left = a.select(F.col(a_col).cast("string").alias("v")).where(F.col("v").isNotNull())
    right = b.select(F.col(b_col).cast("string").alias("v")).where(F.col("v").isNotNull())
    return left.intersect(right).agg(F.count(F.lit(1)).alias("overlap"))


def best_per_pair(rel: DataFrame, min_confidence: float | None = None) -> DataFrame:
    """First relationship per (parent_table, child_table) in score order (F2).

    The relationship table is bounded by (eligible columns)^2, so a window
    over it is cheap.
    """
    if min_confidence is not None:
        rel = rel.where(F.col("confidence") >= min_confidence)
    w = Window.partitionBy("parent_table", "child_table").orderBy(*relationship_order())
    return rel.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def er_edges(rel: DataFrame, threshold: float = 0.75) -> DataFrame:
    """ER diagram edges: confidence >= threshold, best per table pair.

    ``cardinality`` is zero-or-more above 0.9 and one-or-more otherwise;
    ``edge`` is the diagram line.
    """
    best = best_per_pair(rel, threshold)
    card = F.when(F.col("confidence") > 0.9, F.lit("||--o{")).otherwise(F.lit("||--|{"))
    label = F.concat(
        F.col("parent_col"), F.lit(" → "), F.col("child_col"),
        F.lit(" ["), percent_text(F.col("confidence"), 0), F.lit("]"),
    )
    return best.select(
        "parent_table", "child_table", "parent_col", "child_col", "confidence",
        card.alias("cardinality"), label.alias("label"),
        F.concat_ws(" ", F.col("parent_table"), card, F.col("child_table"), F.lit(":"),
                    F.concat(F.lit('"'), label, F.lit('"'))).alias("edge"),
    )


def er_diagram_lines(edges: DataFrame) -> DataFrame:
    """Diagram text lines: header, one entity line per table, one per edge."""
    entities = (
        edges.select(F.col("parent_table").alias("t"))
        .union(edges.select(F.col("child_table").alias("t"))).distinct()
        .select(F.lit(1).alias("section"), F.concat(F.lit("    "), F.col("t"), F.lit(" {}")).alias("line"))
    )
    lines = edges.select(F.lit(2).alias("section"), F.concat(F.lit("    "), F.col("edge")).alias("line"))
    head = edges.sparkSession.range(1).select(F.lit(0).alias("section"), F.lit("erDiagram").alias("line"))
    return head.union(entities).union(lines)


def fk_ddl(rel: DataFrame, min_confidence: float = 0.9, best_only: bool = False) -> DataFrame:
    """ALTER TABLE .. ADD CONSTRAINT statements for confidence > threshold.

    ``best_only`` keeps the first candidate per child column, so a constraint
    name is never emitted twice.
    """
    hi = rel.where(F.col("confidence") > min_confidence)
    if best_only:
        w = Window.partitionBy("child_table", "child_col").orderBy(*relationship_order())
        hi = hi.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    stmt = F.format_string(  # fixed text
        "ALTER TABLE %s ADD CONSTRAINT fk_%s_%s FOREIGN KEY (%s) REFERENCES %s(%s);",
        "child_table", "child_table", "child_col", "child_col", "parent_table", "parent_col",
    )
    return hi.select(
        "child_table", "child_col", "parent_table", "parent_col", "confidence",
        F.concat(F.lit("-- Confidence: "), percent_text(F.col("confidence"), 1)).alias("comment"),
        stmt.alias("statement"),
    )


def ddl_script_lines(ddl: DataFrame) -> DataFrame:
    """Script text: comment, statement and a blank line per constraint, in
    confidence order (export form of B13). A global sort, then an in-order
    explode: no single-partition window."""
    return ddl.orderBy(*relationship_order()).select(
        F.explode(F.array(F.col("comment"), F.col("statement"), F.lit(""))).alias("line")
    )


def export_relationships(rel: DataFrame, path: str) -> str:
    """Relationship table as CSV with a header."""
    rel.select(*RELATIONSHIP_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return path
