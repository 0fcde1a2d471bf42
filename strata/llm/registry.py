"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import text_sha
from strata.llm.compression_quality import quality_scores
from strata.llm.exact_dedup import exact_classes
from strata.llm.fill_middle import fill_in_middle, restored
from strata.llm.lexical_search import search
from strata.llm.line_dedup import clean_lines
from strata.llm.mixing import schedule
from strata.llm.near_dedup import near_classes
from strata.llm.packing import pack
from strata.llm.ppm import ppm_scores
from strata.llm.quality_rules import judge
from strata.llm.sharding import shard
from strata.llm.suffix_dedup import remove_repeats
from strata.llm.toxicity import toxicity
from strata.sources.files import load_table

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle.strip()
        return fn
    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


@query("op1_quality_rules")
def op1_quality_rules(spark, sf):
    return judge(documents(spark, sf), carry=["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "bits", "low", "high")


@query("op2_ppm")
def op2_ppm(spark, sf):
    return ppm_scores(documents(spark, sf))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf):
    return remove_repeats(documents(spark, sf), digest=True)


@query("op4_packing")
def op4_packing(spark, sf):
    return pack(documents(spark, sf), public_tokenizers.path(TOKENIZER))


@query("op5_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS pos
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source
), r AS (
  SELECT *, (2 * source_size)::DOUBLE / weight AS dry, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS budget, sum(weight) OVER () AS weights
  FROM s
), b AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS spent, coalesce(sum(weight) OVER w, 0)::DOUBLE AS gone
  FROM r WINDOW w AS (ORDER BY dry, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, dry <= (budget - spent) / (weights - gone) AS full_ FROM b
), t AS (
  SELECT source, source_size, weight,
         CASE WHEN full_ THEN (2 * source_size)::DOUBLE
              ELSE weight * ((budget - (sum(CASE WHEN full_ THEN 2 * source_size ELSE 0 END) OVER ())::DOUBLE)
                   / (weights - sum(CASE WHEN full_ THEN weight ELSE 0.0::DOUBLE END) OVER ())) END AS target
  FROM f
), c AS (
  SELECT doc_id, d.source, pos, size, source_size, target, weight,
         (sum(size) OVER (PARTITION BY d.source ORDER BY pos, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS begin_
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, (begin_ + turn * source_size + size)::DOUBLE / weight AS finish FROM c, (VALUES (0), (1)) v(turn) WHERE size > 0
), o AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, turn, pos, size ROWS UNBOUNDED PRECEDING) AS upto FROM e
), k AS (
  SELECT doc_id, sum(greatest(0, least(size, (SELECT floor(1.5 * sum(size)) FROM d) - (upto - size))))::BIGINT AS taken FROM o GROUP BY doc_id
)
SELECT c.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN k ON c.doc_id = k.doc_id
""")
def op5_mixing(spark, sf):
    return schedule(documents(spark, sf)).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
""")
def op6_exact_dedup(spark, sf):
    return exact_classes(documents(spark, sf))


@query("op7_compression_quality")
def op7_compression_quality(spark, sf):
    return quality_scores(documents(spark, sf), load_table(spark, sf, "labels"))


@query("op8_line_dedup", r"""
WITH d AS (
  SELECT doc_id, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d
), t AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM l
), b AS (
  SELECT t FROM t WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= 8
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(b.t) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (b.t IS NULL) AS kept
  FROM t LEFT JOIN b ON t.t = b.t GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def op8_line_dedup(spark, sf):
    return clean_lines(documents(spark, sf)).select("doc_id", "n_lines", "n_removed", text_sha(F.col("text")).alias("kept_sha256"))


@query("op9_near_dedup")
def op9_near_dedup(spark, sf):
    return near_classes(documents(spark, sf)).select("doc_id", "class_id", "class_size", "kept")


@query("op10_toxicity")
def op10_toxicity(spark, sf):
    return toxicity(documents(spark, sf), load_table(spark, sf, "labels")).select(
        "doc_id", "held_out", "score", "predicted", "p_value", F.size("segments").alias("n_segments"))


@query("op11_fill_middle", r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), c AS (
  SELECT *, least(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS a,
         greatest(('0x' || h[1:8])::BIGINT % (n + 1), ('0x' || h[9:16])::BIGINT % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n) AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
""")
def op11_fill_middle(spark, sf):
    return fill_in_middle(documents(spark, sf)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", text_sha(F.col("output")).alias("output_sha256"),
        text_sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


@query("op12_lexical_search", r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), s AS (
  SELECT count(*) FILTER (len(terms) > 0)::BIGINT AS docs, coalesce(sum(len(terms)), 0)::BIGINT AS total FROM d
), i AS (
  SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), x AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM x, s GROUP BY term, docs
), m AS (
  SELECT r, doc_id, (25 + (75 * len(terms)::BIGINT * docs) // greatest(total, 1))::BIGINT AS m FROM d, s
), v AS (
  SELECT q, item_id, x.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN x ON i.term = x.term JOIN w ON w.term = x.term JOIN m ON m.r = x.r GROUP BY q, item_id, x.r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM v WHERE score > 0
QUALIFY rank <= 10
""")
def op12_lexical_search(spark, sf):
    return search(documents(spark, sf), load_table(spark, sf, "benchmark"))


@query("op13_sharding")
def op13_sharding(spark, sf):
    return shard(documents(spark, sf)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
