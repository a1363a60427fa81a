"""Transcripts, boundaries and windows derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import scan
from newsloom.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one, of fewer partitions than there are cores, is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def _run(keep: int, mul: int, step: int, width: int, extra_mul: int, extra_add: int, every: int) -> Column:
    """A disturbed copy of the gold breaks: some dropped, the rest shifted, one added to every few documents."""
    d, n = F.col("doc_id"), F.col("n")
    kept = F.filter("breaks", lambda b: (d + b) % keep != 0)
    moved = F.transform(kept, lambda b: b + ((d * mul + b * step) % width) - width // 2)
    extra = F.when(d % every == 0, F.array((d * extra_mul + extra_add) % n)).otherwise(F.array().cast("array<bigint>"))
    return F.array_sort(F.array_distinct(F.filter(F.filter(F.concat(moved, extra), lambda p: p > 0), lambda p: p < n)))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, doc_id, body, outlet, show, n (words), breaks (gold: words at line starts), run_a, run_b."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    base = docs.select(F.col("doc_id").cast("string").alias("record_id"), "doc_id", F.col("text").alias("body"), F.col("source").alias("outlet"), F.col("lang").alias("show"))
    base = T.pin(base.withColumn("_scan", scan.line_starts(F.col("body"))), n=F.col("_scan.n"), breaks=F.col("_scan.breaks")).drop("_scan")
    return T.pin(base, run_a=_run(7, 31, 17, 61, 97, 13, 5), run_b=_run(11, 13, 7, 41, 53, 29, 4))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 200 words every 100, with a made-up p_break and the breaks of run_a inside."""
    t = transcripts(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / 100))))
    start = F.col("k") * 100
    return t.select("record_id", (F.col("k") * 100).alias("word_start"), (((F.col("doc_id") * 7 + F.col("k") * 137) % 1000) / 1000.0).cast("double").alias("p_break"), (((F.col("doc_id") * 3 + F.col("k") * 211) % 1000) / 1000.0).cast("double").alias("p_none"), F.filter("run_a", lambda b: (b >= start) & (b < start + 200)).alias("breaks"))


def _run_sql(keep: int, mul: int, step: int, width: int, extra_mul: int, extra_add: int, every: int) -> str:
    return (
        f"list_sort(list_distinct(list_filter(list_concat(list_transform(list_filter(breaks, lambda b: (doc_id + b) % {keep} <> 0), lambda b: b + ((doc_id * {mul} + b * {step}) % {width}) - {width // 2}), "
        f"CASE WHEN doc_id % {every} = 0 THEN [(doc_id * {extra_mul} + {extra_add}) % n] ELSE CAST([] AS BIGINT[]) END), lambda p: p > 0 AND p < n)))"
    )


#: CTEs t (transcripts) and w (scored windows); a query follows them.
WORDS = f"[^{T.WS}]+"
BASE = f"""
t0 AS (
  SELECT CAST(doc_id AS VARCHAR) AS record_id, doc_id, text AS body, source AS outlet, lang AS show,
         regexp_extract(text, '^[{T.WS}]*') AS lead, regexp_extract_all(text, '{WORDS}[{T.WS}]*') AS pieces
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), t1 AS (
  SELECT *, CAST(len(pieces) AS BIGINT) AS n, list_filter(CAST(range(1, len(pieces)) AS BIGINT[]), lambda i: contains(pieces[i], chr(10))) AS breaks FROM t0
), t AS (
  SELECT *, {_run_sql(7, 31, 17, 61, 97, 13, 5)} AS run_a, {_run_sql(11, 13, 7, 41, 53, 29, 4)} AS run_b FROM t1
), w AS (
  SELECT record_id, doc_id, k * 100 AS word_start, ((doc_id * 7 + k * 137) % 1000) / 1000.0::DOUBLE AS p_break, ((doc_id * 3 + k * 211) % 1000) / 1000.0::DOUBLE AS p_none,
         list_filter(run_a, lambda b: b >= k * 100 AND b < k * 100 + 200) AS breaks
  FROM (SELECT *, unnest(range(0, greatest(n - 1, 0) // 100 + 1)) AS k FROM t)
)"""


def matched(gold: str, pred: str, tolerance: str, source: str = "t", keys: str = "record_id") -> str:
    """CTEs st and used: the greedy matching of two list columns, one row per key with the indices used."""
    k = keys.split(", ")
    same = " AND ".join(f"s.{x} = c.{x}" for x in k)
    own = ", ".join(f"s.{x}" for x in k)
    return f"""
cand AS (
  SELECT {keys}, gi, pi, row_number() OVER (PARTITION BY {keys} ORDER BY abs(g - p), gi, pi) AS rk FROM (
    SELECT {keys}, gi, pi, {gold}[gi] AS g, {pred}[pi] AS p, tol FROM (
      SELECT {keys}, {gold}, {pred}, {tolerance} AS tol, gi, unnest(range(1, len({pred}) + 1)) AS pi FROM (
        SELECT *, unnest(range(1, len({gold}) + 1)) AS gi FROM {source}))) WHERE abs(g - p) <= tol
), st AS (
  SELECT {keys}, CAST([] AS BIGINT[]) AS ug, CAST([] AS BIGINT[]) AS up, CAST(0 AS BIGINT) AS rk FROM {source}
  UNION ALL
  SELECT {keys}, ug, up, rk FROM (
    SELECT {own}, list_append(s.ug, c.gi) AS ug, list_append(s.up, c.pi) AS up, c.rk AS rk, row_number() OVER (PARTITION BY {own} ORDER BY c.rk) AS nth
    FROM st s JOIN cand c ON {same} AND c.rk > s.rk AND NOT list_contains(s.ug, c.gi) AND NOT list_contains(s.up, c.pi)) WHERE nth = 1
), used AS (
  SELECT {keys}, arg_max(ug, len(ug)) AS ug, arg_max(up, len(up)) AS up FROM st GROUP BY {keys}
)"""


RATES = "CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall"


def rates(counts: str, keys: str) -> str:
    """A query giving counts and rates, rounded, of a query with tp, fn, fp."""
    lead = f"{keys}, " if keys else ""
    return f"""
SELECT {lead}tp, fn, fp, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1
FROM (SELECT *, {RATES} FROM ({counts}))"""
