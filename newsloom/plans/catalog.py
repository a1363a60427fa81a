"""Registered queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import anchors as A
from newsloom.functions import scoring as S
from newsloom.functions import text as T
from newsloom.operators import accounting, metrics, postprocess, reconcile, segments, training, validation, windows
from newsloom.plans.inputs import BASE, matched, rates, scored_windows, table, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).withColumn("word_count", F.col("n"))


# --- segments and merging ---------------------------------------------------

_SEGMENTS = f"""
WITH {BASE}, e AS (
  SELECT *, list_concat([CAST(0 AS BIGINT)], breaks) AS a, list_concat(breaks, [n]) AS b FROM t
), s AS (
  SELECT record_id, lead, pieces, len(breaks) AS n_cuts, i - 1 AS index, a[i] AS word_start, b[i] AS word_end,
         CASE WHEN i = 1 THEN lead ELSE '' END || array_to_string(list_slice(pieces, a[i] + 1, b[i]), '') AS text
  FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM e)
), o AS (
  SELECT record_id, n_cuts, index, word_start, word_end, text, CAST(sum(length(text)) OVER (PARTITION BY record_id ORDER BY index) AS BIGINT) AS char_end FROM s
)"""
_SEGMENT_COLUMNS = "record_id || '#' || lpad(CAST(index AS VARCHAR), CAST(greatest(3, length(CAST(index AS VARCHAR))) AS INTEGER), '0') AS segment_id, record_id, index, word_start, word_end, char_end - length(text) AS char_start, char_end, word_end - word_start AS n_words, n_cuts"
_FLAG = "CASE WHEN word_end = word_start THEN 'empty' WHEN word_end - word_start < 8 THEN 'short' ELSE '' END"


@query(f"{_SEGMENTS} SELECT {_SEGMENT_COLUMNS}, text, {_FLAG} AS flags FROM o")
def segments_rows(spark, sf_dir):
    """Every document cut at its line starts."""
    out = segments.to_segments(transcripts(spark, sf_dir), min_words=8)
    return out.withColumn("flags", F.array_join("flags", ","))


@query(f"{_SEGMENTS} SELECT {_SEGMENT_COLUMNS} FROM o")
def segments_offsets(spark, sf_dir):
    """As segments_rows, without texts and flags."""
    return segments.to_segments(transcripts(spark, sf_dir), include_text=False).drop("flags")


@query(f"{_SEGMENTS} SELECT record_id, segment_id, text, n_cuts FROM (SELECT {_SEGMENT_COLUMNS}, text FROM o)")
def segments_minimal(spark, sf_dir):
    return segments.minimal(segments.to_segments(transcripts(spark, sf_dir)))


@query(f"WITH {BASE} SELECT record_id, body, n AS word_count, true AS same FROM t")
def merge_roundtrip(spark, sf_dir):
    """Cut at line starts, merged again and compared with the text."""
    docs = transcripts(spark, sf_dir)
    merged = segments.merge_strict(segments.to_segments(docs))
    return merged.join(docs.select("record_id", F.col("body").alias("_was")), "record_id").select("record_id", "body", "word_count", (F.col("body") == F.col("_was")).alias("same"))


@query(f"""SELECT record_id, body, CAST(len(regexp_extract_all(body, '[^{T.WS}]+')) AS BIGINT) AS word_count, CAST(NULL AS VARCHAR) AS error
FROM (SELECT CAST(conv_id AS VARCHAR) AS record_id, string_agg(text, '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id)""")
def merge_conversations(spark, sf_dir):
    """Turns as segments, merged to conversations; offsets by a window over the turn lengths."""
    from pyspark.sql import Window

    order = Window.partitionBy("record_id").orderBy("index")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("record_id"), F.col("turn").alias("index"), "text")
    rows = turns.withColumn("char_end", F.sum(F.length("text")).over(order)).withColumn("char_start", F.col("char_end") - F.length("text"))
    rows = rows.withColumns({"word_start": F.lit(0), "word_end": T.word_count(F.col("text"))})
    return segments.merge_segments(rows).select("record_id", "body", "word_count", "error")


@query(f"""{_SEGMENTS}, f AS (SELECT record_id, {_FLAG} <> '' AS flagged FROM o),
r AS (SELECT record_id, count(*) FILTER (WHERE NOT flagged) AS kept, count(*) FILTER (WHERE flagged) AS dropped FROM f GROUP BY record_id)
SELECT CAST(sum(kept) AS BIGINT) AS n_kept, CAST(sum(dropped) AS BIGINT) AS n_dropped, count(*) FILTER (WHERE kept = 0) AS n_vanished FROM r""")
def drop_flagged_accounting(spark, sf_dir):
    """Segments kept and dropped by flag, and records that lost all of theirs."""
    rows = segments.to_segments(transcripts(spark, sf_dir), min_words=8, include_text=False)
    return segments.drop_counts(rows)


@query(f"""{_SEGMENTS} SELECT record_id, CAST(count(*) AS BIGINT) AS n_segments, CAST(sum(word_end - word_start) AS BIGINT) AS n_words FROM o GROUP BY record_id""")
def group_by_record(spark, sf_dir):
    rows = segments.to_segments(transcripts(spark, sf_dir), include_text=False)
    grouped = segments.group_by_record(rows, ("index", "n_words"))
    return grouped.select("record_id", F.size("segments").cast("bigint").alias("n_segments"), F.aggregate("segments", F.lit(0).cast("bigint"), lambda s, x: s + x["n_words"]).alias("n_words"))


@query(f"""WITH {BASE}, x AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '0' WHEN 1 THEN CAST(n AS VARCHAR) WHEN 2 THEN '-1,' || (n + 5) END AS bad FROM t)
SELECT CASE WHEN doc_id % 13 = 0 THEN 'a#' ELSE '' END || record_id AS record_id, CASE WHEN doc_id % 13 = 0 THEN 'record_id holds ' || chr(39) || '#' || chr(39) WHEN doc_id % 11 = 0 THEN 'no usable breaks' ELSE 'boundaries outside (0, ' || n || '): [' || bad || ']' END AS error
FROM x WHERE doc_id % 13 = 0 OR doc_id % 11 = 0 OR bad IS NOT NULL""")
def segment_bad_breaks(spark, sf_dir):
    """Records that can't be cut, among sound ones, and why."""
    long = lambda *x: F.array(*x).cast("array<bigint>")
    turn = F.col("doc_id") % 4
    bad = F.when(turn == 0, long(F.lit(0))).when(turn == 1, long(F.col("n"))).when(turn == 2, long(F.lit(-1), F.col("n") + 5)).otherwise(long())
    docs = transcripts(spark, sf_dir).withColumn("breaks", F.when(F.col("doc_id") % 11 != 0, F.concat("breaks", bad)))
    return segments.segment_errors(docs.withColumn("record_id", F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("a#"), "record_id")).otherwise(F.col("record_id"))))


@query(f"""WITH {BASE} SELECT record_id,
  CASE WHEN doc_id % 17 = 0 THEN 'no transcript' WHEN doc_id % 19 = 0 THEN 'it was predicted for ' || (n + 1) || ' words of different text, the transcript has ' || n
       WHEN doc_id % 23 = 0 THEN 'transcript has no usable body' WHEN doc_id % 29 = 0 THEN 'boundaries outside (0, ' || n || '): [0]' END AS problem,
  doc_id % 17 = 0 OR doc_id % 19 = 0 AS fatal
FROM t WHERE doc_id % 23 <> 0 OR doc_id % 19 <> 0""")
def segments_guards(spark, sf_dir):
    """Predictions joined to their transcripts, with planted faults: fatal ones, and ones that lose a record."""
    t = transcripts(spark, sf_dir).where("doc_id % 23 <> 0 or doc_id % 19 <> 0")
    d = F.col("doc_id")
    theirs = t.where("doc_id % 17 <> 0").select("record_id", F.when(d % 23 != 0, F.col("body")).alias("body"), F.lit(1).alias("ordinal"))
    older = theirs.withColumns({"body": F.lit("not the last one"), "ordinal": F.lit(0)})
    pred = t.select("record_id", F.when(d % 29 == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("run_a")).alias("pred_breaks"), (F.col("n") + F.when(d % 19 == 0, 1).otherwise(0)).alias("word_count"))
    return accounting.cuts(older.union(theirs), pred).select("record_id", "problem", "fatal")


@query(f"""{_SEGMENTS}, r AS (
  SELECT record_id, index, word_end, {_FLAG} = '' AS keep FROM o WHERE CAST(record_id AS BIGINT) % 5 <> 0 OR index <> 1
), g AS (SELECT record_id, count(*) FILTER (WHERE keep) AS kept, max(index) FILTER (WHERE keep) AS last, max(word_end) FILTER (WHERE keep) AS words FROM r GROUP BY record_id)
SELECT record_id, CASE WHEN kept = 0 THEN 'vanished' WHEN kept = last + 1 THEN 'rebuilt' ELSE 'failed' END AS outcome, CASE WHEN kept = last + 1 THEN words END AS word_count,
  CASE WHEN kept = 0 THEN 'every segment was dropped' WHEN kept <> last + 1 THEN 'segments are missing or duplicated' END AS error FROM g""")
def merge_accounting(spark, sf_dir):
    """What becomes of each record when some segments are missing and flagged ones are dropped."""
    rows = segments.to_segments(transcripts(spark, sf_dir), min_words=8)
    rows = rows.where((F.col("record_id").cast("bigint") % 5 != 0) | (F.col("index") != 1))
    return accounting.merged(rows, drop_flagged=True).select("record_id", "outcome", "word_count", "error")


@query(f"""WITH {BASE} SELECT record_id, CAST(c AS BIGINT) AS char_start, k - 1 AS word FROM (
  SELECT record_id, starts[k] AS c, k FROM (SELECT *, unnest(range(1, n + 2)) AS k FROM (
    SELECT record_id, n, list_transform(range(0, n + 1), lambda i: CASE WHEN n = 0 THEN length(body) ELSE length(lead) + length(array_to_string(list_slice(pieces, 1, i), '')) END) AS starts FROM t)))""")
def word_char_starts(spark, sf_dir):
    """The character at which each word begins, and the length at the end."""
    t = transcripts(spark, sf_dir)
    return t.select("record_id", F.posexplode(T.word_char_starts(F.col("body"))).alias("word", "char_start")).select("record_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("word").cast("bigint").alias("word"))


@query(f"""{_SEGMENTS} SELECT segment_id, regexp_extract(segment_id, '^(.+)#([0-9]+)$', 1) AS parent, CAST(regexp_extract(segment_id, '^(.+)#([0-9]+)$', 2) AS BIGINT) AS ordinal FROM (SELECT {_SEGMENT_COLUMNS} FROM o)""")
def parse_segment_ids(spark, sf_dir):
    rows = segments.to_segments(transcripts(spark, sf_dir), include_text=False)
    parsed = T.parse_segment_id(F.col("segment_id"))
    return rows.select("segment_id", parsed["record_id"].alias("parent"), parsed["index"].alias("ordinal"))


@query(f"{_SEGMENTS} SELECT record_id, index, regexp_replace(regexp_replace(text, '^[{T.WS}]+', ''), '[{T.WS}]+$', '') AS clean FROM o")
def clean_texts(spark, sf_dir):
    return segments.to_segments(transcripts(spark, sf_dir)).select("record_id", "index", T.strip(F.col("text")).alias("clean"))


# --- matching and scores ----------------------------------------------------


_A25 = matched("breaks", "run_a", "25")


@query(f"""WITH RECURSIVE {BASE}, {_A25}
SELECT record_id, t.breaks[ug[i]] AS gold, t.run_a[up[i]] AS pred, i - 1 AS ordinal
FROM (SELECT *, unnest(range(1, len(ug) + 1)) AS i FROM used) u JOIN t USING (record_id)""")
def match_pairs(spark, sf_dir):
    m = metrics.match_documents(transcripts(spark, sf_dir), 25, pred="run_a")
    return m.select("record_id", F.posexplode("match.pairs").alias("ordinal", "x")).select("record_id", "x.gold", "x.pred", F.col("ordinal").cast("bigint").alias("ordinal"))


@query(f"""WITH RECURSIVE {BASE}, {_A25}
SELECT record_id, CAST(len(ug) AS BIGINT) AS tp, CAST(len(breaks) - len(ug) AS BIGINT) AS fn, CAST(len(run_a) - len(up) AS BIGINT) AS fp,
  round(coalesce(list_avg(list_transform(range(1, len(ug) + 1), lambda i: abs(breaks[ug[i]] - run_a[up[i]]))), 0.0), 6) AS mean_offset
FROM used JOIN t USING (record_id)""")
def match_counts(spark, sf_dir):
    m = metrics.match_documents(transcripts(spark, sf_dir), 25, pred="run_a")
    return _rounded(m.select("record_id", "tp", "fn", "fp", S.mean_offset(F.col("match.pairs")).alias("mean_offset")), "mean_offset")


_TOLS = f"WITH RECURSIVE {BASE}, tt AS (SELECT *, unnest([25, 50, 100]) AS tolerance FROM t), {matched('breaks', 'run_a', 'tolerance', 'tt', 'record_id, tolerance')}"
_COUNTS = "CAST(sum(len(ug)) AS BIGINT) AS tp, CAST(sum(len(breaks) - len(ug)) AS BIGINT) AS fn, CAST(sum(len(pred) - len(up)) AS BIGINT) AS fp"


@query(f"{_TOLS}, sc AS ({rates('SELECT tolerance, ' + _COUNTS.replace('len(pred)', 'len(run_a)') + ' FROM used JOIN tt USING (record_id, tolerance) GROUP BY tolerance', 'tolerance')}) SELECT tolerance, tp, fn, fp, precision, recall, f1 FROM sc")
def score_tolerances(spark, sf_dir):
    """Pooled rates at 25, 50 and 100 words."""
    docs = transcripts(spark, sf_dir).withColumn("pred_breaks", F.col("run_a"))
    return _rounded(metrics.score_tolerances(docs).drop("f1_gain"), "precision", "recall", "f1")


@query(f"WITH RECURSIVE {BASE}, {_A25}, n AS (SELECT outlet, count(*) AS n_docs FROM t GROUP BY outlet), sc AS ({rates('SELECT outlet, ' + _COUNTS.replace('len(pred)', 'len(run_a)') + ' FROM used JOIN t USING (record_id) GROUP BY outlet', 'outlet')}) SELECT sc.*, n_docs FROM sc JOIN n USING (outlet)")
def score_by_outlet(spark, sf_dir):
    docs = transcripts(spark, sf_dir).withColumn("pred_breaks", F.col("run_a"))
    return _rounded(metrics.score_by(docs, "outlet"), "precision", "recall", "f1")


_PARTIAL = "p AS (SELECT t.*, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN run_a ELSE CAST([] AS BIGINT[]) END AS pred FROM t)"


@query(f"WITH RECURSIVE {BASE}, {_PARTIAL}, {matched('breaks', 'pred', '25', 'p')}, sc AS ({rates('SELECT ' + _COUNTS + ' FROM used JOIN p USING (record_id)', '')}) SELECT * FROM sc")
def score_missing_docs(spark, sf_dir):
    """Predictions for labelled documents only: the others' boundaries count as missed."""
    gold = transcripts(spark, sf_dir)
    pred = gold.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("record_id", F.col("run_a").alias("pred_breaks"))
    return _rounded(metrics.pool(metrics.match_documents(metrics.align(gold, pred))), "precision", "recall", "f1")


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)")
def absent_gold(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("record_id"))
    return metrics.absent_gold(transcripts(spark, sf_dir), labels).select("record_id")


@query("""SELECT CAST(id AS VARCHAR) AS record_id FROM (SELECT CASE WHEN doc_id % 2 = 1 THEN doc_id + 100000000 ELSE doc_id END AS id FROM labels) l
WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.id AND d.text IS NOT NULL)""")
def orphan_predictions(spark, sf_dir):
    """Predictions without gold, among ones with."""
    moved = F.col("doc_id") + F.when(F.col("doc_id") % 2 == 1, 100000000).otherwise(0)
    labels = table(spark, sf_dir, "labels").select(moved.cast("string").alias("record_id"))
    return metrics.orphans(transcripts(spark, sf_dir), labels).select("record_id")


@query(f"""WITH {BASE}, g AS (SELECT * FROM t WHERE doc_id % 3 <> 0), p AS (SELECT record_id, doc_id, n + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS words FROM t WHERE doc_id % 2 = 0)
SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM p) AS n_pred, count(p.record_id) AS n_shared, count(*) FILTER (WHERE p.record_id IS NULL) AS n_absent,
  CAST(coalesce(sum(len(breaks)) FILTER (WHERE p.record_id IS NULL), 0) AS BIGINT) AS at_stake, (SELECT count(*) FROM p WHERE doc_id % 3 = 0) AS n_orphans, count(*) FILTER (WHERE words <> n) AS n_drift
FROM g LEFT JOIN p USING (record_id)""")
def score_accounting(spark, sf_dir):
    """What a score leaves out: gold without prediction, predictions without gold, other texts."""
    g = _gold(spark, sf_dir)
    pred = g.where("doc_id % 2 = 0").select("record_id", (F.col("n") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("word_count"))
    return accounting.scored(g.where("doc_id % 3 <> 0"), pred)


@query(f"""WITH {BASE} SELECT record_id FROM t WHERE len(breaks) > 1 AND doc_id % 3 <> 0""")
def split_gold(spark, sf_dir):
    """The gold of the records that a split has rows of; rows repeat records, and some have no gold."""
    t = transcripts(spark, sf_dir)
    rows = t.where("size(breaks) > 1").select("record_id", F.explode("breaks").alias("b"))
    return accounting.expected(rows, t.where("doc_id % 3 <> 0")).select("record_id")


@query(f"WITH {BASE} SELECT record_id, n AS gold_words, n + doc_id % 2 AS pred_words FROM t WHERE doc_id % 2 <> 0")
def word_count_drift(spark, sf_dir):
    g = _gold(spark, sf_dir)
    return metrics.drift(g, g.withColumn("word_count", F.col("n") + F.col("doc_id") % 2))


_PK = f"""WITH {BASE}, k AS (
  SELECT *, greatest(1, CAST(round_even(n::DOUBLE / (2 * (len(breaks) + 1)), 0) AS BIGINT)) AS k FROM t
), probe AS (
  SELECT record_id, k, i, len(list_filter(list_distinct(breaks), lambda b: b > i AND b <= i + k)) AS g, len(list_filter(list_distinct(run_a), lambda b: b > i AND b <= i + k)) AS p
  FROM (SELECT *, unnest(range(0, n - k)) AS i FROM k WHERE n > k)
)"""


@query(f"{_PK} SELECT record_id, round(avg(CASE WHEN (g = 0) <> (p = 0) THEN 1.0 ELSE 0.0 END), 6) AS pk, round(avg(CASE WHEN g <> p THEN 1.0 ELSE 0.0 END), 6) AS wd FROM probe GROUP BY record_id")
def pk_windowdiff(spark, sf_dir):
    """Pk and WindowDiff of each document that is long enough."""
    docs = metrics.pk_windowdiff(transcripts(spark, sf_dir), pred="run_a", n="n")
    return _rounded(docs.select("record_id", "pk", "wd").where("pk is not null"), "pk", "wd")


@query(f"{_PK}, d AS (SELECT avg(CASE WHEN (g = 0) <> (p = 0) THEN 1.0::DOUBLE ELSE 0.0 END) AS pk, avg(CASE WHEN g <> p THEN 1.0::DOUBLE ELSE 0.0 END) AS wd FROM probe GROUP BY record_id) SELECT round(avg(pk), 6) AS mean_pk, round(avg(wd), 6) AS mean_wd, count(*) AS n_scored FROM d")
def mean_pk_windowdiff(spark, sf_dir):
    docs = metrics.pk_windowdiff(transcripts(spark, sf_dir), pred="run_a", n="n")
    return _rounded(metrics.mean_pk_windowdiff(docs), "mean_pk", "mean_wd")


@query(f"""WITH {BASE}, k AS (
  SELECT *, least(greatest(2, CAST(round_even(n::DOUBLE / (len(breaks) + 1) / 2, 0) AS BIGINT)), n - 1) AS k FROM t WHERE n >= 4
), probe AS (
  SELECT record_id, len(list_filter(breaks, lambda b: b > i AND b <= i + k)) AS g, len(list_filter(run_a, lambda b: b > i AND b <= i + k)) AS p
  FROM (SELECT *, unnest(range(0, n - k)) AS i FROM k WHERE n > k)
) SELECT record_id, round(avg(CASE WHEN (g = 0) <> (p = 0) THEN 1.0 ELSE 0.0 END), 6) AS pk, round(avg(CASE WHEN g <> p THEN 1.0 ELSE 0.0 END), 6) AS wd FROM probe GROUP BY record_id""")
def pk_windowdiff_research(spark, sf_dir):
    docs = metrics.pk_windowdiff(transcripts(spark, sf_dir), pred="run_a", n="n", research=True)
    return _rounded(docs.select("record_id", "pk", "wd").where("pk is not null"), "pk", "wd")


_UNIFORM = "u AS (SELECT *, CASE WHEN len(breaks) > 0 THEN list_transform(range(1, len(breaks) + 1), lambda i: CAST(round_even(n::DOUBLE / (len(breaks) + 1) * i, 0) AS BIGINT)) ELSE CAST([] AS BIGINT[]) END AS guess FROM t)"


@query(f"WITH {BASE}, {_UNIFORM} SELECT record_id, unnest(guess) AS guess FROM u")
def baseline_uniform(spark, sf_dir):
    t = transcripts(spark, sf_dir)
    return t.select("record_id", F.explode(S.baseline_uniform(F.col("breaks"), F.col("n"))).alias("guess"))


@query(f"WITH RECURSIVE {BASE}, {_UNIFORM}, {matched('breaks', 'guess', '25', 'u')}, sc AS ({rates('SELECT ' + _COUNTS.replace('len(pred)', 'len(guess)') + ' FROM used JOIN u USING (record_id)', '')}) SELECT * FROM sc")
def baseline_uniform_score(spark, sf_dir):
    t = transcripts(spark, sf_dir).withColumn("guess", S.baseline_uniform(F.col("breaks"), F.col("n")))
    return _rounded(metrics.pool(metrics.match_documents(t, pred="guess")), "precision", "recall", "f1")


@query(f"WITH {BASE} SELECT CAST(0 AS BIGINT) AS tp, CAST(sum(len(breaks)) AS BIGINT) AS fn, CAST(0 AS BIGINT) AS fp, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1 FROM t")
def baseline_none_score(spark, sf_dir):
    t = transcripts(spark, sf_dir).withColumn("guess", S.baseline_none())
    return metrics.pool(metrics.match_documents(t, pred="guess"))


_SYSTEMS = f"""WITH RECURSIVE {BASE}, {_UNIFORM}, d AS (
  SELECT record_id, 'model' AS system, breaks, run_a AS guess, n FROM t UNION ALL SELECT record_id, 'none', breaks, CAST([] AS BIGINT[]), n FROM t UNION ALL SELECT record_id, 'uniform', breaks, guess, n FROM u
), {matched('breaks', 'guess', '25', 'd', 'record_id, system')}, sc AS ({rates('SELECT system, ' + _COUNTS.replace('len(pred)', 'len(guess)') + ' FROM used JOIN d USING (record_id, system) GROUP BY system', 'system')}),
k AS (SELECT *, least(greatest(2, CAST(round_even(n::DOUBLE / (len(breaks) + 1) / 2, 0) AS BIGINT)), n - 1) AS k FROM d WHERE n >= 4), probe AS (
  SELECT record_id, system, len(list_filter(breaks, lambda b: b > i AND b <= i + k)) AS g, len(list_filter(guess, lambda b: b > i AND b <= i + k)) AS p FROM (SELECT *, unnest(range(0, n - k)) AS i FROM k WHERE n > k)
), pd AS (SELECT system, avg(CASE WHEN (g = 0) <> (p = 0) THEN 1.0::DOUBLE ELSE 0.0 END) AS pk, avg(CASE WHEN g <> p THEN 1.0::DOUBLE ELSE 0.0 END) AS wd FROM probe GROUP BY record_id, system),
b AS (SELECT sc.*, round(pk, 6) AS pk, round(wd, 6) AS windowdiff FROM sc JOIN (SELECT system, avg(pk) AS pk, avg(wd) AS wd FROM pd GROUP BY system) USING (system))"""


@query(f"{_SYSTEMS} SELECT * FROM b")
def baseline_scores(spark, sf_dir):
    """run_a and both baselines: rates, Pk and WindowDiff."""
    docs = _gold(spark, sf_dir).withColumn("pred_breaks", F.col("run_a"))
    return _rounded(metrics.baseline_scores(docs), "precision", "recall", "f1", "pk", "windowdiff")


@query(f"""{_SYSTEMS} SELECT max(f1) FILTER (WHERE system = 'model') > max(f1) FILTER (WHERE system = 'uniform')
  AND coalesce(nullif(max(windowdiff) FILTER (WHERE system = 'model'), 0), 1) < coalesce(nullif(max(windowdiff) FILTER (WHERE system = 'uniform'), 0), 1)
  AND coalesce(nullif(max(windowdiff) FILTER (WHERE system = 'model'), 0), 1) < coalesce(nullif(max(windowdiff) FILTER (WHERE system = 'none'), 0), 1) AS ship FROM b""")
def ship_gate(spark, sf_dir):
    """Whether run_a beats both baselines."""
    docs = _gold(spark, sf_dir).withColumn("pred_breaks", F.col("run_a"))
    return metrics.ship_gate(metrics.baseline_scores(docs))


# --- windows and postprocessing ---------------------------------------------

_CHAIN = """
fired AS (SELECT record_id{key}, unnest(breaks) AS b FROM {source}),
c1 AS (SELECT *, CASE WHEN b - lag(b) OVER (PARTITION BY record_id{key} ORDER BY b) <= 25 THEN 0 ELSE 1 END AS fresh FROM fired),
c2 AS (SELECT *, sum(fresh) OVER (PARTITION BY record_id{key} ORDER BY b) AS chain FROM c1),
c3 AS (SELECT record_id{key}, CAST(round_even(avg(b), 0) AS BIGINT) AS b FROM c2 GROUP BY record_id{key}, chain)"""


@query(f"WITH {BASE}, {_CHAIN.format(key='', source='w')} SELECT record_id, b AS \"offset\" FROM c3")
def dedupe_overlaps(spark, sf_dir):
    """Boundaries that overlapping windows found twice, merged."""
    offsets = scored_windows(spark, sf_dir).select("record_id", F.explode("breaks").alias("offset"))
    return postprocess.dedupe(offsets, ("record_id",))


@query(f"WITH {BASE}, f AS (SELECT * FROM w WHERE p_break > 0.5), {_CHAIN.format(key='', source='f')}, l AS (SELECT record_id, list(b ORDER BY b) AS p FROM c3 GROUP BY record_id) SELECT t.record_id, coalesce(array_to_string(p, ','), '') AS pred_breaks FROM t LEFT JOIN l USING (record_id)")
def apply_threshold(spark, sf_dir):
    docs = transcripts(spark, sf_dir).select("record_id")
    out = postprocess.apply_threshold(scored_windows(spark, sf_dir), docs, 0.5)
    return out.select("record_id", F.array_join(F.col("pred_breaks").cast("array<string>"), ",").alias("pred_breaks"))


_TAUS = postprocess.THRESHOLDS
_SWEEP = f"""WITH RECURSIVE {BASE}, taus AS (SELECT unnest([{', '.join(map(str, _TAUS))}])::DOUBLE AS tau),
f AS (SELECT w.*, tau FROM w, taus WHERE p_break > tau), {_CHAIN.format(key=', tau', source='f')},
l AS (SELECT record_id, tau, list(b ORDER BY b) AS p FROM c3 GROUP BY record_id, tau),
d AS (SELECT t.record_id, taus.tau, breaks, coalesce(p, CAST([] AS BIGINT[])) AS pred FROM t CROSS JOIN taus LEFT JOIN l ON l.record_id = t.record_id AND l.tau = taus.tau),
{matched('breaks', 'pred', '25', 'd', 'record_id, tau')},
sc AS ({rates('SELECT tau, ' + _COUNTS + ', CAST(sum(len(pred)) AS BIGINT) AS n_pred FROM used JOIN d USING (record_id, tau) GROUP BY tau', 'tau, n_pred')}),
fi AS (SELECT tau, count(*) AS n_firing FROM f GROUP BY tau)
SELECT sc.*, coalesce(n_firing, 0) AS n_firing FROM sc LEFT JOIN fi USING (tau)"""


@query(_SWEEP)
def tau_sweep(spark, sf_dir):
    """One scored set of windows, several thresholds."""
    out = postprocess.sweep(scored_windows(spark, sf_dir), transcripts(spark, sf_dir).select("record_id", "breaks"), _TAUS)
    return _rounded(out.drop("rank"), "precision", "recall", "f1")


@query(f"SELECT tau, f1 FROM ({_SWEEP}) ORDER BY f1 DESC, tau DESC LIMIT 1")
def best_threshold(spark, sf_dir):
    out = postprocess.sweep(scored_windows(spark, sf_dir), transcripts(spark, sf_dir).select("record_id", "breaks"), _TAUS)
    return _rounded(postprocess.best(out).select("tau", "f1"), "f1")


@query(f"WITH {BASE} SELECT count(*) FILTER (WHERE p_break > p_none) AS n_greedy, count(*) AS n_windows FROM w")
def greedy_would_fire(spark, sf_dir):
    return postprocess.greedy_would_fire(scored_windows(spark, sf_dir))


@query(f"""WITH {BASE}, h AS (SELECT record_id, word_start, b - word_start AS local, CAST(200 AS BIGINT) AS n_words, word_start = 0 AS is_first, word_start + 200 >= n AS is_last
  FROM (SELECT w.*, n, unnest(w.breaks) AS b FROM w JOIN t USING (record_id)))
SELECT record_id, word_start, local, (NOT is_first AND local < 20) OR (NOT is_last AND local > n_words - 20) AS guarded, (is_first AND local = 0) OR (is_last AND local = n_words) AS degenerate FROM h""")
def guard_filter(spark, sf_dir):
    w = scored_windows(spark, sf_dir).join(transcripts(spark, sf_dir).select("record_id", "n"), "record_id")
    w = w.withColumn("b", F.explode("breaks"))
    hits = w.select("record_id", "word_start", (F.col("b") - F.col("word_start")).alias("local"), F.lit(200).cast("bigint").alias("n_words"), (F.col("word_start") == 0).alias("is_first"), (F.col("word_start") + 200 >= F.col("n")).alias("is_last"))
    return postprocess.guard(hits).select("record_id", "word_start", "local", "guarded", "degenerate")


@query(f"WITH {BASE} SELECT record_id, e.a AS start, e.b AS \"end\" FROM (SELECT record_id, unnest(list_transform(range(1, len(run_a) + 2), lambda i: {{'a': CASE WHEN i = 1 THEN 0 ELSE run_a[i - 1] END, 'b': CASE WHEN i > len(run_a) THEN n ELSE run_a[i] END}})) AS e FROM t) WHERE e.b > e.a")
def story_spans(spark, sf_dir):
    t = transcripts(spark, sf_dir).select("record_id", F.col("run_a").alias("pred_breaks"), F.col("n").alias("word_count"))
    return windows.segment_spans(t)


_GEOMETRY = windows.Geometry(window_tokens=512, stride_tokens=256, edge_guard_lo=32, tail_window_min_advance=64)
_MAPS = f"""WITH {BASE}, m0 AS (
  SELECT *, regexp_extract_all(body, '[^{T.WS}]+') AS words FROM t
), m1 AS (
  SELECT *, list_transform(words, lambda x: CAST(ceil(length(x) / 6.0) AS BIGINT)) AS sizes FROM m0
), m2 AS (
  SELECT record_id, list(c ORDER BY i) AS tail FROM (SELECT record_id, i, sum(s) OVER (PARTITION BY record_id ORDER BY i) AS c FROM (SELECT record_id, unnest(sizes) AS s, generate_subscripts(sizes, 1) AS i FROM m1)) GROUP BY record_id
), m AS (
  SELECT m1.*, list_concat([CAST(0 AS BIGINT)], coalesce(CAST(tail AS BIGINT[]), CAST([] AS BIGINT[]))) AS w2t FROM m1 LEFT JOIN m2 USING (record_id)
)"""


def _starts_sql(window: str, stride: str, advance: str) -> str:
    return f"""CASE WHEN nt <= {window} THEN [CAST(0 AS BIGINT)] ELSE list_concat(range(0, nt - {window} + 1, {stride}), CASE WHEN (nt - {window}) - ((nt - {window}) // {stride}) * {stride} >= {advance} THEN [nt - {window}] ELSE CAST([] AS BIGINT[]) END) END"""


_GRID = f"""{_MAPS}, g1 AS (SELECT *, w2t[len(w2t)] AS nt FROM m), g2 AS (SELECT *, {_starts_sql('512', '256', '64')} AS starts FROM g1),
g3 AS (SELECT *, i - 1 AS win, starts[i] AS token_start, least(starts[i] + 512, nt) AS token_end, i = 1 AS is_first, i = len(starts) AS is_last FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM g2)),
g AS (SELECT *, len(list_filter(w2t, lambda x: x < token_start)) AS word_start, len(list_filter(w2t, lambda x: x < token_end)) AS word_end FROM g3)"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.token_maps(transcripts(spark, sf_dir), windows.chunk_tokenizer)


@query(f"{_MAPS} SELECT record_id, i - 1 AS word, w2t[i] AS token FROM (SELECT record_id, w2t, unnest(range(1, len(w2t) + 1)) AS i FROM m)")
def word_to_token_index(spark, sf_dir):
    return _maps(spark, sf_dir).select("record_id", F.posexplode("w2t").alias("word", "token")).select("record_id", F.col("word").cast("bigint").alias("word"), F.col("token").cast("bigint").alias("token"))


@query(f"{_GRID} SELECT record_id, win AS \"window\", token_start, token_end, word_start, word_end, is_first, is_last, array_to_string(list_slice(words, word_start + 1, word_end), ' ') AS words FROM g WHERE word_end > word_start")
def window_grid(spark, sf_dir):
    """Sliding windows of 512 tokens over every document."""
    w = windows.enumerate_windows(_maps(spark, sf_dir), _GEOMETRY)
    whole = {c: F.col(c).cast("bigint") for c in ("window", "token_start", "token_end", "word_start", "word_end")}
    return w.withColumns(whole | {"words": F.array_join("words", " ")})


def _anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the gold anchors as a model would write them."""
    w = windows.enumerate_windows(_maps(spark, sf_dir), _GEOMETRY, carry=("breaks",))
    local = F.transform(F.filter("breaks", lambda b: (b > F.col("word_start")) & (b < F.col("word_end"))), lambda b: b - F.col("word_start"))
    return w.withColumn("local", local).withColumn("generated", A.build_target(F.col("words"), F.col("local")))


_LOCAL = f"""{_GRID}, x AS (
  SELECT record_id, win, word_start, word_end - word_start AS nw, is_first, is_last, list_slice(words, word_start + 1, word_end) AS ws,
         list_transform(list_filter(breaks, lambda b: b > word_start AND b < word_end), lambda b: b - word_start) AS local FROM g WHERE word_end > word_start
)"""
_PRE, _POST = "list_slice(ws, greatest(b - 12, 0) + 1, b)", "list_slice(ws, b + 1, b + 8)"
_HITS = """y AS (
  SELECT *, {pre} AS pre, {post} AS post FROM (SELECT *, unnest(local) AS b, generate_subscripts(local, 1) AS ordinal FROM x)
), z AS (
  SELECT *, list_filter(list_filter(range(0, nw - len(pre) + 1), lambda i: ws[i + 1] = pre[1]), lambda i: list_slice(ws, i + 1, i + len(pre)) = pre) AS hits FROM y
)""".format(pre=_PRE, post=_POST)


@query(f"""{_LOCAL}, {_HITS}, l AS (SELECT record_id, win, string_agg(CAST(ordinal AS VARCHAR) || '. ' || array_to_string(pre, ' ') || ' <|STORY_BREAK|> ' || array_to_string(post, ' '), chr(10) ORDER BY ordinal) AS target_text FROM y GROUP BY record_id, win)
SELECT x.record_id, x.win AS "window", coalesce(target_text, 'NONE') AS target_text FROM x LEFT JOIN l USING (record_id, win)""")
def training_targets(spark, sf_dir):
    """What a model should write for each window."""
    return _anchored(spark, sf_dir).select("record_id", F.col("window").cast("bigint").alias("window"), F.col("generated").alias("target_text"))


@query(f"{_LOCAL}, {_HITS} SELECT record_id, win AS \"window\", ordinal - 1 AS ordinal, array_to_string(pre, ' ') AS pre, array_to_string(post, ' ') AS post FROM y")
def parse_anchors(spark, sf_dir):
    """Targets parsed again."""
    a = _anchored(spark, sf_dir).select("record_id", "window", F.posexplode(A.parse_anchors(F.col("generated"))).alias("ordinal", "a"))
    return a.select("record_id", F.col("window").cast("bigint").alias("window"), F.col("ordinal").cast("bigint").alias("ordinal"), "a.pre", "a.post")


@query(f"{_LOCAL}, {_HITS} SELECT record_id, win AS \"window\", ordinal - 1 AS ordinal, hits[1] + len(pre) AS \"offset\", len(hits) > 1 AS ambiguous FROM z")
def localize_anchors(spark, sf_dir):
    """Parsed anchors grounded in their windows."""
    hits = A.ground(F.col("words"), A.parse_anchors(F.col("generated")))
    a = _anchored(spark, sf_dir).select("record_id", "window", F.posexplode(hits).alias("ordinal", "a"))
    return a.select("record_id", F.col("window").cast("bigint").alias("window"), F.col("ordinal").cast("bigint").alias("ordinal"), F.col("a.offset").cast("bigint").alias("offset"), "a.ambiguous")


@query(f"""{_LOCAL}, {_HITS}, q AS (SELECT *, hits[1] + len(pre) AS o, len(hits) > 1 AS amb, CAST(floor(0.1::DOUBLE * nw) AS BIGINT) AS mar FROM z),
q2 AS (SELECT *, (NOT is_first AND o < mar) OR (NOT is_last AND o > nw - mar) AS guarded, (is_first AND o = 0) OR (is_last AND o = nw) AS bad FROM q),
q3 AS (SELECT record_id, win, list(word_start + o ORDER BY ordinal) FILTER (WHERE NOT guarded AND NOT bad) AS br, count(*) FILTER (WHERE amb) AS ambiguous, count(*) FILTER (WHERE NOT guarded AND bad) AS degenerate FROM q2 GROUP BY record_id, win)
SELECT x.record_id, x.word_start, coalesce(array_to_string(br, ','), '') AS breaks, coalesce(ambiguous, 0) AS ambiguous, coalesce(degenerate, 0) AS degenerate, CAST(0 AS BIGINT) AS unlocatable FROM x LEFT JOIN q3 USING (record_id, win)""")
def window_scores(spark, sf_dir):
    """Anchors parsed, grounded, guarded and counted for every window."""
    made = _anchored(spark, sf_dir).withColumns({"p_break": F.lit(1.0), "p_none": F.lit(0.0)})
    s = windows.window_scores(made)
    whole = {c: F.col(c).cast("bigint") for c in ("word_start", "ambiguous", "degenerate", "unlocatable")}
    return s.withColumns(whole | {"breaks": F.array_join(F.col("breaks").cast("array<string>"), ",")}).select("record_id", "word_start", "breaks", "ambiguous", "degenerate", "unlocatable")


_CUTS = f"""{_GRID}, x0 AS (
  SELECT record_id, win, word_start, word_end - word_start AS nw, is_first, is_last, list_slice(words, word_start + 1, word_end) AS ws FROM g WHERE word_end > word_start
), x1 AS (
  SELECT *, list_filter(range(1, nw), lambda i: ends_with(ws[i], '.') AND regexp_matches(ws[i + 1], '^\\p{{Lu}}')) AS every FROM x0
), x AS (
  SELECT *, list_filter(every, lambda b, j: (j - 1) % 3 = 0) AS local FROM x1
)"""


@query(f"""{_CUTS}, {_HITS}, q AS (SELECT *, hits[1] + len(pre) AS o, len(hits) > 1 AS amb, CAST(floor(0.1::DOUBLE * nw) AS BIGINT) AS mar FROM z),
q2 AS (SELECT *, (NOT is_first AND o < mar) OR (NOT is_last AND o > nw - mar) OR (is_first AND o = 0) OR (is_last AND o = nw) AS gone FROM q),
q3 AS (SELECT record_id, list(word_start + o) AS breaks FROM q2 WHERE NOT gone AND least(0.999, len(local) / 10.0) > 0.05 GROUP BY record_id), {_CHAIN.format(key='', source='q3')},
l AS (SELECT record_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS p FROM c3 GROUP BY record_id), am AS (SELECT record_id, count(*) FILTER (WHERE amb) AS n FROM q GROUP BY record_id)
SELECT t.record_id, t.n AS word_count, t.outlet, t."show", coalesce(p, '') AS pred_breaks, CAST(0 AS BIGINT) AS n_unlocatable_anchors, coalesce(am.n, 0) AS n_ambiguous_anchors, 0.05::DOUBLE AS tau
FROM t LEFT JOIN l USING (record_id) LEFT JOIN am ON am.record_id = t.record_id""")
def segment_documents(spark, sf_dir):
    """Windows, scorer (a stand-in), anchors, threshold: a predictions table."""
    docs = transcripts(spark, sf_dir)
    scores = windows.score_windows(docs, _GEOMETRY, tokenizer=windows.chunk_tokenizer)
    out = windows.segment_documents(scores, docs, 0.05)
    return _whole(out, "n_unlocatable_anchors", "n_ambiguous_anchors").withColumn("pred_breaks", F.array_join(F.col("pred_breaks").cast("array<string>"), ","))


# --- reconciling -------------------------------------------------------------


def _two_runs(spark: SparkSession, sf_dir: str, overlap: float = 0.6, old: str = "true", new: str = "true") -> DataFrame:
    t = transcripts(spark, sf_dir)
    cut = lambda run, where: segments.to_segments(t.where(where).withColumn("breaks", F.col(run)), include_text=False)
    return reconcile.reconcile(cut("run_a", old), cut("run_b", new), min_overlap=overlap)


_SID = "record_id || '#' || lpad(CAST({i} AS VARCHAR), CAST(greatest(3, length(CAST({i} AS VARCHAR))) AS INTEGER), '0')"


def _side(run: str, where: str) -> str:
    return f"SELECT record_id, i - 1 AS i, {_SID.format(i='(i - 1)')} AS id, CASE WHEN i = 1 THEN 0 ELSE {run}[i - 1] END AS a, CASE WHEN i > len({run}) THEN n ELSE {run}[i] END AS b FROM (SELECT *, unnest(range(1, len({run}) + 2)) AS i FROM t WHERE {where})"


def _reconcile(overlap: float, old: str = "true", new: str = "true") -> str:
    """Correspondences c; above one half each segment has at most one partner, below the best are taken one by one."""
    greedy = f"""cand AS (SELECT record_id, oi, ni, row_number() OVER (PARTITION BY record_id ORDER BY j DESC, oi, ni) AS rk FROM y WHERE j >= {overlap}), st AS (
  SELECT DISTINCT record_id, CAST([] AS BIGINT[]) AS ug, CAST([] AS BIGINT[]) AS up, CAST(0 AS BIGINT) AS rk FROM cand
  UNION ALL
  SELECT record_id, ug, up, rk FROM (
    SELECT s.record_id, list_append(s.ug, c.oi) AS ug, list_append(s.up, c.ni) AS up, c.rk, row_number() OVER (PARTITION BY s.record_id ORDER BY c.rk) AS nth
    FROM st s JOIN cand c ON s.record_id = c.record_id AND c.rk > s.rk AND NOT list_contains(s.ug, c.oi) AND NOT list_contains(s.up, c.ni)) WHERE nth = 1
), used AS (SELECT record_id, arg_max(ug, len(ug)) AS ug, arg_max(up, len(up)) AS up FROM st GROUP BY record_id),
p AS (SELECT y.* FROM y JOIN (SELECT record_id, unnest(ug) AS oi, unnest(up) AS ni FROM used) u ON u.record_id = y.record_id AND u.oi = y.oi AND u.ni = y.ni)"""
    return f"""WITH RECURSIVE {BASE}, o AS ({_side('run_a', old)}), n AS ({_side('run_b', new)}),
x AS (SELECT o.record_id, o.i AS oi, n.i AS ni, o.id AS oid, n.id AS nid, o.a AS oa, o.b AS ob, n.a AS na, n.b AS nb,
  greatest(0, least(o.b, n.b) - greatest(o.a, n.a)) AS inter FROM o JOIN n ON o.record_id = n.record_id),
y AS (SELECT *, CASE WHEN ob - oa + nb - na - inter <> 0 THEN inter / (ob - oa + nb - na - inter)::DOUBLE WHEN oa = na AND ob = nb THEN 1.0 ELSE 0.0 END AS j,
  nb > na AND inter >= 0.5 * (nb - na) AS nin, ob > oa AND inter >= 0.5 * (ob - oa) AS oin FROM x),
{f"p AS (SELECT * FROM y WHERE j >= {overlap})" if overlap > 0.5 else greedy},
pairs AS (SELECT p.*, EXISTS (SELECT 1 FROM y WHERE y.record_id = p.record_id AND y.oi = p.oi AND y.ni <> p.ni AND y.nin) AS split, EXISTS (SELECT 1 FROM y WHERE y.record_id = p.record_id AND y.ni = p.ni AND y.oi <> p.oi AND y.oin) AS merged FROM p),
lone_o AS (SELECT o.* FROM o WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.record_id = o.record_id AND p.oi = o.i)),
lone_n AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.record_id = n.record_id AND p.ni = n.i)),
host_o AS (SELECT * FROM (SELECT y.*, row_number() OVER (PARTITION BY record_id, oi ORDER BY inter DESC, ni) AS k FROM y WHERE oin) WHERE k = 1),
host_n AS (SELECT * FROM (SELECT y.*, row_number() OVER (PARTITION BY record_id, ni ORDER BY inter DESC, oi) AS k FROM y WHERE nin) WHERE k = 1),
c AS (
  SELECT record_id, CASE WHEN split THEN 'split' WHEN merged THEN 'merged' WHEN oa = na AND ob = nb THEN 'same' ELSE 'moved' END AS status, oid AS old_id, nid AS new_id, round(j, 6) AS overlap, na - oa AS start_shift FROM pairs
  UNION ALL
  SELECT l.record_id, CASE WHEN h.ni IS NULL THEN 'removed' ELSE 'merged' END, l.id, h.nid, coalesce(round(h.j, 6), 0.0), h.na - h.oa FROM lone_o l LEFT JOIN host_o h ON h.record_id = l.record_id AND h.oi = l.i
  UNION ALL
  SELECT l.record_id, CASE WHEN h.oi IS NULL THEN 'added' ELSE 'split' END, h.oid, l.id, coalesce(round(h.j, 6), 0.0), h.na - h.oa FROM lone_n l LEFT JOIN host_n h ON h.record_id = l.record_id AND h.ni = l.i
)"""


_RECONCILE = _reconcile(0.6)


@query(f"{_RECONCILE} SELECT * FROM c")
def reconcile_pairs(spark, sf_dir):
    """How the segments of run_a relate to those of run_b."""
    return _rounded(_two_runs(spark, sf_dir).drop("ordinal"), "overlap")


@query(f"{_reconcile(0.3)} SELECT * FROM c")
def reconcile_low_overlap(spark, sf_dir):
    """Pairs that share less than half: the best are taken first."""
    return _rounded(_two_runs(spark, sf_dir, 0.3).drop("ordinal"), "overlap")


@query(f"{_reconcile(0.0)} SELECT * FROM c")
def reconcile_any_overlap(spark, sf_dir):
    """Every pair of a record is a candidate."""
    return _rounded(_two_runs(spark, sf_dir, 0.0).drop("ordinal"), "overlap")


@query(f"{_reconcile(0.6, 'doc_id % 3 <> 0', 'doc_id % 4 <> 0')} SELECT * FROM c")
def reconcile_one_sided(spark, sf_dir):
    """Records that only one of the runs has."""
    return _rounded(_two_runs(spark, sf_dir, 0.6, "doc_id % 3 <> 0", "doc_id % 4 <> 0").drop("ordinal"), "overlap")


@query(f"{_RECONCILE} SELECT status, count(*) AS n FROM c GROUP BY status")
def reconcile_status_counts(spark, sf_dir):
    return reconcile.status_counts(_two_runs(spark, sf_dir))


@query(f"{_RECONCILE} SELECT old_id, new_id FROM c WHERE status IN ('same', 'moved')")
def id_map(spark, sf_dir):
    return reconcile.id_map(_two_runs(spark, sf_dir))


@query(f"{_RECONCILE} SELECT count(*) AS n_moved, max(abs(start_shift)) AS max_shift FROM c WHERE status IN ('same', 'moved') AND start_shift <> 0")
def reconcile_shifts(spark, sf_dir):
    return reconcile.shifts(_two_runs(spark, sf_dir))


# --- validation and training data -------------------------------------------


@query(f"""WITH {BASE} SELECT record_id, 'word_count is not the body''s ' || n AS problem FROM t WHERE doc_id % 17 = 0
UNION ALL SELECT record_id, 'duplicate annotation record_id' FROM t WHERE doc_id % 23 = 0
UNION ALL SELECT record_id, 'annotated against different text' FROM t WHERE doc_id % 17 = 0
UNION ALL SELECT record_id, 'annotated against different text' FROM t WHERE doc_id % 17 = 0 AND doc_id % 23 = 0
UNION ALL SELECT record_id, 'offsets out of range: [0]' FROM t WHERE doc_id % 17 <> 0 AND doc_id % 19 = 0
UNION ALL SELECT record_id, 'offsets out of range: [0]' FROM t WHERE doc_id % 17 <> 0 AND doc_id % 19 = 0 AND doc_id % 23 = 0
UNION ALL SELECT record_id, 'breaks are not ascending' FROM t WHERE doc_id % 17 <> 0 AND doc_id % 19 = 0 AND len(breaks) > 0
UNION ALL SELECT record_id, 'breaks are not ascending' FROM t WHERE doc_id % 17 <> 0 AND doc_id % 19 = 0 AND doc_id % 23 = 0 AND len(breaks) > 0""")
def validate_problems(spark, sf_dir):
    """Transcripts and annotations with planted faults."""
    g = _gold(spark, sf_dir)
    told = g.withColumn("word_count", F.when(F.col("doc_id") % 17 == 0, F.col("n") + 1).otherwise(F.col("n")))
    notes = g.withColumn("breaks", F.when(F.col("doc_id") % 19 == 0, F.concat("breaks", F.array(F.lit(0).cast("bigint")))).otherwise(F.col("breaks")))
    notes = notes.unionByName(notes.where("doc_id % 23 = 0"))
    return validation.cross_file(told, notes)


@query(f"WITH {BASE} SELECT record_id, CASE WHEN doc_id % 17 = 0 THEN 'word_count differs' ELSE 'break offsets out of range' END AS reason FROM t WHERE doc_id % 17 = 0 OR doc_id % 19 = 0")
def unusable_annotations(spark, sf_dir):
    g = _gold(spark, sf_dir)
    notes = g.withColumn("word_count", F.when(F.col("doc_id") % 17 == 0, F.col("n") + 1).otherwise(F.col("n")))
    notes = notes.withColumn("breaks", F.when(F.col("doc_id") % 19 == 0, F.concat("breaks", F.array(F.lit(0).cast("bigint")))).otherwise(F.col("breaks")))
    return validation.usable_annotations(g, notes)[1]


_CLIPPING = training.Clipping(window=512, stride=384, guard_lo=50, guard_hi=462, min_window=128, min_advance=32)
_CLIP = _MAPS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", k1 AS (SELECT *, w2t[len(w2t)] AS nt, list_transform(breaks, lambda b: w2t[b + 1]) AS bt FROM m),
k2 AS (SELECT *, {_starts_sql('512', '384', '32')} AS starts FROM k1), k3 AS (SELECT * EXCLUDE (starts), unnest(starts) AS g0 FROM k2),
k AS (SELECT *, least(g0 + 512, nt) AS g1 FROM k3),
z AS (
  SELECT record_id, g0, bt, g0 AS t0, g1 AS t1, 0 AS turn, false AS done, '' AS category, '' AS note FROM k
  UNION ALL
  SELECT record_id, g0, bt,
    CASE WHEN small THEN t0 ELSE coalesce(lead_, t0) END, CASE WHEN small THEN t1 ELSE coalesce(trail, t1) END, turn + 1, small OR (lead_ IS NULL AND trail IS NULL),
    CASE WHEN small OR lead_ IS NOT NULL OR trail IS NOT NULL THEN '' WHEN len(list_filter(bt, lambda b: b > t0 AND b < t1)) > 0 THEN 'true_transition' ELSE 'pure_continuation' END,
    CASE WHEN t1 - t0 < 100 THEN 'window_shorter_than_guard_bands' WHEN t1 - t0 < 128 THEN 'clipped_below_min_window' WHEN lead_ IS NULL AND trail IS NULL THEN CASE WHEN turn > 0 THEN 'clipped' ELSE '' END ELSE '' END
  FROM (SELECT *, t1 - t0 < 128 AS small, list_max(list_filter(bt, lambda b: b > t0 AND b < t0 + 50)) AS lead_, list_min(list_filter(bt, lambda b: b > t1 - 50 AND b < t1)) AS trail FROM z WHERE NOT done AND turn < 32)
), v0 AS (SELECT record_id, g0, arg_max(t0, turn) AS t0, arg_max(t1, turn) AS t1, arg_max(category, turn) AS category, arg_max(note, turn) AS note, arg_max(done, turn) AS done FROM z GROUP BY record_id, g0),
v1 AS (SELECT k.record_id, k.outlet, v0.g0, g1, t0, t1, category, CASE WHEN done THEN note ELSE 'clip_did_not_converge' END AS note, k.breaks, k.words, len(list_filter(w2t, lambda x: x < t0)) AS w0, len(list_filter(w2t, lambda x: x < t1)) AS w1 FROM v0 JOIN k ON k.record_id = v0.record_id AND k.g0 = v0.g0),
v AS (SELECT *, list_filter(breaks, lambda b: b > w0 AND b < w1) AS bg, category = '' OR w1 <= w0 AS rejected FROM v1)"""


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return training.build_rows(_maps(spark, sf_dir), _CLIPPING)


def _whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


@query(f"""{_CLIP} SELECT record_id, g0 AS grid_tok_start, g1 AS grid_tok_end, t0 AS win_tok_start, t1 AS win_tok_end, w0 AS win_word_start, w1 AS win_word_end, category, note = 'clipped' AS was_clipped, len(bg) AS n_breaks,
  array_to_string(list_slice(words, w0 + 1, w1), ' ') AS input_text FROM v WHERE NOT rejected""")
def training_rows(spark, sf_dir):
    """Windows clipped past the breaks in their guard bands."""
    names = ("grid_tok_start", "grid_tok_end", "win_tok_start", "win_tok_end", "win_word_start", "win_word_end", "n_breaks")
    return _whole(_training(spark, sf_dir)[0], *names).select("record_id", *names, "category", "was_clipped", "input_text")


@query(f"{_CLIP} SELECT record_id, g0 AS grid_tok_start, CASE WHEN note = '' THEN 'empty_word_span' ELSE note END AS reject_reason FROM v WHERE rejected")
def training_rejects(spark, sf_dir):
    return _whole(_training(spark, sf_dir)[1], "grid_tok_start").select("record_id", "grid_tok_start", "reject_reason")


@query(f"{_CLIP}, c AS (SELECT CAST(sum(len(bg)) AS BIGINT) AS n_breaks, count(*) FILTER (WHERE note = 'clipped') AS n_clipped, count(*) AS n_rows FROM v WHERE NOT rejected), d AS (SELECT count(*) AS n_covered FROM (SELECT DISTINCT record_id, unnest(bg) AS b FROM v WHERE NOT rejected)) SELECT * FROM c, d")
def training_coverage(spark, sf_dir):
    return training.coverage(_training(spark, sf_dir)[0]).drop("n_unlocatable")


@query(f"{_CLIP} SELECT outlet, count(*) AS n FROM v WHERE NOT rejected GROUP BY outlet")
def outlet_mix(spark, sf_dir):
    return training.most_common(_training(spark, sf_dir)[0], "outlet")


@query(f"""{_CLIP}, q AS (SELECT list(t1 - t0 ORDER BY t1 - t0) AS x FROM v WHERE NOT rejected)
SELECT x[1 + CAST(floor(0.5::DOUBLE * (len(x) - 1)) AS BIGINT)] AS p50, x[1 + CAST(floor(0.95::DOUBLE * (len(x) - 1)) AS BIGINT)] AS p95, x[1 + len(x) // 2] AS median FROM q""")
def width_quantiles(spark, sf_dir):
    rows = _training(spark, sf_dir)[0]
    width = (F.col("win_tok_end") - F.col("win_tok_start")).cast("bigint")
    return training.quantiles(rows, width, p50=training.lower(0.5), p95=training.lower(0.95), median=training.upper_median())


@query(f"""{_CLIP}, r AS (SELECT *, CASE WHEN category = 'true_transition' THEN 1 ELSE 0 END AS a FROM v WHERE NOT rejected), c AS (SELECT sum(a) AS na, count(*) - sum(a) AS nc FROM r)
SELECT record_id, g0 AS grid_tok_start, round(CASE WHEN na = 0 OR nc = 0 THEN 1.0 WHEN a = 1 THEN 0.5::DOUBLE / na * (na + nc) ELSE 0.5::DOUBLE / nc * (na + nc) END, 6) AS decision_weight FROM r, c""")
def decision_weights(spark, sf_dir):
    rows = training.decision_weights(_training(spark, sf_dir)[0], 0.5)
    return _rounded(_whole(rows, "grid_tok_start").select("record_id", "grid_tok_start", "decision_weight"), "decision_weight")


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transcripts(spark, sf_dir)
    return t.select("record_id", "doc_id", F.when(F.size("breaks") > 0, "A").otherwise("C").alias("category"), (F.col("doc_id") % 10 == 0).alias("heldout"))


@query(f"""WITH {BASE}, a AS (SELECT doc_id % 10 = 0 AS held, CASE WHEN len(breaks) > 0 THEN 'A' ELSE 'C' END AS category FROM t), c AS (SELECT category, count(*) AS n FROM a WHERE NOT held GROUP BY category),
s AS (SELECT 'test' AS split, (SELECT count(*) FROM a WHERE held) AS n UNION ALL SELECT 'val', sum(greatest(1, CAST(round_even(n * 0.12::DOUBLE, 0) AS BIGINT))) FROM c UNION ALL SELECT 'train', sum(n - greatest(1, CAST(round_even(n * 0.12::DOUBLE, 0) AS BIGINT))) FROM c)
SELECT split, CAST(n AS BIGINT) AS n FROM s WHERE n > 0""")
def split_sizes(spark, sf_dir):
    return training.assign_splits(_annotated(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_CLIP}, r AS (SELECT CASE WHEN CAST(record_id AS BIGINT) % 10 = 0 THEN 'test' ELSE 'pool' END AS split, category FROM v WHERE NOT rejected) SELECT split, category, count(*) AS n_rows FROM r GROUP BY CUBE (split, category)")
def split_grid(spark, sf_dir):
    rows = _training(spark, sf_dir)[0].withColumn("split", F.when(F.col("doc_id") % 10 == 0, "test").otherwise("pool"))
    return training.split_grid(rows)


@query(f"WITH {BASE} SELECT greatest(1, CAST(floor(count(*) * 0.3::DOUBLE) AS BIGINT)) AS n_records FROM t")
def sample_by_record(spark, sf_dir):
    return training.sample_by_record(transcripts(spark, sf_dir), 0.3).agg(F.count_distinct("record_id").alias("n_records"))


_GRIDS = _MAPS.replace("WITH ", "WITH RECURSIVE ", 1) + """, gr AS (SELECT w, r, g, CAST(floor(w * r) AS BIGINT) AS s FROM (SELECT unnest([2048, 3072, 4096]) AS w), (SELECT unnest([0.5, 0.75])::DOUBLE AS r), (SELECT unnest([200, 300, 400]) AS g)),
k0 AS (SELECT record_id, breaks, w2t, w2t[len(w2t)] AS nt, list_transform(breaks, lambda b: w2t[b + 1]) AS bt FROM m),
k1 AS (SELECT k0.*, gr.* FROM k0, gr),
k2 AS (SELECT *, CASE WHEN nt <= w THEN [CAST(0 AS BIGINT)] ELSE list_concat(range(0, nt - w + 1, s), CASE WHEN (nt - w) - ((nt - w) // s) * s >= 256 THEN [nt - w] ELSE CAST([] AS BIGINT[]) END) END AS starts FROM k1),
k AS (SELECT * EXCLUDE (starts), unnest(starts) AS g0 FROM k2),
z AS (
  SELECT record_id, w, r, g, g0, bt, g0 AS t0, least(g0 + w, nt) AS t1, 0 AS turn, false AS done, '' AS category FROM k
  UNION ALL
  SELECT record_id, w, r, g, g0, bt, CASE WHEN small THEN t0 ELSE coalesce(lead_, t0) END, CASE WHEN small THEN t1 ELSE coalesce(trail, t1) END, turn + 1, small OR (lead_ IS NULL AND trail IS NULL),
    CASE WHEN small OR lead_ IS NOT NULL OR trail IS NOT NULL THEN '' WHEN len(list_filter(bt, lambda b: b > t0 AND b < t1)) > 0 THEN 'true_transition' ELSE 'pure_continuation' END
  FROM (SELECT *, t1 - t0 < greatest(2 * g, w // 4) AS small, list_max(list_filter(bt, lambda b: b > t0 AND b < t0 + g)) AS lead_, list_min(list_filter(bt, lambda b: b > t1 - g AND b < t1)) AS trail FROM z WHERE NOT done AND turn < 32)
), e0 AS (SELECT record_id, w, r, g, g0, arg_max(t0, turn) AS t0, arg_max(t1, turn) AS t1, arg_max(category, turn) AS category FROM z GROUP BY ALL),
e1 AS (SELECT e0.*, k0.breaks, len(list_filter(w2t, lambda x: x < t0)) AS w0, len(list_filter(w2t, lambda x: x < t1)) AS w1, CAST(record_id AS BIGINT) % 10 AS part FROM e0 JOIN k0 USING (record_id)),
e AS (SELECT *, category <> '' AND w1 > w0 AS kept, list_filter(breaks, lambda b: b > w0 AND b < w1) AS bg FROM e1),
cov AS (SELECT w, r, g, count(*) AS covered FROM (SELECT DISTINCT w, r, g, record_id, unnest(bg) AS b FROM e WHERE kept) GROUP BY w, r, g)
SELECT 'w' || w || '_s' || s || '_g' || g AS variant_id, CAST(w AS BIGINT) AS window_tokens, s AS stride_tokens, r AS stride_ratio, CAST(g AS BIGINT) AS edge_guard_lo, a.* EXCLUDE (w, r, g), coalesce(covered, 0) AS breaks_covered, CAST(w + 1024 AS BIGINT) AS max_seq_len,
  round(n_cat_a / greatest(1, n_rows)::DOUBLE, 6) AS cat_a_share, round(coalesce(covered, 0) / (SELECT sum(len(breaks)) FROM t)::DOUBLE, 6) AS coverage
FROM (SELECT w, r, g, count(*) FILTER (WHERE kept) AS n_rows, count(*) FILTER (WHERE NOT kept) AS n_rejected, count(*) FILTER (WHERE kept AND part > 1) AS n_train, count(*) FILTER (WHERE kept AND part = 1) AS n_val, count(*) FILTER (WHERE kept AND part = 0) AS n_test,
  count(*) FILTER (WHERE kept AND category = 'true_transition') AS n_cat_a FROM e GROUP BY w, r, g) a JOIN gr USING (w, r, g) LEFT JOIN cov USING (w, r, g)"""


@query(_GRIDS)
def variant_manifest(spark, sf_dir):
    """All eighteen window geometries over token maps that are computed once."""
    part = F.col("doc_id") % 10
    t = transcripts(spark, sf_dir)
    splits = t.select("record_id", F.when(part == 0, "test").when(part == 1, "val").otherwise("train").alias("split"))
    n_gold = t.agg(F.sum(F.size("breaks"))).first()[0] or 1
    out = training.manifest(training.build_variants(_maps(spark, sf_dir)), n_gold, splits)
    return _rounded(_whole(out, "window_tokens", "stride_tokens", "edge_guard_lo", "max_seq_len"), "cat_a_share", "coverage")


_ERRORS = """h AS (SELECT t.*, list_transform(ug, lambda i: breaks[i]) AS hg, list_transform(up, lambda i: run_a[i]) AS hp FROM used JOIN t USING (record_id)),
e AS (
  SELECT record_id, 'false_positive' AS kind, b AS word_offset, list_min(list_transform(breaks, lambda o: abs(b - o))) AS nearest, body FROM (SELECT *, unnest(list_filter(run_a, lambda p: NOT list_contains(hp, p))) AS b FROM h)
  UNION ALL
  SELECT record_id, 'false_negative', b, list_min(list_transform(run_a, lambda o: abs(b - o))), body FROM (SELECT *, unnest(list_filter(breaks, lambda p: NOT list_contains(hg, p))) AS b FROM h)
)"""
_MINE = f"WITH RECURSIVE {BASE}, {_A25}, {_ERRORS}"


@query(f"""{_MINE} SELECT record_id, kind, word_offset, nearest, array_to_string(list_slice(ws, greatest(0, word_offset - 60) + 1, word_offset), ' ') AS text_before, array_to_string(list_slice(ws, word_offset + 1, word_offset + 60), ' ') AS text_after
FROM (SELECT *, regexp_extract_all(body, '[^{T.WS}]+') AS ws FROM e)""")
def mine_errors(spark, sf_dir):
    """Unmatched boundaries with the text around them."""
    t = transcripts(spark, sf_dir).select("record_id", "body", "breaks", F.col("run_a").alias("pred_breaks"))
    return training.mine_errors(t)


@query(f"""{_MINE} SELECT record_id, "at", kind, gold, model, off FROM (
  SELECT record_id, least(breaks[ug[i]], run_a[up[i]]) AS "at", 'match' AS kind, breaks[ug[i]] AS gold, run_a[up[i]] AS model, abs(breaks[ug[i]] - run_a[up[i]]) AS off FROM (SELECT record_id, ug, up, unnest(range(1, len(ug) + 1)) AS i FROM used) JOIN t USING (record_id)
  UNION ALL SELECT record_id, word_offset, 'extra', NULL, word_offset, NULL FROM e WHERE kind = 'false_positive'
  UNION ALL SELECT record_id, word_offset, 'missed', word_offset, NULL, NULL FROM e WHERE kind = 'false_negative')""")
def review_events(spark, sf_dir):
    """Gold and predicted boundaries side by side."""
    t = transcripts(spark, sf_dir).select("record_id", "breaks", F.col("run_a").alias("pred_breaks"))
    return training.review_events(t).select("record_id", F.explode("events").alias("e")).select("record_id", "e.*")


@query(f"{_MINE} SELECT kind, count(*) AS n FROM e GROUP BY kind")
def error_counts(spark, sf_dir):
    t = transcripts(spark, sf_dir).select("record_id", "body", "breaks", F.col("run_a").alias("pred_breaks"))
    return training.mine_errors(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_CLIP}, {_A25}, {_ERRORS}
SELECT record_id, g0 AS grid_tok_start, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.record_id = v.record_id AND e.word_offset >= w0 AND e.word_offset < w1) THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS row_weight FROM v WHERE NOT rejected""")
def hard_weights(spark, sf_dir):
    """Training rows that hold a mined error, weighted up."""
    t = transcripts(spark, sf_dir).select("record_id", "body", "breaks", F.col("run_a").alias("pred_breaks"))
    rows = training.hard_weights(_training(spark, sf_dir)[0], training.mine_errors(t), 3.0)
    return _whole(rows, "grid_tok_start").select("record_id", "grid_tok_start", "row_weight")


@query(f"""WITH {BASE}, p AS (
  SELECT record_id, list_filter(list_transform(string_split(regexp_replace(body, '([a-z.)\\]"])([A-Z][A-Z .''-]{{2,25}}(?:, [A-Z][A-Za-z .]+)?:)', '\\1' || chr(10) || '\\2', 'g'), chr(10)),
    lambda x: regexp_replace(regexp_replace(x, '^[{T.WS}]+', ''), '[{T.WS}]+$', '')), lambda x: x <> '') AS parts FROM t
) SELECT record_id, unnest(parts) AS paragraph, generate_subscripts(parts, 1) - 1 AS ordinal FROM p""")
def speaker_paragraphs(spark, sf_dir):
    """Texts cut at line ends and speaker labels."""
    t = transcripts(spark, sf_dir)
    return t.select("record_id", F.posexplode(T.paragraphs(F.col("body"))).alias("ordinal", "paragraph")).withColumn("ordinal", F.col("ordinal").cast("bigint"))
