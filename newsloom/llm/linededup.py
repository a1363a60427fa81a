"""Line dedup by a suffix array over line-ID sequences (operator 5).

A document is the sequence of its lines' IDs (128-bit hashes).  The suffixes of
all sequences are sorted by distributed prefix doubling: from their order by the
first h lines, a suffix's pair of ranks, its own and that of the suffix h lines
further on (fewer in the last round), gives the order by 2h lines.  Suffixes of
one rank are an interval of the suffix array whose longest common prefix is h
or more.  A suffix whose interval has no other member can't be in a longer
common prefix either, so it leaves the rounds: what is sorted in a round is the
table of intervals of two and more, and lines that occur once never enter.

The rounds end at RUN lines, as the intervals of that depth tell all that is
deleted.  All but the first suffix of an interval, in the order of (doc_id, line),
begin a later copy of RUN lines; the copies of a document that touch or overlap are
one maximal run.  Deleted are the lines of these runs, and single lines of at
least `least` characters that have an earlier copy: LONG in `dedup_lines`, as in
its SQL, and SHORT in `deduplicate`, which has no SQL and also takes boilerplate
of a few words.  The first copy always stays.

Plan.  Texts are exploded to line IDs, which are the only thing the rounds
shuffle.  Intervals are found by aggregation, so that the most frequent line is
counted where it lies; ranks are handed out by a range sort of the intervals
alone and go back to the suffixes by a join, where adaptive execution splits a
frequent line's rows.  Each round writes its table to the shared folder; only the
runs stay there.  Texts are cut by array expressions.

Cases.  Null texts are returned as they are.  An empty text is one empty line.
Documents whose lines are all deleted have a null text in `dedup_lines` and are
dropped by `deduplicate`.  Rows that repeat id and text are one document and
are edited alike; rows of one id with different texts are different documents.
A null id sorts first.  An empty table gives an empty one.  Clashing column names
don't matter: only id and text are looked at, the rest is carried along; an
integer column n_chars is updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import let
from newsloom.llm.common import Tables, documents, plain

#: A repeated run is deleted from this many lines on.
RUN = 2
#: A single repeated line is deleted from this many characters on, in dedup_lines (and its SQL) and in deduplicate.
#: Below SHORT, about three words, clean documents share lines by chance ("Yes.", "Chapter 1", "}").
LONG, SHORT = 40, 15


def _key(id_col: str, text_col: str) -> tuple[Column, Column]:
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), F.xxhash64(F.col(text_col))


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG) -> DataFrame:
    """d, t (document key), p (line, from 0), h, g (line ID), long."""
    d, t = _key(id_col, text_col)
    split = docs.where(F.col(text_col).isNotNull()).select(d.alias("d"), t.alias("t"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("p", "x"))
    return split.select("d", "t", "p", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"), (F.length("x") >= least).alias("long"))


def intervals(tables: Tables, suffixes: DataFrame, *prefix: str) -> DataFrame:
    """The intervals of suffixes (d, t, p) by their prefix, of two places and more: prefix, first (the least place), r (rank)."""
    place = F.struct("d", "t", "p")
    found = suffixes.groupBy(*prefix).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # ranks needn't be dense, only in the order of the prefixes
    return tables.put(found.orderBy(*prefix).select(*prefix, "first", F.monotonically_increasing_id().alias("r")))


def ranked(tables: Tables, docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", least: int = LONG) -> tuple[DataFrame, DataFrame]:
    """Suffixes (d, t, p, r, later, long) in intervals of common prefixes of one line, and of `run` lines."""
    later = (F.struct("d", "t", "p") > F.col("first")).alias("later")
    every = lines(docs, id_col, text_col, least)
    order = intervals(tables, every, "h", "g")
    table = single = tables.put(every.join(order, ["h", "g"]).select("d", "t", "p", "r", later, "long").distinct())
    tables.drop(order)
    depth = 1
    while depth < run:
        step = min(depth, run - depth)
        ahead = table.select("d", "t", (F.col("p") - step).alias("p"), F.col("r").alias("r2"))
        paired = tables.put(table.select("d", "t", "p", F.col("r").alias("r1"), "long").join(ahead, ["d", "t", "p"]))
        order = intervals(tables, paired, "r1", "r2")
        longer = tables.put(paired.join(order, ["r1", "r2"]).select("d", "t", "p", "r", later, "long"))
        tables.drop(paired, order, *([] if table is single else [table]))
        table, depth = longer, depth + step
    return single, table


def later_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", least: int = LONG) -> DataFrame:
    """d, t and the maximal runs of lines that are later copies: an array of disjoint (start, stop), in order."""
    tables = Tables(docs.sparkSession, "lines")
    single, table = ranked(tables, docs, run, id_col, text_col, least)
    copies = table.where("later").select("d", "t", "p", (F.col("p") + run).alias("stop"))
    copies = copies.union(single.where("later and long").select("d", "t", "p", (F.col("p") + 1).alias("stop")))
    own = Window.partitionBy("d", "t").orderBy("p")
    # a run begins where no copy before reaches; a document's copies are no more than its lines
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    begun = copies.withColumn("fresh", F.when(F.col("p") <= reach, 0).otherwise(1)).withColumn("k", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    runs = begun.groupBy("d", "t", "k").agg(F.min("p").alias("start"), F.max("stop").alias("stop"))
    out = tables.put(runs.groupBy("d", "t").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs")))
    tables.drop(single, *([] if table is single else [table]))
    return out


def _kept(text: Column, runs: Column) -> Column:
    """The lines of a text outside its runs."""

    def cut(own: Column) -> Column:
        n = F.array(F.size(own))
        edges = F.arrays_zip(F.concat(F.array(F.lit(0)), runs["stop"]).alias("a"), F.concat(runs["start"], n).alias("b"))
        return F.flatten(F.transform(edges, lambda e: F.slice(own, e["a"] + 1, e["b"] - e["a"])))

    return let(F.split(text, "\n", -1), cut)


def _joined(docs: DataFrame, run: int, id_col: str, text_col: str, least: int) -> DataFrame:
    """docs with _runs (null for most) and _text, what is left of the text (null if nothing is)."""
    d, t = _key(id_col, text_col)
    runs = later_runs(docs, run, id_col, text_col, least).select(F.col("d").alias("_d"), F.col("t").alias("_t"), F.col("runs").alias("_runs"))
    left = let(_kept(F.col(text_col), F.col("_runs")), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")))
    # texts are always shuffled to their runs, at every size alike
    return docs.join(runs.hint("merge"), (d == F.col("_d")) & (t == F.col("_t")), "left").withColumn("_text", F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(left))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LONG, run: int = RUN) -> DataFrame:
    """doc_id, n_lines, n_removed, text (null if nothing is left) of the rows with a text."""
    docs, (id_col, text_col) = plain(docs, id_col, text_col)
    removed = F.aggregate("_runs", F.lit(0).cast("bigint"), lambda s, r: s + r["stop"] - r["start"])
    rows = _joined(docs, run, id_col, text_col, least).where(F.col(text_col).isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.size(F.split(F.col(text_col), "\n", -1)).cast("bigint").alias("n_lines"), F.coalesce(removed, F.lit(0)).cast("bigint").alias("n_removed"), F.col("_text").alias("text"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = SHORT, run: int = RUN) -> DataFrame:
    """The rows of docs with the text that is left; rows of which nothing is left go."""
    fields = docs.schema.fields
    docs, (id_col, text_col) = plain(docs, id_col, text_col)
    rows = _joined(docs, run, id_col, text_col, least).where("_runs is null or _text is not null")
    out = []
    for own, field in zip(docs.columns, fields, strict=True):
        value = F.col(own)
        if own == text_col:
            value = F.col("_text")
        elif field.name == "n_chars" and field.dataType.typeName() in ("integer", "long"):
            value = F.when(F.col("_runs").isNull(), value).otherwise(F.length("_text").cast(field.dataType))
        out.append(value.alias(own))
    return rows.select(*out).toDF(*[f.name for f in fields])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY p) AS following FROM l
), e AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, p) > 1 AS one,
         following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, p) > 1 AS two
  FROM w
), r AS (
  SELECT *, (one AND length(line) >= {LONG}) OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY p), false) AS gone FROM e
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone) AS text
FROM r GROUP BY doc_id
"""
