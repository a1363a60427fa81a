"""Substring dedup by recompression (operator 8).

A passage is repeated if its WORDS consecutive words occur at two places, in
different documents or in one.  Result: the maximal spans of words covered by
such passages, in every document that has any.

Symbols by recompression.  A text is a string of word symbols.  First the maximal
runs of a word are named; then each round names the pairs of neighbours whose
first symbol is in the round's left half of the alphabet and whose second is in
the right half.  A symbol of SPAN or more words is final.  Names are global: each is a hash
of what it stands for, hence the same in every document, so that a round needs
no shuffled dictionary and all rounds take one narrow pass.

Why nothing is missed.  With each symbol goes its context, the words from which
alone follows that it is formed: those of the symbol, and those of each neighbour that one of its
parts looked at without joining.  A final symbol whose context lies within a passage
is therefore formed wherever the passage occurs.  A passage that holds no such
symbol (one that is periodic, or that was parsed unluckily) holds none anywhere, and has its least hash of SPAN words for a
symbol instead, which is a function of the passage too.  So all places of a
passage share all symbols that it holds, and it has one at least.  ROUNDS bounds
the rounds; symbols that are still open then are such a case.

Candidates are the passages all of whose symbols occur at two different places (of texts,
by hash: copies of a text are one).  The symbols are counted by aggregation and a
second pass forms them again, which is cheaper than to keep them.

Verification.  Candidates are named by two independent 64-bit hashes and
aggregated; a span is reported only if a passage truly recurs.  Documents with equal texts
are found by a hash of the text beforehand; one of them stands for all.  Nowhere
does a frequent symbol or passage gather in one task: both are aggregated where they lie, and
joined back by key, where adaptive execution splits a frequent one's rows.

Cases.  Words are separated by ASCII white space.  Null texts and texts of fewer
than WORDS words have no spans.  Rows that repeat id and text are one document;
rows of one id with different texts count as one place where passages of both
begin at the same word.  Rows with a null id are left out.  Of equal documents the least doc_id is the first copy.
An empty table has no spans.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import vectext as V
from newsloom.llm.common import Tables, documents

WORDS, SPAN, ROUNDS = 50, 8, 20
SLICE = 1 << 20


def recompress(symbols: np.ndarray, last: np.ndarray, span: int = SPAN, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, first word, and first and last word of the context, of the final symbols whose context isn't longer than a passage; `last` marks the last word of each text.

    Where a symbol looked beyond its text, the context takes in the place beyond, which is in no passage.
    """
    same = np.zeros(len(symbols), bool)
    same[1:] = (symbols[1:] == symbols[:-1]) & ~last[:-1]
    start = np.flatnonzero(~same)
    size = np.diff(np.append(start, len(symbols)))
    last = last[start + size - 1]
    names = symbols[start].copy()
    run = size > 1
    names[run] = V.pair(names[run], size[run].astype(np.uint64), 11)
    low, high = start - 1, start + size
    out: list[tuple[np.ndarray, ...]] = []

    def take(final: np.ndarray) -> None:
        short = final & (high - low < words)
        out.append((names[short], start[short], low[short], high[short]))

    for turn in range(ROUNDS):
        open_ = size < span
        pair = np.zeros(len(names), bool)
        pair[:-1] = open_[:-1] & open_[1:] & ~last[:-1] & (names[:-1] != names[1:])
        if not pair.any():
            break
        right = V.mix(names + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(40) & np.uint64(1) == 1
        joins = np.flatnonzero(pair & ~right & np.append(right[1:], False))
        joined = np.zeros(len(names), bool)
        joined[joins] = joined[joins + 1] = True
        # an open symbol that didn't join looked at the neighbour on its side
        new_low, new_high = low.copy(), high.copy()
        looks = open_ & ~joined
        at = np.flatnonzero(looks & ~right)
        inner = at[~last[at]]
        new_low[inner], new_high[inner] = np.minimum(low[inner], low[inner + 1]), np.maximum(high[inner], high[inner + 1])
        outer = at[last[at]]
        new_high[outer] = np.maximum(high[outer], start[outer] + size[outer])
        at = np.flatnonzero(looks & right)
        begins = np.append(True, last[:-1])
        inner = at[~begins[at]]
        new_low[inner], new_high[inner] = np.minimum(low[inner], low[inner - 1]), np.maximum(high[inner], high[inner - 1])
        outer = at[begins[at]]
        new_low[outer] = np.minimum(low[outer], start[outer] - 1)
        new_low[joins] = np.minimum(low[joins], low[joins + 1])
        new_high[joins] = np.maximum(high[joins], high[joins + 1])
        names, size, last = names.copy(), size.copy(), last.copy()
        names[joins] = V.pair(names[joins], names[joins + 1], 2 * turn + 12)
        size[joins] += size[joins + 1]
        last[joins] = last[joins + 1]
        keep = np.ones(len(names), bool)
        keep[joins + 1] = False
        names, start, size, last, low, high = names[keep], start[keep], size[keep], last[keep], new_low[keep], new_high[keep]
    take(size >= span)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _passages(h: np.ndarray, words: int, salt: int) -> np.ndarray:
    """Names of all passages of so many words, by doubling."""
    own, size = V.mix(h + np.uint64(salt)), 1
    while 2 * size <= words:
        own = V.pair(own[: len(own) - size], own[size:], size + salt)
        size *= 2
    rest = words - size
    return V.pair(own[: len(own) - rest], own[rest:], size + salt + 1) if rest else own


def _first_end(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """For each word the least end of the ranges that begin there or later."""
    ends = np.full(n + 1, np.iinfo(np.int64).max)
    inside = (low >= 0) & (low < n)
    np.minimum.at(ends, low[inside], high[inside])
    return np.minimum.accumulate(ends[::-1])[::-1][:n]


def anchors(h: np.ndarray, last: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of the passages of texts that are joined to one string of word hashes.

    Name, place (the first word; of the least hash of SPAN words -1 less it), and first and last word of the context of each symbol; then the first word
    of each passage, and the place of the least hash that stands for it (0 if it holds other symbols).
    """
    n = len(h)
    name, start, low, high = recompress(h, last, words=words)
    ends = np.flatnonzero(last)
    stop = ends[np.searchsorted(ends, np.arange(n))] + 1
    at = np.flatnonzero(np.arange(n) + words <= stop)
    bare = at[_first_end(low, high, n)[at] >= at + words]
    least = np.zeros(len(bare), np.int64)
    if len(bare):
        grams = _passages(h, SPAN, 2001)
        steps = np.arange(words - SPAN + 1)
        for i in range(0, len(bare), 1 << 16):
            part = bare[i : i + (1 << 16)]
            least[i : i + len(part)] = part + grams[part[:, None] + steps].argmin(1)
        places = np.unique(least)
        name = np.concatenate([name, V.mix(grams[places])])
        start, low, high = np.concatenate([start, -1 - places]), np.concatenate([low, places]), np.concatenate([high, places + SPAN - 1])
    stands = np.zeros(len(at), np.int64)
    stands[np.searchsorted(at, bare)] = -1 - least
    return name, start, low, high, at, stands


def candidates(place: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, stands: np.ndarray, shared: np.ndarray, n: int, words: int = WORDS) -> np.ndarray:
    """The first words of the passages all of whose symbols are shared."""
    plain = place >= 0
    alone = plain & ~shared
    good = (stands != 0) | (_first_end(low[alone], high[alone], n)[at] >= at + words)
    bare = stands != 0
    good[bare] = np.isin(stands[bare], place[~plain & shared])
    return at[good]


def _sliced(texts: pa.Array, rows: np.ndarray):
    """Yields word hashes, the marks of last words, the row of each word and its place in the row, for slices of the given rows."""
    # cut into slices before words are looked for, so that a worker holds the words of one slice
    for i, j in V.slices(V.buffers(texts)[1], SLICE):
        wanted = rows[(rows >= i) & (rows < j)]
        raw, _, start, end, own = V.words(texts.take(pa.array(wanted)))
        if len(start):
            yield V.hashes(raw, start, end), np.append(own[1:] != own[:-1], True), wanted[own], np.arange(len(own)) - np.searchsorted(own, own)


def _placed(place: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of symbols, and their places in these."""
    first = np.where(place >= 0, place, -1 - place)
    return own[first], np.where(place >= 0, at[first], -1 - at[first])


def _symbols(batches):
    for batch in batches:
        for h, last, own, at in _sliced(batch.column(1), np.arange(len(batch))):
            name, place, *_ = anchors(h, last)
            rows, places = _placed(place, own, at)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column(0).take(pa.array(rows)), pa.array(places.astype(np.int32))], ["symbol", "t", "p"])


def _windows(batches):
    for batch in batches:
        ids, texts, kinds, marks = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy(), batch.column(3)
        # markers: this document has equals, and is the first (1) or a later one (2) of them
        twin = np.flatnonzero(kinds > 0)
        size = np.zeros(len(ids), np.int64)
        for _, _, own, _ in _sliced(texts, twin):
            size += np.bincount(own, minlength=len(ids))
        twin = twin[size[twin] >= WORDS]
        yield _batch(ids[twin], size[twin], ids[twin], -kinds[twin])
        code = lambda rows, places: rows.astype(np.int64) << 33 | places.astype(np.int64) + (1 << 32)
        marked = code(np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(marks), 0).to_numpy()), marks.flatten().to_numpy())
        wanted = np.flatnonzero((kinds < 2) & marks.is_valid().to_numpy(zero_copy_only=False))
        for h, last, own, at in _sliced(texts, wanted):
            _, place, low, high, begin, stands = anchors(h, last)
            shared = np.isin(code(*_placed(place, own, at)), marked)
            begin = candidates(place, low, high, begin, stands, shared, len(h))
            if len(begin):
                yield _batch(_passages(h, WORDS, 1)[begin].view(np.int64), _passages(h, WORDS, 1001)[begin].view(np.int64), ids[own[begin]], at[begin])


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(kind)) for x, kind in zip(columns, (np.int64, np.int64, np.int64, np.int32), strict=True)], ["w1", "w2", "d", "p"])


def _spans(batches):
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for d, at, later in zip(*(batch.column(i) for i in range(3)), strict=True):
            p, late = at.values.to_numpy(), later.values.to_numpy(zero_copy_only=False)
            order = np.argsort(p, kind="stable")
            p, late = p[order], late[order]
            cut = np.flatnonzero(np.append(True, p[1:] > p[:-1] + WORDS))
            first, stop = p[cut], p[np.append(cut[1:], len(p)) - 1] + WORDS
            covered = np.zeros(int(stop[-1]) + 1, np.int64)
            np.add.at(covered, p[late], 1)
            np.add.at(covered, p[late] + WORDS, -1)
            total = np.append(0, np.cumsum(np.cumsum(covered) > 0))
            rows[0] += [d.as_py()] * len(cut)
            rows[1].append(first), rows[2].append(stop), rows[3].append(total[stop] - total[first])
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(np.concatenate(x).astype(np.int64)) for x in rows[1:]]], ["doc_id", "start_word", "end_word", "n_later"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_later: how many words of the span are in a later copy."""
    tables = Tables(docs.sparkSession, "substrings")
    own, text = F.col(id_col).cast("bigint"), F.col(text_col)
    rows = docs.where(own.isNotNull() & text.isNotNull()).select(own.alias("d"), text.alias("text"))
    key = F.xxhash64("d", "t1").alias("k")
    # equal documents, by a 128-bit hash of the text; only hashes are shuffled
    prints = rows.select("d", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")).distinct()
    equals = tables.put(prints.groupBy("t1", "t2").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n")))
    kinds = prints.join(equals.where("n > 1"), ["t1", "t2"]).select(key, F.when(F.col("d") == F.col("least"), 1).otherwise(2).alias("kind"))
    # symbols at two different places; the same place of copies is one
    symbols = rows.select(F.xxhash64("text").alias("t"), "text").mapInArrow(_symbols, "symbol bigint, t bigint, p int")
    place = F.xxhash64("t", "p")
    shared = tables.put(symbols.groupBy("symbol").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("symbol"))
    marks = symbols.join(shared, "symbol").groupBy("t").agg(F.collect_set("p").alias("marks"))
    first = equals.select(F.col("t1").alias("t"), F.col("t1"), F.col("least").alias("d"))
    marks = marks.join(first, "t").select(key, "marks")
    marked = tables.put(marks.join(kinds, "k", "full").select("k", F.coalesce("kind", F.lit(0)).alias("kind"), "marks"))
    found = tables.put(rows.withColumn("t1", F.xxhash64("text")).withColumn("k", key).join(marked, "k").select("d", "text", "kind", "marks").mapInArrow(_windows, "w1 bigint, w2 bigint, d bigint, p int"))
    here = F.struct("d", "p")
    again = found.where("p >= 0").groupBy("w1", "w2").agg(F.min(here).alias("least"), F.max(here).alias("most")).where("least <> most").select("w1", "w2", "least")
    later = found.where("p >= 0").join(again, ["w1", "w2"]).select("d", "p", (here > F.col("least")).alias("later"), F.lit(None).cast("bigint").alias("n"))
    later = later.union(found.where("p < 0").select("d", "p", F.lit(None).cast("boolean"), F.col("w2")))
    by_doc = later.groupBy("d").agg(F.collect_list(F.when(F.col("p") >= 0, F.struct("p", "later"))).alias("at"), F.max("n").alias("n"), F.min("p").alias("kind"))
    # a document with equals is repeated as a whole: passages from its first word to its last
    every = F.transform(F.sequence(F.lit(0), (F.col("n") - WORDS).cast("int")), lambda i: F.struct(i.alias("p"), (F.col("kind") == -2).alias("later")))
    by_doc = by_doc.select("d", F.when(F.col("n").isNotNull(), F.concat("at", every)).otherwise(F.col("at")).alias("at"))
    out = tables.put(by_doc.select("d", F.col("at.p").alias("p"), F.col("at.later").alias("later")).mapInArrow(_spans, "doc_id bigint, start_word bigint, end_word bigint, n_later bigint"))
    tables.drop(equals, shared, marked, found)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))


SQL = f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\r\\v\\f]+') AS words FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), s AS (
  SELECT doc_id, p, md5(array_to_string(list_slice(words, p + 1, p + {WORDS}), ' ')) AS passage
  FROM (SELECT doc_id, words, unnest(range(0, len(words) - {WORDS} + 1)) AS p FROM w WHERE len(words) >= {WORDS})
), c AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY passage ORDER BY doc_id, p) > 1 AS later, count(*) OVER (PARTITION BY passage) AS n FROM s
), m AS (
  SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {WORDS} THEN 0 ELSE 1 END AS fresh FROM c WHERE n > 1
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM m
), l AS (
  SELECT doc_id, span, p, lag(p) OVER (PARTITION BY doc_id, span ORDER BY p) AS before FROM g WHERE later
), n AS (
  SELECT doc_id, span, sum(least({WORDS}, p - coalesce(before, p - {WORDS}))) AS n_later FROM l GROUP BY doc_id, span
), r AS (
  SELECT doc_id, span, min(p) AS start_word, max(p) + {WORDS} AS end_word FROM g GROUP BY doc_id, span
)
SELECT r.doc_id, r.start_word, r.end_word, CAST(coalesce(n.n_later, 0) AS BIGINT) AS n_later
FROM r LEFT JOIN n ON r.doc_id = n.doc_id AND r.span = n.span
"""
