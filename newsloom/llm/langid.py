"""Language identification with language-bitmask n-gram filters (operator 6).

One bit-sliced Bloom filter holds the byte n-grams of all languages: slot i is
a row of words, one for every 64 languages, whose bit l says that some n-gram of
language l hashes there.  The AND
of an n-gram's slots gives, in one look-up, all languages that contain it.  A
document's n-grams are looked up, the bits are counted by language, and each
count is corrected for the filter's false positives: with N n-grams and a
false-positive rate f (that of the language's own slice), the share is
(count / N - f) / (1 - f).  The language of greatest share wins if the share
reaches MIN_SHARE and leads by MIN_LEAD; otherwise the document is rejected.

Fitting uses a bounded sample of labelled rows, about FIT_ROWS documents of
each language chosen by a hash of the id; an n-gram belongs to a language if at
least MIN_DOCS of the language's sampled documents have it, fewer (down to one)
if there are less than MIN_DOCS * SOME of them.  N-grams are of the
lower-cased text in which every byte that isn't a letter is a space.

Identification is one narrow pass; the filter has a fixed size.

Cases.  A null, empty or letterless text is rejected: null language, share 0.
Ties between languages are rejected (no lead).  Rows with null labels or ids
aren't fitted on, but are identified.  Repeated rows are identified each.
Without any labelled row everything is rejected; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import vectext as V
from newsloom.llm.common import documents, id_text
from newsloom.session import ship

GRAM, SLOTS, HASHES = 5, 1 << 20, 2
#: Bound on the labelled rows that are fitted on, by language (in expectation).
FIT_ROWS = 500
MIN_DOCS = 3
#: Sampled documents of a language for each document that must have an n-gram, up to MIN_DOCS.
SOME = 50
MIN_SHARE, MIN_LEAD = 0.5, 0.05
SLICE = 1 << 20
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[V._LETTER] = np.flatnonzero(V._LETTER).astype(np.uint8)


def grams(column: pa.Array):
    """Yields, for slices of rows, the first row, the n-grams as integers and the row of each, counted from the first."""
    raw, offsets = V.buffers(pc.utf8_lower(V.strings(column)))
    for i, j in V.slices(offsets, SLICE):
        part = _CLEAN[raw[offsets[i] : offsets[j]]].astype(np.uint64)
        own = offsets[i : j + 1] - offsets[i]
        n = len(part) - GRAM + 1
        if n <= 0:
            continue
        code = part[:n].copy()
        for k in range(1, GRAM):
            code |= part[k : k + n] << np.uint64(8 * k)
        row = np.repeat(np.arange(j - i), np.diff(own))[: len(part)]
        blank = np.uint64(sum(32 << 8 * k for k in range(GRAM)))
        ok = (row[:n] == row[GRAM - 1 :]) & (code != blank)
        yield i, code[ok], row[:n][ok]


def slots(code: np.ndarray) -> list[np.ndarray]:
    h = V.mix(code)
    return [((h >> np.uint64(32 * k)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Filter:
    def __init__(self, languages: list[str], sets: list[np.ndarray]):
        self.languages = languages
        self.table = np.zeros((max(1, -(-len(languages) // 64)), SLOTS), np.uint64)
        for k, found in enumerate(sets):
            for s in slots(found.astype(np.uint64)):
                self.table[k // 64][s] |= np.uint64(1) << np.uint64(k % 64)
        fill = [np.count_nonzero(self.table[k // 64] >> np.uint64(k % 64) & np.uint64(1)) / SLOTS for k in range(len(languages))]
        self.false = np.array(fill) ** HASHES

    def masks(self, code: np.ndarray, word: int = 0) -> np.ndarray:
        """Of each n-gram, the languages from 64 * word on that have it."""
        out = None
        for s in slots(code):
            out = self.table[word][s] if out is None else out & self.table[word][s]
        return out

    def shares(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share by row and language, and the number of n-grams by row."""
        n = len(column)
        counts, total = np.zeros((n, len(self.languages))), np.zeros(n, np.int64)
        for first, code, row in grams(column):
            size = int(row.max()) + 1 if len(row) else 0
            total[first : first + size] += np.bincount(row, minlength=size)
            for k in range(len(self.languages)):
                if k % 64 == 0:
                    mask = self.masks(code, k // 64)
                counts[first : first + size, k] += np.bincount(row, weights=(mask >> np.uint64(k % 64) & np.uint64(1)).astype(np.float64), minlength=size)
        share = (counts / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false)
        return np.where(total[:, None] > 0, np.maximum(share, 0), 0), total

    def decide(self, column: pa.Array) -> tuple[list[str | None], np.ndarray]:
        share, _ = self.shares(column)
        if not self.languages:
            return [None] * len(column), np.zeros(len(column))
        order = np.sort(share, axis=1)
        best = order[:, -1]
        lead = best - (order[:, -2] if share.shape[1] > 1 else 0)
        sure = (best >= MIN_SHARE) & (lead >= MIN_LEAD)
        return [self.languages[b] if s else None for b, s in zip(share.argmax(1), sure, strict=True)], best


def least_docs(n: int) -> int:
    """Of n sampled documents of a language, how many must have an n-gram that is to count."""
    return min(MIN_DOCS, max(1, n // SOME))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Filter:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in docs.select(F.col(lang_col).cast("string").alias("lang")).where("lang is not null").groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Filter([], [])
    take = F.coalesce(*[F.when(F.col("lang") == name, F.lit(int(min(1.0, fit_rows / sizes[name]) * 1_000_000))) for name in languages])
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)) < take)

    def stage(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for name in set(langs):
                own = batch.column(0).filter(pc.equal(batch.column(1), name))
                once = [np.unique(row.astype(np.uint64) << np.uint64(8 * GRAM) | code) & np.uint64((1 << 8 * GRAM) - 1) for _, code, row in grams(own)]
                found, count = np.unique(np.concatenate(once), return_counts=True) if once else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(count.astype(np.int64))], ["lang", "gram", "n"])

    sampled = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    few = F.coalesce(*[F.when(F.col("lang") == name, F.lit(least_docs(n))) for name, n in sampled.items() if n < MIN_DOCS * SOME], F.lit(MIN_DOCS))
    kept = sample.select("text", "lang").mapInArrow(stage, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") >= few)
    table = kept.select("lang", "gram").toArrow()
    found = {name: table.filter(pc.equal(table["lang"], name))["gram"].to_numpy() for name in languages}
    return Filter(languages, [found[name] for name in languages])


def identify(docs: DataFrame, model: Filter | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, language (null if rejected), share."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col))

    def stage(batches):
        for batch in batches:
            language, share = shared.value.decide(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(share)], ["doc_id", "language", "share"])

    return id_text(docs, id_col, text_col).mapInArrow(stage, "doc_id bigint, language string, share double")


def keep_identified(docs: DataFrame, model: Filter | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language was told, all columns as they are; one narrow pass."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, id_col, text_col))

    def stage(batches):
        for batch in batches:
            language, _ = shared.value.decide(batch.column(at))
            yield batch.filter(pa.array([x is not None for x in language], pa.bool_()))

    return docs.mapInArrow(stage, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


SQL = None
