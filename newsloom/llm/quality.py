"""Quality rules: an isolation forest over rule statistics (operator 9).

Each document's rule statistics (STATISTICS) are computed by array operations
over whole batches.  The forest's trees split random statistics at random
points; a document that is isolated after few splits is anomalous.  With E the
mean path length and c(n) the mean path of an unsuccessful search among n
points, the score is 2 ** (-E / c(n)): near 1 for anomalies.

The labelled documents are halved by a hash of the id.  Each tree is grown on the
SAMPLE rows of one half, all of it, whose hashes for the tree are least, as an
isolation forest's trees are.  The threshold is calibrated on all rows of the other
half: it maximises the share of bad rows above it less LOST_WEIGHT times the share
of good rows above it.  The statistics are computed in one narrow pass and
written; labels are joined to them, not to texts, and scores are ranked in Spark.

Cases.  A null text or one without words has a null score and isn't kept.  A
doc_id with contradicting labels counts as bad.  Without labelled good rows
nothing can be calibrated and every document with words is kept.  Repeated rows
and rows with null ids are scored each.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm import vectext as V
from newsloom.llm.common import Tables, documents, id_text

STATISTICS = ("word_length", "symbols", "upper", "same_as_before", "variety", "symbol_ends", "bars")
#: Ratios are smoothed as if so many usual words were added, lest very short texts look anomalous.
SMOOTH = 20.0
TREES, SAMPLE = 200, 256
#: How many lost bad rows one lost good row weighs.
LOST_WEIGHT = 4.0
_SYMBOL = np.array([32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?" for b in range(256)])
_UPPER = np.array([65 <= b < 91 for b in range(256)])
_LOWER = np.array([97 <= b < 123 for b in range(256)])
_BAR = np.array([b == 124 for b in range(256)])
SLICE = 1 << 21


def statistics(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An (n, len(STATISTICS)) array of the statistics, and the number of words by row."""
    raw, offsets, start, end, row = V.words(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(STATISTICS)))
    count = np.bincount(row, minlength=n)
    bounds = np.searchsorted(start, offsets)
    for i, j in V.slices(offsets, SLICE):
        a, b = bounds[i], bounds[j]
        if a == b:
            continue
        part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        # sums by row from running sums, which are right for empty rows too
        by_row = lambda flag: np.diff(np.append(0, np.cumsum(flag))[own])
        words = count[i:j]
        r = row[a:b] - i
        size = (end - start)[a:b]
        chars = np.bincount(r, weights=size, minlength=j - i)
        h = V.hashes(raw, start[a:b], end[a:b])
        same = np.zeros(b - a)
        same[1:] = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        key = np.sort(r.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
        fresh = np.append(True, key[1:] != key[:-1])
        distinct = np.bincount((key[fresh] >> np.uint64(44)).astype(np.int64), minlength=j - i)
        upper, lower = by_row(_UPPER[part]), by_row(_LOWER[part])
        last = raw[end[a:b] - 1]
        out[i:j] = np.stack(
            [
                (chars + 6.0 * SMOOTH) / (words + SMOOTH),
                by_row(_SYMBOL[part]) / (chars + 6.0 * SMOOTH),
                (upper + 0.15 * SMOOTH) / (upper + lower + 5.0 * SMOOTH),
                np.bincount(r, weights=same, minlength=j - i) / (words + SMOOTH),
                np.log1p(distinct + SMOOTH) / np.log1p(words + SMOOTH),
                np.bincount(r, weights=_SYMBOL[last], minlength=j - i) / (words + SMOOTH),
                by_row(_BAR[part]) / (words + SMOOTH),
            ],
            axis=1,
        )
    return out, count


def mean_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Trees as arrays: statistic (-1 at a leaf), split point or leaf's path length, and the left child (the right one follows)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)]

    @classmethod
    def of(cls, samples: list[np.ndarray], seed: int = 5) -> Forest:
        """A tree for each sample; all have as many rows."""
        forest = cls(samples[0], 0, len(samples[0]), seed)
        rng = np.random.Generator(np.random.PCG64(seed))
        forest.trees = [forest._grow(rows, rng) for rows in samples]
        return forest

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        feature, value, left = [0], [0.0], [0]
        todo = [(0, rows, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            open_ = np.flatnonzero(high > low)
            if depth >= self.depth or len(own) < 2 or not len(open_):
                feature[node], value[node] = -1, depth + mean_path(len(own))
                continue
            f = int(rng.choice(open_))
            cut = rng.uniform(low[f], high[f])
            feature[node], value[node], left[node] = f, cut, len(feature)
            goes = own[:, f] < cut
            for k, part in enumerate((own[goes], own[~goes])):
                feature.append(0), value.append(0.0), left.append(0)
                if len(part):
                    todo.append((left[node] + k, part, depth + 1))
                else:
                    feature[-1], value[-1] = -1, float(depth + 1)
        return np.array(feature), np.array(value), np.array(left)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for feature, value, left in self.trees:
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth + 1):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[at_row, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, left[node] + right, node)
            total += value[node]
        return 2.0 ** (-total / len(self.trees) / max(mean_path(self.sample), 1e-9))


NAMES = [f"s{i}" for i in range(len(STATISTICS))]
#: Scores of a range that are ranked at a time, about.
RANKED = 1 << 18


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, worth (whether there are words) and the statistics of every row."""

    def stage(batches):
        for batch in batches:
            found, count = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count > 0), *[pa.array(found[:, i]) for i in range(len(NAMES))]], ["doc_id", "worth", *NAMES])

    return id_text(docs, id_col, text_col).mapInArrow(stage, "doc_id bigint, worth boolean, " + ", ".join(f"{x} double" for x in NAMES))


def known(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, quality, half (0: forest, 1: threshold) and the statistics of all labelled rows with words."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("l_id"), F.col("quality").cast("int").alias("quality")).where("l_id is not null and quality is not null").groupBy("l_id").agg(F.min("quality").alias("quality"))
    return rows.where("worth").join(own, F.col("doc_id") == F.col("l_id")).select("doc_id", "quality", F.pmod(F.xxhash64("l_id", F.lit(92)), F.lit(2)).cast("int").alias("half"), *NAMES)


def _values(table: pa.Table) -> np.ndarray:
    return np.stack([table[x].to_numpy() for x in NAMES], axis=1) if len(table) else np.zeros((0, len(NAMES)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, quality and half of all labelled documents, as arrays: for tables that fit the driver."""
    table = known(measured(docs, id_col, text_col), labels).toArrow().sort_by("doc_id")
    return _values(table), table["quality"].to_numpy(), table["half"].to_numpy()


def draws(rows: DataFrame, n: int, trees: int = TREES, sample: int = SAMPLE) -> list[np.ndarray]:
    """For each tree the rows, of n, whose hashes for it are least."""
    size, share = min(sample, n), 2.0

    while True:
        limit = np.uint64(min(2**64 - 1, int(2**64 * min(1.0, share * size / n))))

        def stage(batches):
            salt = V.mix(np.arange(1, trees + 1, dtype=np.uint64))
            for batch in batches:
                for k in range(0, batch.num_rows, 4096):
                    part = batch.slice(k, 4096)
                    h = V.mix(V.mix(part.column(0).to_numpy().view(np.uint64))[:, None] ^ salt)
                    row, tree = np.nonzero(h <= limit)
                    yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array((h[row, tree] >> np.uint64(1)).astype(np.int64)), *part.take(pa.array(row)).columns], ["tree", "h", "doc_id", *NAMES])

        found = rows.select("doc_id", *NAMES).mapInArrow(stage, "tree bigint, h bigint, doc_id bigint, " + ", ".join(f"{x} double" for x in NAMES)).toArrow()
        found = found.sort_by([(x, "ascending") for x in ("tree", "h", "doc_id", *NAMES)])
        edges = np.searchsorted(found["tree"].to_numpy(), np.arange(trees + 1))
        if np.diff(edges).min() >= size:
            values = _values(found)
            return [values[x : x + size] for x in edges[:-1]]
        # too few for some tree, which is next to impossible but for ids that repeat
        share *= 4


def threshold(tables: Tables, rows: DataFrame, forest: Forest, lost_weight: float) -> float:
    """The score, of all rows, above which the share of bad ones less lost_weight times that of good ones is greatest; the highest of several."""
    shared = tables.spark.sparkContext.broadcast(forest)

    def stage(batches):
        for batch in batches:
            score = shared.value.scores(_values(pa.Table.from_batches([batch])))
            yield pa.RecordBatch.from_arrays([pa.array(score), batch.column(0)], ["score", "quality"])

    scored = rows.select("quality", *NAMES).mapInArrow(stage, "score double, quality int")
    counts = tables.put(scored.groupBy("score").agg(F.sum((F.col("quality") == 1).cast("bigint")).alias("good"), F.sum((F.col("quality") == 0).cast("bigint")).alias("bad")))
    parts = max(1, -(-counts.count() // RANKED))
    ranged = tables.put(counts.repartitionByRange(parts, F.desc("score")).withColumn("part", F.spark_partition_id()))
    sums = sorted(ranged.groupBy("part").agg(F.sum("good"), F.sum("bad")).collect())
    before, good, bad = [], 0, 0
    for part, more_good, more_bad in sums:
        before.append((part, good, bad))
        good, bad = good + more_good, bad + more_bad
    offsets = tables.spark.createDataFrame(before, "part int, good_before bigint, bad_before bigint")
    above = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(f"{c}_before")
    gain = total("bad") / F.lit(float(max(bad, 1))) - F.lit(float(lost_weight)) * (total("good") / F.lit(float(max(good, 1))))
    best = ranged.join(F.broadcast(offsets), "part").select("score", gain.alias("gain")).orderBy(F.desc("gain"), F.desc("score")).first()
    tables.drop(counts, ranged)
    return best.score


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lost_weight: float = LOST_WEIGHT, rows: DataFrame | None = None) -> tuple[Forest | None, float]:
    """The forest, and the score above which a document isn't kept; rows are the measured docs, if there are any yet."""
    tables = Tables(docs.sparkSession, "quality")
    own = tables.put(known(measured(docs, id_col, text_col) if rows is None else rows, labels))
    n, good = own.agg(F.coalesce(F.sum((F.col("half") == 0).cast("bigint")), F.lit(0)), F.coalesce(F.sum(((F.col("half") == 1) & (F.col("quality") == 1)).cast("bigint")), F.lit(0))).first()
    out = None, 1.0
    if n >= 2 and good:
        forest = Forest.of(draws(own.where("half = 0"), n))
        out = forest, threshold(tables, own.where("half = 1"), forest, lost_weight)
    tables.drop(own)
    return out


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lost_weight: float = LOST_WEIGHT) -> DataFrame:
    """doc_id, score, keep."""
    rows = Tables(docs.sparkSession, "quality").put(measured(docs, id_col, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, lost_weight, rows))

    def stage(batches):
        forest, most = shared.value
        for batch in batches:
            worth = batch.column(1).to_numpy(zero_copy_only=False)
            value = forest.scores(_values(pa.Table.from_batches([batch]))) if forest else np.zeros(len(worth))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, mask=~worth), pa.array(worth & (value <= most))], ["doc_id", "score", "keep"])

    return rows.mapInArrow(stage, "doc_id bigint, score double, keep boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = None
