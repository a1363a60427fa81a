"""Exact top-k search by tiled matrix products (operator 4).

Vectors are packed into tiles of about TILE rows by a hash of the row, those of
queries and those of all rows (shards).  The tiles lie along the sides of a grid of cells of
at most BLOCK tiles a side; a query tile is sent to the cells of its row, a shard
tile to those of its column, and each cell is a group of its own, so that the
products are spread evenly over tasks.  A pair of tiles is one matrix product, of which
only each query's best k are kept (partial selection); the lists of a query are
merged over the tiles of the cell and then over the cells in a tree of fan-in FAN,
one shuffle of k entries a query and list at each level.  There is no other way than to compare all
pairs: the work is the number of queries times that of rows.

`queries` says which rows are queries: all, or as in the registered query those
whose id is divisible by EVERY.  Each is compared with all rows.  The score is the cosine, rounded
to 9 digits for ranking so that the order of summation can't decide; ties go to
the lesser id.

Cases.  Rows with a null id, a null or empty vector, or a null or non-finite
element are left out.  Vectors are only compared with those of the same length.
A zero vector has score 0 with everything.  Rows that repeat id and vector
count once; rows of one id are never each other's neighbours, and an id with
several vectors is a query with each.  Fewer than k
others give shorter lists, an empty table none.  Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import Tables

K, EVERY = 10, 50
#: Rows of a tile (in expectation), lists merged at a time, queries of a product, tiles along a cell's side at most.
TILE, FAN, CHUNK, BLOCK = 2048, 8, 512, 64
_PACK = "tile int, width int, ids binary, vectors binary"
_LISTS = "q int, width int, s int, owners binary, ids binary, scores binary"


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    ids = table["vec_id"].to_numpy()
    width = key[1].as_py()
    vectors = table["embedding"].combine_chunks()
    vectors = (pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    order = np.lexsort((*vectors.T[:1], ids))
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)
    return pa.table({"tile": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([width], pa.int32()), "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([unit[order].tobytes()], pa.binary())})


def best(owners: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k best entries, ties to the lesser id; entries of -inf are none, with id -1."""
    n, m = scores.shape
    if m > 4 * k:
        least = np.partition(scores, m - k, axis=1)[:, m - k]
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        row, col = np.nonzero(scores > -np.inf)
    value, found = scores[row, col], ids[col] if ids.ndim == 1 else ids[row, col]
    order = np.lexsort((found, -value, row))
    row, value, found = row[order], value[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    keep = place < k
    out_ids, out = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    out_ids[row[keep], place[keep]], out[row[keep], place[keep]] = found[keep], value[keep]
    return out_ids, out


def _merged(owners: np.ndarray, a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    return b if a is None else best(owners, np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1), k)


def top_k(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE, queries: Column | None = None) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, score (rounded to 9 digits); queries is a condition on vec_id and embedding."""
    spark = vectors.sparkSession
    tables = Tables(spark, "topk")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = tables.put(rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine)).distinct())

    def packed(own: DataFrame) -> tuple[DataFrame, int]:
        n = max(1, math.ceil(own.count() / tile))
        keyed = own.withColumn("tile", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")).withColumn("width", F.size("embedding"))
        return tables.put(keyed.groupBy("tile", "width").applyInArrow(_pack, _PACK)), n

    shards, n_shards = packed(rows)
    asking, n_asking = (shards, n_shards) if queries is None else packed(rows.where(queries))
    # cells enough for all cores, each of bounded size
    down = math.ceil(n_asking / BLOCK)
    across = min(n_shards, max(math.ceil(n_shards / BLOCK), math.ceil(4 * spark.sparkContext.defaultParallelism / down)))

    def placed(df: DataFrame, asks: bool) -> DataFrame:
        line = F.pmod(F.col("tile"), F.lit(down if asks else across))
        every = F.sequence(F.lit(0), F.lit((across if asks else down) - 1))
        cell = F.transform(every, lambda x: line * across + x if asks else x * across + line)
        return df.select(F.explode(cell).alias("cell"), "width", F.lit(asks).alias("asks"), "tile", "ids", "vectors")

    def products(key: tuple, table: pa.Table) -> pa.Table:
        cell, width = key[0].as_py(), key[1].as_py()
        tiles = [(r["asks"], r["tile"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, width)) for r in table.select(["asks", "tile", "ids", "vectors"]).to_pylist()]
        out = []
        for _, q, owners, own in (x for x in tiles if x[0]):
            lists = None
            for _, _, ids, other in (x for x in tiles if not x[0]):
                found, scores = [], []
                for i in range(0, len(own), CHUNK):
                    product = np.round(own[i : i + CHUNK] @ other.T, 9) + 0.0
                    product[owners[i : i + CHUNK, None] == ids[None, :]] = -np.inf
                    a, b = best(owners[i : i + CHUNK], ids, product, k)
                    found.append(a), scores.append(b)
                lists = _merged(owners, lists, (np.concatenate(found), np.concatenate(scores)), k)
            if lists:
                out.append({"q": q, "width": width, "s": cell % across, "owners": owners.tobytes(), "ids": lists[0].tobytes(), "scores": lists[1].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("q", pa.int32()), ("width", pa.int32()), ("s", pa.int32()), ("owners", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())]))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        lists, merged = table.to_pylist(), None
        owners = np.frombuffer(lists[0]["owners"], np.int64)
        for x in lists:
            merged = _merged(owners, merged, (np.frombuffer(x["ids"], np.int64).reshape(-1, k), np.frombuffer(x["scores"]).reshape(-1, k)), k)
        return pa.table({"q": pa.array([key[0].as_py()], pa.int32()), "width": pa.array([key[1].as_py()], pa.int32()), "s": pa.array([key[2].as_py()], pa.int32()), "owners": [lists[0]["owners"]], "ids": [merged[0].tobytes()], "scores": [merged[1].tobytes()]})

    def rows_of(batches):
        for batch in batches:
            for r in batch.to_pylist():
                owners, ids, scores = np.frombuffer(r["owners"], np.int64), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["scores"])
                keep = scores > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(owners, k)[keep]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(owners))[keep]), pa.array(ids[keep]), pa.array(scores[keep])], ["query_id", "rank", "neighbor_id", "score"])

    cells = placed(asking, True).union(placed(shards, False))
    # a stated number of partitions, which isn't reduced for being small: the work is in the tasks
    lists = cells.repartition(down * across, "cell", "width").groupBy("cell", "width").applyInArrow(products, _LISTS)
    n = across
    while n > 1:
        n = math.ceil(n / FAN)
        lists = lists.withColumn("s", F.floor(F.col("s") / FAN).cast("int")).groupBy("q", "width", "s").applyInArrow(merge, _LISTS)
    out = tables.put(lists.mapInArrow(rows_of, "query_id bigint, rank int, neighbor_id bigint, score double"))
    tables.drop(rows, shards, *([] if asking is shards else [asking]))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows whose id is divisible by EVERY, each against all rows."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.pmod("vec_id", F.lit(EVERY)) == 0)


SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
), n AS (SELECT vec_id, e, len(e) AS w, sqrt(list_dot_product(e, e)) AS norm FROM v),
s AS (
  SELECT a.vec_id AS query_id, a.e AS own, b.vec_id AS neighbor_id,
         CASE WHEN a.norm = 0 OR b.norm = 0 THEN 0 ELSE round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 9) END AS score
  FROM n a JOIN n b ON a.w = b.w AND a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank, neighbor_id, score FROM s
)
SELECT query_id, rank, neighbor_id, score FROM r WHERE rank <= {K}
"""
