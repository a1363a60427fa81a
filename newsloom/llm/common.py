"""Tables that cut lineage, and the choice of the columns an operator works on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.session import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a small table, of fewer partitions than there are cores, is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where nothing else is set, one of our own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


class Tables:
    """Parquet tables in the shared folder.  What is computed from them survives the loss of an executor.

    An operator drops its tables but for those that its result still reads; `drop_since` drops these
    once that result is written.
    """

    roots: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.made = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.roots.append(self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._newsloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for table in tables:
            _delete(self.spark, table._newsloom_path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_since(spark: SparkSession, made: int) -> None:
    """Delete the tables of all operators that began when so many had (len(Tables.roots))."""
    while len(Tables.roots) > made:
        _delete(spark, Tables.roots.pop())


def plain(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """docs with columns named c0, c1, ..., so that no name of an operator's own can clash, and what some are now called."""
    ship(docs.sparkSession)
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(c)}" for c in columns]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns, by fixed names, so that no other column of the input can clash."""
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
