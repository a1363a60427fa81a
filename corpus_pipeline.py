"""Five stages that turn raw documents into encoded training text.

Language ID, line dedup, SimHash near-dedup, mixing sources to target weights
and SentencePiece encoding, in this order.  Each stage takes (spark, docs,
sf_dir) and works on all rows that the one before it kept.  All but the last
return the columns of documents, whatever else these hold and however they are named.

Cases.  Null, empty, blank and letterless texts have no language, so the first
stage drops them; of the later ones line dedup, near-dedup and encoding would
keep them (with null tokens for a null text).  Rows with a null id or source go
through all stages but the fourth, which can't draw a row without an id.  Long
texts are whole texts everywhere.  Rows that repeat id and text are one document
and stay together.  Ties: of copies the one of the least doc_id stays.  An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import langid, linededup, mixing, pieces, simhash
from newsloom.llm.common import Tables, drop_since


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs; documents of which nothing is left go."""
    return linededup.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources, shard by shard in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, token_ids, n_tokens and round_trip: whether decoding gives the text again."""
    return pieces.encode(docs, keep=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Bloom filters, fingerprints and random draws are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again; a result goes when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, before = Tables(spark, "pipeline"), []
    made = len(Tables.roots)
    for _, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir))
        tables.drop(*before)
        drop_since(spark, made)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
