"""Every registered query against its SQL; those without SQL against what they must hold."""

import pytest
from conftest import SMALL

from newsloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_agrees_with_sql(name, agrees):
    agrees(name)


def test_segment_documents_covers_every_document(spark):
    rows = catalog.QUERIES["segment_documents"](spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("text is not null")
    assert sorted(r.record_id for r in rows) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
    for r in rows:
        found = [int(b) for b in r.pred_breaks.split(",") if b]
        assert all(0 < b < r.word_count for b in found) and sorted(found) == found


def test_speaker_paragraphs_keep_words(spark):
    rows = catalog.QUERIES["speaker_paragraphs"](spark, SMALL).orderBy("record_id", "ordinal").collect()
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = {}
    for r in rows:
        found.setdefault(r.record_id, []).append(r.paragraph)
    for key, parts in found.items():
        assert "".join("".join(parts).split()) == "".join(texts[key].split())


def test_no_regular_expression_runs_for_each_break(spark):
    import re

    plan = catalog.QUERIES["segments_rows"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    lambdas = re.findall(r"lambdafunction\((?:[^()]|\([^()]*\))*\)", plan)
    assert lambdas and not any("regexp" in x for x in lambdas)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(r.same for r in entry.entry(spark).collect())
