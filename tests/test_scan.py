"""Words on Arrow batches, and queries that make each costly step once."""

import random

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from newsloom.functions import anchors as A
from newsloom.functions import arrays, scan
from newsloom.functions import text as T
from newsloom.operators import accounting, windows
from newsloom.plans import catalog

TEXTS = [None, "", " ", "a", " a\n\nb\u00a0c\u3000 ", "\n\n", "\u00e9t\u00e9\u2009\u4e2d\u6587\u3001\u5b57\u200b x\ty \U0001f600", "a\u0085b\u1680c\u2028d\u205fe\u202ff", "x" * 50, "one two.\nThree \r\n\nfour\n"]


def texts(spark):
    rng = random.Random(3)
    more = ["".join(rng.choice("ab.\u00e9\u4e2d \n\t\u3000\u2003\u00a0") for _ in range(rng.randrange(40))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(TEXTS + more)), "i int, t string")


@pytest.mark.parametrize("chunk", [16, 4 << 20])
def test_scan_agrees_with_python(spark, monkeypatch, chunk):
    monkeypatch.setattr(scan, "CHUNK", chunk)
    # in the driver, as workers import the module anew
    import pyarrow as pa

    rows = [r.t for r in texts(spark).collect()]
    made = {}
    monkeypatch.setattr(scan, "_apply", lambda kind, f, *columns: f)
    body = pa.array(rows, pa.string())
    made["words"], made["n"], made["starts"], made["lines"] = (f(None)(body).to_pylist() for f in (scan.words, scan.word_count, scan.word_char_starts, scan.line_starts))
    cuts = [[k for k in range(1, len((t or "").split())) if k % 2] for t in rows]
    parts = scan.cut(None, None, True)(body, pa.array(cuts, pa.list_(pa.int64()))).to_pylist()
    for i, t in enumerate(rows):
        if t is None:
            assert [made[k][i] for k in made] + [parts[i]] == [None] * 5
            continue
        own, at = t.split(), 0
        starts = []
        for w in own:
            starts.append(at := t.index(w, at))
            at += len(w)
        assert (made["words"][i], made["n"][i], made["starts"][i]) == (own, len(own), [*starts, len(t)])
        assert made["lines"][i] == {"n": len(own), "breaks": [k for k in range(1, len(own)) if "\n" in t[starts[k - 1] : starts[k]]]}
        edges = [0, *(starts[c] for c in cuts[i]), len(t)]
        assert parts[i] == [{"a": a, "b": b, "begin": x, "end": y, "text": t[x:y]} for a, b, x, y in zip([0, *cuts[i]], [*cuts[i], len(own)], edges, edges[1:], strict=False)]


def test_ground_agrees_with_localize(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = [rng.choice("abcd") for _ in range(rng.randrange(30))]
        line = lambda n: " ".join(rng.choice("abcdx") for _ in range(n))
        at = rng.randrange(len(words) + 1)
        rows.append((i, words, [(" ".join(words[max(0, at - 12) : at]) or "x", line(rng.randrange(4))), (line(1) + " " + " ".join(words[max(0, at - 9) : at]), line(rng.randrange(3))), (line(rng.randrange(1, 4)), "")]))
    table = spark.createDataFrame(rows, "i int, w array<string>, a array<struct<pre:string,post:string>>")
    for strict in (False, True):
        # pinned: else the anchors are filtered by the optimizer's leave
        one = table.select("i", A.ground(F.col("w"), F.col("a"), strict).alias("g"), F.transform("a", lambda a: A.localize(F.col("w"), a["pre"], a["post"], strict)).alias("l"))
        assert one.where(~F.col("g").eqNullSafe(F.col("l"))).count() == 0


def test_chunks_are_counted_as_the_tokenizer_cuts(spark):
    plain = lambda text: windows.chunk_tokenizer(text)
    words = scan.words(F.col("t"))
    table = texts(spark).where("t is not null").select(words.alias("w"))
    assert table.where(~windows.word_to_token(F.col("w"), windows.chunk_tokenizer).eqNullSafe(windows.word_to_token(F.col("w"), plain))).count() == 0


def test_chain_means(spark):
    table = spark.createDataFrame([([1, 26, 52, 27, 26],), ([],), ([5, 6],), (None,)], "a array<bigint>")
    assert [r[0] for r in table.select(arrays.chain_means(F.col("a"), 25)).collect()] == [[26], [], [6], None]


def plan(spark, name):
    return catalog.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["drop_flagged_accounting", "merge_accounting", "word_to_token_index", "localize_anchors", "window_scores", "parse_anchors", "training_targets"])
def test_documents_are_read_once_and_no_words_by_regular_expressions(spark, name):
    made = plan(spark, name)
    assert made.count("parquet") == 1 and "regexp_extract_all" not in made


def test_windows_are_scored_once(spark):
    made = plan(spark, "segment_documents")
    assert made.count("MapInArrow") == 1 and made.count("parquet") == 2


def test_text_queries_have_small_batches(spark):
    import __spark_entry__ as entry

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for name, most in (("word_to_token_index", "2000"), ("op6_language_id", "10000"), ("word_char_starts", "2000")):
        entry.queries()[name](spark, SMALL)
        assert spark.conf.get(rows) == most
    entry.queries()["op6_language_id"](spark, SMALL)


def test_score_accounting_reads_each_side_once(spark):
    assert plan(spark, "score_accounting").count("parquet") == 2


def test_scored_counts_pairs_of_repeated_and_null_ids(spark):
    gold = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3]), ("b", 5, [1]), (None, 1, [7]), ("c", None, [])], "record_id string, word_count bigint, breaks array<bigint>")
    pred = spark.createDataFrame([("a", 1), ("a", 9), (None, 2), ("c", 4), ("z", 1)], "record_id string, word_count bigint")
    got = accounting.scored(gold, pred).first().asDict()
    assert got == {"n_gold": 5, "n_pred": 5, "n_shared": 3, "n_absent": 2, "at_stake": 2, "n_orphans": 2, "n_drift": 3}


def test_flags_drop_whole_records(spark):
    rows = spark.createDataFrame([("a", 0, 0, 1, "x", []), ("a", 1, 1, 2, "y", ["short"]), ("b", 0, 0, 1, "x", ["short"]), ("c", 0, 0, 1, "x", ["short"]), ("c", 1, 1, 2, "y", [])], "record_id string, index bigint, char_start bigint, char_end bigint, text string, flags array<string>")
    rows = rows.withColumns({"word_start": F.col("index"), "word_end": F.col("index") + 1, "n_cuts": F.lit(1)})
    got = {r.record_id: (r.body, r.outcome, r.error) for r in accounting.merged(rows, drop_flagged=True).collect()}
    assert got == {"a": ("x", "rebuilt", None), "b": (None, "vanished", "every segment was dropped"), "c": (None, "failed", "segments are missing or duplicated")}
