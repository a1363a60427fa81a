"""The command line: what it writes, what it says about lost records, and how it exits."""

import json
import struct

import pytest

from newsloom import cli
from newsloom.operators import segments, windows
from newsloom.sources import adapter, jsonl

WORDS = " ".join(f"w{i}" for i in range(50))


@pytest.fixture
def folder(tmp_path, spark):
    return tmp_path


def put(path, rows):
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


def read(path):
    return [json.loads(line) for part in sorted(path.glob("part-*")) for line in part.read_text().splitlines()]


def cut(folder, transcripts, predictions, *extra):
    args = ["segments", "--transcripts", put(folder / "t.jsonl", transcripts), "--predictions", put(folder / "p.jsonl", predictions), "--out", str(folder / "s"), *extra]
    code = cli.main(args)
    return code, read(folder / "s")


def pair(record, breaks, body=WORDS, n=None):
    n = len(body.split()) if n is None else n
    return {"record_id": record, "body": body, "outlet": "A"}, {"record_id": record, "word_count": n, "pred_breaks": breaks}


@pytest.mark.parametrize(("bad", "code"), [(None, 0), ([0], 1), ([50.0], 1), ([None], 1), (["30"], 1)])
def test_a_record_that_cannot_be_cut_is_named_and_the_others_are_written(folder, capsys, bad, code):
    rows = [pair(f"r{i}", [25] if i != 3 or bad is None else bad) for i in range(5)]
    got, out = cut(folder, [t for t, _ in rows], [p for _, p in rows])
    assert got == code and len({r["record_id"] for r in out}) == 5 - code and len(out) == 2 * (5 - code)
    assert all(r["outlet"] == "A" for r in out) and ("r3" in capsys.readouterr().out) == bool(code)


@pytest.mark.parametrize("body", [..., None, 12345, ["a", "b"]])
def test_a_transcript_without_a_text_loses_its_own_record_only(folder, body):
    good, bad = pair("ok", [2], "a b c d e"), pair("bad", [2], "a b c d e")
    bad[0].pop("body") if body is ... else bad[0].update(body=body)
    code, out = cut(folder, [good[0], bad[0]], [good[1], bad[1]])
    assert code == 1 and [r["record_id"] for r in out] == ["ok", "ok"]


def test_other_texts_and_missing_transcripts_end_the_run(folder):
    drifted = pair("x", [20], n=49)
    with pytest.raises(SystemExit, match="different text"):
        cut(folder, [drifted[0]], [drifted[1]])
    with pytest.raises(SystemExit, match="no transcript"):
        cut(folder, [drifted[0]], [pair("y", [20])[1]])
    assert not (folder / "s").exists()
    # of a transcript that comes twice the last counts
    assert cut(folder, [{"record_id": "x", "body": "too short"}, drifted[0]], [pair("x", [20])[1]])[0] == 0


def test_columns_of_segments(folder):
    rows = [[x] for x in pair("r", [25])]
    _, full = cut(folder, *rows)
    assert {"word_start", "char_end", "n_words", "outlet", "text"} <= set(full[0])
    _, bare = cut(folder, *rows, "--no-text")
    assert "text" not in bare[0] and bare[1]["char_start"] == full[1]["char_start"]
    _, small = cut(folder, *rows, "--minimal")
    assert all(set(r) == {"record_id", "segment_id", "text", "n_cuts"} and r["n_cuts"] == 1 for r in small)
    with pytest.raises(SystemExit, match="--minimal"):
        cli.main(["merge", "--segments", str(folder / "s"), "--out", str(folder / "m")])


def test_merge_names_records_that_vanish(folder, capsys):
    long, short = pair("A", []), pair("B", [], "a b c")
    cut(folder, [long[0], short[0]], [long[1], short[1]], "--min-words", "10")
    assert cli.main(["merge", "--segments", str(folder / "s"), "--out", str(folder / "all")]) == 0
    assert read(folder / "all") == [{"record_id": "A", "word_count": 50, "body": WORDS}, {"record_id": "B", "word_count": 3, "body": "a b c"}]
    capsys.readouterr()
    assert cli.main(["merge", "--segments", str(folder / "s"), "--out", str(folder / "some"), "--drop-flagged"]) == 1
    said = capsys.readouterr().out
    assert [r["record_id"] for r in read(folder / "some")] == ["A"] and "  - B" in said and "2 record(s) in, 1 out" in said and "biased" in said


def test_score(folder, capsys):
    gold = [{"record_id": f"d{i}", "word_count": 105, "breaks": [50]} for i in range(4)]
    pred = [{"record_id": f"d{i}", "word_count": 105, "pred_breaks": [60]} for i in range(4)]

    def score(preds, *extra):
        return cli.main(["score", "--predictions", put(folder / "p.jsonl", preds), "--gold", put(folder / "g.jsonl", gold), *extra])

    assert score(pred) == 0 and "1.0000" in capsys.readouterr().out
    # half the predictions missing: an error, and with leave half the recall
    assert score(pred[:2]) == 2 and "  - d3" in capsys.readouterr().out
    assert score([*pred[:2], {"record_id": "z", "pred_breaks": []}], "--allow-missing") == 0
    said = capsys.readouterr().out
    assert "0.6667" in said and "1 prediction(s) without gold" in said and "their 2 breaks" in said
    with pytest.raises(SystemExit, match="different text"):
        score([pred[0] | {"word_count": 100}, *pred[1:]])
    with pytest.raises(SystemExit, match="in common"):
        score([{"record_id": "z", "pred_breaks": []}])


def test_reconcile(folder, capsys):
    for name, breaks in (("old", [10, 30]), ("new", [12])):
        t, p = pair("r", breaks)
        cut(folder, [t], [p])
        (folder / "s").rename(folder / name)
    assert cli.main(["reconcile", "--old", str(folder / "old"), "--new", str(folder / "new"), "--out", str(folder / "c")]) == 0
    assert [(r["status"], r["old_id"], r["new_id"], r["start_shift"]) for r in read(folder / "c")] == [("moved", "r#000", "r#000", 0), ("merged", "r#002", "r#001", -18), ("merged", "r#001", "r#001", 2)]
    assert "1 of 3 old ids have one new id; 2 have none" in capsys.readouterr().out


@pytest.fixture
def trained(folder):
    path = folder / "adapter"
    path.mkdir()
    (path / adapter.CONFIG).write_text(json.dumps({"window_tokens": 128, "stride_tokens": 64, "edge_guard_lo": 8}))
    (path / adapter.SETUP).write_text(json.dumps({"trainable_token_indices": {row: [1] for row in adapter.ROWS}}))
    header = json.dumps({f"base.{row}.token_adapter.trainable_tokens_delta": {} for row in adapter.ROWS}).encode()
    (path / adapter.WEIGHTS).write_bytes(struct.pack("<Q", len(header)) + header)
    return path


def test_check_adapter(trained, capsys):
    assert cli.main(["check-adapter", str(trained)]) == 0 and "128 tokens" in capsys.readouterr().out
    (trained / adapter.CONFIG).unlink()
    assert cli.main(["check-adapter", str(trained)]) == 1
    with pytest.raises(FileNotFoundError):
        cli.main(["check-adapter", str(trained / "nowhere")])


def failing(prompt):
    def score(frame):
        if frame["prompt"].str.contains("boom").any():
            raise RuntimeError("out of order")
        return windows.rule_scorer(prompt)(frame)

    return score


def test_run_and_sweep(folder, trained, capsys):
    story = " ".join(f"{'The' if i % 20 == 0 else 'word'}{'.' if i % 20 == 19 else ''}" for i in range(200))
    docs = [{"record_id": f"r{i}", "body": story, "show": "S"} for i in range(4)]
    source = put(folder / "t.jsonl", [*docs, {"record_id": "none", "body": 7}])
    out = ["--out", str(folder / "p"), "--batch-size", "1"]
    assert cli.main(["run", str(trained), "--input", source, "--limit", "4", *out]) == 0
    rows = sorted(read(folder / "p"), key=lambda r: r["record_id"])
    assert [r["record_id"] for r in rows] == ["r0", "r1", "r2", "r3"] and all(r["word_count"] == 200 and r["pred_breaks"] and r["show"] == "S" and "outlet" not in r for r in rows)
    # a record of which a window can't be scored, or that has no text, is named and not written in part
    put(folder / "t.jsonl", [*docs[:3], {"record_id": "r3", "body": "boom " + story}, {"record_id": "none", "body": 7}])
    capsys.readouterr()
    assert cli.main(["run", str(trained), "--input", source, "--scorer", f"{__name__}:failing", *out]) == 1
    said = capsys.readouterr().out
    assert sorted(r["record_id"] for r in read(folder / "p")) == ["r0", "r1", "r2"] and "  - r3: RuntimeError: out of order" in said and "  - none" in said and "5 records in, 3 out" in said
    gold = put(folder / "g.jsonl", [{"record_id": "r0", "word_count": 200, "breaks": rows[0]["pred_breaks"]}])
    assert cli.main(["sweep", str(trained), "--input", source, "--gold", gold, "--out", str(folder / "sweep.json")]) == 0
    swept = json.loads((folder / "sweep.json").read_text())
    assert len(swept) == 11 and swept[-1]["f1"] == 1.0 and swept[-1]["n_firing"] > 0
    put(folder / "g.jsonl", [{"record_id": "elsewhere", "breaks": []}])
    with pytest.raises(SystemExit, match="in common"):
        cli.main(["sweep", str(trained), "--input", source, "--gold", gold])


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "record_id string, k int, note string")
    jsonl.write(table, str(tmp_path / "plain"))
    jsonl.write(table, str(tmp_path / "nulls"), nulls=True)
    assert sorted(map(len, read(tmp_path / "plain"))) == [2, 3] and sorted(map(len, read(tmp_path / "nulls"))) == [3, 3]
    assert json.loads(jsonl.to_array(table.orderBy("k"))) == [{"record_id": "a", "k": 1}, {"record_id": "b", "k": 2, "note": "x"}]
    with pytest.raises(ValueError):
        jsonl.to_array(table, most=1)
    splits = spark.createDataFrame([("a", "train"), ("b", "val")], "record_id string, split string")
    jsonl.write_dataset(table, table.where("false"), splits, str(tmp_path / "set"))
    assert [r["record_id"] for r in read(tmp_path / "set/dataset/split=val")] == ["b"] and len(read(tmp_path / "set/splits")) == 2 and read(tmp_path / "set/rejected_windows") == []
    put(tmp_path / "some.jsonl", [{"record_id": "a", "text": "x"}])
    assert jsonl.read_present(spark, str(tmp_path / "some.jsonl"), "segment").columns == ["record_id", "text"]


def test_review_page(spark):
    from newsloom.sources import review

    events = spark.createDataFrame([("r<1>", "one two & three FOUR: five", [(2, "match", 2, 3, 1), (4, "missed", 4, None, None)])], "record_id string, body string, events array<struct<at:bigint,kind:string,gold:bigint,model:bigint,off:bigint>>")
    page = review.render(events, "a <title>")
    assert "r&lt;1&gt;" in page and "a &lt;title&gt;" in page and page.count("class='mark") == 2
    assert page.index("one two") < page.index("agreed, 1 words apart") < page.index("&amp; three") < page.index("not predicted") < page.index("five")
    with pytest.raises(ValueError):
        review.render(events.union(events), "t", most=1)


def test_minimal_rows_are_refused_with_the_reason(spark):
    with pytest.raises(ValueError, match="--minimal"):
        segments.require_full(spark.createDataFrame([("r#000", "r", "x", 1)], "segment_id string, record_id string, text string, n_cuts int"))
