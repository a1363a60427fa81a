"""The pipeline stage by stage against brute force, and on odd inputs."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).parent))
from helpers import components, differing_bits, docs, drawn, edited, identified, odd  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from newsloom.llm import common, langid, linededup, mixing, simhash  # noqa: E402

STAGES = dict(P.STAGES)


def test_stages(spark, tmp_path):
    import sentencepiece

    def after(name, table):
        STAGES[name](spark, table, SMALL).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in kept.collect()}
        assert kept.columns == table.columns and len(rows) == kept.count()
        return kept, rows

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r for r in table.collect()}

    # language ID: what exact n-gram sets decide, but for what lies on a threshold
    shares = identified(spark, table)
    table, rows = after("language_id", table)
    assert all(rows[i] == before[i] for i in rows)
    for i, own in shares.items():
        best, second, *_ = sorted(own.values(), reverse=True)
        if abs(best - langid.MIN_SHARE) > 0.05 and abs(best - second - langid.MIN_LEAD) > 0.05:
            assert (i in rows) == (best >= langid.MIN_SHARE and best - second >= langid.MIN_LEAD), i
    before = rows

    # line dedup: every run of lines compared with all before it
    left = {i: t for (i, _), t in edited([(r.doc_id, r.text) for r in before.values()], least=linededup.SHORT).items()}
    table, rows = after("line_dedup", table)
    assert {i: r.text for i, r in rows.items()} == {i: t for i, t in left.items() if t is not None}
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in rows.items())
    before = rows

    # near-dedup: all pairs of fingerprints
    prints = simhash.fingerprints(table).orderBy("doc_id").collect()
    f = np.array([[r.f0, r.f1] for r in prints], np.int64).view(np.uint64)
    label = components(len(prints), zip(*np.nonzero(np.triu(differing_bits(f) <= simhash.MOST_BITS, 1)), strict=True))
    # the search misses no pair
    keep = set(before) - {r.doc_id for r, least in zip(prints, label, strict=True) if prints[least].doc_id != r.doc_id}
    table, rows = after("near_dedup", table)
    assert rows == {i: before[i] for i in keep}
    before = rows

    # mixing: exact quotas, and all members
    sizes = Counter(r.source for r in before.values())
    share = {s: n**mixing.TEMPERATURE for s, n in sizes.items()}
    each = sum(sizes.values()) / sum(share.values())
    quota = mixing.fill(sizes, share, round(sum(min(n, each * share[s]) for s, n in sizes.items())))
    hashes = {r.doc_id: r.h for r in table.selectExpr("doc_id", f"xxhash64({mixing.SEED}, doc_id) h").collect()}
    table, rows = after("mix_sources", table)
    assert rows == {i: before[i] for i in drawn([(i, r.source) for i, r in before.items()], hashes, quota, mixing.BLOCK, mixing.SHARD)}

    # encoding, and the pipeline as a whole
    model = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    want = sorted((i, r.lang, r.source, tuple(model.encode(r.text))) for i, r in rows.items())
    made = len(common.Tables.roots)
    got = P.run(spark, SMALL)
    assert got.columns == ["doc_id", "lang", "source", "token_ids", "n_tokens", "round_trip"]
    assert sorted((r.doc_id, r.lang, r.source, tuple(r.token_ids)) for r in got.collect()) == want and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got.collect())
    # what the stages wrote is gone but for the last one's input
    assert len(common.Tables.roots) == made + 1


def test_odd_and_empty_inputs(spark, tmp_path):
    table = odd(spark)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    # texts that are null, empty or blank have no language, and 5 is like no labelled text
    assert ids(P.language_id(spark, table, SMALL)) == [4]
    assert ids(P.line_dedup(spark, table, SMALL)) == ids(table) == ids(P.near_dedup(spark, table, SMALL))
    # a row without an id can't be drawn
    assert ids(P.mix_sources(spark, table, SMALL)) == [1, 2, 3, 4, 5, 5]
    assert ids(P.sentencepiece(spark, table, SMALL)) == ids(table)
    for name, stage in P.STAGES:
        out = stage(spark, table, SMALL)
        assert name == "sentencepiece" or out.columns == table.columns
        assert stage(spark, table.where("false"), SMALL).collect() == [], name
    for name, own, left in (("odd", table, [4]), ("empty", table.where("false"), [])):
        own.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert ids(P.run(spark, str(tmp_path / name))) == left


def test_ties_go_to_the_least_id(spark):
    text = "one line of an ordinary text that has words enough to tell the language of it\nand another one that is like it but not the same"
    rows = [(i, text.replace("one", f"one{i}", 1) + "\n" + "tail " * i, "en", "a") for i in (7, 3, 5)]
    assert [r.doc_id for r in P.near_dedup(spark, docs(spark, rows, extra=True), SMALL).collect()] == [3]


def test_near_dedup_misses_no_pair(spark, monkeypatch):
    # 3000 pairs of documents whose fingerprints differ in exactly the bits that are allowed
    rng = np.random.default_rng(4)
    flips = np.zeros((3000, 128), np.uint8)
    np.put_along_axis(flips, rng.random(flips.shape).argsort(1)[:, : simhash.MOST_BITS], 1, 1)
    a = rng.integers(0, 256, (3000, 16), np.uint8)
    f = np.stack([a, a ^ np.packbits(flips, axis=1)], axis=1).reshape(6000, 16).view(np.int64)
    prints = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(f)], "doc_id bigint, f0 bigint, f1 bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: prints)
    table = docs(spark, [(i, f"text {i}", "en", "a") for i in range(6000)])
    assert sorted(r.doc_id for r in P.near_dedup(spark, table, SMALL).collect()) == list(range(0, 6000, 2))


def test_near_dedup_follows_a_chain_to_its_end(spark):
    # nine texts, each pair of neighbours under one more id; two rounds of the components' edges have equal counts and sums of hashes before the last
    chain = [476, 2802, 2206, 2817, 1087, 2727, 1982, 1447, 122]
    text = {i: " ".join(f"w{i}x{k}" for k in range(40)) for i in chain}
    rows = list(text.items()) + [(5000 + k, text[i]) for k, both in enumerate(zip(chain, chain[1:])) for i in both]
    table = docs(spark, [(i, t, "en", "a") for i, t in rows])
    assert [r.doc_id for r in P.near_dedup(spark, table, SMALL).collect()] == [122]
    found = simhash.groups(table).collect()
    assert {(r.group_id, r.group_size) for r in found} == {(122, 17)} and len(found) == 17
