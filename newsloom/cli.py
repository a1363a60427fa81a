"""Command line.

    python -m newsloom check-adapter ADAPTER
    python -m newsloom run ADAPTER --input T --out P
    python -m newsloom sweep ADAPTER --input T --gold G
    python -m newsloom score --predictions P --gold G
    python -m newsloom segments --transcripts T --predictions P --out S
    python -m newsloom merge --segments S --out T
    python -m newsloom reconcile --old S --new S

Inputs are files or folders of JSON lines; outputs are folders of them.  A command
that lost a record names it and doesn't exit with 0.
"""

from __future__ import annotations

import argparse
import importlib
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import accounting, metrics, postprocess, reconcile, segments, windows
from newsloom.sources import adapter, jsonl

SHOWN = 10
STATUSES = ("same", "moved", "split", "merged", "added", "removed")


def _spark() -> SparkSession:
    return SparkSession.builder.appName("newsloom").getOrCreate()


def _names(df: DataFrame, *columns: str) -> list[str]:
    """The first few rows, a line each."""
    return ["  - " + ": ".join(str(x) for x in r) for r in df.select(*columns).orderBy("record_id").limit(SHOWN).collect()]


def _tell(df: DataFrame, what: str, *columns: str) -> int:
    """Print how many rows there are and the first of them; nothing if there are none."""
    n = df.count()
    if n:
        print(f"\n{n} {what}:")
        print("\n".join(_names(df, *columns)))
        if n > SHOWN:
            print(f"  and {n - SHOWN} more")
    return n


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df.orderBy("ordinal").limit(limit) if limit else df


def _plugin(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _transcripts(spark: SparkSession, path: Path) -> DataFrame:
    return jsonl.read_strict(spark, str(path), {"body": "string"}, {c: "string" for c in accounting.CARRIED} | {"word_count": "bigint"})


def _scores(args: argparse.Namespace, docs: DataFrame, n: int) -> DataFrame:
    folder = adapter.resolve(args.adapter, args.revision)
    prompt = adapter.prompt(folder)
    decode = windows.DecodeSpec(gen_batch_size=args.batch_size)
    parts = max(1, math.ceil(n / args.chunk)) if getattr(args, "chunk", None) else None
    return windows.score_windows(docs, adapter.geometry(folder), _plugin(args.scorer)(prompt), _plugin(args.tokenizer), prompt, decode, parts)


def check_adapter(args: argparse.Namespace) -> int:
    folder = adapter.resolve(args.adapter, args.revision)
    found = adapter.verify(folder)
    print(f"adapter: {folder}")
    if (folder / adapter.CONFIG).exists():
        g, p = adapter.geometry(folder), adapter.prompt(folder)
        print(f"windows of {g.window_tokens} tokens every {g.stride_tokens}, guard {g.edge_guard_lo}; anchors of {p.anchor_pre_words} and {p.anchor_post_words} words")
    print("\n".join([f"{len(found)} problem(s):", *[f"  - {x}" for x in found]]) if found else "no problems")
    return int(bool(found))


def run(args: argparse.Namespace) -> int:
    spark = _spark()
    docs = _first(_transcripts(spark, args.input), args.limit)
    n = docs.count()
    bad = docs.where("body is null").select("record_id", "error")
    good = docs.where("body is not null")
    scores = _scores(args, good, n).persist()
    found = windows.segment_documents(scores, good, args.tau).withColumns({"adapter": F.lit(str(args.adapter)), "adapter_revision": F.lit(args.revision)})
    jsonl.write(found, str(args.out))
    written = jsonl.read(spark, str(args.out), "prediction").count()
    print(f"{n} records in, {written} out ({args.out})")
    lost = _tell(bad.unionByName(windows.lost(scores)), "record(s) aren't in the output", "record_id", "error")
    return int(bool(lost) or written != n)


def sweep(args: argparse.Namespace) -> int:
    spark = _spark()
    docs = _first(_transcripts(spark, args.input), args.limit).where("body is not null")
    gold = jsonl.read(spark, str(args.gold), "annotation").select("record_id", F.array_sort("breaks").alias("breaks"))
    docs = docs.join(gold.select("record_id"), "record_id", "left_semi")
    n = docs.count()
    if not n:
        raise SystemExit(f"{args.input} and {args.gold} have no record_id in common")
    scores = _scores(args, docs, n).persist()
    failed = _tell(windows.lost(scores), "record(s) couldn't be scored and are left out", "record_id", "error")
    usable = scores.join(windows.lost(scores).select("record_id"), "record_id", "left_anti")
    greedy = postprocess.greedy_would_fire(usable).first()
    print(f"{n} documents, {greedy.n_windows} windows; greedy decoding would fire in {greedy.n_greedy}")
    swept = postprocess.sweep(usable, gold, tuple(args.thresholds), args.tolerance).orderBy("rank").persist()
    print(f"{'tau':>8} {'firing':>7} {'preds':>7} {'tp':>6} {'fn':>6} {'fp':>6} {'P':>7} {'R':>7} {'F1':>8}")
    for r in swept.collect():
        print(f"{r.tau:>8.3f} {r.n_firing:>7} {r.n_pred:>7} {r.tp:>6} {r.fn:>6} {r.fp:>6} {r.precision:>7.3f} {r.recall:>7.3f} {r.f1:>8.4f}")
    best = postprocess.best(swept).first()
    print(f"best F1 {best.f1:.4f} at tau {best.tau:.3f}; a flat curve is no tuning opportunity")
    if args.out:
        Path(args.out).write_text(jsonl.to_array(swept.drop("rank"), len(args.thresholds)), encoding="utf-8")
    return int(bool(failed))


def score(args: argparse.Namespace) -> int:
    spark = _spark()
    gold = jsonl.read(spark, str(args.gold), "annotation").select("record_id", F.array_sort("breaks").alias("breaks"), "word_count")
    pred = jsonl.read(spark, str(args.predictions), "prediction").select("record_id", "pred_breaks", "word_count").withColumn("ordinal", F.monotonically_increasing_id())
    tally = accounting.scored(gold, pred).first()
    if not tally.n_shared:
        raise SystemExit(f"{args.predictions} ({tally.n_pred} records) and {args.gold} ({tally.n_gold} records) have no record_id in common")
    if tally.n_orphans:
        print(f"{tally.n_orphans} prediction(s) without gold are left out")
    if tally.n_absent:
        _tell(metrics.absent_gold(gold, pred), f"of {tally.n_gold} gold documents have no prediction; their {tally.at_stake} breaks count as missed", "record_id")
        if not args.allow_missing:
            print("--allow-missing scores such a file anyway")
            return 2
    if tally.n_drift:
        found = metrics.drift(gold, pred)
        raise SystemExit("\n".join([f"{tally.n_drift} record(s) were predicted for different text than their gold's, so no offset means the same:", *_names(found, "record_id", "gold_words", "pred_words")]))
    aligned = metrics.align(gold.withColumnRenamed("word_count", "_gold_words"), pred).withColumn("word_count", F.coalesce("pred_words", "_gold_words", F.lit(0)))
    print(f"{tally.n_gold} documents\n{'tolerance':>10} {'tp':>6} {'fn':>6} {'fp':>6} {'P':>7} {'R':>7} {'F1':>8}")
    for r in metrics.score_tolerances(aligned).orderBy("tolerance").collect():
        print(f"{r.tolerance:>10} {r.tp:>6} {r.fn:>6} {r.fp:>6} {r.precision:>7.3f} {r.recall:>7.3f} {r.f1:>8.4f}")
    means = metrics.mean_pk_windowdiff(metrics.pk_windowdiff(aligned)).first()
    if means.n_scored:
        print(f"mean Pk {means.mean_pk:.4f}, mean WindowDiff {means.mean_wd:.4f} over {means.n_scored} documents")
    return 0


def cut(args: argparse.Namespace) -> int:
    spark = _spark()
    told = jsonl.read_strict(spark, str(args.predictions), {"pred_breaks": "array<bigint>"}, {"word_count": "bigint"})
    judged = accounting.cuts(_transcripts(spark, args.transcripts), told, accounting.CARRIED).persist()
    fatal = judged.where("fatal")
    if n := fatal.count():
        raise SystemExit("\n".join([f"{n} prediction(s) have no transcript or are for different text; nothing was written:", *_names(fatal, "record_id", "problem")]))
    rows = segments.to_segments(judged.where("problem is null").drop("problem", "fatal"), args.min_words, not args.no_text, accounting.CARRIED)
    jsonl.write(segments.minimal(rows) if args.minimal else rows, str(args.out))
    lost = _tell(judged.where("problem is not null"), f"record(s) gave no segments and aren't in {args.out}", "record_id", "problem")
    done = spark.read.json(str(args.out)) if judged.count() > lost else None
    n_rows = done.count() if done is not None else 0
    print(f"{judged.count() - lost} of {judged.count()} records, {n_rows} segments ({args.out})")
    if args.min_words and done is not None and "flags" in done.columns:
        print(f"{done.where(F.size('flags') > 0).count()} of them flagged; flagged ones are kept")
    if args.no_text or args.minimal:
        print("merge needs texts and offsets; " + ("texts" if args.no_text else "offsets") + " were left out")
    return int(bool(lost))


def merge(args: argparse.Namespace) -> int:
    spark = _spark()
    rows = jsonl.read_present(spark, str(args.segments), "segment")
    try:
        judged = accounting.merged(rows, args.drop_flagged).persist()
    except ValueError as lacking:
        raise SystemExit(str(lacking)) from None
    good = judged.where("outcome = 'rebuilt'")
    jsonl.write(good.select("record_id", "word_count", "body").orderBy("record_id"), str(args.out))
    print(f"{rows.count()} segments, {judged.count()} record(s) in, {good.count()} out ({args.out})")
    gone = _tell(judged.where("outcome = 'vanished'"), "record(s) lost every segment and aren't in the output (short ones are the likeliest, so the rest is a biased sample)", "record_id")
    failed = _tell(judged.where("outcome = 'failed'"), "record(s) can't be rebuilt", "record_id", "error")
    return int(bool(gone or failed))


def relate(args: argparse.Namespace) -> int:
    spark = _spark()
    try:
        old, new = (segments.require_full(jsonl.read_present(spark, str(path), "segment")) for path in (args.old, args.new))
    except ValueError as lacking:
        raise SystemExit(str(lacking)) from None
    pairs = reconcile.reconcile(old, new, args.min_overlap).persist()
    n_old = old.count()
    print(f"{n_old} old segments, {new.count()} new")
    counts = {r.status: r.n for r in reconcile.status_counts(pairs).collect()}
    print("\n".join(f"{s:>8} {counts[s]}" for s in STATUSES if s in counts))
    moved = reconcile.shifts(pairs).first()
    if moved.n_moved:
        print(f"{moved.n_moved} one-to-one pairs begin elsewhere, by {moved.max_shift} words at most")
    stable = reconcile.id_map(pairs).count()
    print(f"{stable} of {n_old} old ids have one new id; {n_old - stable} have none")
    if args.out:
        jsonl.write(pairs.orderBy("record_id", "ordinal").drop("ordinal"), str(args.out), nulls=True)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="newsloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = top.add_subparsers(dest="command", required=True)

    def verb(name: str, f, help_: str, *paths: str, out: bool | None = True) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=help_)
        for path in paths:
            p.add_argument(f"--{path}", type=Path, required=True)
        if out is not None:
            p.add_argument("--out", type=Path, required=out)
        p.set_defaults(call=f)
        return p

    def model(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("adapter", help="a local folder")
        p.add_argument("--revision")
        p.add_argument("--base-model", help="passed over: the scorer brings its own")
        p.add_argument("--batch-size", type=int, default=8)
        p.add_argument("--limit", type=int, help="the first so many records")
        p.add_argument("--scorer", default="newsloom.operators.windows:rule_scorer", help="module:factory, called with the prompt; the default is a stand-in without a model")
        p.add_argument("--tokenizer", default="newsloom.operators.windows:regex_tokenizer", help="module:function")
        return p

    p = verb("check-adapter", check_adapter, "look for what would fail silently", out=None)
    p.add_argument("adapter")
    p.add_argument("--revision")
    p = model(verb("run", run, "predict boundaries", "input"))
    p.add_argument("--tau", type=float, default=postprocess.TAU)
    p.add_argument("--chunk", type=int, default=64, help="records a partition when scoring")
    p = model(verb("sweep", sweep, "score every threshold from one pass", "input", "gold", out=False))
    p.add_argument("--tolerance", type=int, default=25)
    p.add_argument("--thresholds", type=lambda s: [float(x) for x in s.split(",")], default=list(postprocess.THRESHOLDS))
    p = verb("score", score, "score predictions against gold", "predictions", "gold", out=None)
    p.add_argument("--allow-missing", action="store_true")
    p = verb("segments", cut, "one row for each story", "transcripts", "predictions")
    p.add_argument("--min-words", type=int, help="flag shorter ones")
    p.add_argument("--no-text", action="store_true")
    p.add_argument("--minimal", action="store_true", help="record_id, segment_id, text and n_cuts only")
    p = verb("merge", merge, "put documents together again", "segments")
    p.add_argument("--drop-flagged", action="store_true")
    p = verb("reconcile", relate, "relate the segments of two runs", "old", "new", out=False)
    p.add_argument("--min-overlap", type=float, default=0.5)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.call(args)
    finally:
        # what a verb persisted, however it ended
        if session := SparkSession.getActiveSession():
            session.catalog.clearCache()
