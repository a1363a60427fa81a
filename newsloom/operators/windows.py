"""Sliding token windows over transcripts, and the scorer that reads them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import anchors as A
from newsloom.functions import scan
from newsloom.functions import scoring as S
from newsloom.functions import text as T
from newsloom.functions.arrays import _apply, bisect_left, lists_of, offsets_of
from newsloom.operators import postprocess


@dataclass(frozen=True)
class Geometry:
    """How a model's windows lie, in tokens."""

    window_tokens: int
    stride_tokens: int
    edge_guard_lo: int
    max_seq_len: int = 4096
    tail_window_min_advance: int = 256
    guard_fraction: float = 0.10


@dataclass(frozen=True)
class DecodeSpec:
    max_new_tokens: int = 256
    gen_batch_size: int = 8
    dedupe_tolerance_words: int = 25
    strict_anchors: bool = False


#: A tokenizer takes a text and returns the (start, end) character offsets of its tokens.
Tokenizer = Callable[[str], list[tuple[int, int]]]


def regex_tokenizer(text: str) -> list[tuple[int, int]]:
    """A stand-in for tests: word pieces of up to six characters, and single marks."""
    return [m.span() for m in re.finditer(r"\w{1,6}|[^\w\s]", text)]


def chunk_tokenizer(text: str) -> list[tuple[int, int]]:
    """A stand-in whose token counts SQL can follow: each space-separated word in chunks of six characters."""
    return [m.span() for m in re.finditer(r"[^ ]{1,6}", text)]


#: A tokenizer none of whose tokens reaches beyond a word, and that looks at nothing but a word's length, may say how many tokens words of these lengths have; then its offsets aren't asked for.
chunk_tokenizer.counts = lambda sizes: (sizes + 5) // 6


def _mapped(lists: pa.Array, tokenizer: Tokenizer) -> pa.Array:
    # a text at a time is a Python object, its words never are
    at = offsets_of(lists)
    sizes = pc.utf8_length(lists.flatten()).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    if counts := getattr(tokenizer, "counts", None):
        total = np.append(0, np.cumsum(counts(sizes - 1)))
        ends = np.arange(at[-1] + len(lists)) - np.repeat(np.arange(len(lists)), np.diff(at) + 1)
        return lists_of(pa.array((total[ends] - np.repeat(total[at[:-1]], np.diff(at) + 1)).astype(np.int32)), at + np.arange(len(at)), lists)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(at[-1] + len(lists), np.int32)
    for i, text in enumerate(pc.binary_join(lists, " ")):
        a, b = at[i], at[i + 1]
        ends = np.fromiter((e for _, e in tokenizer(text.as_py() or "")), np.int64)
        out[a + i : b + i] = np.searchsorted(ends, starts[a:b] - (starts[a] if b > a else 0), "right")
        out[b + i] = len(ends)
    return lists_of(pa.array(out), at + np.arange(len(at)), lists)


def _usable(tokenizer: Tokenizer) -> None:
    if not callable(tokenizer):
        raise TypeError("a tokenizer that gives the character offsets of its tokens is needed")


def word_to_token(words: Column, tokenizer: Tokenizer = regex_tokenizer) -> Column:
    """For each word the first token that ends after the word's start, and the number of tokens at the end."""
    _usable(tokenizer)
    return _apply("array<int>", lambda lists: _mapped(lists, tokenizer), words)


def token_maps(docs: DataFrame, tokenizer: Tokenizer = regex_tokenizer) -> DataFrame:
    """docs (record_id, body, ...) with words, w2t (as `word_to_token` gives it) and n_tokens; computed once, in one pass through Python, used by every geometry."""
    _usable(tokenizer)

    def mapped(texts: pa.Array, s: scan.Scanned) -> pa.Array:
        words = lists_of(s.values(), s.first, texts)
        return pa.StructArray.from_arrays([words, _mapped(words, tokenizer)], ["words", "w2t"])

    made = scan.scanned("struct<words:array<string>,w2t:array<int>>", mapped, F.col("body"))
    out = T.pin(docs.withColumn("_map", made), words=F.col("_map.words"), w2t=F.col("_map.w2t")).drop("_map")
    return out.withColumn("n_tokens", F.element_at("w2t", -1))


def enumerate_windows(mapped: DataFrame, geometry: Geometry, prompt: A.PromptSpec | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each window with words: record_id, window, word_start, words, is_first, is_last (by grid position), the columns to carry along, and a prompt if asked for.

    All windows of a document are cut before rows are made of them, so that a row carries its own words only.
    """
    starts = S.window_starts(F.col("n_tokens"), geometry.window_tokens, geometry.stride_tokens, geometry.tail_window_min_advance)
    rows = T.pin(mapped.select("record_id", *carry, "words", "w2t", "n_tokens"), _starts=starts)
    rows = T.pin(rows, _ends=F.transform("_starts", lambda s: F.least(s + geometry.window_tokens, F.col("n_tokens"))))
    rows = rows.withColumns({"_low": bisect_left(F.col("w2t"), F.col("_starts")), "_high": bisect_left(F.col("w2t"), F.col("_ends"))})
    own = lambda e, i: F.struct(
        i.alias("window"), e["_starts"].alias("token_start"), e["_ends"].alias("token_end"), e["_low"].alias("word_start"), e["_high"].alias("word_end"),
        (i == 0).alias("is_first"), (i == F.size("_starts") - 1).alias("is_last"), F.slice("words", e["_low"] + 1, e["_high"] - e["_low"]).alias("words"),
    )
    out = rows.select("record_id", *carry, F.explode(F.transform(F.arrays_zip("_starts", "_ends", "_low", "_high"), own)).alias("x")).select("record_id", *carry, "x.*").where("word_end > word_start")
    return out.withColumn("prompt", prompt.render(F.array_join("words", " "))) if prompt else out


#: A scorer takes frames with a column prompt, and returns p_break, p_none and generated for each row.
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def rule_scorer(prompt: A.PromptSpec = A.PromptSpec()) -> Scorer:
    """A stand-in for tests, not a model: it marks the words that begin with a capital after a full stop, every third of them, in the anchor format."""

    def score(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in frame["prompt"]:
            words = text.split("Transcript:\n")[-1].rsplit("\n\nBoundaries:", 1)[0].split()
            cuts = [i for i, word in enumerate(words[:-1], 1) if word[-1] == "." and words[i][0].isupper()][::3]
            lines = [f"{k}. {' '.join(words[max(0, b - prompt.anchor_pre_words) : b])} {prompt.story_break_token} {' '.join(words[b : b + prompt.anchor_post_words])}" for k, b in enumerate(cuts, 1)]
            p = min(0.999, len(cuts) / 10)
            rows.append((p, 1 - p, "\n".join(lines) if lines else prompt.no_break_target))
        return pd.DataFrame(rows, columns=["p_break", "p_none", "generated"])

    return score


def run_scorer(windows: DataFrame, scorer: Scorer, decode: DecodeSpec = DecodeSpec()) -> DataFrame:
    """windows with p_break, p_none, generated and error.

    Prompts are sorted by length within a partition, longest first, so that
    batches are alike and memory fails early.  A batch that runs out of memory is
    halved; one that fails otherwise gives error rows and not the end of the job.
    A scorer sees all columns but the words, which stay in Arrow.
    """
    # joined, words take a quarter of the room in the sort; none of them holds a space
    joined = windows.withColumn("words", F.array_join("words", " ")).select("record_id", "window", "word_start", "words", "is_first", "is_last", "prompt")
    schema = joined.schema
    out = schema.simpleString()[7:-1] + ",p_break:double,p_none:double,generated:string,error:string"
    names = schema.names
    made = ("p_break", "p_none", "generated")

    def attempt(part: pd.DataFrame) -> Iterator[tuple]:
        """p_break, p_none, generated and error of each row."""
        try:
            scored = scorer(part).reset_index(drop=True)
            # rows that the scorer leaves out are null
            found = [*zip(*(scored[c].tolist() for c in made), strict=True)][: len(part)]
            yield from [(*row, None) for row in found + [(None, None, None)] * (len(part) - len(found))]
        except MemoryError as full:
            if len(part) == 1:
                yield None, None, None, f"out of memory: {full}"
                return
            half = len(part) // 2
            yield from attempt(part.iloc[:half])
            yield from attempt(part.iloc[half:])
        except Exception as failure:  # noqa: BLE001 - a plug-in may raise anything
            yield from [(None, None, None, f"{type(failure).__name__}: {failure}")] * len(part)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select([c for c in names if c != "words"]).to_pandas()
            rows = [row for i in range(0, len(frame), decode.gen_batch_size) for row in attempt(frame.iloc[i : i + decode.gen_batch_size])]
            found = [pa.array([row[k] for row in rows], kind, from_pandas=True) for k, kind in enumerate((pa.float64(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *made, "error"])

    scored = joined.sortWithinPartitions(F.length("prompt").desc()).mapInArrow(stage, ", ".join(x.replace(":", " ", 1) for x in _split_fields(out)))
    return scored.withColumn("words", F.split("words", " "))


def _split_fields(text: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def window_scores(generated: DataFrame, prompt: A.PromptSpec = A.PromptSpec(), guard_fraction: float = 0.10, strict: bool = False) -> DataFrame:
    """What each window's text says: breaks in document words, and the counts of anchors that gave none."""
    n = F.size("words")
    hits = A.ground(F.col("words"), A.parse_anchors(F.col("generated"), prompt), strict)
    rows = T.pin(generated.withColumn("_h", hits), _hits=F.col("_h")).withColumn("_found", F.filter("_hits", lambda h: h["offset"].isNotNull()))
    inside = F.filter("_found", lambda h: ~S.in_guard_zone(h["offset"], n, F.col("is_first"), F.col("is_last"), guard_fraction))
    rows = rows.withColumn("_inside", inside)
    bad = lambda h: S.is_degenerate(h["offset"], n, F.col("is_first"), F.col("is_last"))
    return rows.select(
        "record_id",
        "word_start",
        *[c for c in ("error",) if c in generated.columns],
        "p_break",
        "p_none",
        (F.col("p_break") > F.col("p_none")).alias("greedy_would_fire"),
        F.transform(F.filter("_inside", lambda h: ~bad(h)), lambda h: (F.col("word_start") + h["offset"]).cast("bigint")).alias("breaks"),
        F.size(F.filter("_hits", lambda h: h["offset"].isNull())).alias("unlocatable"),
        F.size(F.filter("_hits", lambda h: h["ambiguous"])).alias("ambiguous"),
        F.size(F.filter("_inside", bad)).alias("degenerate"),
    )


def score_windows(docs: DataFrame, geometry: Geometry, scorer: Scorer | None = None, tokenizer: Tokenizer = regex_tokenizer, prompt: A.PromptSpec = A.PromptSpec(), decode: DecodeSpec = DecodeSpec(), partitions: int | None = None) -> DataFrame:
    """Every window of docs scored, without a threshold; the costly stage, to be written once and swept often.

    A window whose scorer failed is a row with an error and no breaks; see `lost`.
    """
    windows = enumerate_windows(token_maps(docs, tokenizer), geometry, prompt)
    if partitions:
        windows = windows.repartition(partitions, "record_id", "window")
    return window_scores(run_scorer(windows, scorer or rule_scorer(prompt), decode), prompt, geometry.guard_fraction, decode.strict_anchors)


def lost(scores: DataFrame) -> DataFrame:
    """record_id, error: the records of which a window couldn't be scored; a prediction from the others would be a part that looks whole."""
    return scores.where("error is not null").groupBy("record_id").agg(F.min("error").alias("error"))


def segment_documents(scores: DataFrame, docs: DataFrame, tau: float = postprocess.TAU, decode: DecodeSpec = DecodeSpec()) -> DataFrame:
    """Predictions: record_id, word_count, pred_breaks, tau and the counts of lost anchors, of all records but those that are `lost`."""
    # the scores are made once: what a record needs of all its windows comes from one aggregation
    error = F.col("error") if "error" in scores.columns else F.lit(None).cast("string")
    fired = F.flatten(F.collect_list(F.when(F.col("p_break") > tau, F.col("breaks"))))
    own = scores.groupBy("record_id").agg(F.min(error).alias("_error"), fired.alias("_fired"), F.sum("unlocatable").alias("n_unlocatable_anchors"), F.sum("ambiguous").alias("n_ambiguous_anchors"))
    base = docs.select("record_id", T.word_count(F.col("body")).cast("bigint").alias("word_count"), *[c for c in ("outlet", "show", "date") if c in docs.columns])
    out = base.join(own, "record_id", "left").where("_error is null")
    fired = F.coalesce("_fired", F.array().cast("array<bigint>"))
    out = out.withColumn("pred_breaks", postprocess.dedupe_lists(fired, decode.dedupe_tolerance_words))
    out = out.select(*base.columns, "pred_breaks", "n_unlocatable_anchors", "n_ambiguous_anchors")
    return out.fillna(0, ["n_unlocatable_anchors", "n_ambiguous_anchors"]).withColumn("tau", F.lit(float(tau)))


def segment_spans(predictions: DataFrame) -> DataFrame:
    """record_id and one row for each story's word range."""
    return predictions.select("record_id", F.explode(S.spans(F.col("pred_breaks"), F.col("word_count"))).alias("s")).select("record_id", F.col("s.a").alias("start"), F.col("s.b").alias("end"))
