"""Prompts, generated anchors and where in a window they point."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions.arrays import _apply, lists_of, offsets_of, spread
from newsloom.functions.scan import Scanned, parts_of

#: How many words are searched at once.
WORDS = 1 << 20

TEMPLATE = (
    "Split this part of a news broadcast into its stories. A new story has a topic, an event or people of its own; "
    "another speaker or another side of the same matter isn't one.\n\nWrite one line for each place where a story begins: "
    "the last {pre} words before it, {tok}, and its first {post} words. Write {none} if there is no such place.\n\n"
    "Transcript:\n{input_text}\n\nBoundaries:\n"
)


@dataclass(frozen=True)
class PromptSpec:
    """What a model was trained to read and to write.  The template is a parameter; a trained model needs its own."""

    story_break_token: str = "<|STORY_BREAK|>"
    no_break_target: str = "NONE"
    anchor_pre_words: int = 12
    anchor_post_words: int = 8
    template: str = TEMPLATE

    def render(self, window_text: Column) -> Column:
        """The prompt of a window.  The text is concatenated, never formatted, so that % and { in it are safe."""
        before, after = self.template.split("{input_text}")
        fill = lambda part: part.format(pre=self.anchor_pre_words, post=self.anchor_post_words, tok=self.story_break_token, none=self.no_break_target)
        return F.concat(F.lit(fill(before)), window_text, F.lit(fill(after)))


_ANCHOR = "array<struct<pre:string,post:string>>"
_NUMBER = re.compile(r"[0-9]+[.)]\s*")


def _read(text: str, prompt: PromptSpec) -> list[tuple[str, str]]:
    token, found = prompt.story_break_token, []
    if token in text:
        # Python's line ends and white space are those of functions/text.py
        for line in text.splitlines():
            if token in line:
                line = line.strip()
                number = _NUMBER.match(line)
                pre, cut, post = line[number.end() if number else 0 :].partition(token)
                if cut and (pre := pre.strip()):
                    found.append((pre, post.strip()))
    return found


def parse_anchors(generated: Column, prompt: PromptSpec = PromptSpec()) -> Column:
    """array<struct<pre, post>> of the anchors that a model wrote, in order."""

    def parsed(texts: pa.Array) -> pa.Array:
        pre, post, size = [], [], []
        for text in texts.to_pylist():
            own = _read(text, prompt) if text is not None else []
            size.append(len(own))
            pre += [x for x, _ in own]
            post += [x for _, x in own]
        values = pa.StructArray.from_arrays([pa.array(pre, pa.string()), pa.array(post, pa.string())], ["pre", "post"])
        return lists_of(values, np.append(0, np.cumsum(size, dtype=np.int64)), texts)

    return _apply(_ANCHOR, parsed, generated)


class _Search:
    """The words of lists as numbers, and where each lies in its list."""

    def __init__(self, row: np.ndarray, at: np.ndarray, code: np.ndarray, codes: int):
        self.at, self.code, self.codes = at, code, codes
        self.order = np.argsort(row * codes + code, kind="stable")
        self.keys = (row * codes + code)[self.order]

    def __call__(self, row: np.ndarray, needle: np.ndarray, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word sequence needle[low : low + size], sought in its row, the first place in the row (-1 if there is none) and the number of places."""
        some = np.flatnonzero(size > 0)
        first, count = np.full(len(row), -1), np.zeros(len(row), np.int64)
        if not len(some) or not len(self.code):
            return first, count
        key = row[some] * self.codes + needle[low[some]]
        begin = np.searchsorted(self.keys, key)
        which, place = spread(begin, np.searchsorted(self.keys, key, "right") - begin)
        which, place = some[which], self.order[place]
        inside = place + size[which] <= self.at[row[which] + 1]
        which, place = which[inside], place[inside]
        for k in range(1, int(size.max())):
            longer = np.flatnonzero(size[which] > k)
            if not len(longer):
                break
            other = longer[self.code[place[longer] + k] != needle[low[which[longer]] + k]]
            which, place = np.delete(which, other), np.delete(place, other)
        count += np.bincount(which, minlength=len(row))
        # from the last to the first, so that the first stays
        first[which[::-1]] = place[::-1] - self.at[row[which[::-1]]]
        return first, count


def _ground(lists: pa.Array, anchors: pa.Array, strict: bool) -> pa.Array:
    at, own = offsets_of(lists), offsets_of(anchors)
    row = np.repeat(np.arange(len(lists)), np.diff(own))
    flat = anchors.flatten()
    pre, post = Scanned(flat.field("pre")), Scanned(flat.field("post"))
    coded = pa.concat_arrays([lists.flatten().cast(pa.string()), pre.values(), post.values()]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    code, of_pre, of_post = code[: at[-1]], code[at[-1] : at[-1] + len(pre.starts)], code[at[-1] + len(pre.starts) :]
    search = _Search(np.repeat(np.arange(len(lists)), np.diff(at)), at, code, len(coded.dictionary) + 1)
    sure = lambda count: count == 1 if strict else count > 0
    first, count = search(row, of_pre, pre.first[:-1], pre.count)
    offset, ambiguous = np.where(sure(count), first + pre.count, -1), count > 1
    rest = np.flatnonzero(~sure(count))
    first, count = search(row[rest], of_post, post.first[rest], post.count[rest])
    offset[rest[count > 0]] = first[count > 0]
    rest = rest[count == 0]
    for k in (8, 6, 4):
        tried = rest[pre.count[rest] >= k]
        first, count = search(row[tried], of_pre, pre.first[tried + 1] - k, np.full(len(tried), k))
        got = sure(count)
        offset[tried[got]] = first[got] + k
        ambiguous[tried[got]] |= count[got] > 1
        rest = np.setdiff1d(rest, tried[got])
    values = pa.StructArray.from_arrays([pa.array(offset.astype(np.int32), mask=offset < 0), pa.array(ambiguous)], ["offset", "ambiguous"])
    return lists_of(values, own, anchors)


def ground(all_words: Column, anchors: Column, strict: bool = False) -> Column:
    """array<struct(offset, ambiguous)>: `localize` for each of the parsed anchors, on the words of a part of an Arrow batch at once."""

    def grounded(lists: pa.Array, wanted: pa.Array) -> pa.Array:
        parts = [_ground(lists.slice(a, n), wanted.slice(a, n), strict) for a, n in parts_of(np.diff(offsets_of(lists)), WORDS)]
        return pa.concat_arrays(parts) if parts else _ground(lists, wanted, strict)

    return _apply("array<struct<offset:int,ambiguous:boolean>>", grounded, all_words, anchors)


def hits(all_words: Column, needle: Column) -> Column:
    """Every position at which a word sequence begins."""


    def search(needle: Column) -> Column:
        n, m = F.size(all_words), F.size(needle)
        # most positions fail on the first word, before anything is sliced
        found = F.filter(F.sequence(F.lit(0), F.greatest(n - m, F.lit(0))), lambda i: (F.get(all_words, i) == F.get(needle, F.lit(0))) & (F.slice(all_words, i + 1, m) == needle))
        return F.when((m > 0) & (n >= m), found).otherwise(F.array().cast("array<int>"))

    return T.let(needle, search)


def locate(all_words: Column, pre: Column) -> Column:
    """struct(offset, ambiguous): the word after the first match of a quoted context."""
    answer = lambda needle, found: F.struct(F.when(F.size(found) > 0, F.get(found, F.lit(0)) + F.size(needle)).alias("offset"), (F.size(found) > 1).alias("ambiguous"))
    return T.let(T.words(pre), lambda needle: T.let(hits(all_words, needle), lambda found: answer(needle, found)))


def localize(all_words: Column, pre: Column, post: Column, strict: bool = False) -> Column:
    """struct(offset, ambiguous): by the context before, else that after, else the last 8, 6 or 4 words before."""
    sure = lambda found: F.size(found) == 1 if strict else F.size(found) > 0
    first = lambda found: F.get(found, F.lit(0))
    answer = lambda offset, unclear: F.struct(offset.alias("offset"), unclear.alias("ambiguous"))

    def tails(needle: Column, ambiguous: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return answer(F.lit(None).cast("int"), ambiguous)
        k = sizes[0]
        tail = hits(all_words, F.slice(needle, F.greatest(F.size(needle) - k + 1, F.lit(1)), F.lit(k)))
        return T.let(tail, lambda found: F.when((F.size(needle) >= k) & sure(found), answer(first(found) + k, ambiguous | (F.size(found) > 1))).otherwise(tails(needle, ambiguous, sizes[1:])))

    def by_context(needle: Column, whole: Column) -> Column:
        ambiguous = F.size(whole) > 1
        after = T.let(hits(all_words, T.words(post)), lambda found: F.when(F.size(found) > 0, answer(first(found), ambiguous)).otherwise(tails(needle, ambiguous, (8, 6, 4))))
        return F.when(sure(whole), answer(first(whole) + F.size(needle), ambiguous)).otherwise(after)

    return T.let(T.words(pre), lambda needle: T.let(hits(all_words, needle), lambda whole: by_context(needle, whole)))


def build_target(all_words: Column, breaks: Column, prompt: PromptSpec = PromptSpec()) -> Column:
    """The text that a model is to write: one numbered anchor for each break, or the word for none."""

    def line(b: Column, i: Column) -> Column:
        low = F.greatest(b - prompt.anchor_pre_words, F.lit(0))
        pre = F.array_join(F.slice(all_words, low + 1, (b - low).cast("int")), " ")
        post = F.array_join(F.slice(all_words, (b + 1).cast("int"), F.lit(prompt.anchor_post_words)), " ")
        return F.concat((i + 1).cast("string"), F.lit(". "), pre, F.lit(f" {prompt.story_break_token} "), post)

    return F.when(F.size(breaks) > 0, F.array_join(F.transform(breaks, line), "\n")).otherwise(F.lit(prompt.no_break_target))
