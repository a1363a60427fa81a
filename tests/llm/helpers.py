"""Tables for tests, and brute-force versions that share no code with the operators."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import langid, linededup, mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use themselves.
EXTRA = "d string, t string, p int, rep int, least int, gone int, _line_gone int, _gone_id int, _mix_h int, mix_shard int, cell int, start int"
LONG = "sphinx of black quartz judge my vow " * 30000


def docs(spark, rows, extra=False):
    full = [(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows]
    if extra:
        return spark.createDataFrame([(*r, *["x"] * 2, *[1] * 10) for r in full], f"{SCHEMA}, {EXTRA}")
    return spark.createDataFrame(full, SCHEMA)


def odd(spark, extra=True):
    """Nulls in every column, empty, blank and very long texts, repeated rows and clashing names."""
    rows = [(1, None, "en", "a"), (None, "lost words here", "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, "a"), (4, LONG, "en", None), (5, "one two", None, None), (5, "one two", None, None), (None, None, None, None)]
    return docs(spark, rows, extra)


def words(rng: random.Random, n: int, kinds: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def components(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


def differing_bits(f):
    return sum(np.bitwise_count(f[:, None, k] ^ f[None, :, k]).astype(int) for k in range(2))


def edited(rows, run=linededup.RUN, least=linededup.LONG):
    """Texts by brute force: every run of lines is compared with all before it.  Rows that repeat are one document."""
    split = sorted({(i if i is not None else -(2**63), t): t.split("\n") for i, t in rows if t is not None}.items())
    one, many, gone = set(), set(), defaultdict(set)
    for key, own in split:
        for k, x in enumerate(own):
            if x in one and len(x) >= least:
                gone[key].add(k)
            one.add(x)
            if len(found := tuple(own[k : k + run])) == run:
                if found in many:
                    gone[key].update(range(k, k + run))
                many.add(found)
    left = {key: [x for k, x in enumerate(own) if k not in gone[key]] for key, own in split}
    return {key: "\n".join(own) if own else None for key, own in left.items()}


def identified(spark, table):
    """doc_id: the share of a document's 5-byte n-grams that each language has, by exact sets."""
    rows = [(r.doc_id, r.text, r.lang, r.h) for r in table.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1_000_000)).alias("h")).collect()]

    def grams(text):
        clean = bytes(b if 65 <= b < 91 or 97 <= b < 123 or b >= 128 else 32 for b in (text or "").lower().encode())
        return [g for g in (clean[i : i + 5] for i in range(len(clean) - 4)) if g != b" " * 5]

    size = Counter(lang for _, text, lang, _ in rows if lang is not None)
    found, sampled = defaultdict(Counter), Counter()
    for i, text, lang, h in rows:
        if i is not None and text is not None and lang is not None and h < int(min(1.0, langid.FIT_ROWS / size[lang]) * 1_000_000):
            sampled[lang] += 1
            found[lang].update(set(grams(text)))
    sets = {lang: {g for g, n in found[lang].items() if n >= min(langid.MIN_DOCS, max(1, sampled[lang] // langid.SOME))} for lang in size}
    out = {}
    for i, text, _, _ in rows:
        own = grams(text)
        out[i] = {lang: sum(g in have for g in own) / max(len(own), 1) for lang, have in sets.items()}
    return out


def rule_statistics(text):
    """The statistics of the quality rules, one byte at a time; None for a text without words."""
    data = (text or "").encode()
    found = re.findall(rb"[^ \t\n\r\x0b\x0c]+", data)
    if not found:
        return None
    symbol = lambda b: 32 < b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"-()?"
    n, chars = len(found), sum(map(len, found))
    upper, lower = sum(65 <= b < 91 for b in data), sum(97 <= b < 123 for b in data)
    return [
        (chars + 120) / (n + 20),
        sum(map(symbol, data)) / (chars + 120),
        (upper + 3) / (upper + lower + 100),
        sum(a == b for a, b in zip(found, found[1:])) / (n + 20),
        math.log1p(len(set(found)) + 20) / math.log1p(n + 20),
        sum(symbol(w[-1]) for w in found) / (n + 20),
        data.count(b"|") / (n + 20),
    ]


def drawn(rows, hashes, quota, block, shard):
    """doc_id: shard, of the rows (doc_id, source), by the order of the hashes in each source, cut at the tree's counts."""
    names = sorted(quota)
    parts = mixing.split(np.array([-(-quota[s] // block) for s in names]), max(1, round(sum(quota.values()) / shard)))
    out = {}
    for k, s in enumerate(names):
        order = sorted((i for i, source in rows if source == s), key=lambda i: (hashes[i], i))[: quota[s]]
        for place, end in enumerate(np.cumsum(parts[:, k]) * block):
            for i in order[end - parts[place, k] * block : end]:
                out[i] = place
    return out
