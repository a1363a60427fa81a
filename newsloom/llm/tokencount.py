"""Token counts under a byte-level BPE vocabulary, with the whole-token shortcut (operator 2).

Offline, on the driver: the merges are run on every string of the vocabulary;
the strings that come out as one token are proven whole.  Counting: a text is
split into pre-tokens by the tokenizer's pattern; a pre-token that is a proven
string counts one without any merging, and only the rest is merged.  Merging
takes the adjacent pair of least rank, leftmost first, until no pair is in the
vocabulary, with a heap so that a very long pre-token costs n log n.

One narrow pass, no shuffle: the vocabulary has a fixed size and travels as a
broadcast.  Counts of merged pre-tokens are remembered per worker in a table
that is emptied when full, which never changes a result.

Cases.  A null text has null counts; an empty text has zero tokens.  Strings
such as special tokens inside a text are ordinary text.  Repeated rows are
counted each; rows with a null id stay.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from newsloom.llm.common import documents, id_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker remembers.
REMEMBERED = 1 << 19


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The tokens of a pre-token."""
    n = len(piece)
    if n < 24:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts
    end, prev, nxt = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, mid, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or end[i] != mid or j >= n or end[j] != stop:
            continue
        end[i], nxt[i], alive[j] = stop, nxt[j], 0
        if nxt[i] < n:
            prev[nxt[i]] = i
            k = nxt[i]
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[k]))
        if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, i, stop))
    return [piece[i : end[i]] for i in range(n) if alive[i]]


def prove_whole(ranks: dict[bytes, int]) -> set[str]:
    """The vocabulary's strings (where they are UTF-8) that the merges turn into one token."""
    whole = set()
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if len(merge(token, ranks)) == 1:
            whole.add(text)
    return whole


class Counter:
    """Counts tokens of texts; built once in a worker."""

    def __init__(self, ranks: dict[bytes, int], whole: set[str]):
        import regex

        self.ranks, self.whole = ranks, whole
        self.split = regex.compile(PATTERN).findall
        self.merged: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int]:
        """Tokens, and the pre-tokens counted by the shortcut."""
        parts = self.split(text)
        whole, merged = self.whole, self.merged
        rest = [p for p in parts if p not in whole]
        direct = len(parts) - len(rest)
        total = direct
        for p in rest:
            n = merged.get(p)
            if n is None:
                if len(merged) >= REMEMBERED:
                    merged.clear()
                n = len(merge(p.encode("utf-8", "surrogatepass"), self.ranks))
                if len(p) < 64:
                    merged[p] = n
            total += n
        return total, direct


_made: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_whole (pre-tokens counted by the shortcut)."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, prove_whole(ranks)))
    key = (path, len(ranks))

    def stage(batches):
        counter = _made.setdefault(key, Counter(*shared.value)) if key not in _made else _made[key]
        for batch in batches:
            tokens, whole = [], []
            for text in batch.column(1):
                t = text.as_py()
                a, b = (None, None) if t is None else counter.count(t)
                tokens.append(a)
                whole.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(whole, pa.int64())], ["doc_id", "n_tokens", "n_whole"])

    return id_text(docs, id_col, text_col).mapInArrow(stage, "doc_id bigint, n_tokens bigint, n_whole bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


SQL = None
