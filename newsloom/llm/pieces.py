"""Exact SentencePiece encoding and decoding of merge-type (BPE) models (operator 7).

Encoding is by backtracking rather than by merging.  Aho-Corasick gives, for
each position, the longest piece that starts there; a token is accepted if it
is compatible with the one before it, that is, if merging the two's joined text
gives just these two; else the next shorter piece is tried, and when none is
left the position is marked in a bitfield of failed positions and the token
before it is shortened in turn.  For merge rules that depend on the merged
piece alone, a sequence whose adjacent tokens are all compatible is the one
that merging gives.  Pieces that their own merges don't reach are left out.

Texts are cut into chunks (spaces, then up to the next space or line break)
where no piece can cross, which the model's pieces are checked for; chunks that
recur are remembered per worker in a table that is emptied when full.
Characters without a piece become byte pieces.

One narrow pass, no shuffle; the pieces have a fixed size and travel as a
broadcast.  Decoding joins the pieces, bytes first, drops the added space and
gives the text again, but for U+2581, which the model writes for a space.

Cases.  A null text has null results; an empty one no tokens.  Repeated rows
are encoded each; rows with a null id stay.  An empty table gives an empty one.  Columns that are not asked for are
not looked at; of those that are, one named like a result is left out.  Decoding null ids gives a null text, and no ids an empty one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import documents
from newsloom.session import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Entries that a worker remembers.
REMEMBERED = 1 << 19


def read_model(path: str = MODEL) -> list[tuple[str, float, str]]:
    """Piece, score and kind (n normal, b byte, x other) by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "b" if model.is_byte(i) else "x" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "n"
    return [(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())]


def merge(text: str, score: dict[str, float]) -> list[str]:
    """Pieces by merging the best adjacent pair, leftmost first; short texts only."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def prepare(model: list[tuple[str, float, str]]) -> dict:
    """What workers need: scores, ids of reachable pieces, byte ids; raises if a piece could cross a chunk's end."""
    score = {p: s for p, s, k in model if k == "n"}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) or "\n" in p for p in score):
        raise ValueError("this model has pieces that cross word ends")
    ids = {p: i for i, (p, _, k) in enumerate(model) if k == "n" and merge(p, score) == [p]}
    return {"score": score, "ids": ids, "bytes": {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(model) if k == "b"}, "table": [bytes([int(p[1:-1], 16)]) if k == "b" else p.replace(SPACE, " ").encode() if k == "n" else b"" for p, _, k in model]}


class Codec:
    """Encodes and decodes texts; built once in a worker."""

    def __init__(self, prepared: dict):
        import ahocorasick

        self.score, self.ids, self.bytes, self.table = (prepared[k] for k in ("score", "ids", "bytes", "table"))
        self.known = {p for p in self.ids if len(p) == 1}
        self.search = ahocorasick.Automaton()
        self.piece: dict[int, str] = {}
        self.size: dict[int, int] = {}
        self.shorter: dict[int, int] = {}
        for p, i in self.ids.items():
            if all(c in self.known for c in p):
                self.search.add_word(p, (len(p), i))
            self.piece[i], self.size[i] = p, len(p)
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        self.search.make_automaton()
        self.good: dict[int, bool] = {}
        self.seen: dict[str, list[int]] = {}
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+").findall

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives these two."""
        if len(self.good) >= REMEMBERED:
            self.good.clear()
        x, y = self.piece[a], self.piece[b]
        ok = self.good[a << 32 | b] = merge(x + y, self.score) == [x, y]
        return ok

    def backtrack(self, text: str) -> list[int]:
        """Pieces of a text all of whose characters are pieces."""
        n = len(text)
        reach, longest = [0] * n, [0] * n
        for end, (size, piece) in self.search.iter(text):
            start = end + 1 - size
            if size > reach[start]:
                reach[start], longest[start] = size, piece
        failed = bytearray(n + 1)
        tokens: list[int] = []
        good, sizes, shorter = self.good, self.size, self.shorter
        at, token, last = 0, longest[0], -1
        while True:
            end = at + sizes[token]
            if not failed[end]:
                ok = True if last < 0 else good.get(last << 32 | token)
                if ok is None:
                    ok = self.compatible(last, token)
                if ok:
                    tokens.append(token)
                    if end == n:
                        return tokens
                    at, last, token = end, token, longest[end]
                    continue
            token = shorter[token]
            while token < 0:
                failed[at] = 1
                gone = tokens.pop()
                at -= sizes[gone]
                last = tokens[-1] if tokens else -1
                token = shorter[gone]

    def chunk(self, text: str) -> list[int]:
        known = self.known
        if known.issuperset(text):
            return self.backtrack(text)
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in known:
                if i > start:
                    ids += self.backtrack(text[start:i])
                ids += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        if start < len(text):
            ids += self.backtrack(text[start:])
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        seen, ids = self.seen, []
        for c in self.chunks(SPACE + text.replace(" ", SPACE)):
            found = seen.get(c)
            if found is None:
                found = self.chunk(c)
                if len(c) < 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[c] = found
            ids += found
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_made: dict[tuple, Codec] = {}


def encode(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, token_ids, n_tokens, and round_trip: whether decoding gave the text again."""
    ship(docs.sparkSession)
    keep = tuple(c for c in keep if c not in ("doc_id", "token_ids", "n_tokens", "round_trip"))
    prepared = prepare(read_model(path))
    shared = docs.sparkSession.sparkContext.broadcast(prepared)
    key = (path, len(prepared["ids"]))

    def stage(batches):
        if key not in _made:
            _made[key] = Codec(shared.value)
        codec = _made[key]
        for batch in batches:
            out, same = [], []
            for text in batch.column(1):
                t = text.as_py()
                ids = None if t is None else codec.encode(t)
                out.append(None if ids is None else pa.array(ids, pa.int32()))
                same.append(None if ids is None else codec.decode(ids) == t.replace(SPACE, " "))
            sizes = [None if x is None else len(x) for x in out]
            ends, total = [0], 0
            for n in sizes:
                total += n or 0
                ends.append(total)
            flat = pa.concat_arrays([x for x in out if x is not None]) if total else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([n is None for n in sizes], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], schema=pa.schema([("doc_id", pa.int64()), *[(f"k{i}", c.type) for i, c in enumerate(batch.columns[2:])], ("token_ids", lists.type), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())]))

    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kept = "".join(f"k{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    out = narrow.mapInArrow(stage, f"doc_id bigint, {kept}token_ids array<int>, n_tokens bigint, round_trip boolean")
    return out.select("doc_id", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "token_ids", "n_tokens", "round_trip")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and the text that token_ids stand for; null ids give a null text."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(prepare(read_model(path)))

    def stage(batches):
        codec = Codec(shared.value)
        for batch in batches:
            texts = [None if (ids := x.as_py()) is None else codec.decode(ids) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(stage, "doc_id bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))


SQL = None
