"""Text columns: words, pieces, offsets and segment ids.

Words are what splitting on Unicode white space gives.  The class is spelled
out because neither of Java's two notions of white space is that one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The classes of WS and of all else with the commonest characters first: Java asks for every character one range after the other.
_BLANK = rf"[[^!-~]&&[\x20-\x20[{WS}]]]"
_WORD = rf"[!-~[\x{{a1}}-\x{{167f}}\x{{3001}}-\x{{10ffff}}[^{WS}]]]"
#: What ends a line, \r\n being one end.
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_SPEAKER = r"""(?<=[a-z.\)\]"])([A-Z][A-Z .'-]{2,25}(?:, [A-Z][A-Za-z .]+)?:)"""


def lead(body: Column) -> Column:
    """The white space before the first word."""
    return F.regexp_extract(body, f"^{_BLANK}*", 0)


def pieces(body: Column) -> Column:
    """Each word with the white space after it: lead plus all pieces is the body."""
    return F.regexp_extract_all(body, F.lit(f"{_WORD}+{_BLANK}*"), F.lit(0))


def words(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(f"{_WORD}+"), F.lit(0))


def word_count(body: Column) -> Column:
    from newsloom.functions import scan

    return scan.word_count(body)


def word_char_starts(body: Column) -> Column:
    """The character offset of each word, and the body's length at the end."""
    from newsloom.functions import scan

    return scan.word_char_starts(body)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_BLANK}+", ""), rf"{_BLANK}+\z", "")


def segment_id(record_id: Column, index: Column) -> Column:
    """`record#007`; an error for a record id that holds the separator."""
    made = F.format_string("%s#%03d", record_id, index)
    return F.when(F.instr(record_id, "#") > 0, F.raise_error(F.concat(F.lit("record_id holds '#': "), record_id))).otherwise(made)


def parse_segment_id(value: Column, strict: bool = False) -> Column:
    """struct(record_id, index) cut at the last separator; null, or an error if strict, for anything else."""
    form = r"^(.+)#([0-9]+)\z"
    found = F.struct(F.regexp_extract(value, form, 1).alias("record_id"), F.regexp_extract(value, form, 2).cast("bigint").alias("index"))
    other = F.raise_error(F.concat(F.lit("not a segment id: "), value)) if strict else F.lit(None)
    return F.when(value.rlike(form), found).otherwise(other)


def context(all_words: Column, at: Column, n: int = 60) -> Column:
    """struct(before, after): so many words on either side of an offset."""
    low = F.greatest(at - n, F.lit(0))
    high = F.least(at + n, F.size(all_words))
    part = lambda a, b: F.array_join(F.slice(all_words, a + 1, F.greatest(b - a, F.lit(0))), " ")
    return F.struct(part(low, at).alias("before"), part(at, high).alias("after"))


def paragraphs(text: Column) -> Column:
    """Run-together speaker labels on lines of their own; blank paragraphs dropped."""
    cut = F.split(F.regexp_replace(text, _SPEAKER, "\n$1"), "\n")
    return F.filter(F.transform(cut, strip), lambda p: p != "")


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once even where lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pin(df, **columns: Column):
    """df with columns that are computed here and nowhere else.

    The optimizer merges projections, and would write a computed array into each
    lambda that refers to it, to be computed again for every element.  It merges
    nothing across a generator, so the values pass through one.
    """
    made = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_pin")
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, made).select(*others, *[F.col("_pin")[name].alias(name) for name in columns])
