"""Token counts by offset-mapped attribution.

A document is encoded once and whole, the spans of its tokens are joined to the spans of its sections, and a token
that crosses a boundary is given to one of the sections by an explicit rule. So the counts of the sections add up
to the count of the document, which separate encodings of the sections would not.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .byte_bpe import read_ranks
from .common import slices

#: To the section with the most of its characters (the earlier one of equals), of its first, or of its last character.
RULES = ("most", "first", "last")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    ranks = read_ranks(path)
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), widths


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """First and end characters of a text's tokens. A token that holds part of a character's bytes touches that character."""
    model, widths = encoder(path, pattern)
    ends = np.cumsum(widths[np.asarray(model.encode_ordinary(text), np.int64)])
    if text.isascii():
        return np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends
    data = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], ends[:-1]])
    return character[starts], character[ends - 1] + 1


def attributed(first: np.ndarray, end: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that also touch another section. Sections follow each other without
    gaps; those of no characters get no token."""
    low = np.searchsorted(section_ends, first, side="right")
    high = np.searchsorted(section_ends, end - 1, side="right")
    crosses = low != high
    owner = high.copy() if rule == "last" else low.copy()
    if rule == "most":
        starts = np.concatenate([[0], section_ends[:-1]])
        for t in np.flatnonzero(crosses):
            span = np.arange(low[t], high[t] + 1)
            owner[t] = span[np.argmax(np.minimum(section_ends[span], end[t]) - np.maximum(starts[span], first[t]))]
    n = len(section_ends)
    return np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)


def _lines(text: str) -> list[str]:
    return text.split("\n")


def section_tokens(df: DataFrame, key: str, sections: list[str] | None = None, text: str = "text", rule: str = "most",
                   separator: str = "\n", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Token counts by section of each row: (key, section, first_char, n_chars, n_tokens, n_crossing).

    Without ``sections`` the sections are the lines of ``text``, each with its line feed; they number from 0. With
    ``sections``, the named columns are joined by ``separator``, encoded as one text, and each column with the
    separator after it is a section, numbered in the order given. Null texts and fields count as empty; an empty
    text is one section without tokens. ``n_tokens`` counts the tokens given to the section by ``rule``,
    ``n_crossing`` those of them that also touch another section. Repeated keys give repeated rows; nothing is
    shuffled, and other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = sections or [text]
    fields = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"f{i}") for i, c in enumerate(names)]
    chosen = df.select(F.col(f"`{key}`").alias("k"), F.concat_ws(separator, *fields).alias("whole"),
                       F.array(*[F.char_length(f) for f in fields[:-1]]).cast("array<int>").alias("lengths"))
    counts = [StructField(n, LongType(), False) for n in ("section", "first_char", "n_chars", "n_tokens", "n_crossing")]
    schema = StructType([StructField("k", df.schema[key].dataType), *counts])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "whole", 1_000_000):
                columns, rows = [[], [], [], [], []], []
                for i, (whole, lengths) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    if sections is None:
                        widths = np.fromiter(map(len, _lines(whole)), np.int64) + 1
                    else:
                        widths = np.array([*lengths, 0], np.int64) + len(separator)
                    ends = np.cumsum(widths)
                    ends[-1] = len(whole)
                    tokens, crossing = attributed(*token_spans(whole, path, pattern), ends, rule)
                    starts = np.concatenate([[0], ends[:-1]])
                    for to, x in zip(columns, (np.arange(len(ends)), starts, ends - starts, tokens, crossing)):
                        to.append(x)
                    rows.append(np.full(len(ends), i))
                keys = part.column(0).take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(np.concatenate(x)) for x in columns]], names=[f.name for f in schema])

    return chosen.mapInArrow(run, schema).withColumnRenamed("k", key)
