"""Token counts per section by offset mapping.

Each document is encoded once, as a whole. Its tokens' byte lengths give
byte spans, byte spans give character spans, and a merge of both sorted span
lists (tokens, sections) gives every section its tokens. No token becomes a
row and no section is encoded on its own, so the counts of a document's sections add up to
its token count.

Sections are lines: a section runs to and with its newline; a text that ends
with a newline has no empty section behind it. Boundary rule (explicit): a token that crosses a
boundary belongs to the section
* ``"largest"``: that holds most of its characters, the earlier one on a tie;
* ``"start"``: that holds its first character.
A character whose bytes are split over several tokens counts for the token
that holds its first byte; a token without a first byte (the tail of such a
character) has an empty span and goes to the section of that character.

Defined cases
* null or empty text: one empty section 0 with no tokens;
* very long texts are encoded whole; special-token strings are ordinary text;
* repeated rows and ids: one set of sections each; null doc_id is kept;
* empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

RULES = ("largest", "start")


def load(path: str, pattern: str):
    """(encoding, byte length of each id) of a tiktoken vocabulary file."""
    import tiktoken
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def spans(raw: bytes, token_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [start, end) of tokens with the given byte lengths."""
    first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # first bytes of characters
    chars = np.concatenate([[0], np.cumsum(first)])
    ends = np.cumsum(token_bytes)
    return chars[ends - token_bytes], chars[ends]


def section_ends(text: str) -> np.ndarray:
    """Character ends of the sections of a text (one empty section at least)."""
    cuts = [i + 1 for i in _newlines(text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    return np.array(cuts, np.int64)


def _newlines(text: str) -> Iterator[int]:
    at = text.find("\n")
    while at >= 0:
        yield at
        at = text.find("\n", at + 1)


def allocate(start: np.ndarray, end: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether the token crosses a boundary)."""
    last = len(ends) - 1
    first = np.minimum(np.searchsorted(ends, start, side="right"), last)
    # an empty span lies behind the first byte of its character
    empty = end <= start
    first[empty] = np.minimum(np.searchsorted(ends, np.maximum(start[empty] - 1, 0), side="right"), last)
    final = np.where(empty, first, np.minimum(np.searchsorted(ends, np.maximum(end - 1, 0), side="right"), last))
    cross = np.flatnonzero(final > first)
    out = first.copy()
    if rule == "largest":
        for t in cross:
            cuts = np.concatenate([[start[t]], ends[first[t]:final[t]], [end[t]]])
            out[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return out, final > first


def section_tokens(docs: DataFrame, vocabulary: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text",
                   rule: str = "largest") -> DataFrame:
    """doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens: one row per section.

    ``n_crossing``: tokens of the section that cross one of its boundaries."""
    if rule not in RULES:
        raise ValueError(f"unknown boundary rule {rule!r}")
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("section", T.IntegerType())]
                          + [T.StructField(n, T.LongType()) for n in ("char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = load(vocabulary, pattern)
        for batch in batches:
            for part in text_slices(batch, 1):
                rows, out = [], []
                for i, t in enumerate(part.column(1).to_pylist()):
                    t = t or ""
                    ids = np.asarray(enc.encode_ordinary(t), np.int64)
                    start, end = spans(t.encode(), lengths[ids])
                    ends = section_ends(t)
                    at, crossing = allocate(start, end, ends, rule)
                    k = len(ends)
                    rows.append(np.full(k, i))
                    out.append(np.stack([np.arange(k), np.concatenate([[0], ends[:-1]]), ends, np.bincount(at, minlength=k),
                                         np.bincount(at[crossing], minlength=k), np.full(k, len(ids))]))
                cols = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(rows))), pa.array(cols[0].astype(np.int32)),
                                                  *[pa.array(c) for c in cols[1:]]],
                                                 names=["doc_id", "section", "char_start", "char_end", "n_tokens", "n_crossing", "doc_tokens"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
