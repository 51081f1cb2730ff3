"""Token ids of whole texts by a public byte-level BPE.

Encoding is a reduction over a tree of text pieces. A piece is cut into halves until it is short; a short piece keeps the
ids of its middle, and as text what stands before its first and behind its last *settled* place. Settled is a place at
which the tokenizer's word pattern divides whatever comes before or after: where the kind of character (letter, number,
white space, other) changes, unless a space or an apostrophe stands in front, since these may join what follows. Two
neighbours are joined by encoding the window between the last settled place of the left and the first of the right; a
piece without any settled place lets the window grow to the next one. So the ids outside the window are proven to be
those of the whole text, and decoding is the concatenation of the parts. Every text goes up the tree, a short one as a
tree of one leaf. A text is one row, and so are its ids, which bounds both to what a row may hold (2 GB).
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("LINELORE_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the word pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF_CHARS = 256

# Control characters that libraries class differently are never taken for either kind.
_OTHER = r"[^\s\p{L}\p{N}\x1c-\x1f\x85\u180e\u200b]"
_SETTLED = regex.compile(rf"(?<=\p{{L}})(?=[^\p{{L}}])|(?<=\p{{N}})(?=[^\p{{N}}])|(?<={_OTHER})(?=[ \t\r\n])|(?<={_OTHER})(?<!')(?=[\p{{L}}\p{{N}}])")
_SETTLED_REV = regex.compile(_SETTLED.pattern, regex.REVERSE)


@functools.lru_cache(maxsize=4)
def codec(folder: str = TOKENIZERS, ranks: str = RANKS):
    """The tokenizer; its files are read in place, once per worker process."""
    import tiktoken

    with open(os.path.join(folder, ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


@dataclass
class Piece:
    """``head`` + ids + ``tail``; a piece without settled place is all head and has ``open`` set."""

    head: str
    ids: list[list[int]]
    tail: str
    open: bool


def leaf(text: str, encode) -> Piece:
    first = _SETTLED.search(text)
    if first is None:
        return Piece(text, [], "", True)
    a, b = first.start(), _SETTLED_REV.search(text).start()
    return Piece(text[:a], [encode(text[a:b])] if b > a else [], text[b:], False)


def join(left: Piece, right: Piece, encode) -> Piece:
    """Of two neighbouring pieces. Associative; the empty text is neutral."""
    if left.open and right.open:
        return leaf(left.head + right.head, encode) if left.head and right.head else left if left.head else right
    if left.open:  # the cut itself may be a settled place
        grown = leaf(left.head + right.head, encode) if left.head and right.head else None
        if grown is None or grown.open:
            return Piece(left.head + right.head, right.ids, right.tail, False)
        mid = encode(grown.tail) if grown.tail else []
        return Piece(grown.head, [*grown.ids, mid, *right.ids], right.tail, False)
    if right.open:
        grown = leaf(left.tail + right.head, encode) if left.tail and right.head else None
        if grown is None or grown.open:
            return Piece(left.head, left.ids, left.tail + right.head, False)
        mid = encode(grown.head) if grown.head else []
        return Piece(left.head, [*left.ids, mid, *grown.ids], grown.tail, False)
    window = left.tail + right.head
    return Piece(left.head, [*left.ids, encode(window) if window else [], *right.ids], right.tail, False)


def reduce_text(text: str, encode, leaf_chars: int = LEAF_CHARS) -> Piece:
    if len(text) <= leaf_chars:
        return leaf(text, encode)
    mid = len(text) // 2
    return join(reduce_text(text[:mid], encode, leaf_chars), reduce_text(text[mid:], encode, leaf_chars), encode)


def encode_text(text: str | None, encode, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """All ids of a text; none for null and empty texts."""
    if not text:
        return []
    p = reduce_text(text, encode, leaf_chars)
    out = encode(p.head) if p.head else []
    for x in p.ids:
        out.extend(x)
    return out + (encode(p.tail) if p.tail else [])


def _encode(folder: str, ranks: str, count: bool, leaf_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(folder, ranks).encode_ordinary
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for i in range(0, b.num_rows, 512):
                ids = [encode_text(t, encode, leaf_chars) for t in texts.slice(i, 512).to_pylist()]
                out = pa.array([len(x) for x in ids], pa.int32()) if count else pa.array(ids, pa.list_(pa.int32()))
                yield pa.record_batch([*(b.column(c).slice(i, 512) for c in range(b.num_columns - 1)), out], names=[*b.schema.names[:-1], "n_tokens" if count else "ids"])

    return run


def _apply(df: DataFrame, keep: list[str], text: str, count: bool, folder: str, ranks: str, leaf_chars: int) -> DataFrame:
    src = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = ", ".join(f"`{k}` {t}" for k, t in src.dtypes[:-1])
    return src.mapInArrow(_encode(folder, ranks, count, leaf_chars), f"{fields}, " + ("n_tokens int" if count else "ids array<int>"))


def encode(df: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` columns and ``ids``: the whole text's token ids without special tokens; empty for null and empty texts.

    Strings that look like special tokens are ordinary text. Repeated rows are encoded each. No row moves between tasks.
    """
    return _apply(df, keep, text, False, folder, ranks, leaf_chars)


def tree_size(df: DataFrame, keep: list[str], text: str = "text", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` columns, ``leaves`` and ``joins`` of each text's tree; an empty or null text has none.

    After k halvings the pieces of n characters have floor(n / 2^k) characters, and n mod 2^k of them one more.
    """
    n = F.coalesce(F.length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("bigint")
    k = F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(leaf_chars)))))
    half = F.pow(F.lit(2), k - 1).cast("bigint")
    leaves = F.when(n == 0, 0).when(k == 0, 1).when(F.floor(n / half) > leaf_chars, half * 2).otherwise(half + n % half)
    return df.select(*[F.col(f"`{c}`") for c in keep], leaves.cast("bigint").alias("leaves"), F.greatest(leaves - 1, F.lit(0)).cast("bigint").alias("joins"))


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, ranks: str = RANKS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keep`` columns and ``n_tokens``, by the same reduction; 0 for null and empty texts."""
    return _apply(df, keep, text, True, folder, ranks, leaf_chars)


def decode(df: DataFrame, keep: list[str], folder: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """``keep`` columns and ``text`` from ``ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(folder, ranks)
        for b in batches:
            texts = [None if x is None else c.decode_bytes(x).decode("utf-8", "replace") for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(texts, pa.string())], names=[*b.schema.names[:-1], "text"])

    src = df.select(*[F.col(f"`{k}`") for k in keep], F.col("ids"))
    return src.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in src.dtypes[:-1]) + ", text string")
