"""Command fingerprints: FNV-1a, 64 bit, of the lower-cased command with white space collapsed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the FNV-1a 64-bit hash.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def fingerprint_value(command: str | None) -> str | None:
    """Of one command; null for null, empty for a command without any word."""
    if command is None:
        return None
    text = " ".join(command.split()).lower()
    if not text:
        return ""
    h = FNV_OFFSET
    for b in text.encode("utf-8", "surrogatepass"):
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def fingerprint_values(commands) -> list[str | None]:
    """Of many commands: each distinct text is hashed once, all of them byte column by byte column.

    Very long commands are hashed one at a time, so that one of them doesn't widen the whole block.
    """
    memo: dict[str | None, str | None] = {None: None}
    block: list[tuple[str, bytes]] = []
    for c in set(commands):
        if c is None or c in memo:
            continue
        raw = " ".join(c.split()).lower().encode("utf-8", "surrogatepass")
        if not raw or len(raw) > 512:
            memo[c] = fingerprint_value(c)
        else:
            block.append((c, raw))
    if block:
        size = np.array([len(r) for _, r in block])
        wide = np.zeros((len(block), int(size.max())), dtype=np.uint64)
        for i, (_, r) in enumerate(block):
            wide[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
        h = np.full(len(block), FNV_OFFSET, dtype=np.uint64)
        prime = np.uint64(FNV_PRIME)
        with np.errstate(over="ignore"):
            for j in range(wide.shape[1]):
                h = np.where(j < size, (h ^ wide[:, j]) * prime, h)
        for (c, _), v in zip(block, h):
            memo[c] = f"{int(v):016x}"
    return [memo[c] for c in commands]


@F.pandas_udf(T.StringType())
def fingerprint(command: pd.Series) -> pd.Series:
    return pd.Series(fingerprint_values(command.where(command.notna(), None).tolist()), dtype=object)


def resolved_fingerprint(stored: Column, command: Column) -> Column:
    """The stored fingerprint, or the one that the command has by the rule where none is stored."""
    return F.coalesce(stored, fingerprint(F.when(stored.isNull(), command)))
