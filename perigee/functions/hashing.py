"""Fingerprints: 64-bit FNV-1a and hashes of canonical JSON, as Arrow kernels."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def fnv1a64(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes as 16 hex digits, null staying null.

    All rows advance one byte at a time together, the longest last, so the loop runs over the
    longest text's bytes and not over rows.
    """
    data = [x.encode() if isinstance(x, str) else b"" for x in text]
    size = np.array([len(x) for x in data])
    order = np.argsort(-size, kind="stable")
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    start = (np.cumsum(size) - size)[order]
    left = size[order]
    state = np.full(len(data), 0xCBF29CE484222325, np.uint64)
    prime = np.uint64(0x100000001B3)
    live = len(data)
    for i in range(int(size.max(initial=0))):
        while live and left[live - 1] <= i:
            live -= 1
        state[:live] = (state[:live] ^ flat[start[:live] + i]) * prime
    out = np.empty(len(data), np.uint64)
    out[order] = state
    return pd.Series([format(int(v), "016x") if isinstance(x, str) else None for v, x in zip(out, text, strict=True)])


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_sha256(text: pd.Series) -> pd.Series:
    """SHA-256 of the canonical form of JSON texts; null for what isn't JSON."""

    def one(x):
        try:
            return hashlib.sha256(canonical_json(json.loads(x)).encode()).hexdigest()
        except (TypeError, ValueError):
            return None

    return text.map(one)
