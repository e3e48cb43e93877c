"""Packed request and reply between chunks of documents and buckets of 64-bit keys.

A chunk is a set of documents, dealt by content, whose rows one task sees together. It asks about its
distinct keys; a bucket sees all requests for its range of keys and answers each in the order asked.
Requests are pre-aggregated (a key stands once per chunk, however often it is used), so a key that
holds a third of all rows costs its bucket one entry per chunk; replies repeat no keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, tidied

U = np.uint64
C1, C2, C3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix's finaliser)."""
    x = x ^ (x >> U(30))
    x *= C1
    x ^= x >> U(27)
    x *= C2
    x ^= x >> U(31)
    return x


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name for the pair of two names."""
    x = a * C3
    x += b
    return mixed(x)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, without the planes that are all zero, or as bits."""
    x = np.ascontiguousarray(x, dtype="<u8")
    if not len(x):
        return b""
    if x.max() <= 1:
        return bytes([0, -len(x) % 8]) + np.packbits(x.astype(np.uint8)).tobytes()
    planes = x.view(np.uint8).reshape(-1, 8).T
    n = 8
    while n > 1 and not planes[n - 1].any():
        n -= 1
    return bytes([n]) + np.ascontiguousarray(planes[:n]).tobytes()


def unpack(b: bytes, dtype=np.uint64) -> np.ndarray:
    if not b:
        return np.zeros(0, dtype)
    if b[0] == 0:
        bits = np.unpackbits(np.frombuffer(b, np.uint8, offset=2))
        return bits[: len(bits) - b[1]].astype(dtype)
    n, raw = b[0], np.frombuffer(b, np.uint8, offset=1)
    m = len(raw) // n
    out = np.zeros((m, 8), np.uint8)
    out[:, :n] = raw.reshape(n, m).T
    return out.reshape(-1).view("<u8").astype(dtype, copy=False)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending integers by their differences."""
    if not len(x):
        return b""
    d = np.empty_like(x)
    d[0] = x[0]
    np.subtract(x[1:], x[:-1], out=d[1:])
    return pack(d)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def bounds(keys: np.ndarray, buckets: int, bits: int = 64) -> np.ndarray:
    """Places in sorted keys of so many bits where each bucket (leading bits) begins, and the end."""
    if buckets == 1:
        return np.array([0, len(keys)])
    edges = np.arange(1, buckets, dtype=np.uint64) << U(bits - (buckets.bit_length() - 1))
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


REQUEST = "chunk long, bucket long, keys binary, extra binary"
REPLY = "chunk long, bucket long, reply binary, sums array<long>"


def requests(chunk: int, keys: np.ndarray, extra: np.ndarray, buckets: int, bits: int = 64) -> list[tuple]:
    """Rows that ask about sorted distinct keys of so many bits, with one extra number each."""
    at, rows = bounds(keys, buckets, bits), []
    low = U((1 << bits) // buckets - 1)
    for b in np.flatnonzero(at[1:] > at[:-1]):
        own = slice(at[b], at[b + 1])
        rows.append((chunk, int(b), pack_sorted(keys[own] & low), pack(extra[own])))
    return rows


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    return tidied(pd.DataFrame(rows, columns=["chunk", "bucket", "keys", "extra"]))


def answered(asked: DataFrame, buckets: int, answer: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(chunk, bucket, reply) for each request row.

    answer(keys, extra) sees a whole bucket: all keys that chunks asked about, and their extra
    numbers; it gives a number for each, or that and a list of sums, which go into a row of chunk -1."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk", kind="stable").reset_index(drop=True)
        parts = [unpack_sorted(b) for b in g["keys"]]
        n = [len(p) for p in parts]
        keys = np.concatenate(parts)
        del parts
        got = answer(keys, np.concatenate([unpack(b) for b in g["extra"]]))
        got, sums = got if isinstance(got, tuple) else (got, None)
        rows = [(c, b, pack(x), None) for c, b, x in zip(g["chunk"], g["bucket"], np.split(got, np.cumsum(n)[:-1]))]
        if sums is not None:
            rows.append((-1, int(g["bucket"].iloc[0]), b"", sums))
        return tidied(pd.DataFrame(rows, columns=["chunk", "bucket", "reply", "sums"]))

    return dealt(asked, buckets, "bucket").groupBy("bucket").applyInPandas(run, REPLY)


def replies_of(g: pd.DataFrame) -> np.ndarray:
    """All replies of one chunk, in the order of its sorted keys."""
    g = g.sort_values("bucket", kind="stable")
    parts = [unpack(b) for b in g["reply"]]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
