"""Words and shingles of texts as 64-bit names, by whole batches."""

from __future__ import annotations

import hashlib

import numpy as np

from .exchange import joined, mixed

#: Entries of a worker's word table before it starts anew.
STORE = 150_000
_table: dict[bytes, int] = {}


def word_name(w: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without ASCII white space."""
    return text.encode().lower().split() if text else []


def names(ws: list[bytes]) -> np.ndarray:
    """The 64-bit names of words."""
    table = _table
    if len(table) > STORE:
        table.clear()
    try:
        return np.array([table[w] for w in ws], np.uint64) if ws else np.zeros(0, np.uint64)
    except KeyError:
        for w in set(ws):
            if w not in table:
                table[w] = word_name(w)
        return np.array([table[w] for w in ws], np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct names of n-word shingles; with fewer words the whole sequence as one."""
    ws = words(text)
    if not ws:
        return np.zeros(0, np.uint64)
    h = names(ws)
    k = min(n, len(h))
    x = mixed(h[: len(h) - k + 1] + np.uint64(k))
    for i in range(1, k):
        x = joined(x, h[i : len(h) - k + 1 + i])
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]
