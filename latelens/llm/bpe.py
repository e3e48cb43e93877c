"""BPE encoding and decoding: speculate, verify, and merge only what fails.

A text is cut at special tokens, normalised, split at white space and then by the tokenizer's
pattern. For the words not seen before, a greedy longest match over the vocabulary proposes tokens;
all adjacent pairs of a batch are then tested at once against a sorted table of known pairs, where
a pair is compatible if exact merging of its joined symbols gives back the pair. A proposal whose
pairs are all compatible is the exact encoding (merging acts on neighbours only), the other words
undergo exact merging. Words and pairs once decided are remembered in a bounded store.

Defined cases: a null text encodes as an empty one, with no tokens and an empty decoding; repeated
rows give equal rows; an empty table gives an empty result; texts are encoded whole, whatever their
length; extra columns stay out of the way, since results are built from the id and text columns.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied

#: Entries in each of the two generations of a worker's store.
STORE = 250_000
#: White space of the normaliser's pattern (the Unicode property); str.split() also cuts at 1C-1F.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SEPARATORS = regex.compile("[\\x1c-\\x1f]")
#: Outside these, character classes and case mapping differ between versions of Unicode.
UNUSUAL = regex.compile("[^\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e]")
#: Texts that are looked through before their new words are encoded together.
TOGETHER = 256


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte: itself where it is printable, else the next free code point."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = {b: chr(b) for b in kept}, 0x100
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return [out[b] for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        m = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.ids: dict[str, int] = m["vocab"]
        self.end = m.get("end_of_word_suffix") or ""
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.rank = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.symbol = _byte_symbols()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace(r"^\s", f"^{SPACE}"))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # tokens that exact merging of their own symbols can't give are never proposed
        self.proposed = {t for t in self.ids if self.merged(self.symbols(t)) == [t]}
        #: how far a proposal that starts with two given symbols can reach
        self.reach: dict[str, int] = {}
        for t in self.proposed:
            k = len(self.symbols(t))
            bare = t[: -len(self.end)] if k < len(t) else t
            self.reach[bare[:2]] = max(k, self.reach.get(bare[:2], 1))
        self.stored: dict[str, tuple[str, str, int]] = {}
        self.older: dict[str, tuple[str, str, int]] = {}
        self.known = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)

    def symbols(self, token: str) -> list[str]:
        """The initial symbols of a token's string; the word end belongs to the last of them."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Exact merging: the best-ranked neighbours first, the left-most among equals."""
        if len(parts) > 64:
            return self._merged_long(parts)
        parts, rank, none = list(parts), self.rank.get, 1 << 60
        ranks = [rank(x, none) for x in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, n log n for words of any length."""
        n = len(parts)
        if n < 2:
            return parts
        parts, nxt, prev, alive = list(parts), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x, y in ((prev[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p, ok in zip(parts, alive) if ok]

    def _greedy(self, parts: list[str]) -> list[str]:
        n, out, i, reach, proposed = len(parts), [], 0, self.reach.get, self.proposed
        s = "".join(parts)
        body = s[: len(s) - len(parts[-1]) + 1]
        while i < n:
            for j in range(min(n, i + reach(body[i : i + 2], 1)), i, -1):
                t = s[i:j] if j < n else s[i:]
                if t in proposed:
                    break
            else:
                t, j = parts[i], i + 1
            out.append(t)
            i = j
        return out

    def _compatible(self, a: np.ndarray) -> np.ndarray:
        """For pairs packed as left << 32 | right: whether merging leaves them apart."""
        new = np.unique(a)
        at = np.searchsorted(self.known, new)
        at[at == len(self.known)] = 0
        new = new[self.known[at] != new] if len(self.known) else new
        if len(new):
            good = np.array([self._apart(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in new], bool)
            both = np.concatenate([self.known, new])
            order = np.argsort(both, kind="stable")
            self.known, self.good = both[order], np.concatenate([self.good, good])[order]
        return self.good[np.searchsorted(self.known, a)]

    def _apart(self, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        return self.merged(self.symbols(a) + self.symbols(b)) == [a, b] if not (self.end and a.endswith(self.end)) else False

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of distinct pre-tokenised words."""
        if not words:
            return []
        parts = []
        for w in words:
            p = [self.symbol[b] for b in w.encode()]
            p[-1] += self.end
            parts.append(p)
        guess = [self._greedy(p) for p in parts]
        ids = [[self.ids.get(t, -1) for t in g] for g in guess]
        flat = np.array([i for x in ids for i in x], np.int64)
        owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        inner = owner[1:] == owner[:-1]
        left, right = flat[:-1][inner], flat[1:][inner]
        ok = np.ones(len(ids), bool)
        ok[owner[flat < 0]] = False
        whole = (left >= 0) & (right >= 0)
        pairs = np.unique(left[whole] << 32 | right[whole], return_inverse=True)
        if len(pairs[0]):
            fine = self._compatible(pairs[0])[pairs[1]]
            ok[owner[1:][inner][whole][~fine]] = False
        for k in np.flatnonzero(~ok):
            ids[k] = [self.ids[t] for t in self.merged(parts[k]) if t in self.ids]
        return ids

    def pieces(self, chunk: str) -> list[str]:
        """The pre-tokenised words of a text without white space."""
        return self.pattern.findall(chunk)

    def _split(self, bit: str) -> list[str]:
        """The normalised text between white space."""
        if UNUSUAL.search(bit):
            t = self.library.normalizer.normalize_str(bit)
        else:
            t = unicodedata.normalize("NFC", bit).lower()
        return [c for c in self.spaces.split(t) if c] if SEPARATORS.search(t) else t.split()

    def _learn(self, chunks: set[str]) -> None:
        """Stores the encodings of chunks; what was used last stays for two generations."""
        if len(self.stored) + len(chunks) > STORE:
            self.older, self.stored = self.stored, {}
            if len(self.known) > 4 * STORE:
                self.known, self.good = self.known[:0], self.good[:0]
        older, new = self.older, {}
        for c in chunks:
            if c in older:
                self.stored[c] = older[c]
            elif UNUSUAL.search(c):  # the library's own tables decide what is a letter here
                new[c] = [c[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(c)]
            else:
                new[c] = self.pieces(c)
        words = list({w for ws in new.values() for w in ws})
        ids = dict(zip(words, self.encode_words(words)))
        for c, ws in new.items():
            own = [i for w in ws for i in ids[w]]
            self.stored[c] = (" ".join(map(str, own)), " ".join([self.names[i] for i in own]), len(own))

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[str, str, int]]:
        """Per text: the ids joined by a space, the decoding, and the number of tokens."""
        for at in range(0, len(texts), TOGETHER):
            split = []
            for text in texts[at : at + TOGETHER]:
                bits = self.cut.split(text) if self.cut and self.cut.search(text) else [text]
                split.append([bit if k % 2 else self._split(bit) for k, bit in enumerate(bits)])
            stored = self.stored
            new = {c for bits in split for bit in bits[::2] for c in bit if c not in stored}
            if new:
                self._learn(new)
                stored = self.stored
            for bits in split:
                got: list = []
                for bit in bits:
                    if isinstance(bit, str):
                        got.append((str(self.special[bit]), bit, 1))
                        continue
                    try:
                        got += [stored[c] for c in bit]
                    except KeyError:  # a generation has ended meanwhile
                        self._learn({c for c in bit if c not in stored})
                        stored = self.stored
                        got += [x for c in bit if (x := stored.get(c) or self.older.get(c))]
                if any(not x[2] for x in got):
                    got = [x for x in got if x[2]]
                yield " ".join([x[0] for x in got]), " ".join([x[1] for x in got]), sum([x[2] for x in got])

    def encode(self, text: str) -> tuple[str, str, int]:
        return next(iter(self.encode_batch([text])))

    def forget(self) -> None:
        """Between tasks a worker keeps a small store only."""
        self.older = {}
        if len(self.stored) > STORE // 2:
            self.stored = {}

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256, decoded_sha256, and with full the ids and decoding."""
    fields = [T.StructField(key, T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if full:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    names = [f.name for f in fields]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            rows = []
            for at in range(0, len(b), TOGETHER):  # so many texts at a time are Python's
                part = b.slice(at, TOGETHER)
                for i, (ids, decoded, n) in zip(part.column(0).to_pylist(), bpe.encode_batch([x or "" for x in part.column(1).to_pylist()])):
                    row = (i, n, digest(ids), digest(decoded))
                    rows.append((*row, [int(x) for x in ids.split()], decoded) if full else row)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names=names)
        bpe.forget()
        tidied(None)

    out = df.select(F.col(key).cast("string").alias(key), text).mapInArrow(run, T.StructType(fields))
    return out.withColumn(key, F.col(key).cast(df.schema[key].dataType))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir):
    from .common import table

    return encode(table(spark, sf_dir, "documents"), default_path())
