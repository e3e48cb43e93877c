"""Exact repeated-substring removal by difference-cover blockwise suffix sorting.

Only ties over WINDOW bytes matter, so suffixes are compared that far. The cover sample are the positions
of each document whose offset modulo PERIOD is in a difference cover: for any two suffixes there is a
shift below PERIOD that takes both into the sample. Two suffixes that tie over WINDOW bytes share, at
that shift d, the rank of the sample string there (SAMPLE bytes), the d bytes before it and the
PERIOD - 1 - d bytes behind it; the other way round, sharing these three they tie.

1. Names of sample strings are exchanged to find those that a single text has; these can tie with no other
   and leave. A name is a hash, and all it can do is keep a suffix in the sort.
2. The sample suffixes that stay are sorted by their bytes, one range of leading bytes (bucket) at a time, in
   as many passes over the buckets as keep what is shuffled below the size of the texts. The place of
   a sample string in its bucket's order is its rank. Inside a rank, the orders of the bytes behind and of the bytes
   before (read backwards) and their common lengths say for every shift which suffixes tie, and the smallest
   document among these takes the window. Bytes alone decide.
3. Each text's removed windows are joined to spans.

Memory is bounded by a chunk of texts or a bucket. A sample string of very many texts would make a bucket
of its own; its windows are asked about one by one instead, dealt by all their bytes, once for each chunk.
Copies of a text collapse first: all but the smallest id lose every byte, and ids never gather by text.
Windows never cross documents; all strings are judged on the input.

Defined cases: null text is empty; texts below WINDOW bytes lose nothing; a null doc_id neither loses
bytes nor takes any; equal doc_ids don't take from one another; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, heavy_join, parsed, stored, tidied
from .exchange import REQUEST, answered, as_frame, joined, mixed, pack, pack_sorted, power_of_two, replies_of, requests, text_bytes, unpack, unpack_sorted

WINDOW = 50
#: A perfect difference cover: every shift modulo PERIOD is a difference of two of its members.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
SAMPLE, SIDE = WINDOW - PERIOD + 1, PERIOD - 1
#: Bits of a sample string's name in requests.
BITS = 48
CHUNK_BYTES, BUCKET_KEYS, GROUP_BYTES = 4 << 20, 1 << 20, 1 << 16
#: Sample suffixes in a bucket aimed at; ranges of leading bytes at most, split by hash from there on; strings that the ranges are chosen from.
BUCKET_SUFFIXES, RANGES, SPLITTERS = 400_000, 4_096, 40_000
#: Bytes of sample suffixes that a pass shuffles, as a part of the texts' bytes.
PASS_SHARE = 0.8
#: Texts with one sample string from which on its windows are asked about one by one.
HOT = 4_096
#: A record: the sample string, what is behind it, what is before it, and how many bytes of either are the text's.
WIDTH = SAMPLE + 2 * SIDE + 2
BEFORE, BEHIND = WIDTH - 2, WIDTH - 1
FIRST = mixed(np.arange(1, 257, dtype=np.uint64))
NONE = hashlib.sha256(b"").hexdigest()
PIECE = "buf binary, starts binary, ids binary, places binary, hot binary, names array<string>, hits long"


def covered(n: int) -> np.ndarray:
    """Cover positions of a text of n bytes that a whole sample string starts at."""
    last = n - SAMPLE
    if last < 0:
        return np.zeros(0, np.int64)
    at = (np.arange(last // PERIOD + 1)[:, None] * PERIOD + np.array(COVER)).reshape(-1)
    return at[: np.searchsorted(at, last, side="right")]


def named(buf: np.ndarray, levels: int) -> np.ndarray:
    """Names of the strings of 2 ** levels bytes at every position, by doubling."""
    x = FIRST[buf]
    for k in range(levels):
        x = joined(x[: max(0, len(x) - (1 << k))], x[1 << k :])
    return x


class Texts:
    """The distinct texts of a chunk that can lose or take bytes, hashed group by group."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.groups, at = texts, [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= GROUP_BYTES):
                size += len(texts[end])
                end += 1
            self.groups.append((at, end))
            at = end

    def hashed(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per group: offsets in their text, texts and names of its sample strings."""
        for a, b in self.groups:
            own = self.texts[a:b]
            at = [covered(len(t)) for t in own]
            offset, count = np.concatenate(at), [len(x) for x in at]
            place = offset + np.repeat(np.cumsum([0, *map(len, own)])[:-1], count)
            h = named(np.frombuffer(b"".join(own), np.uint8), 4)
            yield offset, np.repeat(np.arange(a, b), count), joined(h[place], h[place + SAMPLE - 16]) >> np.uint64(64 - BITS)

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct names of sample strings, and how many texts have each, 255 at most."""
        parts = [(t, k) for _, t, k in self.hashed()]
        t, k = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        if len(self.texts) <= 1 << (64 - BITS):  # name and text in one number: a plain sort
            both = np.sort(k << np.uint64(64 - BITS) | t.astype(np.uint64))
            k, t = both >> np.uint64(64 - BITS), both & np.uint64((1 << (64 - BITS)) - 1)
        else:
            order = np.lexsort((t, k))
            k, t = k[order], t[order]
        same = k[1:] == k[:-1]
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        apart = np.concatenate([[False], same & (t[1:] != t[:-1])])
        return k[first], np.minimum(1 + np.add.reduceat(apart.astype(np.int64), first), 255).astype(np.uint64)

    def shared(self, replies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts, offsets and replies of the sample suffixes that may tie; replies by distinct name in order."""
        hashed = list(self.hashed())
        _, _, run = _runs(np.concatenate([k for *_, k in hashed]))
        said = replies[run]
        hit = np.flatnonzero(said)
        return np.concatenate([t for _, t, _ in hashed])[hit], np.concatenate([p for p, *_ in hashed])[hit], said[hit]


def _signed(x: np.ndarray) -> np.ndarray:
    """Signed ids as unsigned numbers: zigzag, so that small ones stay small."""
    return ((x << 1) ^ (x >> 63)).astype(np.uint64)


def _unsigned(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(1)).astype(np.int64) ^ -(x & np.uint64(1)).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, starts of the runs of ties in it, and each key's run."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    run = np.empty(len(keys), np.int64)
    run[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), run


def _strings(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as strings of one length, which sort as bytes do."""
    x = np.ascontiguousarray(x)
    return x.view(f"S{x.shape[1]}").reshape(-1)


def records(buf: np.ndarray, starts: np.ndarray, places: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records of sample suffixes, their texts, and the places of their sample strings.

    buf holds texts from starts on. Instead of a hot one there is a record for each window around it,
    as a sample string with nothing before it."""
    text = np.searchsorted(starts, places, side="right") - 1
    before, behind = np.minimum(SIDE, places - starts[text]), np.minimum(SIDE, starts[text + 1] - places - SAMPLE)
    cold = ~hot
    at, own, left, right = places[cold], text[cold], before[cold], behind[cold]
    if hot.any():
        d = np.arange(PERIOD)
        i, j = np.nonzero((d <= before[hot][:, None]) & (SIDE - d <= behind[hot][:, None]))
        more, k = np.unique(places[hot][i] - j, return_index=True)
        at, own = np.concatenate([at, more]), np.concatenate([own, text[hot][i[k]]])
        left, right = np.concatenate([left, np.zeros(len(more), np.int64)]), np.concatenate([right, np.full(len(more), SIDE)])
    every = sliding_window_view(np.concatenate([np.zeros(SIDE, np.uint8), buf, np.zeros(SAMPLE + SIDE, np.uint8)]), SAMPLE + 2 * SIDE)[at]
    out = np.empty((len(at), WIDTH), np.uint8)
    out[:, : SAMPLE + SIDE], out[:, SAMPLE + SIDE : BEFORE] = every[:, SIDE:], every[:, :SIDE]
    out[:, BEFORE], out[:, BEHIND] = left, right
    for c, have, place in ((0, left, SAMPLE + SIDE), (1, right, SAMPLE)):
        short = np.flatnonzero(have < SIDE)  # no byte of another text
        col = np.arange(SIDE)
        block = out[short, place : place + SIDE]
        block[(col < SIDE - have[short][:, None]) if c == 0 else (col >= have[short][:, None])] = 0
        out[short, place : place + SIDE] = block
    return out, own, at


def bucket_of(rec: np.ndarray, splits: np.ndarray, parts: int) -> np.ndarray:
    """Buckets: the range of leading bytes, and within it a part by hash. Plain windows are dealt by all their bytes."""
    key = rec[:, :WINDOW].copy()
    key[rec[:, BEFORE] > 0, SAMPLE:] = 0
    key[rec[:, BEHIND] < SIDE, SAMPLE:] = 0
    out = np.searchsorted(splits, _strings(key), side="right").astype(np.int64) if len(splits) else np.zeros(len(rec), np.int64)
    if parts > 1:
        h = np.zeros(len(rec), np.uint64)
        for x in np.pad(key, ((0, 0), (0, -WINDOW % 8))).view("<u8").T:
            h = joined(h, x)
        out = out * parts + (h % np.uint64(parts)).astype(np.int64)
    return out


def _grouped(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether a smaller id has an equal x."""
    order, first, run = _runs(x)
    return ids > np.minimum.reduceat(ids[order], first)[run]


def _common(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it; -1 where a run begins."""
    out = np.full(len(x), -1, np.int64)
    same = x[1:] == x[:-1]
    out[1:] = np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))
    out[new] = -1
    return out


def ties(rec: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each record a bit by shift: whether the window that begins so many bytes before is one of a smaller id.

    The records of a bucket are sorted by sample string, then by what is behind it."""
    out, shifts = np.zeros(len(rec), np.uint32), np.arange(PERIOD)
    if len(rec) < 2:
        return out
    order = np.argsort(_strings(rec), kind="stable")
    s, own = rec[order], ids[order]
    new = np.concatenate([[True], (s[1:, :SAMPLE] != s[:-1, :SAMPLE]).any(axis=1)])
    first = np.flatnonzero(new)
    rank, size = np.cumsum(new) - 1, np.diff(np.append(first, len(s)))
    other = np.concatenate([[False], (s[1:] != s[:-1]).any(axis=1)]) & ~new
    mixed_rank = np.logical_or.reduceat(other, first)
    bits = np.zeros(len(s), np.uint32)
    # ranks whose records are all alike: one minimum answers for every shift
    alike = np.flatnonzero((~mixed_rank & (size > 1))[rank])
    if len(alike):
        whole = ((shifts <= s[alike, BEFORE][:, None]) & (SIDE - shifts <= s[alike, BEHIND][:, None])) @ (1 << shifts).astype(np.uint32)
        least = np.minimum.reduceat(own, first)[rank]
        bits[alike] = np.where(own[alike] > least[alike], whole, 0)
    part = np.flatnonzero(mixed_rank[rank])
    if len(part):
        t, own, rank = s[part], own[part], rank[part]
        new = np.concatenate([[True], rank[1:] != rank[:-1]])
        behind = _common(t[:, SAMPLE : SAMPLE + SIDE], new)
        before = t[:, SAMPLE + SIDE : BEFORE][:, ::-1]
        back = np.argsort(_strings(np.concatenate([rank.astype(">u4").view(np.uint8).reshape(-1, 4), before], axis=1)), kind="stable")
        ahead = _common(before[back], np.concatenate([[True], rank[back][1:] != rank[back][:-1]]))
        found, left = np.zeros(len(t), np.uint32), np.empty(len(t), np.int64)
        for d in range(PERIOD):
            left[back] = np.cumsum(ahead < d)
            key = np.cumsum(behind < SIDE - d) * (len(t) + 1) + left
            ok = np.flatnonzero((t[:, BEFORE] >= d) & (t[:, BEHIND] >= SIDE - d))
            if len(ok):
                found[ok] |= _grouped(key[ok], own[ok]).astype(np.uint32) << np.uint32(d)
        bits[part] = found
    out[order] = bits
    return out


def _collapsed(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, name, least, text): the distinct texts with their least ids, a chunk's in one partition.

    A text comes once from each partition of docs, and is merged in sorted order, not gathered."""
    given = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("name"), F.col("doc_id").cast("long").alias("least"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[str] = set()
        for b in batches:
            least, first = {}, {}
            for i, (name, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if name not in first:
                    first[name], least[name] = i, x
                elif x is not None and (least[name] is None or x < least[name]):
                    least[name] = x
            text = b.column(2).take(pa.array(list(first.values()), pa.int64()))
            new = pa.array([n not in told for n in first], pa.bool_())
            told.update(first)
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array(list(least.values()), pa.int64()), pc.if_else(new, text, pa.scalar(None, text.type))], names=["name", "least", "text"])

    rows = given.mapInArrow(run, "name string, least long, text string").withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(chunks)))
    have = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(have, -(-chunks // 16)), "chunk").groupBy("chunk", "name")
    return rows.agg(F.min("least").cast("string").alias("least"), F.first("text", ignorenulls=True).alias("text"))


def _read(g: pd.DataFrame) -> tuple[list[tuple], Texts, list[int]]:
    """The chunk's (name, least, text) by name; those that take part, and their places among all."""
    every = sorted((n, parsed(i), (t or "").encode()) for n, i, t in zip(g["name"], g["least"], g["text"]))
    part = [k for k, (_, i, t) in enumerate(every) if i is not None and len(t) >= WINDOW]
    return every, Texts([every[k][2] for k in part]), part


def _runs_of(cover: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


class Piece:
    """The texts of a chunk that have sample suffixes that may tie."""

    def __init__(self, row):
        self.buf = np.frombuffer(row["buf"], np.uint8)
        self.starts, self.ids = (np.frombuffer(row[k], np.int64) for k in ("starts", "ids"))
        self.places, self.hot = unpack_sorted(row["places"]).astype(np.int64), unpack(row["hot"]) > 0
        self.names = row["names"]

    def asked(self, splits: np.ndarray, parts: int, low: int, high: int):
        """Distinct records by bucket, for buckets low <= b < high: (bucket, records, least ids), and of each
        record its place among these, its text and its place."""
        rec, text, at = records(self.buf, self.starts, self.places, self.hot)
        bucket = bucket_of(rec, splits, parts)
        own = np.flatnonzero((bucket >= low) & (bucket < high))
        rec, text, at, bucket = rec[own], text[own], at[own], bucket[own]
        order = np.argsort(_strings(rec), kind="stable")
        order = order[np.argsort(bucket[order], kind="stable")]
        s, b = rec[order], bucket[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]).any(axis=1) | (b[1:] != b[:-1])]) if len(s) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        run = np.empty(len(s), np.int64)
        run[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[text][order], first) if len(s) else np.zeros(0, np.int64)
        return b[first], s[first], least, run, text, at


def remove_repeats(docs: DataFrame, full: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and with full the spans and kept bytes."""
    total = text_bytes(docs)
    chunks = max(1, -(-total // CHUNK_BYTES))
    names = power_of_two(total * len(COVER) / PERIOD / BUCKET_KEYS)
    rows, hot_from = _collapsed(docs, chunks), HOT
    result = "name string, least long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", spans array<struct<start:long,end:long>>, kept binary" if full else "")
    columns = ["name", "least", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if full else [])]
    piece_columns = [x.split(" ")[0] for x in PIECE.split(", ")]

    def frame(out: list, more: tuple = ()) -> pd.DataFrame:
        d = pd.DataFrame(out, columns=[*columns, *more], dtype=object)
        for c in ("least", "n_bytes", "n_removed", "n_spans", *(("chunk", "hits") if more else ())):
            d[c] = pd.array(d[c].tolist(), "Int64")
        return tidied(d)

    def ask(key, g: pd.DataFrame) -> pd.DataFrame:
        _, texts, part = _read(g)
        return as_frame(requests(int(key[0]), *texts.sample(), names, BITS) if part else [])

    def count(keys, extra):
        """0 for sample strings of one text, 1 for those of several, 2 for those of very many."""
        order, first, run = _runs(keys)
        n = np.add.reduceat(extra[order], first)
        return ((n > 1).astype(np.uint64) + (n > hot_from).astype(np.uint64))[run]

    def kept_pieces(key, g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        every, texts, part = _read(g)
        owner, offset, said = texts.shared(replies_of(r)) if part else (np.zeros(0, np.int64),) * 3
        with_hits, out = np.unique(owner), []
        stay = {part[k] for k in with_hits}
        for k, (name, least, t) in enumerate(every):
            if k not in stay:
                out.append([name, least, len(t), 0, 0, name, *([[], t] if full else []), None, *[None] * len(piece_columns)])
        if len(with_hits):
            own = [texts.texts[k] for k in with_hits]
            starts = np.cumsum([0, *map(len, own)])
            places = starts[np.searchsorted(with_hits, owner)] + offset
            order = np.argsort(places)
            ids = np.array([every[part[k]][1] for k in with_hits], np.int64)
            piece = [b"".join(own), starts.astype(np.int64).tobytes(), ids.tobytes(), pack_sorted(places[order].astype(np.uint64)), pack((said[order] > 1).astype(np.uint64)), [every[part[k]][0] for k in with_hits], len(places)]
            out.append([*[None] * len(columns), int(key[0]), *piece])
        return frame(out, ("chunk", *piece_columns))

    sample = cut(answered(rows.groupBy("chunk").applyInPandas(ask, REQUEST), names, count))
    both = cut(rows.groupBy("chunk").cogroup(sample.groupBy("chunk")).applyInPandas(kept_pieces, f"{result}, chunk long, {PIECE}"))
    pieces = both.where("chunk is not null").select("chunk", *piece_columns)
    hits = pieces.agg(F.sum("hits")).first()[0] or 0
    ranges = min(RANGES, -(-hits // BUCKET_SUFFIXES)) or 1
    parts = max(1, -(-hits // (ranges * BUCKET_SUFFIXES)))
    splits = _splits(pieces, hits, ranges)
    buckets = (len(splits) + 1) * parts
    passes = int(min(buckets, max(1, -(-hits * (WIDTH + 4) // max(1, total * PASS_SHARE)))))

    def asking(low: int, high: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for _, row in b.iterrows():
                    at, rec, least, *_ = Piece(row).asked(splits, parts, low, high)
                    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]])) if len(at) else [0]
                    yield as_frame([(int(row["chunk"]), int(at[i]), rec[i:j].tobytes(), pack(_signed(least[i:j]))) for i, j in zip(edge, edge[1:])])

        return run

    def answer(g: pd.DataFrame) -> pd.DataFrame:
        rec = [np.frombuffer(b, np.uint8).reshape(-1, WIDTH) for b in g["keys"]]
        bits = ties(np.concatenate(rec), _unsigned(np.concatenate([unpack(b) for b in g["extra"]])))
        return tidied(pd.DataFrame([(c, b, pack(x)) for c, b, x in zip(g["chunk"], g["bucket"], np.split(bits, np.cumsum([len(x) for x in rec])[:-1]))], columns=["chunk", "bucket", "reply"]))

    replies = None
    for k in range(passes):
        low, high = buckets * k // passes, buckets * (k + 1) // passes
        asked = dealt(pieces.mapInPandas(asking(low, high), REQUEST), (high - low) * 8, "bucket")
        got = cut(asked.groupBy("bucket").applyInPandas(answer, "chunk long, bucket long, reply binary"))
        replies = got if replies is None else replies.unionByName(got)

    def removed(key, g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return frame([])
        piece = Piece(g.iloc[0])
        _, rec, least, run, text, at = piece.asked(splits, parts, 0, buckets)
        bits = replies_of(r).astype(np.uint32)[run]
        later = piece.ids[text] > least[run]  # the same record stands in a smaller document of the chunk
        left, right = rec[run, BEFORE], rec[run, BEHIND]
        gone = np.zeros(len(piece.buf) + 1, bool)
        for d in range(PERIOD):
            gone[at[((bits >> np.uint32(d)) & 1 > 0) | (later & (d <= left) & (SIDE - d <= right))] - d] = True
        mark = np.zeros(len(piece.buf) + 1, np.int32)
        where = np.flatnonzero(gone)
        mark[where] += 1
        mark[where + WINDOW] -= 1
        cover, out = np.cumsum(mark)[:-1] > 0, []
        for name, i, a, b in zip(piece.names, piece.ids.tolist(), piece.starts, piece.starts[1:]):
            own = cover[a:b]
            spans, kept = _runs_of(own), piece.buf[a:b][~own].tobytes()
            out.append([name, i, int(b - a), int(own.sum()), len(spans), hashlib.sha256(kept).hexdigest(), *([spans, kept] if full else [])])
        return frame(out)

    found = dealt(pieces, chunks, "chunk").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(removed, result)
    return _spread(docs, both.where("chunk is null").select(*columns).unionByName(found), full)


def _splits(pieces: DataFrame, hits: int, ranges: int) -> np.ndarray:
    """Strings that part the sample suffixes into ranges of like size, from a sample of about SPLITTERS strings."""
    if ranges < 2:
        return np.zeros(0, f"S{WINDOW}")
    step = max(1, hits // SPLITTERS)

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                p = Piece(row)
                at = p.places[int(row["chunk"]) % step :: step]
                yield pd.DataFrame({"s": [p.buf[i : i + SAMPLE].tobytes() for i in at]})

    got = sorted(bytes(r.s) for r in pieces.mapInPandas(some, "s binary").collect())
    edge = [got[len(got) * k // ranges] for k in range(1, ranges)] if got else []
    return _strings(np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x in sorted(set(edge))), np.uint8).reshape(-1, WINDOW)) if edge else np.zeros(0, f"S{WINDOW}")


def _spread(docs: DataFrame, texts: DataFrame, full: bool) -> DataFrame:
    """texts' results for each row of docs."""
    ids = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("name")))
    j = heavy_join(ids, texts, "name", "doc_id")
    copy = (F.col("doc_id") > F.col("least")) & (F.col("n_bytes") >= WINDOW)
    none = F.col("doc_id").isNull()
    pick = lambda c, whole, gone: F.when(none, whole).when(copy, gone).otherwise(F.col(c)).alias(c)
    out = [F.col("doc_id"), F.col("n_bytes"), pick("n_removed", F.lit(0), F.col("n_bytes")), pick("n_spans", F.lit(0), F.lit(1)), pick("kept_sha256", F.col("name"), F.lit(NONE))]
    if full:
        one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
        out += [pick("spans", F.col("spans"), one), pick("kept", F.col("kept"), F.lit(b""))]
    return j.select(*out)


def op3_suffix_dedup(spark, sf_dir):
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents"))
