"""LM scoring with a weighted backoff automaton.

Training documents give n-gram counts. A state is a known history; its arcs are the n-grams that
continue it, and its failure arc leads to the history without its oldest word. An arc weighs
log10 (c(h, w) + m P(w | h')) / (c(h) + m), a failure arc log10 m / (c(h) + m), and the root holds
add-one unigrams with a place for unknown words, so each state's continuations sum to one.

The whole automaton grows with the corpus and is never in one place. Documents are dealt to chunks;
a chunk asks for the counts of the n-grams that its own documents run through (training documents
bring their counts in the same request), and builds from the replies the tables of states, arcs and
failure arcs that its documents can reach. The walk goes left to right and carries a state; where the state
has no arc for a token, it takes failure arcs, adding their weights, until one has. All cursors of a
chunk move together, so that a step is a search in the arcs' table.

Defined cases: a null or empty text is the end token alone; a null doc_id is not held out; repeated
rows are scored, and counted, each for itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dealt, id_text
from .exchange import REQUEST, answered, as_frame, distinct, joined, mixed, power_of_two, replies_of, requests, text_bytes
from .shingles import names, words

CHUNK_BYTES, BUCKET_KEYS = 4 << 20, 1 << 20
#: The end token's name, and the weight of the shorter history by order.
END = np.uint64(0x5DEECE66D1234567)
BACK = {2: 200.0, 3: 50.0}


def grams(tokens: np.ndarray, starts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to order: the names of the n-grams that end at each token, and where there is one.

    starts: index of each text's first token; n-grams don't reach over it."""
    place = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.append(starts, len(tokens))))
    out, x = [], None
    for k in range(1, order + 1):
        if k == 1:
            x, has = tokens, np.ones(len(tokens), bool)
        else:
            y = np.zeros_like(tokens)
            y[1:] = joined(mixed(x[:-1] + np.uint64(k)), tokens[1:])
            x, has = y, place >= k - 1
        out.append((x, has))
    return out


#: Tokens that a cursor reads; a longer text has several, each warmed up by the tokens of its first history.
SPAN = 512


class Automaton:
    """The part of the automaton that a chunk's texts can reach.

    States are numbered from the root (0); state_of[k - 1] gives the state of a k-gram of the chunk, -1 for an
    unknown one. Arcs stand sorted by state and token beside their weight and next state; those of the
    root are found by token. fail and fail_weight hold each state's failure arc."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, order: int, count, total: int, distinct_tokens: int, back: dict[int, float]):
        """count: training counts for n-gram names; total and distinct_tokens: of the training tokens."""
        self.order, self.starts, self.floor = order, starts, total + distinct_tokens + 1.0
        self.unknown = -np.log10(self.floor)
        ids, state_of, p_before, c_before = [], [], None, None
        fail, fail_weight, keys, weights, nexts, n = [np.zeros(1, np.int64)], [np.zeros(1)], [], [], [], 1
        for k, (x, has) in enumerate(grams(tokens, starts, order), 1):
            at = np.flatnonzero(has)
            names_, first, run = np.unique(x[at], return_index=True, return_inverse=True)
            own, place = np.full(len(tokens), -1, np.int64), at[first]
            own[at] = run
            c = count(names_).astype(np.float64)
            known = np.flatnonzero(c > 0)
            if k == 1:
                self.known, suffix_state = c[own], np.zeros(len(c), np.int64)
                p = (c + 1.0) / self.floor
            else:
                suffix, history = ids[-1][place], ids[-1][place - 1]
                suffix_state = state_of[-1][suffix]
                p = (c + back[k] * p_before[suffix]) / (c_before[history] + back[k])
            if k < order:
                state = np.full(len(c), -1, np.int64)
                state[known] = np.arange(n, n + len(known))
                n += len(known)
                fail.append(suffix_state[known])
                fail_weight.append(np.log10(back[k + 1] / (c[known] + back[k + 1])))
            else:
                state = suffix_state
            if k == 1:
                self.token = own
                self.root_weight = np.where(c > 0, np.log10(p), self.unknown)
                self.root_next = np.where(c > 0, state, 0) if order > 1 else np.zeros(len(c), np.int64)
            else:
                keys.append(state_of[-1][history[known]] << 32 | ids[0][place[known]])
                weights.append(np.log10(p[known]))
                nexts.append(state[known])
            ids.append(own)
            state_of.append(state)
            p_before, c_before = p, c
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        keys = np.concatenate([*keys, np.zeros(0, np.int64)])
        at = np.argsort(keys)
        self.arcs = np.append(keys[at], np.iinfo(np.int64).max)
        self.weight, self.next = np.concatenate([*weights, np.zeros(0)])[at], np.concatenate([*nexts, np.zeros(0, np.int64)])[at]

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after its text's tokens to the left, and the failure arcs taken for it.

        Cursors go left to right, each carrying its state; all move together."""
        size = np.diff(np.append(self.starts, len(self.token)))
        spans = -(-size // SPAN)
        text = np.repeat(np.arange(len(size)), spans)
        emit = self.starts[text] + SPAN * (np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans))
        begin = np.maximum(self.starts[text], emit - (self.order - 1))
        end = np.minimum(emit + SPAN, self.starts[text] + size[text])
        longest = np.argsort(begin - end, kind="stable")
        begin, emit, end = begin[longest], emit[longest], end[longest]
        state, length = np.zeros(len(begin), np.int64), end - begin
        logs, failed = np.zeros(len(self.token)), np.zeros(len(self.token), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -t))
            place = begin[:live] + t
            w, s = self.token[place], state[:live].copy()
            acc, falls = np.zeros(live), np.zeros(live, np.int64)
            open_ = np.flatnonzero(s)
            while len(open_):
                key = s[open_] << 32 | w[open_]
                at = np.searchsorted(self.arcs, key)
                hit = self.arcs[at] == key
                got, arc = open_[hit], at[hit]
                acc[got] += self.weight[arc]
                state[got] = self.next[arc]
                miss = open_[~hit]
                acc[miss] += self.fail_weight[s[miss]]
                falls[miss] += 1
                s[got] = -1  # this cursor has moved on
                s[miss] = self.fail[s[miss]]
                open_ = miss[s[miss] > 0]
            root = np.flatnonzero(s == 0)
            acc[root] += self.root_weight[w[root]]
            state[root] = self.root_next[w[root]]
            shown = place >= emit[:live]
            logs[place[shown]], failed[place[shown]] = acc[shown], falls[shown]
        return logs, failed


def score(docs: DataFrame, order: int = 2, folds: int = 7, held_fold: int = 2, back: dict[int, float] = BACK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs."""
    total = text_bytes(docs)
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), power_of_two(total / 5 / BUCKET_KEYS * (order / 2))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select(id_text(), "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"))
    rows = dealt(rows, chunks, "chunk")

    def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
        parts = [np.append(names(words(t)), END) for t in texts]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])[:-1]

    def ask(key, g: pd.DataFrame) -> pd.DataFrame:
        tokens, starts = tokens_of(g["text"])
        trained = np.repeat(~g["held_out"].to_numpy(bool), np.diff(np.append(starts, len(tokens))))
        every = np.concatenate([x[has] for x, has in grams(tokens, starts, order)])
        weight = np.concatenate([trained[has] for _, has in grams(tokens, starts, order)])
        at = np.argsort(every, kind="stable")
        every, weight = every[at], weight[at]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        single = distinct(tokens)
        marks = np.zeros(len(first), np.uint64)
        marks[np.searchsorted(every[first], single)] = 1
        # twice the training count, plus one for unigrams
        extra = np.add.reduceat(weight.astype(np.uint64), first) * np.uint64(2) + marks
        return as_frame(requests(int(key[0]), every[first], extra, buckets))

    def total_count(keys, extra):
        at = np.argsort(keys, kind="stable")
        k = keys[at]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        begin = np.flatnonzero(first)
        sums = np.add.reduceat(extra[at] >> np.uint64(1), begin)
        single = np.maximum.reduceat(extra[at] & np.uint64(1), begin)
        out = np.empty(len(keys), np.uint64)
        out[at] = sums[np.cumsum(first) - 1]
        known = sums[single == 1]
        return out, [int((known > 0).sum()), int(known.sum())]

    asked = rows.groupBy("chunk").applyInPandas(ask, REQUEST)
    replies = cut(answered(asked, buckets, total_count))
    v, n = replies.where("chunk = -1").agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first()
    v, n = v or 0, n or 0

    def walk(key, g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(g):
            return pd.DataFrame([], columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        tokens, starts = tokens_of(g["text"])
        keys = distinct(np.concatenate([x[has] for x, has in grams(tokens, starts, order)]))
        counts = replies_of(r)
        auto = Automaton(tokens, starts, order, lambda x: counts[np.searchsorted(keys, x)], n, v, back)
        logs, known = auto.walk()[0], auto.known
        base = np.log10((known + 1.0) / auto.floor)
        return pd.DataFrame(
            {
                "doc_id": g["doc_id"], "held_out": g["held_out"],
                "n_tokens": np.diff(np.append(starts, len(tokens))), "n_known": np.add.reduceat((known > 0).astype(np.int64), starts),
                "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts),
            }
        )

    out = "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = rows.groupBy("chunk").cogroup(replies.where("chunk >= 0").groupBy("chunk")).applyInPandas(walk, out)
    return scored.withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"])).withColumn("train_tokens", F.lit(n).cast("long"))


def op2_lm_scoring(spark, sf_dir):
    from .common import table

    return score(table(spark, sf_dir, "documents"))
