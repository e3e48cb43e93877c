"""Mixing sources to target weights by balanced sampling (the cube method).

Every document gets the inclusion number target/size of its source: a whole part of sure copies and
a fractional probability. Flight phase: within blocks of a source the fractional probabilities walk
through the null space of the balancing constraints (number of documents, number of tokens) until at
most two per block are still open; the open ones of several blocks meet in the next level, until a
source is one block. Landing phase: the last two or so are drawn by their probabilities, jointly so that the
token total is expected to come nearest.

Targets of few sources are shared out on the driver; those of more by sums over the table of sources, round by
round, until no further source is full.

Defined cases: a null or empty text has size 0 and is drawn like any other; a null source is a source
of its own, last in order; repeated rows (and equal doc_ids) are separate documents; an empty table
gives an empty result; a null weight list falls back to equal weights; extra columns are kept, and
those called as the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, heavy_join, stored

#: Sources whose table is gathered and broadcast; that of more stays distributed.
FEW_SOURCES = 10_000
#: Documents in a block of the first level, and blocks that meet in one block of the next.
BLOCK, FAN = 4_000, 4_000
EPS = 1e-9


def targets(sizes: list[float], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size: the excess goes to the others by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if w <= 0 or left * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def _ranked_sources(t: DataFrame) -> DataFrame:
    """t(source, ...) with each source's rank in code-point order, null last."""
    edges = t.where("source is not null").sample(min(1.0, FEW_SOURCES / max(1, t.count())), 7).select("source").limit(2 * FEW_SOURCES).collect()
    step = max(1, len(edges) // 64)
    edges = sorted({r.source for r in edges}, key=lambda x: x.encode())[::step]
    part = F.when(F.col("source").isNull(), F.lit(len(edges) + 1)).otherwise(sum((F.when(F.col("source") >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    t = t.withColumn("__part", part)
    start, rows = 0, []
    for r in sorted(t.groupBy("__part").agg(F.count("*").alias("n")).collect(), key=lambda r: r["__part"]):
        rows.append((r["__part"], start))
        start += r["n"]
    starts = F.create_map(*[F.lit(x) for r in rows for x in r])
    own = Window.partitionBy("__part").orderBy("source")
    return t.withColumn("rank", F.row_number().over(own) - 1 + starts[F.col("__part")]).drop("__part")


def source_targets(sized: DataFrame, weights: Iterable[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target) for the sources of sized(source, size), in code-point order, null last."""
    w = list(weights) or [1]
    t = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    schema = "source string, source_size long, target double"
    if t.count() <= FEW_SOURCES:
        rows = sorted(t.collect(), key=lambda r: (r.source is None, (r.source or "").encode()))
        sizes = [r.source_size for r in rows]
        got = targets(sizes, [w[i % len(w)] for i in range(len(rows))], share * sum(sizes), most)
        return sized.sparkSession.createDataFrame([(r.source, r.source_size, x) for r, x in zip(rows, got)], schema)
    weight = F.array(*[F.lit(float(x)) for x in w])[(F.col("rank") % len(w)).cast("int")]
    t = stored(_ranked_sources(t).select("source", "source_size", weight.alias("weight")))
    total = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    left, open_, full = total, t.agg(F.sum("weight")).first()[0], F.lit(False)
    while open_:
        full = full | (F.lit(left) * F.col("weight") / F.lit(open_) >= F.lit(most) * F.col("source_size"))
        r = t.agg(F.sum(F.when(full, F.col("source_size"))).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        before, left, open_ = (left, open_), total - most * (r["cap"] or 0), r["w"] or 0.0
        if (left, open_) == before:
            break
    own = F.lit(left) * F.col("weight") / F.lit(open_ or 1.0)
    return t.select("source", "source_size", F.when(full, F.lit(float(most)) * F.col("source_size")).otherwise(own).cast("double").alias("target"))


def _draws(seed: str) -> "np.random.Generator":
    return np.random.Generator(np.random.PCG64(int.from_bytes(hashlib.blake2b(seed.encode(), digest_size=8).digest(), "big")))


def flight(p: np.ndarray, size: np.ndarray, seed: str) -> np.ndarray:
    """Moves probabilities along (1, size)'s null space until at most two are strictly between 0 and 1."""
    p, s = p.astype(float).tolist(), size.astype(float).tolist()
    u = iter(_draws(seed).random(len(p) + 8).tolist())
    window: list[int] = []

    def move(ids: list[int], v: list[float]) -> None:
        up = down = float("inf")
        for i, d in zip(ids, v):
            if d > 0:
                up, down = min(up, (1 - p[i]) / d), min(down, p[i] / d)
            elif d < 0:
                up, down = min(up, p[i] / -d), min(down, (1 - p[i]) / -d)
        step = up if next(u, 0.5) * (up + down) < down else -down
        for i, d in zip(ids, v):
            x = p[i] + step * d
            p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x

    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            window.append(i)
        if len(window) == 3:
            a, b, c = window
            v = [s[c] - s[b], s[a] - s[c], s[b] - s[a]]
            big = max(map(abs, v))
            move(window, [x / big for x in v] if big else [1.0, -1.0, 0.0])
            window = [j for j in window if 0 < p[j] < 1]
    if len(window) == 2 and s[window[0]] == s[window[1]]:
        move(window, [1.0, -1.0])
    out = np.array(p)
    return np.where(out < EPS, 0.0, np.where(out > 1 - EPS, 1.0, out))


def landed(p: np.ndarray, size: np.ndarray, u: float) -> np.ndarray:
    """The few open probabilities drawn by u in (0, 1): each by its own probability, two of them jointly so that
    the token total is expected to come nearest."""
    out, open_ = p.copy(), np.flatnonzero((p > 0) & (p < 1)).tolist()
    while open_:
        a, b = open_[0], open_[1] if len(open_) > 1 else None
        open_ = open_[2:]
        if b is None:
            out[a] = float(u < p[a])
            continue
        miss = lambda x, y: abs((x - p[a]) * size[a] + (y - p[b]) * size[b])
        # the chance of both, between what their probabilities admit: the cost is linear in it
        low, high = max(0.0, p[a] + p[b] - 1), min(p[a], p[b])
        both = high if miss(1, 1) + miss(0, 0) < miss(1, 0) + miss(0, 1) else low
        out[a], out[b] = (1, 1) if u < both else (1, 0) if u < p[a] else (0, 1) if u < p[a] + p[b] - both else (0, 0)
        u = (u * 7919.0) % 1.0
    return out


def with_targets(docs: DataFrame, size: Column, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(doc_id, source, size, source_size, target, __sure, __p) for each row of docs."""
    sized = docs.withColumn("size", size.cast("long"))
    t = source_targets(sized.select("source", "size"), weights, share, most)
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    t = t.withColumn("__name", name).drop("source")
    d = sized.drop("source_size", "target").withColumn("__name", name)
    few = t.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    d = (d.join(F.broadcast(t), "__name") if few else heavy_join(d, t, "__name", "doc_id")).drop("__name")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumn("__sure", F.floor(ratio + EPS))
    return d.withColumn("__p", F.greatest(F.lit(0.0), ratio - F.col("__sure")))


def cube(d: DataFrame, seed: str = "mix-1") -> DataFrame:
    """d(doc_id, source, size, __sure, __p, ...) with copies, all rows kept.

    Each level deals rows to (source, block), flies, and sends on the open rows alone; rows that are
    decided leave with their level."""
    id_type = dict(d.dtypes)["doc_id"]
    d = d.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn ids with nulls into floats
    total = d.count()
    blocks = max(1, -(-total // BLOCK))
    key = F.xxhash64("doc_id", "source", "size")
    d = d.withColumn("__block", F.pmod(key, F.lit(blocks)))
    fields = d.schema.simpleString()[len("struct<") : -1]
    cols = d.columns

    def fly(last: bool):
        def run(key, g: pd.DataFrame) -> pd.DataFrame:
            # large documents first: those that stay open for landing are the small ones
            order = g[["size", "doc_id"]].assign(h=pd.util.hash_array(g["doc_id"].astype(str).to_numpy(dtype=object))).sort_values(["size", "h"], ascending=[False, True], kind="stable").index
            g = g.loc[order].reset_index(drop=True)
            own = f"{seed}|{key[0]}|{int(key[1])}"
            p = flight(g["__p"].to_numpy(), g["size"].to_numpy(), own)
            g["__p"] = landed(p, g["size"].to_numpy(), float(_draws(f"{own}|landing").random())) if last else p
            return g[cols]

        return run

    done = None
    while True:
        flown = cut(d.groupBy("source", "__block").applyInPandas(fly(blocks == 1), fields))
        decided = flown if blocks == 1 else flown.where((F.col("__p") <= 0) | (F.col("__p") >= 1))
        done = decided if done is None else done.unionByName(decided)
        if blocks == 1:
            break
        blocks = max(1, -(-blocks // FAN))
        d = flown.where((F.col("__p") > 0) & (F.col("__p") < 1)).withColumn("__block", F.pmod(F.col("__block"), F.lit(blocks)))
    return done.withColumn("copies", (F.col("__sure") + F.round("__p")).cast("long")).withColumn("doc_id", F.col("doc_id").cast(id_type)).drop("__sure", "__p", "__block")


def mixed_rows(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as it is taken.

    Rows are told apart by 128 bits of a hash of their content. Equal rows share what they were dealt: each is repeated by
    the whole part, and one of them by the rest too."""
    columns = docs.columns
    every = [F.col(f"`{c}`") for c in columns]
    d = docs.withColumn("__key", F.concat_ws(":", *[F.xxhash64(F.lit(k), *every, *[c.isNull() for c in every]) for k in (1, 2)]))
    light = d.select(F.col("__key").alias("doc_id"), "source", size.cast("long").alias("__size"))
    dealt = cube(with_targets(light, F.col("__size"), **options).select("doc_id", "source", "size", "__sure", "__p"))
    dealt = cut(dealt.groupBy(F.col("doc_id").alias("__key")).agg(F.sum("copies").alias("__c"), F.count("*").alias("__m")))
    each = F.floor(F.col("__c") / F.col("__m")).cast("int")
    joined = d.join(dealt.where("__c > 0"), "__key")
    out = joined.where(each > 0).withColumn("__i", F.explode(F.sequence(F.lit(1), each)))
    rest = dealt.where("__m > 1 and __c % __m > 0")
    if rest.limit(1).count():
        one = d.join(rest, "__key").groupBy("__key").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("__row"), F.first(F.col("__c") % F.col("__m")).cast("int").alias("__r"))
        one = one.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__r")))).select("__row.*")
        return out.select(*[F.col(f"`{c}`") for c in columns]).unionByName(one)
    return out.select(*[F.col(f"`{c}`") for c in columns])


def op1_mixing(spark, sf_dir):
    from .common import table

    docs = table(spark, sf_dir, "documents")
    d = cube(with_targets(docs, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD))).select("doc_id", "source", "size", "source_size", "target", "__sure", "__p"))
    return d.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
