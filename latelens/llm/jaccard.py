"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are distinct sequences of words (copies collapse first), columns are shingles
with their document frequency. Two rows with similarity of at least t share one of the rarest
n - ceil(t n) + 1 columns of each; columns that a single row has drop out. Products are then formed
block by block: first blocks of rows by the hub of their columns, where sizes and places in the shared
column let them reach the bound, and, after rows that proved linked have been joined into groups,
between a hub's rows and those outside its largest group. There only rows of like size share a
block: sizes of linked sets differ by a factor of t at most. Overlaps are accumulated over slices of
columns of whole sets; a pair is discarded as soon as what is left of its smaller set can't take it to
the bound, and a row with its last pair, so every link is counted exactly. A block gives back a
spanning forest of its links.

Defined cases: null or empty texts (and texts of white space) have no shingles and link with
nothing; a text with fewer words than a shingle has one shingle; rows with equal words are one class
and all linked; a null doc_id takes part as a text but gives its group no name (a group of null ids
has a null component); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PER_TASK, cut, heavy_join, stored, tidied
from .components import components, forest
from .exchange import REQUEST, answered, as_frame, mixed, power_of_two, replies_of, requests, text_bytes
from .shingles import shingle_set, words

#: Text in a chunk, keys in a bucket, rows in a block of the product.
CHUNK_BYTES, BUCKET_KEYS, BLOCK = 4 << 20, 1 << 20, 256
#: Shingles and rows in a block of the exact product, and columns in a slice of it.
BLOCK_SHINGLES, BLOCK_ROWS, SLICE = 400_000, 1_024, 2_048
#: Bits of the keys that column frequencies are counted by; a clash only makes a column look less rare.
BITS = 48
COUNT_CAP = 65_535
CLASSES = "node string, n long, n_own long, least string, cols array<long>, at array<int>, text string"


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n shingles has with any partner."""
    return -(-n * percent // 100)


def word_name(ws: list[bytes]) -> str:
    """A name of a text's words; '' for none."""
    return hashlib.blake2b(b" ".join(ws), digest_size=12).hexdigest() if ws else ""


def _named(docs: DataFrame, texts: bool) -> DataFrame:
    """(node, doc_id), or with texts (node, least, text): for each batch its distinct sequences of words with
    their least ids, and the text where a partition shows it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[str] = set()
        for b in batches:
            given, ids = b.column(1).to_pylist(), b.column(0)
            names = [word_name(words(t)) for t in given]
            if not texts:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), ids], names=["node", "doc_id"])
                continue
            first: dict[str, list] = {}
            for name, i, t in zip(names, ids.to_pylist(), given):
                if name not in first:
                    first[name] = [i, t if name and name not in told else None]
                elif i is not None and (first[name][0] is None or i < first[name][0]):
                    first[name][0] = i
            told.update(first)
            rows = list(first.values())
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array([r[0] for r in rows], ids.type), pa.array([r[1] for r in rows], pa.string())], names=["node", "least", "text"])
        tidied(None)

    kind = id_kind(docs)
    given = docs.select(F.col("doc_id").cast(kind).alias("doc_id"), "text")
    return given.mapInArrow(run, f"node string, least {kind}, text string" if texts else f"node string, doc_id {kind}")


def id_kind(docs: DataFrame) -> str:
    """Ids are integers, or else text and ordered as such."""
    return "string" if dict(docs.dtypes)["doc_id"] == "string" else "long"


def _chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """(chunk, node, least, text): one row for each distinct sequence of words, a chunk's in one partition."""
    rows = _named(docs, True).withColumn("chunk", F.pmod(F.xxhash64("node"), F.lit(chunks)))
    have = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(have, -(-chunks // PER_TASK)), "chunk").groupBy("chunk", "node")
    return rows.agg(F.min("least").cast("string").alias("least"), F.first("text", ignorenulls=True).alias("text"))


def _merged(g: pd.DataFrame) -> list[tuple]:
    """The classes of a chunk: node, least id as text, text."""
    return sorted(zip(g["node"], g["least"], g["text"]), key=lambda x: x[0])


def _keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys over sets, and how many sets have each."""
    k = np.sort(np.concatenate(sets) >> np.uint64(64 - BITS)) if sets else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
    return k[first], np.diff(np.concatenate([first, [len(k)]]))


def classes(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, n, n_own, least, cols, at, text): a row for each distinct sequence of words.

    n_own counts the shingles of no other row; cols are the prefix columns that another row has too, at their places in the set's order of
    rarity; the text is kept where there are any. The node of texts without words is ''."""
    total = text_bytes(docs)
    chunks, buckets = max(1, -(-total // CHUNK_BYTES)), power_of_two(total / 6 / BUCKET_KEYS)
    rows = _chunked(docs, chunks)

    def ask(key, g: pd.DataFrame) -> pd.DataFrame:
        keys, count = _keys([shingle_set(t, shingle) for *_, t in _merged(g)])
        return as_frame(requests(int(key[0]), keys, count.astype(np.uint64), buckets, BITS))

    def total_count(keys, extra):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])
        sums = np.add.reduceat(extra[order], np.flatnonzero(first))
        out = np.empty(len(keys), np.uint64)
        out[order] = np.minimum(sums, np.uint64(COUNT_CAP))[np.cumsum(first) - 1]
        return out

    def prefixes(key, g: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        merged = _merged(g)
        sets = [shingle_set(t, shingle) for *_, t in merged]
        keys, _ = _keys(sets)
        counts, out = replies_of(r), []
        for (node, least, text), s in zip(merged, sets):
            n, cols, at = len(s), [], []
            long = n - needed(n, percent) + 1
            c = counts[np.searchsorted(keys, s >> np.uint64(64 - BITS))] if n else np.zeros(0, np.uint64)
            n_own = int((c == 1).sum())
            if n_own < min(long, n):
                # by frequency, then by scrambled name; s ascends, so a stable sort breaks ties alike everywhere
                order = np.argsort(c << np.uint64(48) | mixed(s) >> np.uint64(16), kind="stable")[:long]
                shown = np.flatnonzero(c[order] > 1)
                cols, at = s[order[shown]].view(np.int64).tolist(), shown.tolist()
            out.append([node, n, n_own, least, cols, at, text if cols else None])
        return tidied(pd.DataFrame(out, columns=["node", "n", "n_own", "least", "cols", "at", "text"]))

    replies = answered(rows.groupBy("chunk").applyInPandas(ask, REQUEST), buckets, total_count)
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(prefixes, CLASSES)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs(u, v) whose sets truly link: the product of a block of rows u and one row v each.

    A block's row v comes first in its sorted run, so a task holds one set beside the rows it reads."""
    load = pairs.groupBy("v").agg(F.count("*").alias("k"))
    placed = heavy_join(pairs, load, "v", "u", load).withColumn("blk", F.pmod(F.xxhash64("u"), F.ceil(F.col("k") / BLOCK)))
    t = texts.select("node", "text")
    left = placed.join(t.withColumnRenamed("node", "u"), "u").select("v", "blk", "u", "text")
    right = placed.select("v", "blk").distinct().join(t.withColumnRenamed("node", "v"), "v").select("v", "blk", F.lit("").alias("u"), "text")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = np.zeros(0, np.uint64)
        for b in batches:
            out, edge = [], np.flatnonzero(np.concatenate([[True], b["u"].to_numpy()[1:] == ""])).tolist() if len(b) else []
            for i, j in zip(edge, [*edge[1:], len(b)]):
                v, u, sets = b["v"].iloc[i], b["u"].iloc[i:j].tolist(), [shingle_set(t, shingle) for t in b["text"].iloc[i:j]]
                if not u[0]:
                    one, u, sets = sets[0], u[1:], sets[1:]
                if not u:
                    continue
                n = np.array([len(s) for s in sets], np.int64)
                every = np.concatenate(sets)
                at = np.searchsorted(one, every)
                at[at == len(one)] = 0
                o = np.bincount(np.repeat(np.arange(len(n)), n)[one[at] == every], minlength=len(n))
                out += [(u[k], v) for k in np.flatnonzero(100 * o >= percent * (n + len(one) - o))]
            yield pd.DataFrame(out, columns=["u", "v"])

    blocks = left.unionByName(right).repartition("v", "blk").sortWithinPartitions("v", "blk", "u")
    return blocks.mapInPandas(product, "u string, v string")


def _sizes_fit(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _reach(na, ia, nb, ib, percent: int):
    """Whether sets that first meet in a column at places ia and ib can overlap enough."""
    most = 1 + F.least(na - ia - 1, nb - ib - 1)
    return (100 + percent) * most >= percent * (na + nb)


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int = 0) -> np.ndarray:
    """Overlap counts of two blocks of sets: their incidence product, summed over slices of shared columns.

    A slice's products are whole in single precision, the sums in double. Pairs that can't reach the bound with
    the columns that are left are discarded, and give a count below it."""
    out = np.zeros((len(left), len(right)))
    a, b = (np.concatenate(x) for x in (left, right))
    columns = np.intersect1d(a, b)
    flat, rest = [], []
    for sets, v in ((left, a), (right, b)):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(columns, v)
        at[at == len(columns)] = 0
        both = columns[at] == v if len(columns) else np.zeros(len(v), bool)
        order = np.argsort(at[both], kind="stable")
        flat.append((row[both][order], at[both][order]))
        rest.append(np.bincount(row[both], minlength=len(sets)))
    sizes = [np.array([len(s) for s in sets], np.float64) for sets in (left, right)]
    need = percent * (sizes[0][:, None] + sizes[1]) / (100 + percent)
    live = [np.arange(len(left)), np.arange(len(right))]
    for begin in range(0, len(columns), SLICE):
        if percent:
            may = out[np.ix_(*live)] + np.minimum(rest[0][live[0]][:, None], rest[1][live[1]]) >= need[np.ix_(*live)] - 0.5
            live = [live[0][may.any(axis=1)], live[1][may.any(axis=0)]]
            if not len(live[0]):
                break
        parts = []
        for k, (row, at) in enumerate(flat):
            i, j = np.searchsorted(at, [begin, begin + SLICE])
            rest[k] -= np.bincount(row[i:j], minlength=len(rest[k]))
            m = np.zeros((out.shape[k], min(SLICE, len(columns) - begin)), np.float32)
            m[row[i:j], at[i:j] - begin] = 1
            parts.append(m if len(live[k]) == len(m) else m[live[k]])
        out[np.ix_(*live)] += parts[0] @ parts[1].T
    return out


def reached(o: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether overlaps of sets of n by m shingles reach the bound; all in double precision, which is exact here."""
    return 100 * o >= percent * (n[:, None] + m - o)


def linked_classes(found: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the classes that link with another class.

    A column's hub is the row in it with the least part of shingles of its own: of many edited copies,
    the least edited one. Rows that share a column share its hub, so blocks by hub hold all pairs."""
    texts = found.where(F.col("text").isNotNull()).select("node", "text")
    posts = found.where(F.size("cols") > 0).select("node", "n", (F.col("n_own") / F.col("n")).alias("own"), F.explode(F.arrays_zip("cols", "at")).alias("x"))
    posts = posts.select("node", "n", "own", F.col("x.cols").alias("col"), F.col("x.at").alias("at"))
    hubs = posts.groupBy("col").agg(F.min(F.struct("own", "node", "n", "at")).alias("h"), F.count("*").alias("k")).where("k > 1")
    both = heavy_join(posts, hubs, "col", "node", hubs.select("col", "k"))
    may = (F.col("node") != F.col("h.node")) & _sizes_fit("n", "h.n", percent) & _reach(F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at"), percent)
    members = stored(both.groupBy(F.col("h.node").alias("hub"), "node").agg(F.first("n").alias("n"), F.min(F.when(may, F.struct(F.col("h.own").alias("own"), F.col("h.node").alias("v")))).alias("best")))
    star = members.groupBy(F.col("node").alias("u")).agg(F.min("best").alias("b")).where("b is not null").select("u", F.col("b.v").alias("v"))
    links = stored(verified(star, texts, shingle, percent))
    groups = stored(components(links))
    # hubs whose rows aren't known to be one group: all rows against those outside the largest one, by size
    band = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.000001)).cast("int") if percent < 100 else F.col("n").cast("int")
    open_ = members.select("hub", "node", "n").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = open_.groupBy("hub", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    split = roots.groupBy("hub").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("k")).where("k > 1")
    open_ = stored(heavy_join(open_, split.select("hub", F.col("top.root").alias("top")), "hub", "node", members.groupBy("hub").agg(F.count("*").alias("k"))).withColumn("band", band))
    # a row outside the largest group meets rows of its own band and of its neighbours
    left = open_.where("root <> top").select("hub", "band", F.lit(0).alias("side"), "node", "root", "n")
    right = open_.select("hub", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.lit(1).alias("side"), "node", "root", "n")
    sides = left.unionByName(right).withColumn("block", F.concat_ws(":", "hub", "band")).drop("hub", "band")
    size = lambda k: F.greatest(F.ceil(F.sum(F.when(F.col("side") == k, F.col("n"))) / BLOCK_SHINGLES), F.ceil(F.count_if(F.col("side") == k) / BLOCK_ROWS)).cast("int")
    blocks = stored(sides.groupBy("block").agg(size(0).alias("p"), size(1).alias("q"), F.count("*").alias("k")).where("p > 0 and q > 0"))
    h = F.xxhash64("node")
    sides = heavy_join(sides, blocks.drop("k"), "block", "node", blocks.select("block", "k"))
    mine, other = F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))
    sides = sides.withColumn("own", F.pmod(h, mine).cast("int")).withColumn("every", F.explode(F.sequence(F.lit(0), other - 1)))
    i, j = (F.when(F.col("side") == k, F.col("own")).otherwise(F.col("every")) for k in (0, 1))
    placed = sides.select("block", i.alias("i"), j.alias("j"), "side", "node", "root").join(texts, "node")

    def tile(g: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in g["text"]]
        a, b = (np.flatnonzero(g["side"] == k) for k in (0, 1))
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["u", "v"])
        n, root, node = np.array([len(s) for s in sets], np.float64), pd.factorize(g["root"])[0], g["node"].to_numpy()
        o = overlaps([sets[i] for i in a], [sets[i] for i in b], percent)
        x, y = np.nonzero(reached(o, n[a], n[b], percent) & (root[a][:, None] != root[b]))
        return tidied(pd.DataFrame([(node[i], node[j]) for i, j in forest(a[x], b[y], len(g))], columns=["u", "v"]))

    more = stored(placed.groupBy("block", "i", "j").applyInPandas(tile, "u string, v string"))
    every = groups.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)
    return components(every)


def jaccard_groups(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    found = cut(classes(docs, shingle, percent))
    roots = linked_classes(found, shingle, percent)
    named = found.where("node <> ''").select("node", "n", F.col("least").cast(id_kind(docs)).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(heavy_join(named, least, "root", "node").select("node", F.col("n").alias("n_shingles"), "component_id"))
    ids = stored(_named(docs, False))
    linked = heavy_join(ids.where("node <> ''"), named, "node", "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = ids.where("node = ''").select("doc_id", F.lit(0).cast("long").alias("n_shingles")).withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone)


def op4_ngram_jaccard(spark, sf_dir):
    from .common import table

    return jaccard_groups(table(spark, sf_dir, "documents"), shingle=4, percent=85)
