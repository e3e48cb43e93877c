"""Connected components over a table of links, by alternating star contractions.

Every round is a pair of grouped minima and joins; nothing but a row count and a checksum of the
links comes to the driver. The links of hubs are salted. Lineage is cut by tables in the shared
folder, and a round's is deleted once the next one's stands.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_join, stored


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(u, v): root is the least node reachable.

    Null ends and links of a node to itself are ignored; no links give an empty result."""
    e = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = stored(e)
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        large = heavy_join(both, least.select("u", F.least("u", "m").alias("m")), "u", "v", least.select("u", "k")).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k"))
        small = heavy_join(large, least.select("u", "m"), "u", "v", least.select("u", "k"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        old, e = e, stored(small.select("x.u", "x.v").where("u <> v").distinct())
        discard(old)
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join what the links (a, b) join, at most n - 1."""
    label = np.arange(n)
    while True:  # the least label spreads, with shortcuts
        m = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return [(int(i), int(label[i])) for i in np.flatnonzero(label != np.arange(n))]
