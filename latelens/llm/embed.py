"""Embedding near-duplicates: spherical k-means cells, blocked cosine products within cells.

Equal vectors collapse first. The vectors of each length are dealt to cells: centroids are fitted on a
sample of about SAMPLE vectors, and every vector is filed under its nearest VISITS cells. Lengths of more
vectors than MOST_CELLS cells should hold are dealt a second time, within each cell, so that cells stay of
like size as the table grows. Fitting and filing are grouped tasks; no list of lengths, cells or centroids comes to
the driver. A pair is counted in the least cell that both visit. Large cells are cut into blocks and
compared tile by tile; vectors travel once for each tile, in their own precision. A tile gives back counts
and a spanning forest of its links, at most one link per vector, never all pairs.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite components link with
nothing; vectors of different length don't link; equal vectors (and repeated rows) are all linked; a
null vec_id takes part but names no component; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, id_text, parsed, stored
from .components import components, forest

#: Vectors that centroids are fitted on; vectors in a cell aimed at; most cells; cells that a vector visits.
SAMPLE, CELL, MOST_CELLS, VISITS = 20_000, 1_000, 4_096, 4
BLOCK, ROUNDS = 1_024, 12
#: Vectors that a task files.
FILED = 20_000


def name_of(v) -> str | None:
    """A name of the vector's values, or None for one that links with nothing."""
    if v is None:
        return None
    try:
        x = np.asarray(v, np.float64)
    except (TypeError, ValueError):
        return None
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return None
    return hashlib.blake2b((x + 0.0).tobytes(), digest_size=12).hexdigest()


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # else very large or small components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fitted(x: np.ndarray, k: int) -> np.ndarray:
    """k centroids of unit vectors by spherical k-means, started far apart; x in a fixed order."""
    c = [x[0]]
    near = x @ c[0]
    for _ in range(1, min(k, len(x))):
        c.append(x[int(near.argmin())])
        near = np.maximum(near, x @ c[-1])
    c = np.array(c)
    for _ in range(ROUNDS):
        home = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        new = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        if np.allclose(new, c):
            break
        c = new
    return c


def _array(blobs, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in blobs]).astype(np.float64)


def filed(points: DataFrame, kind: str, visits: int) -> DataFrame:
    """(name, cell, capped) for points(name, grp, v): the nearest cells of each, within its group.

    A group of at most CELL points is one cell; capped says that a group wants more than MOST_CELLS."""
    sizes = points.groupBy("grp").agg(F.count("*").alias("n"))
    large = stored(sizes.where(F.col("n") > CELL))
    some = heavy_join(points, large, "grp", "name", large.select("grp", F.col("n").alias("k")))
    some = some.where(F.pmod(F.xxhash64("name", F.lit(11)), F.ceil(F.col("n") / SAMPLE)) == 0)

    def centres(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("name")
        c = fitted(unit(_array(g["v"], kind)), min(MOST_CELLS, -(-int(g["n"].iloc[0]) // CELL)))
        return pd.DataFrame({"grp": [g["grp"].iloc[0]], "c": [c.tobytes()]})

    c = stored(some.groupBy("grp").applyInPandas(centres, "grp string, c binary"))
    salts = F.ceil(F.col("n") / FILED).cast("int")
    whole = heavy_join(points, large, "grp", "name", large.select("grp", F.col("n").alias("k"))).withColumn("salt", F.pmod(F.xxhash64("name"), salts))
    shown = c.join(large, "grp").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))

    def file(key, g: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(c):
            return pd.DataFrame([], columns=["name", "cell", "capped"])
        x, out = unit(_array(g["v"], kind)), []
        centre = np.frombuffer(c["c"].iloc[0]).reshape(-1, x.shape[1])
        near = np.argsort(-(x @ centre.T), axis=1, kind="stable")[:, :visits]
        capped = int(c["n"].iloc[0]) > CELL * MOST_CELLS
        for name, cells in zip(g["name"], near.tolist()):
            out += [(name, f"{key[0]}:{cell:05d}", capped) for cell in cells]
        return pd.DataFrame(out, columns=["name", "cell", "capped"])

    got = whole.select("grp", "salt", "name", "v").groupBy("grp", "salt").cogroup(shown.groupBy("grp", "salt")).applyInPandas(file, "name string, cell string, capped boolean")
    return got.unionByName(points.join(large, "grp", "left_anti").select("name", F.col("grp").alias("cell"), F.lit(False).alias("capped")))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, visits: int = VISITS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"vec_id": b["vec_id"], "name": [name_of(v) for v in b["embedding"]]})

    def collapse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = pd.DataFrame({"rep": pd.array([parsed(i) for i in b["vec_id"]], "Int64"), "name": [name_of(v) for v in b["embedding"]], "v": b["embedding"]})
            g = d[d["name"].notna()].groupby("name", sort=False)
            out = g.agg(rep=("rep", "min"), k=("name", "size"), v=("v", "first")).reset_index()
            out["d"] = [str(len(v)) for v in out["v"]]
            out["v"] = [np.asarray(v, kind).tobytes() for v in out["v"]]
            yield out[["name", "rep", "k", "d", "v"]]

    rows = vectors.select(id_text("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    named = stored(rows.mapInPandas(names, "vec_id string, name string").withColumn("vec_id", F.col("vec_id").cast("long")))
    parts = rows.mapInPandas(collapse, "name string, rep long, k long, d string, v binary")
    classes = stored(parts.groupBy("name").agg(F.min("rep").alias("rep"), F.sum("k").alias("k"), F.first("d").alias("d"), F.first("v").alias("v")))
    first = stored(filed(classes.select("name", F.col("d").alias("grp"), "v"), kind, visits))
    cells = first.select("name", "cell")
    if first.where("capped").limit(1).count():
        again = first.where("capped").join(classes.select("name", "v"), "name").select("name", F.col("cell").alias("grp"), "v")
        cells = stored(first.where("not capped").select("name", "cell").unionByName(filed(again, kind, visits).select("name", "cell")))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("m"))
    visited = cells.groupBy("name").agg(F.sort_array(F.collect_set("cell")).alias("cells"))
    tiles = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = heavy_join(cells, sizes, "cell", "name", sizes.withColumnRenamed("m", "k")).withColumn("i", F.pmod(F.xxhash64("name"), tiles).cast("int"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), tiles - 1)))
    placed = placed.select("cell", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "name")
    placed = placed.join(classes.select("name", "k", "v"), "name").join(visited, "name")

    def product(key, g: pd.DataFrame) -> pd.DataFrame:
        p, q = int(key[1]), int(key[2])
        x = unit(_array(g["v"], kind))
        order = {c: n for n, c in enumerate(sorted({c for cells in g["cells"] for c in cells}))}
        visits_ = np.full((len(g), max(len(c) for c in g["cells"])), -1)
        for n, own_cells in enumerate(g["cells"]):
            visits_[n, : len(own_cells)] = [order[c] for c in own_cells]
        cell, side, k = order[str(key[0])], g["i"].to_numpy(), g["k"].to_numpy()
        left, right = np.flatnonzero(side == p), np.flatnonzero(side == q)
        a, b = np.nonzero(x[left] @ x[right].T >= cosine)
        a, b = left[a], right[b]
        if p == q:
            a, b = a[a < b], b[a < b]
        # a pair counts in the least cell that both visit
        own = np.ones(len(a), bool)
        for c in visits_.T:
            own &= (c[a] >= cell) | (c[a] < 0) | ~(visits_[b] == c[a][:, None]).any(axis=1)
        a, b = a[own], b[own]
        links = np.bincount(a, weights=k[b], minlength=len(g)) + np.bincount(b, weights=k[a], minlength=len(g))
        name = g["name"].to_numpy()
        to = {i: name[r] for i, r in forest(a, b, len(g))} if len(a) else {}
        out = [(name[i], int(links[i]), to.get(i)) for i in np.flatnonzero(links > 0)]
        return pd.DataFrame(out, columns=["name", "links", "to"])

    found = stored(placed.groupBy("cell", "p", "q").applyInPandas(product, "name string, links long, to string"))
    counts = found.groupBy("name").agg(F.sum("links").alias("links"))
    roots = components(found.where(F.col("to").isNotNull()).select(F.col("name").alias("u"), F.col("to").alias("v")))
    c = classes.select("name", "rep", "k").join(counts, "name", "left").join(roots.withColumnRenamed("node", "name"), "name", "left")
    c = stored(c.withColumn("root", F.coalesce("root", "name")))
    least = c.groupBy("root").agg(F.min("rep").alias("component_id"))
    c = stored(heavy_join(c, least, "root", "name").select("name", (F.coalesce("links", F.lit(0)) + F.col("k") - 1).alias("n_links"), "component_id"))
    linked = heavy_join(named.where("name is not null"), c, "name", "vec_id").select("vec_id", "n_links", "component_id")
    alone = named.where("name is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_embedding_near_dedup(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "embeddings"))
