from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from latelens.llm import common, embed
from latelens.llm.components import components


def expected(ids, vectors, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(ids)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            if a != b and good[a] and good[b] and len(vectors[a]) == len(vectors[b]):
                x, y = np.array(vectors[a], float), np.array(vectors[b], float)
                link[a, b] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
    root = list(range(n))
    for _ in range(n):
        new = [min([root[a]] + [root[b] for b in np.flatnonzero(link[a])]) for a in range(n)]
        if new == root:
            break
        root = new
    least = {}
    for a in range(n):
        if ids[a] is not None:
            least[root[a]] = min(least.get(root[a], ids[a]), ids[a])
    return sorted((str(ids[a]), int(link[a].sum()), str(least.get(root[a]))) for a in range(n))


def got(d):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in d.collect())


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 8))
    vs = [(base[i % 6] + rng.normal(size=8) * 0.15).tolist() for i in range(60)]
    vs += [vs[0], vs[0], [0.0] * 8, None, [], [1.0, None, 2.0], [float("nan")] * 8, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0], [-0.0] * 7 + [1.0], [0.0] * 7 + [1.0], [1e200] * 8, [1e-200] * 8]
    ids = [*range(len(vs) - 1), None]
    d = spark.createDataFrame(list(zip(ids, vs)), "vec_id long, embedding array<double>").withColumn("name", F.lit("clash")).repartition(3)
    finite = [v if v is None or not v or None in v or not np.isfinite(v).all() else (np.array(v) / (np.abs(v).max() or 1)).tolist() for v in vs]
    assert got(embed.near_duplicates(d)) == expected(ids, finite)
    assert embed.near_duplicates(d.limit(0)).count() == 0


def test_recall_over_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embed, "CELL", 60)
    monkeypatch.setattr(embed, "BLOCK", 50)
    rng = np.random.default_rng(3)
    c = rng.normal(size=(40, 16))
    vs = (c[rng.integers(0, 40, 600)] + rng.normal(size=(600, 16)) * rng.choice([0.05, 0.3], size=(600, 1))).tolist()
    d = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    r, e = got(embed.near_duplicates(d)), expected(list(range(600)), vs)
    assert sum(x[1] for x in r) >= 0.9 * sum(x[1] for x in e) > 0 and all(x[1] <= y[1] for x, y in zip(r, e))


def test_every_compared_link_counts(spark, monkeypatch):
    monkeypatch.setattr(embed, "CELL", 5)
    rng = np.random.default_rng(4)
    c = rng.normal(size=(10, 6))
    vs = c[rng.integers(0, 10, 600)] + rng.normal(size=(600, 6)) * 0.3
    d = spark.createDataFrame(list(enumerate(vs.tolist())), "vec_id long, embedding array<double>")
    x = embed.unit(vs)
    cells = np.argsort(-(x @ embed.fitted(x[np.argsort([embed.name_of(v) for v in vs])], 120).T), axis=1, kind="stable")[:, : embed.VISITS]
    meet = (cells[:, None, :, None] == cells[None, :, None, :]).any(axis=(2, 3)) & ~np.eye(600, dtype=bool)
    want = (meet & (x @ x.T >= 0.9)).sum(axis=1)
    assert {r.vec_id: r.n_links for r in embed.near_duplicates(d).collect()} == dict(enumerate(want.tolist()))


def test_cells_within_cells(spark, monkeypatch):
    monkeypatch.setattr(embed, "CELL", 20)
    monkeypatch.setattr(embed, "MOST_CELLS", 6)
    monkeypatch.setattr(embed, "FILED", 100)
    monkeypatch.setattr(common, "HEAVY", 50)
    rng = np.random.default_rng(8)
    c = rng.normal(size=(30, 12))
    vs = (c[rng.integers(0, 30, 700)] + rng.normal(size=(700, 12)) * 0.1).astype(np.float32).tolist()
    d = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>")
    r, e = got(embed.near_duplicates(d)), expected(list(range(700)), vs)
    assert sum(x[1] for x in r) >= 0.95 * sum(x[1] for x in e) > 0 and all(x[1] <= y[1] for x, y in zip(r, e))
    kept = embed.filed(d.select(F.col("vec_id").cast("string").alias("name"), F.lit("12").alias("grp"), F.lit(b"").alias("v")).limit(20), "<f4", 4).collect()
    assert {(x.cell, x.capped) for x in kept} == {("12", False)}


def test_vectors_of_many_lengths(spark):
    rows = [(3 * n + k, [1.0] * n + [float(k // 2)]) for n in range(1, 1_102) for k in range(3)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    links = {r.vec_id: r.n_links for r in embed.near_duplicates(d).collect()}
    # 1,0 and 1,0 are equal; the third is near them from five ones on: n / sqrt(n (n + 1)) >= 0.9
    assert links == {3 * n + k: (2 if n >= 5 else 1 if k < 2 else 0) for n in range(1, 1_102) for k in range(3)}


def test_query(spark, sf):
    from latelens.llm.embed import op5_embedding_near_dedup

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    d = op5_embedding_near_dedup(spark, sf)
    assert got(d) == expected([r.vec_id for r in e], [r.embedding for r in e])
    assert d.where("kept <> (vec_id = component_id)").count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(f"{a:03d}", f"{a + 1:03d}") for a in range(50)] + [(f"{900 - a}", "899") for a in range(30)] + [(f"r{a}", f"r{b}") for a, b in rng.integers(0, 40, (25, 2))] + [(None, "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    d = components(spark.createDataFrame(pairs, "u string, v string"))
    assert sorted((r.node, r.root) for r in d.collect()) == sorted((x, find(x)) for x in parent)
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(c.STAGES, 1):
        before, docs = docs, stage(spark, docs, sf).cache()
        seen.append(docs.count())
        if k < len(c.STAGES):
            assert docs.columns == columns
        if k in (1, 2):
            assert docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        if k == 1:
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            from latelens.llm.quality import op6_quality_rules

            assert ids == {r.doc_id for r in op6_quality_rules(spark, sf).where("kept").collect()}
        if k == 2:
            from latelens.llm.jaccard import jaccard_groups

            g = jaccard_groups(before.select("doc_id", "text"), 5, 80)
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {r.component_id for r in g.collect()}
    assert seen[1] < seen[0] and seen[2] <= seen[1] and seen[3] == seen[2] and seen[4] == seen[5]
    assert sorted(map(tuple, c.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_stages_on_odd_rows(spark, odd, empty, sf):
    import corpus_pipeline as c

    for k, (_, stage) in enumerate(c.STAGES, 1):
        a, b = stage(spark, odd, sf), stage(spark, empty, sf)
        assert b.count() == 0 and (k == 5 or a.columns == odd.columns)
        assert k in (1, 2, 4) or a.count() == odd.count()
    kept = c.near_duplicates(spark, odd, sf)
    texts = [r.text for r in kept.collect() if r.doc_id is not None and r.text and r.text.strip()]
    assert texts.count("one two") == 1


def test_repeated_and_null_ids(spark):
    import corpus_pipeline as c

    text = lambda k, n=40: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("b", 50)), (1, text("a")), (2, text("b", 50)), (2, text("c")), (3, text("b", 51))]
    rows += [(None, text("d")), (None, text("d")), (None, text("d", 41)), (None, text("c", 41)), (None, text("e")), (None, None), (None, ""), (None, ""), (4, ""), (4, "")]
    # a link to one that another one links with: b has 50, 55 and 60 words
    rows += [(5, text("b", 55)), (None, text("b", 60))]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(3)
    got = c.near_duplicates(spark, docs, "")
    want = [(1, text("a")), (1, text("b", 50)), (2, text("c")), (None, text("d", 41)), (None, text("e")), (None, None), (None, ""), (None, ""), (4, "")]
    assert got.columns == docs.columns and sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
