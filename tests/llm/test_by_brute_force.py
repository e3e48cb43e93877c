"""The mixing query and the corpus pipeline against plain programs of their own, on the smallest tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from latelens.llm import mixing
from latelens.llm.queries import ORACLE_SQL, QUERIES

SIZE = re.compile(r"[^\x20\x09-\x0D]+")


def shares(sizes: dict, share=1.5, most=2):
    """Targets by bisecting the level at which sources that aren't full stand."""
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [k for k in sizes if k is None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    total, low, high = share * sum(sizes.values()), 0.0, 4.0 * sum(sizes.values()) + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(level * weight[k], most * sizes[k]) for k in sizes) < total:
            low = level
        else:
            high = level
    return {k: min(high * weight[k], most * sizes[k]) for k in sizes}


def test_mixing_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(SIZE.findall(r.text or "")) for i, r in docs.items()}
    by_source: Counter = Counter()
    for i, r in docs.items():
        by_source[r.source] += size[i]
    want, taken, largest = shares(by_source), Counter(), defaultdict(int)
    got = QUERIES["op1_mixing"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], by_source[s]) and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    # what is open at the end are two documents
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, QUERIES["op1_mixing"](spark, sf).collect()))


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as c

    from test_text_operators import expected_groups, library

    names = [n for n, _ in c.STAGES]
    stages, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    given = docs
    for _, stage in c.STAGES:
        docs = stage(spark, docs, sf).cache()
        stages.append(docs.collect())
    assert len(names) == 5
    # 1: the documents that the operator's SQL keeps, with no line that the input hasn't
    d = duckdb.connect()
    d.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    kept = {r[0] for r in d.execute(f"select doc_id from ({ORACLE_SQL['op6_quality_rules']}) where kept").fetchall()}
    first, text = stages[0], {r.doc_id: r.text for r in given.collect()}
    assert sorted(r.doc_id for r in first) == sorted(kept)
    for r in first:
        lines = iter(text[r.doc_id].split("\n"))
        assert all(any(x == y for y in lines) for x in r.text.split("\n")) and r.n_chars == len(r.text)
    # 2: one document, the least, of each group of all pairs' links
    groups = expected_groups([(r.doc_id, r.text) for r in first], 5, 80)
    least = {int(i) for i, n, g in groups if n == 0 or i == g}
    assert sorted(r.doc_id for r in stages[1]) == sorted(least)
    assert {r.doc_id: r.text for r in stages[1]} == {r.doc_id: r.text for r in first if r.doc_id in least}
    # 3: all documents, none with an address, and no word changed in texts without digits or addresses
    third = {r.doc_id: r.text for r in stages[2]}
    address = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
    assert set(third) == least
    for r in stages[1]:
        assert not set(address.findall(r.text)) & set(address.findall(third[r.doc_id]))
        assert bool(re.search("[0-9@]", r.text)) or third[r.doc_id] == r.text
    # 4: each row as often as its source's share says, rounded either way, and the words near the targets
    size, source, words = {}, {}, Counter()
    for r in stages[2]:
        size[r.doc_id], source[r.doc_id] = len(SIZE.findall(r.text)), r.source
        words[r.source] += size[r.doc_id]
    want, copies, taken = shares(words), Counter(r.doc_id for r in stages[3]), Counter()
    for i in size:
        exact = want[source[i]] / words[source[i]] if words[source[i]] else 0
        assert copies[i] in (int(exact + 1e-9), int(exact + 1e-9) + 1)
        taken[source[i]] += copies[i] * size[i]
    assert all(abs(taken[s] - want[s]) <= 2 * max(size[i] for i in size if source[i] == s) for s in want)
    assert {(r.doc_id, r.text) for r in stages[3]} <= {(r.doc_id, r.text) for r in stages[2]}
    # 5: what the tokenizers library gives
    from latelens.llm import bpe

    lib, sha = library(bpe.default_path()), lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = Counter()
    for r in stages[3]:
        ids, decoded, n = lib(r.text)
        expected[r.doc_id, n, sha(ids), sha(decoded)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in stages[4]) == expected
    assert Counter(map(tuple, c.run(spark, sf).collect())) == Counter(map(tuple, stages[4]))
    assert mixing.FEW_SOURCES > len(words)
