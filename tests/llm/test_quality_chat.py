from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latelens.llm.chat import format_chats, masked_text, read_back, text_parts
from latelens.llm.quality import op6_quality_rules, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t: str):
    w, at = WORD.findall(t), set()
    c = Counter(zip(w, w[1:], w[2:]))
    for i in range(len(w) - 2):
        if c[w[i], w[i + 1], w[i + 2]] > 1:
            at |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(at)


def test_counts_against_brute_force(spark, sf):
    got = {r.doc_id: r for r in op6_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, e = got[d.doc_id], counts(d.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == e
        assert r.base_failed == (e[0] < 50 or 100 * e[4] > 50 * e[0]) and not (r.base_failed and r.kept)


def test_odd_rows_and_clashing_columns(odd, empty):
    d = quality_rules(odd)
    rows = d.collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if r.text is None or len(r.text) < 20)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text or "")
        assert (r.clean_text is None) == (r.text is None)
    assert quality_rules(empty).count() == 0


def test_lines_are_judged_one_by_one(spark):
    good = "This line is a sentence that ends as it should."
    text = "\n".join(["Home | News | Sport | About", good, "All rights reserved.", "Read on", good + " Twice."])
    r = quality_rules(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.clean_text == f"{good}\n{good} Twice." and r.n_lines_removed == 3


def test_no_python_in_plans(spark, sf):
    plan = op6_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


HARD = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "&lt;|end|>&amp;", "", "\\", "<", "|>", "a\nb", "é😀"]


@pytest.mark.parametrize("text", HARD)
def test_round_trip(spark, text):
    d = spark.createDataFrame([(1, 1, "user", text), (1, 2, "assistant", text + "!"), (1, 3, "assistant", None)], "conv_id int, turn int, role string, text string")
    f = format_chats(d.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    r = f.select("*", read_back(F.col("formatted")).alias("back"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).first()
    assert [(x.role, x.text) for x in r.back] == [("user", text), ("assistant", text + "!"), ("assistant", "")]
    assert r.loss == text + "!" and r.n_turns == 3


def test_parts_become_placeholders(spark):
    part = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"
    rows = [(1, 1, "user", [("text", "see <this>", None, None), ("image", None, "a.png", 9), ("audio", None, "b.wav", None)]), (1, 2, "user", [("document", None, "c.pdf", 5), ("text", None, None, None)]), (2, None, None, None)]
    f = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {part}")).collect()}
    assert f[1].formatted == "<|turn|>user<|text|>see &lt;this><|image:0:9|><|audio:1:128|><|end|><|turn|>user<|text|><|document:2:5|><|end|>"
    assert [(a.turn_no, a.kind, a.ref, a.n_tokens) for a in f[1].attachments] == [(1, "image", "a.png", 9), (1, "audio", "b.wav", 128), (2, "document", "c.pdf", 5)]
    assert f[1].expanded_tokens == 142 and f[2].formatted == "<|turn|><|text|><|end|>" and f[2].loss_spans == []


def test_query_against_brute_force(spark, sf):
    from latelens.llm.chat import op9_chat_formatting

    rows = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    convs: dict = {}
    for c, t, role, text in sorted(rows):
        convs.setdefault(c, []).append((role, text))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in op9_chat_formatting(spark, sf).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
