"""Line-first quality rules as DataFrame expressions.

Every line is judged for itself (navigation, boilerplate, missing punctuation), failing lines are
removed, and a document that loses too large a part of its characters is rejected. Whole-document
counts (words, symbols, repeated windows) join the verdict.

Defined cases: a null text counts as no text and is rejected as too short; an empty text likewise;
repeated rows are judged alike, each for itself; an empty table gives an empty result; columns whose
names clash with the added ones are replaced by them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower

#: Phrases of lines that are part of a site, not of a text.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
    "use of cookies", "uses cookies", "lorem ipsum", "javascript is disabled", "enable javascript", "sign in to",
    "log in to", "subscribe to our newsletter", "click here to", "skip to content", "back to top", "share on facebook",
)
SPACE = r"[\x20\x09-\x0D]"
SEPARATORS = rf"{SPACE}[|»›·•]{SPACE}"
ENDS = rf"[.!?…\"'”’»)\]:;]{SPACE}*\z"
#: A word that ends in a doubled mark, and the space after it.
DOUBLED = rf"[!?#*$%&|<>]{{2,}}{SPACE}"


@dataclass(frozen=True)
class LineRules:
    """min_words, max_repeat_percent: of the whole document. max_lost_percent: of the characters in
    words that removed lines may hold. max_separators: in one line. short_words: a line with fewer
    words and no closing mark, among other lines, counts as navigation. max_symbol_percent: symbols
    against words. max_shout_percent: of a line's words that end in a doubled mark. max_phrase_words: in
    a line that a boilerplate phrase condemns."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost_percent: int = 30
    max_separators: int = 2
    short_words: int = 4
    max_symbol_percent: int = 10
    max_shout_percent: int = 50
    max_phrase_words: int = 25


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long).

    n_repeat_words: the 3-word windows are sorted with their places; equal neighbours are repeated,
    and each adds up to three words that the next repeated window doesn't cover: n log n, also for
    very long texts."""
    kept = [c for c in df.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    t = F.coalesce(F.col(text), F.lit(""))
    d = df.select(*[F.col(f"`{c}`") for c in kept], F.split(t, r"[\x20\x09-\x0D]+").alias("__all"), t.alias("__t"))
    # only the ends of the split can be empty
    d = d.withColumn("__w", F.filter("__all", lambda x: x != "")).drop("__all")
    n = F.size("__w")
    spread = lambda k: F.slice("__w", k, F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(F.arrays_zip(spread(1), spread(2), spread(3)), lambda w, i: F.struct(F.xxhash64(w["0"], w["1"], w["2"]).alias("h"), i.alias("i")))
    d = d.withColumn("__k", F.sort_array(hashes))
    k = F.col("__k")
    m = F.size(k)
    d = d.withColumn(
        "__at",
        F.sort_array(F.transform(F.filter(F.arrays_zip(k.alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(k, 1, F.greatest(m - 1, F.lit(0)))).alias("p"), F.slice(k, 2, F.greatest(m, F.lit(1))).alias("n")), lambda z: (z["x"]["h"] == z["p"]["h"]) | (z["x"]["h"] == z["n"]["h"])), lambda z: z["x"]["i"])),
    )
    at = F.col("__at")
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    lines = F.filter(F.split(F.col("__t"), "\n", -1), lambda x: x.rlike(WORD))
    return d.select(
        *[F.col(f"`{c}`") for c in kept],
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words"),
    )


def seen_lines(text: Column) -> Column:
    """A text's lines as array<struct<x, low, spaced, n>>: what the rules look at, made once per line."""
    parts = lambda c: F.split(c, "\n", -1)
    one = lambda x, low: F.struct(x.alias("x"), low.alias("low"), F.concat(F.lit(" "), x, F.lit(" ")).alias("spaced"), F.regexp_count(x, F.lit(WORD)).alias("n"))
    return F.zip_with(parts(text), parts(ascii_lower(text)), one)


def line_fails(line: Column, rules: LineRules) -> Column:
    """True where a line of seen_lines is navigation, boilerplate, shouting or lacks any closing mark."""
    n, phrase = line["n"], F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | line["low"].contains(p)
    nav = F.regexp_count(line["spaced"], F.lit(SEPARATORS)) > rules.max_separators
    doubled = F.regexp_count(line["spaced"], F.lit(DOUBLED)) * 100 > n * rules.max_shout_percent
    bare = (n < rules.short_words) & ~line["x"].rlike(ENDS)
    return ((n < rules.max_phrase_words) & phrase) | bare | nav | ((n > 2) & doubled)


def cleaned(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """df with clean_text (failing lines removed, null for null), lost_chars and n_lines_removed."""
    judged = F.transform(seen_lines(F.coalesce(F.col(text), F.lit(""))), lambda z: F.struct(z["x"].alias("x"), ((z["n"] > 0) & line_fails(z, rules)).alias("bad")))
    d = df.withColumn("__j", judged)
    bad = F.filter("__j", lambda z: z["bad"])
    count = lambda z: F.length(F.translate(z["x"], " \t\n\x0b\x0c\r", ""))
    return (
        d.withColumn("clean_text", F.when(F.col(text).isNotNull(), F.array_join(F.transform(F.filter("__j", lambda z: ~z["bad"]), lambda z: z["x"]), "\n")))
        .withColumn("lost_chars", F.aggregate(bad, F.lit(0).cast("long"), lambda a, z: a + count(z)))
        .withColumn("n_lines_removed", F.size(bad).cast("long"))
        .drop("__j")
    )


def quality_rules(df: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """df with the counts, clean_text, lost_chars, n_lines_removed, base_failed and kept."""
    d = cleaned(with_counts(df.withColumn("__text", F.col(text)), "__text"), "__text", rules).drop("__text")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * rules.max_lost_percent
    symbols = F.col("n_symbols") * 100 > F.col("n_words") * rules.max_symbol_percent
    d = d.withColumn("base_failed", failed)
    return d.withColumn("kept", ~(F.col("base_failed") | lost | symbols))


def op6_quality_rules(spark, sf_dir):
    from .common import table

    d = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "n_lines_removed")


def oracle() -> str:
    """The query in SQL."""
    r, q = LineRules(), lambda x: x.replace("'", "''")
    phrase = " or ".join(f"contains(low, '{q(p)}')" for p in BOILERPLATE)
    return rf"""
with t as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '{WORD}') as ws from t),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from w, unnest(range(1, len(ws) - 1)) as x(i) where len(ws) >= 3),
c as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
rep as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from c where c > 1) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as x from t),
n as (select doc_id, x, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low, len(regexp_extract_all(x, '{WORD}')) as n from lines),
j as (select *, n > 0 and (((({phrase})) and n < {r.max_phrase_words}) or len(regexp_extract_all(' ' || x || ' ', '{SEPARATORS}')) > {r.max_separators}
    or (len(regexp_extract_all(' ' || x || ' ', '{DOUBLED}')) * 100 > n * {r.max_shout_percent} and n > 2)
    or (not regexp_matches(x, '{q(ENDS)}') and n < {r.short_words})) as bad from n),
l as (select doc_id, count(*) filter (n > 0) - count(distinct x) filter (n > 0) as dup, count(*) filter (bad) as removed,
    coalesce(sum(length(regexp_replace(x, '{SPACE}+', '', 'g'))) filter (bad), 0) as lost from j group by doc_id),
k as (select w.doc_id, len(ws) as n_words, length(regexp_replace(t, '{SPACE}+', '', 'g')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
    l.dup as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, l.lost, l.removed from w join l on l.doc_id = w.doc_id left join rep on rep.doc_id = w.doc_id),
f as (select *, n_words < {r.min_words} or 100 * n_repeat_words > {r.max_repeat_percent} * n_words as base_failed from k)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed or lost * 100 > word_chars * {r.max_lost_percent} or n_symbols * 100 > n_words * {r.max_symbol_percent}) as kept, lost::bigint as lost_chars, removed::bigint as n_lines_removed from f"""
