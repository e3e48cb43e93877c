"""Chat formatting over typed content parts, as DataFrame expressions.

A visitor flattens each turn's parts (text, image, audio, document) into one ordered string: text is
escaped, any other part becomes a placeholder `<|kind:k:n|>` with k the attachment's place in the
conversation and n its expanded token count; attachments are recorded beside it. A conversation is
the sequence of `<|turn|>role<|text|>content<|end|>`, and its loss mask is the list of spans
(start, length in code points) of the assistant's contents. Escaping `&`, `<` and `[` keeps control
strings of this and of common other templates out of texts and is undone by unescaped().

Defined cases: null text or role reads as empty; rows are ordered by (turn, role, text), nulls
first; repeated rows are repeated turns; a null conv_id is one conversation of its own; an empty
table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that a part expands to where it doesn't say so itself.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART = "struct<type:string,text:string,ref:string,n_tokens:int>"


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("n_tokens")))


def _expanded(p: Column) -> Column:
    default = F.lit(0)
    for kind, n in EXPANDED.items():
        default = F.when(p["type"] == kind, F.lit(n)).otherwise(default)
    return F.coalesce(p["n_tokens"], default)


def format_chats(rows: DataFrame, parts: str = "parts", train_role: str = "assistant") -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts): formatted, loss_spans array<struct
    <start:long (0-based), len:long>>, attachments array<struct<turn_no, kind, ref, n_tokens>>,
    n_turns and expanded_tokens.

    Offsets and attachment numbers are running sums over the conversation's rows, so that no string
    or array is grown turn by turn."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "__text")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    p = F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>"))
    d = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), p.alias("__parts"),
        F.array_join(F.transform(p, lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("__text"),
    )
    d = d.withColumn("__others", F.filter("__parts", lambda x: ~is_text(x)))
    d = d.withColumn("__first", F.coalesce(F.sum(F.size("__others")).over(before), F.lit(0)))
    shown = F.transform(
        F.col("__parts"),
        lambda x, i: F.when(is_text(x), escaped(F.coalesce(x["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), escaped(x["type"]), F.lit(":"), (F.col("__first") + F.size(F.filter(F.slice("__parts", 1, i), lambda y: ~is_text(y)))).cast("string"), F.lit(":"), _expanded(x).cast("string"), F.lit("|>"))
        ),
    )
    d = d.withColumn("__shown", F.array_join(shown, ""))
    d = d.withColumn("__head", F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT)))
    d = d.withColumn("__line", F.concat("__head", "__shown", F.lit(END)))
    d = d.withColumn("__start", F.coalesce(F.sum(F.length("__line").cast("long")).over(before), F.lit(0)) + F.length("__head"))
    d = d.withColumn("turn_no", F.row_number().over(own))
    kept = F.struct(
        "turn_no", F.col("__line").alias("line"), F.col("__start").alias("start"), F.length("__shown").cast("long").alias("len"),
        (F.col("role") == train_role).alias("trained"),
        F.transform("__others", lambda x: F.struct(F.col("turn_no").alias("turn_no"), x["type"].alias("kind"), x["ref"].alias("ref"), _expanded(x).alias("n_tokens"))).alias("others"),
    )
    g = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(kept)).alias("__turns"))
    attachments = F.flatten(F.transform("__turns", lambda x: x["others"]))
    return g.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("__turns", lambda x: x["line"]), "").alias("formatted"),
        F.transform(F.filter("__turns", lambda x: x["trained"]), lambda x: F.struct(x["start"].alias("start"), x["len"].alias("len"))).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation of texts."""
    lines = F.split(formatted, r"<\|end\|>", -1)
    lines = F.slice(lines, 1, F.size(lines) - 1)
    return F.transform(
        lines,
        lambda x: F.struct(
            unescaped(F.substring_index(x, TEXT, 1).substr(F.lit(len(TURN) + 1), F.length(x))).alias("role"),
            unescaped(x.substr(F.instr(x, TEXT) + F.lit(len(TEXT)), F.length(x))).alias("text"),
        ),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), s["len"].cast("int")))), "")


def op9_chat_formatting(spark, sf_dir):
    from .common import table

    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn int, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    d = format_chats(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    d = d.withColumn("__back", read_back(F.col("formatted"))).withColumn("__loss", masked_text(F.col("formatted"), F.col("loss_spans")))
    every = F.array_join(F.transform("__back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("__back").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
