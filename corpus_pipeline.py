"""The corpus pipeline: stages over documents, each written and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return
the columns of documents. Rows of equal doc_id and text count as one document in the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from latelens.llm.bpe import default_path, encode
from latelens.llm.common import WORD, cut, table
from latelens.llm.jaccard import jaccard_groups
from latelens.llm.mixing import mixed_rows
from latelens.llm.pii import QUERY_KEY, pseudonymise
from latelens.llm.quality import quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that failed; other columns stay."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    d = quality_rules(docs.select(F.struct(*columns).alias("__row"), "text"))
    # a generator holds the filter back: pushed down, it would repeat every rule where it is used
    d = d.select(F.inline(F.array(F.struct("__row", "clean_text", "kept")))).where("kept")
    return d.select(*[F.col("clean_text").alias("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]).transform(_sized(docs))


def _sized(docs: DataFrame):
    """Sets n_chars, where there is one, to the text's length."""
    kind = dict(docs.dtypes).get("n_chars")
    return lambda d: d if kind is None else d.withColumn("n_chars", F.length("text").cast(kind))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word similarity of 0.8 or more: the one of least doc_id, null ids last.

    Each distinct doc_id and text is a document of its own, known by 128 bits of a hash of both. Texts without words
    link with nothing: such rows of null doc_id all stay, of others one of each doc_id and text."""
    key = F.concat_ws(":", *[F.xxhash64(F.lit(k), "doc_id", "text", F.col("doc_id").isNull()) for k in (1, 2)])
    groups = cut(jaccard_groups(docs.select(key.alias("doc_id"), "text"), shingle=5, percent=80).withColumnRenamed("doc_id", "__id").distinct())
    given = docs.select(key.alias("__id"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("length")).distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", -F.col("length"), "__id", (F.col("doc_id").isNull() & (F.col("n_shingles") == 0)).alias("all"))
    stays = groups.join(given, "__id").groupBy("component_id").agg(F.min(order).alias("m")).select("m.__id", F.col("m.all").alias("__all"))
    row = Window.partitionBy("__id").orderBy(F.lit(0))
    kept = docs.withColumn("__id", key).join(stays, "__id").withColumn("__n", F.row_number().over(row)).where("__n = 1 or __all")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pseudonymise(docs, QUERY_KEY, counts=False).transform(_sized(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as the mix of sources takes."""
    return mixed_rows(docs, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row."""
    return encode(docs, default_path())


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", pii),
    ("mixing sources", mixing),
    ("BPE encoding", bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = cut(docs)
    return docs
