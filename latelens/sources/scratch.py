"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The folder of spark.checkpoint.dir, or one in the warehouse, which is shared too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return named.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df written once and read again: what several jobs look at is then the same, whatever made it."""
    folder = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
