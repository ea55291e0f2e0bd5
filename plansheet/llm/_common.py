"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plansheet.operators.tables import shared_folder
from plansheet.shipping import ship

#: One word: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch, so that Python workers hold some megabytes of texts at a time, however long these are.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ARROW_BYTES, where the session has the default; a value of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64m", "64MB", "67108864"):
        spark.conf.set(key, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hidden(df: DataFrame, own: tuple[str, ...] = ("doc_id", "text", "source", "n_chars")) -> tuple[DataFrame, dict[str, str]]:
    """df with the columns that an operator doesn't use under names that can't clash with its own, and those names."""
    names = {c: c if c in own else f"_extra{k}" for k, c in enumerate(df.columns)}
    return df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), names


def shown(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of hidden() under their names again."""
    return df.select(*(F.col(n).alias(c) for c, n in names.items()))
