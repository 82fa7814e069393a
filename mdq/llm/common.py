"""Helpers shared by the operators: staged tables, row keys, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: ASCII white space, the only separators of words: \x20 and \x09 to \x0D
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: sorts after every id, so that rows without an id come last
NO_ID = 2**63 - 1


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data, in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/mdq-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: the plan restarts there and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_list(text: Column) -> Column:
    """Words between ASCII white space, in order."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def hash128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(c), F.xxhash64(F.lit(1), c)


def pieces(total_bytes: int, each: int, least: int = 8) -> int:
    """How many parts of about `each` bytes hold total_bytes."""
    return max(least, -(-int(total_bytes) // each))
