"""Documents staged once in bucketed groups, so that several passes over the texts need no shuffle of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_path

#: groups that a task of the staging job deals its rows to
SPLIT = 8


def total_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def bucketed(docs: DataFrame, name: str) -> DataFrame:
    """docs plus __group and __row, written as a bucketed table in the shared folder and read back.

    __row is unique and __group small enough for one worker's memory; both are fixed once the
    table is written, so later passes agree even if executors are lost. A group never spans two
    tasks of the staging job, so no shuffle is needed to write it, and joins or co-groups on
    __group read the table in place.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("__row", F.monotonically_increasing_id()).withColumn(
        "__group", (F.spark_partition_id() * SPLIT + F.pmod(F.col("__row"), F.lit(SPLIT))).cast("int")
    )
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    made = f"mdq_{name}_{uuid.uuid4().hex[:12]}"
    rows.write.option("path", work_path(spark, name)).option("compression", "zstd").bucketBy(n, "__group").saveAsTable(made)
    return spark.table(made)
