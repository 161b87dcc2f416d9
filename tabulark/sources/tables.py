"""Where rows come from and go to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; naming columns is left to the reader by pruning."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def literal(spark: SparkSession, rows: list[tuple], schema: str | StructType) -> DataFrame:
    """Rows that are already in memory."""
    return spark.createDataFrame(rows, schema)


def compact(df: DataFrame, files: int) -> DataFrame:
    """The same rows in fewer partitions, to be written as fewer files."""
    return df.coalesce(files)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for tables of one use, in the one that the cluster names in
    spark.checkpoint.dir; only on one machine without it (tests) a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "tabulark-shared")
    return f"{root.rstrip('/')}/tabulark/{name}-{uuid.uuid4().hex}"
