"""What several operators share: the shared folder, cut lineage, Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of strings that a Python worker turns into its own objects at a time.
SLICE = 4_000_000

#: Tables of written() that are not deleted yet.
_paths: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where the session has none and runs on one machine (tests) a temporary
    folder is used instead; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return "file://" + os.path.join(tempfile.gettempdir(), "tabulark-shared")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends here,
    so a lost executor costs a read and never the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tabulark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tabulark_path = path  # type: ignore[attr-defined]
    _paths.add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    where.getFileSystem(conf).delete(where, True)
    _paths.discard(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_tabulark_path", None)
    if path:
        _delete(df.sparkSession, path)


def forget_all(spark: SparkSession) -> None:
    """Delete all tables that written() made in this program: for the end of a job, when its results are used or saved."""
    for path in list(_paths):
        _delete(spark, path)


def remainder(doc_id, n: int):
    """crc32(doc_id as text) mod n, the fold of a document."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def slices(batch: pa.RecordBatch, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in order, about limit bytes of strings at a time (a longer row alone)."""
    size = np.full(batch.num_rows, 16, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def by_batch(df: DataFrame, each: Callable[..., dict], schema: str, setup: Callable[[], object] | None = None) -> DataFrame:
    """mapInArrow with columns as Python lists.

    each(columns, state) gets {column: list} and returns {column: values} for
    the columns of schema; state is setup()'s value, made once a task.
    """
    spark = df.sparkSession
    fields = spark.createDataFrame([], schema).schema
    arrow = [(f.name, f.dataType.simpleString()) for f in fields]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for whole in batches:
            for batch in slices(whole):
                got = each({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}, state)
                yield pa.RecordBatch.from_arrays([pa.array(got[n], kinds[k]) for n, k in arrow], [n for n, _ in arrow])

    return df.mapInArrow(run, schema)
