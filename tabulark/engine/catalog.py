"""Table and index metadata: numbered JSON snapshots of a warehouse.

A table is a list of Parquet files.  A change writes new files beside the old
and then the next snapshot; the highest number counts, so readers see all of a
change or nothing, and only files that hold touched rows are rewritten.  A
number can be taken once: of two changes to one snapshot the second is refused.
An index is a table of (key, file), laid out by key bucket: it names the files
that an equality must read.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = {"INT": T.IntegerType(), "BOOLEAN": T.BooleanType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "TIMESTAMP": T.TimestampType(), "TIMESTAMP_NTZ": T.TimestampNTZType()}
#: Snapshots that stay for readers when older ones are removed.
KEPT = 10


@dataclass
class Column:
    name: str
    kind: str
    length: int = 0

    @property
    def type(self) -> T.DataType:
        return KINDS.get(self.kind, T.StringType())

    @property
    def bytes(self) -> int:
        return {"INT": 4, "BOOLEAN": 1, "BIGINT": 8, "DOUBLE": 8, "TIMESTAMP": 8, "TIMESTAMP_NTZ": 8}.get(self.kind, self.length or 16)


@dataclass
class Table:
    name: str
    columns: list[Column]
    files: list[str] = field(default_factory=list)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, True) for c in self.columns])

    def typed(self, df, *more: str):
        """df with its CHAR columns known to Spark as such, through all that is derived from them."""
        meta = {c.name: {"__CHAR_VARCHAR_TYPE_STRING": f"char({c.length})"} for c in self.columns if c.kind == "CHAR"}
        return df.select(*[F.col(f"`{c.name}`").alias(c.name, metadata=meta[c.name]) if c.name in meta else F.col(f"`{c.name}`") for c in self.columns], *more)

    @property
    def record_bytes(self) -> int:
        return sum(c.bytes for c in self.columns)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass
class Index:
    name: str
    table: str
    column: str
    kind: str = "LINEAR_HASH"
    columns: list[str] = field(default_factory=list)
    #: [folder, number of buckets] of each part.
    parts: list[list] = field(default_factory=list)


class Conflict(RuntimeError):
    """Another writer's change came first."""


class Catalog:
    """Names are told apart without case."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables: dict[str, Table] = {}
        self.indexes: dict[str, Index] = {}
        self.version = 0
        self.load()

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), where

    def _snapshots(self) -> list[int]:
        fs, root = self._fs(self.root)
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[8:-5]) for n in names if re.fullmatch(r"catalog-\d+\.json", n))

    def load(self) -> None:
        """Read the newest snapshot."""
        there = self._snapshots()
        self.tables, self.indexes, self.version = {}, {}, there[-1] if there else 0
        if not there:
            return
        fs, path = self._fs(f"{self.root}/catalog-{self.version}.json")
        stream = fs.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        got = json.loads(text)
        self.tables = {k: Table(v["name"], [Column(**c) for c in v["columns"]], v["files"]) for k, v in got["tables"].items()}
        self.indexes = {k: Index(**v) for k, v in got["indexes"].items()}

    def save(self) -> None:
        """Write the next snapshot: beside first, then under its number, which must be free."""
        jvm = self.spark._jvm
        text = json.dumps({"tables": {k: asdict(v) for k, v in self.tables.items()}, "indexes": {k: asdict(v) for k, v in self.indexes.items()}})
        fs, new = self._fs(f"{self.root}/new-{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/catalog-{self.version + 1}.json")
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(path), how)
        except Py4JJavaError as e:
            fs.delete(new, False)
            self.load()
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict("the tables were changed meanwhile; the statement had no effect") from None
            raise
        self.version += 1

    def forget_old(self) -> None:
        """Delete all but the newest snapshots."""
        for n in self._snapshots()[:-KEPT]:
            self.remove(f"{self.root}/catalog-{n}.json")

    def fresh(self, name: str) -> str:
        return f"{self.root}/{name.lower()}/{uuid.uuid4().hex}"

    def remove(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def table(self, name: str) -> Table | None:
        return self.tables.get(name.lower())

    def index(self, name: str) -> Index | None:
        return self.indexes.get(name.lower())

    def find_spatial(self, table: str) -> Index | None:
        """The first index over several columns, which holds metadata only."""
        return next((i for i in self.indexes_of(table) if i.kind == "RTREE"), None)

    def indexes_of(self, table: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == table.lower()]

    def find_index(self, table: str, column: str) -> Index | None:
        return next((i for i in self.indexes_of(table) if i.kind == "LINEAR_HASH" and i.column.lower() == column.lower()), None)
