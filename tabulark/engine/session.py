"""The engine: statements in, DataFrames and messages out."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.chars import char_fit
from ..operators import changes
from ..plans import explain as X
from ..plans import stats as S
from . import statements as P
from .catalog import Catalog, Column, Conflict, Index, Table

#: Buckets of an index's layout at least and at most, entries of one aimed at; parts of an index that are left apart.
INDEX_BUCKETS, MOST_BUCKETS, ENTRIES, PARTS = 4, 4096, 1_000_000, 16


class EngineError(ValueError):
    pass


@dataclass
class Result:
    """Rows (None for statements without), a message, the explanation and the counters asked for."""

    df: DataFrame | None
    said: str = ""
    explain: str | None = None
    observed: dict[str, Observation] = field(default_factory=dict)

    @property
    def message(self) -> str:
        """What the statement did; of a query its rows are counted for it."""
        return self.said or f"{self.df.count()} row(s) returned."

    @property
    def counters(self) -> dict[str, int]:
        """Rows that each scan read and that came out, once the rows were used."""
        return {name: o.get["rows"] for name, o in self.observed.items()}

    def text(self, limit: int = 100) -> str:
        """The rows as a table of fixed-width columns."""
        return self.df._jdf.showString(limit, 0, False)


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: object
    high: object = None


class Engine:
    """Tables of INT, BOOLEAN and CHAR(n) in a folder, over Spark.

    compat=True reads <= and >= as < and >.
    """

    def __init__(self, spark: SparkSession, warehouse: str, compat: bool = False):
        self.spark, self.compat = spark, compat
        self.catalog = Catalog(spark, warehouse)
        self._stats: dict[str, S.TableStats] = {}
        self._views: set[str] = set()

    def close(self) -> None:
        """Drop the views of this engine; tables stay in their folder."""
        for view in self._views:
            self.spark.catalog.dropTempView(view)
        self._views.clear()
        self._stats.clear()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def tables(self) -> list[str]:
        return sorted(t.name for t in self.catalog.tables.values())

    def indexes(self, table: str | None = None) -> list[tuple[str, str, tuple[str, ...], str]]:
        """(index, table, columns, kind) of all indexes, or of a table's."""
        every = self.catalog.indexes.values() if table is None else self.catalog.indexes_of(self._known(table).name)
        return sorted((i.name, i.table, tuple(i.columns or [i.column]), i.kind) for i in every)

    def describe(self, table: str) -> list[tuple[str, str, int]]:
        return [(c.name, c.kind, c.length) for c in self._known(table).columns]

    # -- tables -----------------------------------------------------------

    def _known(self, name: str) -> Table:
        t = self.catalog.table(name)
        if t is None:
            raise EngineError(f"Table '{name}' does not exist")
        return t

    def table(self, name: str) -> DataFrame:
        return self._read(self._known(name))

    def _read(self, t: Table, files: list[str] | None = None) -> DataFrame:
        files = t.files if files is None else files
        if not files:
            return t.typed(self.spark.createDataFrame([], t.schema))
        return t.typed(self.spark.read.schema(t.schema).parquet(*files))

    def row_ids(self, table: str) -> DataFrame:
        """The rows with the file and the place in it of each."""
        t = self._known(table)
        place = [F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_number")]
        if not t.files:
            return self._read(t).select("*", F.lit("").alias("row_file"), F.lit(0).cast("long").alias("row_number"))
        return self.spark.read.schema(t.schema).parquet(*t.files).select("*", *place)

    def fetch(self, table: str, file: str, number: int) -> DataFrame:
        """The row at a place that row_ids() named; only its file is read."""
        t = self._known(table)
        if file.rsplit("/", 1)[-1] not in {f.rsplit("/", 1)[-1] for f in t.files}:
            return self._read(t, [])
        return t.typed(self.spark.read.schema(t.schema).parquet(file).where(F.col("_metadata.row_index") == number))

    def _named(self, t: Table, index: Index, value) -> list[str]:
        """The files that the index names for a value."""
        c = t.column(index.column)
        key, found = F.lit(value).cast(c.type), None
        for buckets in sorted({n for _, n in index.parts}):
            parts = [p for p, n in index.parts if n == buckets]
            base = parts[0].rsplit("/", 1)[0]
            rows = self.spark.read.option("basePath", base).parquet(*parts).where((F.col("bucket") == self._bucket(key, buckets)) & (F.col("key") == key)).select("file")
            found = rows if found is None else found.union(rows)
        named = set() if found is None else {x.file for x in found.distinct().collect()}  # at most the table's files
        return [f for f in t.files if f in named]

    def _fitting(self, c: Column, value):
        return str(value)[: c.length].ljust(c.length) if c.kind == "CHAR" else value

    def lookup(self, table: str, column: str, value) -> DataFrame:
        """Rows with column = value; only files that the index names are read."""
        t = self._known(table)
        c = t.column(column)
        if c is None:
            raise EngineError(f"no column {column} in {table}")
        index = self.catalog.find_index(table, column)
        value = self._fitting(c, value)
        files = t.files if index is None or not t.files else self._named(t, index, value)
        return self._read(t, files).where(F.col(c.name) == F.lit(value))

    @staticmethod
    def _bucket(key: SparkColumn, buckets: int) -> SparkColumn:
        return F.pmod(F.hash(key), F.lit(buckets))

    def _checked(self, df: DataFrame, t: Table) -> DataFrame:
        """df as t stores it: CHAR fitted, no nulls."""
        out = []
        for c in t.columns:
            v = F.col(c.name).cast(c.type)
            v = char_fit(v, c.length) if c.kind == "CHAR" else v
            out.append(F.when(v.isNull(), F.raise_error(F.lit(f"null in {t.name}.{c.name}"))).otherwise(v).alias(c.name))
        return df.select(*out)

    def _write(self, t: Table, df: DataFrame) -> list[str]:
        path = self.catalog.fresh(t.name)
        self._checked(df, t).write.parquet(path)
        fs, where = self.catalog._fs(path)
        return [x.getPath().toString() for x in fs.listStatus(where) if x.getPath().getName().endswith(".parquet")]

    def _index_files(self, t: Table, index: Index, files: list[str]) -> None:
        """Add a part for new files; where there are many parts, all become one, without files that are gone."""
        if not files or index.kind != "LINEAR_HASH":
            return
        if len(index.parts) >= PARTS:
            index.parts, files = [], t.files
        by_name = {f.rsplit("/", 1)[1]: f for f in files}
        names = self.spark.createDataFrame(list(by_name.items()), "name string, file string")
        read = self.spark.read.schema(t.schema).parquet(*files)
        rows = read.select(F.col(index.column).alias("key"), F.col("_metadata.file_name").alias("name")).distinct()
        entries = read.count()  # of footers; a bound
        buckets = min(MOST_BUCKETS, max(INDEX_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, entries / ENTRIES))))))
        path = f"{self.catalog.root}/{t.name}/index-{index.name.lower()}/part={uuid.uuid4().hex}"
        rows = rows.join(names, "name").select("key", "file", self._bucket(F.col("key"), buckets).alias("bucket"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(path)
        index.parts.append([path, buckets])

    def _changed(self, t: Table, files: list[str], new: list[str]) -> None:
        t.files = files + new
        for index in self.catalog.indexes_of(t.name):
            self._index_files(t, index, new)
        self._stats.pop(t.name.lower(), None)
        self._saved()

    def _saved(self) -> None:
        try:
            self.catalog.save()
        except Conflict as e:
            self._stats.clear()
            raise EngineError(str(e)) from None

    def compact(self, name: str, rows_per_file: int = 5_000_000) -> int:
        """Rewrite the table into files of about so many rows, and its indexes in one part each; the number of files."""
        t = self._known(name)
        if not t.files:
            return 0
        df = self._read(t)
        new = self._write(t, df.repartition(max(1, math.ceil(df.count() / rows_per_file))))
        for index in self.catalog.indexes_of(t.name):
            index.parts = []
        self._changed(t, [], new)
        return len(new)

    # -- statements -------------------------------------------------------

    def execute(self, sql: str, explain: bool = False, counters: bool = False) -> Result:
        """Run a statement.  explain adds the decisions and Spark's plan to a
        query's result, counters the rows of its scans and of its output."""
        try:
            s = P.parse(sql)
        except P.ParseError as e:
            raise EngineError(str(e)) from e
        if isinstance(s, P.Select):
            if s.explained:
                text = self._select(s, True, False).explain or ""
                lines = self.spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line int, plan string")
                return Result(lines, "", text)
            return self._select(s, explain, counters)
        return getattr(self, f"_{type(s).__name__.lower()}")(s, explain)

    def _createtable(self, s: P.CreateTable, _: bool) -> Result:
        if self.catalog.table(s.table):
            raise EngineError(f"Table '{s.table}' already exists")
        if len({c[0].lower() for c in s.columns}) < len(s.columns):
            raise EngineError("column names repeat")
        self.catalog.tables[s.table.lower()] = Table(s.table.lower(), [Column(*c) for c in s.columns])
        self._saved()
        return Result(None, f"Table '{s.table}' created.")

    def _droptable(self, s: P.DropTable, _: bool) -> Result:
        t = self._known(s.table)
        for i in self.catalog.indexes_of(t.name):
            del self.catalog.indexes[i.name.lower()]
        del self.catalog.tables[t.name]
        self._saved()
        self.catalog.remove(f"{self.catalog.root}/{t.name}")
        self.spark.catalog.dropTempView(t.name)
        self._views.discard(t.name)
        self._stats.pop(t.name, None)
        return Result(None, f"Table '{s.table}' dropped.")

    def _createindex(self, s: P.CreateIndex, _: bool) -> Result:
        t = self._known(s.table)
        if self.catalog.index(s.index):
            raise EngineError(f"Index '{s.index}' already exists")
        c = t.column(s.column)
        if c is None:
            raise EngineError(f"no column {s.column} in {s.table}")
        index = Index(s.index, t.name, c.name)
        self._index_files(t, index, t.files)
        self.catalog.indexes[s.index.lower()] = index
        self._saved()
        return Result(None, f"Index '{s.index}' created on {s.table}({s.column}).")

    def create_spatial_index(self, name: str, table: str, columns: list[str]) -> None:
        """An index over two or more columns: metadata only, no query uses it."""
        t = self._known(table)
        if self.catalog.index(name):
            raise EngineError(f"Index '{name}' already exists")
        found = [t.column(c) for c in columns]
        if len(columns) < 2 or None in found or len({c.name for c in found}) < len(columns):
            raise EngineError("a spatial index needs two or more different columns of its table")
        self.catalog.indexes[name.lower()] = Index(name, t.name, found[0].name, "RTREE", [c.name for c in found])
        self._saved()

    def _dropindex(self, s: P.DropIndex, _: bool) -> Result:
        index = self.catalog.index(s.index)
        if index is None:
            raise EngineError(f"Index '{s.index}' does not exist")
        del self.catalog.indexes[s.index.lower()]
        self._saved()
        for p, _ in index.parts:
            self.catalog.remove(p)
        return Result(None, f"Index '{s.index}' dropped.")

    def _typed(self, c: Column, v):
        """A literal as its column's type; text is read as the type asks."""
        if v is None:
            raise EngineError(f"null for {c.name}")
        if isinstance(v, P.Expression):
            raise EngineError(f"{v.sql} is not a literal")
        try:
            if c.kind == "INT":
                if isinstance(v, bool):
                    raise ValueError(v)
                n = int(v.strip()) if isinstance(v, str) else int(v)
                if not -(2**31) <= n < 2**31:
                    raise ValueError(v)
                return n
        except ValueError:
            raise EngineError(f"{v!r} is not an INT for {c.name}") from None
        if c.kind == "BOOLEAN":
            return v if isinstance(v, bool) else str(v).strip().lower() == "true"
        if c.kind in ("BIGINT", "DOUBLE"):
            try:
                return int(v) if c.kind == "BIGINT" else float(v)
            except ValueError:
                raise EngineError(f"{v!r} is not a {c.kind} for {c.name}") from None
        if c.kind in ("TIMESTAMP", "TIMESTAMP_NTZ"):
            try:
                return datetime.fromisoformat(str(v))
            except ValueError:
                raise EngineError(f"{v!r} is not a TIMESTAMP for {c.name}") from None
        if c.kind == "STRING":
            return str(v)
        text = str(v).upper() if isinstance(v, bool) else str(v)
        return text[: c.length].ljust(c.length)

    def _insert(self, s: P.Insert, _: bool) -> Result:
        t = self._known(s.table)
        order = t.columns
        if s.columns is not None:
            order = [t.column(n) for n in s.columns]
            if None in order or len({c.name for c in order}) != len(t.columns):
                raise EngineError("the column list must name every column once")
        rows = []
        for row in s.rows:
            if len(row) != len(order):
                raise EngineError(f"{len(row)} values for {len(order)} columns")
            got = {c.name: self._typed(c, v) for c, v in zip(order, row)}
            rows.append(tuple(got[c.name] for c in t.columns))
        new = self._write(t, self.spark.createDataFrame(rows, t.schema).coalesce(1))
        self._changed(t, t.files, new)
        return Result(None, f"{len(rows)} row{'' if len(rows) == 1 else 's'} inserted.")

    def load(self, name: str, df: DataFrame) -> int:
        """Append a DataFrame's rows, matched by position."""
        t = self._known(name)
        new = self._write(t, changes.inserted(self.spark.createDataFrame([], t.schema), df))
        self._changed(t, t.files, new)
        return self._read(t, new).count()

    def create(self, name: str, df: DataFrame) -> int:
        """A table with the columns of a DataFrame and its rows; the number of rows."""
        kinds = {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP_NTZ", "string": "STRING"}
        if any(k not in kinds for _, k in df.dtypes):
            raise EngineError(f"columns must be of types {', '.join(kinds)}")
        self._createtable(P.CreateTable(name, tuple((c, kinds[k], 0) for c, k in df.dtypes)), False)
        return self.load(name, df)

    def _where(self, t: Table, text: str | None) -> SparkColumn | None:
        if text is None:
            return None
        return F.expr(P.fit_chars(text, lambda q, n: self._length([(t.name, t.name)], q, n), self.compat))

    def _length(self, relations, qualifier: str | None, name: str) -> int | None:
        for alias, table in relations:
            t = self.catalog.table(table)
            if t is not None and (qualifier is None or qualifier.lower() in (alias.lower(), table.lower())):
                c = t.column(name)
                if c is not None:
                    return c.length or None
        return None

    def _touched(self, t: Table, condition: SparkColumn | None, text: str | None) -> tuple[list[str], int]:
        """Files that hold matching rows, and how many rows match."""
        if condition is None:
            return list(t.files), self._read(t).count()
        eq = self._simple(t, text)
        index = self.catalog.find_index(t.name, eq.column) if eq is not None and eq.op == "=" else None
        if not t.files:
            changes.matching(self._read(t), condition).count()  # names and types are checked even so
            return [], 0
        files = t.files if index is None else self._named(t, index, self._fitting(t.column(eq.column), eq.value))
        if not files:
            return [], 0
        place = "row_file"
        while t.column(place) is not None:
            place = "_" + place
        read = t.typed(self.spark.read.schema(t.schema).parquet(*files).select("*", F.col("_metadata.file_name").alias(place)), place)
        rows = changes.matching(read, condition).groupBy(place).agg(F.count("*").alias("n")).collect()  # at most one row a file
        hit = {r[0]: r.n for r in rows}
        return [f for f in t.files if f.rsplit("/", 1)[1] in hit], sum(hit.values())

    def _update(self, s: P.Update, _: bool) -> Result:
        t = self._known(s.table)
        new: dict[str, SparkColumn] = {}
        for name, v in s.changes:
            c = t.column(name)
            if c is None:
                raise EngineError(f"no column {name} in {s.table}")
            new[c.name] = F.expr(v.sql) if isinstance(v, P.Expression) else F.lit(self._typed(c, v))
        condition = self._where(t, s.where)
        files, n = self._touched(t, condition, s.where)
        if n:
            made = self._write(t, changes.updated(self._read(t, files), new, condition))
            self._swap(t, files, made)
        return Result(None, f"{n} row(s) updated.")

    def _delete(self, s: P.Delete, _: bool) -> Result:
        t = self._known(s.table)
        condition = self._where(t, s.where)
        files, n = self._touched(t, condition, s.where)
        if n:
            gone = changes.matching(self._read(t, files), condition)
            made = [] if condition is None else self._write(t, changes.deleted(self._read(t, files), condition))
            self._swap(t, files, made)
            return Result(gone, f"{n} row(s) deleted.")
        return Result(None, f"{n} row(s) deleted.")

    def _swap(self, t: Table, old: list[str], new: list[str]) -> None:
        """Old files stay on disk for readers that still hold them; vacuum() removes them."""
        self._changed(t, [f for f in t.files if f not in set(old)], new)

    def vacuum(self, name: str) -> None:
        """Delete a table's files that no snapshot names any more."""
        t = self._known(name)
        fs, where = self.catalog._fs(f"{self.catalog.root}/{t.name}")
        self.catalog.forget_old()
        live = {f.rsplit("/", 2)[1] for f in t.files}
        for x in fs.listStatus(where) if fs.exists(where) else []:
            leaf = x.getPath().getName()
            if leaf not in live and not leaf.startswith("index-"):
                fs.delete(x.getPath(), True)
        for index in self.catalog.indexes_of(name):
            fs, where = self.catalog._fs(f"{self.catalog.root}/{t.name}/index-{index.name.lower()}")
            parts = {p.rsplit("/", 1)[1] for p, _ in index.parts}
            for x in fs.listStatus(where) if fs.exists(where) else []:
                if x.getPath().getName() not in parts:
                    fs.delete(x.getPath(), True)

    # -- queries ----------------------------------------------------------

    def _indexed(self, t: Table, alias: str, sql: str, joined: bool) -> tuple[Index, Condition] | None:
        """The index, and the equality of a top-level condition, by which the one mention of a table in a query is read."""
        tokens = P.lex(sql)
        if {"UNION", "INTERSECT", "EXCEPT", "OR", "LEFT", "RIGHT", "FULL", "OUTER", "ANTI", "SEMI"} & {x.upper for x in tokens} or sum(x.upper == "SELECT" for x in tokens) != 1:
            return None
        for c in self._conditions(t, alias, sql, joined):
            index = self.catalog.find_index(t.name, c.column) if c.op == "=" else None
            if index is not None:
                return index, c
        return None

    def _conditions(self, t: Table, alias: str, sql: str, joined: bool) -> list[Condition]:
        """The comparisons of a table's columns with literals in a query's WHERE."""
        where = _where_text(sql)
        parts = [p.strip() for p in _conjuncts(where)] if where else []
        return [c for c in (self._simple(t, p) for p in parts if not joined or p.lower().startswith((alias.lower() + ".", t.name + "."))) if c]

    def _select(self, s: P.Select, explain: bool, counters: bool) -> Result:
        rel = P.relations(s.sql, lambda n: self.catalog.table(n) is not None)
        observed: dict[str, Observation] = {}
        for alias, table in rel:
            t = self._known(table)
            found = self._indexed(t, alias, s.sql, len(rel) > 1) if sum(n.lower() == t.name for _, n in rel) == 1 else None
            files = None
            if found is not None and t.files:
                index, c = found
                cheaper = not explain or X.access_path(X.Trace(), t.name, c, self.stats(t.name), t.record_bytes, {c.column.lower()}).startswith("SelectIndex")
                if cheaper:
                    files = self._named(t, index, self._fitting(t.column(c.column), c.value))
            df = self._read(t, files)
            if counters:
                observed[t.name] = Observation()
                df = df.observe(observed[t.name], F.count(F.lit(1)).alias("rows"))
            df.createOrReplaceTempView(t.name)
            self._views.add(t.name)
        tokens = P.lex(s.sql)
        words = [t.upper for t in tokens]
        joined = len(rel) > 1 and not {"UNION", "INTERSECT", "EXCEPT"} & set(words) and words.count("SELECT") == 1
        if joined and "CROSS" not in words and "USING" not in words and "NATURAL" not in words and not self._equates(tokens):
            raise EngineError("a join needs an equality of columns")
        sql = P.fit_chars(s.sql, lambda q, n: self._length(rel, q, n), self.compat)
        df = self.spark.sql(sql)
        star = words[:2] == ["SELECT", "*"] or words[:3] == ["SELECT", "DISTINCT", "*"]
        if joined and star and not {"USING", "NATURAL", "SEMI", "ANTI", "GROUP"} & set(words):
            twice = len({t.lower() for _, t in rel}) < len(rel)
            names = [f"{(a if twice else t).lower()}_{c.name}" for a, t in rel for c in self._known(t).columns]
            if len(names) == len(df.columns):
                df = df.toDF(*names)
        text = self._explained(s.sql, rel, df) if explain else None
        if counters:
            observed["output"] = Observation()
            df = df.observe(observed["output"], F.count(F.lit(1)).alias("rows"))
        return Result(df, "", text, observed)

    @staticmethod
    def _equates(tokens) -> bool:
        for i, t in enumerate(tokens):
            if t.value == "=" and 0 < i < len(tokens) - 1 and tokens[i - 1].kind == "name" == tokens[i + 1].kind and not {tokens[i - 1].upper, tokens[i + 1].upper} & {"TRUE", "FALSE"}:
                return True
        return False

    def count_message(self, result: Result) -> str:
        """The message of a query once its rows are counted."""
        return result.message

    def stats(self, name: str) -> S.TableStats:
        t = self._known(name)
        if t.name not in self._stats:
            self._stats[t.name] = S.collect(self._read(t), [c.name for c in t.columns if c.kind == "INT"], [c.name for c in t.columns if c.kind != "INT"])
        return self._stats[t.name]

    def _simple(self, t: Table, where: str | None) -> Condition | None:
        """where as one comparison of a column with a literal, if it is that."""
        if not where:
            return None
        k = P.lex(where)
        if len(k) >= 3 and k[1].value == "." and k[0].kind == k[2].kind == "name":
            k = k[2:]
        if len(k) < 3 or k[0].kind != "name" or t.column(k[0].value.strip("`")) is None:
            return None
        name, r = t.column(k[0].value.strip("`")).name, P._Reader(" ".join(x.value for x in k[2:]))
        if k[1].value in ("=", "<", ">", "<=", ">="):
            v = r.value(("AND", "OR"))
            return None if r.at < len(r.tokens) or isinstance(v, P.Expression) else Condition(name, k[1].value, v)
        if k[1].upper == "BETWEEN":
            a = r.value(("AND",))
            r.need("AND")
            b = r.value(("AND", "OR"))
            return None if r.at < len(r.tokens) or isinstance(b, P.Expression) else Condition(name, "between", a, b)
        return None

    def _explained(self, sql: str, rel, df: DataFrame) -> str:
        """Logical tree and decisions of each SELECT, then Spark's plan."""
        out = []
        tokens = P.lex(sql)
        cuts = [0] + [t.end for t in tokens if t.upper in ("UNION", "INTERSECT", "EXCEPT")] + [len(sql)]
        for start, end in zip(cuts, cuts[1:]):
            part = sql[start:end]
            own = P.relations(part, lambda n: self.catalog.table(n) is not None)
            if own:
                out.append(self._explain_one(part, own))
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n\n".join([*out, "=== Spark Plan ===\n" + plan])

    def _explain_one(self, sql: str, rel) -> str:
        tokens = P.lex(sql)
        trace = X.Trace()
        tables = [self._known(t) for _, t in rel]
        tree: list[tuple[int, str]] = []
        distinct, join = any(t.upper == "DISTINCT" for t in tokens), len(tables) > 1
        depth = int(distinct) + int(join)
        roots = []
        for (alias, _), t in zip(rel, tables):
            mine = self._conditions(t, alias, sql, join)
            once = sum(n.lower() == t.name for _, n in rel) == 1
            indexed = {i.column.lower() for i in self.catalog.indexes_of(t.name) if i.kind == "LINEAR_HASH"} if once and self._indexed(t, alias, sql, join) else set()
            condition = next((c for c in mine if c.op == "=" and c.column.lower() in indexed), mine[0] if mine else None)
            roots.append(X.access_path(trace, t.name, condition, self.stats(t.name), t.record_bytes, indexed))
            if condition is not None:
                tree.append((depth, f"[FILTER] {condition.column} {condition.op} {condition.value}"))
            tree.append((depth + (condition is not None), f"[SCAN] {t.name}"))
        root = roots[0]
        if join:
            on = next((f"{_column_text(tokens, i, -1)} = {_column_text(tokens, i, 1)}" for i, t in enumerate(tokens) if t.value == "=" and tokens[i - 1].kind == "name" and i + 1 < len(tokens) and tokens[i + 1].kind == "name"), "cross")
            method = X.join_method(trace, self.stats(tables[0].name).rows, self.stats(tables[1].name).rows, on, None)
            tree.insert(0, (int(distinct), f"[JOIN] {on}"))
            root = f"BNLJoin({on})" if method == "bnl" else f"MergeJoin({on}, sort first)"
        if distinct:
            method = X.distinct_method(trace, join, max(1, self.stats(tables[0].name).rows))
            tree.insert(0, (0, "[DISTINCT] all columns"))
            root = "SortBasedDistinct" if method == "sort" else "HashBasedDistinct"
        return "\n".join(["=== Logical Plan ===", *("  " * d + x for d, x in tree), "=== Physical Plan ===", root, trace.text()])


def _where_text(sql: str) -> str | None:
    """The condition of a query without subqueries."""
    tokens = P.lex(sql)
    at = next((t for t in tokens if t.upper == "WHERE"), None)
    stop = next((t.start for t in tokens if at and t.start > at.start and t.upper in ("GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT")), len(sql))
    return sql[at.end : stop].strip() if at else None


def _conjuncts(where: str) -> list[str]:
    """The parts of a condition between top-level ANDs (those of BETWEEN stay)."""
    tokens, out, start, depth, between = P.lex(where), [], 0, 0, False
    for t in tokens:
        depth += (t.value == "(") - (t.value == ")")
        between = between or t.upper == "BETWEEN"
        if t.upper == "AND" and depth == 0:
            if between:
                between = False
            else:
                out.append(where[start : t.start])
                start = t.end
    return [*out, where[start:]]


def _column_text(tokens, i: int, side: int) -> str:
    a, b = i + side, i + 2 * side
    if 0 <= b < len(tokens) and tokens[b].value == ".":
        c = i + 3 * side
        first, last = (c, a) if side < 0 else (a, c)
        return f"{tokens[first].value}.{tokens[last].value}"
    return tokens[a].value
