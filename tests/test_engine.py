import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tabulark import catalogue
from tabulark.engine import Engine, EngineError
from tabulark.functions.chars import hash_key
from tabulark.operators import changes as C
from tabulark.operators import relational as R
from tabulark.plans import explain as X
from tabulark.plans.query import Query
from tabulark.plans.stats import Histogram

SF = "/root/testdata/sf0.01"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE employees (id INT, name CHAR(10), salary INT, active BOOLEAN)")
    e.execute("CREATE TABLE departments (id INT, dname CHAR(6))")
    e.execute("INSERT INTO employees VALUES (1, 'Alice', 75000, TRUE), (2, 'Bob', 52000, FALSE), (3, 'Cy', -7, TRUE)")
    e.execute("INSERT INTO departments VALUES (1, 'Sales')")
    return e


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    df = catalogue.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.select(*columns)) == sorted(map(tuple, cur.fetchall()), key=repr)


def test_select(engine):
    assert len(engine.execute("SELECT * FROM Employees").df.collect()) == 3
    assert [r.id for r in engine.execute("SELECT * FROM employees WHERE active = TRUE").df.sort("id").collect()] == [1, 3]
    assert [r.id for r in engine.execute("SELECT * FROM employees WHERE name = 'Alice'").df.collect()] == [1]
    assert [r.id for r in engine.execute("SELECT * FROM employees WHERE salary > -8 AND salary < 1").df.collect()] == [3]
    got = engine.execute("SELECT * FROM employees e JOIN departments d ON e.id = d.id WHERE e.salary > 50000").df
    assert got.columns == ["employees_id", "employees_name", "employees_salary", "employees_active", "departments_id", "departments_dname"]
    assert engine.count_message(engine.execute("SELECT * FROM employees e, departments d WHERE e.id = d.id")) == "1 row(s) returned."


def test_set_operations(engine):
    q = "SELECT id FROM employees {} SELECT id FROM departments"
    assert [rows(engine.execute(q.format(k)).df) for k in ("UNION", "INTERSECT", "EXCEPT")] == [[(1,), (2,), (3,)], [(1,)], [(2,), (3,)]]


def test_changes(engine):
    assert engine.execute("UPDATE employees SET salary = 60000, active = FALSE WHERE id = 3").message == "1 row(s) updated."
    assert engine.execute("UPDATE employees SET active = TRUE").message == "3 row(s) updated."
    assert engine.execute("DELETE FROM employees WHERE salary < 55000").message == "1 row(s) deleted."
    assert rows(engine.table("employees").select("id", "salary", "active")) == [(1, 75000, True), (3, 60000, True)]
    assert engine.execute("DELETE FROM employees").message == "2 row(s) deleted."
    assert engine.table("employees").count() == 0


def test_index(engine):
    assert engine.execute("CREATE INDEX by_salary ON employees (salary)").message == "Index 'by_salary' created on employees(salary)."
    engine.execute("INSERT INTO employees VALUES (4, 'Di', 75000, TRUE)")
    assert rows(engine.lookup("employees", "salary", 75000).select("id")) == [(1,), (4,)]
    assert engine.execute("DELETE FROM employees WHERE salary = 75000").message == "2 row(s) deleted."
    assert engine.lookup("employees", "salary", 75000).count() == 0
    assert engine.execute("UPDATE employees SET salary = 9 WHERE id = 2").message == "1 row(s) updated."
    assert rows(engine.lookup("employees", "salary", 9).select("id")) == [(2,)]
    engine.execute("DROP INDEX by_salary")
    with pytest.raises(EngineError):
        engine.execute("DROP INDEX by_salary")


def test_tables_survive(engine, spark):
    again = Engine(spark, engine.catalog.root)
    assert rows(again.table("departments")) == [(1, "Sales ")]
    engine.execute("DROP TABLE departments")
    with pytest.raises(EngineError):
        Engine(spark, engine.catalog.root).table("departments")


def test_char(engine):
    engine.execute("CREATE TABLE c (c CHAR(4))")
    engine.execute("INSERT INTO c VALUES ('Al'), ('Alex'), ('Alexander'), ('al'), ('')")
    assert rows(engine.table("c")) == [("    ",), ("Al  ",), ("Alex",), ("Alex",), ("al  ",)]
    assert engine.execute("SELECT * FROM c WHERE c = 'Alexander'").df.count() == 2
    engine.execute("CREATE TABLE d (c CHAR(6))")
    engine.execute("INSERT INTO d VALUES ('Al'), ('Alexan')")
    assert engine.execute("SELECT * FROM c x JOIN d y ON x.c = y.c").df.count() == 1


@pytest.mark.parametrize("sql", [
    "SELECT * FROM nothing_here", "INSERT INTO departments VALUES (1)", "INSERT INTO departments VALUES (99999999999, 'x')",
    "INSERT INTO departments VALUES (NULL, 'x')", "UPDATE departments SET nope = 1", "CREATE TABLE t (a FLOAT)",
    "CREATE TABLE departments (a INT)", "CREATE INDEX i ON departments (id, dname)", "SELECT * FROM employees, departments",
    "DROP TABLE nothing_here", "GRANT ALL", "SELECT * FROM employees WHERE zz.id = 1",
])
def test_errors(engine, sql):
    with pytest.raises((EngineError, AnalysisException)):
        engine.execute(sql)


def test_compat_bounds(spark, engine):
    old = Engine(spark, engine.catalog.root, compat=True)
    sql = "SELECT * FROM employees WHERE salary <= 52000"
    assert (engine.execute(sql).df.count(), old.execute(sql).df.count()) == (2, 1)


def test_unknown_is_no(spark):
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert rows(C.deleted(df, F.col("a") == 1)) == [(None,)]
    assert rows(C.updated(df, {"a": F.lit(5)}, F.col("a") == 1)) == [(5,), (None,)]


def test_except_kinds(spark):
    mk = lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    a, b = mk(1, 1, 2), mk(1, 3, 4, 5)
    assert (rows(R.subtract(a, b)), rows(R.subtract_counting(a, b)), rows(R.subtract_keeping(a, b))) == ([(2,)], [(1,), (2,)], [(2,)])
    assert R.intersect(a, mk()).columns == ["a"] and R.union(mk(), mk()).count() == 0
    with pytest.raises(ValueError):
        R.union(a, spark.createDataFrame([("x",)], "a string"))


def test_join_plans(spark):
    a, b = (spark.sql(f"select * from values {v} as t(k)") for v in ("(1), (1), (2)", "(1), (1), (1), (3)"))
    q = Query(a, "a").join(b, "b").on("k", "k")
    plans = {m: q.prefer(m).build() for m in ("bnl", "merge")}
    assert [p.count() for p in plans.values()] == [6, 6]
    text = {m: p._jdf.queryExecution().executedPlan().toString() for m, p in plans.items()}
    assert "BroadcastHashJoin" in text["bnl"] and "SortMergeJoin" in text["merge"]


def test_costs():
    assert X.block_nested_loop(640, 640) <= X.merge_join(640, 640) and X.block_nested_loop(641, 641) > X.merge_join(641, 641)
    assert next(n for n in range(1, 99) if X.index_select(n, 1.0, 39) < X.pages(n, 39)) == 36
    h = Histogram(1, 50, [10] * 10)
    assert h.width == 5 and h.point(60) == h.point(50) == 10 / 5 / 100 and h.between(1, 50) == 1.0 and h.between(9, 1) == 0.0


def test_explain(engine):
    got = engine.execute("SELECT DISTINCT * FROM employees e JOIN departments d ON e.id = d.id", explain=True).explain
    for part in ("=== Logical Plan ===", "[JOIN] e.id = d.id", "=== Query Optimizer Trace ===", "[JOIN] → BNLJoin", "[DISTINCT] → SortBasedDistinct", "=== Spark Plan ==="):
        assert part in got


@pytest.mark.parametrize("sql", [
    "SELECT * FROM (SELECT id, name FROM employees) q WHERE q.name = 'Alice'", "WITH q AS (SELECT id, name AS n FROM employees) SELECT * FROM q WHERE n = 'Alice'",
    "SELECT * FROM employees WHERE name IN ('Alice', 'x')", "SELECT * FROM employees WHERE name BETWEEN 'Alice' AND 'Alicf'", "SELECT * FROM employees WHERE \"Alice\" = name",
    "SELECT id FROM (SELECT 1 AS id, 'Alice' AS name FROM departments) WHERE name = 'Alice'",
])
def test_char_through_queries(engine, sql):
    assert [r.id for r in engine.execute(sql).df.collect()] == [1]


def test_char_comparison_is_pushed_down(engine):
    plan = engine.execute("SELECT * FROM employees WHERE name = 'Alice'").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(name,Alice     )" in plan


def test_select_reads_by_index(engine):
    for i in range(4, 9):
        engine.execute(f"INSERT INTO employees VALUES ({i}, 'N{i}', {i * 1000}, TRUE)")
    sql = "SELECT * FROM employees WHERE salary = 5000 AND active = TRUE"
    files = lambda r: len(r.df.inputFiles())
    assert files(engine.execute(sql)) == 6
    engine.execute("CREATE INDEX by_salary ON employees (salary)")
    engine.execute("CREATE INDEX by_name ON employees (name)")
    got = engine.execute(sql)
    assert files(got) == 1 and [r.id for r in got.df.collect()] == [5]
    assert files(engine.execute("SELECT * FROM employees e WHERE e.name = 'N7'")) == 1
    assert files(engine.execute("SELECT * FROM employees WHERE salary = 5000 OR id = 1")) == 6
    assert [r.employees_id for r in engine.execute("SELECT * FROM employees, departments WHERE employees.salary = 75000 AND employees.id = departments.id").df.collect()] == [1]
    assert engine.execute("SELECT * FROM employees WHERE salary = 123456").df.count() == 0


def test_index_upkeep_and_compaction(engine):
    engine.execute("CREATE INDEX by_salary ON employees (salary)")
    for i in range(4, 24):
        engine.execute(f"INSERT INTO employees VALUES ({i}, 'N', {i}, TRUE)")
    index = engine.catalog.index("by_salary")
    assert len(index.parts) <= 16 and all(engine.lookup("employees", "salary", i).count() == 1 for i in (4, 11, 23, 75000))
    before = rows(engine.table("employees"))
    assert engine.compact("employees") == 1 and len(index.parts) == 1
    engine.vacuum("employees")
    again = Engine(engine.spark, engine.catalog.root)
    assert rows(again.table("employees")) == before and again.lookup("employees", "salary", 11).count() == 1


def test_second_writer_is_refused(engine):
    other = Engine(engine.spark, engine.catalog.root)
    engine.execute("INSERT INTO departments VALUES (2, 'Tech')")
    with pytest.raises(EngineError):
        other.execute("INSERT INTO departments VALUES (3, 'Lost')")
    assert rows(other.table("departments")) == rows(engine.table("departments")) == [(1, "Sales "), (2, "Tech  ")]
    other.execute("INSERT INTO departments VALUES (3, 'Kept')")
    assert Engine(engine.spark, engine.catalog.root).table("departments").count() == 3


def test_messages_counters_and_places(engine):
    got = engine.execute("SELECT * FROM employees WHERE id > 1", counters=True)
    assert got.message == "2 row(s) returned." and "| id|" in engine.execute("SELECT id FROM employees").text().replace("|id ", "| id")
    assert got.counters == {"employees": 3, "output": 2}
    place = engine.row_ids("employees").where("id = 3").first()
    assert rows(engine.fetch("employees", place.row_file, place.row_number).select("id")) == [(3,)]
    engine.execute("DELETE FROM employees WHERE id = 3")
    assert engine.fetch("employees", place.row_file, place.row_number).count() == 0
    lines = engine.execute("EXPLAIN SELECT * FROM employees WHERE id = 1").df.collect()
    assert any("SelectLinear(employees)" in r.plan for r in lines)


def test_catalog_lists(engine):
    engine.execute("CREATE INDEX by_salary ON employees (salary)")
    engine.create_spatial_index("place", "employees", ["id", "salary"])
    assert engine.tables() == ["departments", "employees"] and engine.describe("departments") == [("id", "INT", 0), ("dname", "CHAR", 6)]
    assert engine.indexes() == [("by_salary", "employees", ("salary",), "LINEAR_HASH"), ("place", "employees", ("id", "salary"), "RTREE")]
    assert engine.catalog.find_spatial("employees").name == "place" and engine.catalog.find_index("employees", "id") is None
    for columns in (["id"], ["id", "ID"], ["id", "nope"]):
        with pytest.raises(EngineError):
            engine.create_spatial_index("bad", "employees", columns)
    engine.execute("INSERT INTO employees VALUES (9, 'Z', 1, TRUE)")
    with engine as e:
        e.execute("SELECT * FROM employees")
    assert not engine.spark.catalog.tableExists("employees")


def test_histogram_ends_at_the_highest_value():
    h = Histogram(0, 10, [3, 3, 3, 2])  # width 3: the last bucket is 9 to 10
    assert h.width == 3 and h.between(9, 10) == 2 / 11 and h.between(10, 10) == 1 / 11 and h.between(0, 10) == 1.0


def test_char_hash(spark):
    texts = ["", "a", "  Alice  ", "Grüße", "a longer text that leaves 32 bits"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for t, r in zip(texts, df.select(hash_key(F.col("c"), "CHAR").alias("h")).collect()):
        h = 0
        for c in t.strip():
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        assert r.h == h & 0x7FFFFFFF


def test_presorted_join_has_no_exchange(spark):
    plan = catalogue.queries()["join_presorted"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2, plan


def test_explain_trace_lines(spark):
    got = [r.step for r in catalogue.queries()["explain_trace"](spark, SF).orderBy("line").collect()]
    tree = ["[DISTINCT] all columns", "  [JOIN] n.region = r.id", "    [SCAN] nations", "    [FILTER] name = ASIA", "      [SCAN] regions"]
    assert got[: len(tree) + 4] == ["=== Logical Plan ===", *tree, "=== Physical Plan ===", "SortBasedDistinct", "=== Query Optimizer Trace ==="]
    costs = [(X.pages(25, 33), None), (X.pages(5, 29), None), (X.block_nested_loop(25, 5), X.merge_join(25, 5)), (X.sort_distinct(25), X.hash_distinct(25))]
    for step, (cost, other) in zip(got[len(tree) + 4 :], costs, strict=True):
        assert f"(cost={cost:.1f}) over" in step and (other is None or f"(cost={other:.1f}) —" in step)
