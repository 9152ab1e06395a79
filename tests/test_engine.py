from pathlib import Path

import pytest

from tessera import errors
from tessera.engine import Engine
from tessera.plans import nodes as n
from tessera.plans.parser import parse

VALUES = [None, 0, 1, 2]


def truth(op, a, b):
    """The reference order: NULL first, NULL equal to NULL."""
    key = lambda v: (0, 0) if v is None else (2, v) if isinstance(v, str) else (1, v)
    x, y = key(a), key(b)
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    e.register("apples", spark.createDataFrame([(1, "Fuji", "Red"), (2, "Gala", "Red"), (3, "Granny Smith", "Green"), (4, "Honeycrisp", None)], "id long, name string, color string"))
    e.register("oranges", spark.createDataFrame([(i, f"o{i}") for i in range(1, 7)], "id long, name string"))
    e.register("nulls", spark.createDataFrame([(a, b) for a in VALUES for b in VALUES], "a int, b int"))
    e.register("classes", spark.createDataFrame([(t, k) for t in (None, "a") for k in (None, 1)], "t string, n int"))
    e.register("empty", spark.createDataFrame([], "id long"))
    return e


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_comparisons_are_two_valued(engine, op):
    got = sorted(map(str, engine.sql(f"select a, b from nulls where a {op} b").collect()))
    assert got == sorted(f"Row(a={a}, b={b})" for a in VALUES for b in VALUES if truth(op, a, b))
    got = sorted(str(r.a) for r in engine.sql(f"select a from nulls where a {op} 1").collect())
    assert got == sorted(str(a) for a in VALUES for _ in VALUES if truth(op, a, 1))
    got = sorted(str(r.a) for r in engine.sql(f"select a from nulls where 1 {op} a").collect())
    assert got == sorted(str(a) for a in VALUES for _ in VALUES if truth(op, 1, a))


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_classes_are_ordered_and_never_equal(engine, op):
    rows = [(t, k) for t in (None, "a") for k in (None, 1)]
    show = lambda found: sorted(map(str, found))
    assert show(map(tuple, engine.sql(f"select t, n from classes where t {op} n").collect())) == show(r for r in rows if truth(op, r[0], r[1]))
    assert show(map(tuple, engine.sql(f"select t, n from classes where n {op} t").collect())) == show(r for r in rows if truth(op, r[1], r[0]))
    assert show(map(tuple, engine.sql(f"select t, n from classes where n {op} 'z'").collect())) == show(r for r in rows if truth(op, r[1], "z"))


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
def test_joins_compare_the_same_way(engine, op):
    got = engine.sql(f"select x.a, y.b from nulls as x join nulls as y on x.a {op} y.b").count()
    assert got == 16 * sum(truth(op, a, b) for a in VALUES for b in VALUES)


def test_scan_filter_limit(engine):
    assert [r.id for r in engine.sql("select * from apples").collect()] == [1, 2, 3, 4]
    assert [r.id for r in engine.sql("select id from apples where id < 3").collect()] == [1, 2]
    assert engine.sql("select id from apples limit 2").count() == 2
    assert engine.sql("select id from apples limit 0").count() == 0
    assert engine.sql("select id from empty").count() == 0
    assert engine.sql("select a.id as x, e.id as y from apples as a join empty as e on a.id = e.id").count() == 0


def test_alias_hides_the_name(engine):
    q = "select q.id from (select id as key from apples) as q"
    with pytest.raises(errors.ColumnNotFound):
        engine.sql(q)
    assert engine.sql("select q.key from (select id as key from apples) as q").columns == ["key"]


def test_base_name_beside_alias(engine):
    assert engine.sql("select apples.id, a.name from apples as a").columns == ["id", "name"]


def test_cross_and_self_join(engine):
    assert engine.sql("select * from apples join oranges").count() == 24
    assert engine.sql("select * from apples join oranges").columns == ["apples.id", "apples.name", "color", "oranges.id", "oranges.name"]
    assert engine.sql("select a.id as x, b.id as y from apples as a join apples as b on a.name = b.name").count() == 4


def test_three_way_join(engine):
    assert engine.sql("select a.id as x from apples as a join oranges as b on a.id = b.id join apples as c on b.id = c.id").count() == 4


@pytest.mark.parametrize(
    "text, error, start",
    [
        ("select * from pears", errors.TableNotFound, 14),
        ("select apple from apples", errors.ColumnNotFound, 7),
        ("select b.id from apples as a", errors.ColumnNotFound, 7),
        ("select id, id from apples", errors.DuplicateColumn, 11),
        ("select *, id from apples", errors.DuplicateColumn, 10),
        ("select id from apples join oranges", errors.DuplicateColumn, 7),
        ("select * from apples as a join apples as b on id = 1", errors.DuplicateColumn, 46),
        ("select median(id) from apples", errors.WrongCommand, 7),
        ("select id, count(*) from apples group by name", errors.WrongCommand, 7),
        ("select * from apples group by name", errors.WrongCommand, 7),
    ],
)
def test_errors_while_planning(engine, text, error, start):
    with pytest.raises(error) as e:
        engine.sql(text)
    assert e.value.span.start == start
    assert e.value.report(text).count("\n") == 2


def test_groups(engine):
    got = {r.color: (r.n, r["max(id)"]) for r in engine.sql("select color, count(*) as n, max(id) from apples group by color").collect()}
    assert got == {"Red": (2, 2), "Green": (1, 3), None: (1, 4)}
    assert engine.sql("select count(color) as n, sum(id) as s, avg(id) as a from apples").first()[:] == (3, 10, 2.5)
    assert engine.sql("select count(*) as n from empty").first().n == 0


def test_create_insert_and_index(engine):
    for count in (1, 7, 60):
        engine.sql("create table pairs(a integer, b integer)")
        assert engine.sql("select * from pairs").count() == 0
        engine.insert("pairs", [(j, 10 * j) for j in range(count)])
        assert [tuple(r) for r in engine.sql("select * from pairs").collect()] == [(j, 10 * j) for j in range(count)]
    engine.sql("create index by_b on pairs(b)")
    assert engine.sql("select * from by_b").columns == ["b", "index"]
    assert [r.b for r in engine.sql("select b from by_b limit 3").collect()] == [0, 10, 20]
    assert [e.name for e in engine.catalog.indexes("pairs", ["b"])] == ["by_b"]
    with pytest.raises(errors.WrongValueType):
        engine.insert("pairs", [("x", 1)])
    with pytest.raises(errors.ColumnNotFound):
        engine.sql("create index bad on pairs(c)")


def test_strategies_agree_and_explain(engine, capsys):
    found = engine.sql("test select a.id as x, b.id as y from apples as a join oranges as b on a.id = b.id").collect()
    assert len(found) == 4 and all(r.agrees and r.n_rows == 4 for r in found)
    assert engine.sql("info select id from apples where id > 2").count() == 2
    out = capsys.readouterr().out
    assert "# rows: 2" in out and "└─ Filter id > 2" in out and "== Physical Plan ==" in out
    assert engine.sql("explain select id from apples").columns == []


def test_filters_and_columns_reach_the_files(spark, data):
    e = Engine.open(spark, data)
    frame = e.plan(n.Select((n.Item(n.Column("c_name")),), n.Table("customer"), n.Compare("=", n.Column("c_custkey"), n.Literal(7))))[0]
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted")
    assert "EqualTo(c_custkey,7)" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_limit_follows_the_stored_order(spark, tmp_path):
    spark.range(1000).repartition(1).sortWithinPartitions("id").write.parquet(str(tmp_path / "t.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        e = Engine.open(spark, str(tmp_path))
        assert e.catalog.frame("t").rdd.getNumPartitions() > 1
        assert [r.id for r in e.sql("select id from t where id > 4 limit 3").collect()] == [5, 6, 7]
        assert [r.id for r in e.sql("select id from t limit 2 offset 5").collect()] == [5, 6]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_rowids_run_through_files(spark, tmp_path):
    spark.range(0, 50, 1, 1).write.parquet(str(tmp_path / "t.parquet"))
    spark.range(50, 90, 1, 1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    e = Engine.open(spark, str(tmp_path))
    ids = sorted(r["__rowid"] for r in e.catalog.with_rowid("t").collect())
    assert ids == list(range(1, 91))
    with pytest.raises(errors.FileNotFound):
        Engine.open(spark, str(tmp_path / "missing"))


def _table_of_files(spark, path, files, rows):
    """Files of so many rows, in order."""
    for f in range(files):
        spark.range(f * rows, (f + 1) * rows, 1, 1).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(f"{path}/f{f}")
        (found,) = Path(path, f"f{f}").glob("*.parquet")
        Path(path, "t.parquet").mkdir(exist_ok=True)
        found.rename(Path(path, "t.parquet", f"part-{f:03d}.parquet"))
    return Engine.open(spark, str(path))


def _files_read(frame):
    return set(frame.inputFiles())


def test_a_limit_reads_the_first_files_only(spark, tmp_path):
    e = _table_of_files(spark, tmp_path, 9, 10)
    frame = e.sql("select id from t limit 3")
    assert [r.id for r in frame.collect()] == [0, 1, 2] and len(_files_read(frame)) == 1
    frame = e.sql("select id from t where id > 12 limit 3 offset 1")
    assert [r.id for r in frame.collect()] == [14, 15, 16] and len(_files_read(frame)) == 2
    assert [r.id for r in e.sql("select id from t where id > 87 limit 5").collect()] == [88, 89]
    assert len(_files_read(e.sql("select id from t limit 35"))) == 4


def test_an_index_serves_what_it_covers(spark, tmp_path):
    e = _table_of_files(spark, tmp_path, 4, 50)
    e.sql("create index by_k on t(k, id)")
    e.sql("create index by_s on t(s)")
    frame = e.sql("select a.id from t as a where a.k = 3 and t.id < 30")
    assert sorted(r.id for r in frame.collect()) == [3, 10, 17, 24]
    assert all("tessera-index" in f for f in _files_read(frame)) and "EqualTo(k,3)" in frame._jdf.queryExecution().executedPlan().toString()
    outline = e.outline(parse("select id from t where k = 3"))
    assert "IndexScan by_k of t (chosen)" in outline and "  TableScan t\n" in outline and "by_s" not in outline
    for text in ("select id from t where id = 3", "select * from t where k = 3", "select id from t where k = 3 limit 2", "select id from t where k = 3 or id = 4", "select id from t where k <> 3"):
        assert not any("tessera-index" in f for f in _files_read(e.sql(text)))
    assert [tuple(r) for r in e.sql("select k, id from by_k limit 2").collect()] == [(0, 0), (0, 7)]


def test_large_numbers_and_long_chains(spark, engine):
    assert engine.sql("select id from apples where id < 99999999999999999999").count() == engine.sql("select id from apples").count()
    with pytest.raises(errors.ParserError) as e:
        engine.sql("select id from apples where id < 1" + "0" * 40)
    assert e.value.span.start == 33
    many = " or ".join(f"id = {i}" for i in range(1200))
    assert engine.sql(f"select id from apples where {many}").count() == engine.sql("select id from apples where id >= 0 and id < 1200").count()
    with pytest.raises(errors.ParserError, match="deep"):
        engine.sql("select id from apples where " + "(" * 5000 + "id = 1" + ")" * 5000)


def test_text_that_is_no_time(spark):
    e = Engine(spark)
    e.register("seen", spark.sql("select timestamp'2024-01-02 03:04:05' as at, date'2024-01-02' as day, true as good"))
    assert e.sql("select at from seen where at < '2024-01-03' and day = '2024-01-02' and good = 'true'").count() == 1
    for text in ("at = 'soon'", "day < 'tomorrow'", "'maybe' = good"):
        with pytest.raises(errors.WrongValueType) as found:
            e.sql(f"select at from seen where {text}")
        assert found.value.span.start == 26
