import sqlite3

import pytest

from tessera import errors
from tessera.engine import Engine
from tessera.sources import pagefile


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "sample.db")
    db = sqlite3.connect(path)
    db.executescript("""
        create table apples(id integer primary key, Name text, price real, raw blob);
        insert into apples values (1, 'Fuji', 1.5, x'00ff'), (2, 'Gala', null, null), (-3, 'Granny Smith', -2.25, x''), (900001, 'Far', 9, null);
        create index by_name on apples(name);
        create table keyed(k text primary key, v integer) without rowid;
        insert into keyed values ('b', -1), ('a', 2);
        create table loose(a integer);
        insert into loose values ('text in an integer column');
        create table none(a integer);
    """)
    db.commit()
    db.close()
    return path


def test_scan_and_types(spark, database):
    e = Engine.open(spark, database)
    rows = e.sql("select id, name, price, raw from apples").collect()
    assert [tuple(r) for r in rows] == [(-3, "Granny Smith", -2.25, bytearray()), (1, "Fuji", 1.5, bytearray(b"\x00\xff")), (2, "Gala", None, None), (900001, "Far", 9.0, None)]
    assert e.sql("select k, v from keyed where v < 0").collect()[0][:] == ("b", -1)
    assert e.sql("select * from none").count() == 0


def test_filters_are_pushed(spark, database):
    e = Engine.open(spark, database)
    frame = e.sql("select id from apples where name = 'Gala' and id > 1")
    assert [r.id for r in frame.collect()] == [2]
    assert e.sql("select a.id as x, b.id as y from apples as a join apples as b on a.name = b.name").count() == 4


def test_indexes_and_catalog(spark, database):
    e = Engine.open(spark, database)
    assert [r.name for r in e.sql("select * from by_name").collect()] == ["Far", "Fuji", "Gala", "Granny Smith"]
    assert e.catalog.page_size == 4096
    listed = {r.name: r.type for r in e.catalog.listing().collect()}
    assert listed["apples"] == "table" and listed["by_name"] == "index"
    assert [x.name for x in e.catalog.indexes("apples", ["name"])] == ["by_name"]


def test_values_of_another_type(spark, database):
    e = Engine.open(spark, database)
    with pytest.raises(Exception, match="WrongValueType|which is not bigint"):
        e.sql("select a from loose").collect()
    assert pagefile.read(spark, database, "loose", mismatch="text").first().a == "text in an integer column"
    with pytest.raises(errors.WrongPageType):
        pagefile.schema_of(database, "missing")


@pytest.fixture
def odd_file(tmp_path):
    path = str(tmp_path / "odd.db")
    db = sqlite3.connect(path)
    db.executescript("""
        create table folded(id integer primary key, name text collate nocase);
        insert into folded values (1, 'gala'), (500000000000, 'Gala');
        create table shadow(rowid text, v integer);
        insert into shadow values ('x', 1), ('y', 2);
        create table dated(d date, paid boolean, price decimal(8, 2), noted datetime);
        insert into dated values ('2024-01-01', 1, 2.5, null), ('2023-05-05', 0, 3, 17);
        create table counted(n integer primary key autoincrement, k text unique);
        insert into counted values (7, 'a');
    """)
    db.commit()
    db.close()
    return path


def test_text_compares_by_bytes_whatever_the_collation(spark, odd_file):
    e = Engine.open(spark, odd_file)
    assert [r.name for r in e.sql("select name from folded where name = 'gala'").collect()] == ["gala"]
    assert [r.name for r in e.sql("select name from folded where name < 'a'").collect()] == ["Gala"]


def test_partitions_follow_the_rows_not_their_ids(spark, odd_file, monkeypatch):
    schema = pagefile.schema_of(odd_file, "folded")
    assert len(pagefile.Reader(odd_file, "folded", schema, False).partitions()) == 1
    monkeypatch.setattr(pagefile, "ROWS", 1)
    reader = pagefile.Reader(odd_file, "folded", schema, False)
    assert [row[0] for p in reader.partitions() for row in reader.read(p)] == [1, 500000000000] and len(reader.partitions()) == 2
    empty = pagefile.Reader(odd_file, "folded", schema, False)
    empty.conditions = [("id", "<", 0)]
    assert [row for p in empty.partitions() for row in empty.read(p)] == []


def test_a_column_called_rowid(spark, odd_file):
    assert sorted(map(tuple, Engine.open(spark, odd_file).sql("select rowid, v from shadow where rowid = 'y'").collect())) == [("y", 2)]


def test_declared_types_without_a_storage_class(spark, odd_file):
    e = Engine.open(spark, odd_file)
    assert sorted(map(tuple, e.sql("select * from dated").collect())) == [("2023-05-05", 0.0, 3.0, 17.0), ("2024-01-01", 1.0, 2.5, None)]
    assert e.sql("select d from dated where d > '2023-12-31'").count() == 1 and e.sql("select d from dated where price > 2.6").count() == 1
    loose = pagefile.read(spark, odd_file, "dated", mismatch="text")
    assert loose.where("paid < 'x'").count() == 2


def test_objects_of_the_format_are_internal(spark, odd_file):
    from tessera.shell import Shell

    lines = []
    Shell(Engine.open(spark, odd_file), lines.append).run(".tables")
    assert lines == ["folded shadow dated counted"]
