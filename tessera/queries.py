"""Queries over the driver's tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine

Query = Callable[[SparkSession, str], DataFrame]

#: Statements that DuckDB understands as they are.
SAME = {
    "scan_star": "select * from nation",
    "project": "select c_custkey, c_name from customer",
    "project_alias": "select c_custkey as id, c_name as name from customer",
    "project_qualified": "select customer.c_name from customer",
    "table_alias": "select c.c_name from customer as c",
    "filter_eq_text": "select * from customer where c_mktsegment = 'BUILDING'",
    "filter_eq_int": "select * from orders where o_orderkey = 42",
    "filter_ne": "select o_orderkey from orders where o_orderstatus <> 'F'",
    "filter_lt": "select p_partkey from part where p_size < 10",
    "filter_le": "select p_partkey from part where p_size <= 10",
    "filter_gt": "select p_partkey from part where p_size > 10",
    "filter_ge": "select p_partkey from part where p_size >= 10",
    "filter_and_or": "select o_orderkey from orders where o_orderkey > 1 and o_orderkey < 10 or o_orderstatus = 'P'",
    "filter_parentheses": "select o_orderkey from orders where o_orderkey > 1 and (o_orderkey < 10 or o_orderstatus = 'P')",
    "filter_col_col": "select l_orderkey, l_suppkey, l_linenumber from lineitem where l_suppkey = l_linenumber",
    "filter_lit_left": "select o_orderkey from orders where 10 > o_orderkey",
    "filter_int_vs_double": "select c_custkey from customer where c_acctbal > 5000",
    "filter_decimal": "select c_custkey from customer where c_acctbal <= -12.5",
    "filter_full_text": "select o_orderkey from orders where o_orderpriority = '5-LOW'",
    "join_equi": "select o.o_orderkey, c.c_name from orders as o join customer as c on o.o_custkey = c.c_custkey",
    "join_theta": "select a.n_nationkey as a_key, b.n_nationkey as b_key from nation as a join nation as b on a.n_nationkey < b.n_nationkey",
    "join_theta_le": "select a.n_nationkey as a_key, b.n_nationkey as b_key from nation as a join nation as b on a.n_regionkey <= b.n_nationkey",
    "join_theta_gt": "select a.n_nationkey as a_key, b.n_nationkey as b_key from nation as a join nation as b on a.n_nationkey > b.n_nationkey",
    "join_theta_ge": "select a.n_nationkey as a_key, b.n_nationkey as b_key from nation as a join nation as b on a.n_nationkey >= b.n_nationkey",
    "join_theta_ne": "select a.r_regionkey as a_key, b.r_regionkey as b_key from region as a join region as b on a.r_regionkey <> b.r_regionkey",
    "join_self": "select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier as a join supplier as b on a.s_nationkey = b.s_nationkey",
    "join_where": "select c.c_name, n.n_name from customer as c join nation as n on c.c_nationkey = n.n_nationkey where n.n_regionkey = 2 and c.c_mktsegment = 'BUILDING'",
    "join_on_literal": "select n_name, r_name from nation join region on r_regionkey = 1",
    "join_one_side": "select n_name, r_name from nation join region on n_nationkey = n_regionkey",
    "limit": "select * from nation limit 3",
    "limit_zero": "select * from nation limit 0",
    "limit_beyond": "select * from region limit 100",
    "limit_offset": "select * from nation limit 4 offset 2",
    "limit_scan_order": "select l_orderkey, l_partkey from lineitem limit 50",
    "subquery": "select q.c_name from (select c_custkey, c_name from customer where c_custkey < 20) as q where q.c_custkey > 5",
    "subquery_join": "select a.n_name, b.r_name from (select n_name, n_regionkey from nation) as a join (select r_regionkey, r_name from region) as b on a.n_regionkey = b.r_regionkey",
    "group_count": "select o_orderstatus, count(*) as n from orders group by o_orderstatus",
    "group_two_keys": "select l_returnflag, l_linestatus, count(*) as n, min(l_shipdate) as first, max(l_shipdate) as last from lineitem group by l_returnflag, l_linestatus",
    "group_keys_only": "select o_orderstatus from orders group by o_orderstatus",
    "group_all_rows": "select count(*) as n, max(o_orderkey) as last from orders",
    "group_of_join": "select n.n_name, count(c.c_custkey) as n from customer as c join nation as n on c.c_nationkey = n.n_nationkey group by n.n_name",
    "group_of_subquery": "select q.c_mktsegment, count(*) as n from (select c_mktsegment from customer where c_acctbal > 0) as q group by q.c_mktsegment",
    "index_only_eq": "select o_custkey from orders where o_custkey = 7",
}
#: Statements whose DuckDB form differs.
OTHER = {
    "join_cross": ("select n_name, r_name from nation join region", "select n_name, r_name from nation cross join region"),
    "base_name_beside_alias": ("select nation.n_name from nation as a where a.n_regionkey = 1", "select n_name from nation where n_regionkey = 1"),
    "star_of_join": (
        "select * from nation join region on n_regionkey = r_regionkey",
        "select n_nationkey, n_name, n_regionkey, r_regionkey, r_name from nation join region on n_regionkey = r_regionkey",
    ),
    "star_of_self_join": (
        "select * from region as a join region as b on a.r_regionkey = b.r_regionkey",
        'select a.r_regionkey as "a.r_regionkey", a.r_name as "a.r_name", b.r_regionkey as "b.r_regionkey", b.r_name as "b.r_name" from region a join region b using (r_regionkey)',
    ),
    "group_aggs": (
        "select c_mktsegment, min(c_custkey) as mn, max(c_custkey) as mx, sum(c_custkey) as s, avg(c_custkey) as a, count(c_name) as n from customer group by c_mktsegment",
        "select c_mktsegment, min(c_custkey) as mn, max(c_custkey) as mx, cast(sum(c_custkey) as bigint) as s, avg(c_custkey) as a, count(c_name) as n from customer group by c_mktsegment",
    ),
    "filter_text_vs_int": ("select c_custkey from customer where c_name > 5", "select c_custkey from customer where c_name is not null"),
    "filter_text_eq_int": ("select c_custkey from customer where c_name = 5", "select c_custkey from customer where false"),
    "filter_int_lt_text": ("select c_custkey from customer where c_custkey < 'a'", "select c_custkey from customer where c_custkey is not null"),
}


def _statement(text: str) -> Query:
    return lambda spark, sf_dir: Engine.open(spark, sf_dir).sql(text)


def _with_nulls(spark: SparkSession, sf_dir: str, table: str, column: str, null: int, name: str) -> Engine:
    """The engine with a further table: the column as k, NULL in place of one value."""
    engine = Engine.open(spark, sf_dir)
    frame = engine.catalog.frame(table)
    engine.register(name, frame.withColumn("k", F.nullif(F.col(column), F.lit(null))))
    return engine


def null_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir, "customer", "c_nationkey", 3, "t").sql("select c_custkey from t where k < 5")


def null_ne(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_nulls(spark, sf_dir, "customer", "c_nationkey", 3, "t").sql("select c_custkey from t where k <> 5")


def null_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _with_nulls(spark, sf_dir, "supplier", "s_nationkey", 3, "t")
    return engine.sql("select a.s_suppkey as a_key, b.s_suppkey as b_key from t as a join t as b on a.k = b.k")


def index_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.open(spark, sf_dir)
    engine.sql("create index by_customer on orders(o_custkey)")
    return engine.sql("select * from by_customer")


def index_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A select over the table that the planner serves from the stored index."""
    engine = Engine.open(spark, sf_dir)
    engine.sql("create index by_customer on orders(o_custkey, o_orderstatus)")
    return engine.sql("select o_orderstatus from orders where o_custkey = 7")


def index_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.open(spark, sf_dir)
    engine.sql("create index by_customer on orders(o_custkey, o_orderstatus)")
    return engine.sql("select * from by_customer where o_custkey = 7")


def create_and_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine.open(spark, sf_dir)
    engine.sql("create table pairs(a integer primary key, b integer)")
    engine.insert("pairs", [(j, 10 * j) for j in range(99)])
    return engine.sql("select a, b from pairs")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.open(spark, sf_dir).catalog.listing()


JOINED = "select o.o_orderkey, c.c_name from orders as o join customer as c on o.o_custkey = c.c_custkey"


EXPLAINED = (JOINED, "select count(*) as n from orders where o_custkey = 7")
OUTLINE = (
    "Project o.o_orderkey, c.c_name",
    "└─ Join on o.o_custkey = c.c_custkey",
    "   ├─ TableScan orders as o",
    "   └─ TableScan customer as c",
    "Project count(*) as n",
    "└─ Group",
    "   └─ Filter o_custkey = 7",
    "      └─ IndexScan by_customer of orders",
    "ways to read orders:",
    "  TableScan orders",
    "  IndexScan by_customer of orders (chosen)",
)
#: The listing of a folder of tables, from their columns.
CATALOG_SQL = """
select 'table' as type, table_name as name, table_name as tbl_name, row_number() over (order by table_name) as rootpage, 'create table ' || table_name || '(' || columns || ')' as sql
from (select table_name, string_agg(column_name || ' ' || case when data_type in ('BIGINT', 'INTEGER', 'SMALLINT') then 'integer' when data_type in ('DOUBLE', 'FLOAT') or data_type like 'DECIMAL%' then 'real'
               when data_type = 'VARCHAR' then 'text' when data_type = 'TIMESTAMP' then 'timestamp_ntz' when data_type = 'FLOAT[]' then 'array<float>' else lower(data_type) end, ', ' order by ordinal_position) as columns
      from information_schema.columns
      where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')
      group by table_name)"""


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of two plans, as explain prints it before Spark's own plan."""
    engine = Engine.open(spark, sf_dir)
    engine.sql("create index by_customer on orders(o_custkey)")
    lines = []
    for text in EXPLAINED:
        with contextlib.redirect_stdout(io.StringIO()) as out:
            engine.sql(f"explain {text}")
        lines += out.getvalue().split("\n\n", 1)[0].splitlines()
    return spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n long, line string")


def info(spark: SparkSession, sf_dir: str) -> DataFrame:
    with contextlib.redirect_stdout(io.StringIO()):
        return Engine.open(spark, sf_dir).sql(f"info {JOINED}")


def test_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    with contextlib.redirect_stdout(io.StringIO()):
        found = Engine.open(spark, sf_dir).sql("test select c.c_custkey, n.n_name from customer as c join nation as n on c.c_nationkey = n.n_nationkey")
    return found.select("strategy", "n_rows", "agrees")


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(Engine.open(spark, sf_dir).catalog.frame("lineitem").count(),)], "n long")


QUERIES: dict[str, Query] = {
    **{k: _statement(v) for k, v in SAME.items()},
    **{k: _statement(v[0]) for k, v in OTHER.items()},
    "null_lt": null_lt,
    "null_ne": null_ne,
    "null_join": null_join,
    "index_table": index_table,
    "index_seek": index_seek,
    "index_served": index_served,
    "create_and_insert": create_and_insert,
    "catalog_tables": catalog_tables,
    "explain": explain,
    "info": info,
    "test_strategies": test_strategies,
    "row_count": row_count,
}

ORACLE_SQL: dict[str, str] = {
    **SAME,
    **{k: v[1] for k, v in OTHER.items()},
    "null_lt": "select c_custkey from customer where nullif(c_nationkey, 3) < 5 or nullif(c_nationkey, 3) is null",
    "null_ne": "select c_custkey from customer where nullif(c_nationkey, 3) is distinct from 5",
    "null_join": "select a.s_suppkey as a_key, b.s_suppkey as b_key from supplier a join supplier b on nullif(a.s_nationkey, 3) is not distinct from nullif(b.s_nationkey, 3)",
    "index_table": 'select o_custkey, row_number() over () as "index" from orders',
    "index_seek": 'select * from (select o_custkey, o_orderstatus, row_number() over () as "index" from orders) where o_custkey = 7',
    "index_served": "select o_orderstatus from orders where o_custkey = 7",
    "catalog_tables": CATALOG_SQL,
    "explain": "select * from (values " + ", ".join(f"({i}, '{line}')" for i, line in enumerate(OUTLINE)) + ") v(n, line)",
    "create_and_insert": "select range as a, 10 * range as b from range(99)",
    "info": JOINED,
    "test_strategies": "select s as strategy, (select count(*) from customer join nation on c_nationkey = n_nationkey) as n_rows, true as agrees from (values ('BROADCAST'), ('MERGE'), ('SHUFFLE_HASH'), ('SHUFFLE_REPLICATE_NL')) v(s)",
    "row_count": "select count(*) as n from lineitem",
}
