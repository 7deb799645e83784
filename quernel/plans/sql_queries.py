"""Registered queries of the SQL dialect and of the operators behind it, with their SQL for the oracle.

A query is a text of the dialect over the tables that it names. ``casts`` bring a result to a type that the oracle can
give too (the dialect's SUM and AVG are decimals).
"""

from __future__ import annotations

import datetime
import io
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.cli import Repl
from quernel.engine import Engine
from quernel.errors import QuernelError
from quernel.operators import relational as ops
from quernel.plans.scratch import new_path
from quernel.sources.parquet import read_parquet
from quernel.sql import parse_select

#: Money and quantities of the test tables have two places.
DOUBLE_SCALE = 2


def engine_over(spark: SparkSession, sf_dir: str, sql: str, use_indexes: bool = True) -> Engine:
    """An engine with the tables that ``sql`` names."""
    engine, s = Engine(spark, use_indexes), parse_select(sql)
    for name in dict.fromkeys(t.name for t in (s.table, *(j.table for j in s.joins))):
        engine.catalog.add_parquet(f"{sf_dir}/{name}.parquet", name, DOUBLE_SCALE)
    return engine


def _over(sql: str, casts: dict[str, str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine_over(spark, sf_dir, sql).query(sql)
        return df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in casts.items()}) if casts else df

    return query


#: Texts that mean the same in the dialect and in the oracle.
_SAME = {
    "scan_project": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "select_star": "SELECT * FROM nation",
    "project_alias": "SELECT n_nationkey AS k, n_name AS name, n_nationkey AS k2 FROM nation",
    "filter_eq_text": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'",
    "filter_neq_nulls": "SELECT sale_id, delivered_qty FROM fmcg_sales WHERE delivered_qty <> 12 AND pack_type != 'Tin'",
    "filter_range": "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20",
    "filter_between": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 7",
    "filter_between_decimal": "SELECT sale_id, channel, price_unit FROM fmcg_sales WHERE price_unit BETWEEN 3.25 AND 4.1",
    "filter_between_negative": "SELECT COUNT(*) AS n FROM customer WHERE c_acctbal BETWEEN -500.5 AND 100.25",
    "filter_negative": "SELECT COUNT(*) AS n FROM fmcg_sales WHERE units_sold > -5 AND stock_available <> -1",
    "filter_in": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_in_columns": "SELECT sale_id FROM fmcg_sales WHERE units_sold IN (delivered_qty, 7, stock_available)",
    "filter_not_in": "SELECT COUNT(*) AS n FROM customer WHERE NOT c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_is_null": "SELECT sale_no, brand FROM sales WHERE region IS NULL OR units_sold IS NULL",
    "filter_is_not_null": "SELECT COUNT(*) AS n, MIN(sku) AS first_sku FROM skus WHERE listed_on IS NOT NULL AND segment IS NOT NULL",
    "filter_and_or_not": "SELECT p_partkey FROM part WHERE (p_size < 10 OR p_type = 'PROMO') AND NOT p_brand = 'Brand#13'",
    "filter_three_valued": "SELECT COUNT(*) AS n FROM fmcg_sales WHERE NOT (units_sold > 10 AND promotion_flag = 1) OR price_unit >= 9.0",
    "filter_col_vs_col": "SELECT COUNT(*) AS n FROM fmcg_sales WHERE units_sold < delivered_qty",
    "filter_literal_left": "SELECT p_partkey FROM part WHERE 45 < p_size",
    "filter_date_text_literal": "SELECT COUNT(*) AS n FROM orders WHERE o_orderdate > '1996-06-01'",
    "filter_date_between": "SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate BETWEEN '1996-01-01' AND '1996-12-31'",
    "filter_date_column": "SELECT sale_no, date FROM sales WHERE date BETWEEN '2023-02-15' AND '2023-11-03' AND date != '2023-05-01'",
    "join_inner": "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "join_reversed_on": "SELECT s.s_suppkey, n.n_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey",
    "join_multi": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_self": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_name = 'NATION_3'",
    "join_same_names": "SELECT k.sku, k.category AS listed, b.category AS own FROM brands b JOIN skus k ON k.brand = b.brand WHERE k.pack_type IS NOT NULL",
    "join_pushdown": "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'P'",
    "join_unpushable_or": "SELECT COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P' OR c.c_mktsegment = 'BUILDING'",
    "join_large": "SELECT COUNT(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey",
    "agg_global": "SELECT COUNT(*) AS n, MIN(l_quantity) AS mn, MAX(l_quantity) AS mx FROM lineitem",
    "agg_global_empty": "SELECT COUNT(*) AS n, MAX(o_orderkey) AS mx FROM orders WHERE o_orderstatus = 'nowhere'",
    "agg_group_empty": "SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'nowhere' GROUP BY o_orderstatus",
    "agg_count_col": "SELECT l_returnflag, COUNT(l_shipdate) AS n FROM lineitem GROUP BY l_returnflag",
    "agg_count_nulls": "SELECT category, COUNT(*) AS n, COUNT(units_sold) AS c FROM fmcg_sales GROUP BY category",
    "agg_min_max_text_date": "SELECT o_orderstatus, MIN(o_orderpriority) AS mn, MAX(o_orderdate) AS mx FROM orders GROUP BY o_orderstatus",
    "agg_group_multi": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_no_agg": "SELECT o_orderpriority FROM orders GROUP BY o_orderpriority",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_having_hidden": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_orderkey) > 14900 AND COUNT(*) > 5",
    "agg_having_key": "SELECT event_type, COUNT(*) AS n FROM events GROUP BY event_type HAVING event_type != 'view'",
    "sort_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sort_hidden_column": "SELECT c_name FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10",
    "sort_alias_and_hidden": "SELECT c_mktsegment AS seg, c_name FROM customer ORDER BY seg ASC, c_custkey ASC LIMIT 10",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "group_sort_limit": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY p_brand LIMIT 7",
    "having_sort_limit": "SELECT channel, segment, MAX(price_unit) AS dearest FROM fmcg_sales GROUP BY channel, segment HAVING COUNT(price_unit) > 20 AND MIN(price_unit) < 5 ORDER BY dearest DESC, segment, channel LIMIT 6",
}

#: (text of the dialect, casts, text of the oracle).
_OWN: dict[str, tuple[str, dict[str, str] | None, str]] = {
    "agg_sum_int": ("SELECT l_returnflag, SUM(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", {"s": "bigint"}, "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_sum_decimal": ("SELECT l_returnflag, SUM(l_quantity) AS s FROM lineitem GROUP BY l_returnflag", None, "SELECT l_returnflag, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": ("SELECT o_orderstatus, AVG(o_custkey) AS a FROM orders GROUP BY o_orderstatus", {"a": "decimal(18,6)"}, "SELECT o_orderstatus, CAST(AVG(o_custkey) AS DECIMAL(18,6)) AS a FROM orders GROUP BY o_orderstatus"),
    "agg_by_brand": (
        "SELECT brand, COUNT(delivered_qty) AS n, SUM(delivered_qty) AS s, AVG(price_unit) AS a, MAX(date) AS latest FROM fmcg_sales GROUP BY brand",
        {"s": "bigint", "a": "decimal(18,6)"},
        "SELECT brand, COUNT(delivered_qty) AS n, CAST(SUM(delivered_qty) AS BIGINT) AS s, CAST(CAST(SUM(price_unit) AS DOUBLE) / COUNT(price_unit) AS DECIMAL(18,6)) AS a, MAX(date) AS latest FROM fmcg_sales GROUP BY brand",
    ),
    "agg_canonical_names": ("SELECT p_type, COUNT(*), MAX(p_size) FROM part GROUP BY p_type", None, 'SELECT p_type, COUNT(*) AS "COUNT(*)", MAX(p_size) AS "MAX(p_size)" FROM part GROUP BY p_type'),
    "agg_star": ("SELECT * FROM part GROUP BY p_type HAVING COUNT(*) > 10", None, 'SELECT p_type, COUNT(*) AS "COUNT(*)" FROM part GROUP BY p_type HAVING COUNT(*) > 10'),
    "limit_negative": ("SELECT o_orderkey FROM orders LIMIT -3", None, "SELECT o_orderkey FROM orders LIMIT 0"),
    "nulls_last_asc": ("SELECT region FROM sales GROUP BY region ORDER BY region LIMIT 3", None, "SELECT DISTINCT region FROM sales ORDER BY region ASC NULLS LAST LIMIT 3"),
    "nulls_last_desc": (
        "SELECT sale_no, units_sold, brand FROM sales WHERE promotion_flag = 0 GROUP BY sale_no, units_sold, brand ORDER BY units_sold DESC, brand DESC, sale_no LIMIT 40",
        None,
        "SELECT DISTINCT sale_no, units_sold, brand FROM sales WHERE promotion_flag = 0 ORDER BY units_sold DESC NULLS LAST, brand DESC NULLS LAST, sale_no ASC NULLS LAST LIMIT 40",
    ),
    "having_alias": ("SELECT o_custkey AS customer, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 11 AND customer > 100", None, "SELECT o_custkey AS customer, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 11 AND o_custkey > 100"),
    "having_alone": ("SELECT MAX(p_size) AS mx FROM part HAVING COUNT(*) > 5", None, "SELECT MAX(p_size) AS mx FROM part HAVING COUNT(*) > 5"),
    "trailing_semicolon": ("SELECT s_suppkey FROM supplier WHERE s_nationkey >= 20;", None, "SELECT s_suppkey FROM supplier WHERE s_nationkey >= 20"),
    "nulls_last_limit": (
        "SELECT sale_no, units_sold, brand FROM sales GROUP BY sale_no, units_sold, brand ORDER BY units_sold ASC, sale_no, brand LIMIT 50",
        None,
        "SELECT DISTINCT sale_no, units_sold, brand FROM sales ORDER BY units_sold ASC NULLS LAST, sale_no ASC NULLS LAST, brand ASC NULLS LAST LIMIT 50",
    ),
    "full_pipeline": (
        "SELECT o.o_orderpriority, COUNT(*) AS n, SUM(l.l_quantity) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY o.o_orderpriority HAVING COUNT(*) > 100 ORDER BY total DESC",
        None,
        "SELECT o.o_orderpriority, COUNT(*) AS n, CAST(SUM(CAST(l.l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' GROUP BY o.o_orderpriority HAVING COUNT(*) > 100 ORDER BY total DESC NULLS LAST",
    ),
    "category_totals": (
        "SELECT b.category, COUNT(*) AS n, SUM(s.units_sold) AS total FROM fmcg_sales s JOIN brands b ON s.brand = b.brand WHERE promotion_flag = 1 GROUP BY b.category HAVING COUNT(*) > 100 ORDER BY total DESC",
        {"total": "bigint"},
        "SELECT b.category, COUNT(*) AS n, CAST(SUM(s.units_sold) AS BIGINT) AS total FROM fmcg_sales s JOIN brands b ON s.brand = b.brand WHERE s.promotion_flag = 1 GROUP BY b.category HAVING COUNT(*) > 100",
    ),
}


def _typed_orders(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over t: orders with two BOOL columns, NULL where the status is P, and a TEXT with quotes and backslashes."""
    o, status = read_parquet(spark, f"{sf_dir}/orders.parquet"), F.col("o_orderstatus")
    engine = Engine(spark)
    engine.catalog.add_table(
        "t",
        o.select(
            "o_orderkey",
            F.when(status != "P", status == "F").alias("done"),
            (F.col("o_custkey") % 2 == 0).alias("even"),
            F.when(status == "F", "it's").when(status == "O", "a\\b").alias("label"),
        ),
    )
    return engine.query(sql)


_TYPED = "FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus = 'F' END AS done, o_custkey % 2 = 0 AS even, CASE o_orderstatus WHEN 'F' THEN 'it''s' WHEN 'O' THEN 'a\\b' END AS label FROM orders) t"
_TYPED_QUERIES = {
    "bool_bare": "SELECT o_orderkey {t} WHERE done AND NOT even",
    "bool_literals": "SELECT COUNT(*) AS n {t} WHERE done = FALSE OR even = TRUE",
    "bool_min_max": "SELECT label, MIN(even) AS mn, MAX(done) AS mx {t} GROUP BY label",
    "text_quote": "SELECT o_orderkey {t} WHERE label = 'it''s' AND even",
    "text_backslash": "SELECT COUNT(*) AS n {t} WHERE label IN ('a\\b', 'a\\\\b')",
}


def _over_typed(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _typed_orders(spark, sf_dir, sql.format(t="FROM t"))


#: Statements that the dialect rejects, with the error of each.
_REJECTED = {
    "SELECT brand FROM skus k JOIN brands b ON k.brand = b.brand": "AmbiguousColumn",
    "SELECT k.sku FROM skus k LEFT JOIN brands b ON k.brand = b.brand": "SqlParseError",
    "SELECT k.sku FROM skus k CROSS JOIN brands b": "SqlParseError",
    "SELECT k.sku FROM skus k JOIN brands b ON k.brand = b.launch_year": "TypeMismatch",
    "SELECT SUM(sku) FROM skus": "TypeMismatch",
    "SELECT AVG(listed_on) FROM skus": "TypeMismatch",
    "SELECT sku AS q, brand AS q FROM skus ORDER BY q": "AmbiguousColumn",
    "SELECT sku FROM skus WHERE listed_on = 20230101": "TypeMismatch",
    "SELECT sku FROM skus WHERE promotion_flag = TRUE": "TypeMismatch",
    "SELECT sku FROM skus WHERE promotion_flag = 1.": "SqlParseError",
    "SELECT sku FROM skus WHERE promotion_flag = 1e3": "SqlParseError",
    "SELECT sku FROM skus WHERE sku = \"x\"": "SqlParseError",
    "SELECT sku FROM skus WHERE COUNT(*) > 1": "BindError",
    "SELECT sku, COUNT(*) FROM skus": "BindError",
    "SELECT nothing FROM skus": "UnknownColumn",
    "SELECT sku FROM nowhere": "UnknownTable",
}


def rejected_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, rows = Engine(spark), []
    for name in ("skus", "brands"):
        engine.catalog.add_parquet(f"{sf_dir}/{name}.parquet", name)
    for sql in _REJECTED:
        try:
            engine.query(sql)
            rows.append((sql, "none"))
        except QuernelError as e:
            rows.append((sql, type(e).__name__))
    return spark.createDataFrame(rows, "statement string, error string")


def create_index_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of index created and used by statements alone."""
    sql = "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey = 21"
    engine = engine_over(spark, sf_dir, sql)
    engine.execute("CREATE INDEX ON orders(o_orderkey)")
    engine.execute("CREATE INDEX ON Orders(O_custkey) USING HASH")
    return engine.execute(sql)


def index_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, "SELECT * FROM nation")
    rows = [(e.table, e.column, e.kind, e.supports_range) for e in (engine.execute(f"CREATE INDEX ON nation({c}) USING {k}") for c, k in (("n_name", "HASH"), ("n_nationkey", "BTREE")))]
    rows += [("nation", c, "none", False) for c in ("n_regionkey",) if engine.catalog.try_get_index("nation", c) is None]
    return spark.createDataFrame(rows, "table_name string, column_name string, kind string, supports_range boolean")


def explain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXPLAIN of a statement over tables that are the same at every scale, a row per line."""
    engine = engine_over(spark, sf_dir, "SELECT n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
    text = engine.execute("EXPLAIN SELECT r.r_name, COUNT(*) AS n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey > 3 GROUP BY r.r_name ORDER BY n DESC LIMIT 2")
    return spark.createDataFrame(list(enumerate(text.splitlines(), 1)), "line long, text string")


#: What the published cost formulas give for 25 nations and 5 regions.
_EXPLAINED = (
    "Limit 2  (cost=71.9, est. rows=1)",
    "  Project (r_name, n)  (cost=71.9, est. rows=1)",
    "    Sort (n DESC)  (cost=71.9, est. rows=1)",
    "      HashAggregate (COUNT(*)) GROUP BY (r_name)  (cost=71.2, est. rows=1)",
    "        HashJoin  (cost=52.5, est. rows=12)",
    "          Filter  (cost=30.0, est. rows=12)",
    "            SeqScan on nation  (cost=25.0, est. rows=25)",
    "          SeqScan on region  (cost=5.0, est. rows=5)",
)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    stats = engine.catalog.add_parquet(f"{sf_dir}/skus.parquet").stats
    columns = ("sku", "brand", "category", "promotion_flag", "listed_on")
    return spark.createDataFrame([(c, stats.distinct_count(c), stats.row_count) for c in columns], "column_name string, n_distinct long, n_rows long")


def filter_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any Column may be a condition of the operator."""
    return ops.project(ops.filter_(read_parquet(spark, f"{sf_dir}/part.parquet"), (F.length("p_name") > 8) & F.col("p_brand").rlike("#[1-3]")), ["p_partkey", "p_brand"])


def programmatic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark)
    engine.catalog.add_rows("t", [("a", 1), ("b", None), (None, 3), ("a", 5)], "k string, v bigint")
    return engine.query("SELECT k, COUNT(*) AS n, MAX(v) AS mx FROM t GROUP BY k")


def printed_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompt prints for a few statements, a row per line, times left out."""
    out = io.StringIO()
    engine = Engine(spark)
    engine.catalog.add_rows("t", [("tea", 12, True, datetime.date(2024, 2, 29)), ("jam", None, None, None)], "k string, v bigint, ok boolean, d date")
    Repl(engine, out).run([".tables", ".schema T", "SELECT * FROM t ORDER BY k", "SELECT v FROM t LIMIT 0", "SELECT COUNT(*) FROM t", ".exit"], prompt=False)
    lines = [re.sub(r"[0-9]+ ms", "x ms", line) for line in out.getvalue().splitlines()]
    return spark.createDataFrame(list(enumerate(lines, 1)), "line long, text string")


_PRINTED = (
    "t", "k TEXT", "v INT", "ok BOOL", "d DATE",
    "k   | v    | ok   | d         ", "----+------+------+-----------", "jam | NULL | NULL | NULL      ", "tea | 12   | true | 2024-02-29", "(2 rows in x ms)", "",
    "v", "-", "(0 rows in x ms)", "",
    "COUNT(*)", "--------", "2       ", "(1 row in x ms)", "",
)


def csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands, with quotes, commas, blanks, NULLs, a DATE and a BOOL, through a CSV file and back by inferred types."""
    path = new_path(spark, "brands.csv")
    brands = read_parquet(spark, f"{sf_dir}/brands.parquet")
    chosen = brands.select(F.concat("brand", F.lit(', "x"')).alias("brand"), "manufacturer", "launch_year", "removed_on", (F.col("launch_year") > 2000).alias("recent"))
    chosen.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    engine = Engine(spark)
    engine.load_csv(path, "b")
    return engine.query("SELECT brand, manufacturer, launch_year, removed_on, recent FROM b WHERE launch_year > 0 OR removed_on IS NULL")


def _values(rows: tuple[str, ...]) -> str:
    """Numbered lines as SQL."""
    return "SELECT CAST(line AS BIGINT) AS line, text FROM (VALUES " + ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in enumerate(rows, 1)) + ") v(line, text)"


def null_handling(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_parquet(spark, f"{sf_dir}/orders.parquet")
    engine = Engine(spark)
    engine.catalog.add_table("t", orders.select(F.nullif("o_orderstatus", F.lit("P")).alias("k"), F.nullif("o_custkey", F.lit(1)).alias("v")))
    return engine.query("SELECT k, COUNT(*) AS n, COUNT(v) AS c, SUM(v) AS s FROM t GROUP BY k").withColumn("s", F.col("s").cast("bigint"))


def nested_loop_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (read_parquet(spark, f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation"))
    return ops.project(ops.nested_loop_join(s, n, "s_nationkey", "n_nationkey"), ["s_suppkey", "n_name"])


def hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, b = (read_parquet(spark, f"{sf_dir}/{t}.parquet") for t in ("fmcg_sales", "brands"))
    s, b = s.select("sale_id", "brand"), b.select(F.col("brand").alias("b"), "manufacturer")
    return ops.project(ops.hash_join(s, b, "brand", "b"), ["sale_id", "manufacturer"])


def _parallel(degree: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = read_parquet(spark, f"{sf_dir}/lineitem.parquet")
        aggregates = {"n": ("COUNT", None), "s": ("SUM", "l_quantity"), "a": ("AVG", "l_discount"), "mx": ("MAX", "l_shipdate")}
        df = ops.parallel_hash_aggregate(lines, ["l_returnflag", "l_linestatus"], aggregates, degree, F.col("l_quantity") > 10, DOUBLE_SCALE)
        return df.withColumn("a", F.col("a").cast("decimal(18,6)"))

    return query


_PARALLEL = """SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s,
  CAST(CAST(SUM(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(l_discount) AS DECIMAL(18,6)) AS a, MAX(l_shipdate) AS mx FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus"""


def _indexed(kind: str, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """Through SQL: the planner takes the index where it is cheaper."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_over(spark, sf_dir, sql)
        engine.catalog.create_index("orders", "o_custkey", kind)
        return engine.query(sql)

    return query


def index_range_btree(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = engine_over(spark, sf_dir, "SELECT * FROM orders")
    index = engine.catalog.create_index("orders", "o_custkey", "BTREE")
    return index.range(10, False, 50, True).select("o_orderkey", "o_custkey")


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and loaded with inferred types."""
    path = new_path(spark, "customer.csv")
    read_parquet(spark, f"{sf_dir}/customer.parquet").write.option("header", True).option("escape", '"').csv(path)
    engine = Engine(spark)
    engine.load_csv(path, "customer")
    df = engine.query("SELECT c_mktsegment, COUNT(*) AS n, SUM(c_acctbal) AS s, MIN(c_custkey) AS mn, MAX(c_name) AS mx FROM customer GROUP BY c_mktsegment")
    return df.withColumn("s", F.col("s").cast("decimal(28,2)"))


_EXACT = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 17"
_EXACT_RESIDUAL = "SELECT o_orderkey FROM orders WHERE o_custkey = 17 AND o_totalprice > 1000"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _over(sql) for name, sql in _SAME.items()},
    **{name: _over(sql, casts) for name, (sql, casts, _) in _OWN.items()},
    "null_handling": null_handling,
    "nested_loop_join": nested_loop_join,
    "hash_join": hash_join,
    **{f"parallel_aggregate_dop{d}": _parallel(d) for d in (1, 4, 17)},
    "index_exact_btree": _indexed("BTREE", _EXACT),
    "index_exact_hash": _indexed("HASH", _EXACT),
    "index_residual": _indexed("HASH", _EXACT_RESIDUAL),
    "index_range_btree": index_range_btree,
    "csv_roundtrip": csv_roundtrip,
    **{name: _over_typed(sql) for name, sql in _TYPED_QUERIES.items()},
    **{f.__name__: f for f in (rejected_statements, create_index_statement, index_registry, explain_lines, statistics, filter_any_column, programmatic_table, printed_result, csv_typed)},
}

SQL: dict[str, str] = {
    **_SAME,
    **{name: oracle for name, (_, _, oracle) in _OWN.items()},
    "null_handling": "SELECT k, COUNT(*) AS n, COUNT(v) AS c, CAST(SUM(v) AS BIGINT) AS s FROM (SELECT NULLIF(o_orderstatus, 'P') AS k, NULLIF(o_custkey, 1) AS v FROM orders) t GROUP BY k",
    "nested_loop_join": _SAME["join_inner"],
    "hash_join": "SELECT s.sale_id, b.manufacturer FROM fmcg_sales s JOIN brands b ON s.brand = b.brand",
    **{f"parallel_aggregate_dop{d}": _PARALLEL for d in (1, 4, 17)},
    "index_exact_btree": _EXACT,
    "index_exact_hash": _EXACT,
    "index_residual": _EXACT_RESIDUAL,
    "index_range_btree": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 10 AND o_custkey <= 50",
    "csv_roundtrip": "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS s, MIN(c_custkey) AS mn, MAX(c_name) AS mx FROM customer GROUP BY c_mktsegment",
    **{name: sql.format(t=_TYPED) for name, sql in _TYPED_QUERIES.items()},
    "rejected_statements": "SELECT * FROM (VALUES " + ", ".join(f"('{q.replace(chr(39), chr(39) * 2)}', '{e}')" for q, e in _REJECTED.items()) + ") v(statement, error)",
    "create_index_statement": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_custkey = 21",
    "index_registry": "SELECT * FROM (VALUES ('nation', 'n_name', 'HASH', FALSE), ('nation', 'n_nationkey', 'BTREE', TRUE), ('nation', 'n_regionkey', 'none', FALSE)) v(table_name, column_name, kind, supports_range)",
    "explain_lines": _values(_EXPLAINED),
    "statistics": " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) AS n_rows FROM skus" for c in ("sku", "brand", "category", "promotion_flag", "listed_on")),
    "filter_any_column": "SELECT p_partkey, p_brand FROM part WHERE length(p_name) > 8 AND regexp_matches(p_brand, '#[1-3]')",
    "programmatic_table": "SELECT k, CAST(n AS BIGINT) AS n, CAST(mx AS BIGINT) AS mx FROM (VALUES ('a', 2, 5), ('b', 1, NULL), (NULL, 1, 3)) v(k, n, mx)",
    "printed_result": _values(_PRINTED),
    "csv_typed": """SELECT brand || ', "x"' AS brand, nullif(manufacturer, '') AS manufacturer, launch_year, removed_on, launch_year > 2000 AS recent FROM brands WHERE launch_year > 0 OR removed_on IS NULL""",
}
