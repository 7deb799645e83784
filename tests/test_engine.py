"""Meaning of statements over small tables."""

import datetime
from decimal import Decimal

import pytest

from quernel.engine import Engine
from quernel.errors import AmbiguousColumn, BindError, SqlParseError, TypeMismatch, UnknownColumn, UnknownTable


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    d = datetime.date
    e.catalog.add_rows("sales", [("N", "x", 10, 1, True, d(2023, 1, 5), Decimal("1.50")), ("N", "y", None, 0, False, d(2023, 6, 1), None), ("S", "x", 5, 1, None, None, Decimal("2.25")), (None, "z", 7, None, True, d(2024, 2, 29), Decimal("-3.00"))],
        "region string, brand string, units bigint, promo bigint, active boolean, day date, price decimal(10,2)")
    e.catalog.add_rows("brands", [("x", "Tea", "1"), ("y", "Jam", "2"), (None, "Nuts", "3")], "brand string, category string, code string")
    e.catalog.add_rows("empty", [], "x bigint, t string")
    return e


def rows(engine, sql):
    return [tuple(r) for r in engine.query(sql).collect()]


def test_three_valued_logic(engine):
    assert rows(engine, "SELECT brand FROM sales WHERE units != 10") == [("x",), ("z",)]
    assert sorted(rows(engine, "SELECT brand FROM sales WHERE NOT units = 10 OR units IS NULL")) == [("x",), ("y",), ("z",)]
    assert rows(engine, "SELECT brand FROM sales WHERE units IN (5, 7) AND NOT region = 'N'") == [("x",)]
    assert rows(engine, "SELECT brand FROM sales WHERE active") == [("x",), ("z",)]
    assert rows(engine, "SELECT brand FROM sales WHERE NOT active") == [("y",)]
    assert rows(engine, "SELECT brand FROM sales WHERE units = units AND region = region AND promo = promo AND price = price") == [("x",), ("x",)]
    assert rows(engine, "SELECT brand FROM sales WHERE 1 = 2") == []


def test_text_moves_to_the_other_type(engine):
    assert len(rows(engine, "SELECT brand FROM sales WHERE day > '2023-05-01'")) == 2
    assert len(rows(engine, "SELECT brand FROM sales WHERE '06/01/2023' = day")) == 1
    assert len(rows(engine, "SELECT brand FROM sales WHERE day = '2023-06-01 10:00:00'")) == 1
    assert len(rows(engine, "SELECT brand FROM sales WHERE units = ' 10 ' OR price = '2.25' OR active = 'False'")) == 3
    assert len(rows(engine, "SELECT brand FROM sales WHERE units IN ('5', '7')")) == 2
    assert len(rows(engine, "SELECT code FROM brands WHERE code = 2")) == 1
    assert len(rows(engine, "SELECT brand FROM sales WHERE units = 10.0 AND price < 2")) == 1
    for bad in ("units = 'x'", "day > 'soon'", "day > '2023-02-30'", "active = 'yes'", "active = 1", "day = 1", "units BETWEEN 1 AND 'b'", "region", "1"):
        with pytest.raises(TypeMismatch):
            engine.query(f"SELECT brand FROM sales WHERE {bad}")


def test_joins(engine):
    got = rows(engine, "SELECT s.brand, b.brand, category FROM sales s JOIN brands b ON b.brand = s.brand")
    assert sorted(got) == [("x", "x", "Tea"), ("x", "x", "Tea"), ("y", "y", "Jam")]
    assert len(rows(engine, "SELECT a.units FROM sales a JOIN sales b ON a.region = b.region JOIN brands c ON c.brand = b.brand")) == 5
    assert engine.query("SELECT * FROM sales s JOIN brands b ON s.brand = b.brand").columns == ["region", "brand", "units", "promo", "active", "day", "price", "brand", "category", "code"]


def test_aggregates(engine):
    assert rows(engine, "SELECT COUNT(*), COUNT(units), SUM(units), MIN(region), MAX(day), MIN(active), AVG(units) FROM sales") == [(4, 3, Decimal(22), "N", datetime.date(2024, 2, 29), False, Decimal("7.333333333"))]
    assert engine.query("SELECT COUNT(*), sum(units) FROM sales").columns == ["COUNT(*)", "SUM(units)"]
    assert rows(engine, "SELECT COUNT(*), COUNT(x), SUM(x), AVG(x), MIN(t) FROM empty") == [(0, 0, None, None, None)]
    assert rows(engine, "SELECT t, COUNT(*) FROM empty GROUP BY t") == []
    assert sorted(rows(engine, "SELECT region, SUM(price) AS p, AVG(price) AS a FROM sales GROUP BY region"), key=str) == sorted([("N", Decimal("1.50"), Decimal("1.5")), ("S", Decimal("2.25"), Decimal("2.25")), (None, Decimal("-3.00"), Decimal("-3"))], key=str)
    assert rows(engine, "SELECT region FROM sales GROUP BY region HAVING COUNT(*) > 1 AND MAX(units) = 10") == [("N",)]
    assert rows(engine, "SELECT region, COUNT(*) AS n FROM sales GROUP BY region HAVING n > 1") == [("N", 2)]
    assert rows(engine, "SELECT * FROM sales GROUP BY region HAVING SUM(units) > 9") == [("N", Decimal(10))]
    assert engine.query("SELECT * FROM sales GROUP BY region HAVING SUM(units) > 9").columns == ["region", "SUM(units)"]
    assert rows(engine, "SELECT MAX(s.brand), MAX(b.brand) FROM sales s JOIN brands b ON s.brand = b.brand WHERE b.brand = 'x'") == [("x", "x")]
    assert len(rows(engine, "SELECT SUM(a.units), SUM(b.units) FROM sales a JOIN sales b ON a.brand = b.brand")[0]) == 2


def test_sum_of_int_does_not_overflow(spark):
    e = Engine(spark)
    e.catalog.add_rows("t", [(2**62,)] * 5, "x bigint")
    assert rows(e, "SELECT SUM(x), AVG(x) FROM t") == [(Decimal(5 * 2**62), Decimal(2**62))]


def test_order_and_limit(engine):
    assert rows(engine, "SELECT units FROM sales ORDER BY units") == [(5,), (7,), (10,), (None,)]
    assert rows(engine, "SELECT units FROM sales ORDER BY units DESC") == [(10,), (7,), (5,), (None,)]
    assert rows(engine, "SELECT brand AS units FROM sales ORDER BY units DESC, price LIMIT 2") == [("z",), ("y",)]
    assert rows(engine, "SELECT brand AS n FROM sales ORDER BY n, day DESC") == [("x",), ("x",), ("y",), ("z",)]
    assert rows(engine, "SELECT region, COUNT(*) AS n FROM sales GROUP BY region ORDER BY n DESC, region LIMIT 2") == [("N", 2), ("S", 1)]
    assert rows(engine, "SELECT brand FROM sales LIMIT 0") == rows(engine, "SELECT brand FROM sales LIMIT -5") == []
    assert len(rows(engine, "SELECT brand FROM sales LIMIT 9223372036854775807")) == 4


def test_names(engine):
    assert engine.query("SELECT BRAND, s.Units AS u, units FROM SALES s").columns == ["BRAND", "u", "units"]
    errors = {
        "SELECT a FROM nowhere": UnknownTable, "SELECT nothing FROM sales": UnknownColumn, "SELECT z.brand FROM sales s": UnknownColumn, "SELECT sales.brand FROM sales s": UnknownColumn,
        "SELECT brand FROM sales s JOIN brands b ON s.brand = b.brand": AmbiguousColumn, "SELECT a.x FROM empty a JOIN empty a ON a.x = a.x": BindError,
        "SELECT units FROM sales WHERE nothing = 1": UnknownColumn, "SELECT units FROM sales WHERE SUM(units) > 1": BindError, "SELECT units FROM sales HAVING units > 1": BindError,
        "SELECT brand, COUNT(*) FROM sales": BindError, "SELECT brand FROM sales GROUP BY region": BindError, "SELECT region FROM sales GROUP BY region ORDER BY units": BindError,
        "SELECT SUM(brand) FROM sales": TypeMismatch, "SELECT AVG(day) FROM sales": TypeMismatch, "SELECT SUM(active) FROM sales": TypeMismatch,
        "SELECT s.units FROM sales s JOIN brands b ON s.units = b.code": TypeMismatch, "SELECT s.units FROM sales s JOIN brands b ON s.brand = s.brand": UnknownColumn,
        "SELECT brand AS q, region AS q FROM sales ORDER BY q": AmbiguousColumn, "SELECT units AS total FROM sales s ORDER BY s.total": UnknownColumn,
        "SELECT region FROM sales GROUP BY region HAVING units > 1": BindError,
    }
    for sql, kind in errors.items():
        with pytest.raises(kind):
            engine.query(sql)


def test_execute(engine):
    assert engine.execute("SELECT brand FROM sales LIMIT 1").count() == 1
    assert "SeqScan on sales" in engine.execute("explain SELECT brand FROM sales")
    with pytest.raises(BindError):
        engine.execute("EXPLAIN CREATE INDEX ON sales(units)")
    with pytest.raises(SqlParseError):
        engine.execute("EXPLAIN nothing")


def test_filters_and_columns_reach_the_files(spark):
    e = Engine(spark)
    e.catalog.add_parquet("/root/testdata/sf0.001/orders.parquet")
    e.catalog.add_parquet("/root/testdata/sf0.001/customer.parquet")
    plan = e.query("SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'P'")._jdf.queryExecution().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "EqualTo(o_orderstatus,P)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in plan
    assert "TakeOrderedAndProject" in e.query("SELECT o_orderkey FROM orders ORDER BY o_totalprice LIMIT 3")._jdf.queryExecution().toString()
