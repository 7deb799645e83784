"""Random queries, by scans and by indexes, against DuckDB."""

import random
from decimal import Decimal

import duckdb
import pytest
from compare import DATA, multiset

from quernel.engine import Engine

SEED, BATCHES, PER_BATCH = 20261126, 10, 50
NUMBERS = {"units_sold": (0, 60), "stock_available": (0, 400), "delivery_days": (1, 6), "promotion_flag": (0, 1), "price_unit": (1, 9)}
TEXTS = {"region": ["QA-Hills", "QA-Coast", "QC-Moor", "nowhere"], "channel": ["Kiosk", "Discount", "Hyper"], "category": ["Tea", "Bread", "Jam", "tea", "it's"], "brand": ["Kophi", "Quobelna"]}
DATES = ("2022-03-01", "2023-06-01", "2024-12-31")
KEYS = ["region", "channel", "category", "promotion_flag", "delivery_days"]


def value(r, column):
    if column in TEXTS:
        return "'" + r.choice(TEXTS[column]).replace("'", "''") + "'"
    if column == "date":
        return f"'{r.choice(DATES)}'"
    low, high = NUMBERS[column]
    v = f"{r.uniform(low, high):.2f}" if column == "price_unit" and r.random() < 0.7 else str(r.randint(low, high))
    return f"-{v}" if r.random() < 0.1 else v


def predicate(r, q="", depth=0):
    if depth < 3 and r.random() < 0.45:
        a, b = predicate(r, q, depth + 1), predicate(r, q, depth + 1)
        text = f"({a} {r.choice(['AND', 'OR'])} {b})"
        return f"NOT {text}" if r.random() < 0.2 else text
    column = r.choice([*NUMBERS, *TEXTS, "date"])
    kind = r.random()
    if kind < 0.15:
        return f"{q}{column} IS {'NOT ' * (r.random() < 0.5)}NULL"
    if kind < 0.3:
        return f"{q}{column} BETWEEN {value(r, column)} AND {value(r, column)}"
    if kind < 0.45:
        return f"{q}{column} IN ({', '.join(value(r, column) for _ in range(r.randint(1, 3)))})"
    if kind < 0.55:
        a, b = r.sample(list(NUMBERS), 2)
        return f"{q}{a} {r.choice(['<', '>=', '!='])} {q}{b}"
    op = r.choice(["=", "!=", "<>", "<", "<=", ">", ">="])
    return f"{value(r, column)} {op} {q}{column}" if r.random() < 0.2 else f"{q}{column} {op} {value(r, column)}"


def aggregates(r, q=""):
    number = r.choice(list(NUMBERS))
    chosen = r.sample(["COUNT(*)", f"COUNT({q}{number})", f"MIN({q}{number})", f"MAX({q}date)", f"COUNT({q}brand)", f"SUM({q}{number})", f"AVG({q}{number})", f"MAX({q}sku)"], r.randint(1, 3))
    return [f"{a} AS a{i}" for i, a in enumerate(chosen)]


def rounded(rows):
    """Averages are decimals here and doubles there."""
    return [tuple(round(float(v), 6) if isinstance(v, (float, Decimal)) else v for v in row) for row in rows]


def query(r):
    kind = r.random()
    where = f" WHERE {predicate(r)}" if r.random() < 0.85 else ""
    if kind < 0.4:
        columns = r.sample([*NUMBERS, *TEXTS, "date", "sale_id"], r.randint(1, 4))
        order = f" ORDER BY {r.choice(list(NUMBERS))}{r.choice(['', ' DESC'])}, sale_id, load_id LIMIT {r.randint(0, 20)}" if r.random() < 0.3 else ""
        return f"SELECT {', '.join(columns)} FROM fmcg_sales{where}{order}"
    if kind < 0.5:
        return f"SELECT {', '.join(aggregates(r))} FROM fmcg_sales{where}"
    if kind < 0.75:
        keys = r.sample(KEYS, r.randint(1, 2))
        having = f" HAVING COUNT(*) > {r.randint(1, 80)}" + (f" AND MIN({r.choice(list(NUMBERS))}) < 3" if r.random() < 0.3 else "") if r.random() < 0.5 else ""
        order = f" ORDER BY {', '.join(k + r.choice(['', ' DESC']) for k in keys)} LIMIT {r.randint(1, 6)}" if r.random() < 0.4 else ""
        return f"SELECT {', '.join(keys + aggregates(r))} FROM fmcg_sales{where}{' GROUP BY ' + ', '.join(keys)}{having}{order}"
    where = f" WHERE {predicate(r, 's.')}" + (f" AND b.{r.choice(['launch_year > 1990', 'removed_on IS NULL', 'load_id = 3'])}" if r.random() < 0.4 else "")
    if r.random() < 0.5:
        return f"SELECT s.sale_id, b.manufacturer, s.category AS c1, b.category AS c2 FROM fmcg_sales s JOIN brands b ON {r.choice(['s.brand = b.brand', 'b.brand = s.brand'])}{where}"
    third = " JOIN loads l ON s.load_id = l.load_id" if r.random() < 0.5 else ""
    return f"SELECT b.category, {', '.join(aggregates(r, 's.'))} FROM fmcg_sales s JOIN brands b ON s.brand = b.brand{third}{where} GROUP BY b.category"


@pytest.fixture(scope="module")
def engines(spark):
    scan, indexed = Engine(spark), Engine(spark)
    for name in ("fmcg_sales", "brands", "loads"):
        df = spark.read.parquet(str(DATA / f"sf0.001/{name}.parquet")).cache()
        for e in (scan, indexed):
            e.catalog.add_table(name, df)
    for i, column in enumerate([*NUMBERS, *TEXTS, "date"]):
        indexed.catalog.create_index("fmcg_sales", column, ("BTREE", "HASH")[i % 2])
    return scan, indexed


@pytest.mark.parametrize("batch", range(BATCHES))
def test_random_queries(engines, batch):
    r = random.Random(SEED + batch)
    con = duckdb.connect()
    for name in ("fmcg_sales", "brands", "loads"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/sf0.001/{name}.parquet')")
    for i in range(PER_BATCH):
        sql = query(r)
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        want = multiset(names, rounded(cursor.fetchall()))
        df = engines[i % 2].query(sql)
        assert df.columns == names, sql
        got = multiset(names, rounded(df.collect()))
        assert got == want, f"{sql}: {list((got - want).items())[:3]} {list((want - got).items())[:3]}"
