import io
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quernel import cli
from quernel.cli import Repl, files, format_table, main
from quernel.engine import Engine
from quernel.operators import relational as ops

SALES = [("N", "x", 10), ("N", "y", None), ("S", "x", 5), ("S", None, 7), ("E", "q", 1)]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(SALES, "region string, brand string, units bigint"), spark.createDataFrame([("x", "Tea"), ("y", "Jam"), (None, "Nuts")], "brand string, category string")


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_joins_agree(tables):
    s, b = tables
    want = sorted([("N", "x", 10, "x", "Tea"), ("N", "y", None, "y", "Jam"), ("S", "x", 5, "x", "Tea")], key=str)
    assert got(ops.hash_join(s, b, "brand", "brand")) == want == got(ops.nested_loop_join(s, b, "brand", "brand"))
    assert "BroadcastNestedLoopJoin" in ops.nested_loop_join(s.limit(3), b.limit(3), "brand", "brand")._jdf.queryExecution().toString()
    assert got(ops.hash_join(s, b.where("1 = 0"), "brand", "brand")) == []


def test_large_sides_are_not_broadcast(spark):
    big = spark.range(10_000_000).selectExpr("id AS a", "id AS b")
    plan = ops.hash_join(big, big, "a", "b")._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
    assert "NestedLoop" not in ops.nested_loop_join(big, big, "a", "b")._jdf.queryExecution().toString()


def test_filter_project_sort_limit(tables):
    s, _ = tables
    assert got(ops.project(ops.filter_(s, F.col("units") > 5), ["units", "region", "units"])) == [(10, "N", 10), (7, "S", 7)]
    assert ops.project(s, {"u": "units"}).columns == ["u"]
    assert [r.units for r in ops.sort(s, ["units"]).collect()] == [1, 5, 7, 10, None]
    assert [r.units for r in ops.limit(ops.sort(s, [("units", True), "brand"]), 2).collect()] == [10, 7]
    assert ops.limit(s, -1).count() == 0


@pytest.mark.parametrize("degree", [1, 2, 4, 8, 17])
def test_parallel_aggregate_equals_the_plain_one(spark, degree):
    df = spark.range(0, 5000, 1, 7).selectExpr("id % 13 AS k", "CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id AS DECIMAL(10,2)) END AS v")
    specs = {"n": ("COUNT", None), "c": ("COUNT", "v"), "s": ("SUM", "v"), "a": ("AVG", "v"), "mn": ("MIN", "v"), "mx": ("MAX", "v")}
    for condition in (None, F.col("v") > 100, F.col("v") < 0):
        plain = ops.hash_aggregate(df if condition is None else df.where(condition), ["k"], specs)
        assert got(ops.parallel_hash_aggregate(df, ["k"], specs, degree, condition)) == got(plain)


def test_aggregate_edges(tables, spark):
    s, _ = tables
    assert got(ops.hash_aggregate(s.where("1 = 0"), [], {"n": ("COUNT", None), "s": ("SUM", "units")})) == [(0, None)]
    assert got(ops.hash_aggregate(s.where("1 = 0"), ["region"], {"n": ("COUNT", None)})) == []
    assert got(ops.hash_aggregate(s, ["region"], {})) == [("E",), ("N",), ("S",)]
    with pytest.raises(ValueError):
        ops.parallel_hash_aggregate(s, [], {"n": ("COUNT", None)}, 0)


def test_prompt(spark, tmp_path):
    (tmp_path / "b.csv").write_text("brand,units,day,active\nx,1,2023-01-05,true\ny,,,\n")
    (tmp_path / "a.csv").write_text("k\n1\n")
    assert [p.name for p in files([], str(tmp_path))] == ["a.csv", "b.csv"] and [p.name for p in files([str(tmp_path / "b.csv")], None)] == ["b.csv"]
    engine, out = Engine(spark), io.StringIO()
    for p in files([], str(tmp_path)):
        engine.load_csv(str(p))
    lines = [".tables", ".schema B", ".schema nothing", "", "SELECT * FROM b ORDER BY brand", "EXPLAIN SELECT brand FROM b", "CREATE INDEX ON b(brand)", "SELECT FROM", "SELECT x FROM b", "SELECT COUNT(*) FROM b", ".quit", ".tables"]
    Repl(engine, out).run(lines)
    text = out.getvalue()
    assert "sql> a\nb\n" in text and "brand TEXT\nunits INT\nday DATE\nactive BOOL" in text and "unknown table 'nothing'" in text
    assert "brand | units | day        | active\n------+-------+------------+-------\nx     | 1     | 2023-01-05 | true  \ny     | NULL  | NULL       | NULL  \n(2 rows in " in text
    assert "SeqScan on b" in text and "created BPlusTree index on b(brand) (" in text and "syntax error: " in text and "error: unknown column 'x'" in text and "(1 row in " in text
    assert text.count("sql> ") == len(lines) - 1
    assert format_table(["a"], []) == "a\n-"


def test_arguments(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    for arguments in (["nothing.csv"], ["--data", "nowhere"], []):
        assert main(arguments) == 2 and capsys.readouterr().err.startswith("error: n")
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "x.csv").write_text("a\n")
    assert [p.name for p in files([], None)] == ["x.csv"]


def test_load_line_and_whole_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "BLOCK_ROWS", 7)
    (tmp_path / "t.csv").write_text("k,v\n" + "".join(f"{i},{'x' * (i // 10)}\n" for i in range(45)))
    out = io.StringIO()
    repl = Repl(Engine(spark), out)
    repl.load(tmp_path / "t.csv")
    (tmp_path / "t.csv").unlink()  # queries read the typed copy
    repl.run(["SELECT k, v FROM t ORDER BY k"], prompt=False)
    lines = out.getvalue().splitlines()
    assert lines[0].startswith("loaded 't': 45 rows, 2 columns (") and lines[-2].startswith("(45 rows in ")
    assert [int(x.split(" | ")[0]) for x in lines[3:-2]] == list(range(45))
    assert lines[3] == "0 | NULL" and lines[-3] == "44 | xxxx"


def test_sums_are_exact(spark):
    ends = [2**63 - 1, -(2**63), 2**42 - 1, -(2**42), -1, 1, 0, 2**21, None]
    df = spark.createDataFrame([(v, Decimal(v % 10**18 if v is not None else 0).scaleb(-9), float(i) / 100, i - 4, Decimal(i).scaleb(-18)) for i, v in enumerate(ends)], "a bigint, b decimal(18,9), c double, d smallint, e decimal(18,18)")
    specs = {f"{f}_{c}": (f, c) for f in ("SUM", "AVG") for c in "abcde"}
    r = ops.hash_aggregate(df, [], specs, 2).first().asDict()
    known = [v for v in ends if v is not None]
    assert r["SUM_a"] == sum(known) and abs(r["AVG_a"] - Decimal(sum(known)) / len(known)) < Decimal("1e-6")
    assert r["SUM_b"] == sum(Decimal(v % 10**18).scaleb(-9) for v in known) and r["SUM_c"] == Decimal("0.36") and r["SUM_d"] == 0 and r["SUM_e"] == Decimal(36).scaleb(-18)
    types = dict(ops.hash_aggregate(df, [], specs, 2).dtypes)
    assert types["SUM_a"] == "decimal(29,0)" and types["SUM_b"] == "decimal(28,9)" and types["SUM_c"] == "decimal(28,2)"
    most = spark.range(0, 3000, 1, 3).select(F.lit(2**63 - 1).alias("x"), F.lit(-(2**63)).alias("y"))
    assert tuple(ops.hash_aggregate(most, [], {"x": ("SUM", "x"), "y": ("SUM", "y")}).first()) == (3000 * (2**63 - 1), -3000 * 2**63)


def test_degree_is_kept(spark):
    df = spark.range(0, 100, 1, 5).selectExpr("id % 3 AS k", "id AS v")
    for degree in (2, 5, 12):
        plan = ops.parallel_hash_aggregate(df, ["k"], {"s": ("SUM", "v")}, degree)._jdf.queryExecution().toString()
        assert (", 12), REPARTITION_BY_NUM" in plan) == (degree == 12) and ("Coalesce 2" in plan) == (degree == 2)
