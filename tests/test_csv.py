import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from quernel.errors import CsvError
from quernel.sources.csv import load_csv, table_name


def load(spark, tmp_path, text, **options):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    df = load_csv(spark, str(path), **options)
    return dict(df.dtypes), [tuple(r) for r in df.collect()]


def test_types_are_inferred_from_all_rows(spark, tmp_path):
    types, rows = load(spark, tmp_path, "id,price,name,active,signup_date\n1,2.50,Ann,true,2023-01-05\n2,10,Bob,FALSE,2023-02-01\n3,,Cy,,\n")
    assert types == {"id": "bigint", "price": "decimal(4,2)", "name": "string", "active": "boolean", "signup_date": "date"}
    assert rows[0] == (1, Decimal("2.50"), "Ann", True, datetime.date(2023, 1, 5)) and rows[2] == (3, None, "Cy", None, None)


@pytest.mark.parametrize(
    ("values", "kind", "parsed"),
    [
        (["1", "2022-01-01"], "string", ["1", "2022-01-01"]),
        (["1", "true"], "string", ["1", "true"]),
        (["0", "1"], "bigint", [0, 1]),
        (["true", "yes"], "string", ["true", "yes"]),
        ([" 5 ", "-7", "+3"], "bigint", [5, -7, 3]),
        (["9223372036854775808", "1"], "decimal(19,0)", [Decimal(9223372036854775808), Decimal(1)]),
        (["1e3", "2.5"], "decimal(38,18)", [Decimal(1000), Decimal("2.5")]),
        (["0.125", "100", ".5"], "decimal(6,3)", [Decimal("0.125"), Decimal(100), Decimal("0.5")]),
        (["2022-1-5", "01/02/2023", "2023-03-04 10:11:12"], "date", [datetime.date(2022, 1, 5), datetime.date(2023, 1, 2), datetime.date(2023, 3, 4)]),
        (["2022-02-30", "2022-01-01"], "string", ["2022-02-30", "2022-01-01"]),
        (["2022", "2023"], "bigint", [2022, 2023]),
        ([" x", "x "], "string", [" x", "x "]),
        (["9" * 39], "string", ["9" * 39]),
    ],
)
def test_inference(spark, tmp_path, values, kind, parsed):
    types, rows = load(spark, tmp_path, "c,k\n" + "".join(f"{v},1\n" for v in values))
    assert types["c"] == kind and [r[0] for r in rows] == parsed


def test_quotes_nulls_and_empty_lines(spark, tmp_path):
    types, rows = load(spark, tmp_path, 'a,b\n"x ""y"", z",1\n\n"",2\n,\n')
    assert types == {"a": "string", "b": "bigint"}
    assert rows == [('x "y", z', 1), (None, 2), (None, None)]


def test_columns_without_values_and_without_rows(spark, tmp_path):
    assert load(spark, tmp_path, "a,b\n,1\n,2\n")[0] == {"a": "string", "b": "bigint"}
    assert load(spark, tmp_path, "a,b\n") == ({"a": "string", "b": "string"}, [])
    assert load(spark, tmp_path, "a\n1\n", infer=False) == ({"a": "string"}, [("1",)])


def test_wrong_field_counts(spark, tmp_path):
    assert load(spark, tmp_path, "a,b\n1,2,3\n4,5\n")[1] == [(1, 2), (4, 5)]
    with pytest.raises(PySparkException, match="fewer than 2 fields"):
        load(spark, tmp_path, "a,b\n1\n")


def test_bad_files(spark, tmp_path):
    with pytest.raises(CsvError):
        load(spark, tmp_path, "")
    with pytest.raises(CsvError):
        load(spark, tmp_path, "a,A\n1,2\n")
    assert table_name("/x/sales.2023.csv") == "sales.2023"


def test_byte_order_mark(spark, tmp_path):
    assert load(spark, tmp_path, "﻿a,b\n1,2\n")[0] == {"a": "bigint", "b": "bigint"}
