import datetime
import statistics

import pytest
from pyspark.sql import functions as F

from quernel.operators.quality import KeptStates, Rule, control_limits, frequency_metrics, frequency_states, merge_frequency_states, merge_profile_states, profile_metrics, profile_states, with_previous_load

RULES = (Rule("u", low=0, high=100), Rule("f", allowed=(0, 1)))
ROWS = [(1, 5, 0, "x"), (1, 7, 1, "x"), (1, None, None, "x"), (1, -3, 9, "x"), (2, 200, None, "x"), (None, 4, 1, "x"), (1, 7, 1, "x")]
SCHEMA = "load_id long, u long, f long, n string"


def metrics(df):
    return {(r.load_id, r.column_name): r for r in frequency_metrics(frequency_states(df, "load_id", RULES), "load_id", RULES).collect()}


def test_exact_metrics_with_nulls_repeats_and_clashing_columns(spark):
    m = metrics(spark.createDataFrame(ROWS, SCHEMA).withColumns({"value": F.lit(1), "column_name": F.lit("x"), "_valid": F.lit(2)}))
    a = m[1, "u"]
    assert (a.n_rows, a.n_nulls, a.n_invalid, a.n_valid, a.n_distinct, a.min_value, a.max_value, a.valid_median) == (5, 1, 1, 3, 3, -3, 7, 7.0)
    assert float(a.valid_sum) == 19 and a.valid_mean == pytest.approx(19 / 3)
    b = m[2, "u"]
    assert (b.n_invalid, b.n_valid, b.valid_mean, b.valid_median) == (1, 0, None, None)
    assert m[2, "f"].n_nulls == 1 and m[2, "f"].min_value is None
    assert m[None, "u"].valid_median == 4.0 and m[1, "f"].n_invalid == 1 and m[1, "f"].valid_mean == pytest.approx(2 / 3)


def test_median_is_exact(spark):
    import random

    r = random.Random(5)
    rows = [(load, r.choice([None, r.randint(-5, 120), r.randint(0, 9)]), 0, "") for load in range(20) for _ in range(r.randint(0, 60))]
    m = metrics(spark.createDataFrame(rows, SCHEMA))
    for load in range(20):
        valid = [u for x, u, _, _ in rows if x == load and u is not None and 0 <= u <= 100]
        if (load, "u") in m:
            assert m[load, "u"].valid_median == (statistics.median(valid) if valid else None)


def test_empty_table_and_merging(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert metrics(df.where("1 = 0")) == {}
    with pytest.raises(ValueError):
        frequency_states(df, "load_id", (*RULES, Rule("u", low=5)))
    halves = [frequency_states(df.where(c), "load_id", RULES) for c in ("u > 5", "u IS NULL OR u <= 5")]
    merged = frequency_metrics(merge_frequency_states(halves, "load_id"), "load_id", RULES).collect()
    assert sorted(map(tuple, merged), key=str) == sorted(map(tuple, metrics(df).values()), key=str)


LOADS = "load_id long, feed string, load_no long"


def test_load_before(spark):
    loads = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "a", 3), (4, "b", 1), (5, None, 1)], LOADS)
    df = spark.createDataFrame([(1, 4, 0, ""), (1, None, 0, ""), (3, 8, 0, ""), (4, 1, 0, ""), (5, 1, 1, ""), (9, 1, 1, "")], SCHEMA)
    rows = {(r.load_id, r.column_name): r for r in with_previous_load(frequency_metrics(frequency_states(df, "load_id", RULES), "load_id", RULES), loads).collect()}
    assert len(rows) == 10
    assert rows[1, "u"].prev_null_share is None and rows[1, "u"].null_share == 0.5
    assert rows[3, "u"].prev_valid_median is None  # load 2, the one before, has no rows
    two = df.union(spark.createDataFrame([(2, 6, 1, "")], SCHEMA))
    rows = {(r.load_id, r.column_name): r for r in with_previous_load(frequency_metrics(frequency_states(two, "load_id", RULES), "load_id", RULES), loads).collect()}
    assert rows[3, "u"].prev_valid_median == 6.0 and rows[2, "u"].prev_null_share == 0.5 and rows[2, "f"].prev_valid_mean == 0.0
    assert all(rows[x, "u"].prev_null_share is None for x in (4, 5, 9))


def test_control_limits(spark):
    loads = spark.createDataFrame([(i, "a", i) for i in range(1, 9)], LOADS)
    values = {1: 10, 2: 11, 3: 10, 4: 11, 5: 10, 6: 90, 7: 11, 8: 10}
    df = spark.createDataFrame([(i, v, 0, "") for i, v in values.items()], SCHEMA)
    m = with_previous_load(frequency_metrics(frequency_states(df, "load_id", RULES), "load_id", RULES), loads)
    found = control_limits(m, "valid_median", history=5).collect()
    assert [(r.load_id, r.column_name, r.value) for r in found] == [(6, "u", 90.0)]
    assert control_limits(m, "valid_median", least=9).count() == 0


def test_profile_of_every_column(spark):
    day = datetime.date(2024, 1, 1)
    df = spark.createDataFrame([("a", 1, 1.5, day, True, [1], "x1"), ("a", 20, None, None, None, None, "y"), ("b", None, float(-3), day, False, [2], None), ("a", 3, 2.0, day, True, [1], "x2")],
        "g string, i long, d double, day date, ok boolean, l array<int>, t string")
    rules = (Rule("t", pattern="x[0-9]"), Rule("i", low=0, high=10), Rule("nothing", low=0))
    whole = {r.column_name: r for r in profile_metrics(profile_states(df, rules=rules)).collect()}
    assert set(whole) == set(df.columns)
    assert (whole["i"].n_rows, whole["i"].n_nulls, whole["i"].n_invalid, whole["i"].min_value, whole["i"].max_value, whole["i"].distinct_estimate) == (4, 1, 1, "1", "20", 3)
    assert whole["t"].n_invalid == 1 and whole["t"].null_share == 0.25 and whole["l"].n_nulls == 1 and whole["l"].min_value is None
    assert whole["day"].min_value == "2024-01-01" and whole["i"].median_estimate == 3.0 and whole["t"].median_estimate is None
    by_group = profile_states(df, ["g"], rules)
    assert by_group.count() == 2 * 6
    merged = {r.column_name: r for r in profile_metrics(merge_profile_states(by_group)).collect()}
    for name in set(df.columns) - {"g"}:
        for field in ("n_rows", "n_nulls", "n_invalid", "distinct_estimate"):
            assert merged[name][field] == whole[name][field], (name, field)
    assert (merged["i"].min_value, merged["i"].max_value) == ("1", "20")
    empty = {r.column_name: r for r in profile_metrics(profile_states(df.where("1 = 0"), rules=rules)).collect()}
    assert empty["i"].n_rows == 0 and empty["i"].null_share is None and empty["i"].distinct_estimate is None


def test_numbers_without_values(spark):
    df = spark.createDataFrame([("a", float("nan"), None), ("b", float("nan"), None)], "g string, d double, i long")
    for states in (profile_states(df), merge_profile_states(profile_states(df, ["g"]))):
        m = {r.column_name: r for r in profile_metrics(states).collect()}
        assert m["d"].median_estimate is None and m["i"].median_estimate is None and m["d"].n_nulls == 0 and m["i"].distinct_estimate is None


def test_only_new_loads_are_read(spark, tmp_path):
    source, kept = str(tmp_path / "t"), KeptStates(spark, str(tmp_path / "kept"), "load_id", RULES)
    rows = spark.createDataFrame([(i % 6, i % 50 if i % 5 else None, i % 3, "") for i in range(600)], SCHEMA)
    exact = lambda df: sorted(map(tuple, frequency_metrics(df, "load_id", RULES).collect()), key=str)
    assert kept.states() is None
    rows.where("load_id < 3").write.partitionBy("load_id").parquet(source)
    arrived = spark.read.schema("u long, f long, n string, load_id long")
    kept.update(arrived.parquet(source))
    first = rows.where("load_id < 3")
    assert exact(kept.states()) == exact(frequency_states(first, "load_id", RULES))
    rows.where("load_id >= 3").write.mode("append").partitionBy("load_id").parquet(source)
    arrived = arrived.parquet(source)
    new = kept.new_rows(arrived)
    kept.update(arrived)
    assert exact(kept.states()) == exact(frequency_states(rows, "load_id", RULES))
    kept.update(arrived)
    assert exact(kept.states()) == exact(frequency_states(rows, "load_id", RULES))
    for load in range(3):  # the rows of loads that are known are not read: their files are no tables any more
        for f in (tmp_path / "t" / f"load_id={load}").glob("*.parquet"):
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert sorted(map(tuple, frequency_states(new, "load_id", RULES).collect()), key=str) == sorted(map(tuple, frequency_states(rows.where("load_id >= 3"), "load_id", RULES).collect()), key=str)


def test_new_loads_with_null_and_too_many_to_name(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(KeptStates, "NAMED", 2)
    rows = spark.createDataFrame([(i, 1, 0, "") for i in range(5)] + [(None, 2, 1, "")], SCHEMA)
    for first in ("load_id < 4", "load_id IS NULL", "load_id = 0"):
        kept = KeptStates(spark, str(tmp_path / first.replace(" ", "")), "load_id", RULES)
        kept.update(rows.where(first))
        kept.update(rows)
        got = frequency_metrics(kept.states(), "load_id", RULES).collect()
        assert sorted(((r.load_id, r.column_name, r.n_rows) for r in got), key=str) == sorted(((x, c, 1) for x in (*range(5), None) for c in "uf"), key=str)


def test_control_limits_of_several_metrics(spark):
    loads = spark.createDataFrame([(i, "a", i) for i in range(1, 9)], LOADS)
    df = spark.createDataFrame([(i, 10 if i != 7 else None, 0, "") for i in range(1, 9)] * 3 + [(8, 500, 0, "")], SCHEMA)
    m = with_previous_load(frequency_metrics(frequency_states(df, "load_id", RULES), "load_id", RULES), loads)
    found = {(r.load_id, r.column_name, r.metric) for r in control_limits(m, ("null_share", "invalid_share", "valid_mean")).collect()}
    assert found == {(7, "u", "null_share"), (8, "u", "invalid_share")}
