import datetime
import random

import pytest
from pyspark.sql import functions as F

from quernel.llm.top_n import candidates, cluster, needed_row_groups, row_groups, skipped, top_n

SCHEMA = "g string, h long, score double, id long"


def brute(rows, n):
    groups = {}
    for g, h, score, i in set(rows):
        if score is not None and score == score:
            groups.setdefault((g, h), []).append((-score, (i is not None, i or 0), score, i))
    return sorted(((g, h, s, i, k) for (g, h), found in groups.items() for k, (_, _, s, i) in enumerate(sorted(found)[:n], 1)), key=str)


def got(spark, rows, n, per_group=50):
    table = cluster(spark.createDataFrame(rows, SCHEMA), ("g", "h"), "score", ("id",), row_group_rows=per_group)
    return sorted((tuple(r) for r in top_n(spark, table, n).collect()), key=str), table


@pytest.mark.parametrize("n", [1, 5, 200])
def test_skewed_groups_with_ties_repeats_and_nulls(spark, n):
    r = random.Random(n)
    rows = [(r.choice(["hot"] * 5 + [None, "", "a", f"g{r.randrange(300)}"]), r.choice([1, 1, None]), r.choice([None, float("nan"), float(r.randrange(40)), -1.5]), r.choice([None, r.randrange(5000)])) for _ in range(4000)]
    rows += rows[:400]
    assert got(spark, rows, n)[0] == brute(rows, n)


def test_skips_row_groups_and_keeps_equal_scores(spark):
    rows = [("hot", 1, float(i // 3), i) for i in range(6000)] + [("b", 1, 1.0, i) for i in range(500)]
    result, table = got(spark, rows, 5, 100)
    assert result == brute(rows, 5)
    found = row_groups(spark, table)
    assert found.agg(F.sum("_rows")).first()[0] == 6500 and found.where("_single").count() > 40
    needed = needed_row_groups(spark, table, 5)
    hot = needed.where("g = 'hot' AND _single").count()
    assert 1 <= hot <= 2
    assert needed.where("g = 'b' AND _single").count() >= 4  # all scores are equal: none is strictly below
    assert candidates(spark, table, 5).count() < 200
    assert needed_row_groups(spark, table, 10**6).count() == found.count()
    r = skipped(spark, table, 5).first()
    assert (r.row_groups, r.rows) == (found.count(), 6500) and r.skipped_row_groups == found.count() - needed.count() and r.skipped_rows > 5000
    assert tuple(skipped(spark, table, 10**6).first())[2:] == (0, 0)
    assert "MapInArrow" not in needed._jdf.queryExecution().toString()


def test_empty_and_extra_columns(spark):
    result, table = got(spark, [], 3)
    assert result == [] and row_groups(spark, table).count() == 0
    df = spark.createDataFrame([("a", 1, 2.0, 7)], SCHEMA).withColumns({"rank": F.lit(1), "_file": F.lit("x")})
    assert top_n(spark, cluster(df, ("g", "h"), "score", ("id",)), 1).columns == ["g", "h", "score", "id", "rank"]
    for bad in ((("g",), "g", ("id",)), ((), "score", ("id",)), (("g",), "score", ())):
        with pytest.raises(ValueError):
            cluster(df, *bad)
    with pytest.raises(ValueError):
        top_n(spark, table, 0)


def test_other_types(spark):
    d = datetime.date
    rows = [(d(2023, 1, 1 + i % 3), i % 2 == 0, i % 7, f"t{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "day date, flag boolean, score long, name string")
    got = [tuple(r)[:4] for r in top_n(spark, cluster(df, ("day", "flag"), "score", ("name",), row_group_rows=10), 2).collect()]
    want = []
    for key in {(r[0], r[1]) for r in rows}:
        want += sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[2], r[3]))[:2]
    assert sorted(got, key=str) == sorted(want, key=str)
