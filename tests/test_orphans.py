import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from quernel.operators import orphans
from quernel.operators.orphans import missing_keys, orphan_report, orphan_rows

D = datetime.date
REFS = "ref string, row_id long, key string, date date"
PARENTS = "key string, valid_from date, valid_to date"


def brute(refs, parents):
    out = set()
    for ref, row_id, key, date in refs:
        if key is None:
            continue
        there = any(k == key and (date is None or (a is not None and a <= date and (b is None or date < b))) for k, a, b in parents)
        if not there:
            out.add((ref, row_id, key, date))
    return out


def check(spark, refs, parents):
    got = [tuple(r) for r in orphan_rows(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(refs, parents)


def test_days_texts_and_nulls(spark):
    parents = [("a", D(2023, 1, 10), D(2023, 3, 1)), ("b", D(2020, 1, 1), None), ("c", None, None), ("", D(2022, 1, 1), None), (None, D(2020, 1, 1), None)]
    days = [None, D(2023, 1, 9), D(2023, 1, 10), D(2023, 2, 28), D(2023, 3, 1), D(2019, 12, 31)]
    refs = [("t", i, k, d) for i, (k, d) in enumerate((k, d) for k in ("a", "b", "c", "", "A", "a ", "ä", None) for d in days)]
    check(spark, refs + refs[:7], parents)
    check(spark, refs, [])
    check(spark, [], parents)
    check(spark, refs, [("a", D(2023, 1, 1), D(2023, 2, 1)), ("a", D(2023, 2, 1), D(2023, 2, 10)), ("a", D(2023, 2, 20), None)])


def test_random_against_brute_force(spark):
    r = random.Random(3)
    day = lambda: D(2022, 1, 1) + datetime.timedelta(r.randrange(800))
    parents = []
    for i in range(120):
        a = r.choice([day(), D(2021, 6, 1)])
        parents.append((f"k{i}", a, r.choice([None, a + datetime.timedelta(r.randrange(400))])))
    refs = [(r.choice(["x", "y"]), i, f"k{min(r.randrange(140), r.randrange(140))}", r.choice([None, day(), day()])) for i in range(4000)]
    check(spark, refs, parents)


def test_many_ranges(spark, monkeypatch):
    n = orphans.RANGE_KEYS + 500
    refs = spark.range(n).select(F.lit("t").alias("ref"), F.col("id").alias("row_id"), F.concat(F.lit("k"), "id").alias("key"), F.lit(D(2023, 1, 5)).alias("date"))
    parents = refs.where("row_id % 1000 != 7").select("key", F.lit(D(2022, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    found = sorted(r.row_id for r in orphan_rows(refs, parents).collect())
    assert found == [i for i in range(n) if i % 1000 == 7]


def test_only_suspects_survive_and_report(spark):
    refs = spark.createDataFrame([("t", 1, "a", D(2023, 1, 5)), ("t", 2, "b", D(2023, 1, 5)), ("t", 3, "b", D(2023, 1, 7)), ("t", 4, "b", None), ("u", 5, "b", D(2023, 2, 1)), ("t", 6, "c", D(2023, 1, 31))], REFS).withColumn("month", F.lit("x"))
    parents = spark.createDataFrame([("a", D(2022, 1, 1), None), ("c", D(2023, 1, 15), None)], PARENTS).withColumn("id", F.lit(0))
    assert sorted((r.ref, r.key) for r in missing_keys(refs, parents).collect()) == [("t", "b"), ("t", "b"), ("t", "c"), ("u", "b")]
    report = sorted(map(tuple, orphan_report(orphan_rows(refs, parents)).collect()), key=str)
    assert report == sorted([("t", D(2023, 1, 1), 2, 1), ("t", None, 1, 1), ("u", D(2023, 2, 1), 1, 1)], key=str)


def test_blocks_take_the_shortest_container():
    r = np.random.default_rng(1)
    cases = {orphans.PLACES: [np.array([5]), np.array([0, 2, 9, 32767])], orphans.RUNS: [np.arange(32768), np.arange(100, 900), np.r_[0:50, 7000:7100]], orphans.BITS: [np.flatnonzero(r.random(32768) < 0.5)]}
    for container, sets in cases.items():
        for places in sets:
            kind, block = orphans.compress(places)
            assert kind == container or len(places) == 1
            assert len(block) <= min(4096, 2 * len(places)) or len(places) == 1
            assert np.flatnonzero(np.unpackbits(orphans.decompress_to_bits(kind, block), bitorder="little")).tolist() == places.tolist()


def test_too_many_survivors_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", 0)
    parents = [("a", D(2023, 1, 10), D(2023, 3, 1))]
    check(spark, [("t", i, k, d) for i, (k, d) in enumerate((k, d) for k in ("a", "b", None) for d in (None, D(2023, 1, 9), D(2023, 1, 10), D(2023, 3, 1)) for _ in range(50))], parents)


def test_rows_do_not_move(spark):
    refs = spark.createDataFrame([("t", i, "b", D(2023, 1, 5)) for i in range(50)], REFS)
    plan = orphan_rows(refs, spark.createDataFrame([("a", D(2022, 1, 1), None)], PARENTS))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1


def test_distinct_by(spark):
    refs = spark.createDataFrame([("t", 1, "x", D(2023, 1, 5)), ("t", 1, "y", D(2023, 1, 5)), ("t", 1, "x", None)], REFS)
    parents = spark.createDataFrame([], PARENTS)
    assert [tuple(r) for r in orphan_rows(refs, parents, ("ref", "row_id")).collect()] == [("t", 1)]
