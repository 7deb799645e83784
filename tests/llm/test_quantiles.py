import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import quantiles as q


def rank_gap(values, estimate, p):
    """How far p * n lies outside the ranks that the estimate has."""
    values = np.sort(values)
    low, high = np.searchsorted(values, estimate, "left"), np.searchsorted(values, estimate, "right")
    target = p * len(values)
    return max(low - target, target - high, 0) / len(values)


PS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)


@pytest.mark.parametrize("k", [64, 256])
def test_all_answers_are_within_the_bound_for_all_but_few_seeds(k):
    broken, bounds, gaps = 0, [], []
    for seed in range(100):
        rng = np.random.default_rng(seed)
        values = rng.permutation(np.concatenate([rng.lognormal(3, 2, 8000).round(), np.repeat(7.0, 3000), np.arange(4000.0)]))
        parts = [q.build(x, k, rng) for x in np.array_split(values, 23)]
        sketch = q.merge([q.merge(parts[i : i + 5], k, rng) for i in range(0, 23, 5)], k, rng)
        assert sum(len(x) * 2**h for h, x in enumerate(sketch.levels)) == len(values)
        assert sum(map(len, sketch.levels)) <= 4 * k
        bound = q.rank_error(sketch.spent, len(values), len(PS))
        gap = max(rank_gap(values, q.quantile(sketch, len(values), p), p) for p in PS)
        broken += gap > bound
        bounds.append(bound)
        gaps.append(gap)
    assert broken <= 2 and max(bounds) < 8 / k
    assert max(gaps) > max(bounds) / 10  # the bound is not idle


def test_what_is_spent_adds_up():
    rng = np.random.default_rng(5)
    a, b = (q.build(rng.random(5000), 64, rng) for _ in range(2))
    assert a.spent > 0 and q.build(rng.random(64), 64, rng).spent == 0
    assert q.merge([a, b], 64, rng).spent >= a.spent + b.spent
    assert q.rank_error(0, 10, 5) == 0 and q.rank_error(4.0, 10, 100) > q.rank_error(4.0, 10, 1) > 0


def test_small_sketches_are_exact():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 200).astype(float)
    sketch = q.build(values, 256, rng)
    for p in (0, 0.001, 0.3, 0.5, 0.777, 1):
        assert q.quantile(sketch, 200, p) == np.sort(values)[max(1, math.ceil(p * 200)) - 1]
    assert q.quantile(q.build(np.array([5.0]), 8, rng), 1, 0.5) == 5.0


def test_levels_shrink_downwards():
    assert [q.capacity(90, h, 4) for h in range(4)] == [27, 40, 60, 90] and q.capacity(90, 0, 40) == 8


ROWS = [("a", i % 5, float(i % 97)) for i in range(5000)] + [("b", 1, 3.0)] * 7 + [(None, 2, 4.0), ("c", 1, None), ("c", 1, float("nan")), ("b", None, 9.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "g string, day long, v double").repartition(5).cache()


@pytest.mark.parametrize("salts", [1, 4])
def test_from_days_and_directly(table, salts):
    days = q.merge_states(q.partial_states(table, ["g", "day"], "v", 128), ["g", "day"], 128, salts=1)
    assert days.count() == 5 + 2 + 1
    for states in (q.merge_states(days, ["g"], 128, salts=salts), q.merge_states(q.partial_states(table, ["g"], "v", 128), ["g"], 128, salts=salts)):
        rows = {(r.g, r.percentile): r for r in q.percentiles(states, ["g"], [0.0, 0.5, 0.9, 1.0]).collect()}
        assert len(rows) == 12 and rows["a", 0.5].n_values == 5000 and rows["b", 0.5].n_values == 8
        assert rows["b", 0.5].estimate == 3.0 and rows["b", 1.0].estimate == 9.0 and rows[None, 0.0].estimate == 4.0
        values = [v for g, _, v in ROWS if g == "a"]
        assert all(rank_gap(values, rows["a", p].estimate, p) <= rows["a", p].rank_error for p in (0.0, 0.5, 0.9, 1.0))
        assert rows["b", 0.5].rank_error == 0 < rows["a", 0.5].rank_error < 0.05


def test_same_result_every_time(spark, tmp_path):
    spark.range(20000).selectExpr("id % 3 AS g", "hash(id) % 1000 AS v").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    run = lambda: sorted(map(tuple, q.percentiles(q.merge_states(q.partial_states(df, ["g"], "v", 64), ["g"], 64), ["g"], [0.1, 0.5, 0.9]).collect()))
    assert run() == run()


def test_many_partial_states_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(q, "FLUSH_ROWS", 500)
    r = random.Random(1)
    values = [r.randrange(10**6) for _ in range(20000)]
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(40)
    found = q.percentiles(q.merge_states(q.partial_states(df, [], "v", 256), [], 256), [], [0.05, 0.5, 0.95]).collect()
    assert all(rank_gap(values, r.estimate, r.percentile) <= r.rank_error < 0.03 and r.n_values == 20000 for r in found)


@pytest.mark.parametrize("one_step", [256, 3])
def test_tree_over_partitions(table, monkeypatch, one_step):
    monkeypatch.setattr(q, "ONE_STEP", one_step)
    days = q.states_of(table, ["g", "day"], "v", 128)
    assert days.columns == ["g", "day", "n", "spent", "sizes", "items"] and days.count() == 5 + 2 + 1
    rows = {r.g: r for r in q.percentiles(q.states_of(table, ["g"], "v", 128), ["g"], [0.5]).collect()}
    assert {g: r.n_values for g, r in rows.items()} == {"a": 5000, "b": 8, None: 1}
    assert q.states_of(table.where("1 = 0"), ["g"], "v").count() == 0
    assert q.states_of(table.withColumnRenamed("day", "_part"), ["_part"], "v").count() == 6


def test_edges(spark, table):
    assert q.percentiles(q.merge_states(q.partial_states(table.where("1 = 0"), ["g"], "v"), ["g"]), ["g"], [0.5]).count() == 0
    clash = table.withColumns({"n": F.lit("x"), "items": F.lit(1), "_v": F.lit(2)})
    assert q.percentiles(q.merge_states(q.partial_states(clash, ["g"], "v"), ["g"]), ["g"], [0.5]).count() == 3
    with pytest.raises(ValueError):
        q.percentiles(q.partial_states(table, ["g"], "v"), ["g"], [1.5])


def test_all_states_of_a_batch_at_once(table):
    rng = np.random.default_rng(3)
    sketches = [q.build(rng.integers(0, 40, n).astype(float), 16, rng) for n in (1, 5, 16, 17, 1000, 2, 20000)]
    counts = [1, 5, 16, 17, 1000, 2, 20000]
    schema = q.to_arrow_schema(q._schema(table, [], *q._STATE))
    batch = q._state_batch([], sketches, counts, schema)
    ps = [0.0, 0.001, 0.3, 0.5, 0.999, 1.0]
    assert q._quantiles(batch, ps).tolist() == [[q.quantile(s, n, p) for p in ps] for s, n in zip(sketches, counts, strict=True)]
    assert q._quantiles(batch.slice(3, 3), ps).tolist() == [[q.quantile(s, n, p) for p in ps] for s, n in zip(sketches[3:6], counts[3:6], strict=True)]
