import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from quernel.llm import mixing, routing
from quernel.llm.mixing import Target, mix, plan_mix, plan_of, report


def cost_of(plan, sizes):
    """Sum over patterns of what the uses of their tokens cost."""
    out = 0
    for p, size in sizes.items():
        used, use = sum(x for (q, _), x in plan.routed.items() if q == p), 0
        while used > 0:
            out += use * min(size, used)
            used, use = used - size, use + 1
    return out


def test_disjoint_sources_are_the_plain_rule():
    targets = [Target("a", 0.5, 1), Target("b", 0.3, 2), Target("c", 0.2, 3), Target("d", 0.0, 1)]
    sizes = {("a",): 70, ("b",): 14, ("c",): 16, (): 0}
    plan = plan_mix(sizes, targets, 100)
    assert plan.quotas == {"a": 50, "b": 30, "c": 20} and plan.reached == {"a": 50, "b": 28, "c": 20}
    assert plan.routed == {(("a",), "a"): 50, (("b",), "b"): 28, (("c",), "c"): 20}


def test_flow_is_best_for_overlapping_sources():
    r = random.Random(4)
    for _ in range(60):
        names = ["a", "b", "c"][: r.randint(1, 3)]
        targets = [Target(n, r.choice([0.2, 0.3, 0.5]), r.randint(1, 3)) for n in names]
        patterns = [p for m in range(1, len(names) + 1) for p in itertools.combinations(names, m)]
        sizes = {p: r.randint(1, 4) for p in r.sample(patterns, r.randint(1, min(3, len(patterns))))}
        total = r.randint(4, 12)
        plan = plan_mix(sizes, targets, total)
        caps = {t.source: t.max_repeats for t in targets}
        arcs = [(p, s) for p in sizes for s in p]
        best = None
        for choice in itertools.product(*[range(min(plan.quotas[s], sizes[p] * caps[s]) + 1) for p, s in arcs]):
            flow = dict(zip(arcs, choice, strict=True))
            ok = all(sum(x for (_, t), x in flow.items() if t == s) <= plan.quotas[s] for s in names) and all(sum(x for (q, _), x in flow.items() if q == p) <= sizes[p] * max(caps[s] for s in p) for p in sizes)
            if ok:
                key = (-sum(choice), cost_of(type(plan)(0, {}, {}, flow), sizes))
                best = key if best is None else min(best, key)
        assert (-sum(plan.routed.values()), cost_of(plan, sizes)) == best


def documents(spark, n, seed=0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        sources = r.choice([["big"]] * 5 + [["small"], ["big", "small"], ["tiny"], ["other"], [], None, ["small", "small", None]])
        rows.append((i, sources, r.choice([0, r.randint(1, 50), r.randint(1, 500)])))
    return rows, spark.createDataFrame(rows, "id long, sources array<string>, n_tokens long").withColumns({"pattern": F.lit("x"), "uses": F.lit(1)})


TARGETS = [Target("big", 0.4, 1), Target("small", 0.45, 4), Target("tiny", 0.1, 2), Target("none", 0.05, 4)]


@pytest.mark.parametrize("seed", [0, 1])
def test_selection(spark, seed):
    rows, df = documents(spark, 3000)
    selected, plan = mix(df, TARGETS, "id", seed)
    got = selected.collect()
    tokens = {i: n for i, _, n in rows}
    assert plan.total == sum(tokens.values())
    caps = {t.source: t.max_repeats for t in TARGETS}
    per_source, uses = {}, {}
    for r in got:
        assert 1 <= r.uses <= caps[r.source] and r.source in dict((i, s) for i, s, _ in rows)[r.id]
        assert r.n_tokens == tokens[r.id] > 0
        per_source[r.source] = per_source.get(r.source, 0) + r.uses * r.n_tokens
        uses[r.id] = uses.get(r.id, 0) + r.uses
    assert len({(r.id, r.source) for r in got}) == len(got)
    assert max(uses.values()) <= 4
    n_intervals = 4
    for s, reached in plan.reached.items():
        assert abs(per_source.get(s, 0) - reached) <= n_intervals * 500
    again = mix(df, TARGETS, "id", seed)[0].collect()
    assert set(map(tuple, again)) == set(map(tuple, got))
    other = {r.id for r in mix(df, TARGETS, "id", seed + 7)[0].collect()}
    assert other != {r.id for r in got}


def test_report(spark):
    _, df = documents(spark, 2000)
    selected, plan = mix(df, TARGETS, "id")
    rows = {r.source: r for r in report(selected, plan, TARGETS).collect()}
    assert set(rows) == {t.source for t in TARGETS}
    assert rows["none"].tokens == 0 and not rows["none"].reachable and rows["big"].reachable
    assert sum(r.share for r in rows.values()) == pytest.approx(1)
    assert rows["small"].most_uses <= 4


def test_edges(spark):
    _, df = documents(spark, 50)
    empty, plan = mix(df.where("1 = 0"), TARGETS, "id")
    assert empty.count() == 0 and plan.total == 0 and all(q == 0 for q in plan.quotas.values())
    nothing, plan = mix(df, [], "id")
    assert nothing.count() == 0 and plan.quotas == {}
    assert mix(df, [Target("big", 0.5, 0)], "id")[0].count() == 0
    one = spark.createDataFrame([(1, ["a"], 10)], "id long, sources array<string>, n_tokens long")
    assert [tuple(r) for r in mix(one, [Target("a", 1.0, 1)], "id")[0].collect()] == [(1, "a", 1, 10)]
    with pytest.raises(ValueError):
        plan_of(df, [Target("a", 1.0, 1)] * 2)


def test_quotas_are_of_decimal_weights():
    for weight, quota in ((0.07, 7), (0.14, 14), (0.28, 28), (0.071, 8)):
        plan = plan_mix({("a",): 7 if weight == 0.07 else 100}, [Target("a", weight, 1)], 100)
        assert plan.quotas == {"a": quota} == plan.reached or plan.quotas["a"] == 8


def test_many_repeats_take_few_steps():
    plan = plan_mix({("a",): 3, ("a", "b"): 5}, [Target("a", 0.9, 10**9), Target("b", 0.1, 10**9)], 10**9)
    assert plan.reached == plan.quotas == {"a": 9 * 10**8, "b": 10**8}
    by_pattern = {p: sum(x for (q, _), x in plan.routed.items() if q == p) for p in ((("a",)), ("a", "b"))}
    assert abs(by_pattern["a",] / 3 - by_pattern["a", "b"] / 5) <= 1  # as often one as the other


def many_patterns(n, n_sources, seed=0):
    r = random.Random(seed)
    names = [f"s{i:02d}" for i in range(n_sources)]
    sizes = {}
    while len(sizes) < n:
        sizes[tuple(sorted(r.sample(names, r.randint(1, 6))))] = r.randint(1, 1000)
    weights = [r.random() ** 3 for _ in names]
    return sizes, [Target(s, round(w / sum(weights), 6), r.randint(1, 4)) for s, w in zip(names, weights, strict=True)]


def test_twenty_thousand_patterns():
    sizes, targets = many_patterns(20_000, 60)
    start = time.perf_counter()
    plan = plan_mix(sizes, targets, sum(sizes.values()))
    assert time.perf_counter() - start < 60
    caps = {t.source: t.max_repeats for t in targets}
    assert all(x <= caps[s] * sizes[p] and s in p for (p, s), x in plan.routed.items())
    for t in targets:
        assert plan.reached[t.source] == sum(x for (_, s), x in plan.routed.items() if s == t.source) <= plan.quotas[t.source]


def test_flow_by_jobs_equals_that_on_the_driver(spark, monkeypatch):
    rows, df = documents(spark, 400)
    df = df.drop("pattern", "uses")
    targets = [Target("big", 0.5, 1), Target("small", 0.35, 4), Target("tiny", 0.1, 2)]
    mixed, local = mix(df, targets, "id")
    want = sorted(map(tuple, mixed.collect()))
    monkeypatch.setattr(mixing, "LOCAL_PATTERNS", 1)
    monkeypatch.setattr(mixing, "BLOCK_PATTERNS", 2)
    selected, plan = mix(df, targets, "id")
    assert plan.routed is None and plan.quotas == local.quotas and sum(plan.reached.values()) == sum(local.reached.values())
    got = selected.collect()
    tokens = {i: n for i, _, n in rows}
    for s, reached in plan.reached.items():
        assert abs(sum(r.uses * tokens[r.id] for r in got if r.source == s) - reached) <= 2000
    assert len(got) and len(want)


def test_blocks_give_the_flow_of_one_block():
    for seed in range(8):
        sizes, targets = many_patterns(60, 7, seed)
        total = sum(sizes.values())
        plan = plan_mix(sizes, targets, total)
        quotas = list(plan.quotas.values())
        live = [t for t in targets if t.weight > 0]
        names = list(sizes)
        parts = [mixing._block(names[i::3], [sizes[p] for p in names[i::3]], live, quotas) for i in range(3)]
        reached = routing.route(routing.LocalBlocks(parts), quotas)
        assert reached.sum() == sum(plan.reached.values())
        routed = {(names[i::3][a], live[b].source): int(parts[i].flow[a, b]) for i in range(3) for a, b in zip(*parts[i].flow.nonzero(), strict=True)}
        assert cost_of(type(plan)(0, {}, {}, routed), sizes) == cost_of(plan, sizes)
