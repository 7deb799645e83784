import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.llm import repetition as rep


def by_hand(text):
    """(units, repeated units), by comparing runs with all earlier ones."""
    if not text:
        return 0, 0
    letters, parts = rep.units(text)
    run = 8 if letters else 4
    hit = set()
    for i in range(len(parts) - run + 1):
        if any(parts[j : j + run] == parts[i : i + run] for j in range(i)):
            hit.update(range(i, i + run))
    return len(parts), len(hit)


def check(texts):
    found = rep.measure_texts(texts)
    for text, n, k in zip(texts, found["n_units"].tolist(), found["n_repeated"].tolist(), strict=True):
        assert (n, k) == by_hand(text), text


CASES = [
    None, "", "   ", "123 456 !!", "one two three", "a b c d a b c d", "a b c d, A-B-C-D!", "a b c d e a b c", "x " * 30, "A1b2C3d a b c d", "the cat sat on the cat sat on the cat sat on",
    "今日は良い天気です。今日は良い天気です。", "天" * 7, "天" * 8, "天" * 9, "カラーカラーカラーカラー", "これ is mixed text with これ is mixed text with", "ééé ÉÉÉ ééé ÉÉÉ ééé", "İstanbul a b c İSTANBUL a b c d", "ab" * 500,
]


def test_cases():
    check(CASES)
    for text in CASES:
        check([text])
    assert by_hand("a b c d a b c d") == (8, 4) and by_hand("天" * 9) == (9, 8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "c", "天", "地", "é", ". ", " 7 "]), max_size=60).map(" ".join), max_size=6))
def test_random_texts(texts):
    check(texts)
    check([t.replace(" ", "") for t in texts])


def test_runs_do_not_cross_texts():
    check(["a b c d", "a b c d", "a b c", "d a b c d", "b c d"] * 3)


def test_table(spark):
    r = random.Random(1)
    texts = [*CASES, " ".join(r.choice("abcdefgh") for _ in range(60000))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"share": F.lit("x"), "n_units": F.lit("y"), "_text": F.lit(1)})
    got = {x.id: x for x in rep.repetition(df, ["id"], "text").collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(CASES):
        n, k = by_hand(text)
        assert (got[i].n_units, got[i].n_repeated, got[i].n_chars) == (n, k, None if text is None else len(text))
        assert got[i].share == (k / n if n else 0.0)
    assert got[len(CASES)].share > 0.9
    assert rep.repetition(df.where("1 = 0"), ["id"], "text").count() == 0


def test_definition():
    assert not rep.repeats_by_definition(None) and not rep.repeats_by_definition("x " * 39)
    assert rep.repeats_by_definition("x " * 40) and not rep.repeats_by_definition("1 " * 60)


def test_bound_is_exact():
    assert rep.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert rep.upper_bound(5, 50, 0.05) == pytest.approx(0.1991, abs=2e-3)
    assert rep.upper_bound(3, 3, 0.05) == 1.0 and rep.upper_bound(0, 0, 0.05) == 1.0


def test_risk_is_controlled():
    """False rejections of good documents stay below alpha in all strata, but for a share delta of holdouts."""
    r = random.Random(2)
    grid = [i / 20 for i in range(1, 20)]
    broken = 0
    for _ in range(200):
        holdout = {s: [(min(1.0, r.expovariate(rate)), True) for _ in range(400)] + [(1.0, False)] * 20 for s, rate in (("x", 12), ("y", 25))}
        cuts = rep.risk_controlled_cutoffs(holdout, grid, 0.95, alpha=0.05, delta=0.1)
        broken += any(math.exp(-rate * cuts[s].cutoff) > 0.05 for s, rate in (("x", 12), ("y", 25)))
        assert cuts["y"].cutoff < cuts["x"].cutoff < 0.95 and cuts["x"].bound <= 0.05 and cuts["x"].n_good == 400
    assert broken <= 20
    few = rep.risk_controlled_cutoffs({"x": [(0.0, True)] * 3}, grid, 0.35)["x"]
    assert few.cutoff == 0.35 and few.n_good == 3 and few.bound > 0.5
    assert rep.risk_controlled_cutoffs({"x": [(0.0, True)] * 5000}, grid, 0.35)["x"].cutoff == 0.05
    assert rep.risk_controlled_cutoffs({}, grid, 0.35) == {}


def test_score_is_never_below_the_share(monkeypatch):
    r = random.Random(8)
    texts = CASES + [" ".join(r.choice("abcdefgh") * r.randint(1, n) for _ in range(r.randint(0, 400))) for n in (1, 2, 4, 9) for _ in range(20)]
    for slots in (1, 32):
        monkeypatch.setattr(rep, "SLOTS", slots)
        found = rep.measure_texts(texts, dict.fromkeys(rep.STRATA, 0.0))
        assert (found["n_scored"] >= found["n_repeated"]).all() and (found["n_scored"] <= found["n_units"]).all()
        assert found["n_repeated"].tolist() == rep.measure_texts(texts)["n_repeated"].tolist()
        if slots == 32:
            assert found["n_scored"].sum() < found["n_repeated"].sum() + 0.1 * found["n_units"].sum()
        cut = rep.measure_texts(texts, dict.fromkeys(rep.STRATA, 0.35))
        exact, n = found["n_repeated"], found["n_units"]
        assert all(c == e for c, e, m in zip(cut["n_repeated"], exact, n, strict=True) if m and e >= 0.35 * m)
        assert (cut["n_repeated"][n > 0] == -1).any()


def long_texts(n):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    return [" ".join(["again and again we say"] * 15) if i % 9 == 0 else " ".join(word() for _ in range(r.randint(20, 60))) for i in range(n)]


def test_screening_holdout_and_report(spark):
    texts = long_texts(900) + [None, "", "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").withColumns({"score": F.lit("x"), "stratum": F.lit(1)})
    holdout = rep.labelled_holdout(docs, "id", "text", 0.35, 700)
    assert holdout == rep.labelled_holdout(docs, "id", "text", 0.35, 700) and sum(map(len, holdout.values())) == 450
    assert sum(map(len, rep.labelled_holdout(docs, "id", "text", 0.35, 20).values())) == 20
    assert any(good and score > 0 for score, good in holdout["words-short"]) or any(score == 0 for score, _ in holdout["words-short"])
    cutoffs = dict.fromkeys(rep.STRATA, rep.Cutoff(0.35, 0, 1.0)) | rep.risk_controlled_cutoffs(holdout, [0.1, 0.2, 0.3], 0.35)
    assert cutoffs["words-short"].cutoff < 0.35 and cutoffs["words-short"].bound <= 0.02
    exact = {r.id: r.share for r in rep.repetition(docs, ["id"], "text").collect()}
    rows = rep.screened(docs, ["id"], "text", {s: c.cutoff for s, c in cutoffs.items()}).collect()
    assert len(rows) == len(texts) and sum(r.share is None for r in rows) > 700
    assert all(r.share is None and exact[r.id] < 0.35 or r.share == exact[r.id] for r in rows)
    report = {r.stratum: r for r in rep.cutoff_report(docs, "id", "text", cutoffs, 0.35, 700).collect()}["words-short"]
    assert report.n_good + report.n_bad == 451 and report.n_bad == report.n_bad_taken > 0 and report.n_good_taken <= 0.1 * report.n_good
    assert rep.labelled_holdout(docs.where("1 = 0"), "id", "text", 0.35, 10) == {}
    assert rep.screened(docs.where("1 = 0"), ["id"], "text", dict.fromkeys(rep.STRATA, 0.3)).count() == 0
