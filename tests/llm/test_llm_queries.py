import pytest
from compare import DATA, differences, duck

from quernel.llm import queries as q
from quernel.llm.repetition import repeats_by_definition

SF = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, name):
    assert not differences(spark, name, q.QUERIES[name], q.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.SQL)))
def test_query_runs(spark, name):
    df = q.QUERIES[name](spark, str(SF))
    assert df.columns and df.count() >= 1


def test_ids_and_shortfalls_by_another_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{q.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rows = duck(SF).execute("SELECT doc_id, text, source FROM documents").fetchall()
    ids = {d: t.encode(x, add_special_tokens=False).ids if x else [] for d, x, _ in rows}
    assert {r.doc_id: list(r.ids) for r in q.p7_ids(spark, str(SF)).collect()} == ids
    size = {}
    for d, _, source in rows:
        size[source] = size.get(source, 0) + len(ids[d])
    total = sum(size.values())
    targets = duck(SF).execute("SELECT source, target_weight, max_repeats FROM mix_targets").fetchall()
    short = {s for s, w, m in targets if m * size.get(s, 0) < w * total}
    assert {r.source for r in q.p8_found(spark, str(SF)).collect()} == short
    shares = {r.source: r for r in q.p8_shares(spark, str(SF)).collect()}
    largest = max(map(len, ids.values()))
    for s, w, m in targets:
        assert shares[s].reachable == (s not in short) and shares[s].most_uses <= m
        assert abs(shares[s].tokens - min(w * total, m * size.get(s, 0))) <= largest + 1


def test_repetition_by_definition(spark):
    rows = duck(SF).execute("SELECT doc_id, text FROM documents").fetchall()
    assert {r.doc_id for r in q.p9_found(spark, str(SF)).collect()} == {d for d, x in rows if repeats_by_definition(x)}


def test_cutoffs_lose_nothing(spark):
    rows = q.p9_cutoffs(spark, str(SF)).collect()
    assert rows and all(0 < r.cutoff <= q.LEAST_SHARE and r.n_bad_taken == r.n_bad for r in rows)


def test_cutoffs_decide_what_is_measured(spark):
    documents = q._long_enough(spark, str(SF))
    cutoffs = {s: c.cutoff for s, c in q._cutoffs(documents).items()}
    measured = q.screened(documents, ["doc_id"], "text", cutoffs).where("share IS NOT NULL").count()
    assert 0 < measured < documents.count() / 2
