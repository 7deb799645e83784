"""A mix of sources with target shares of the total size.

Documents may belong to several sources. They are aggregated by membership pattern (the set of their sources that have
a target), and a min-cost flow (``routing``) routes the patterns' tokens to the quotas of the sources: the first use of
a document costs nothing, each further use one more than the use before (convex costs), so no document is repeated
while another that would do is unused. The network has a node per pattern and source and nothing per document. Documents
are then taken in a seeded random order: each pattern is a line of its documents' tokens in that order, laid end to end
as often as it is repeated; every source owns an interval of the line, and gets a document each time its start lies in
it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.llm.routing import Block, LocalBlocks, SparkBlocks, route
from quernel.plans.scratch import materialize

#: Membership patterns whose flow is made on the driver, and those of a block of more, whose flow is made by jobs.
LOCAL_PATTERNS, BLOCK_PATTERNS = 100_000, 20_000
#: Documents of a bucket of the seeded order, and the fewest buckets; only buckets in which an interval ends are put in exact order.
BUCKET_DOCUMENTS, LEAST_BUCKETS = 20_000, 1024
#: Intervals, of under 1 KB each, that are sent to every task; more are joined.
BROADCAST_INTERVALS = 20_000


@dataclass(frozen=True)
class Target:
    source: str
    weight: float
    max_repeats: int


@dataclass(frozen=True)
class Plan:
    """The quotas and what of them is reached, by source; ``total`` is T. ``routed`` has the tokens from each (pattern, source), or is None where patterns are too many for the driver."""

    total: int
    quotas: dict[str, int]
    reached: dict[str, int]
    routed: dict[tuple[tuple[str, ...], str], int] | None


def _quota(weight: float, total: int) -> int:
    """weight * ``total`` rounded up, of the decimal number that ``weight`` is written as."""
    return math.ceil(Fraction(str(weight)) * total)


def _live(targets: Sequence[Target]) -> list[Target]:
    return [t for t in targets if t.weight > 0]


def _block(patterns: Sequence[Sequence[str]], sizes: Sequence[int], live: Sequence[Target], quotas: Sequence[int]) -> Block:
    place = {t.source: i for i, t in enumerate(live)}
    uses = np.zeros((len(patterns), len(live)), np.int64)
    at = [(i, place[s]) for i, p in enumerate(patterns) for s in p if s in place]
    if at:
        rows, columns = np.array(at).T
        uses[rows, columns] = np.array([max(0, t.max_repeats) for t in live])[columns]
    uses[np.array(sizes) <= 0] = 0
    return Block(np.maximum(np.array(sizes, np.int64), 1), uses, np.array(quotas, np.int64))


def plan_mix(pattern_tokens: Mapping[tuple[str, ...], int], targets: Sequence[Target], total: int) -> Plan:
    """Route pattern tokens to quotas of weight * ``total`` tokens, rounded up.

    A source takes a document ``max_repeats`` times at most, a document of several sources is used as often as the most
    generous of them allows at most. Targets without weight or repeats get nothing.
    """
    live = _live(targets)
    quotas = [_quota(t.weight, total) for t in live]
    patterns = list(pattern_tokens)
    routed: dict[tuple[tuple[str, ...], str], int] = {}
    if not patterns or not live:
        return Plan(total, {t.source: q for t, q in zip(live, quotas, strict=True)}, {t.source: 0 for t in live}, routed)
    block = _block(patterns, [pattern_tokens[p] for p in patterns], live, quotas)
    reached = route(LocalBlocks([block]), quotas).tolist()
    for i, j in zip(*np.nonzero(block.flow)):
        routed[patterns[i], live[j].source] = int(block.flow[i, j])
    return Plan(total, {t.source: q for t, q in zip(live, quotas, strict=True)}, {t.source: r for t, r in zip(live, reached, strict=True)}, routed)


_LINES = "pattern array<string>, source string, _from long, _to long, _size long"


def _intervals(patterns: Sequence[Sequence[str]], sizes: Sequence[int], taken) -> list[tuple[list[str], str, int, int, int]]:
    """The intervals that sources own of each pattern's line; ``taken`` gives the tokens of (number of the pattern, source)."""
    out = []
    for i, (p, size) in enumerate(zip(patterns, sizes, strict=True)):
        at = 0
        for s in p:
            take = taken(i, s)
            if take:
                out.append((list(p), s, at, at + take, size))
                at += take
    return out


def _plan_by_jobs(patterns: DataFrame, targets: Sequence[Target], total: int) -> tuple[Plan, DataFrame]:
    """``plan_mix`` and its intervals over blocks of patterns (pattern, n) that stay in a written table."""
    live = _live(targets)
    quotas = [_quota(t.weight, total) for t in live]
    n_blocks = -(-patterns.count() // BLOCK_PATTERNS)
    spread = patterns.repartition(n_blocks, F.col("pattern"))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        names, sizes = table.column("pattern").to_pylist(), table.column("n").to_pylist()
        state = ([TaskContext.get().partitionId()], [pickle.dumps(_block(names, sizes, live, quotas))], [pickle.dumps((names, sizes))])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(state, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "state", "names"])

    # A block is some BLOCK_PATTERNS rows, spread by a hash of distinct patterns.
    start = materialize(spread.mapInArrow(built, "block int, state binary, names binary"), "blocks")
    blocks = SparkBlocks(start.select("block", "state"))
    reached = route(blocks, quotas).tolist()
    place = {t.source: i for i, t in enumerate(live)}

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state, named in zip(batch.column("state").to_pylist(), batch.column("names").to_pylist(), strict=True):
                block, (names, sizes) = pickle.loads(state), pickle.loads(named)
                rows = _intervals(names, sizes, lambda i, s, block=block: int(block.flow[i, place[s]]) if s in place else 0)
                kinds = (pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(), pa.int64())
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["pattern", "source", "_from", "_to", "_size"])

    intervals = blocks.table.join(start.select("block", "names"), "block").mapInArrow(lines, _LINES)
    plan = Plan(total, {t.source: q for t, q in zip(live, quotas, strict=True)}, {t.source: r for t, r in zip(live, reached, strict=True)}, None)
    return plan, materialize(intervals, "intervals")


def _pattern(names: Sequence[str]):
    """The sorted sources of ``sources`` that have a target."""
    return F.array_sort(F.array_distinct(F.filter("sources", lambda s: s.isin(*names)))) if names else F.array().cast("array<string>")


def plan_of(documents: DataFrame, targets: Sequence[Target]) -> tuple[DataFrame, Plan, DataFrame]:
    """(documents with pattern, the plan, the intervals of the patterns' lines) of ``documents`` (id, sources array, n_tokens)."""
    if len({t.source for t in targets}) != len(targets):
        raise ValueError("targets must be distinct sources")
    spark = documents.sparkSession
    pattern = F.coalesce(_pattern([t.source for t in _live(targets)]), F.array().cast("array<string>"))
    with_pattern = documents.withColumn("pattern", pattern)
    patterns = materialize(with_pattern.groupBy("pattern").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")), "patterns")
    n, total = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n > LOCAL_PATTERNS:
        return with_pattern, *_plan_by_jobs(patterns, targets, total)
    by_pattern = {tuple(r["pattern"]): r["n"] for r in patterns.collect()}
    plan = plan_mix(by_pattern, targets, total)
    names = list(by_pattern)
    lines = _intervals(names, list(by_pattern.values()), lambda i, s: plan.routed.get((names[i], s), 0))
    return with_pattern, plan, spark.createDataFrame(lines, _LINES)


def select(documents: DataFrame, lines: DataFrame, id_column: str, seed: int = 0) -> DataFrame:
    """(id, source, uses) of the documents in the mix; the same for the same seed.

    ``documents`` and ``lines`` are results of ``plan_of``. Ids are unique. A source's tokens differ from what the plan
    routes by less than the largest document at each end of an interval. Documents without tokens are never taken.
    """
    n_lines, buckets = lines.count(), max(LEAST_BUCKETS, -(-documents.count() // BUCKET_DOCUMENTS))
    order = F.xxhash64(F.lit(seed), F.col(id_column))
    placed = documents.where(F.col("n_tokens") > 0).select(id_column, "pattern", "n_tokens", order.alias("_order")).withColumn("_bucket", F.pmod(F.shiftright("_order", 24), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy("pattern", "_bucket").agg(F.sum("n_tokens").alias("_n"))
    upto = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)  # a row per bucket of the pattern
    sizes = sizes.withColumn("_start", F.sum("_n").over(upto) - F.col("_n"))
    # A bucket is cut if an interval ends in it, in any repetition of the line.
    ends = lines.select("pattern", F.explode(F.array(F.col("_from") % F.col("_size"), F.col("_to") % F.col("_size"))).alias("_end")).groupBy("pattern").agg(F.collect_set("_end").alias("_ends"))
    is_cut = F.exists("_ends", lambda e: (e > F.col("_start")) & (e < F.col("_start") + F.col("_n")))
    sizes = sizes.join(ends, "pattern").select("pattern", "_bucket", "_start", is_cut.alias("_cut"))
    joined = placed.join(sizes, ["pattern", "_bucket"])
    inside = Window.partitionBy("pattern", "_bucket").orderBy("_order", id_column).rowsBetween(Window.unboundedPreceding, 0)
    whole = joined.where(~F.col("_cut")).withColumn("_place", F.col("_start"))
    cut = joined.where("_cut").withColumn("_place", F.col("_start") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    # Starts of the document: _place + j * _size for j = 0, 1, ...; those below x: ceil((x - _place) / _size).
    below = lambda x: F.expr(f"CASE WHEN {x} > _place THEN ({x} - _place - 1) div _size + 1 ELSE 0L END")
    all_placed = whole.unionByName(cut).join(F.broadcast(lines) if n_lines <= BROADCAST_INTERVALS else lines, "pattern")
    uses = (below("_to") - below("_from")).cast("long")
    return all_placed.select(id_column, "source", uses.alias("uses"), "n_tokens").where(F.col("uses") > 0)


def report(selected: DataFrame, plan: Plan, targets: Sequence[Target]) -> DataFrame:
    """A row per target: source, target_weight, quota, routed, tokens, share of the mix, most_uses, reachable."""
    spark = selected.sparkSession
    rows = [(t.source, t.weight, plan.quotas.get(t.source, 0), plan.reached.get(t.source, 0)) for t in targets]
    wanted = spark.createDataFrame(rows, "source string, target_weight double, quota long, routed long")
    got = selected.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # a row per source
    return (
        wanted.join(got, "source", "left")
        .fillna(0, ["tokens", "most_uses"])
        .withColumn("_all", all_tokens)
        .select("source", "target_weight", "quota", "routed", "tokens", (F.col("tokens") / F.when(F.col("_all") > 0, F.col("_all"))).alias("share"), "most_uses", (F.col("routed") >= F.col("quota")).alias("reachable"))
    )


def mix(documents: DataFrame, targets: Sequence[Target], id_column: str, seed: int = 0) -> tuple[DataFrame, Plan]:
    """The selected documents and the plan. ``documents`` has id, sources (array) and n_tokens; it is read once."""
    held = materialize(documents.select(id_column, "sources", "n_tokens"), "mix-input")
    with_pattern, plan, lines = plan_of(held, targets)
    return select(with_pattern, lines, id_column, seed), plan
