"""Min-cost maximum flow from membership patterns to the quotas of sources.

The network has an arc into each pattern for every use of its tokens, use j at cost j, an arc from a pattern to each of
its sources, and an arc from each source to the sink. What the patterns can supply together is a polymatroid, on which
costs that only rise with the use are least if all first uses are exhausted before any second one, and so on: so the
flow is made level by level, each a maximum flow that goes on from the last, and a pattern that cannot send all of a
level never sends more. Levels that all patterns can still send are taken many at a time, by doubling and halving. Paths are searched on the graph of sources alone: from a to b leads what patterns could move from a to b.

Patterns are held in blocks of numpy arrays. ``LocalBlocks`` has them in memory; ``SparkBlocks`` in a written table, for
more patterns than a driver should hold: each step is then a job, and only sums of a block come back.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.plans.scratch import materialize


class Block:
    """Patterns with their sizes, the uses that each source allows (0: no member), and the flow between them."""

    def __init__(self, size: np.ndarray, uses: np.ndarray, quotas: np.ndarray):
        """Sizes are positive; the quotas add up to less than 2**62."""
        self.size = size.astype(np.int64)
        # No source takes more than its quota, nor all together more than theirs: further uses are not told apart.
        self.room = self.size[:, None] * np.minimum(uses, quotas[None, :] // self.size[:, None] + 1)
        self.most = self.size * np.minimum(uses.max(axis=1, initial=0), quotas.sum() // self.size + 1)
        self.flow = np.zeros_like(self.room)
        self.supply = np.zeros_like(self.size)
        self.open = self.most > 0

    def left(self) -> np.ndarray:
        return self.supply - self.flow.sum(axis=1)

    def is_open(self) -> bool:
        return bool(self.open.any())

    def raise_supply(self, levels: int) -> None:
        self.supply[self.open] = np.minimum(self.most, self.supply + levels * self.size)[self.open]

    def close(self) -> None:
        """Patterns that could not send all of their supply, or have no further uses, are done."""
        used = self.flow.sum(axis=1)
        self.open &= (used == self.supply) & (used < self.most)
        self.supply = np.minimum(self.supply, used)

    def is_full(self) -> bool:
        """Whether all open patterns have sent what they may."""
        return not self.left()[self.open].any()

    def reach(self) -> np.ndarray:
        """By source, the unused supply that could enter it."""
        rows = np.flatnonzero(self.left() > 0)
        return np.minimum(self.left()[rows, None], self.room[rows] - self.flow[rows]).sum(axis=0)

    def moves(self, a: int, to: Sequence[int]) -> np.ndarray:
        """What could move from source a to each of ``to``."""
        rows = np.flatnonzero(self.flow[:, a] > 0)
        picked = np.ix_(rows, list(to))
        return np.minimum(self.flow[rows, a][:, None], self.room[picked] - self.flow[picked]).sum(axis=0)

    def pushable(self, s: int) -> int:
        return int(np.minimum(self.left(), self.room[:, s] - self.flow[:, s]).sum())

    def push(self, s: int, amount: int) -> None:
        self.flow[:, s] += _first(np.minimum(self.left(), self.room[:, s] - self.flow[:, s]), amount)

    def shift(self, a: int, b: int, amount: int) -> None:
        moved = _first(np.minimum(self.flow[:, a], self.room[:, b] - self.flow[:, b]), amount)
        self.flow[:, a] -= moved
        self.flow[:, b] += moved

    def reached(self) -> np.ndarray:
        return self.flow.sum(axis=0)


def _first(available: np.ndarray, amount: int) -> np.ndarray:
    """``amount`` taken from the first of ``available``."""
    before = np.cumsum(available) - available
    return np.clip(amount - before, 0, available)


class LocalBlocks:
    def __init__(self, blocks: list[Block]):
        self.blocks = blocks

    def report(self, f: Callable[[Block], object]) -> list:
        return [f(b) for b in self.blocks]

    def apply(self, f: Callable[[Block, int], None]) -> None:
        for i, b in enumerate(self.blocks):
            f(b, i)

    def state(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(b.flow.copy(), b.supply.copy()) for b in self.blocks]

    def restore(self, state: list[tuple[np.ndarray, np.ndarray]]) -> None:
        for b, (flow, supply) in zip(self.blocks, state, strict=True):
            b.flow, b.supply = flow, supply


class SparkBlocks:
    """Blocks in a written table (block int, state binary). A failed step leaves the table of the step before."""

    SCHEMA = "block int, state binary"

    def __init__(self, table: DataFrame):
        self.table = table
        self.places = {b: i for i, b in enumerate(sorted(r[0] for r in table.select("block").collect()))}  # a number a block

    def report(self, f: Callable[[Block], object]) -> list:
        def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [pickle.dumps(f(pickle.loads(s))) for s in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "state"])

        # A few numbers for each source and block.
        rows = self.table.mapInArrow(reported, self.SCHEMA).collect()
        return [pickle.loads(bytes(r["state"])) for r in sorted(rows, key=lambda r: r["block"])]

    def apply(self, f: Callable[[Block, int], None]) -> None:
        places = self.places

        def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    b = pickle.loads(s)
                    f(b, places[i])
                    out.append(pickle.dumps(b))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["block", "state"])

        self.table = materialize(self.table.mapInArrow(applied, self.SCHEMA), "blocks")

    def state(self) -> DataFrame:
        return self.table

    def restore(self, state: DataFrame) -> None:
        self.table = state


def _allot(parts: Sequence[int], amount: int) -> list[int]:
    return _first(np.array(parts, np.int64), amount).tolist()


def route(blocks: LocalBlocks | SparkBlocks, quotas: Sequence[int]) -> np.ndarray:
    """Make the flow of ``blocks``; returns what each source gets."""
    left = np.array(quotas, np.int64)
    levels, growing = 1, True
    while left.any() and any(blocks.report(Block.is_open)):
        state, before = blocks.state(), left.copy()
        blocks.apply(lambda b, i, levels=levels: b.raise_supply(levels))
        _fill(blocks, left)
        full = all(blocks.report(Block.is_full))
        if not full and levels > 1:  # somewhere on the way a pattern is done
            blocks.restore(state)
            left[:] = before
            growing = False
        else:
            blocks.apply(lambda b, i: b.close())
        if levels == 1 and not full:
            growing = True
        else:
            levels = levels * 2 if growing else max(1, levels // 2)
    return np.array(quotas, np.int64) - left


def _push(blocks, s: int, most: int) -> int:
    parts = blocks.report(lambda b: b.pushable(s))
    amount = min(sum(parts), most)
    if amount:
        shares = _allot(parts, amount)
        blocks.apply(lambda b, i: b.push(s, shares[i]))
    return amount


def _fill(blocks, left: np.ndarray) -> None:
    """A maximum flow from the present one: straight, then along shortest paths over sources. ``left`` is updated."""
    for s in np.argsort(-left, kind="stable").tolist():
        if left[s] > 0:
            left[s] -= _push(blocks, s, int(left[s]))
    rows: dict[int, np.ndarray] = {}
    while left.any():
        reach = sum(blocks.report(Block.reach))
        path = _path(blocks, rows, reach, left)
        if path is None:
            return
        amount = min([int(reach[path[0]]), int(left[path[-1]])] + [int(rows[a][b]) for a, b in zip(path, path[1:])])
        for a, b in reversed(list(zip(path, path[1:]))):  # the last move first makes room for the one before
            shares = _allot(blocks.report(lambda x, a=a, b=b: int(x.moves(a, [b])[0])), amount)
            blocks.apply(lambda x, i, a=a, b=b, shares=shares: x.shift(a, b, shares[i]))
        _push(blocks, path[0], amount)
        left[path[-1]] -= amount
        touched = sorted(set(path))
        for a in list(rows):
            if a in touched:
                del rows[a]
            else:
                rows[a][touched] = sum(blocks.report(lambda x, a=a: x.moves(a, touched)))


def _path(blocks, rows: dict[int, np.ndarray], reach: np.ndarray, left: np.ndarray) -> list[int] | None:
    """Shortest path from a source that unused supply can enter to one with quota left; ``rows`` keeps what could move."""
    n = len(left)
    via: dict[int, int] = {int(s): -1 for s in np.flatnonzero(reach > 0)}
    queue = list(via)
    for a in queue:
        if left[a] > 0:
            path = [a]
            while via[path[-1]] >= 0:
                path.append(via[path[-1]])
            return path[::-1]
        if a not in rows:
            rows[a] = sum(blocks.report(lambda x, a=a: x.moves(a, range(n))))
        for b in np.flatnonzero(rows[a] > 0).tolist():
            if b not in via and b != a:
                via[b] = a
                queue.append(b)
    return None
