"""The cost model behind access paths and EXPLAIN: estimates in abstract units, from exact table statistics."""

from __future__ import annotations

import math

# Cost per row (or per row and level, per pair, per level) and default shares.
SEQ_ROW = 1.0
RANDOM_ACCESS_ROW = 4.0
TREE_LEVEL = 2.0
RANGE_SELECTIVITY = 0.3
FILTER_SELECTIVITY = 0.5
FILTER_ROW = 0.2
PROJECT_ROW = 0.05
HASH_ROW = 1.0
NESTED_LOOP_PAIR = 1.0
SORT_ROW_LEVEL = 0.5
AGGREGATE_ROW = 1.5
GROUP_SHARE = 0.1


def seq_scan(rows: float) -> float:
    return rows * SEQ_ROW


def index_scan(rows: float, share: float) -> float:
    return TREE_LEVEL * math.log2(max(rows, 2)) + rows * share * RANDOM_ACCESS_ROW


def selectivity(op: str, distinct: int) -> float:
    """The share of rows that a comparison of a column with a value keeps."""
    if op == "=":
        return 1.0 / max(distinct, 1)
    return 1.0 - 1.0 / max(distinct, 1) if op == "!=" else RANGE_SELECTIVITY


def join_rows(left: float, right: float, left_distinct: int, right_distinct: int) -> float:
    return left * right / max(left_distinct, right_distinct, 1)


def hash_join(left: float, right: float) -> float:
    return (left + right) * HASH_ROW


def nested_loop_join(left: float, right: float) -> float:
    return left * right * NESTED_LOOP_PAIR


def sort(rows: float) -> float:
    return rows * SORT_ROW_LEVEL * math.log2(max(rows, 2))


def group_rows(rows: float, keyed: bool) -> float:
    return max(1.0, rows * GROUP_SHARE) if keyed else 1.0


def parallel_aggregate(rows: float, degree: int) -> float:
    return (rows * SEQ_ROW + rows * AGGREGATE_ROW) / max(degree, 1)
