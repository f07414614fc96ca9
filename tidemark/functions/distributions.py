"""Distributions of records over partitions and rounds: plain numbers on the driver, and a column that draws from them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes on disk for a byte of record, as the file-size rule assumes.
COMPRESSION = 0.66
ZIPF_SHAPE = 2.93


def normalise(weights: Sequence[float]) -> list[float]:
    total = math.fsum(weights)
    if total <= 0 or min(weights) < 0:
        raise ValueError("weights must be non-negative and not all zero")
    return [w / total for w in weights]


def uniform(n: int) -> list[float]:
    return [1.0 / n] * n


def exponential(rate: float, n: int) -> list[float]:
    return normalise([math.exp(-rate * i) for i in range(n)])


def cdf(weights: Sequence[float]) -> list[float]:
    """Running sums; the last is 1 exactly, so every draw in [0, 1) falls into a bucket."""
    sums = list(accumulate(weights))
    return [*sums[:-1], 1.0]


def draw(steps: Sequence[float], u: float) -> int:
    """The first bucket whose running sum is not below u; -1 if u is above all."""
    return next((i for i, s in enumerate(steps) if u <= s), -1)


def draw_column(steps: Sequence[float], u: Column) -> Column:
    """draw() as a column. Beyond 64 buckets it looks for the block first, so that a row compares about 2 * sqrt(n) numbers."""
    below = lambda values, x: F.size(F.filter(values, lambda s: s < x))
    numbers = F.array(*(F.lit(float(s)) for s in steps))
    if len(steps) <= 64:
        return below(numbers, u)
    width = math.isqrt(len(steps)) + 1
    ends = F.array(*(F.lit(float(steps[min(i + width, len(steps)) - 1])) for i in range(0, len(steps), width)))
    block = below(ends, u)
    return block * width + below(F.slice(numbers, block * width + 1, width), u)


def zipf_quotas(n: int, buckets: int, shape: float = ZIPF_SHAPE) -> list[int]:
    """Quotas proportional to rank ** -shape, rounded down, 1 at least, largest first. Their sum may differ from n."""
    parts = normalise([(r + 1) ** -shape for r in range(buckets)])
    return sorted((max(1, int(n * p)) for p in parts), reverse=True)


def exact_zipf_quotas(n: int, buckets: int, shape: float = ZIPF_SHAPE) -> list[int]:
    """zipf_quotas with the sum n: what lacks goes to the largest; what is over is taken from the smallest, down to 0."""
    quotas = zipf_quotas(n, buckets, shape)
    over = sum(quotas) - n
    if over < 0:
        quotas[0] -= over
    for i in range(buckets - 1, -1, -1):
        cut = min(max(over, 0), quotas[i])
        quotas[i], over = quotas[i] - cut, over - cut
    return quotas


def distribution_matrix(rounds: int, partitions: int, matrix: Sequence[Sequence[float]] | None = None) -> list[list[float]]:
    """A row of insert weights for each round: the given ones, checked, or uniform ones. Rounds beyond a given matrix repeat its last row."""
    if matrix is None:
        return [uniform(max(1, partitions)) for _ in range(rounds)]
    if not matrix:
        raise ValueError("the matrix has no rows")
    width = len(matrix[0])
    if partitions > 0 and width != partitions:
        raise ValueError(f"the matrix has {width} columns for {partitions} partitions")
    for row in matrix:
        if len(row) != width or abs(math.fsum(row) - 1) > 1e-5 or min(row) < 0:
            raise ValueError("each row of the matrix must have the same width and sum to 1")
    return [list(matrix[min(r, len(matrix) - 1)]) for r in range(rounds)]


def split_round(round_no: int, n: int, update_ratio: float, partitions_to_update: int) -> tuple[int, int]:
    """Inserts and updates of a round. Updates need earlier rounds and partitions to update, and no more keys than there are."""
    updates = 0 if round_no == 0 or partitions_to_update <= 0 else min(int(update_ratio * n), round_no * n)
    return n - updates, updates


def file_count(records: int, record_size: int, file_size: int) -> int:
    """Files of about file_size bytes for so many records, two at least."""
    return max(2, int(records / max(1.0, file_size / (record_size * COMPRESSION))))


def padded(values: Sequence, n: int) -> list:
    """The first n values; the last one repeats."""
    if not values:
        raise ValueError("no values")
    return [values[min(i, len(values) - 1)] for i in range(n)]
