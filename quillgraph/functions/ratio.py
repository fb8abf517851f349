"""Similarity of labels: 200 times the longest common subsequence, by the sum of lengths.

This is the normalised indel similarity. The dynamic programme is an expression of nested
aggregates over arrays, so it runs in the JVM beside the join that it filters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays."""
    zeros = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(previous: Column, x: Column) -> Column:
        def cell(built: Column, j: Column) -> Column:
            up, left, corner = F.get(previous, j), F.get(built, j - 1), F.get(previous, j - 1)
            return F.concat(built, F.array(F.when(F.get(b, j - 1) == x, corner + 1).otherwise(F.greatest(up, left))))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(0)), cell)

    last = F.aggregate(a, zeros, row)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0)).otherwise(F.element_at(last, -1))


def ratio(a: Column, b: Column) -> Column:
    """0 to 100; two empty texts are equal."""
    n = F.length(a) + F.length(b)
    return F.when(a == b, F.lit(100.0)).otherwise(200.0 * common_length(characters(a), characters(b)) / n)


def indel_ratio(a: str, b: str) -> float:
    """The same for two Python strings, where an order-dependent step needs it."""
    if a == b:
        return 100.0
    previous = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(previous[j - 1] + 1 if x == y else max(previous[j], row[-1]))
        previous = row
    return 200.0 * previous[-1] / (len(a) + len(b))
