"""Array expressions over scores, embeddings and token matrices."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.rules import lookup


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda an outer expression would be computed again for every
    array element; a one-element array keeps it to once.
    """
    return F.transform(F.array(value), body)[0]


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def argmax(scores: Column) -> Column:
    """Zero-based position of the largest score, the first one on ties."""
    return F.array_position(scores, F.array_max(scores)) - 1


def argmax_label(scores: Column, labels: Mapping[int, str]) -> Column:
    """Label of the largest score; the position as text where it has no label."""
    position = argmax(scores)
    return lookup(position.cast("int"), labels, position.cast("string"))


def softmax(scores: Column) -> Column:
    def shares(powers: Column) -> Column:
        return _bind(_total(powers), lambda total: F.transform(powers, lambda x: x / total))

    values = _doubles(scores)
    powers = _bind(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return _bind(powers, shares)


def sigmoid(scores: Column) -> Column:
    return F.transform(_doubles(scores), lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(-x)))


def l2_normalize(vector: Column) -> Column:
    """Vector over its Euclidean norm; null for a zero vector."""
    values = _doubles(vector)
    norm = F.sqrt(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x))
    return _bind(norm, lambda n: F.when(n > 0, F.transform(values, lambda x: x / n)))


def mean_pool(tokens: Column) -> Column:
    """Mean over the rows of a token matrix."""

    def average(rows: Column) -> Column:
        zero = F.transform(rows[0], lambda x: F.lit(0.0))
        total = F.aggregate(rows, zero, lambda acc, row: F.zip_with(acc, row, lambda a, b: a + b))
        return _bind(F.size(rows), lambda n: F.transform(total, lambda x: x / n))

    return F.when(F.size(tokens) > 0, _bind(tokens.cast("array<array<double>>"), average))


def to_matrix(vector: Column, width: int) -> Column:
    """A flat vector cut into rows of ``width``."""
    starts = F.sequence(F.lit(1), F.size(vector), F.lit(width))
    return F.transform(starts, lambda start: F.slice(vector, start, width))


def flatten(nested: Column) -> Column:
    return F.flatten(nested)
