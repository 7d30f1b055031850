"""Vector functions over columns of array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def doubles(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(c: Column) -> Column:
    return F.sqrt(_sum(F.transform(c, lambda x: x * x)))


def l2_normalize(c: Column, eps: float = 1e-12) -> Column:
    """c over its norm; a zero vector stays."""
    n = F.greatest(norm(c), F.lit(eps))
    return F.transform(c, lambda x: x / n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def truncate(c: Column, width: int) -> Column:
    """The first components, normalized."""
    return l2_normalize(F.slice(c, 1, width))


def last_token(states: Column, mask: Column, left_padded: Column) -> Column:
    """The state of the last token: the last of all in a left-padded batch, else that at the mask's sum."""
    return F.when(left_padded, F.element_at(states, -1)).otherwise(F.element_at(states, F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))))


def linear(c: Column, weights: list[list[float]]) -> Column:
    """Each row of weights times c."""
    return F.array(*(dot(c, F.array(*map(F.lit, row))) for row in weights))


def mlp(c: Column, layers: list[list[list[float]]], normalize: bool = False) -> Column:
    """Bias-free layers with rectifiers between; a vector of another width than the first layer's ends the query."""
    c = checked(c, len(layers[0][0]))
    for i, weights in enumerate(layers):
        c = linear(c, weights)
        if i + 1 < len(layers):
            c = F.transform(c, lambda x: F.greatest(x, F.lit(0.0)))
    return l2_normalize(c) if normalize else c


def checked(c: Column, width: int) -> Column:
    """c; a row of another width ends the query."""
    return F.when(F.size(c) == width, c).otherwise(F.raise_error(F.lit(f"vectors must have width {width}")).cast("array<double>"))


def safe_divide(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return a / F.greatest(b, F.lit(eps))
