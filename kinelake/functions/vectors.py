"""Functions on joint vectors (``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def widen(vector: Column) -> Column:
    return vector.cast("array<double>")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INFINITY))


def all_finite(vector: Column) -> Column:
    return F.forall(vector, is_finite)


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def vec_norm(vector: Column) -> Column:
    return F.sqrt(total(F.transform(widen(vector), lambda x: x * x)))


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(widen(a), widen(b), lambda x, y: x - y)


def vec_absdiff(a: Column, b: Column) -> Column:
    return F.zip_with(widen(a), widen(b), lambda x, y: F.abs(x - y))


def vec_distance(a: Column, b: Column) -> Column:
    return vec_norm(vec_sub(a, b))


def vec_argmax(vector: Column) -> Column:
    """Position of the first maximum, -1 for an empty vector."""
    return F.when(F.size(vector) > 0, F.array_position(vector, F.array_max(vector)).cast("int") - 1).otherwise(F.lit(-1))


def without(vector: Column, position: Column) -> Column:
    """The vector minus one position (the arm, when the position is the gripper's)."""
    return F.filter(vector, lambda _, i: i != position)


def named(vector: Column, names: Column) -> Column:
    """Joint name -> value map; a name beyond the vector's width is dropped, as is a surplus value."""
    width = F.least(F.size(names), F.size(vector))
    return F.map_from_arrays(F.slice(names, F.lit(1), width), F.slice(widen(vector), F.lit(1), width))


def pick(values: Column, names: Column) -> Column:
    """Values of a joint map in the given order; a joint without a value reads 0."""
    return F.transform(names, lambda n: F.coalesce(F.element_at(values, n), F.lit(0.0)))
