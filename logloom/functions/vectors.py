"""Arithmetic on array<double> columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .base import col, let
from .templates import words


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda acc, x: acc + x * x))


def member_cosine(member, centroid, centroid_norm) -> Column:
    """Cosine with the guard used for cluster confidence: a zero centroid
    counts as full confidence."""
    n = col(centroid_norm)
    return (F.when(n == 0, F.lit(1.0))
             .otherwise(dot(member, centroid) / (norm(member) * n + F.lit(1e-9))))


def centroid_distance(member, centroid, centroid_norm) -> Column:
    """One minus cosine; zero when either vector is zero or absent."""
    size = F.nullif(norm(member) * col(centroid_norm), F.lit(0.0))
    return F.coalesce(F.lit(1.0) - dot(member, centroid) / size, F.lit(0.0))


def squared_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def run_lengths(values) -> Column:
    """Distinct array values with their counts, as structs (value, n)."""
    def of_sorted(s):
        marks = F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i))
        return let(F.filter(marks, lambda m: m.isNotNull()), lambda at: F.transform(
            at, lambda p, j: F.struct(
                F.get(s, p).alias("value"),
                (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("n"))))

    return let(F.array_sort(col(values)), of_sorted)


def word_slots(text, dims: int = S.HASH_DIMS) -> Column:
    """Slot number of every word: its hash modulo ``dims``.

    The last eight hex digits settle both the slot and the sign as long as
    ``dims`` is a power of two.
    """
    if dims < 2 or dims & (dims - 1):
        raise ValueError("dims must be a power of two")
    return F.transform(
        words(text),
        lambda w: F.conv(F.right(F.md5(w), F.lit(8)), 16, 10).cast("long")
                   .bitwiseAND(F.lit(dims - 1).cast("long")).cast("int"))


def hash_embedding(text, dims: int = S.HASH_DIMS) -> Column:
    """Signed word-hash vector of length one, computed inside the row.

    An even hash adds one and an odd hash subtracts one, so with an even
    ``dims`` the sign belongs to the slot.
    """
    signs = F.lit([1.0 if d % 2 == 0 else -1.0 for d in range(dims)])

    def dense(counts):
        length = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda acc, x: acc + x * x))
        return let(length, lambda n: F.transform(
            signs, lambda sign, d: F.coalesce(
                sign * F.try_element_at(counts, d) / n, F.lit(0.0))))

    return let(F.map_from_entries(run_lengths(word_slots(text, dims))), dense)
