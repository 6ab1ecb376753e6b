"""Vectors as Spark columns: dot products and a deterministic projection of words to buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the projection: buckets, and how a word's weight falls with its place.
DIMENSION, DECAY = 768, 0.1


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def is_valid(a: Column, size: int) -> Column:
    """Of the right length, and all values finite."""
    return a.isNotNull() & (F.size(a) == size) & F.forall(a, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def bucket(word: Column) -> Column:
    """MD5 of the word as a number, modulo 768 = 256 * 3.

    256 leaves the last byte. By 3 every power of 16 leaves 1, so parts of the hex number may be added.
    """
    h = F.md5(word)
    low = F.conv(F.substring(h, 31, 2), 16, 10).cast("int")
    by_3 = sum(F.conv(F.substring(h, a, n), 16, 10).cast("long") % 3 for a, n in ((1, 14), (15, 14), (29, 4)))
    return (low + 256 * F.pmod(by_3 - low, F.lit(3))).cast("int")


def bucket_value(word: Column) -> Column:
    """(MD5 >> 16) modulo 1000, scaled to [-1, 1): in two parts of 56 bits, where 2 ** 56 leaves 936 by 1000."""
    h = F.md5(word)
    high, low = (F.conv(F.substring(h, a, 14), 16, 10).cast("long") % 1000 for a in (1, 15))
    return ((high * 936 + low) % 1000) / F.lit(500.0) - 1.0
