"""Vectors, sparse maps and 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, epsilon: float = 1e-8) -> Column:
    """a over its length plus epsilon, in double."""
    return F.transform(F.array(norm(a) + epsilon), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs; 999 if one is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(999))


def sign_hash(a: Column) -> Column:
    """The signs of the first 64 entries as the bits of a long, first entry lowest."""
    bits = F.transform(F.slice(a, 1, 64), lambda x, i: F.when(x >= 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bits), F.expr("0L"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of sparse maps, a missing key being 0; 0 if one has no length (or is null)."""
    a, b = (F.coalesce(m, F.create_map().cast("map<string,double>")) for m in (a, b))
    square = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    both = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k), F.lit(0.0)) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    n = square(a) * square(b)
    return F.when(n == 0, 0.0).otherwise(both / n)
