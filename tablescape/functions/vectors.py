"""Vector and distribution functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0 or lengths differ."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets; ``empty`` where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(empty))


def distribution_cosine(a: Column, b: Column) -> Column:
    """Cosine of two map<string,double> distributions; both empty give 1, one empty 0."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0.0))
    total = lambda f: F.aggregate(F.transform(keys, f), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(total(lambda k: at(a, k) * at(a, k))) * F.sqrt(total(lambda k: at(b, k) * at(b, k)))
    return F.when(F.size(keys) == 0, F.lit(1.0)).when(size > 0, total(lambda k: at(a, k) * at(b, k)) / size).otherwise(F.lit(0.0))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance sqrt(JSD / ln 2) of two map<string,double> distributions."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    at = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0.0))

    def part(k):
        p, q = at(a, k), at(b, k)
        m = (p + q) / 2
        half = lambda x: F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0))
        return (half(p) + half(q)) / 2

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.transform(keys, part), F.lit(0.0), lambda s, x: s + x)) / F.log(F.lit(2.0)))
