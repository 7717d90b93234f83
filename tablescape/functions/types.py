"""Type classes of free type strings: ordered, unanchored patterns, the first that is found wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three vocabularies of (class, pattern), in order.
NINE = [
    ("integer", "int|integer|bigint|smallint|tinyint"),
    ("numeric", "decimal|numeric|float|double|real"),
    ("string", "char|varchar|text|string"),
    ("datetime", "date|time|timestamp"),
    ("boolean", "bool|boolean"),
    ("binary", "blob|binary|varbinary"),
    ("json", "json|jsonb"),
    ("uuid", "uuid|guid"),
]
TEN = [
    ("integer", "int|integer|bigint|smallint|tinyint|serial"),
    ("numeric", "decimal|numeric|float|double|real|money"),
    ("string", "char|varchar|text|string|clob"),
    ("datetime", "date|time|timestamp|datetime"),
    ("boolean", "bool|boolean|bit"),
    ("binary", "blob|binary|varbinary|bytea"),
    ("structured", "json|jsonb|xml"),
    ("identifier", "uuid|guid|uniqueidentifier"),
    ("collection", "array|enum|set"),
]
SIX = [
    ("integer", "int|integer|bigint|smallint|tinyint"),
    ("numeric", "decimal|numeric|float|double|real|money"),
    ("string", "char|varchar|text|string"),
    ("datetime", "date|time|timestamp"),
    ("boolean", "bool|boolean"),
]


def type_class(type_: Column, vocabulary: list[tuple[str, str]] = NINE) -> Column:
    """The class of a type string; ``other`` where no pattern is found, null for null."""
    low, out = F.lower(type_), None
    for name, pattern in vocabulary:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.when(type_.isNotNull(), out.otherwise("other"))
