"""Text functions over columns. All but the Jaro-Winkler similarity are built-in expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that a diagram keeps as they are, and words that it reserves.
KEPT_NAMES = ["Campaign", "EntityGroup", "User", "File", "Giver", "PaymentTransaction", "Opportunity", "CampaignDonation", "CampaignAsset", "EntityGroupUser", "EntityGroupAPI", "EntityGroupAsset"]
RESERVED = ["erDiagram", "PK", "FK", "int", "string", "boolean", "date"]
# Words that make an error message sensitive.
SENSITIVE = ["password", "secret", "token", "key", "auth", "credential", "connection string", "database", "sql"]
# Business names by the first term that a table name contains, in order.
BUSINESS_TERMS = [
    ("campaign", "Campaign Management"), ("user", "User Management"), ("member", "Membership"), ("donation", "Donation Processing"), ("gift", "Gift Management"),
    ("giver", "Donor Relations"), ("volunteer", "Volunteer Management"), ("event", "Event Management"), ("organization", "Organization"), ("organisation", "Organization"),
    ("entitygroup", "Organization"), ("programme", "Programme Management"), ("program", "Program Management"), ("payment", "Payment Processing"),
    ("transaction", "Transaction Processing"), ("contact", "Contact Management"), ("account", "Account Management"), ("finance", "Financial Management"),
    ("report", "Reporting"), ("audit", "Audit & Compliance"), ("system", "System Configuration"), ("admin", "Administration"), ("log", "Logging & Monitoring"),
    ("file", "File Management"), ("opportunity", "Opportunity Management"),
]


def normalize_header(c: Column) -> Column:
    """Trimmed, lower-cased, each run of white space an underscore."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "_")


def sanitize_identifier(c: Column) -> Column:
    """A diagram's table name: other characters than letters, digits and _ become _, a leading digit gets ``Table_``, empty is ``Unknown``, reserved words (in any case) get a trailing _."""
    clean = F.regexp_replace(c, "[^a-zA-Z0-9_]", "_")
    clean = F.when(clean.rlike("^[0-9]"), F.concat(F.lit("Table_"), clean)).otherwise(clean)
    reserved = F.lower(clean).isin([w.lower() for w in RESERVED])
    return F.when(c.isNull() | (c == ""), "Unknown").when(c.isin(KEPT_NAMES), c).when(reserved, F.concat(clean, F.lit("_"))).otherwise(clean)


def domain_key(c: Column) -> Column:
    """Lower-cased letters, digits and single underscores for white space, 50 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", "_"), 1, 50)


def sanitize_input(c: Column) -> Column:
    """Without angle brackets and control characters, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[<>]", ""), r"[\x00-\x1F\x7F]", ""))


def sanitize_filename(c: Column) -> Column:
    """Characters that file systems refuse become _, leading dots go, 255 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"^\.+", ""), 1, 255)


# What is redacted in a message, and what stands in its place.
REDACTIONS = [
    (r"/Users/[^/]+/[^\s]+", "[REDACTED_PATH]"), (r"/home/[^/]+/[^\s]+", "[REDACTED_PATH]"), (r"C:\\[^\s]+", "[REDACTED_PATH]"),
    (r"at [^\s]+ \([^)]+\)", "at [REDACTED_FUNCTION]"),
]


def redact_error(c: Column) -> Column:
    """A message fit for users: sensitive ones are replaced whole, paths and stack frames redacted, 200 characters at most."""
    out = c
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, to)
    out = F.substring(out, 1, 200)
    return (
        F.when(c.isNull() | (c == ""), "Unknown error")
        .when(F.lower(c).rlike("|".join(SENSITIVE)), "Internal system error - details withheld for security")
        .otherwise(F.when(out == "", "Unknown error occurred").otherwise(out))
    )


def camel_words(c: Column) -> Column:
    """A space before each capital, trimmed."""
    return F.trim(F.regexp_replace(c, "([A-Z])", " $1"))


def business_name(c: Column) -> Column:
    """The name of the first business term that the table name contains; else the name with a capital and spaces for _ and -."""
    low, out = F.lower(c), F.when(c.isNull() | (c == ""), "General")
    for term, name in BUSINESS_TERMS:
        out = out.when(low.contains(term), name)
    return out.otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.regexp_replace(F.substring(c, 2, 1 << 20), "[_-]", " ")))


def string_hash(c: Column) -> Column:
    """The 32-bit hash h = 31 h + code over the characters, wrapped, then its absolute value."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: wrap(h * 31 + x)))


def hash_embedding(c: Column, dimensions: int = 384) -> Column:
    """Array of doubles: the i-th (from 0) word of over two characters adds 1/(i+1) at its hash; normalised to length 1, all zero without words."""
    words = F.filter(F.split(F.lower(c), r"\W+"), lambda w: F.length(w) > 2)
    places = F.transform(words, lambda w, i: F.struct((string_hash(w) % dimensions).cast("int").alias("at"), (F.lit(1.0) / (i + 1)).alias("w")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(places, lambda p: p["at"] == d), F.lit(0.0), lambda a, p: a + p["w"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def sql_block(c: Column) -> Column:
    """The first fenced SQL block, trimmed; null without one."""
    found = F.regexp_extract(c, r"(?s)```sql\s*(.*?)\s*```", 1)
    return F.when(found != "", F.trim(found))


def list_items(c: Column, most: int = 5) -> Column:
    """The first items of numbered and bulleted lists."""
    return F.slice(F.transform(F.regexp_extract_all(c, F.lit(r"(?m)^\s*(?:[-*•]|\d+\.)\s+(.+)$"), F.lit(1)), F.trim), 1, most)


def bold_sections(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))


def arrow_description(c: Column) -> Column:
    """(source, target) of a relationship's description: ``a -> b``, else ``FK column``."""
    a, b = F.regexp_extract(c, r"(\w+)\s*->\s*(\w+)", 1), F.regexp_extract(c, r"(\w+)\s*->\s*(\w+)", 2)
    fk = F.regexp_extract(c, r"(?i)\bFK\s+(\w+)", 1)
    null = F.lit(None).cast("string")
    return F.struct(F.when(a != "", a).when(fk != "", fk).otherwise(null).alias("source"), F.when(b != "", b).otherwise(null).alias("target"))


def response_confidence(c: Column) -> Column:
    """0.7, more for SQL, markup and length, less for hedging; held to 0.3 to 0.95."""
    low = F.lower(c)
    score = F.lit(0.7) + F.when(c.contains("```sql"), 0.1).otherwise(0.0) + F.when(c.contains("**") | c.contains("##"), 0.05).otherwise(0.0) + F.when(F.length(c) > 500, 0.1).otherwise(0.0) - F.when(low.contains("might") | low.contains("possibly"), 0.1).otherwise(0.0)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.3), score))


def sql_speed(c: Column) -> Column:
    """fast, medium or slow by the joins, subqueries and aggregates of SQL text."""
    low = F.lower(c)
    joins, subs = F.regexp_count(low, F.lit("join")), F.regexp_count(low, F.lit(r"\(select"))
    return F.when((joins > 3) | (subs > 1), "slow").when((joins > 1) | (subs > 0) | low.rlike("count|sum|avg|max|min"), "medium").otherwise("fast")


def sql_confidence(c: Column) -> Column:
    low = F.lower(c)
    score = F.lit(0.8) + F.when(low.contains("select") & low.contains("from"), 0.1).otherwise(0.0) + F.when(low.contains("join"), 0.1).otherwise(0.0) + F.when(low.contains("where"), 0.05).otherwise(0.0)
    return F.least(F.lit(0.95), score)


def sql_tips(c: Column) -> Column:
    """Array of tips on SQL text."""
    low = F.lower(c)
    tips = F.array(
        F.when(low.contains("select *"), "Consider selecting only needed columns instead of using SELECT *"),
        F.when(F.regexp_count(low, F.lit("join")) > 2, "Consider adding indexes on join columns for better performance"),
        F.when(low.contains("where") & ~low.contains("index"), "Ensure WHERE clause columns have appropriate indexes"),
    )
    return F.array_compact(tips)


def characters(c: Column) -> Column:
    """The distinct characters of a name in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != ""))


def is_inactive(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("inactive", "disabled", "false", "0", "no", "n")


def is_truthy(c: Column) -> Column:
    """True for true, yes, 1, y and on in any case; else false, null too."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "yes", "1", "y", "on"), F.lit(False))


def _jaro_winkler(a: str, b: str, floored: bool) -> float:
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (y for y, t in zip(b, taken) if t)))
    t = moved // 2 if floored else moved / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def counted_characters(c: Column) -> Column:
    """The characters of a name in lower case, each with its count so far: two names share as many of these as characters, repeats included."""
    chars = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))


def jaro_winkler_bound(a: Column, b: Column, shared: Column) -> Column:
    """What ``jaro_winkler`` can give at most for names that share so many characters; built-in expressions, for a filter before it."""
    x, y = F.lower(a), F.lower(b)
    jaro = (shared / F.length(x) + shared / F.length(y) + 1) / 3
    prefix = sum((F.when((F.length(x) >= n) & (F.substring(x, 1, n) == F.substring(y, 1, n)), 1).otherwise(0) for n in range(1, 5)), F.lit(0))
    return F.when(shared == 0, F.lit(0.0)).otherwise(jaro + prefix * 0.1 * (1 - jaro))


def jaro_winkler(a: Column, b: Column, compat: bool = False) -> Column:
    """Case-insensitive Jaro-Winkler similarity; ``compat`` keeps half transpositions. Null for null."""

    @F.pandas_udf("double")
    def similarity(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _jaro_winkler(p, q, not compat) for p, q in zip(x, y)], dtype="float64")

    return similarity(a, b)
