"""Query specifications over a catalog: join paths, execution as DataFrames, SQL text, cost class, lint and rewriting.

A specification is data; it becomes DataFrame calls that Spark plans. No SQL
is parsed here.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Join:
    left: str
    left_column: str
    right: str
    right_column: str
    how: str = "inner"  # inner, left, right, full


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str  # = != > < >= <= LIKE IN BETWEEN
    value: object
    table: str | None = None


@dataclass(frozen=True)
class QuerySpec:
    tables: list[str]
    columns: list[str] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    conditions: list[Condition] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    aggregates: dict[str, tuple[str, str]] = field(default_factory=dict)  # name -> (function, expression)
    order_by: list[tuple[str, str]] = field(default_factory=list)
    limit: int | None = None


def join_path(start: str, end: str, keys: list[tuple[str, str, str, str]]) -> list[Join]:
    """The joins of a shortest path over foreign keys in either direction; of equal ones the first by key order. Empty if there is none.

    The foreign keys are the catalog's metadata, not rows.
    """
    before, queue = {start: None}, deque([start])
    while queue and end not in before:
        at = queue.popleft()
        for st, sc, tt, tc in keys:
            for a, ac, b, bc in ((st, sc, tt, tc), (tt, tc, st, sc)):
                if a == at and b not in before:
                    before[b] = Join(a, ac, b, bc)
                    queue.append(b)
    out, at = [], end
    while before.get(at) is not None:
        out.append(before[at])
        at = before[at].left
    return out[::-1]


def condition(c: Condition) -> Column:
    """The predicate with typed literals. BETWEEN without two values is equality, IN with one value a list of it."""
    col, v = F.col(c.column), c.value
    match c.operator.upper():
        case "=":
            return col == F.lit(v)
        case "!=":
            return col != F.lit(v)
        case ">":
            return col > F.lit(v)
        case "<":
            return col < F.lit(v)
        case ">=":
            return col >= F.lit(v)
        case "<=":
            return col <= F.lit(v)
        case "LIKE":
            return col.like(str(v))
        case "IN":
            return col.isin(list(v) if isinstance(v, (list, tuple, set)) else [v])
        case "BETWEEN":
            if isinstance(v, (list, tuple)) and len(v) == 2:
                return col.between(v[0], v[1])
            return col == F.lit(v[0] if isinstance(v, (list, tuple)) else v)
    raise ValueError(f"unknown operator {c.operator}")


def execute(spec: QuerySpec, tables: dict[str, DataFrame]) -> DataFrame:
    """The specification as a DataFrame. Conditions on a table are filters below its join; Spark pushes them to the scan."""
    def part(name: str) -> DataFrame:
        df = tables[name]
        for c in spec.conditions:
            if c.table == name or c.table is None and c.column in df.columns:
                df = df.where(condition(c))
        return df

    df = part(spec.tables[0])
    have = {spec.tables[0]}
    for j in spec.joins:
        right = part(j.right)
        if j.left_column == j.right_column:
            df = df.join(right, j.left_column, j.how)
        else:
            df = df.join(right, F.col(j.left_column) == F.col(j.right_column), j.how)
        have.add(j.right)
    missing = [t for t in spec.tables if t not in have]
    if missing:
        raise ValueError(f"no join reaches {missing}")
    if spec.group_by or spec.aggregates:
        df = df.groupBy(*spec.group_by).agg(*[F.expr(f"{f}({e})").alias(n) for n, (f, e) in spec.aggregates.items()] or [F.count("*").alias("n")])
    elif spec.columns:
        df = df.select(*[c.rpartition(".")[2] for c in spec.columns])
    if spec.order_by:
        df = df.orderBy(*[F.desc(c) if d.upper() == "DESC" else F.asc(c) for c, d in spec.order_by])
    return df.limit(spec.limit) if spec.limit else df


def _text(v: object) -> str:
    return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"


def to_sql(spec: QuerySpec) -> str:
    """The specification as SQL text, values quoted as their type needs."""
    first = spec.tables[0]
    cols = ", ".join([*spec.group_by, *(f"{f}({e}) AS {n}" for n, (f, e) in spec.aggregates.items())]) if spec.group_by or spec.aggregates else ", ".join(c if "." in c else f"{first}.{c}" for c in spec.columns) or "*"
    lines = [f"SELECT {cols}", f"FROM {first}"]
    lines += [f"{j.how.upper()} JOIN {j.right} ON {j.left}.{j.left_column} = {j.right}.{j.right_column}" for j in spec.joins]
    said = []
    for c in spec.conditions:
        name, v = f"{c.table or first}.{c.column}", c.value
        if c.operator.upper() == "IN":
            said.append(f"{name} IN ({', '.join(map(_text, v if isinstance(v, (list, tuple, set)) else [v]))})")
        elif c.operator.upper() == "BETWEEN" and isinstance(v, (list, tuple)) and len(v) == 2:
            said.append(f"{name} BETWEEN {_text(v[0])} AND {_text(v[1])}")
        else:
            said.append(f"{name} {'=' if c.operator.upper() == 'BETWEEN' else c.operator} {_text(v[0] if isinstance(v, (list, tuple)) else v)}")
    if said:
        lines.append("WHERE " + " AND ".join(said))
    if spec.group_by:
        lines.append("GROUP BY " + ", ".join(spec.group_by))
    if spec.order_by:
        lines.append("ORDER BY " + ", ".join(f"{c} {d.upper()}" for c, d in spec.order_by))
    if spec.limit:
        lines.append(f"LIMIT {spec.limit}")
    return "\n".join(lines)


def cost(spec: QuerySpec) -> tuple[int, str]:
    """2 a table, 5 a join, 10 more for joins beyond the first, 2 a condition, 3 more for LIKE and IN, 5 a group: below 10 fast, below 25 medium."""
    n = 2 * len(spec.tables) + 5 * len(spec.joins) + 10 * max(0, len(spec.joins) - 1) + 2 * len(spec.conditions) + 3 * sum(c.operator.upper() in ("LIKE", "IN") for c in spec.conditions) + 5 * bool(spec.group_by)
    return n, "fast" if n < 10 else "medium" if n < 25 else "slow"


def lint(spec: QuerySpec) -> list[str]:
    out = []
    if len(spec.tables) > 1 and len(spec.joins) < len(spec.tables) - 1:
        out.append("tables without a join make a Cartesian product")
    if not spec.columns and not spec.group_by:
        out.append("all columns are selected")
    out += [f"LIKE without a wildcard on {c.column}" for c in spec.conditions if c.operator.upper() == "LIKE" and not set("%_") & set(str(c.value))]
    if spec.order_by and not spec.limit:
        out.append("an order without a limit sorts everything")
    return out


def without_duplicate_joins(spec: QuerySpec) -> QuerySpec:
    """Without joins on a pair of columns that an earlier join has, in either direction; equality conditions first, LIKE last."""
    seen, joins = set(), []
    for j in spec.joins:
        key = frozenset([(j.left, j.left_column), (j.right, j.right_column)])
        if key not in seen:
            joins.append(j)
        seen.add(key)
    rank = lambda c: 0 if c.operator == "=" else 2 if c.operator.upper() == "LIKE" else 1
    return replace(spec, joins=joins, conditions=sorted(spec.conditions, key=rank))


def from_description(words: str, keys: list[tuple[str, str, str, str]], tables: list[str]) -> QuerySpec:
    """The tables that a description names, joined along shortest paths in the order of the list."""
    named = [t for t in tables if t.lower() in words.lower()]
    joins: list[Join] = []
    have = set(named[:1])
    for a, b in zip(named, named[1:]):
        for j in join_path(a, b, keys):
            if j.right not in have:
                joins.append(j)
                have.add(j.right)
    return QuerySpec(tables=list(dict.fromkeys([*named, *(j.right for j in joins)])), joins=joins)


def explain(spec: QuerySpec) -> str:
    """The specification in words."""
    parts = [f"reads {', '.join(spec.tables)}"]
    parts += [f"joins {j.right} on {j.left}.{j.left_column} = {j.right}.{j.right_column} ({j.how})" for j in spec.joins]
    if spec.conditions:
        parts.append("keeps rows where " + " and ".join(f"{c.column} {c.operator} {c.value}" for c in spec.conditions))
    if spec.group_by:
        parts.append(f"groups by {', '.join(spec.group_by)}")
    if spec.order_by:
        parts.append("orders by " + ", ".join(f"{c} {d}" for c, d in spec.order_by))
    if spec.limit:
        parts.append(f"takes {spec.limit} rows")
    return "; ".join(parts)
