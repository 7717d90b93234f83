"""Data dictionaries to a catalog: profiles of sheets, tables, columns, relationships and code values, from (sheet, row, cells) rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.functions.text import counted_characters, is_inactive, is_truthy, jaro_winkler, jaro_winkler_bound, normalize_header

# The ordered synonyms of a dictionary's headers.
SYNONYMS = {
    "table": ["logical_table_name", "table_name", "tablename", "table", "entityname", "entity"],
    "kind": ["data_kind", "datakind", "kind", "entitykind", "type"],
    "column": ["attribute_name", "attributename", "column_name", "fieldname", "column"],
    "column_type": ["type", "data_type", "datatype", "fieldtype"],
    "is_pk": ["is_autonumber", "isautonumber", "is_pk", "ispk", "primary_key"],
    "ref_table": ["reference_table", "referencetable", "fkentity", "ref_table"],
    "ref_column": ["column_table", "columntable", "fkfield", "ref_column", "reference_column"],
}


@dataclass(frozen=True)
class Mapping:
    """Which sheets and headers hold what; column names are matched in any case and spacing."""

    table_sheet: str
    table_name: str
    column_sheet: str
    column_table: str
    column_name: str
    table_kind: str | None = None
    column_type: str | None = None
    primary_key: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    kinds: tuple[str, ...] = ()


def profile_sheets(cells: DataFrame) -> DataFrame:
    """(sheet, header, n_rows, preview): the first non-empty row as header, rows below it, five of them; empty sheets go."""
    full = cells.where(F.exists("cells", lambda c: F.trim(c) != ""))
    w = Window.partitionBy("sheet").orderBy("row")
    r = full.withColumn("at", F.row_number().over(w))
    return r.groupBy("sheet").agg(
        F.max(F.when(F.col("at") == 1, F.col("cells"))).alias("header"), F.count_if(F.col("at") > 1).alias("n_rows"),
        F.transform(F.array_sort(F.collect_list(F.when((F.col("at") > 1) & (F.col("at") <= 6), F.struct("at", "cells")))), lambda x: x["cells"]).alias("preview"),
    )


def suggest_roles(profiles: DataFrame) -> DataFrame:
    """(sheet, role, confidence): tables, columns or codes by the sheet's name: .4 for tables and columns, .2 for codes."""
    s = F.lower("sheet")
    role = F.when(s.contains("table") | s.contains("entit"), "tables").when(s.contains("column") | s.contains("attribute") | s.contains("field"), "columns").when(s.contains("code") | s.contains("master") | s.contains("lookup"), "codes")
    return profiles.select("sheet", role.alias("role"), F.when(role == "codes", 0.2).otherwise(0.4).alias("confidence")).where("role IS NOT NULL")


def records(cells: DataFrame, sheet: str) -> DataFrame:
    """(row, record): the sheet's rows below its header as maps from normalised header to trimmed cell; empty rows go."""
    s = cells.where(F.col("sheet") == sheet).where(F.exists("cells", lambda c: F.trim(c) != ""))
    head = s.orderBy("row").limit(1).select(F.transform("cells", normalize_header).alias("head"), F.col("row").alias("at"))
    named = s.crossJoin(F.broadcast(head)).where("row > at")  # one row
    entries = F.filter(F.zip_with("head", "cells", lambda h, c: F.struct(h.alias("k"), F.trim(F.coalesce(c, F.lit(""))).alias("v"))), lambda e: e["k"].isNotNull() & (e["k"] != ""))
    # of repeated headers the first stands
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["k"]), e["k"]) == i + 1)
    return named.select("row", F.map_from_entries(first).alias("record"))


def field(name: str | None) -> Column:
    """The record's cell under a header, null if empty or unnamed."""
    if not name:
        return F.lit(None).cast("string")
    v = F.element_at("record", F.lit("_".join(name.strip().lower().split())))
    return F.when(v != "", v)


def synonym(role: str) -> Column:
    """The first non-empty cell under any of a role's synonyms."""
    return F.coalesce(*[field(s) for s in SYNONYMS[role]])


def missing_parts(cells: DataFrame, m: Mapping) -> DataFrame:
    """(part): sheets and headers of the mapping that the workbook lacks."""
    have = profile_sheets(cells).select("sheet", F.explode(F.transform("header", normalize_header)).alias("h"))
    norm = lambda n: "_".join(n.strip().lower().split())
    need = [(m.table_sheet, norm(m.table_name)), (m.column_sheet, norm(m.column_table)), (m.column_sheet, norm(m.column_name))]
    need += [(m.column_sheet, norm(c)) for c in (m.column_type, m.primary_key, m.ref_table, m.ref_column) if c]
    if m.table_kind:
        need.append((m.table_sheet, norm(m.table_kind)))
    n = cells.sparkSession.createDataFrame(need, "sheet string, h string")
    return n.join(have, ["sheet", "h"], "left_anti").select(F.concat_ws("/", "sheet", "h").alias("part")).distinct()


def parse(cells: DataFrame, m: Mapping) -> dict[str, DataFrame]:
    """The catalog of a mapped dictionary: ``tables``, ``columns``, ``relationships``, ``created``.

    Tables without a name go, and those whose stated kind is not among
    ``kinds`` where these are given; of repeated names the first stands.
    Columns of unknown tables go; their type defaults to text. A foreign key
    needs both its table and its column. Tables that are referred to and not
    stated are created with a key ``id int``.
    """
    t = records(cells, m.table_sheet).select("row", field(m.table_name).alias("table_name"), field(m.table_kind).alias("data_kind")).where("table_name IS NOT NULL")
    if m.kinds:
        t = t.where(F.col("data_kind").isNull() | F.lower("data_kind").isin([k.lower() for k in m.kinds]))
    tables = t.groupBy("table_name").agg(F.min_by("data_kind", "row").alias("data_kind"), F.min("row").alias("ordinal"))
    c = records(cells, m.column_sheet).select(
        "row", field(m.column_table).alias("table_name"), field(m.column_name).alias("column_name"), F.coalesce(field(m.column_type), F.lit("text")).alias("column_type"),
        is_truthy(field(m.primary_key)).alias("is_pk"), field(m.ref_table).alias("ref_table"), field(m.ref_column).alias("ref_column"),
    ).where("table_name IS NOT NULL AND column_name IS NOT NULL")
    c = c.join(tables.select("table_name"), "table_name", "left_semi")
    fk = F.col("ref_table").isNotNull() & F.col("ref_column").isNotNull()
    columns = c.select("table_name", F.col("row").alias("ordinal"), "column_name", "column_type", "is_pk", fk.alias("is_fk"), F.when(fk, F.col("ref_table")).alias("ref_table"), F.when(fk, F.col("ref_column")).alias("ref_column"))
    rels = columns.where("is_fk").select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), F.col("ref_table").alias("target_table"), F.col("ref_column").alias("target_column"))
    lost = rels.select(F.col("target_table").alias("table_name")).distinct().join(tables.select("table_name"), "table_name", "left_anti")
    created = lost.select("table_name", F.lit("created").alias("data_kind"), F.lit(None).cast("int").alias("ordinal"))
    made = lost.select("table_name", F.lit(0).alias("ordinal"), F.lit("id").alias("column_name"), F.lit("int").alias("column_type"), F.lit(True).alias("is_pk"), F.lit(False).alias("is_fk"), F.lit(None).cast("string").alias("ref_table"), F.lit(None).cast("string").alias("ref_column"))
    return {"tables": tables.unionByName(created), "columns": columns.unionByName(made), "relationships": rels, "created": lost}


FIXED = Mapping("TableMetadata", "Logical Table Name", "AttributeMetadata", "Logical Table Name", "Attribute Name", "Data Kind", "Type", "Is Autonumber", "Reference Table", "Column Table", ("entity", "staticentity"))


def nested(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, data_kind, columns): columns as an array in their order; an empty one for tables without."""
    rest = [c for c in columns.columns if c not in ("table_name", "ordinal")]
    g = columns.groupBy("table_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", *rest))), lambda x: F.struct(*[x[c].alias(c) for c in rest])).alias("columns"))
    kind = g.schema["columns"].dataType
    return tables.select("table_name", "data_kind").join(g, "table_name", "left").withColumn("columns", F.coalesce("columns", F.array().cast(kind)))


def repair_references(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """``columns`` with the references of foreign keys that lack one, from the first relationship (by target) of the same table and column."""
    first = rels.groupBy(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name")).agg(F.min(F.struct("target_table", "target_column")).alias("r"))
    j = columns.join(first, ["table_name", "column_name"], "left")
    lacks = F.col("is_fk") & F.col("ref_table").isNull()
    return j.withColumn("ref_column", F.when(lacks, F.col("r.target_column")).otherwise(F.col("ref_column"))).withColumn("ref_table", F.when(lacks, F.col("r.target_table")).otherwise(F.col("ref_table"))).drop("r")


def sanitized(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``columns`` with a key ``id integer`` for every named table that has none; unnamed tables go."""
    named = tables.where(F.trim("table_name") != "").select("table_name").distinct()
    bare = named.join(columns.select("table_name"), "table_name", "left_anti").select("table_name", F.lit(0).alias("ordinal"), F.lit("id").alias("column_name"), F.lit("integer").alias("column_type"), F.lit(True).alias("is_pk"))
    return columns.join(named, "table_name", "left_semi").unionByName(bare, allowMissingColumns=True)


def code_values(cells: DataFrame, sheet: str, mode: str = "mixed") -> DataFrame:
    """(code, description, is_active, notes, target): rows with a code and a description.

    ``mode``: ``field_enums`` keeps rows with a field, ``entity_tables`` rows
    with an entity (noted ``Entity: x``), ``mixed`` all (noted ``Category: x``).
    """
    r = records(cells, sheet).select(field("code").alias("code"), field("description").alias("description"), field("status").alias("status"), field("entity").alias("entity"), field("field").alias("f"), field("category").alias("category"))
    r = r.where("code IS NOT NULL AND description IS NOT NULL")
    if mode == "field_enums":
        r, target, notes = r.where("f IS NOT NULL"), F.col("f"), F.lit(None).cast("string")
    elif mode == "entity_tables":
        r, target, notes = r.where("entity IS NOT NULL"), F.col("entity"), F.concat(F.lit("Entity: "), "entity")
    else:
        target, notes = F.coalesce("category", "entity", "f"), F.when(F.col("category").isNotNull(), F.concat(F.lit("Category: "), "category"))
    return r.select("code", "description", (~F.coalesce(is_inactive(F.col("status")), F.lit(False))).alias("is_active"), notes.alias("notes"), target.alias("target"))


def match_names(names: DataFrame, candidates: DataFrame, least: float = 0.7) -> DataFrame:
    """(name, candidate, similarity): the equal candidate in any case, else the most similar from ``least`` on, ties to the least name.

    Equal names leave before the rest meets the candidates; both are distinct
    names of a catalog, bounded lists whose smaller side Spark ships if its
    size allows. Every name may be near every candidate at such a ``least``, so
    all meet, but only pairs whose shared characters and prefix allow it reach
    the similarity itself.
    """
    n, c = names.select("name").distinct(), candidates.select("candidate").distinct()
    exact = n.join(c, F.lower("name") == F.lower("candidate")).groupBy("name").agg(F.min("candidate").alias("candidate")).withColumn("similarity", F.lit(1.0))
    left = n.join(exact, "name", "left_anti").withColumn("cn", counted_characters(F.col("name")))
    bound = jaro_winkler_bound(F.col("name"), F.col("candidate"), F.size(F.array_intersect("cn", "cc")))
    met = left.join(c.withColumn("cc", counted_characters(F.col("candidate"))), bound >= least - 1e-9).select("name", "candidate")
    rest = met.withColumn("similarity", jaro_winkler(F.col("name"), F.col("candidate"))).where(F.col("similarity") >= least)
    near = rest.groupBy("name").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "candidate")).alias("b")).select("name", F.col("b.candidate").alias("candidate"), (-F.col("b.s")).alias("similarity"))
    return exact.unionByName(near)
