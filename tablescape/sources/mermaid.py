"""ER diagrams in Mermaid text: read into catalog rows, written from them."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from tablescape.functions.text import arrow_description, sanitize_identifier
from tablescape.operators.patterns import cardinality

#: Lines and characters beyond which a diagram is cut to so many lines.
MOST_LINES, MOST_CHARACTERS = 2000, 100_000
# what ends a line for a pattern's dot and its end, beside the line breaks that part a diagram
_END = "\r\x85\u2028\u2029"
_LAST = rf"(?=[{_END}]?\Z)"
_COMMENT = re.compile(rf"%%[^{_END}]*{_LAST}")
_OPENS = re.compile(rf"^(\w+)\s*\{{{_LAST}", re.ASCII)
_REL = re.compile(rf"^\s*(\w+)\s+([|}}o{{]{{1,2}}(?:--|\.\.)[|{{o}}]{{1,2}})\s+(\w+)\s*(?::\s*\"?([^\"]*)\"?)?\s*{_LAST}", re.ASCII)


_WORDS, _MARKS = re.compile(r"(\S+)\s+(\S+)", re.ASCII), re.compile(rf"\S+\s+\S+\s*([^{_END}]*){_LAST}", re.ASCII)
_PK, _FK = re.compile(r"\bPK\b", re.ASCII), re.compile(r"\bFK\b", re.ASCII)


def _scanned(body: str):
    """(at, line, name, opens) of a diagram's lines without comments: the table of the block that a line stands in, and whether it opens it."""
    name = None
    for at, line in enumerate(re.split(r"\r?\n", body) if "\r" in body else body.split("\n")):
        if "%%" in line:
            line = _COMMENT.sub("", line)
        line = line.strip(" ")
        if line == "" or line == "erDiagram":
            continue
        opens = _OPENS.search(line) if "{" in line else None
        if opens:  # an open block ends at its bracket or at the next block
            name = opens[1]
        elif line == "}":
            name = None
        yield at, line, name, opens is not None


def _tables(body: str) -> list[tuple]:
    return [(name,) for name in {name for _, _, name, opens in _scanned(body) if opens}]


def _columns(body: str) -> list[tuple]:
    out = []
    for at, line, name, opens in _scanned(body):
        if name is not None and not opens:
            words = _WORDS.match(line)
            if words:
                marks = _MARKS.match(line) if words.end() < len(line) else None
                out.append((name, at, words[1], words[2], marks is not None and _PK.search(marks[1]) is not None, marks is not None and _FK.search(marks[1]) is not None))
    return out


def _relationships(body: str) -> list[tuple]:
    out, known = [], set()
    for at, line, name, opens in _scanned(body):
        if opens:
            known.add(name)
        elif name is None and ("--" in line or ".." in line):
            rel = _REL.search(line)
            if rel:
                out.append((rel[1], rel[2], rel[3], rel[4] or ""))
    return [r for r in out if r[0] in known and r[2] in known]


def _read(diagrams: DataFrame, f, fields: str) -> DataFrame:
    """(diagram, ``fields``): the rows that ``f`` makes of each body."""
    schema = T.StructType([diagrams.schema["diagram"], *T.StructType.fromDDL(fields).fields])
    wanted = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for i, body in enumerate(batch.column(1).to_pylist()):
                rows = f(body) if body is not None else []
                if rows:
                    diagram = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([diagram, *(pa.array(c, t.type) for c, t in zip(zip(*rows), list(wanted)[1:]))], schema=wanted)

    return diagrams.select("diagram", "body").mapInArrow(run, schema)


def parse(diagrams: DataFrame, type_first: bool = False) -> dict[str, DataFrame]:
    """``tables``, ``columns`` (diagram, table_name, ordinal, column_name, column_type, is_pk, is_fk) and ``relationships`` of (diagram, body), a row a diagram.

    Columns are written ``name type``, or ``type name`` with ``type_first``;
    relationships in the whole grammar of symbols; those of unknown tables go.
    A table that is not closed ends with the next.
    """
    a, b = ("column_type", "column_name") if type_first else ("column_name", "column_type")
    columns = _read(diagrams, _columns, f"table_name string, ordinal int, {a} string, {b} string, is_pk boolean, is_fk boolean").select("diagram", "table_name", "ordinal", "column_name", "column_type", "is_pk", "is_fk")
    tables = _read(diagrams, _tables, "table_name string").distinct()
    d = arrow_description(F.col("label"))
    rels = _read(diagrams, _relationships, "left string, symbol string, right string, label string").select("diagram", F.col("left").alias("source_table"), d["source"].alias("source_column"), F.col("right").alias("target_table"), d["target"].alias("target_column"), cardinality(F.col("symbol")).alias("cardinality"))
    return {"tables": tables, "columns": columns, "relationships": rels}


def _bodies(batches, wanted: pa.Schema):
    """A diagram for each domain of pieces (see ``render``), which come in order: a column of the block ``head``, or text ``t`` of its own."""
    names = ["domain", "part", "key", "head", "column_name", "column_type", "t"]
    domain, out, key, head, block, clean = None, None, None, None, [], {}

    def cleaned(name, kind):
        if (name, kind) not in clean:
            if len(clean) > 100_000:
                clean.clear()
            clean[name, kind] = f"        {re.sub(r'[^A-Za-z0-9_]', '_', name)} {re.sub(r'[^A-Za-z0-9_]', '_', kind)}"
        return clean[name, kind]

    def shut():
        if head is not None:
            rows = block
            if len({r[:2] for r in block}) < len(block):  # columns of one place and name in the order of what is written
                rows = [r for _, same in itertools.groupby(block, lambda r: r[:2]) for r in sorted(same, key=lambda r: (r[2] is not None, r[2]))]
            out.append(f"    {head} {{\n" + "\n".join(r[2] for r in rows if r[2] is not None) + "\n    }")
            block.clear()

    def body():
        text = "erDiagram\n" + "\n".join(out)
        if len(text) > MOST_CHARACTERS or text.count("\n") + 1 > MOST_LINES:
            text = "\n".join(text.split("\n")[:MOST_LINES])
        return pa.RecordBatch.from_arrays([pa.array([domain], wanted.field(0).type), pa.array([text], wanted.field(1).type)], schema=wanted)

    for batch in batches:
        texts = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        for to, part, name, first, column, kind, t, ordinal, pk, fk in zip(*texts, *(batch.column(c).to_pylist() for c in ("ordinal", "is_pk", "is_fk"))):
            if out is None or to != domain:
                if out is not None:
                    shut()
                    yield body()
                domain, out, key, head = to, [], None, None
            again = key == (part, name)
            if not again:
                shut()
                key, head = (part, name), first
            if first is not None:
                line = None if column is None or kind is None else cleaned(column, kind) + (" PK" if pk else " FK" if fk else "")
                block.append((ordinal, column, line))
            elif t is not None and not (again and part in (2, 5)):  # ghosts and their marks once
                out.append(t)
    if out is not None:
        shut()
        yield body()


def render(columns: DataFrame, rels: DataFrame, membership: DataFrame) -> DataFrame:
    """(domain, body): a diagram for each domain of (table_name, domain).

    Tables with their columns and PK/FK marks, relationships inside the
    domain once for each pair of tables, and a ghost block for each table
    outside that a table of the domain refers to. Beyond ``MOST_LINES`` lines
    or ``MOST_CHARACTERS`` characters the first ``MOST_LINES`` lines stand.
    """
    name = lambda c: sanitize_identifier(F.col(c))
    m = membership.select("table_name", "domain")
    block = columns.join(m.withColumn("head", name("table_name")), "table_name").select("domain", F.lit(1).alias("part"), F.col("table_name").alias("key"), "head", "ordinal", "column_name", "column_type", "is_pk", "is_fk", F.lit(None).cast("string").alias("t"))
    rest = {c: F.lit(None).cast(block.schema[c].dataType) for c in block.columns}
    whole = lambda df: df.select(*[F.col(c) if c in ("domain", "part", "key", "t") else rest[c].alias(c) for c in block.columns])
    empty = m.join(columns.select("table_name").distinct(), "table_name", "left_anti").select("domain", F.lit(1).alias("part"), F.col("table_name").alias("key"), F.concat(F.lit("    "), name("table_name"), F.lit(" {\n        id int PK\n    }")).alias("t"))
    r = rels.join(m.select(F.col("table_name").alias("source_table"), "domain"), "source_table").join(m.select(F.col("table_name").alias("target_table"), F.col("domain").alias("there")), "target_table", "left")
    inside = F.when(F.col("domain") == F.col("there"), True).when(F.col("there").isNull() | (F.col("domain") != F.col("there")), False)
    r = r.withColumn("inside", inside).where("inside IS NOT NULL").groupBy("domain", "inside", "source_table", "target_table").agg(F.min("source_column").alias("source_column"))
    r = r.withColumns({"s": name("source_table"), "to": name("target_table")})
    text = F.concat(F.lit("    "), "s", F.lit(" }o--|| "), "to", F.lit(' : "FK '), "source_column", F.lit('"'))
    piece = lambda part, key, t: F.struct(F.lit(part).alias("part"), key.alias("key"), t.alias("t"))
    pair, to = F.concat_ws("|", "source_table", "target_table"), F.col("target_table")
    ghost, shown = F.concat(F.lit("    "), "to", F.lit(" {\n        id int PK\n    }")), F.concat(F.lit("    class "), "to", F.lit(" ghost"))
    links = r.select("domain", F.explode(F.when(F.col("inside"), F.array(piece(3, pair, text))).otherwise(F.array(piece(2, to, ghost), piece(4, pair, text), piece(5, to, shown)))).alias("p")).select("domain", "p.*")
    # one order of all pieces, so that a domain's are neighbours and are joined as they pass
    all_ = block.unionByName(whole(empty)).unionByName(whole(links)).repartition("domain").sortWithinPartitions("domain", "part", "key", "ordinal", "column_name", "t")
    schema = T.StructType([T.StructField("domain", all_.schema["domain"].dataType), T.StructField("body", T.StringType())])
    wanted = to_arrow_schema(schema)
    return all_.mapInArrow(lambda batches: _bodies(batches, wanted), schema)


def context(columns: DataFrame, rels: DataFrame) -> DataFrame:
    """(table_name, text): a table's columns in words, ``name type PK/FK -> table.column``."""
    j = columns.join(rels.select(F.col("source_table").alias("table_name"), F.col("source_column").alias("column_name"), "target_table", "target_column"), ["table_name", "column_name"], "left")
    one = F.concat("column_name", F.lit(" "), "column_type", F.when(F.col("is_pk"), " PK").when(F.col("is_fk"), " FK").otherwise(""), F.coalesce(F.concat(F.lit(" -> "), "target_table", F.lit("."), "target_column"), F.lit("")))
    return j.groupBy("table_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", one.alias("c")))), lambda x: x["c"]), ", ").alias("text"))


def simplified(columns: DataFrame, rels: DataFrame, most: int = 12, words: tuple[str, ...] = ("user", "account", "order", "customer", "product")) -> dict[str, DataFrame]:
    """``tables`` (key ones by name, and the ``most`` of the most relationships, ties by name) and the ``relationships`` among them."""
    d = rels.select(F.explode(F.array("source_table", "target_table")).alias("table_name")).groupBy("table_name").agg(F.count("*").alias("n"))
    top = d.orderBy(F.desc("n"), "table_name").limit(most).select("table_name")
    key = columns.select("table_name").distinct().where(F.lower("table_name").rlike("|".join(words)))
    t = top.unionByName(key).distinct()
    side = lambda c: t.select(F.col("table_name").alias(c))
    return {"tables": t, "relationships": rels.join(side("source_table"), "source_table", "left_semi").join(side("target_table"), "target_table", "left_semi")}


def ghost_references(rels: DataFrame, membership: DataFrame, hubs: DataFrame, most: int = 5) -> DataFrame:
    """(domain, table_name, home, incoming, importance, rank): tables outside a domain that it refers to, the ``most`` important ones.

    Importance is the references from the domain, half of those back to it,
    and 10 for a hub.
    """
    m = membership.select("table_name", "domain")
    r = rels.join(m.select(F.col("table_name").alias("source_table"), F.col("domain").alias("sd")), "source_table").join(m.select(F.col("table_name").alias("target_table"), F.col("domain").alias("td")), "target_table").where("sd <> td")
    into = r.groupBy(F.col("sd").alias("domain"), F.col("target_table").alias("table_name"), F.col("td").alias("home")).agg(F.count("*").alias("incoming"))
    back = r.groupBy(F.col("td").alias("domain"), F.col("source_table").alias("table_name")).agg(F.count("*").alias("outgoing"))
    h = hubs.select(F.col("node").alias("table_name"), F.lit(10.0).alias("bonus"))
    x = into.join(back, ["domain", "table_name"], "left").join(h, "table_name", "left").na.fill(0, ["outgoing"]).na.fill(0.0, ["bonus"])
    x = x.withColumn("importance", F.col("incoming") + 0.5 * F.col("outgoing") + F.col("bonus"))
    w = Window.partitionBy("domain").orderBy(F.desc("importance"), "table_name")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("domain", "table_name", "home", "incoming", "importance", "rank")


def search(columns: DataFrame, rels: DataFrame, membership: DataFrame, query: str) -> DataFrame:
    """(kind, name, place): tables (by name or domain), columns and relationships that contain ``query`` in any case; repeats once."""
    q = query.lower()
    like = lambda *cs: F.lower(F.concat_ws(" ", *cs)).contains(q)
    t = membership.where(like("table_name", "domain")).select(F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.col("domain").alias("place"))
    c = columns.where(like("column_name", "column_type")).select(F.lit("column").alias("kind"), F.col("column_name").alias("name"), F.col("table_name").alias("place"))
    r = rels.where(like("source_table", "source_column", "target_table", "target_column")).select(F.lit("relationship").alias("kind"), F.concat_ws(".", "source_table", "source_column").alias("name"), F.concat_ws(".", "target_table", "target_column").alias("place"))
    return t.unionByName(c).unionByName(r).distinct()
