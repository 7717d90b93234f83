"""Dictionaries, diagrams, patterns, weights and text functions on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from tablescape.functions import text, types, vectors
from tablescape.operators import patterns, weights
from tablescape.sources import dictionary, mermaid, sinks, xlsx

TABLES = [["Logical Table Name", "Data Kind", "Description"], ["Customer", "entity", "x"], ["Order", "entity", ""], ["Status", "staticentity", ""], ["Ignored", "view", ""], ["", "", ""], ["Customer", "entity", "again"]]
COLUMNS = [
    ["Logical Table Name", "Attribute Name", "Type", "Is Autonumber", "Reference Table", "Column Table"],
    ["Customer", "CustomerId", "int", "true", "", ""], ["Customer", "Name", "varchar(200)", "false", "", ""], ["Order", "OrderId", "int", "TRUE", "", ""],
    ["Order", "CustomerId", "int", "false", "Customer", "CustomerId"], ["Order", "StatusId", "int", "false", "Status", "StatusId"], ["Order", "RegionId", "", "", "Region", "Id"],
    ["Order", "Half", "int", "", "Region", ""], ["Nowhere", "X", "int", "", "", ""],
]


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "a.xlsx").write_bytes(xlsx.write_workbook({"TableMetadata": TABLES, "AttributeMetadata": COLUMNS, "Empty": [], "Codes <&>": [["code", "description", "status", "category"], ["A", "Active", "", "c1"], ["B", "Blocked", "Inactive", ""], ["", "none", "", ""]]}))
    spark.dataSource.register(xlsx.XlsxDataSource)
    return spark.read.format("xlsx").load(str(d)), d


def test_workbooks(spark, cells):
    df, d = cells
    rows = {(r["sheet"], r["row"]): r["cells"] for r in df.collect()}
    assert rows["AttributeMetadata", 2][:4] == ["Customer", "CustomerId", "int", "true"]
    again = {(r["sheet"], r["row"]): r["cells"] for r in xlsx.read_workbooks(spark, str(d)).collect()}
    assert again == rows
    p = {r["sheet"]: r for r in dictionary.profile_sheets(df).collect()}
    assert set(p) == {"TableMetadata", "AttributeMetadata", "Codes <&>"} and p["TableMetadata"]["n_rows"] == 5 and len(p["AttributeMetadata"]["preview"]) == 5
    assert {r["sheet"]: r["role"] for r in dictionary.suggest_roles(dictionary.profile_sheets(df)).collect()} == {"TableMetadata": "tables", "AttributeMetadata": "columns", "Codes <&>": "codes"}


def test_dictionary(cells):
    df, _ = cells
    assert dictionary.missing_parts(df, dictionary.FIXED).count() == 0
    c = dictionary.parse(df, dictionary.FIXED)
    assert {r["table_name"] for r in c["tables"].collect()} == {"Customer", "Order", "Status", "Region"}
    assert {r["table_name"] for r in c["created"].collect()} == {"Region"}
    cols = {(r["table_name"], r["column_name"]): r for r in c["columns"].collect()}
    assert cols["Order", "RegionId"]["column_type"] == "text" and cols["Order", "RegionId"]["is_fk"] and not cols["Order", "Half"]["is_fk"]
    assert cols["Order", "OrderId"]["is_pk"] and cols["Region", "id"]["is_pk"] and ("Nowhere", "X") not in cols
    assert c["relationships"].count() == 3
    n = {r["table_name"]: len(r["columns"]) for r in dictionary.nested(c["tables"], c["columns"]).collect()}
    assert n == {"Customer": 2, "Order": 5, "Status": 0, "Region": 1}
    codes = {r["code"]: r for r in dictionary.code_values(df, "Codes <&>").collect()}
    assert set(codes) == {"A", "B"} and codes["A"]["is_active"] and not codes["B"]["is_active"] and codes["A"]["notes"] == "Category: c1"


def test_diagrams(spark):
    body = 'erDiagram\n%% note\nOrder {\n  id int PK\n  CustomerId int FK\n}\nCustomer {\n  id int PK\n  name text\nStatus {\n id int\n}\nOrder }o--|| Customer : "FK CustomerId"\nCustomer ||--o{ Order : "id -> CustomerId"\nOrder }o--|| Ghost : x'
    got = mermaid.parse(spark.createDataFrame([("d", body)], "diagram string, body string"))
    assert {r["table_name"] for r in got["tables"].collect()} == {"Order", "Customer", "Status"}
    cols = {(r["table_name"], r["column_name"]): (r["column_type"], r["is_pk"], r["is_fk"]) for r in got["columns"].collect()}
    assert cols["Order", "CustomerId"] == ("int", False, True) and cols["Customer", "name"] == ("text", False, False) and len(cols) == 5
    rels = {(r["source_table"], r["source_column"], r["target_table"], r["target_column"], r["cardinality"]) for r in got["relationships"].collect()}
    assert rels == {("Order", "CustomerId", "Customer", None, "many-to-one"), ("Customer", "id", "Order", "CustomerId", "one-to-many")}


def test_render_round_trip(spark):
    columns = spark.createDataFrame([("A", 1, "id", "int", True, False), ("A", 2, "b_id", "int", False, True), ("A", 3, "c_id", "int", False, True), ("B", 1, "id", "int", True, False), ("C", 1, "id", "varchar(10)", True, False)], "table_name string, ordinal int, column_name string, column_type string, is_pk boolean, is_fk boolean")
    rels = spark.createDataFrame([("A", "b_id", "B", "id"), ("A", "c_id", "C", "id")], "source_table string, source_column string, target_table string, target_column string")
    m = spark.createDataFrame([("A", "x"), ("B", "x"), ("C", "y")], "table_name string, domain string")
    out = {r["domain"]: r["body"] for r in mermaid.render(columns, rels, m).collect()}
    assert out["x"].splitlines()[0] == "erDiagram" and 'A }o--|| B : "FK b_id"' in out["x"] and "class C ghost" in out["x"] and out["x"].count("C {") == 1 and "ghost" not in out["y"]
    back = mermaid.parse(spark.createDataFrame([("x", out["x"])], "diagram string, body string"))
    assert {(r["source_table"], r["target_table"]) for r in back["relationships"].collect()} == {("A", "B"), ("A", "C")}
    h = spark.createDataFrame([("C",)], "node string")
    g = mermaid.ghost_references(rels, m, h).collect()
    assert [(r["domain"], r["table_name"], r["importance"]) for r in g] == [("x", "C", 11.0)]
    assert {(r["kind"], r["name"]) for r in mermaid.search(columns, rels, m, "B_ID").collect()} == {("column", "b_id"), ("relationship", "A.b_id")}
    assert "b_id int FK -> B.id" in {r["table_name"]: r["text"] for r in mermaid.context(columns, rels).collect()}["A"]
    assert mermaid.simplified(columns, rels, most=2)["relationships"].count() == 1


COLS = "table_name string, column_name string, column_type string, type_class string, is_pk boolean, is_fk boolean, is_unique boolean, is_nullable boolean"


@pytest.fixture(scope="module")
def schema(spark):
    rows = [("Enrollment", "student_id", "int", "integer", True, True, False, False), ("Enrollment", "course_id", "int", "integer", True, True, False, False), ("Enrollment", "createdAt", "date", "datetime", False, False, False, True), ("Enrollment", "updatedBy", "text", "string", False, False, False, True), ("Enrollment", "updatedAt", "date", "datetime", False, False, False, True)]
    rows += [("Student", "id", "int", "integer", True, False, True, False), ("Student", "parentId", "int", "integer", False, True, False, True), ("Course", "id", "int", "integer", True, False, True, False), ("Course", "name", "text", "string", False, False, False, True), ("Loose", "x", "int", "integer", False, False, False, True)]
    rels = [("Enrollment", "student_id", "Student", "id", False), ("Enrollment", "course_id", "Course", "id", False), ("Student", "parentId", "Student", "id", True)]
    return spark.createDataFrame(rows, COLS), spark.createDataFrame(rels, "source_table string, source_column string, target_table string, target_column string, nullable boolean")


def test_patterns(schema):
    columns, rels = schema
    got = {(r["table_name"], r["pattern"]) for r in patterns.schema_patterns(columns, rels).collect()}
    assert got == {("Enrollment", "junction"), ("Enrollment", "audit_trail"), ("Student", "hierarchy"), ("Course", "lookup"), ("Loose", "orphan")}
    kinds = {r["table_name"]: r["table_type"] for r in patterns.table_types(columns, rels).collect()}
    assert kinds == {"Enrollment": "entity", "Student": "lookup", "Course": "lookup", "Loose": "reference"}
    c = patterns.complexity(columns, rels).first()
    assert c["score"] == pytest.approx(2 * 4 + 3 * 3 + 5 * 4 + 10 + 2 * 10 / 4) and c["class"] == "moderate" and c["max_depth"] == 2


def test_names(spark):
    df = spark.createDataFrame([("OrderItems", "Orders"), ("UserAccount", "StatusType"), ("tmp_user", "cache_log")], "s string, t string")
    s, t = F.col("s"), F.col("t")
    r = df.select(patterns.relationship_kind(s, t).alias("k"), patterns.importance(s).alias("i"), F.round(patterns.relationship_strength(s, t), 6).alias("w"), patterns.business_nature(s, t).alias("n")).collect()
    assert [tuple(x) for x in r] == [("composition", 0.9, 0.98, "core"), ("aggregation", 0.9, pytest.approx(0.44), "lookup"), ("aggregation", pytest.approx(0.27), pytest.approx(0.542), "audit")]


def test_weights(schema):
    columns, rels = schema
    w = {(r["source_table"], r["target_table"]): r for r in weights.weighted(rels, columns).collect()}
    e = w["Enrollment", "Course"]
    assert e["w_structural"] == 1.0 and e["w_constraint"] == 1.0 and e["w_semantic"] == 0.5
    assert e["w_topological"] == pytest.approx(0.6 * max(0.1, 1 - (2 + 1) / 2 / 3) + 0.4)
    for method in ("additive", "multiplicative", "hybrid"):
        for r in weights.weighted(rels, columns, method=method).collect():
            assert 0.1 <= r["w_final"] <= 1.0


def test_text(spark):
    df = spark.createDataFrame([(x,) for x in ["  Table  Name ", "Campaign", "1 bad-name", "boolean", "", None]], "x string")
    x = F.col("x")
    assert [r[0] for r in df.select(text.sanitize_identifier(x)).collect()] == ["__Table__Name_", "Campaign", "Table_1_bad_name", "boolean_", "Unknown", "Unknown"]
    one = lambda c, v: spark.createDataFrame([(v,)], "x string").select(c).first()[0]
    assert one(text.normalize_header(x), "  Table \t Name ") == "table_name"
    assert one(text.redact_error(x), "open /home/bob/a.txt failed") == "open [REDACTED_PATH] failed"
    assert one(text.redact_error(x), "bad PassWord") == "Internal system error - details withheld for security"
    assert one(text.string_hash(x), "hello world") == 1794106052
    assert one(text.string_hash(x), "polygenelubricants" * 3) >= 0
    v = one(text.hash_embedding(x), "alpha beta alpha")
    assert len(v) == 384 and sum(a * a for a in v) == pytest.approx(1) and sum(a > 0 for a in v) == 2
    assert one(text.camel_words(x), "UserAccount") == "User Account" and one(text.business_name(x), "tblUser") == "User Management" and one(text.business_name(x), "red_box") == "Red box"
    assert one(text.sql_block(x), "see\n```sql\nSELECT 1\n```") == "SELECT 1" and one(text.list_items(x), "1. a\n- b\nc") == ["a", "b"] and one(text.bold_sections(x), "**a** b **c**") == ["a", "c"]
    assert one(text.sql_speed(x), "select 1") == "fast" and one(text.sql_speed(x), "select count(*) from a join b join c join d join e") == "slow"
    assert one(text.sql_tips(x), "SELECT * FROM a WHERE b") == ["Consider selecting only needed columns instead of using SELECT *", "Ensure WHERE clause columns have appropriate indexes"]
    assert one(text.domain_key(x), "My Domain! 1") == "my_domain_1" and one(text.is_truthy(x), " On ") and not one(text.is_truthy(x), None)
    assert [one(types.type_class(x), v) for v in ("BIGINT", "double", "varchar(3)", "timestamp", "bool", "uuid", "point", "x")] == ["integer", "numeric", "string", "datetime", "boolean", "uuid", "integer", "other"]
    assert one(types.type_class(x, types.TEN), "serial") == "integer" and one(types.type_class(x, types.SIX), "uuid") == "other"
    jw = lambda a, b, **k: spark.createDataFrame([(a, b)], "a string, b string").select(text.jaro_winkler(F.col("a"), F.col("b"), **k)).first()[0]
    assert jw("MARTHA", "marhta") == pytest.approx(0.961111, abs=1e-6) and jw("a", "") == 0 and jw("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], {"a": 0.5, "b": 0.5}, {"a": 1.0})], "a array<double>, b array<double>, p map<string,double>, q map<string,double>")
    r = df.select(vectors.cosine(F.col("a"), F.col("b")), vectors.euclidean(F.col("a"), F.col("b")), vectors.distribution_cosine(F.col("p"), F.col("q")), vectors.jensen_shannon(F.col("p"), F.col("p")), vectors.jensen_shannon(F.col("p"), F.col("q"))).first()
    assert r[0] == pytest.approx(0.70710678) and r[1] == 1 and r[2] == pytest.approx(0.70710678) and r[3] == 0 and 0 < r[4] < 1


def test_match_names_and_sinks(spark, tmp_path):
    n, c = spark.createDataFrame([("custmer",), ("ORDERS",), ("zzz",)], "name string"), spark.createDataFrame([("Customer",), ("Orders",), ("Order",)], "candidate string")
    got = {r["name"]: r["candidate"] for r in dictionary.match_names(n, c).collect()}
    assert got == {"custmer": "Customer", "ORDERS": "Orders"}
    words = ["Account", "accuont", "a", "", "Ledger", "ledgers", "aab", "baa", "naïve", "NAIVE", "\U0001f600x", "x\U0001f600"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    shared = F.size(F.array_intersect(text.counted_characters(F.col("a")), text.counted_characters(F.col("b"))))
    for r in pairs.select("a", "b", text.jaro_winkler(F.col("a"), F.col("b")).alias("s"), text.jaro_winkler_bound(F.col("a"), F.col("b"), shared).alias("most")).collect():
        assert r["s"] <= r["most"] + 1e-12 or r["a"] == r["b"] == "", r
    path = str(tmp_path / "projects")
    sinks.replace_project(spark.range(3), path, "p1")
    sinks.replace_project(spark.range(5), path, "p2")
    sinks.replace_project(spark.range(1), path, "p1")
    assert sinks.read_project(spark, path, "p1").count() == 1 and sinks.read_project(spark, path, "p2").count() == 5


def test_a_diagram_is_read_where_it_lies(spark):
    """No shuffle and no order of lines: a body is read in one pass; comments, open blocks, carriage returns and relationships before their tables."""
    body = "erDiagram\r\n    b }o--|| a : \"FK x\"\n    a {\n        id int PK %% PK FK\n        x varchar FK\n    b {\n        c--d int\n    }\n    c }o--|| a : \"FK x\"\n\n%% a }o--|| b"
    got = mermaid.parse(spark.createDataFrame([("d", body), ("e", None), ("f", "")], "diagram string, body string"))
    assert sorted(tuple(r) for r in got["columns"].collect()) == [("d", "a", 3, "id", "int", True, False), ("d", "a", 4, "x", "varchar", False, True), ("d", "b", 6, "c--d", "int", False, False)]
    assert [tuple(r) for r in got["relationships"].collect()] == [("d", "b", "x", "a", None, "many-to-one")]
    for name in ("columns", "relationships"):
        assert "Exchange" not in got[name]._jdf.queryExecution().executedPlan().toString()


def test_columns_of_one_place_and_ghosts_once(spark):
    columns = spark.createDataFrame([("t", 1, "x", "b!", False, True), ("t", 1, "x", "a?", True, False), ("t", None, "w", None, False, False)], "table_name string, ordinal int, column_name string, column_type string, is_pk boolean, is_fk boolean")
    rels = spark.createDataFrame([("t", "x", "g"), ("t", "w", "g"), ("u", "x", "g")], "source_table string, source_column string, target_table string")
    out = mermaid.render(columns, rels, spark.createDataFrame([("t", "d"), ("u", "d")], "table_name string, domain string")).collect()
    lines = ["erDiagram", "    t {", "        x a_ PK", "        x b_ FK", "    }", "    u {", "        id int PK", "    }", "    g {", "        id int PK", "    }", '    t }o--|| g : "FK w"', '    u }o--|| g : "FK x"', "    class g ghost"]
    assert [tuple(r) for r in out] == [("d", "\n".join(lines))]


def test_weights_join_an_end_once(spark):
    """Columns of one name multiply a relationship, one without a column stays; an end is one join, not one a question."""
    c = spark.createDataFrame([("a", "x", "int", "integer", False, True, False, True), ("a", "x", "int", "integer", True, True, False, False), ("b", "id", "int", "integer", True, False, True, False)], "table_name string, column_name string, column_type string, type_class string, is_pk boolean, is_fk boolean, is_unique boolean, is_nullable boolean")
    r = spark.createDataFrame([("a", "x", "b", "id", False), ("a", "none", "b", None, True), ("a", "x", "gone", "id", True)], "source_table string, source_column string, target_table string, target_column string, nullable boolean")
    w = weights.weighted(r, c)
    got = sorted((x["source_column"], round(x["w_structural"], 6), round(x["w_constraint"], 6), round(x["w_similarity"], 6)) for x in w.collect())
    alike = 0.3 * 0.5 + 0.3 + 0.2 * (0.5 / (1.5**0.5 * 2**0.5))
    assert got == [("none", 0.5, 0.5, round(alike, 6)), ("x", 1.0, 0.85, round(alike, 6)), ("x", 1.0, 1.0, round(alike, 6))]
    assert w._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 3  # two ends and the greatest degree
