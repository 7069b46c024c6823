"""Many CSV files with headers of their own: cells as the standard library reads them, one profile a file, a report for each."""

import csv
import io

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.sources import imports, published

HEAD = "database_key,schema_name,object_name,object_type\n"


def listed(spark, texts):
    return spark.createDataFrame([(f"f{k:04}.csv", len(t), "0", t) for k, t in enumerate(texts)], "path string, bytes long, sha256 string, text string")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.text(alphabet='ab",\n\r é', max_size=6), min_size=1, max_size=4), min_size=1, max_size=5), min_size=1, max_size=40))
def test_cells_are_those_that_were_written(spark, tables):
    texts = []
    for n, rows in enumerate(tables):
        out = io.StringIO()
        csv.writer(out, lineterminator=["\n", "\r\n", "\r"][n % 3]).writerows(rows)
        texts.append(out.getvalue())
    got = imports.parsed(listed(spark, texts)).select("path", F.transform("records", imports.cells).alias("rows")).orderBy("path").collect()
    assert [r["rows"] for r in got] == [[[c.strip() for c in row] for row in rows] for rows in tables]


def test_odd_quotes_and_long_records(spark):
    odd = 'a"b,"c"d,"open\nx'
    long = "h,k\n" + '"' + 'say ""x"", ' * 60_000 + '",' + "y" * 200_000 + "\n" + ",".join(["z"] * 20_000)
    got = imports.parsed(listed(spark, [odd, long, "", "\n\n", ",\n"])).select("path", F.transform("records", imports.cells).alias("rows")).orderBy("path").collect()
    rows = [r["rows"] for r in got]
    assert rows[0] == list(csv.reader(io.StringIO(odd)))
    assert [len(x) for x in rows[1]] == [2, 2, 20_000] and rows[1][1][0] == ('say "x", ' * 60_000).strip()
    assert rows[2:] == [[], [], [["", ""]]]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("catalogue")
    (root / "incoming" / "deep").mkdir(parents=True)
    (root / "profiles").mkdir()
    put = lambda name, text, encoding="utf-8": (root / "incoming" / name).write_bytes(text.encode(encoding))
    put("database-tables__main.csv", HEAD + 'main,app,users,\nMAIN,app,"""Mixed Case""",view\nother,app,x,table\nmain,,y,table\nmain,app,z,index\nmain,app,USERS,table\n', "utf-8-sig")
    put("database-columns__main.csv", "column_name,object_name,schema_name,database_key,nullable,extra\nid,users,app,main,y,1\nname,users,app,main,n,2,more\nid,absent,app,main,y,3\n")
    put("deep/database-tables__wide.csv", HEAD + "wide,s,表,table\n", "cp932")
    put("deep/database-tables__utf.csv", HEAD + "utf,s,été,table\n", "utf-16")
    put("headless.csv", "")
    put("only-header.csv", "Code,Label\n")
    put("labels.csv", "code,LABEL,Active\n1,one,yes\n2,two,\n1,one,true\n1,uno,yes\n")
    put("clash.csv", "code,label,active,kind\n9,x,1,1\n")
    put("notes.txt", "code,label\n3,x\n")
    put("big.csv", "code,label\n" + "4,x\n" * 5000)
    (root / "incoming" / "bad.csv").write_bytes(b"code,label\n\xff\xff\xfe\xfd,\x81\n")
    (root / "profiles" / "labels.json").write_text('{"name": "labels", "catalogType": "labels", "match": {"requiredHeaders": ["Code", "Label"]}, "fields": {"code": "code", "label": {"column": "label", "default": "none"}, "active": "active", "origin": {"constant": "hand"}}, "transforms": {"label": ["upper"], "active": ["bool"]}, "output": {"filename": "labels.csv", "fields": ["code", "label", "active", "origin"], "identity": ["code"]}}')
    (root / "profiles" / "second.json").write_text('{"catalogType": "kinds", "match": {"filename": "cl*.csv", "requiredHeaders": ["kind"]}, "fields": {"kind": "kind"}, "output": {"filename": "kinds.csv", "fields": ["kind"]}}')
    return str(root)


def taken(spark, folder, policy="error"):
    return imports.imported(imports.csv_files(spark, folder, limit=10_000), imports.profiles(spark, f"{folder}/profiles"), policy)


def test_a_report_for_each_file(spark, folder):
    found = taken(spark, folder)
    got = {r.path: (r.catalog_type, r.database_key, r.profile, r.rows_read, r.rows_imported, r.rows_rejected, r.status) for r in found.reports.collect()}
    none = ("unknown", "", "", 0, 0, 0, "rejected")
    assert got == {
        "database-tables__main.csv": ("database-tables", "MAIN", "builtin-database-tables", 6, 2, 4, "partial"),
        "database-columns__main.csv": ("database-columns", "MAIN", "builtin-database-columns", 3, 2, 1, "partial"),
        "deep/database-tables__wide.csv": ("database-tables", "WIDE", "builtin-database-tables", 1, 1, 0, "imported"),
        "deep/database-tables__utf.csv": ("database-tables", "UTF", "builtin-database-tables", 1, 1, 0, "imported"),
        "labels.csv": ("labels", "", "labels", 4, 3, 1, "partial"),
        "only-header.csv": ("labels", "", "labels", 0, 0, 0, "imported"),
        "headless.csv": none, "clash.csv": none, "big.csv": none, "bad.csv": none,
    }
    said = {r.path: r.message for r in found.reports.where("status = 'rejected'").collect()}
    assert said["clash.csv"] == "several profiles: labels, second" and said["big.csv"] == "the file is too large" and said["bad.csv"] == "the encoding is not known"
    issues = sorted((r.path, r.line or 0, r.issue_type[8:]) for r in found.issues.collect())
    assert issues == [
        ("bad.csv", 0, "INVALID_FILE"), ("big.csv", 0, "INVALID_FILE"), ("clash.csv", 0, "INVALID_FILE"), ("database-columns__main.csv", 4, "REFERENCE_MISSING"), ("database-tables__main.csv", 4, "INVALID_ROW"),
        ("database-tables__main.csv", 5, "INVALID_ROW"), ("database-tables__main.csv", 6, "INVALID_ROW"), ("database-tables__main.csv", 7, "CONFLICT"), ("headless.csv", 0, "UNKNOWN_SCHEMA"), ("labels.csv", 5, "CONFLICT"),
    ]
    assert sorted(r.object_name for r in found.tables.collect()) == ["Mixed Case", "USERS", "ÉTÉ", "表"]
    assert sorted((r.column_name, r.nullable) for r in found.columns.collect()) == [("ID", "Y"), ("NAME", "N")]
    assert sorted(r.value for r in found.rows.collect()) == [["1", "ONE", "Y", "hand"], ["2", "TWO", "N", "hand"]]


def test_policies_keep_the_first_or_the_last(spark, folder):
    first, last = taken(spark, folder, "first-wins"), taken(spark, folder, "last-wins")
    assert {r.value[1] for r in first.rows.collect()} == {"ONE", "TWO"} and {r.value[1] for r in last.rows.collect()} == {"UNO", "TWO"}
    kinds = lambda found: {r.object_name: (r.object_type, r.source_line) for r in found.tables.where("database_key = 'MAIN'").collect()}
    assert kinds(first)["USERS"] == ("TABLE", 2) and kinds(last)["USERS"] == ("TABLE", 7)
    assert first.issues.where("issue_type = 'CATALOG_CONFLICT'").isEmpty() and last.reports.where("path = 'labels.csv' and status = 'imported' and rows_imported = 4").count() == 1
    with pytest.raises(ValueError):
        taken(spark, folder, "any")


def test_no_files_and_profiles_that_do_not_fit(spark):
    found = imports.imported(listed(spark, ["x"]).where("false"), [])
    assert found.reports.isEmpty() and found.tables.isEmpty() and found.columns.isEmpty() and found.issues.isEmpty()
    assert [r.status for r in imports.imported(listed(spark, ["a,b\n1,2"]), []).reports.collect()] == ["rejected"]
    make = lambda **kw: imports.Profile(**({"name": "p", "catalog_type": "k", "required": ("a",), "fields": {"a": "a"}, "output": "a.csv", "output_fields": ("a",)} | kw))
    make()
    for wrong in ({"required": ()}, {"fields": {}}, {"output": ""}, {"output": "../a.csv"}, {"output_fields": ("a", "a")}, {"output_fields": ("b",)}, {"identity": ("b",)}):
        with pytest.raises(ValueError):
            make(**wrong)
    with pytest.raises(ValueError):
        imports.imported(listed(spark, ["a\n1"]), [make(), make(name="q", identity=("a",))])


def test_a_catalogue_is_published_whole(spark, folder, tmp_path):
    root = str(tmp_path / "package")
    imports.publish_import(taken(spark, folder), root)
    tables, columns = published.opened(spark, root, "tables"), published.opened(spark, root, "columns")
    assert tables.columns == ["database", "table_code", "schema", "columns_file"] and tables.count() == 4
    assert {r.table_code for r in tables.join(columns, "columns_file", "left_semi").collect()} == {"USERS"}
    assert published.opened(spark, root, "reports").count() == 10 and published.damaged(spark, root).isEmpty()
