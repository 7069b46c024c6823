"""Catalogues from many CSV files: a file's own header decides on its profile, rows are mapped, checked and merged by identity, and each file has a report.

Headers may differ from file to file, so no schema is given to a reader: files are opened whole, and expressions cut them into records and cells. One pass serves all profiles; what an
identity keeps is an aggregate, combined before the shuffle.
"""

from __future__ import annotations

import fnmatch
import json
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.functions.names import sql_name
from tracelake.operators.catalogue import OBJECT_TYPES
from tracelake.sources.published import publish
from tracelake.sources.readers import decode
from tracelake.sources.scratch import written

#: Bytes of a file, which is one row; a larger one is reported as rejected.
FILE_LIMIT = 256_000_000

# Names of files with a profile of their own, the fields of both kinds, and what counts as true.
NAMED = r"(?i)^database-(tables|columns)__([A-Za-z0-9_.-]+)\.csv$"
TABLE_FIELDS = ("database_key", "schema_name", "object_name", "object_type", "status", "comment")
COLUMN_FIELDS = (
    "database_key", "schema_name", "object_name", "column_name", "ordinal_position", "data_type", "data_length", "data_precision", "data_scale", "nullable",
    "default_value", "primary_key", "comment",
)
TRUE = ("1", "true", "yes", "y")
TABLES, COLUMNS = "database-tables", "database-columns"
IDENTITY = {TABLES: TABLE_FIELDS[:3], COLUMNS: COLUMN_FIELDS[:4]}
CAPITALS = {TABLES: ("object_type", "status"), COLUMNS: ("data_type", "nullable", "primary_key")}
POLICIES = ("error", "first-wins", "last-wins")

# A cell with its quotes, and a record; possessive, so that long ones need no stack.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"?)?+[^,\r\n]*+'
_RECORD = rf"({_CELL}(?:,{_CELL})*+)(?:\r\n|\r|\n|\z)"


@dataclass(frozen=True)
class Profile:
    """How files with the required headers are read. fields: target to a header, or to {"constant": ...}, {"column": ..., "default": ...} or {"fromFilename": "database_key"}."""

    name: str
    catalog_type: str
    required: tuple[str, ...]
    fields: dict = field(hash=False)
    filename: str = "*.csv"
    transforms: dict = field(default_factory=dict, hash=False)
    output: str = ""
    output_fields: tuple[str, ...] = ()
    identity: tuple[str, ...] = ()

    def __post_init__(self):
        if not (self.required and self.fields and self.catalog_type):
            raise ValueError(f"profile {self.name} needs a type, required headers and fields")
        if self.catalog_type in IDENTITY:
            return
        if not self.output or not self.output_fields or ".." in self.output.split("/") or self.output.startswith("/"):
            raise ValueError(f"profile {self.name} needs an output inside the package, and its fields")
        if len(set(self.output_fields)) < len(self.output_fields) or not set(self.identity) <= set(self.output_fields) <= {*self.fields, "database_key"}:
            raise ValueError(f"profile {self.name}: output fields are mapped and named once, and the identity is made of them")


@dataclass(frozen=True)
class Imported:
    """tables, columns: a row for each identity; rows: output, key, value of the other outputs; reports: one for each file; issues: files and rows that were not taken."""

    tables: DataFrame
    columns: DataFrame
    rows: DataFrame
    reports: DataFrame
    issues: DataFrame


BUILT_IN = (
    Profile("builtin-database-tables", TABLES, TABLE_FIELDS[:3], {f: f for f in TABLE_FIELDS}),
    Profile("builtin-database-columns", COLUMNS, COLUMN_FIELDS[:4], {f: f for f in COLUMN_FIELDS}),
)


def profiles(spark: SparkSession, folder: str) -> list[Profile]:
    """The profiles in a folder's JSON files, by file name: a fixed list, written by hand."""
    read = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder).select(F.col("_metadata.file_name").alias("name"), "value")
    out = []
    for row in read.orderBy("name").collect():
        p = json.loads(row["value"])
        match, output = p.get("match") or {}, p.get("output") or {}
        out.append(
            Profile(
                p.get("name") or row["name"].rsplit(".", 1)[0], p.get("catalogType") or "", tuple(match.get("requiredHeaders") or ()), p.get("fields") or {}, match.get("filename") or "*.csv",
                p.get("transforms") or {}, output.get("filename") or "", tuple(output.get("fields") or ()), tuple(output.get("identity") or ()),
            )
        )
    return out


def csv_files(spark: SparkSession, root: str, limit: int = FILE_LIMIT) -> DataFrame:
    """path (within root, or within its folder `incoming` if it has one), bytes, sha256, text of the CSV files, profiles left out. Only the size of files over the limit is read.

    A reader gives no row for an empty file; those come from the reader's own list of names, which the driver holds for every scan.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop.Path(at, "incoming")):
        at = hadoop.Path(at, "incoming")
    base = fs.makeQualified(at).toString()
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    start = len(fs.makeQualified(at).toUri().getPath()) + 1
    every = spark.createDataFrame([(unquote(urlsplit(name).path)[start:],) for name in found.inputFiles()], "path string")
    own = F.substring("path", F.lit(len(base) + 2), F.length("path"))
    wanted = lambda name: name.rlike(r"\.csv$") & ~F.lower(name).rlike("(^|/)profiles/")
    found = found.where(wanted(own))
    empty = every.where(wanted(F.col("path"))).join(found.select(own.alias("path")), "path", "left_anti").select("path", F.lit(0).cast("long").alias("bytes"), F.sha2(F.lit(""), 256).alias("sha256"), F.lit("").alias("text"))
    small = found.where(F.col("length") <= limit).select(own.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), decode("content")["text"].alias("text"))
    large = found.where(F.col("length") > limit).select(own.alias("path"), F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("text"))
    return small.unionByName(large).unionByName(empty)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def cells(record: Column) -> Column:
    """The cells of a record: quotes around a cell go, doubled ones inside it become one, white space at its ends goes."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), F.lit(1))
    parts = r'(?s)^"([^"]*+(?:""[^"]*+)*+)"?(.*)$'
    bare = lambda c: F.concat(F.replace(F.regexp_extract(c, parts, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, parts, 2))
    return F.transform(raw, lambda c: _stripped(F.when(F.startswith(c, F.lit('"')), bare(c)).otherwise(c)))


def parsed(files: DataFrame) -> DataFrame:
    """files: path, bytes, sha256, text (null: unreadable). Each with its headers and records, the header's among them; empty lines are none. A written table."""
    records = F.filter(F.regexp_extract_all("text", F.lit(_RECORD), F.lit(1)), lambda r: r != "")
    rows = files.select("path", "bytes", "sha256", records.alias("records"))
    return written(rows.withColumn("headers", F.coalesce(cells(F.get("records", F.lit(0))), F.expr("cast(array() as array<string>)"))))


def _file_name() -> Column:
    return F.substring_index("path", "/", -1)


def headers(files: DataFrame) -> DataFrame:
    """path, sha256, headers, detected_type, database: what a look at each file tells, to write a profile from."""
    kind, database = F.lower(F.regexp_extract(_file_name(), NAMED, 1)), F.upper(F.regexp_extract(_file_name(), NAMED, 2))
    known = kind != ""
    return parsed(files).select("path", "sha256", "headers", F.when(known, F.concat(F.lit("database-"), kind)).alias("detected_type"), F.when(known, database).alias("database"))


def assigned(read: DataFrame, known: list[Profile]) -> DataFrame:
    """read: `parsed` files. Adds database (of the file's name), profile (null without exactly one), issue_type and message."""
    low = F.transform("headers", lambda h: F.lower(h))
    fits = lambda p: F.size(F.array_except(F.array(*[F.lower(F.lit(h)) for h in p.required]), low)) == 0
    kind = F.lower(F.regexp_extract(_file_name(), NAMED, 1))
    built_in = F.coalesce(*[F.when((kind == p.catalog_type.rpartition("-")[2]) & fits(p), F.lit(p.name)) for p in BUILT_IN])
    own = [F.when(_file_name().rlike(fnmatch.translate(p.filename)) & fits(p), F.lit(p.name)) for p in known]
    matching = F.array_compact(F.array(*own)) if own else F.expr("cast(array() as array<string>)")
    rows = read.withColumn("database", F.upper(F.regexp_extract(_file_name(), NAMED, 2))).withColumn("built_in", built_in).withColumn("own", matching)
    profile = F.when(F.col("records").isNotNull(), F.coalesce("built_in", F.when(F.size("own") == 1, F.get("own", F.lit(0)))))
    rows = rows.withColumn("profile", profile)
    fault = F.when(F.col("sha256").isNull(), "the file is too large").when(F.col("records").isNull(), "the encoding is not known")
    fault = fault.when(F.col("profile").isNull() & (F.size("own") > 1), F.concat(F.lit("several profiles: "), F.array_join("own", ", ")))
    unknown = F.when(F.col("profile").isNull(), F.concat(F.lit("no profile for headers: "), F.array_join("headers", ", ")))
    issue = F.when(fault.isNotNull(), "CATALOG_INVALID_FILE").when(F.col("profile").isNull(), "CATALOG_UNKNOWN_SCHEMA")
    return rows.select("path", "bytes", "sha256", "headers", "records", "database", "profile", issue.alias("issue_type"), F.coalesce(fault, unknown).alias("message"))


def _mapped(p: Profile) -> Column:
    """Target to value as a profile has it; of headers that repeat, the last one counts."""
    steps = {"trim": _stripped, "upper": F.upper, "lower": F.lower, "bool": lambda c: F.when(F.lower(_stripped(c)).isin(*TRUE), "Y").otherwise("N")}
    backwards = F.reverse(F.transform("headers", lambda h: F.lower(h)))

    def cell(header: str) -> Column:
        at = F.array_position(backwards, F.lower(F.lit(header)))
        return F.coalesce(F.when(at > 0, F.get("cells", (F.size("headers") - at).cast("int"))), F.lit(""))

    def value(spec) -> Column:
        if isinstance(spec, str):
            return cell(spec)
        if "constant" in spec:
            return F.lit(str(spec["constant"]))
        if spec.get("fromFilename") == "database_key":
            return F.col("database")
        found = cell(spec.get("column", ""))
        return F.when(found == "", F.lit(str(spec.get("default") or ""))).otherwise(found)

    out = {"database_key": F.col("database")}
    for target, spec in p.fields.items():
        out[target] = value(spec)
        for step in p.transforms.get(target, ()):
            out[target] = steps[step](out[target])
    if p.catalog_type == TABLES:
        out["object_type"] = F.when(out.get("object_type", F.lit("")) == "", "TABLE").otherwise(out.get("object_type", F.lit("")))
    for target in CAPITALS.get(p.catalog_type, ()):
        out[target] = F.upper(out[target]) if target in out else F.lit("")
    for target in IDENTITY.get(p.catalog_type, ()):
        out[target] = sql_name(_stripped(out[target])) if target in out else F.lit("")
    return F.create_map(*[x for target, v in out.items() for x in (F.lit(target), _stripped(v))])


def _kinds(known: list[Profile], of) -> Column:
    """What `of` makes of a row's profile, for all profiles in one expression."""
    out = None
    for p in (*BUILT_IN, *known):
        out = F.when(F.col("profile") == p.name, of(p)) if out is None else out.when(F.col("profile") == p.name, of(p))
    return out


def _values(names: tuple[str, ...]) -> Column:
    return F.array(*[F.col("fields")[n] for n in names])


def checked(files: DataFrame, known: list[Profile]) -> DataFrame:
    """files: `assigned`. A row for each record: path, line, output, key, value, fields, message (why it is invalid, else null). Lines are counted by records, from 2."""
    rows = files.where("profile is not null").select("path", "headers", "database", "profile", F.posexplode("records").alias("line", "record")).where("line > 0")
    rows = rows.select("path", (F.col("line") + 1).cast("long").alias("line"), "headers", "database", "profile", cells(F.col("record")).alias("cells"))
    rows = rows.withColumn("fields", _kinds(known, _mapped))
    rows = rows.withColumn("output", _kinds(known, lambda p: F.lit(p.catalog_type if p.catalog_type in IDENTITY else p.output)))
    rows = rows.withColumn("key", _kinds(known, lambda p: _values(IDENTITY.get(p.catalog_type) or p.identity or p.output_fields)))
    rows = rows.withColumn("value", _kinds(known, lambda p: _values(p.output_fields) if p.output_fields else F.expr("cast(array() as array<string>)")))
    graph = F.col("output").isin(TABLES, COLUMNS)
    missing = graph & F.exists("key", lambda k: F.coalesce(k, F.lit("")) == "")
    other = graph & (F.col("database") != "") & (F.get("key", F.lit(0)) != F.col("database"))
    kind = (F.col("output") == TABLES) & ~F.col("fields")["object_type"].isin(*OBJECT_TYPES)
    message = F.when(missing, "an identifier is missing or none").when(other, "another database than the file's name has").when(kind, "not a kind of object")
    return rows.select("path", "line", "output", "key", "value", "fields", message.alias("message"))


def imported(files: DataFrame, known: list[Profile], policy: str = "error") -> Imported:
    """files: path, bytes, sha256, text. Takes every record of every file with exactly one profile, in the order of paths and lines.

    A table or column that comes again is rejected by `error`, even with the same values, as its place is part of it; a row of another output only with other values. `first-wins` and
    `last-wins` keep one and reject none. Columns without a table are rejected. Files without a profile, with several, with an unknown encoding or over the limit are reported as rejected.
    A file without records but its header is imported with none; a null path or no file at all gives no rows; other columns are ignored.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {', '.join(POLICIES)}")
    shapes = {}
    for p in known:
        if p.output and shapes.setdefault(p.output, (p.output_fields, p.identity)) != (p.output_fields, p.identity):
            raise ValueError(f"profiles of {p.output} differ in fields or identity")
    sources = written(assigned(parsed(files.where("path is not null")), known))
    rows = written(checked(sources, known))
    place = F.struct("path", "line")
    best = F.max_by if policy == "last-wins" else F.min_by
    kept = rows.where("message is null").groupBy("output", "key").agg(best("value", place).alias("value"), best("fields", place).alias("fields"), best(place, place).alias("place"))
    kept = written(kept)
    columns, tables = kept.where(F.col("output") == COLUMNS), kept.where(F.col("output") == TABLES)
    owner = F.slice("key", 1, 3).alias("owner")
    owned = tables.select(F.col("key").alias("owner")).distinct()
    orphans = columns.select("place.*", owner).join(owned, "owner", "left_anti")
    held = columns.withColumn("owner", F.slice("key", 1, 3)).join(owned, "owner", "left_semi")

    issue = lambda kind, message: (F.lit(kind).alias("issue_type"), message.alias("message"))
    issues = rows.where("message is not null").select("path", "line", *issue("CATALOG_INVALID_ROW", F.col("message")))
    if policy == "error":
        again = rows.where("message is null").join(kept.select("output", "key", F.col("place"), F.col("value").alias("first")), ["output", "key"])
        again = again.where((place != F.col("place")) & (F.col("output").isin(TABLES, COLUMNS) | (F.col("value") != F.col("first"))))
        issues = issues.unionByName(again.select("path", "line", *issue("CATALOG_CONFLICT", F.lit("the identity is taken"))))
    issues = written(issues.unionByName(orphans.select("path", "line", *issue("CATALOG_REFERENCE_MISSING", F.lit("the column's table is in no catalogue")))))

    rejected = issues.groupBy("path").agg(F.count(F.lit(1)).alias("rows_rejected"))
    reports = sources.withColumn("rows_read", F.when(F.col("profile").isNull(), 0).otherwise(F.greatest(F.size("records") - 1, F.lit(0))).cast("long")).join(rejected, "path", "left")
    reports = reports.withColumn("rows_rejected", F.coalesce("rows_rejected", F.lit(0).cast("long")))
    status = F.when(F.col("profile").isNull(), "rejected").when(F.col("rows_rejected") > 0, "partial").otherwise("imported")
    reports = reports.select(
        "path", F.coalesce(_kinds(known, lambda p: F.lit(p.catalog_type)), F.lit("unknown")).alias("catalog_type"), F.when(F.col("profile").isNotNull(), F.col("database")).otherwise("").alias("database_key"),
        F.coalesce("profile", F.lit("")).alias("profile"), "sha256", "bytes", "rows_read", (F.col("rows_read") - F.col("rows_rejected")).alias("rows_imported"), "rows_rejected", status.alias("status"),
        F.coalesce("message", F.lit("")).alias("message"),
    )
    whole = sources.where("issue_type is not null").select("path", F.lit(None).cast("long").alias("line"), "issue_type", "message")
    typed = lambda df, names: df.select(*[F.coalesce(F.col("fields")[n], F.lit("")).alias(n) for n in names], F.col("place.path").alias("source_path"), F.col("place.line").alias("source_line"))
    return Imported(typed(tables, TABLE_FIELDS), typed(held, COLUMN_FIELDS), kept.where(~F.col("output").isin(TABLES, COLUMNS)).select("output", "key", "value"), reports, issues.unionByName(whole))


def normalised(found: Imported) -> tuple[DataFrame, DataFrame]:
    """Tables with the name of their columns' file, and columns with it: what the analysers read. The name is a hash of the table's identity."""
    file = F.concat(F.lit("tables/v3/"), F.substring(F.sha2(F.concat_ws("|", "database_key", "schema_name", "object_name"), 256), 1, 24), F.lit(".csv")).alias("columns_file")
    tables = found.tables.select(F.col("database_key").alias("database"), F.col("object_name").alias("table_code"), F.col("schema_name").alias("schema"), file)
    return tables, found.columns.select(file, F.col("column_name").alias("column_code"), "data_type", "nullable", "ordinal_position", F.col("schema_name").alias("schema"))


def publish_import(found: Imported, root: str) -> str:
    """The catalogue as a package that is there whole or not at all; tables and columns lie in order, so a table's columns are read from few parts."""
    tables, columns = normalised(found)
    parts = {"tables": tables.orderBy("database", "schema", "table_code"), "columns": columns.orderBy("columns_file", "column_code"), "rows": found.rows, "reports": found.reports, "issues": found.issues}
    return publish(parts, root)


_PROFILES = [
    Profile(
        "export", TABLES, ("owner", "table name"), {"database_key": {"constant": "archive"}, "schema_name": "Owner", "object_name": "Table Name", "object_type": {"column": "Kind", "default": "table"}, "comment": "Comment"},
        transforms={"comment": ("upper",)},
    ),
    Profile("fields", COLUMNS, ("Object", "Field"), {"database_key": {"constant": "archive"}, "schema_name": "Schema", "object_name": "Object", "column_name": "Field", "nullable": "Null"}, "fields-*.csv", {"nullable": ("bool",)}),
    Profile("brands", "brands", ("Brand", "Type"), {"brand": "Brand", "type": "Type"}, transforms={"type": ("lower",)}, output="brands.csv", output_fields=("brand", "type"), identity=("brand",)),
]


def _exports(s, d):
    """Parts as CSV files of ten, in six forms: named ones, three with profiles, one that no profile knows, one that two know."""
    p = table(s, d, "part").withColumn("f", F.expr("p_partkey div 10")).withColumn("form", F.col("f") % 6).withColumn("no", F.lpad(F.col("f").cast("string"), 9, "0"))
    size = F.col("p_size").cast("string")
    line = (
        F.when(F.col("form") == 0, F.concat_ws(",", F.concat(F.lit("db"), "f"), "p_type", F.concat(F.lit("t"), size), F.when(F.col("p_size") % 9 == 0, "index").otherwise("view")))
        .when(F.col("form") == 1, F.concat(F.lit('"a ""'), "p_name", F.lit('"",\nand more",'), "p_type", F.lit(' ,"t'), size, F.lit('",'), F.when(F.col("p_size") % 9 == 0, "index").otherwise("")))
        .when(F.col("form") == 2, F.concat_ws(",", "p_type", F.concat(F.lit("t"), size), F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")), F.lit("Yes")))
        .when(F.col("form") == 5, F.concat_ws(",", F.lit("x"), "p_brand", "p_type"))
        .otherwise(F.concat_ws(",", "p_type", size, "p_brand", "p_type"))
    )
    head = F.when(F.col("form") == 0, "database_key,schema_name,object_name,object_type").when(F.col("form") == 1, "Comment, OWNER ,Table Name,Kind").when(F.col("form") == 2, "Schema,Object,Field,Null")
    head = head.when(F.col("form") == 3, "a,b,c,d").when(F.col("form") == 4, "Owner,Table Name,Brand,Type").otherwise("Brand,Brand,Type")
    name = F.when(F.col("form") == 0, F.concat(F.lit("database-tables__db"), "f")).otherwise(F.concat(F.when(F.col("form") == 2, "fields-").otherwise("file-"), "no"))
    files = p.groupBy(F.concat(name, F.lit(".csv")).alias("path"), head.alias("head")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))).alias("lines"))  # ten lines
    text = F.concat("head", F.lit("\r\n"), F.array_join("lines.line", "\r\n"))
    return files.select("path", F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("sha256"), text.alias("text"))


def _normalised_counts(s, d):
    tables, columns = normalised(imported(_exports(s, d), _PROFILES))
    return tables.join(columns.groupBy("columns_file").agg(F.count(F.lit(1)).alias("n")), "columns_file", "left").select("database", "schema", "table_code", "columns_file", F.coalesce("n", F.lit(0)).alias("columns"))


QUERIES = {
    "catalogue_headers": lambda s, d: headers(_exports(s, d)).select("path", "sha256", F.array_join("headers", "|").alias("headers"), "detected_type", "database"),
    "catalogue_import_reports": lambda s, d: imported(_exports(s, d), _PROFILES).reports.drop("sha256", "message"),
    "catalogue_import_issues": lambda s, d: imported(_exports(s, d), _PROFILES).issues.select("path", "line", "issue_type"),
    "catalogue_import_last_wins": lambda s, d: imported(_exports(s, d), _PROFILES, "last-wins").rows.select("output", F.array_join("value", "|").alias("value")),
    "catalogue_normalised": _normalised_counts,
}

_P = """with p as (select *, p_partkey // 10 as f, (p_partkey // 10) % 6 as form, p_partkey % 10 + 2 as line, case when (p_partkey // 10) % 6 = 0 then 'database-tables__db' || (p_partkey // 10) when (p_partkey // 10) % 6 = 2 then 'fields-' || lpad((p_partkey // 10)::varchar, 9, '0') else 'file-' || lpad((p_partkey // 10)::varchar, 9, '0') end || '.csv' as path from part),
  l as (select *, case form when 0 then 'db' || f || ',' || p_type || ',t' || p_size || ',' || case when p_size % 9 = 0 then 'index' else 'view' end when 1 then '"a ""' || p_name || '"",' || chr(10) || 'and more",' || p_type || ' ,"t' || p_size || '",' || case when p_size % 9 = 0 then 'index' else '' end
    when 2 then p_type || ',t' || p_size || ',c' || (p_partkey % 3) || ',Yes' when 5 then 'x,' || p_brand || ',' || p_type else p_type || ',' || p_size || ',' || p_brand || ',' || p_type end as record from p),
  g as (select path, any_value(form) as form, any_value(f) as f, count(*) as n, case any_value(form) when 0 then 'database_key,schema_name,object_name,object_type' when 1 then 'Comment, OWNER ,Table Name,Kind' when 2 then 'Schema,Object,Field,Null' when 3 then 'a,b,c,d' when 4 then 'Owner,Table Name,Brand,Type' else 'Brand,Brand,Type' end as head, string_agg(record, chr(13) || chr(10) order by p_partkey) as body from l group by 1),
  x as (select path, f, form, head, n, head || chr(13) || chr(10) || body as text from g),
  t as (select *, row_number() over (partition by case form when 0 then 'DB' || f else 'ARCHIVE' end, upper(p_type), p_size order by path, line) as k from p where form in (0, 1) and p_size % 9 <> 0),
  c as (select *, row_number() over (partition by upper(p_type), p_size, p_partkey % 3 order by path, line) as k from p where form = 2),
  o as (select * from c where k = 1 and not exists (select 1 from t where t.form = 1 and upper(t.p_type) = upper(c.p_type) and t.p_size = c.p_size)),
  b as (select *, first_value(lower(p_type)) over (partition by p_brand order by path, line) as first, row_number() over (partition by p_brand order by path desc, line desc) as back from p where form = 5),
  i as (select path, line, 'CATALOG_INVALID_ROW' as issue_type from p where form in (0, 1) and p_size % 9 = 0 union all select path, line, 'CATALOG_CONFLICT' from t where k > 1 union all select path, line, 'CATALOG_CONFLICT' from c where k > 1
    union all select path, line, 'CATALOG_REFERENCE_MISSING' from o union all select path, line, 'CATALOG_CONFLICT' from b where lower(p_type) <> first)"""
ORACLES = {
    "catalogue_headers": _P + " select path, sha256(text) as sha256, replace(replace(head, ' OWNER ', 'OWNER'), ',', '|') as headers, case when form = 0 then 'database-tables' end as detected_type, case when form = 0 then 'DB' || f end as database from x",
    "catalogue_import_reports": _P + ", r as (select path, count(*) as bad from i group by 1) select path, case form when 0 then 'database-tables' when 1 then 'database-tables' when 2 then 'database-columns' when 5 then 'brands' else 'unknown' end as catalog_type, case when form = 0 then 'DB' || f else '' end as database_key, case form when 0 then 'builtin-database-tables' when 1 then 'export' when 2 then 'fields' when 5 then 'brands' else '' end as profile, strlen(text)::bigint as bytes, case when form in (3, 4) then 0 else n end as rows_read, case when form in (3, 4) then 0 else n - coalesce(bad, 0) end as rows_imported, coalesce(bad, 0) as rows_rejected, case when form in (3, 4) then 'rejected' when bad > 0 then 'partial' else 'imported' end as status from x left join r using (path)",
    "catalogue_import_issues": _P + " select path, line, issue_type from i union all select path, null, case form when 3 then 'CATALOG_UNKNOWN_SCHEMA' else 'CATALOG_INVALID_FILE' end from x where form in (3, 4)",
    "catalogue_import_last_wins": _P + " select 'brands.csv' as output, p_brand || '|' || lower(p_type) as value from b where back = 1",
    "catalogue_normalised": _P + ", n as (select upper(p_type) as schema, 'T' || p_size as table_code, count(*) as n from c where k = 1 group by 1, 2), w as (select case form when 0 then 'DB' || f else 'ARCHIVE' end as database, upper(p_type) as schema, 'T' || p_size as table_code from t where k = 1) select database, schema, table_code, 'tables/v3/' || substr(sha256(database || '|' || schema || '|' || table_code), 1, 24) || '.csv' as columns_file, case when database = 'ARCHIVE' then coalesce(n, 0) else 0 end as columns from w left join n using (schema, table_code)",
}
