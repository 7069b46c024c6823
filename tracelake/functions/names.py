"""Paths, SQL names, routes, executables, slugs and other keys as Column functions. What has no canonical form is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of nodes by where they run.
DATABASE_TYPES = ("TABLE", "VIEW", "MATERIALIZED_VIEW", "COLUMN", "SEQUENCE", "SYNONYM", "PROCEDURE", "FUNCTION", "TRIGGER", "PLSQL_PACKAGE", "DATABASE", "DATABASE_SCHEMA", "INLINE_SQL", "SQL_FILE")
JOB_TYPES = ("JOB_NETWORK", "JOB")
OUTSIDE, UNKNOWN, OTHER = "Hệ thống ngoài", "Chưa xác định", "Khác"


def path(value: Column) -> Column:
    """A path relative to its repository, with forward slashes; null if absolute, empty, or one that leaves it."""
    plain = F.translate(F.trim(value), "\\", "/")
    parts = F.filter(F.split(plain, "/"), lambda p: (p != "") & (p != "."))
    bad = F.startswith(plain, F.lit("/")) | plain.rlike(r"^[A-Za-z]:/") | F.array_contains(parts, "..") | (F.size(parts) == 0)
    return F.when(~bad, F.array_join(parts, "/"))


def sql_part(part: Column) -> Column:
    """A part of an SQL name: a quoted one as it is written, another in upper case."""
    plain = F.trim(part)
    quoted = F.replace(F.substring(plain, F.lit(2), F.length(plain) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(plain, F.lit('"')), quoted).otherwise(F.upper(plain))


def sql_parts(value: Column) -> Column:
    """The parts between dots that stand outside quotes; null for an empty part or an open quote."""
    marked = F.concat(F.lit("."), F.trim(value))
    parts = F.transform(F.regexp_extract_all(marked, F.lit(r'\.((?:"(?:[^"]|"")*"|[^."])*)'), F.lit(1)), lambda p: F.trim(p))
    whole = F.concat(F.lit("."), F.array_join(parts, "."))
    sound = F.forall(parts, lambda p: p.rlike(r'^("([^"]|"")*"|[^"]+)$')) & (F.replace(whole, F.lit(" "), F.lit("")) == F.replace(marked, F.lit(" "), F.lit("")))
    return F.when(sound, F.transform(parts, sql_part))


def sql_name(value: Column) -> Column:
    return F.array_join(sql_parts(value), ".")


def leaf(value: Column) -> Column:
    """The last part of a dotted name, without a database link."""
    return F.element_at(sql_parts(F.split(value, "@")[0]), -1)


def owner(value: Column, default: str | None = None) -> Column:
    """The part before the last of a dotted name, else the default."""
    parts = sql_parts(F.split(value, "@")[0])
    return F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.lit(default))


def slug(value: Column) -> Column:
    """The last segment of a path in lower case; what is no letter, digit, hyphen, underscore or dot becomes one hyphen."""
    last = F.element_at(F.split(F.translate(F.trim(value), "\\", "/"), "/"), -1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(last), r"[^\p{L}\p{N}_.-]", "-"), "^-+|-+$", ""), "-{2,}", "-")
    return F.when(plain == "", "source").otherwise(plain)


def executable(name: Column) -> Column:
    """One name for a program, however its file is spelt: no folder, no `.exe`, no separators."""
    last = F.element_at(F.split(F.translate(F.trim(name), "\\", "/"), "/"), -1)
    return F.regexp_replace(F.regexp_replace(F.lower(last), r"\.exe$", ""), "[-_. ]", "")


def route(value: Column) -> Column:
    """A route without host, query and trailing slash, whose parameters are all `{id}`."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(value), r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    one = F.regexp_replace(F.concat(F.lit("/"), bare), "/+", "/")
    named = F.regexp_replace(one, r"\{[^/{}]+\}|<(?:[^:>/]+:)?[^/>]+>|:[A-Za-z_][A-Za-z0-9_]*", "{id}")
    return F.when(F.trim(value) != "", F.when(named == "/", named).otherwise(F.regexp_replace(named, "/+$", "")))


def route_key(verb: Column, value: Column) -> Column:
    """What calls and operations are matched by: the verb, and the route in lower case; null unless the verb is letters."""
    upper = F.upper(F.trim(verb))
    return F.when(upper.rlike("^[A-Z]+$"), F.concat(upper, F.lit(" "), F.lower(route(value))))


def system_of(node_type: Column, system: Column, database: Column, repository: Column) -> Column:
    """The lane a node is drawn in: the database for its objects, the repository for code."""
    return (
        F.when(node_type.isin(*JOB_TYPES), "Jobnet")
        .when(node_type.isin("EXTERNAL_DATABASE_OBJECT", "DATABASE_LINK"), F.coalesce(database, F.lit(OUTSIDE)))
        .when(node_type.isin("EXTERNAL_API_OPERATION", "EXTERNAL_SYSTEM"), F.coalesce(system, F.lit(OUTSIDE)))
        .when(node_type == "UNRESOLVED_REFERENCE", UNKNOWN)
        .when(node_type.isin(*DATABASE_TYPES) & database.isNotNull(), database)
        .otherwise(F.coalesce(repository, system, database, F.lit(OTHER)))
    )


def shortened(value: Column, most: int) -> Column:
    """At most so many characters, white space collapsed; what is cut ends in an ellipsis."""
    plain = F.trim(F.regexp_replace(value, r"\s+", " "))
    return F.when(F.length(plain) <= most, plain).otherwise(F.concat(F.rtrim(F.substring(plain, 1, most - 1)), F.lit("…")))


def small_id(stable_id: Column, salt: int = 0) -> Column:
    """A positive number below 2^60 for an id, from a digest; a salt gives another one."""
    text = F.concat(stable_id, F.lit(f"#{salt}")) if salt else stable_id
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
