"""Readers of source files, package CSVs and line-wise JSON, with decoding, newline styles and comments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.contract import table

# Folders that are not read.
PRUNED = ("node_modules", "bin", "obj", ".git", ".svn", "dist", "target")
SIZE_LIMIT = 5_000_000

GRAPH_SCHEMAS = {
    "nodes": "stable_id string, node_type string, name string, qualified_name string, system_key string, database_key string",
    "edges": "edge_id string, source string, target string, edge_type string, layer string, operation string, confidence double",
    "evidence": "edge_id string, source_path string, start_line int, confidence double",
}


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...], limit: int = SIZE_LIMIT) -> DataFrame:
    """path, content, sha256, too_large of the files under root with one of the suffixes, pruned folders left out; only the size of too large ones is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    pruned = "/(" + "|".join(p.replace(".", r"\.") for p in PRUNED) + ")/"
    kept = found.where(~F.col("path").rlike(pruned)).where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    large = F.col("length") > limit
    return kept.select("path", F.when(~large, F.col("content")).alias("content"), F.when(~large, F.sha2("content", 256)).alias("sha256"), large.alias("too_large"))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def decode(content: pd.Series) -> pd.DataFrame:
    """Text and encoding of each file: a byte order mark, then UTF-8, UTF-16 by its zeros, then the Japanese encoding with more Japanese letters; null where none fits."""
    rows = []
    for raw in content:
        rows.append((None, None) if raw is None else _decoded(bytes(raw)))
    return pd.DataFrame(rows, columns=["text", "encoding"])


def _decoded(raw: bytes) -> tuple[str | None, str | None]:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            return raw.decode(name, "strict"), name
    zeros = raw.count(0)
    names = ["utf-16-le" if raw[1::2].count(0) >= raw[::2].count(0) else "utf-16-be"] if zeros > len(raw) // 4 else ["utf-8"]
    for name in names:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            pass
    best = None
    for name in ("cp932", "euc_jp"):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        score = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in text) - 2 * sum("｡" <= c <= "ﾟ" for c in text)
        if best is None or score > best[0]:
            best = (score, text, name)
    return (best[1], best[2]) if best else (None, None)


def newline_style(text: Column) -> Column:
    """CRLF, LF, CR, mixed or none."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf, cr = F.regexp_count(text, F.lit("(?<!\r)\n")), F.regexp_count(text, F.lit("\r(?!\n)"))
    kinds = (crlf > 0).cast("int") + (lf > 0).cast("int") + (cr > 0).cast("int")
    return F.when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf > 0, "CRLF").when(lf > 0, "LF").otherwise("CR")


# Comments by language; string literals are matched first, so that marks inside them don't count.
COMMENTS = {
    "sql": r"'(?:[^']|'')*'|(--[^\n]*|/\*[\s\S]*?\*/)",
    "html": r"(<!--[\s\S]*?-->)",
    "c": r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|(//[^\n]*|/\*[\s\S]*?\*/)",
}


def comments(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key, n, kind, comment for each comment of a text, in order."""
    found = F.filter(F.regexp_extract_all(text, F.lit(COMMENTS[language]), F.lit(1)), lambda c: c != "")
    rows = df.select(key, F.posexplode(found).alias("n", "comment"))
    kind = F.when(F.col("comment").rlike(r"^(--|//)"), "LINE").otherwise("BLOCK")
    return rows.select(key, "n", kind.alias("kind"), "comment")


def package(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a graph package: all CSV parts of its folder, with the contract's schema; malformed rows fail."""
    options = {"header": "true", "multiLine": "true", "escape": '"', "mode": "FAILFAST", "nullValue": "", "emptyValue": '""'}
    return spark.read.schema(GRAPH_SCHEMAS[name]).options(**options).csv(f"{root}/{name}")


def memory(spark: SparkSession, path: str, schema: T.StructType | str, kind: str | None = None, contains: str | None = None, limit: int = 50) -> DataFrame:
    """Rows of line-wise JSON by kind and a part of their text."""
    rows = spark.read.schema(schema).json(path)
    if kind is not None:
        rows = rows.where(F.col("kind") == kind)
    if contains is not None:
        rows = rows.where(F.contains(F.lower("text"), F.lit(contains.lower())))
    return rows.limit(limit)


def dependencies(rows: DataFrame, system_owners: tuple[str, ...] = ("SYS", "SYSTEM", "PUBLIC")) -> DataFrame:
    """Pairs of objects of an ALL_DEPENDENCIES export, in capitals, without the system's own."""
    pick = rows.select(*[F.upper(F.trim(F.col(c))).alias(c) for c in ("OWNER", "NAME", "TYPE", "REFERENCED_OWNER", "REFERENCED_NAME", "REFERENCED_TYPE")])
    return pick.where(~F.col("REFERENCED_OWNER").isin(*system_owners)).distinct()


def project_closure(references: DataFrame, starts: DataFrame, rounds: int = 50) -> DataFrame:
    """references: project, refers_to; starts: project. Every project that the starts refer to, directly or not, and themselves."""
    from tracelake.sources.scratch import written

    seen = front = written(starts.select("project").distinct())
    for _ in range(rounds):
        front = front.join(references, "project").select(F.col("refers_to").alias("project")).distinct()
        front = written(front.join(seen, "project", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


QUERIES = {
    "page_comments": lambda s, d: comments(table(s, d, "pages"), "page_id", "html", "html").groupBy("kind", "n").agg(F.count(F.lit(1)).alias("pages"), F.max(F.length("comment")).alias("longest")),
    "newline_styles": lambda s, d: table(s, d, "documents").select(newline_style(F.col("text")).alias("style")).groupBy("style").agg(F.count(F.lit(1)).alias("n")),
    "source_inventory": lambda s, d: table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), (F.octet_length("html") > 10_000).alias("too_large")),
    "project_closure": lambda s, d: project_closure(table(s, d, "orders").select(F.col("o_custkey").alias("project"), (F.col("o_orderkey") % 97).alias("refers_to")).distinct(), s.createDataFrame([(3,)], "project long")),
}
ORACLES = {
    "page_comments": r"select case when true then 'BLOCK' end as kind, (n - 1)::int as n, count(*) as pages, max(length(c))::int as longest from (select generate_subscripts(l, 1) as n, unnest(l) as c from (select regexp_extract_all(html, '<!--[\s\S]*?-->') as l from pages)) group by all",
    "newline_styles": r"with s as (select regexp_matches(text, '\r\n') as a, regexp_matches(text, '(^|[^\r])\n') as b, regexp_matches(text, '\r([^\n]|$)') as c from documents) select case when a::int + b::int + c::int = 0 then 'none' when a::int + b::int + c::int > 1 then 'mixed' when a then 'CRLF' when b then 'LF' else 'CR' end as style, count(*) as n from s group by 1",
    "source_inventory": "select page_id, sha256(html) as sha256, strlen(html) > 10000 as too_large from pages",
    "project_closure": "with recursive r as (select distinct o_custkey as p, o_orderkey % 97 as q from orders), c as (select 3::bigint as project union select q from c join r on p = project) select project from c",
}
