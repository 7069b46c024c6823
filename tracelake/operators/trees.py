"""JSON documents as rows of their parts: opened, changed part by part, and closed again, all by built-in functions on VARIANT.

A document is opened level by level, so its depth costs a round and its width costs rows; no document is walked by one function. A part is known by its path: a key
for each step into an object, a position for each into an array. Closed documents have their keys in order, so equal documents are equal texts.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.contract import table
from tracelake.plans.calls import CALLS_SQL, _accesses, call_edges, call_nodes
from tracelake.sources.scratch import written

# Keys that say where something stands.
POSITION_KEYS = ("line", "start_line", "end_line", "start_column", "end_column", "column", "location", "source", "offset", "span")
#: Numbers up to this size, and texts of up to so many digits, are no compact identifiers.
SMALL, FEW_DIGITS = 2**31, 9
#: A document of up to so many characters is changed as one text; of a longer one, each part is a row.
SHORT = 100_000
#: Signs of structure, and what stands for them inside texts.
SIGNS, SHIELDS = "{}[],:", "\3\4\5\6\7\x0b"
#: Pieces of a flat text: a text (with a colon if it is a key), a number, anything between.
PIECE = r'"[^"]*+":?+|-?[0-9][-+.0-9eE]*+|[^"0-9-]++'


def _kind(value: Column) -> Column:
    schema = F.schema_of_variant(value)
    return F.when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "array").when(schema == "STRING", "text").otherwise("other")


def opened(docs: DataFrame, into: tuple[str, ...] = ("object", "array")) -> DataFrame:
    """docs: id, doc (JSON text). id, path, kind (object, array, text, other), value (VARIANT) of every part, the document itself with an empty path. Text that isn't JSON is null,
    as is a missing one. `into`: kinds that are opened; others are parts as they are."""
    none = F.array().cast("array<struct<key:string,pos:int>>")
    rows = docs.select("id", none.alias("path"), F.coalesce(F.try_parse_json("doc"), F.parse_json(F.lit("null"))).alias("value"))
    level = written(rows.withColumn("kind", _kind(F.col("value"))).select("id", "path", "kind", "value"), compression="zstd")
    every = level
    while True:
        inner = level.where(F.col("kind").isin(*into))
        if inner.isEmpty():
            return every
        inner = inner.select("id", "path", F.col("kind").alias("above"), F.col("value").alias("whole"))
        step = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("whole").outer()))
        at = F.struct(F.when(F.col("above") == "object", F.col("key")).alias("key"), F.when(F.col("above") == "array", F.col("pos")).alias("pos"))
        step = step.select("id", F.concat("path", F.array(at)).alias("path"), "value")
        level = written(step.withColumn("kind", _kind(F.col("value"))).select("id", "path", "kind", "value"), compression="zstd")
        every = every.unionByName(level)


def closed(parts: DataFrame, spaced: bool = False) -> DataFrame:
    """parts: id, path, kind, text (of parts that were not opened). id, doc: each document put together again, level by level from its deepest parts."""
    comma, colon = (", ", ": ") if spaced else (",", ":")
    parts = written(parts.select("id", "path", "kind", "text", F.size("path").alias("depth")), compression="zstd")
    deepest = parts.agg(F.max("depth")).first()[0] or 0
    below = parts.where(F.col("depth") == deepest).select("id", "path", "kind", "text").withColumn("text", F.coalesce("text", _empty()))
    for depth in range(deepest, 0, -1):
        last = F.element_at("path", -1)
        of = below.select("id", F.slice("path", 1, depth - 1).alias("path"), last["key"].alias("key"), last["pos"].alias("pos"), "text")
        member = F.when(F.col("key").isNull(), F.col("text")).otherwise(F.concat(_quoted(F.col("key")), F.lit(colon), "text"))
        held = of.withColumn("member", member).groupBy("id", "path").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "member"))).alias("m"))
        held = held.select("id", "path", F.array_join("m.member", comma).alias("inner"))
        here = parts.where(F.col("depth") == depth - 1).join(held, ["id", "path"], "left")
        text = F.when(F.col("inner").isNull(), F.coalesce("text", _empty())).when(F.col("kind") == "object", F.concat(F.lit("{"), "inner", F.lit("}"))).otherwise(F.concat(F.lit("["), "inner", F.lit("]")))
        below = written(here.select("id", "path", "kind", text.alias("text")), compression="zstd")
    return below.select("id", F.col("text").alias("doc"))


def _quoted(text: Column) -> Column:
    """The text as JSON."""
    return F.to_json(F.to_variant_object(F.array(text))).substr(F.lit(2), F.char_length(F.to_json(F.to_variant_object(F.array(text)))) - 2)


def _empty() -> Column:
    return F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise("null")


def texts(parts: DataFrame, into: tuple[str, ...] = ("object", "array"), also: tuple[str, ...] = ()) -> DataFrame:
    """The parts with their own JSON text; opened ones have none."""
    return parts.select("id", "path", "kind", *also, F.when(~F.col("kind").isin(*into), F.to_json("value")).alias("text"))


def without_keys(parts: DataFrame, keys: tuple[str, ...] = POSITION_KEYS) -> DataFrame:
    """The parts that don't stand under one of the keys, at any depth."""
    return parts.where(~F.exists("path", lambda s: F.coalesce(s["key"].isin(*keys), F.lit(False))))


def references(parts: DataFrame, one: str = "ref_node_id", many: str = "ref_node_ids") -> DataFrame:
    """id, node: texts under the key `one`, and in lists under the key `many`, at any depth."""
    last, before = F.try_element_at("path", F.lit(-1)), F.try_element_at("path", F.lit(-2))
    named = (last["key"] == one) | (last["pos"].isNotNull() & (before["key"] == many))
    found = parts.where((F.col("kind") == "text") & F.coalesce(named, F.lit(False))).select("id", F.variant_get("value", "$", "string").alias("node"))
    return found.where("node <> ''").distinct()


def references_of(docs: DataFrame, one: str = "ref_node_id", many: str = "ref_node_ids") -> DataFrame:
    """docs: id, doc. The `references` of whole documents. Only parts whose text has one of the keys are opened, and of other parts only texts that may be references are kept."""
    names = [json.dumps(key, ensure_ascii=False) for key in (one, many)]
    holds = lambda text, after="": F.contains(text, F.lit(names[0] + after)) | F.contains(text, F.lit(names[1] + after))
    # Made inside explode, a document is put into text and parsed once; filters would repeat it. A key may be written with escapes.
    wanted = F.filter(F.array("doc"), lambda d: holds(d) | F.contains(d, F.lit("\\")))
    level = docs.select("id", F.lit(False).alias("list"), F.explode_outer(F.transform(wanted, lambda d: F.try_parse_json(d))).alias("whole"))
    found = None

    def kept(part: Column) -> Column:
        text, is_list = F.startswith(part["json"], F.lit('"')), F.startswith(part["json"], F.lit("["))
        listed = is_list & F.coalesce(F.col("key") == many, F.lit(False))
        opens = listed | ((is_list | F.startswith(part["json"], F.lit("{"))) & holds(part["json"], ":"))
        named = text & F.coalesce((F.col("key") == one) | (F.col("list") & F.col("key").isNull()), F.lit(False))
        return F.struct(listed.alias("list"), F.when(opens, part["value"]).alias("whole"), F.when(named, F.variant_get(part["value"], "$", "string")).alias("node"))

    while True:
        step = level.lateralJoin(level.sparkSession.tvf.variant_explode(F.col("whole").outer()))
        parts = F.transform(F.array("value"), lambda v: F.struct(v.alias("value"), F.to_json(v).alias("json")))
        level = step.select("id", F.explode_outer(F.transform(parts, kept)).alias("p")).select("id", "p.*").where("whole is not null or node is not null")
        level = written(level, compression="zstd")
        here = level.where("node <> ''").select("id", "node")
        found = here if found is None else found.unionByName(here)
        level = level.where("whole is not null").select("id", "list", "whole")
        if level.isEmpty():
            return found.distinct()


def rewritten(parts: DataFrame, names: DataFrame) -> DataFrame:
    """parts as from `texts`, with value; names: old, new. Texts that are an old name become the new one."""
    named = parts.withColumn("old", F.when(F.col("kind") == "text", F.try_variant_get("value", "$", "string"))).join(names.groupBy("old").agg(F.min("new").alias("new")), "old", "left")
    return named.select("id", "path", "kind", F.when(F.col("new").isNotNull(), _quoted(F.col("new"))).otherwise(F.col("text")).alias("text"))


def restored(parts: DataFrame, names: DataFrame) -> DataFrame:
    """parts as from `texts`, with value; names: number, new. Large whole numbers, and long texts of digits, that are a compact identifier become its name."""
    number = F.when(F.schema_of_variant("value") == "BIGINT", F.try_variant_get("value", "$", "bigint"))
    digits = F.try_variant_get("value", "$", "string")
    number = F.coalesce(F.when((number > SMALL) | (number < -SMALL), number), F.when((F.col("kind") == "text") & (F.char_length(digits) > FEW_DIGITS) & digits.rlike("^-*[0-9]+$"), F.expr("try_cast(try_variant_get(value, '$', 'string') as bigint)")))
    named = parts.withColumn("number", number).join(names.groupBy("number").agg(F.min("new").alias("new")), "number", "left")
    return named.select("id", "path", "kind", F.when(F.col("new").isNotNull(), _quoted(F.col("new"))).otherwise(F.col("text")).alias("text"))


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """left, right: id, doc. id, doc: both as one. Objects are merged key by key, lists get the other's values that they lack, and of other values the left one stays unless it is
    null or empty. A document of one side only stays as it is."""
    only = ("object",)
    a, b = opened(left, only), opened(right, only)
    blank = F.is_variant_null("value") | F.to_json("value").isin('""', "[]", "{}")
    side = lambda df, s: df.select("id", "path", F.col("kind").alias(f"kind_{s}"), F.col("value").alias(f"value_{s}"), blank.alias(f"blank_{s}"))
    a, b = side(a, "a"), side(b, "b")
    # What the left side has as a value stays, and what the right side has under it goes.
    firm = a.where("kind_a <> 'object' and not blank_a").select("id", F.col("path").alias("above"))
    prefixes = b.where(F.size("path") > 0).select("id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", 1, n))).alias("above"))
    # Paths repeat, so the file of these parts says nothing of their size: they are never to be a broadcast.
    under = written(prefixes.join(firm.hint("merge"), ["id", "above"], "left_semi").select("id", "path").distinct())
    both = a.join(b.join(under, ["id", "path"], "left_anti"), ["id", "path"], "full")
    lists = (F.col("kind_a") == "array") & (F.col("kind_b") == "array")
    values = lambda s: F.transform(F.col(f"value_{s}").cast("array<variant>"), lambda v: F.to_json(v))
    joined = F.concat(F.lit("["), F.array_join(F.concat(values("a"), F.array_except(values("b"), values("a"))), ","), F.lit("]"))
    right_wins = F.col("value_a").isNull() | (F.col("blank_a") & F.col("value_b").isNotNull() & ~((F.col("kind_a") == "object") & (F.col("kind_b") == "object")))
    kind = F.when(right_wins, F.col("kind_b")).otherwise(F.col("kind_a"))
    text = F.when(lists & ~F.col("blank_a"), joined).when(right_wins, F.to_json("value_b")).otherwise(F.to_json("value_a"))
    rows = both.select("id", "path", kind.alias("kind"), F.when(kind != "object", text).alias("text"))
    return closed(rows)


def _parsed(doc: str = "doc") -> Column:
    return F.coalesce(F.try_parse_json(doc), F.parse_json(F.lit("null")))


def _flat(text: Column) -> Column:
    """JSON text whose quotes only begin and end texts: control characters, which JSON has escaped, stand for escaped backslashes and quotes."""
    return F.replace(F.replace(text, F.lit("\\\\"), F.lit("\1")), F.lit('\\"'), F.lit("\2"))


def _json(flat: Column) -> Column:
    return F.replace(F.replace(flat, F.lit("\2"), F.lit('\\"')), F.lit("\1"), F.lit("\\\\"))


def _shielded(flat: Column, signs: str, by: str) -> Column:
    """A flat text with the signs inside its texts replaced, those between them as they are."""
    inside = F.transform(F.split(flat, '"'), lambda t, i: F.when(i % 2 == 1, F.translate(t, signs, by)).otherwise(t))
    return F.array_join(inside, '"')


def _spaced_without(flat: Column, keys: tuple[str, ...]) -> tuple[Column, Column]:
    """A flat text in spaced form without what stands under the keys, and whether some is left, which holds more than one level."""
    shielded = _shielded(flat, SIGNS, SHIELDS)
    name = f'"(?:{"|".join(re.escape(k) for k in keys)})":'
    member = "(?<=[{,])" + name + r'(?:"[^"]*+"|\{[^{}\[\]]*+\}|\[[^{}\[\]]*+\]|[^"{}\[\],]++)(?:,|(?=\}))'
    rest = F.replace(F.regexp_replace(shielded, member, ""), F.lit(",}"), F.lit("}"))
    spaced = F.replace(F.replace(rest, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    return F.translate(spaced, SHIELDS, SIGNS), rest.rlike(name)


def _trees_by_parts(docs: DataFrame, key: str) -> DataFrame:
    parts = without_keys(texts(opened(docs)))
    under = parts.where(F.get("path", F.lit(0))["key"] == key).withColumn("path", F.slice("path", 2, 1_000_000))
    return closed(under, spaced=True).select("id", F.col("doc").alias("tree"))


def tree_fingerprints(docs: DataFrame, lines: DataFrame, key: str = "semantic_tree") -> DataFrame:
    """docs: id, doc; lines: id, line (an edge type, operation and target). id, fingerprint: the first 20 digits of the digest of a node's sorted edges with its tree, positions left out.

    A tree is one text; only where a position holds more than one level, or the document is long, is it opened and closed.
    """
    long = F.coalesce(F.char_length("doc") > SHORT, F.lit(False))
    # Made inside explode, a text is made once.
    flat = F.explode(F.array(F.when(~long, _flat(F.to_json(F.try_variant_get(_parsed(), f"$['{key}']", "variant"))))))
    flats = docs.select("id", "doc", long.alias("long"), flat.alias("flat"))
    text, left = _spaced_without(F.col("flat"), POSITION_KEYS)
    made = flats.select("id", "doc", F.explode(F.array(F.struct((F.col("long") | F.coalesce(left, F.lit(False))).alias("parts"), _json(text).alias("tree")))).alias("t"))
    made = written(made.select("id", F.when(F.col("t.parts"), F.col("doc")).alias("doc"), "t.parts", F.when(~F.col("t.parts"), F.col("t.tree")).alias("tree")), compression="zstd")
    trees, rest = made.where("not parts").select("id", "tree"), made.where("parts").select("id", "doc")
    if not rest.isEmpty():
        trees = trees.unionByName(rest.select("id").join(_trees_by_parts(rest, key), "id", "left"))
    trees = trees.withColumn("tree", F.when(~F.col("tree").isin("{}", "[]", '""', "0", "false"), F.col("tree")))
    listed = lines.groupBy("id").agg(F.array_sort(F.collect_list("line")).alias("l")).select("id", F.array_join(F.transform("l", _quoted), ", ").alias("edges"))
    payload = F.concat(F.lit('{"edges": ['), F.coalesce("edges", F.lit("")), F.lit('], "tree": '), F.coalesce("tree", F.lit("null")), F.lit("}"))
    return trees.join(listed, "id", "left").select("id", F.substring(F.sha2(payload, 256), 1, 20).alias("fingerprint"))


def _replaced(docs: DataFrame, names: DataFrame, key, long: Column, by_parts) -> DataFrame:
    """docs: id, doc; names: key, new. id, doc: pieces of a document that have a key among the names become the new text. `key` makes it of a piece, or null.

    A document is one row: only pieces with a key are looked up. Those for which `long` holds are changed `by_parts`.
    """
    long = F.coalesce(long | (F.char_length("doc") > SHORT), F.lit(False))
    docs = written(docs.select("id", F.when(long, F.col("doc")).alias("doc"), F.when(~long, _flat(F.to_json(_parsed()))).alias("flat")), compression="zstd")
    pieces = docs.where("flat is not null").select("id", F.regexp_extract_all("flat", F.lit(PIECE), F.lit(0)).alias("pieces"))
    keyed = F.filter(F.transform(F.array_distinct("pieces"), lambda p: F.struct(p.alias("piece"), key(p).alias("key"))), lambda p: p["key"].isNotNull())
    new = names.where("key is not null").groupBy("key").agg(_flat(_quoted(F.min("new"))).alias("new")).where("new <> 'null'")
    found = pieces.select("id", F.explode(keyed).alias("p")).select("id", "p.*").join(new, "key")
    found = found.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("piece", "new"))).alias("new"))
    rows = pieces.join(found, "id", "left")
    text = F.array_join(F.when(F.col("new").isNull(), F.col("pieces")).otherwise(F.transform("pieces", lambda p: F.coalesce(F.try_element_at("new", p), p))), "")
    rows, rest = rows.select("id", _json(text).alias("doc")), docs.where("flat is null").select("id", "doc")
    return rows if rest.isEmpty() else rows.unionByName(by_parts(texts(opened(rest), also=("value",))))


def rewritten_docs(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs: id, doc; names: old, new. `rewritten` for whole documents."""
    text = lambda p: F.when(F.startswith(p, F.lit('"')) & F.endswith(p, F.lit('"')), p)
    keys = names.where("old is not null").select(_flat(_quoted(F.col("old"))).alias("key"), "new")
    return _replaced(docs, keys, text, F.lit(False), lambda parts: closed(rewritten(parts, names)))


def restored_docs(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs: id, doc; names: number, new. `restored` for whole documents. A fraction may read like a whole number once it is parsed, so documents with one are changed part by part."""

    def number(p: Column) -> Column:
        whole = F.when(p.rlike("^-?[0-9]+$"), p.try_cast("bigint"))
        digits = F.when(p.rlike(f'^"(?=.{{{FEW_DIGITS + 1}}})-*[0-9]+"$'), F.btrim(p, F.lit('"')).try_cast("bigint"))
        return F.coalesce(F.when((whole > SMALL) | (whole < -SMALL), whole), digits)

    return _replaced(docs, names.select(F.col("number").alias("key"), "new"), number, F.col("doc").rlike("[0-9][.eE]"), lambda parts: closed(restored(parts, names)))


def _docs(s, d):
    """A tree for each procedure that has accesses: its steps with the targets they touch, and where they stand."""
    steps = _accesses(s, d).select("l_orderkey", "start_line", "l_partkey", "access", "target").distinct()
    step = F.struct("start_line", "l_partkey", "access", "target")
    rows = steps.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(step)).alias("s"))
    listed = F.transform("s", lambda x: F.struct(x["access"].alias("kind"), F.struct(x["start_line"].alias("start_line")).alias("span"), F.array(F.array(x["target"]), F.array()).alias("targets")))
    number = F.lit(5_000_000_000).cast("long") + F.col("l_orderkey")
    tree = F.struct(F.lit("procedure").alias("kind"), (F.col("l_orderkey") % 100).alias("line"), F.get("s", F.lit(0))["target"].alias("ref_node_id"), listed.alias("steps"))
    doc = F.to_json(F.struct(tree.alias("semantic_tree"), number.alias("owner"), F.array(number.cast("string"), F.lit("7")).alias("others")))
    return rows.select(F.concat(F.lit("procedure:"), F.col("l_orderkey").cast("string")).alias("id"), doc.alias("doc"))


def _lines(s, d):
    return call_edges(s, d).where("source like 'procedure:%'").select(F.col("source").alias("id"), F.concat("edge_type", F.lit("||"), "target").alias("line"))


def _rewritten(s, d):
    names = call_nodes(s, d).where("node_type = 'VIEW'").select(F.col("stable_id").alias("old"), F.concat(F.lit("table:"), F.substring_index("stable_id", ":", -1)).alias("new"))
    return rewritten_docs(_docs(s, d), names)


def _restored(s, d):
    names = table(s, d, "orders").select((F.lit(5_000_000_000).cast("long") + F.col("o_orderkey")).alias("number"), F.concat(F.lit("screen:"), F.col("o_custkey").cast("string")).alias("new"))
    return restored_docs(_docs(s, d), names)


def _merged(s, d):
    o = table(s, d, "orders")
    key = F.col("o_orderkey").cast("string").alias("id")
    left = o.select(key, F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("note").alias("note"), F.array(F.lit("a"), F.col("o_orderstatus")).alias("tags"), F.struct(F.col("o_custkey").alias("customer")).alias("of"))).alias("doc"))
    right = o.where("o_orderkey % 3 = 0").select(key, F.to_json(F.struct(F.lit("x").alias("status"), F.lit("other").alias("note"), F.array(F.lit("F"), F.lit("b"), F.lit("b")).alias("tags"), F.struct(F.lit(1).alias("customer"), F.col("o_orderpriority").alias("priority")).alias("of"))).alias("doc"))
    return merged(left, right)


QUERIES = {
    "tree_fingerprints": lambda s, d: tree_fingerprints(_docs(s, d), _lines(s, d)),
    "json_references": lambda s, d: references_of(_docs(s, d)),
    "json_rewritten": _rewritten,
    "json_ids_restored": _restored,
    "json_merged": _merged,
}

_STEPS = CALLS_SQL + """, st as (select distinct l_orderkey, l_linenumber, l_partkey, access, target from acc),
  tr as materialized (select l_orderkey as o, 5000000000 + l_orderkey as num, string_agg('{"kind": "' || access || '", "targets": [["' || target || '"], []]}', ', ' order by l_linenumber, l_partkey, access, target) as plain,
    string_agg('{"kind":"' || access || '","span":{"start_line":' || l_linenumber || '},"targets":[["' || target || '"],[]]}', ',' order by l_linenumber, l_partkey, access, target) as whole,
    string_agg('{"kind":"' || access || '","span":{"start_line":' || l_linenumber || '},"targets":[["' || replace(target, 'view:', 'table:') || '"],[]]}', ',' order by l_linenumber, l_partkey, access, target) as tables,
    arg_min(target, (l_linenumber, l_partkey, access, target)) as first from st group by 1) """
ORACLES = {
    "tree_fingerprints": _STEPS + """, l as (select source, string_agg('"' || edge_type || '||' || target || '"', ', ' order by edge_type || '||' || target) as edges from edges where source like 'procedure:%' group by 1)
      select 'procedure:' || o as id, sha256('{"edges": [' || coalesce(edges, '') || '], "tree": {"kind": "procedure", "ref_node_id": "' || first || '", "steps": [' || plain || ']}}')[:20] as fingerprint from tr left join l on source = 'procedure:' || o""",
    "json_references": _STEPS + "select 'procedure:' || o as id, first as node from tr",
    "json_rewritten": _STEPS + """select 'procedure:' || o as id, '{"others":["' || num || '","7"],"owner":' || num || ',"semantic_tree":{"kind":"procedure","line":' || (o % 100) || ',"ref_node_id":"' || replace(first, 'view:', 'table:') || '","steps":[' || tables || ']}}' as doc from tr""",
    "json_ids_restored": _STEPS + """select 'procedure:' || o as id, '{"others":["screen:' || o_custkey || '","7"],"owner":"screen:' || o_custkey || '","semantic_tree":{"kind":"procedure","line":' || (o % 100) || ',"ref_node_id":"' || first || '","steps":[' || whole || ']}}' as doc from tr join orders on o = o_orderkey""",
    "json_merged": """select o_orderkey::varchar as id, '{"note":"' || case when o_orderkey % 2 = 1 then 'note' when o_orderkey % 3 = 0 then 'other' else '' end || '","of":{"customer":' || o_custkey || case when o_orderkey % 3 = 0 then ',"priority":"' || o_orderpriority || '"' else '' end
      || '},"status":"' || o_orderstatus || '","tags":["a","' || o_orderstatus || '"' || case when o_orderkey % 3 = 0 then case when o_orderstatus = 'F' then ',"b"' else ',"F","b"' end else '' end || ']}' as doc from orders""",
}
