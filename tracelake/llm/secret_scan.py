"""Multipart credential linking.

Some spans are secrets by their form alone (the base kinds). Others are weak: a random-looking string, a user or client
name, an address. Weak candidates are parts, each with an interval in its text. Two parts are in one scope if they stand in one section of the
text, which empty lines end, with at most SCOPE code points between them. An interval join finds the parts that have their complement there:

- An identifier (weak, or an access key) needs a secret: a weak one, an assigned one or a long hexadecimal one.
- A weak secret needs an identifier or a service's address; a long hexadecimal string is no reason to report an address.
- A service's address (a host, a database, a bucket) needs a weak or assigned secret; a plain web address needs an assigned secret, or a weak
  one that has its identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

# The patterns of the base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # a maximal run, so the same spans as [0-9a-f]+ of 24 or more
KINDS = ("assign", "access", "hex")

#: Parts that count only next to their complement. A weak secret has digits and both cases.
WEAK_SECRET = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])"
IDENTIFIER = r"""(?<![A-Za-z0-9])(?i:user(?:_?name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
SERVICE = r"""(?i:s3|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?<![A-Za-z0-9])(?i:host|server|endpoint|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}"""
WEB = r"""(?i:https?)://[^\s"'<>]+"""
SECTION_END = r"\n[\x20\t\r]*\n"
#: Code points between two parts of one scope, at most.
SCOPE = 256
#: Matches that one fold takes; a text with more is folded in parts.
FOLD = 256

#: rank, name and pattern of the weak kinds.
WEAK = ((3, "linked_secret", WEAK_SECRET), (4, "linked_id", IDENTIFIER), (5, "linked_endpoint", SERVICE), (6, "linked_endpoint", WEB))
#: By rank, assigned spans first: what a part is to others, and what it needs of them; a kind with nothing to need is reported anyway.
GIVES = {0: ("secret", "key", "credential"), 1: ("identifier",), 2: ("secret",), 3: ("secret", "key"), 4: ("identifier",), 5: ("service",)}
NEEDS = {3: ("identifier", "service"), 4: ("secret",), 5: ("key",), 6: ("credential",)}

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
NONE = f"cast(array() as array<{SPAN}>)"


def found(text: Column, pattern: str, rank: int, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points; matches whose group is shorter than `least` are dropped.

    The pieces between matches and the matches themselves alternate, so their lengths add up to the positions. They are added up in parts
    of FOLD matches, and each part is then moved by the length of those before it.
    """
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(F.coalesce(x["whole"], F.lit("")))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        good = x["whole"].isNotNull() & (F.char_length(x["value"]) >= least)
        return F.struct(end.cast("long").alias("at"), F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    def moved(part: Column, by: Column) -> Column:
        span = lambda s: F.struct((s["start"] + by).alias("start"), s["rank"].alias("rank"), (s["end"] + by).alias("end"), s["kind"].alias("kind"))
        return F.transform(part["out"], span)

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr(NONE).alias("out"))
    firsts = lambda x: F.sequence(F.lit(1), F.size(x), F.lit(FOLD))
    folded = lambda x: F.transform(firsts(x), lambda i: F.aggregate(F.slice(x, i, FOLD), zero, step))
    before = lambda parts: F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]))
    placed = lambda parts: F.filter(F.flatten(F.zip_with(parts, before(parts), lambda p, by: F.when(p.isNotNull(), moved(p, by)).otherwise(F.expr(NONE)))), lambda s: s.isNotNull())
    one = lambda x: F.element_at(F.transform(F.array(x), lambda y: placed(folded(y))), 1)
    return F.when(text.rlike(pattern), one(rows)).otherwise(F.expr(NONE))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def _by_rank(table: dict[int, tuple[str, ...]]) -> Column:
    out = F.expr("cast(array() as array<string>)")
    for rank, names in table.items():
        out = F.when(F.col("rank") == rank, F.array(*map(F.lit, names))).otherwise(out)
    return out


def in_scope(parts: DataFrame, others: DataFrame, scope: int) -> DataFrame:
    """parts: row, section, start, end, needs; others: row, section, start, end, gives. The parts that have what they need in their scope, each once.

    The interval join is dealt by text, section, what is needed and bin of positions: a part lies in each bin that it touches, and
    looks into those next to them. As a semi join it makes no pairs.
    """
    touched = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") - 1) / scope))
    near = F.sequence(F.floor(F.col("start") / scope) - 1, F.floor((F.col("end") - 1) / scope) + 1)
    left = parts.withColumn("what", F.explode("needs")).withColumn("bin", F.explode(touched))
    right = others.select("row", "section", F.col("start").alias("start2"), F.col("end").alias("end2"), F.explode("gives").alias("what"), near.alias("bins")).withColumn("bin", F.explode("bins")).drop("bins")
    gap = F.greatest("start", "start2") - F.least("end", "end2")
    keys = [left[k] == right[k] for k in ("row", "section", "what", "bin")]
    return left.join(right, [*keys, gap <= scope], "left_semi").drop("what", "bin").distinct()


def marked(docs: DataFrame, keep: list[str], scope: int = SCOPE) -> DataFrame:
    """doc (the columns `keep` of each row), base and more: the base spans and the linked parts of its text."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = F.array_sort(F.concat(found(text, ASSIGN, 0, "assign", 2, 6), found(text, ACCESS, 1, "access", 0, 20), found(text, HEX, 2, "hex")))
    any_ = text.rlike(WEAK_SECRET)
    for _, _, pattern in WEAK[1:]:
        any_ = any_ | text.rlike(pattern)
    weak = F.when(any_, F.concat(*(found(text, pattern, rank, kind) for rank, kind, pattern in WEAK))).otherwise(F.expr(NONE))
    ends = F.when(any_, found(text, SECTION_END, 0, "end")["start"]).otherwise(F.expr("cast(array() as array<bigint>)"))
    doc = F.struct(*(docs[f"`{c}`"] for c in keep))
    spans = written(docs.select(doc.alias("doc"), F.monotonically_increasing_id().alias("row"), base.alias("base"), weak.alias("weak"), ends.alias("ends")))

    rows = spans.where("size(weak) > 0").select("row", "base", "weak", "ends", F.explode(F.concat("base", "weak")).alias("p"))
    overlaps = lambda b: (b["start"] < F.col("p.end")) & (b["end"] > F.col("p.start"))
    # a weak part in a base span is that span; a weak secret in an identifier or address is no secret of its own
    inside = F.exists("base", overlaps) | ((F.col("p.rank") == 3) & F.exists("weak", lambda w: (w["rank"] > 3) & overlaps(w)))
    rows = rows.where((F.col("p.rank") < 3) | ~inside).select("row", "p.*", F.size(F.filter("ends", lambda e: e < F.col("p.start"))).alias("section"))
    parts = written(rows.withColumn("needs", _by_rank(NEEDS)).withColumn("gives", _by_rank(GIVES)))
    first = written(in_scope(parts.where("rank between 3 and 5"), parts, scope))
    # what an identifier or a service has made a credential
    credentials = parts.where("rank = 0").unionByName(first.where("rank = 3")).withColumn("gives", F.array(F.lit("credential")))
    every = first.unionByName(in_scope(parts.where("rank = 6"), credentials, scope))
    more = every.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end", "kind"))).alias("more"))
    return spans.select("row", "doc", "base").join(more, "row", "left").select("doc", "base", F.coalesce("more", F.expr(NONE)).alias("more"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """A row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    spans has all base spans, and of the weak parts (`linked_secret`, `linked_id`, `linked_endpoint`) those with a complement
    in their scope; a weak part inside a base span is that span. Null and empty texts have no spans, repeated rows
    each return, and a null doc_id is carried along. Other columns are ignored; an empty table gives no rows.
    """
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return marked(docs, ["doc_id"], scope).select(
        F.col("doc.doc_id").cast("long").alias("doc_id"), *map(of, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_linked"),
    )


def masked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The rows of `docs`, with all their columns; each stretch that spans of secrets cover gives way to the kind of its first span in angle brackets.

    Texts without spans, and null ones, stay as they are. Repeated rows each return; an empty table gives no rows.
    """
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("doc.text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        next_ = F.struct(F.concat(acc["out"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at"))
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], next_).otherwise(longer)

    spans = F.array_sort(F.concat("base", "more"))
    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("doc.text"), (acc["at"] + 1).cast("int"), F.char_length("doc.text"))))
    text = F.when(F.size(F.concat("base", "more")) == 0, F.col("doc.text")).otherwise(done)
    out = marked(docs, docs.columns, scope)
    return out.select(*(text.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
