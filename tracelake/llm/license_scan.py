"""Exact set-similarity join of text blocks with licence templates.

A block is a run of consecutive words, also across lines, up to a quarter longer than the template. It matches a template when it has at least
CONTAINMENT of the template's distinct words, wherever in the text it stands. A block's words are its text's, so the join first looks for texts:
words are ordered by how many texts have them, rarest first. A text that holds a matching block has enough of the template's words (length filter);
among the first of its own words and of the template's, as long as the rest allows, they share one (prefix filter); and at the first one
they share, enough words are left behind in both (positional filter). Of what is left, every run is compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, texts, written

# Phrases that are places by themselves, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Openings and key sentences of well-known public licences.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "released under the mit license",
    ),
    "apache": (
        "licensed under the apache license version 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
}
CONTAINMENT = 0.8
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_WORDS), lambda w: w != "")


def templates() -> list[tuple[str, str, list[str]]]:
    """Label, text and distinct words of each template."""
    return [(label, text, sorted(set(text.split()))) for label, texts_ in TEMPLATES.items() for text in texts_]


def needed(n: int) -> int:
    """Shared words that reach the threshold for a template of n words."""
    return max(1, -int(-(n * CONTAINMENT) // 1))


def block_of(template: str) -> int:
    """Words of a block, at most."""
    n = len(template.split())
    return n + n // 4


def vocabulary() -> list[str]:
    return sorted({w for _, _, ws in templates() for w in ws})


#: Words that a text needs for the template that needs least.
LEAST = min(needed(len(ws)) for _, _, ws in templates())


def candidates(texts_: DataFrame) -> DataFrame:
    """texts_: row, w (all words in order), have (the templates' words among them). Each with every template of which it has enough words.

    Only word counts of the templates' vocabulary come to the driver; the templates are a fixed list, so their prefixes are broadcast.
    """
    spark = texts_.sparkSession
    counts = texts_.select(F.explode("have").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = {r.token: r.n for r in counts.collect()}  # at most the templates' words
    order = sorted(vocabulary(), key=lambda w: (often.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for k, (label, text, ws) in enumerate(templates()):
        ranked, need = sorted(ws, key=rank.get), needed(len(ws))
        rows += [(ranked[at], k, label, ranked, at, need, block_of(text)) for at in range(len(ws) - need + 1)]
    prefixes = F.broadcast(spark.createDataFrame(rows, "token string, template int, label string, words array<string>, at int, need int, block int"))
    own = F.array_intersect(F.lit(order), F.col("have"))  # in the global order
    near = texts_.withColumn("have", own).where(F.size("have") >= LEAST)
    near = near.select("*", F.posexplode(F.slice("have", F.lit(1), F.size("have") - LEAST + 1)).alias("place", "token")).join(prefixes, "token")
    long_enough = F.size("have") >= F.col("need")
    behind = F.least(F.size("have") - F.col("place"), F.size("words") - F.col("at")) >= F.col("need")
    # a pair is taken where it first meets
    first = F.size(F.array_intersect(F.slice("words", F.lit(1), F.col("at")), "have")) == 0
    near = near.where(long_enough & behind & first)
    return near.where(F.size(F.array_intersect("have", "words")) >= F.col("need")).select("row", "w", "template", "label", "words", "need", "block")


def matches(texts_: DataFrame) -> DataFrame:
    """row, template, label, at, containment: the text's best block for each template that one of its blocks matches, and the word with which it starts.

    A block may start at a word of the template: one that starts before it has none more.
    """
    starts = "filter(sequence(0, size(w) - 1), i -> array_contains(words, w[i]))"
    best = f"array_max(transform({starts}, i -> struct(size(array_intersect(words, slice(w, i + 1, block))) as shared, -i as earlier)))"
    found = candidates(texts_).withColumn("best", F.expr(best)).where("best.shared >= need")
    return found.select("row", "template", "label", (-F.col("best.earlier")).cast("long").alias("at"), (F.col("best.shared") / F.size("words")).alias("containment"))


def read(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, the places of each phrase, have, and w where a template may be in the text. A written table."""
    padded = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    places = []
    for phrase in PHRASES:
        parts = phrase.split()
        at = f"filter(sequence(0, size(w) - {len(parts)}), i -> " + " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(parts)) + ")"
        places.append(F.when(F.contains("padded", F.lit(f" {phrase} ")), F.expr(at)).otherwise(F.expr("cast(array() as array<int>)")))
    rows = texts(docs).select("doc_id", words(F.col("text")).alias("w")).withColumn("padded", padded).withColumn("have", F.array_intersect(F.lit(vocabulary()), F.col("w")))
    return written(
        rows.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.size("w").cast("long").alias("n_words"), *[p.alias(f"p{k}") for k, p in enumerate(places)],
            "have", F.when(F.size("have") >= LEAST, F.col("w")).alias("w"),
        )
    )


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, by_block.

    n_base counts the places of all phrases, also across lines. labels adds those of the templates that a block of the text matches; score is the largest
    containment, 1 where a phrase stands, and 0 without any. Null and empty texts have no words and no labels. Repeated
    rows each return, a null doc_id is carried along, other columns are ignored, an empty table gives no rows.
    """
    base = read(docs)
    every = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    own = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(PHRASES.values())]))))
    best = matches(base.select("row", "w", "have")).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = base.select("row", "doc_id", "n_words", every.alias("places"), own.alias("base_labels")).join(best, "row", "left")
    more = F.coalesce("more", F.expr("cast(array() as array<string>)"))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", more)), ",").alias("labels"), score.alias("score"), F.col("best").isNotNull().alias("by_block"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
