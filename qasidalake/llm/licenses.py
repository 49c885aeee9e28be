"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of the text, or a window of consecutive words as long as the
template, wherever the lines break; a template is a set of words.  A block matches
where it holds at least ``THRESHOLD`` of a template's words, and the template's
``RULES`` allow it.  The template words are ordered by how many documents hold them,
rarest first, over all documents.  Then, with need = ceil(threshold * template size):

* prefix filter: a match holds one of the template's size - need + 1 rarest words, so
  the join's key is a prefix word: of the texts, only places of prefix words are dealt
  out, each with the words around it (or the template words of its line);
* length filter: those words hold at least ``need`` template words at all;
* positional filter: for the common word at place p of the template and q of the
  block, min(p, q) + 1 + min(words after p, words after q) is at least ``need``.

What passes is verified by counting: a line as it is; of the windows that hold the place, those that start
with a template word and those that end before a word that the rules bar.  Any other window holds no
more than one of them: moved on to its first template word it loses nothing, unless that takes in a barred word, and
then the one that ends before that word loses nothing.  The filters only skip pairs that cannot match,
so every match is found.  The templates are a parameter of the caller's, a few rows
that are broadcast; no text is shuffled, only (digest of the text, labels, score) of
texts that match and the result's own columns.

Only A-Z are lower-cased.  Null and empty texts have no words, no labels and a
score of 0; texts of any length are scanned whole.  Rows of equal text get equal
results; repeated rows and ids are all kept.  An empty table gives an empty result, an
id column named like a new column gets a longer name, other columns are not kept.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let
from .common import free_name

# Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Lines of well-known licenses and notices, with the label that each stands for.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: By label, words that a block of its templates must hold and words that it must not: what tells licenses apart
#: whose notices have nearly the same words.
RULES = {
    "gpl": (("general", "public"), ("lesser", "affero", "documentation", "library")),
    "cc-by-nc": (("nc",), ("nd", "sa")),
    "cc-by": (("attribution",), ("noncommercial", "sharealike", "noderivatives", "noderivs", "commercial", "derivatives")),
    "mpl": (("mozilla",), ()),
}
THRESHOLD = 0.8
#: Parts that the rows of one text are dealt into where its match is joined to them.
SALTS = 16
SEPARATORS = "[\\x00-/:-`{-\\x7f]+"


def template_words(text: str) -> list[str]:
    """A template's distinct words, in order of appearance."""
    return list(dict.fromkeys(re.findall("[a-z0-9]+", text.lower())))


def template_length(text: str) -> int:
    """A template's words with repetitions: the length of its windows."""
    return len(re.findall("[a-z0-9]+", text.lower()))


def needed(size: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased.

    ``lower`` also changes other letters, which changes neither a word's place nor
    an ASCII word, but for the two signs whose small form is an ASCII letter.
    """
    plain = F.replace(F.replace(text, F.lit("\u0130"), F.lit("\u0131")), F.lit("\u212a"), F.lit("\u0131"))
    return F.array_remove(F.split(F.lower(plain), SEPARATORS), "")


def document_frequencies(df: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the (fixed) vocabulary."""
    held = F.array_intersect(words_of(F.col(text_col).cast("string")), F.array(*map(F.lit, vocabulary)))
    counts = df.select(F.explode(held).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in counts.collect()}  # a row for each word of the vocabulary at most


def _base_places(words: Column) -> Column:
    """(place, label) of each base phrase, for texts that hold its last word."""

    def at(i: Column) -> Column:
        label = F.lit(None)
        for phrase, name in reversed(PHRASES):
            same = F.lit(True)
            for k, word in enumerate(phrase.split()):
                same = same & (F.get(words, i + k) == word)
            label = F.when(same, F.lit(name)).otherwise(label)
        return F.struct(i.alias("place"), label.alias("label"))

    some = F.array_contains(words, "license")
    every = F.filter(F.transform(F.sequence(F.lit(0), F.size(words) - 1), at), lambda x: x["label"].isNotNull())
    return F.when(some, every).otherwise(F.filter(F.array(at(F.lit(-9))), lambda x: F.lit(False)))


def _rarest_first(text: str, order: dict[str, int]) -> list[str]:
    return sorted(template_words(text), key=lambda w: (order[w], w))


def _prefix_words(templates, order: dict[str, int], threshold: float) -> set[str]:
    return {w for _, text in templates for w in _rarest_first(text, order)[: 1 + len(template_words(text)) - needed(len(template_words(text)), threshold)]}


def _template_rows(spark, templates, order: dict[str, int], threshold: float, rules) -> DataFrame:
    """A row for each prefix word of each template: (token, p, template, size, need, length, label, musts, bars)."""
    rows = []
    for label, text in templates:
        words = _rarest_first(text, order)
        need = needed(len(words), threshold)
        musts, bars = rules.get(label, ((), ()))
        musts = [w for w in musts if w in words]  # only what this wording of the license can have
        rows += [(word, p, words, len(words), need, template_length(text), label, musts, list(bars)) for p, word in enumerate(words[: len(words) - need + 1])]
    return spark.createDataFrame(rows, "token string, p int, template array<string>, size int, need int, length int, label string, musts array<string>, bars array<string>")


def license_matches(df: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, rules=RULES) -> DataFrame:
    """(key, labels, score) of the texts with a match: key is the text's digest, score the best block's containment."""
    vocabulary = sorted({w for _, text in templates for w in template_words(text)})
    frequencies = document_frequencies(df, text_col, vocabulary)
    order = {w: frequencies.get(w, 0) for w in vocabulary}
    table = _template_rows(df.sparkSession, templates, order, threshold, rules)
    strings = lambda xs: F.array(*map(F.lit, xs))
    prefix = strings(sorted(_prefix_words(templates, order, threshold)))
    ranked = strings(sorted(order, key=lambda w: (order[w], w)))
    held = strings(sorted({*order, *(w for _, bars in rules.values() for w in bars)}))
    around = max(template_length(text) for _, text in templates)

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = df.select(F.md5(text.cast("binary")).alias("key"), text.alias("text"), words_of(text).alias("words")).where(F.arrays_overlap("words", prefix))

    def near(x: Column) -> Column:
        first = F.greatest(x["i"] - around + 1, F.lit(0))
        return F.struct(x["w"].alias("token"), (x["i"] - first).alias("at"), F.slice("words", first + 1, x["i"] - first + around + 1).alias("context"))

    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(prefix, x["w"]))
    windows = texts.select("key", F.inline(F.transform(places, near)))
    lines = F.transform(F.split("text", "\n"), lambda line: let(words_of(line), lambda ws: F.filter(held, lambda w: F.array_contains(ws, w))))
    lines = F.filter(F.array_distinct(lines), lambda ws: F.arrays_overlap(ws, prefix))
    lines = texts.select("key", F.explode(lines).alias("context")).select("key", F.explode(F.array_intersect("context", prefix)).alias("token"), "context")
    blocks = windows.unionByName(lines.withColumn("at", F.lit(None).cast("int")))

    own = F.filter(ranked, lambda w: F.array_contains("context", w))
    blocks = blocks.withColumn("own", own).withColumn("q", F.array_position("own", F.col("token")).cast("int") - 1)
    reachable = F.least("p", "q") + 1 + F.least(F.col("size") - 1 - F.col("p"), F.size("own") - 1 - F.col("q")) >= F.col("need")
    pairs = blocks.join(F.broadcast(table), (blocks["token"] == table["token"]) & (F.size(F.array_intersect("own", "template")) >= F.col("need")) & reachable)

    def common(block: Column) -> Column:
        """How many template words a block holds, or 0 where the rules forbid the match."""
        allowed = (F.size(F.array_intersect("musts", block)) == F.size("musts")) & ~F.arrays_overlap("bars", block)
        return F.when(allowed, F.size(F.array_intersect("template", block))).otherwise(0)

    has = lambda words, i: F.coalesce(F.array_contains(words, F.get("context", i)), F.lit(False))
    starts = F.sequence(F.greatest(F.col("at") - F.col("length") + 1, F.lit(0)), "at")
    starts = F.filter(starts, lambda i: has("template", i) | has("bars", i + F.col("length")))
    best = F.array_max(F.transform(starts, lambda i: common(F.slice("context", i + 1, F.col("length")))))
    found = pairs.select("key", "label", "size", "need", F.when(F.col("at").isNull(), common(F.col("context"))).otherwise(best).alias("n")).where("n >= need")
    # as many labels as there are templates at most
    return found.groupBy("key").agg(F.collect_set("label").alias("found"), F.max(F.col("n") / F.col("size").cast("double")).alias("score"))


def license_labels(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD, rules=RULES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each text."""
    matches = license_matches(df, text_col, templates, threshold, rules)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    measured = let(words_of(text), lambda words: F.struct(F.size(words).alias("n_words"), _base_places(words).alias("base")))
    rows = df.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("key"), measured.alias("m"))
    places, base = F.transform("m.base", lambda x: x["place"]), F.transform("m.base", lambda x: x["label"])
    rows = rows.select("id", "key", F.col("m.n_words").cast("long").alias("n_words"), F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"), F.array_distinct(base).alias("base"))
    # copies of one text may be a third of all rows: its match is held by several tasks
    matches = matches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(matches, ["key", "salt"], "left")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    both = F.concat("base", F.coalesce("found", F.array().cast("array<string>")))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return rows.select(F.col("id").alias(free_name(names, id_col)), *names[:4], listed(F.col("base")).alias("base_labels"), listed(both).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
