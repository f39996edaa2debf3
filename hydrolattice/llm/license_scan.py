"""Licence texts by exact phrases and by an exact set-similarity join, in DataFrame functions only.

Texts are cut into overlapping blocks of words. A block holds a template where it contains ``threshold`` of the template's
distinct words. The join that finds all such pairs orders the words of the templates by the number of documents that
hold them, rare ones first, and reads a block in that order. A pair that meets the threshold shares one of the first words
of both (prefix filter), the block holds enough template words at all (length filter), and from the place of the first
shared word on enough words are left on both sides (positional filter). Pairs that pass are compared in full.

Words of no template cannot be shared, so a block is its template words. Templates are a parameter: their words are
literals and their prefixes one small table, whose size is checked. Texts are not shuffled: matches are gathered by the digest of their text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, stored

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII characters that are no part of a word
MAX_TEMPLATE_WORDS = 20_000  # distinct words of all templates; more is an error
SALTS = 16


@dataclass(frozen=True)
class Phrase:
    text: str  # words in lower case
    label: str


@dataclass(frozen=True)
class Template:
    label: str
    text: str


# Opening sentences of public licences and usual one-line notices.
TEMPLATES = (
    Template("apache-2", "Licensed under the Apache License, Version 2.0."),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)
PHRASES = (Phrase("under the mit license", "mit"), Phrase("apache license version 2", "apache-2"), Phrase("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Joining:
    """A run of ``block_words - step + 1`` words lies whole in some block. ``threshold`` is a share of a template's words."""

    threshold: Fraction = Fraction(9, 10)
    block_words: int = 96
    step: int = 32

    def needed(self, words: int) -> int:
        return ceil(self.threshold * words)


def joined_words(text: Column) -> Column:
    """The words of a text in lower case with one space before, between and after them; a text without words is one space."""
    return F.concat(F.lit(" "), F.trim(ascii_lower(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), GAP, " "))), F.lit(" "))


def _spaces(column: Column) -> Column:
    return (F.length(column) - F.length(F.replace(column, F.lit(" "), F.lit("")))).cast("long")


def word_count(joined: Column) -> Column:
    return F.when(joined == "  ", F.lit(0).cast("long")).otherwise(_spaces(joined) - 1)


def words_of(joined: Column) -> Column:
    return F.filter(F.split(joined, " "), lambda w: w != "")


def template_words(spark: SparkSession, templates: Sequence[Template], room: int) -> list[list[str]]:
    """Distinct words of each template, read as the documents are; ``room`` is the longest run of words that a block holds whole."""
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(t.text) for t in templates])).alias("at", "text")).select("at", words_of(joined_words(F.col("text"))).alias("words"))
    every = [r["words"] for r in rows.orderBy("at").collect()] if templates else []
    if any(len(words) > room for words in every):
        raise ValueError(f"a template of more than {room} words does not fit whole into a block")
    return [list(dict.fromkeys(words)) for words in every]


def _literal(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]).cast("array<string>")


@dataclass(frozen=True)
class Index:
    """``vocabulary``: template words, rare ones first; ``sets``: (label, words in that order, words needed) of each template."""

    vocabulary: list[str]
    sets: list[tuple[str, list[str], int]]

    @property
    def prefix(self) -> list[str]:
        return sorted({w for _, words, needed in self.sets for w in words[: len(words) - needed + 1]})


def vocabulary_of(sets: Sequence[Sequence[str]]) -> list[str]:
    words = sorted({w for s in sets for w in s})
    if len(words) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates with more than {MAX_TEMPLATE_WORDS} distinct words are no parameter but a table")
    return words


def index_of(templates: Sequence[Template], sets: Sequence[Sequence[str]], frequency: dict[str, int], joining: Joining) -> Index:
    """The templates' words in the order of all documents. A template without words matches nothing."""
    rank = {w: k for k, w in enumerate(sorted(vocabulary_of(sets), key=lambda w: (frequency.get(w, 0), w)))}
    return Index(list(rank), [(t.label, sorted(s, key=rank.__getitem__), joining.needed(len(s))) for t, s in zip(templates, sets, strict=True) if s])


def frequencies(present: DataFrame) -> dict[str, int]:
    """Documents that hold each template word: as many rows as the templates have words."""
    return {r["word"]: r["n"] for r in present.select(F.explode("present").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def block_matches(docs: DataFrame, keep: list[str], text: str, index: Index, joining: Joining) -> DataFrame:
    """``keep`` columns, first_word, label and containment of every pair of a block and a template at the threshold."""
    kept = [f"_k{i}" for i in range(len(keep))]
    found = "first_word bigint, label string, containment double"
    base = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], joined_words(F.col(text)).alias("_joined"))
    if not index.sets:
        none = F.from_json(F.lit("[]"), f"array<struct<{found.replace(' ', ':').replace(',:', ',')}>>")
        return base.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.inline(none))
    likely = base.withColumn("_words", words_of(F.col("_joined"))).where(F.arrays_overlap("_words", _literal(index.prefix)))
    last = F.greatest(F.size("_words") - (joining.block_words - joining.step) - 1, F.lit(0))
    block = F.transform(
        F.sequence(F.lit(0), last, F.lit(joining.step)),
        lambda s: F.struct(s.cast("long").alias("start"), F.array_intersect(_literal(index.vocabulary), F.slice(F.col("_words"), s + 1, F.lit(joining.block_words))).alias("words")),
    )
    least = min(needed for _, _, needed in index.sets)
    blocks = likely.select(*kept, F.explode(F.filter(block, lambda b: F.size(b["words"]) >= least)).alias("_b")).select(*kept, "_b.start", "_b.words", F.size("_b.words").alias("_size"))
    postings = docs.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(word).alias("_word"), F.lit(i).alias("_i"), F.lit(label).alias("label"), F.lit(needed).alias("_needed"), _literal(words).alias("_template"))
        for label, words, needed in index.sets for i, word in enumerate(words[: len(words) - needed + 1])
    ])))
    met = blocks.select("*", F.posexplode("words").alias("_j", "_at")).join(F.broadcast(postings), F.col("_at") == F.col("_word"))  # MAX_TEMPLATE_WORDS bounds it
    enough = F.col("_size") >= F.col("_needed")
    prefix = F.col("_j") <= F.col("_size") - F.col("_needed")
    left = F.least(F.size("_template") - F.col("_i"), F.col("_size") - F.col("_j")) >= F.col("_needed")
    common = met.where(enough & prefix & left).withColumn("_both", F.array_intersect("words", "_template"))
    true = common.where((F.size("_both") >= F.col("_needed")) & (F.get("_both", F.lit(0)) == F.col("_word")))  # once, at the first shared word
    return true.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.col("start").alias("first_word"), "label", (F.size("_both") / F.size("_template")).alias("containment"))


def _places(joined: Column, phrase: Phrase) -> Column:
    """(n, first, last) of the places where a phrase's words stand consecutively: the text is cut before each of them."""
    pieces = F.split(joined, rf"(?= \Q{phrase.text}\E )", -1)
    leading = F.startswith(joined, F.lit(f" {phrase.text} "))
    counted = F.transform(F.array(pieces), lambda p: F.struct(
        (F.size(p) - F.when(leading, 0).otherwise(1)).cast("long").alias("n"), F.when(leading, F.lit(0).cast("long")).otherwise(_spaces(F.element_at(p, 1))).alias("first"),
        (word_count(joined) - _spaces(F.element_at(p, -1)) + 1).alias("last"),
    ))
    none = F.lit(None).cast("long")
    return F.when(F.contains(joined, F.lit(f" {phrase.text} ")), F.get(counted, F.lit(0))).otherwise(F.struct(F.lit(0).cast("long").alias("n"), none.alias("first"), none.alias("last")))


def scan(docs: DataFrame, keep: list[str], *, text: str = "text", templates: Sequence[Template] = TEMPLATES, phrases: Sequence[Phrase] = PHRASES, joining: Joining = Joining()) -> DataFrame:
    """``keep`` columns of every row with n_words, n_base, first_word, last_word, base_labels, labels and score.

    A missing text is empty; a text without words has no label and score 0. ``score`` is 1 with a phrase, else the greatest containment of a template. Rows that
    share a text share its labels. Other columns of ``docs`` may have any name, and an empty table gives no row.
    """
    sets = template_words(docs.sparkSession, templates, joining.block_words - joining.step + 1)
    vocabulary = vocabulary_of(sets)
    kept = [f"_k{i}" for i in range(len(keep))]
    base = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    read = base.select(*kept, F.sha2("_text", 256).alias("_digest"), joined_words(F.col("_text")).alias("_joined"))
    places = [_places(F.col("_joined"), p).alias(f"_p{i}") for i, p in enumerate(phrases)]
    facts = read.select(*kept, "_digest", word_count(F.col("_joined")).alias("_n"), F.array_intersect(_literal(vocabulary), F.split("_joined", " ")).alias("present"), *places)
    facts = stored(facts, "license_facts")
    index = index_of(templates, sets, frequencies(facts), joining)
    hits = block_matches(base.withColumn("_digest", F.sha2("_text", 256)), ["_digest"], "_text", index, joining)
    matches = stored(hits.groupBy("_digest").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_most")), "license_matches")
    spun = facts.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # a text may be a third of all rows
    dealt = matches.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = spun.join(dealt, ["_digest", "_salt"], "left")
    n_base = sum((F.col(f"_p{i}.n") for i in range(len(phrases))), F.lit(0).cast("long"))
    null = F.lit(None).cast("long")
    own = F.array_compact(F.array(*[F.when(F.col(f"_p{i}.n") > 0, F.lit(p.label)) for i, p in enumerate(phrases)]).cast("array<string>"))
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return every.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], F.col("_n").alias("n_words"), n_base.alias("n_base"),
        F.least(null, null, *[F.col(f"_p{i}.first") for i in range(len(phrases))]).alias("first_word"),
        F.greatest(null, null, *[F.col(f"_p{i}.last") for i in range(len(phrases))]).alias("last_word"),
        text_of(own).alias("base_labels"), text_of(F.concat(own, F.coalesce("_labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("_most", F.lit(0.0))).alias("score"),
    )
