"""Licence scan: exact set-similarity join of text blocks with notice templates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from instqc.llm.common import attach, digest, only_keys
from instqc.session import cut_lineage

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Opening words and short grants of widely used notices: the method's label, the words, those that must be there, and
#: those of a sister licence, which must not.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2", ""),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4", "nc nd sa"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4", "nd sa"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4", "nc nd"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "waived", ""),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu 3", "lesser affero"),
    ("gnu-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu", "lesser affero"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "granted", ""),
    ("mit", "under the mit license", "mit", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", ""),
    ("no-reuse", "no part of this publication may be reproduced without prior written permission", "reproduced", ""),
)

#: Share of a template's distinct words that a block must hold. A block is any run of as many words as the template has,
#: over line breaks and all.
CONTAINMENT = 0.8

#: Words of the lower-cased text: ASCII digits and letters, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def words_in(text: str) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, templates: Sequence[tuple[str, str, str, str]], containment: float) -> DataFrame:
    """(number, label, template, need, total, span, must, other): one row per template, a fixed few."""
    rows = []
    for number, (label, text, must, other) in enumerate(templates):
        words = text.split()
        distinct = sorted(set(words))
        rows.append((number, label, distinct, math.ceil(containment * len(distinct) - 1e-9), len(distinct), len(words), must.split(), other.split()))
    return spark.createDataFrame(
        rows, "number int, label string, template array<string>, need int, total int, span int, must array<string>, other array<string>")


def prefixes(table: DataFrame, ranks: DataFrame) -> DataFrame:
    """The prefix of each template in global order, rarest word first: the table's columns with word and at.

    ``need`` words of ``total`` must be shared, so a block that shares them
    holds one of the first ``total - need + 1``.
    """
    ordered = Window.partitionBy("number").orderBy("rank")
    words = table.select("*", F.explode("template").alias("word")).join(F.broadcast(ranks), "word")
    placed = words.withColumn("at", F.row_number().over(ordered) - 1)
    return placed.filter(F.col("at") <= F.col("total") - F.col("need")).drop("rank")


def candidates(docs: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_th, number) of texts that hold enough words of a template anywhere, and the templates with their ``prefix``.

    Words are ranked by the number of texts that hold them in all of ``docs``
    (ties by the word). A text is paired with a template if it holds a word of
    the template's prefix, has enough words of the templates at all (length
    filter), the first prefix word leaves enough words behind it both in the
    template and in the text (positional filter), and the shared words, counted
    out, are enough and include those that must be there.
    """
    spark = docs.sparkSession
    listed = table.collect()
    vocabulary = sorted({w for r in listed for w in r["template"]})
    held = docs.select("_th", F.array_intersect(words_in("text"), F.array(*map(F.lit, vocabulary))).alias("words"))
    held = cut_lineage(held.filter(F.size("words") >= min(r["need"] for r in listed)))
    counts = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    ranks = cut_lineage(every.join(counts, "word", "left").select(
        "word", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.coalesce("n", F.lit(0)), "word")).alias("rank")))
    heads = cut_lineage(prefixes(table, ranks))
    rank_of = {r["word"]: r["rank"] for r in ranks.collect()}
    in_order = sorted(vocabulary, key=rank_of.get)
    first_words = sorted({r["word"] for r in heads.select("word").distinct().collect()})
    # Intersecting from the left keeps the global order.
    ordered = held.withColumn("words", F.array_intersect(F.array(*map(F.lit, in_order)), F.col("words")))
    probing = ordered.select("_th", "words", F.explode(F.filter("words", lambda w: w.isin(*first_words))).alias("word"))
    place = F.array_position("words", F.col("word"))
    pairs = probing.join(F.broadcast(heads), "word").filter(
        # Words from here on, in the template and in the text; earlier matches would have paired already.
        (F.size("words") >= F.col("need")) & (F.col("total") - F.col("at") >= F.col("need"))
        & (F.size("words") - place + 1 + F.least(F.col("at"), place - 1) >= F.col("need")))
    met = pairs.filter((F.size(F.array_intersect("words", "template")) >= F.col("need")) & (F.size(F.array_except("must", "words")) == 0))
    prefix = heads.groupBy("number").agg(F.collect_list("word").alias("prefix"))
    return met.select("_th", "number").distinct(), table.join(prefix, "number")


def contained(docs: DataFrame, templates: Sequence[tuple[str, str, str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(_th, label, shared): every label that some block of a text contains a template of, with the largest share.

    The set join finds the texts that may; in these, each place of a prefix
    word is looked at with every block that covers it, and the words of each
    block are counted out. A block that contains the template covers such a
    place, so none is missed, wherever lines break. Blocks must hold the words
    that tell the licence and none of a sister's. ``docs`` has _th, a digest
    of the text, and text; copies are looked at once.
    """
    table = template_table(docs.sparkSession, templates, containment)
    found, told = candidates(docs, table)
    found = cut_lineage(found)
    texts = only_keys(docs.select("_th", "text"), found, ["_th"]).dropDuplicates(["_th"]).select("_th", words_in("text").alias("_w"))
    rows = texts.join(found, "_th").join(F.broadcast(told), "number")
    last = F.greatest(F.size("_w") - F.col("span"), F.lit(0))
    hits = F.filter(F.transform("_w", lambda w, p: F.when(F.array_contains("prefix", w), p)), lambda p: p.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(F.least(p - F.col("span") + 1, last), F.lit(0)), F.least(p, last)))))
    windows = rows.select("_th", "label", "template", "need", "total", "must", "other", "span", "_w", F.explode(starts).alias("_s"))
    block = windows.withColumn("_b", F.slice("_w", F.col("_s") + 1, F.col("span"))).drop("_w")
    block = block.withColumn("_both", F.size(F.array_intersect("_b", "template")))
    good = block.filter((F.col("_both") >= F.col("need")) & (F.size(F.array_except("must", "_b")) == 0) & ~F.arrays_overlap("other", "_b"))
    return good.groupBy("_th", "label").agg(F.max(F.col("_both") / F.col("total")).alias("shared"))


def licence_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Null counts as the empty text. n_base counts the places of all phrases,
    first_word and last_word are their least and greatest start in words.
    labels are those of the phrases and of every template that a block
    contains to four fifths; score is 1 if a phrase is there, else the
    largest share of a contained template, else 0. Repeated rows and null ids
    each get their row.
    """
    keyed = docs.select("doc_id", "text").withColumn("_th", digest(F.col("text")))
    found = contained(keyed.select("_th", "text")).groupBy("_th").agg(
        F.sort_array(F.collect_set("label")).alias("_own"), F.max("shared").alias("_shared")
    )
    # Words with a blank on either side, so that neighbours do not share one.
    spaced = keyed.select("doc_id", "_th", F.concat(F.lit(" "), F.regexp_replace(_lowered("text"), GAP, "  "), F.lit(" ")).alias("_s"))
    spaced = spaced.withColumn("n_words", F.regexp_count("_s", F.lit(r"[^ ]+")).cast("long"))
    starts, ends, labels, places = [], [], [], []
    for phrase, label in PHRASES.items():
        mark = " " + "  ".join(phrase.split()) + " "
        there = F.contains(F.col("_s"), F.lit(mark))
        count = F.when(there, ((F.length("_s") - F.length(F.replace("_s", F.lit(mark)))) / len(mark)).cast("long")).otherwise(0)
        places.append(count)
        before = F.regexp_count(F.substring_index("_s", mark, 1), F.lit(r"[^ ]+")).cast("long")
        after = F.regexp_count(F.substring_index("_s", mark, -1), F.lit(r"[^ ]+")).cast("long")
        starts.append(F.when(there, before))
        ends.append(F.when(there, F.col("n_words") - after - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    based = spaced.select(
        "doc_id", "_th", "n_words", reduce(lambda a, b: a + b, places).alias("n_base"),
        F.least(*starts).alias("first_word"), F.greatest(*ends).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("_base"),
    )
    joined = attach(based, found, ["_th"], ["doc_id"], "left")
    own = F.coalesce("_own", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", own)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_shared", F.lit(0.0))).alias("score"),
    )
