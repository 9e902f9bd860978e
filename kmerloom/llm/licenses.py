"""License scans: phrases by place, and templates by an exact set-similarity join.

A text block is a line, or up to ``LINES`` lines that follow one another, as notices are
often wrapped.  It is a set of words, and so is a template.  Words are put in one
global order, by how many documents have them, rare ones first.  A block that contains
a share t of a template has one of the template's |T| - ceil(t |T|) + 1 rarest words
(prefix filter), as many words of templates as that share needs (length filter), and
enough of them from its first common word on (positional filter).  What is left is
compared in full.  Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # all ASCII but digits and letters
WORD = rf"[^{OTHER}]+"

LINES = 4  # of a wrapped notice
WRAPPED_WORDS = 3  # a block of several lines has so many words at most for each distinct one of the template

#: Phrases and the labels they give.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices as they are commonly written, and the labels they give.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), rf"[{OTHER}]+"), "")


def phrase_places(docs: DataFrame, phrases: dict[str, str] = PHRASES, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels to every document.

    A place is the number of the word at which all words of a phrase follow one another;
    words are runs of ASCII digits, letters and all characters beyond ASCII.  Null or
    empty texts have no words, no places, null first and last words and '' as labels.
    """
    docs = docs.drop("n_words", "n_base", "first_word", "last_word", "base_labels", "_w", "_at", "_low")
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("n_words", F.regexp_count(t, F.lit(WORD)).cast("long")).withColumn("_low", F.lower(t))
    # plain searches for the words of a phrase cost far less than a pattern; places are found exactly below
    maybe = reduce(or_, (reduce(and_, (F.contains(F.col("_low"), F.lit(w)) for w in sorted(set(p.split()), key=len, reverse=True))) for p in phrases))
    df = df.withColumn("_w", F.when(maybe, _words(t)))  # only texts that can have a place are taken apart
    places = []
    for p in phrases:
        w = p.split()
        here = " AND ".join(f"_w[i + {j}] = '{x}'" for j, x in enumerate(w))
        places.append(F.expr(f"CASE WHEN size(_w) >= {len(w)} THEN filter(sequence(0, size(_w) - {len(w)}), i -> {here}) ELSE array() END"))
    df = df.withColumn("_at", F.when(F.col("_w").isNotNull(), F.array(*places)))
    every = F.flatten("_at")
    named = F.array_compact(F.array(*(F.when(F.size(F.col("_at")[i]) > 0, F.lit(label)) for i, label in enumerate(phrases.values()))))
    df = df.withColumns(
        {
            "n_base": F.when(every.isNull(), 0).otherwise(F.size(every)).cast("long"),
            "first_word": F.array_min(every).cast("long"),
            "last_word": F.array_max(every).cast("long"),
            "base_labels": F.coalesce(F.array_join(F.sort_array(F.array_distinct(F.when(F.col("_at").isNotNull(), named))), ","), F.lit("")),
        }
    )
    return df.drop("_w", "_at", "_low")


def template_blocks(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9, key: str = "doc_id", text: str = "text", lines: int = 1) -> DataFrame:
    """Every block that contains ``threshold`` or more of the words of a template.

    A block is a line, or two to ``lines`` lines in a row if they have ``WRAPPED_WORDS`` words
    at most for each distinct word of the template, so that a notice that is wrapped is found
    but not its words strewn over a page.  Returns key, line (the number of the first one),
    lines (how many), block (the text), template (its number), label and containment (the
    share of the template's distinct words).  Templates are a fixed list; only the
    frequencies of their words and the list itself go to the driver.  Null and empty texts
    have no lines with words, texts are read whole, and an empty table gives no block; rows
    that repeat give repeated rows; other columns are not read.
    """
    spark = docs.sparkSession
    sets = [sorted(set(t.split())) for _, t in templates]
    vocabulary = sorted(set().union(*sets))
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    # the global order: how many documents have each word, over all of them
    seen = body.select(F.explode(F.array_intersect(F.split(F.lower("_t"), rf"[{OTHER}]+"), F.array(*map(F.lit, vocabulary)))).alias("word"))
    frequency = dict(seen.groupBy("word").count().collect())
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    rows, guards = [], set()
    for number, ((label, _), words) in enumerate(zip(templates, sets, strict=True)):
        ranked = sorted(words, key=order.__getitem__)
        need = ceil(threshold * len(ranked) - 1e-9)
        # a match lacks |T| - need words at most, so it has one of any |T| - need + 1: for a cheap look, the longest
        guards.update(sorted(words, key=lambda w: (-len(w), w))[: len(words) - need + 1])
        for at, w in enumerate(ranked[: len(ranked) - need + 1]):
            rows.append((order[w], at, number, label, [order[x] for x in ranked], need))
    plan = spark.createDataFrame(rows, "rank int, at int, template int, label string, ranks array<int>, need int")
    # lines of the texts that can hold a match at all, as the ranks of their template words
    some = body.withColumn("_low", F.lower("_t")).filter(reduce(or_, (F.contains(F.col("_low"), F.lit(w)) for w in sorted(guards))))
    ranks = F.map_from_arrays(F.array(*map(F.lit, order)), F.array(*map(F.lit, order.values())))
    held = lambda x: F.array_compact(F.transform(F.array_distinct(_words(x)), lambda w: F.try_element_at(ranks, w)))
    some = some.select(key, F.split("_t", "\n").alias("_l")).withColumn("_b", F.transform("_l", lambda x: F.struct(held(x).alias("r"), F.regexp_count(x, F.lit(WORD)).alias("n"))))
    # lines without a word of any template end no block and begin none, so most windows are never made
    each = F.flatten(F.transform("_b", lambda x, i: F.when(F.size(x["r"]) > 0, F.transform(F.sequence(F.lit(1), F.least(F.lit(lines), F.size("_b") - i)), lambda m: F.struct(i.alias("line"), m.alias("lines")))).otherwise(F.array().cast("array<struct<line:int,lines:int>>"))))
    blocks = some.select(key, "_l", "_b", F.inline(each)).filter("lines = 1 OR size(_b[line + lines - 1].r) > 0")
    inside = F.slice("_b", F.col("line") + 1, F.col("lines"))
    union = F.sort_array(F.array_distinct(F.flatten(F.transform(inside, lambda x: x["r"]))))
    blocks = blocks.select(key, "line", "lines", F.array_join(F.slice("_l", F.col("line") + 1, F.col("lines")), "\n").alias("block"), union.alias("_b"), F.aggregate(inside, F.lit(0), lambda a, x: a + x["n"]).alias("_n"))
    blocks = blocks.select("*", F.posexplode("_b").alias("_q", "rank"))
    # a fixed list of templates: its size doesn't depend on the data
    pairs = blocks.join(F.broadcast(plan), "rank")
    pairs = pairs.filter((F.size("_b") >= F.col("need")) & ((F.col("lines") == 1) | (F.col("_n") <= WRAPPED_WORDS * F.size("ranks"))))
    # counting on from a first common word; where an earlier one was common, that pair stands for this block
    pairs = pairs.filter(1 + F.least(F.size("ranks") - F.col("at") - 1, F.size("_b") - F.col("_q") - 1) >= F.col("need"))
    pairs = pairs.filter(F.element_at(F.array_intersect("ranks", "_b"), 1) == F.col("rank"))
    found = pairs.withColumn("containment", F.size(F.array_intersect("ranks", "_b")) / F.size("ranks"))
    return found.filter(F.size(F.array_intersect("ranks", "_b")) >= F.col("need")).select(key, "line", "lines", "block", "template", "label", "containment")


def scan_licenses(docs: DataFrame, threshold: float = 0.9, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Phrases and templates together: the columns of ``phrase_places`` for each key, labels and score.

    ``labels`` has those of both, distinct, sorted and joined by commas; ``score`` is 1 with
    a phrase, else the largest containment of a block that reaches the threshold, else 0.
    Rows with one key share their template labels; a null key is a key.  Null and empty texts
    have no labels and score 0; an empty table gives an empty one; columns beside key and
    text are not read.
    """
    base = phrase_places(docs.select(key, text), text=text).drop(text)
    blocks = template_blocks(docs, threshold=threshold, key=key, text=text, lines=LINES)
    own = blocks.groupBy(F.col(key).alias("_k")).agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    out = base.join(own, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")
    based = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_join(F.sort_array(F.array_union(based, F.coalesce("_labels", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return out.withColumns({"labels": labels, "score": score}).drop("_labels", "_best")
