"""Licence scans by diagonal voting, in DataFrame operations only.

Every rolling word pair of every text is joined by hash to the places where licence templates have
it. A match at text place p and template place t votes for diagonal p - t. Votes are counted per
diagonal, neighbouring diagonals of a template are merged, and the spans are verified: each vote has
compared the words themselves, and a span must hold enough of its template, densely enough.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.llm.common import row_id, shown_id

# Phrases that count as base places, and their labels.
BASE = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# Wording that is common in licence lines and headers, with labels of the scan's own.
TEMPLATES = [
    ("cc-by", "creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "creative commons zero public domain dedication"),
    ("proprietary", "all rights reserved"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("unlicense", "free and unencumbered software released into the public domain"),
]
CUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A template that carries the number of words of every text.
EVERY = -1


def template_words(text: str) -> list[str]:
    return [w for w in re.split(CUT, text.lower()) if w]


def template_places(spark: SparkSession, base=BASE, own=TEMPLATES) -> DataFrame:
    """``(template, at, first, second)``: one row per word pair of a template. A few hundred rows,
    fixed by the lists above."""
    rows = []
    for n, (_, text) in enumerate([*base, *own]):
        words = template_words(text)
        rows += [(n, i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    schema = "template int, at int, first string, second string"
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("first", "second"))


def matches(docs: DataFrame, base=BASE, own=TEMPLATES) -> DataFrame:
    """``(did, th, template, diagonal, votes, lowest, highest, n_words)``; template ``EVERY`` has one
    row per distinct document with its number of words and, as votes, how often the row is there."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    words = F.array_remove(F.split(text, CUT), "")
    cut = docs.select(
        row_id().alias("did"), F.hash(F.coalesce(F.col("text"), F.lit(""))).alias("th"), words.alias("words")
    )
    pairs = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1)))
    # The first element stands for the text itself; its key is that of no template pair.
    every = F.xxhash64(F.lit(""), F.lit(""))
    at = cut.select("did", "th", "words", F.posexplode(F.concat(F.array(every), pairs)).alias("place", "pair"))
    places = template_places(docs.sparkSession, base, own)
    whole = docs.sparkSession.range(1).select(
        F.lit(EVERY).alias("template"), F.lit(0).alias("at"), F.lit("").alias("first"), F.lit("").alias("second"),
        every.alias("pair"),
    )
    word = lambda i: F.get("words", F.col("place") - 1 + i)
    same = (F.col("template") == EVERY) | (word(0) == F.col("first")) & (word(1) == F.col("second"))
    voted = at.join(F.broadcast(places.unionByName(whole)), "pair").where(same)
    place = F.col("place") - 1
    return (
        voted.select(
            "did", "th", "template",
            F.when(F.col("template") == EVERY, 0).otherwise(place - F.col("at")).alias("diagonal"),
            place.alias("start"), F.size("words").alias("n"),
        )
        .groupBy("did", "th", "template", "diagonal")
        .agg(
            F.count(F.lit(1)).alias("votes"),
            F.min("start").alias("lowest"),
            F.max("start").alias("highest"),
            F.max("n").cast("long").alias("n_words"),
        )
    )


def license_scan(
    docs: DataFrame, base=BASE, own=TEMPLATES, least: float = 0.7, slack: int = 3
) -> DataFrame:
    """One row per document: base places, labels, and the best coverage of a template as ``score``.

    Own templates count from ``least`` of their word pairs, over diagonals at most ``slack`` apart;
    those of fewer than seven pairs need all. A null or empty text has no words and no labels (''); a null
    id stays null; repeated rows are returned each; texts may have any length; extra columns are left
    behind; an empty table gives an empty one.
    """
    names = [label for label, _ in [*base, *own]]
    pairs = [len(template_words(text)) - 1 for _, text in [*base, *own]]
    found = matches(docs, base, own)
    # Repeated rows vote once each; the row that stands for the text tells how many there are.
    text_rows = W.partitionBy("did", "th")
    found = found.withColumn(
        "copies", F.max(F.when(F.col("template") == EVERY, F.col("votes"))).over(text_rows)
    ).withColumn("votes", F.col("votes") / F.col("copies"))
    run = W.partitionBy("did", "th", "template").orderBy("diagonal")
    is_base = (F.col("template") >= 0) & (F.col("template") < len(base))
    here = F.col("template") + 1
    length = F.get(F.array(*map(F.lit, [1, *pairs])), here)
    # A diagonal that holds all of its template is a span by itself, also beside others, and so is each of
    # a template that needs all its pairs: it may stand several times in a row.
    found = found.withColumn("alone", is_base | (length < 7) | (F.col("votes") >= length))
    apart = F.coalesce(
        (F.col("diagonal") - F.lag("diagonal").over(run) > slack) | F.lag("alone").over(run), F.lit(True)
    )
    found = found.withColumn("run", F.sum((apart | F.col("alone")).cast("int")).over(run))
    spans = found.groupBy("did", "th", "template", "run").agg(
        F.sum("votes").alias("votes"),
        F.min("diagonal").alias("diagonal"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
    )
    label = F.get(F.array(*map(F.lit, ["", *names])), here)
    # A short template needs all its pairs, as most of them are in others too.
    needed = F.when(length < 7, F.lit(1.0)).otherwise(F.lit(least))
    covered = F.least(F.lit(1.0), F.col("votes") / length)
    dense = F.col("highest") - F.col("lowest") + 1 <= length + slack * F.greatest(F.lit(1), length / 8)
    base_hit = is_base & (F.col("votes") == length)
    own_hit = (F.col("template") >= len(base)) & (covered >= needed) & dense
    hit = base_hit | own_hit
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, label))), ",")
    return (
        spans.groupBy("did", "th")
        .agg(
            F.max("n_words").alias("n_words"),
            F.sum(base_hit.cast("long")).alias("n_base"),
            F.min(F.when(base_hit, F.col("diagonal"))).cast("long").alias("first_word"),
            F.max(F.when(base_hit, F.col("diagonal"))).cast("long").alias("last_word"),
            listed(base_hit).alias("base_labels"),
            listed(hit).alias("labels"),
            F.coalesce(F.max(F.when(hit, covered)), F.lit(0.0)).alias("score"),
            F.max("copies").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
        .select(
            shown_id().alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        )
    )
