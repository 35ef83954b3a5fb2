"""License scans by diagonal voting: word k-grams of texts meet template positions, and votes on one diagonal make a span."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phrases that must stand word for word, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices that may be changed a little, and their labels.
NOTICES = [
    ("released under the mit license", "mit-release"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-grant"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-pointer"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-grant"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-grant"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under a creative commons attribution", "cc"),
    ("copyright all rights reserved", "reserved"),
]
#: What parts words: all ASCII but letters and digits.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ROW = "\x00"  # no word holds this character; it stands for the row itself


def templates(spark, base: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """One row for each 2-gram of each template, and one that all rows meet. Its size is that of the phrase lists."""
    rows = [(-1, "", True, 0, 0, 1, _ROW, "")]
    for t, (phrase, label) in enumerate([*base, *notices]):
        words = phrase.split()
        rows += [(t, label, t < len(base), k, len(words), len(words) - 1, words[k], words[k + 1]) for k in range(len(words) - 1)]
    df = spark.createDataFrame(rows, "template int, label string, is_base boolean, t_pos int, t_words int, t_grams int, t1 string, t2 string")
    return df.withColumn("t_key", F.xxhash64("t1", "t2"))


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, notices: list[tuple[str, str]] = NOTICES, coverage: float = 0.8, drift: int = 3) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row of docs(doc_id, text).

    All rolling word 2-gram hashes of a text are joined to the positions of the templates' 2-grams; the words themselves
    confirm a hash. Matches of a template at one offset (text position less template position) are a diagonal. A base
    phrase stands where one diagonal has all its 2-grams. Of a notice, diagonals that lie at most `drift` apart are
    merged; it is found where they hold at least `coverage` of its 2-grams within one and a half times its length, in any
    such window of a longer merged run.
    score: the largest share of 2-grams of what was found.

    A null text counts as empty; texts without words or matches give a row with 0, nulls and empty strings. Repeated
    rows each give a row; doc_id may be null. Other columns are ignored. The template side is sent to each task: its
    size is fixed by the lists. Texts are read whole.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"))
    line = F.concat(F.array(F.lit(_ROW)), F.col("words"))
    grams = rows.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.arrays_zip(line.alias("w"), F.slice(line, 2, F.size("words") + 1).alias("x"))).alias("pos", "g"))
    w1, w2 = F.col("g.w"), F.when(F.col("pos") == 0, F.lit("")).otherwise(F.col("g.x"))
    grams = grams.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), w1.alias("w1"), w2.alias("w2")).where("w2 is not null")
    grams = grams.withColumn("key", F.xxhash64("w1", "w2"))
    parts = F.broadcast(templates(docs.sparkSession, base, notices))
    hits = grams.join(parts, (F.col("key") == F.col("t_key")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2")))
    diagonals = hits.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "t_words", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_list("t_pos").alias("places"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    own = W.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(own)
    apart = F.when(F.col("is_base"), F.lit(1)).otherwise((gap.isNull() | (gap > drift)).cast("int"))
    merged = diagonals.withColumn("apart", apart).withColumn("island", F.sum("apart").over(own))
    spans = merged.groupBy("row", "doc_id", "n_words", "template", "label", "is_base", "t_words", "t_grams", "island").agg(
        F.array_sort(F.flatten(F.collect_list(F.transform("places", lambda t: F.struct((F.col("diagonal") + t).alias("pos"), t.alias("t_pos")))))).alias("at"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("start")
    )
    most = F.floor(1.5 * F.col("t_words")).cast("int")
    twice = max((max(Counter(zip(w, w[1:], strict=False)).values(), default=1) for w in (t.split() for t, _ in [*base, *notices])), default=1)
    within = lambda x, i: F.filter(F.slice("at", i + 1, most * twice), lambda y: y["pos"] + 2 - x["pos"] <= most)
    places = lambda a: F.size(F.array_distinct(F.transform(a, lambda y: y["t_pos"])))
    long = ~F.col("is_base") & (F.col("hi") + 2 - F.col("lo") > most)
    spans = spans.withColumn("n", F.when(long, F.array_max(F.transform("at", lambda x, i: places(within(x, i))))).otherwise(places(F.col("at"))))
    share = F.col("n") / F.col("t_grams")
    found = F.when(F.col("template") < 0, F.lit(False)).when(F.col("is_base"), F.col("n") == F.col("t_grams")).otherwise(share >= coverage)
    spans = spans.withColumn("found", found)
    place = F.when(F.col("found") & F.col("is_base"), F.col("start").cast("long"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"),
        joined(F.when(F.col("found") & F.col("is_base"), F.col("label"))).alias("base_labels"), joined(F.when(F.col("found"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("found"), share)), F.lit(0.0)).alias("score"),
    ).drop("row")
