"""License scans by diagonal voting, in DataFrame operations alone.

All rolling word 3-grams of a text are hashed and joined to the places of the same hashes in the
templates, where the words have to be the same as well. A hit votes for its diagonal: its place in the text less its place in the template. Votes of
one diagonal are a passage that runs in step with the template; neighbouring diagonals are merged, since
a word put in or left out moves the rest by one. A merged span counts if enough of the template stands in it. Where
copies follow one another, their diagonals merge too; such a span is cut into stretches of a copy's length. Short
templates, of which a word makes another license, must stand whole on one diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsync.llm._common import row_key

K = 3
#: Wordings of fewer words must stand whole.
SHORT = 10

# License phrases by label; all of a phrase's words must stand in a row.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Wordings by label, of which a part may be missing or changed.
WORDINGS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the terms of the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("all-rights-reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of "
        "the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
]


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of characters other than ASCII ones that are no letter or digit."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(w: Column) -> Column:
    """Hash of each run of ``K`` words."""
    last = F.size(w) - K
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))


def _runs(places: Column, grams: Column, w: Column) -> Column:
    """Place, hash and words of the runs at ``places``."""
    return F.transform(places, lambda i: F.struct(i.alias("pos"), F.get(grams, i).alias("hash"), F.concat_ws(" ", *(F.get(w, i + j) for j in range(K))).alias("words")))


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, wordings: list[tuple[str, str]] = WORDINGS, part: float = 0.7, slack: int = 3) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` for each row of ``docs``.

    n_base, first_word, last_word, base_labels: places of whole ``phrases``, their least and greatest start
    (words from 0, null without any) and their labels. A wording of ``SHORT`` words or more counts where merged diagonals, ``slack``
    apart at most, cover at least ``part`` of its words within a stretch of text not over a half longer, a shorter one where it stands whole. score: the largest
    covered part of any template. spans: (label, first_word, last_word, part) of all that counts; of stretches that overlap in one merged span, the first. Label lists are sorted and
    comma-joined, empty without any. Templates of fewer than three words match nothing. Null and empty texts have no words.
    Repeated rows give equal rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = [(i, label, text, i < len(phrases)) for i, (label, text) in enumerate([*phrases, *wordings])]
    template = spark.createDataFrame(rows, "template int, label string, text string, whole boolean").withColumn("w", words(F.col("text")))
    template = template.select("template", "label", "whole", F.size("w").alias("size"), F.col("w"), _grams(F.col("w")).alias("g"))
    template = template.select("template", "label", "whole", "size", F.explode(_runs(F.transform("g", lambda _, i: i), F.col("g"), F.col("w"))).alias("t"))
    template = template.withColumn("offset", F.col("t.pos")).withColumn("exact", F.col("whole") | (F.col("size") < SHORT))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), words(F.col("text")).alias("w"))
    # The templates are the constants above, or the caller's lists: a broadcast of a few hundred rows.
    # Most texts and most runs of words have nothing of a template: where these are few, only the others become rows.
    known = sorted(r["hash"] for r in template.select("t.hash").distinct().limit(10_001).collect())
    places = F.transform("g", lambda _, i: i)
    if 0 < len(known) <= 10_000:
        held = F.filter(F.transform("g", lambda h, i: F.when(h.isin(*known), i)), lambda i: i.isNotNull())
        places = F.when(F.arrays_overlap(F.col("g"), F.array(*map(F.lit, known))), held)
    same = (F.col("gram.hash") == F.col("t.hash")) & (F.col("gram.words") == F.col("t.words"))
    keyed_grams = keyed.select("key", "w", _grams(F.col("w")).alias("g"))
    hits = keyed_grams.select("key", F.explode(_runs(places, F.col("g"), F.col("w"))).alias("gram")).join(F.broadcast(template), same).withColumn("pos", F.col("gram.pos"))
    votes = hits.groupBy("key", "template", "label", "whole", "exact", "size", (F.col("pos") - F.col("offset")).alias("diagonal")).agg(
        F.collect_set("offset").alias("offsets"), F.min("pos").alias("low"), (F.max("pos") + K - 1).alias("high")
    )
    along = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack), F.lit(True))
    named = ["key", "template", "label", "whole", "exact", "size", "group"]
    limit = F.floor(1.5 * F.col("size") + slack).cast("int")
    all_of = Window.partitionBy("key", "template", "group")
    votes = votes.withColumn("group", F.sum(fresh.cast("int")).over(along))
    votes = votes.withColumn("long", ~F.col("exact") & (F.max("high").over(all_of) - F.min("low").over(all_of) + 1 > limit))
    merged = (
        votes.where(~F.col("long")).groupBy(*named)
        .agg(F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("diagonal").alias("diagonal"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("offsets", lambda o: F.sequence(o, o + K - 1)))))
    spans = merged.withColumn("part", covered / F.col("size")).where(F.when(F.col("exact"), F.col("part") == 1).otherwise(F.col("part") >= part))
    spans = spans.select("key", "label", "whole", "diagonal", "low", "high", "part", F.col("part").alias("best"))
    # In a longer span, every hit starts a stretch; a stretch has the first hit of each offset.
    most = max((int(1.5 * len(text.split()) + slack) for _, text in wordings), default=0)
    ahead = Window.partitionBy("key", "template", "group").orderBy("pos").rangeBetween(0, max(0, most - K))
    hit = F.struct("pos", "offset")
    stretches = (
        votes.where("long").select(*named, "diagonal", F.explode("offsets").alias("offset"))
        .withColumn("pos", F.col("diagonal") + F.col("offset"))
        .withColumn("near", F.filter(F.collect_list(hit).over(ahead), lambda h: h["pos"] <= F.col("pos") + limit - K))
        .withColumn("offsets", F.array_distinct(F.transform("near", lambda h: h["offset"])))
        .withColumn("part", covered / F.col("size")).where(F.col("part") >= part)
        .withColumn("high", F.array_max(F.transform("offsets", lambda o: F.array_min(F.transform(F.filter("near", lambda h: h["offset"] == o), lambda h: h["pos"])))) + K - 1)
        .groupBy(*named)
        .agg(F.max("part").alias("best"), F.array_sort(F.collect_set(F.struct(F.col("pos").alias("low"), "high", "part"))).alias("all"))
    )
    none = F.array().cast("array<struct<low:int,high:int,part:double>>")
    apart = F.aggregate(
        "all", F.struct(F.lit(-1).alias("end"), none.alias("kept")),
        lambda seen, x: F.when(x["low"] <= seen["end"], seen).otherwise(F.struct(x["high"].alias("end"), F.concat(seen["kept"], F.array(x)).alias("kept"))),
    )["kept"]
    spans = spans.unionByName(
        stretches.select("key", "label", "whole", F.lit(None).cast("int").alias("diagonal"), "best", F.inline(apart))
    )
    base = F.when(F.col("whole"), F.col("diagonal"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy("key").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        joined(F.when(F.col("whole"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("best").alias("score"),
        F.array_sort(F.collect_list(F.struct("label", F.col("low").alias("first_word"), F.col("high").alias("last_word"), "part"))).alias("spans"),
    )
    return keyed.select("doc_id", "key", F.size("w").cast("long").alias("n_words")).join(found, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
