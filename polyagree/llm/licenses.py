"""Licence scans by diagonal voting. DataFrame functions only.

All rolling k-word hashes of a text are joined to the positions of licence templates. A match at word p of the text and
word t of a template votes for the diagonal p - t: the place where the template would begin. Votes are counted by diagonal;
diagonals that lie near one another are merged, as a word more or less in the text moves the rest to a neighbour. A merged
span is verified by alignment: its matches are runs of equal words in the order of the text, and what lies between runs, before
the first and after the last counts as edits; a hit has one edit for each EDIT_WORDS words of the template at most, so a
short notice must stand word for word. Of hits of which one lies within another, the outer one counts.

Base phrases are found as they stand, whatever the templates say.

Words are runs of digits, letters and all characters beyond ASCII, with A-Z in lower case. Cases: null text counts as empty;
repeated rows and repeated doc_ids get the same result as if alone; of hits with equal spans the one of fewer edits counts, then of the
lesser label; a very long text is one row until its words are parted; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import let

K, NEAR, EDIT_WORDS = 4, 3, 12

# Base phrases with their labels, and notices of public licences with the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "apache-2.0-notice": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "gpl-3-notice": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under a creative commons attribution sharealike 4 0 international license"],
    "mit-text": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "zlib": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "lgpl-notice": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "agpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"],
    "cc0": ["the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "bsl-1.0": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"],
    "artistic": ["the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control over the development of the package"],
    "all-rights-reserved": ["no part of this publication may be reproduced distributed or transmitted in any form or by any means"],
}

# Identifiers of licences in the order of the alphabet; a line that names one gives it as its label.
SPDX = [
    "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
TEMPLATES |= {f"spdx:{x.lower()}": ["spdx license identifier " + x.lower().replace("-", " ").replace(".", " ")] for x in SPDX}


def words_of(text: Column) -> Column:
    """lower() also turns other letters, which stay beyond ASCII and so match no template; the two that do not are spelt out."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    odd = text.contains("K") | text.contains("İ")
    lowered = F.when(odd, F.translate(text, upper, low)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def phrase_places(words: Column, phrases: dict[str, str]) -> Column:
    """Array of (start, label) of all places of the phrases."""

    none = F.array().cast("array<struct<start:bigint,label:string>>")

    def one(w: Column, parts: list[str], label: str) -> Column:
        def here(i: Column) -> Column:
            return reduce(lambda a, b: a & b, (F.coalesce(F.get(w, i + k) == p, F.lit(False)) for k, p in reversed([*enumerate(parts)])))

        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)
        found = F.transform(places, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
        return F.when(F.array_contains(w, parts[-1]) & F.array_contains(w, parts[0]), found).otherwise(none)

    def of(w: Column) -> Column:
        return F.concat(*(one(w, phrase.split(), label) for phrase, label in phrases.items()))

    return F.when(F.size(words) > 0, let(words, of)).otherwise(none)


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def grams(words: Column, k: int) -> Column:
    """Hashes of all rolling k-word windows, by place."""
    return F.when(
        F.size(words) >= k,
        let(word_hashes(words), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + n) for n in range(k))))),
    ).otherwise(F.array().cast("array<bigint>"))


def template_positions(spark, templates: dict[str, list[str]], k: int) -> DataFrame:
    """gram, template, label, at, n_template (words): as many rows as the templates have words at most."""
    rows = [(f"{label}/{i}", label, text.split()) for label, texts in templates.items() for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "template string, label string, words array<string>")
    return table.select("template", "label", F.size("words").alias("n_template"), F.posexplode(grams(F.col("words"), k)).alias("at", "gram"))


def _aligned(matches: Column, size: Column, k: int) -> Column:
    """Struct of first, last (words of the text) and edits, from matches (place, at) in the order of the text."""
    start = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("place"), F.lit(-1).alias("at"), F.lit(0).alias("edits"))

    def step(a: Column, x: Column) -> Column:
        text, template = x["place"] - a["place"] - 1, x["at"] - a["at"] - 1  # words between; negative where runs overlap
        between = F.greatest(text, template, F.abs(text - template), F.lit(0))
        return F.struct(
            F.when(a["first"] < 0, x["place"]).otherwise(a["first"]).alias("first"),
            (x["place"] + (k - 1)).alias("place"),
            F.greatest(a["at"], x["at"] + (k - 1)).alias("at"),
            (a["edits"] + F.when(a["first"] < 0, x["at"]).otherwise(between)).alias("edits"),
        )

    return F.aggregate(matches, start, step, lambda a: F.struct(a["first"].alias("first"), a["place"].alias("last"), (a["edits"] + size - 1 - a["at"]).alias("edits")))


def hits(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """doc_id, text_hash, label, template, first, last (words of the text), cover (1 less edits by words): the verified spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    rows = rows.select("doc_id", "text_hash", F.posexplode(grams(F.col("words"), k)).alias("place", "gram"))
    votes = rows.join(F.broadcast(template_positions(docs.sparkSession, templates, k)), "gram")  # as small as the templates
    key = ["doc_id", "text_hash", "label", "template", "n_template"]
    diagonals = votes.groupBy(*key, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set(F.struct("place", "at")).alias("matches"))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    merged = diagonals.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(along))
    merged = merged.groupBy(*key, "span").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    spans = merged.select(*key, _aligned(F.col("matches"), F.col("n_template"), k).alias("s")).select(*key, "s.*")
    spans = spans.where(F.col("edits") * EDIT_WORDS <= F.col("n_template"))
    outer = Window.partitionBy("doc_id", "text_hash").orderBy("first", F.desc("last"), "edits", "label", "template").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("upto", F.max("last").over(outer)).where(F.coalesce(F.col("upto") < F.col("last"), F.lit(True)))
    return spans.select("doc_id", "text_hash", "label", "template", "first", "last", (1 - F.col("edits") / F.col("n_template")).alias("cover"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    based = rows.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), phrase_places(F.col("words"), phrases).alias("base"))
    found = hits(docs, templates).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("own"), F.max("cover").alias("cover"), F.collect_list(F.struct("label", "first", "last", "cover")).alias("spans"))
    joined = based.join(found.withColumnRenamed("doc_id", "id_").withColumnRenamed("text_hash", "hash_"), F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")), "left")
    names = F.array_distinct(F.transform("base", lambda x: x["label"]))
    start = F.transform("base", lambda x: x["start"])
    return joined.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, F.coalesce("own", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.least(F.greatest(F.coalesce("cover", F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)), F.lit(1.0)).alias("score"),
        F.array_sort("spans").alias("spans"),
    )
