"""License scans: base phrases, and notices found by diagonal voting.

All rolling hashes of ``K`` words of every text are joined to the positions
at which license templates hold the same words. Matches of one text and
template lie on the diagonal word position minus template position; votes are
counted by diagonal, diagonals within ``MERGE`` of each other (a word more or
less inside a notice) become one span, and a span counts by the share of the
template's words that it covers. Hash matches are verified by the words.

DataFrame operations only.

Edge cases: null or empty text has no words, no labels and score 0; a null id
is kept as it is; repeated rows get equal results; an empty table gives an
empty result; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm._shared import KEYS, NOT_ALNUM, ascii_lower, cut, row_keys, words

K, MERGE, MIN_SCORE = 4, 2, 0.6
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Public license notices, by label.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "bsd": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met""",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "mit": [
        "Released under the MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
    ],
    "mpl": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""",
    ],
}


def text_words(text: Column) -> Column:
    return words(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM)


def template_grams(spark: SparkSession, templates: Mapping[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """label, template, t_pos, t_words, t_h and the words t0.. of each k-gram; as large as the templates."""
    rows, n = [], 0
    for label in sorted(templates):
        for text in templates[label]:
            own = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
            rows += [(label, n, i, len(own), *own[i : i + k]) for i in range(len(own) - k + 1)]
            n += 1
    names = [f"t{i}" for i in range(k)]
    frame = spark.createDataFrame(rows, "label string, template int, t_pos int, t_words int, " + ", ".join(f"{c} string" for c in names))
    return frame.withColumn("t_h", F.xxhash64(*names))


def votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, list[str]] = TEMPLATES, k: int = K) -> DataFrame:
    """Row keys, label, template, t_words, diagonal, t_pos: one row a verified match."""
    w = F.col("__w")
    rows = docs.select(*[c.alias(n) for n, c in row_keys(id_col, text_col).items()], text_words(F.col(text_col)).alias("__w"))
    zipped = F.arrays_zip(F.sequence(F.lit(1), F.size(w)).alias("p"), w.alias("w0"), *[F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{i}") for i in range(1, k)])
    rows = rows.select(*KEYS, F.inline_outer(zipped).alias("p", *[f"w{i}" for i in range(k)]))
    rows = rows.where(F.col(f"w{k - 1}").isNotNull()).withColumn("h", F.xxhash64(*[f"w{i}" for i in range(k)]))
    same = F.col("h") == F.col("t_h")
    for i in range(k):
        same = same & (F.col(f"w{i}") == F.col(f"t{i}"))
    hits = rows.join(F.broadcast(template_grams(docs.sparkSession, templates, k)), same)  # as large as the templates
    return hits.select(*KEYS, "label", "template", "t_words", (F.col("p") - 1 - F.col("t_pos")).alias("diagonal"), "t_pos")


def spans(found: DataFrame, k: int = K, merge: int = MERGE) -> DataFrame:
    """Row keys, label, template, first (word), n_votes, covered, score of each merged span."""
    per = [*KEYS, "label", "template", "t_words"]
    lines = found.groupBy(*per, "diagonal").agg(F.count(F.lit(1)).alias("n"), F.collect_set("t_pos").alias("at"))
    w = Window.partitionBy(*per).orderBy("diagonal")
    lines = lines.withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w), F.lit(merge + 1)) > merge).cast("int"))
    lines = lines.withColumn("span", F.sum("new").over(w))
    merged = lines.groupBy(*per, "span").agg(F.sum("n").alias("n_votes"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(F.col("diagonal") + F.array_min("at")).alias("first"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + k - 1)))))
    return merged.withColumn("covered", covered).select(*KEYS, "label", "template", "first", "n_votes", "covered", (covered / F.col("t_words")).alias("score"))


def places(w: Column, n: Column, joined: Column, phrase: str) -> Column:
    """Start of every place where the phrase's words stand in ``w``; looked for only where the joined words hold it."""
    own = phrase.split(" ")

    def here(i: Column) -> Column:
        out = w[i] == own[0]
        for j, x in enumerate(own[1:], 1):
            out = out & (w[i + j] == x)
        return out

    return F.when(joined.contains(f" {phrase} "), F.filter(F.sequence(F.lit(0), n - len(own)), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, list[str]] = TEMPLATES, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    found = spans(votes(docs, id_col, text_col, templates))
    found = cut(found.groupBy(*KEYS).agg(F.max("score").alias("best"), F.collect_set(F.when(F.col("score") >= min_score, F.col("label"))).alias("more")), "notices")
    rows = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in row_keys(id_col, text_col).items()], text_words(F.col(text_col)).alias("__w"))
    rows = rows.withColumns({"n_words": F.size("__w"), "__s": F.concat(F.lit(" "), F.array_join("__w", " "), F.lit(" "))})
    at = {f"__p{i}": places(F.col("__w"), F.col("n_words"), F.col("__s"), p) for i, p in enumerate(PHRASES)}
    rows = rows.withColumns(at).drop("__w", "__s").withColumn("__all", F.flatten(F.array(*at)))
    label = [F.when(F.size(p) > 0, F.lit(v)) for p, v in zip(at, PHRASES.values(), strict=True)]
    rows = rows.select(
        "doc_id", *KEYS, F.col("n_words").cast("long").alias("n_words"), F.size("__all").cast("long").alias("n_base"), F.array_min("__all").cast("long").alias("first_word"),
        F.array_max("__all").cast("long").alias("last_word"), F.array_sort(F.array_compact(F.array(*label))).alias("__base"),
    )
    rows = rows.join(found, KEYS, "left")
    return rows.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("__base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("__base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )
