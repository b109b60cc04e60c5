"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

Blocks are all runs of words that are a quarter longer than a template, whatever the lines they
stand in. Tokens are ordered by their frequency in the corpus, rarest first. A block that holds at
least `need` of a template's tokens holds one of the first |T| - need + 1 of them (prefix filter);
with the rarest of those at place j, it holds `need` of the tokens from j on, among the words near
it (positional and length filter). Blocks around the places that pass are counted.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

#: Phrases that name a license wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wordings of licenses and notices, and their labels.
TEMPLATES = {
    "Released under the MIT License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so": "mit",
    "Licensed under the Apache License, Version 2.0": "apache",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache",
    "This work is licensed under the GNU General Public License, version 3": "gpl",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0": "mpl",
    "This is free and unencumbered software released into the public domain": "unlicense",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "Licensed under CC BY-SA 4.0": "cc-by-sa",
    "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
    "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License": "cc-by-sa",
    "All rights reserved": "all-rights-reserved",
}
#: A template of this many tokens or more is found from this share of them on; in a shorter one each word decides, so all are needed.
CONTAINMENT, LONG = 0.8, 10
#: A block has this many words for each of the template's.
SLACK = 1.25

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), SEPARATOR), "")


def word_list(template: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, re.sub("[A-Z]", lambda m: m[0].lower(), template)) if w]


def template_rows(templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> list[tuple[list[str], str, int, int]]:
    """(distinct tokens, label, need, words of a block) of each template that has words."""
    out = []
    for t, label in (templates or TEMPLATES).items():
        words = word_list(t)
        distinct = sorted(set(words))
        need = len(distinct) if len(distinct) < LONG else math.ceil(containment * len(distinct) - 1e-9)
        if words:
            out.append((distinct, label, need, math.ceil(SLACK * len(words) - 1e-9)))
    return out


def phrase_places(w: Column, phrase: list[str]) -> Column:
    """Word positions where the phrase's words stand consecutively; cheap where a word is missing."""
    there = reduce(lambda a, b: a & b, [F.array_contains(w, x) for x in phrase])
    at = F.filter(F.sequence(F.lit(0), F.size(w) - len(phrase)), lambda i: reduce(lambda a, b: a & b, [w[i + k] == x for k, x in enumerate(phrase)]))
    return F.when(there & (F.size(w) >= len(phrase)), at).otherwise(F.array().cast("array<int>"))


def prefix_index(docs: DataFrame, text: str, templates: dict[str, str] | None, containment: float) -> list[tuple]:
    """(token, later tokens, tokens, need, words of a block, label) of the templates' prefixes; tokens are ordered by the corpus, rarest first."""
    sets = template_rows(templates, containment)
    vocabulary = sorted({w for t, *_ in sets for w in t})
    word = docs.select(F.explode(word_array(F.col(text))).alias("w")).where(F.col("w").isin(vocabulary))
    counts = {r.w: r.n for r in word.groupBy("w").agg(F.count("*").alias("n")).collect()}  # as many rows as the templates have tokens
    index = []
    for t, label, need, block in sets:
        ordered = sorted(t, key=lambda w: (counts.get(w, 0), w))
        index += [(w, ordered[j:], ordered, need, block, label) for j, w in enumerate(ordered[: len(t) - need + 1])]
    return index


def template_matches(docs: DataFrame, keys: list[str], text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(keys, start, label, containment) of the best block around each place that passes the filters; start counts words from 0."""
    index = prefix_index(docs, text, templates, containment)
    strings = lambda x: F.array(*map(F.lit, x))
    row = [F.struct(F.lit(w).alias("token"), strings(later).alias("later"), strings(t).alias("template"), F.lit(need).alias("need"), F.lit(block).alias("block"), F.lit(label).alias("label")) for w, later, t, need, block, label in index]
    prefixes = F.broadcast(docs.sparkSession.range(1).select(F.inline(F.array(*row))))  # its size is the templates'
    words = docs.select(*keys, word_array(F.col(text)).alias("w"))
    at = words.select(*keys, "w", F.posexplode("w").alias("i", "token")).where(F.col("token").isin(sorted({x[0] for x in index})))
    first = F.greatest(F.col("i") - F.col("block") + 1, F.lit(0))
    near = at.join(prefixes, "token").withColumns({"first": first, "span": F.slice("w", first + 1, F.col("i") + F.col("block") - first)})
    near = near.where(F.size(F.array_intersect("span", "later")) >= F.col("need"))
    near = cut(near.select(*keys, "first", (F.col("i") - F.col("first")).alias("back"), "span", "template", "need", "block", "label"), "near")
    held = F.expr("transform(sequence(0, back), s -> struct(size(array_intersect(slice(span, s + 1, block), template)) as n, -s as s))")
    best = near.select(*keys, "first", "need", "label", F.size("template").alias("tokens"), F.array_max(held).alias("best")).where("best.n >= need")
    return best.select(*keys, (F.col("first") - F.col("best.s")).alias("start"), "label", (F.col("best.n") / F.col("tokens")).alias("containment")).distinct()


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score): one row for each row of docs.

    Base labels come from phrases, the others from template_matches(); score is the largest
    containment found, 1 where a phrase stands, else 0. Only A-Z are lower-cased. Null texts are
    empty; rows alike in key and text have equal results.
    """
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text")).withColumn("_same", F.xxhash64("_text"))
    words = rows.select("_key", "_same", word_array(F.col("_text")).alias("w"))
    found = words.select("_key", "_same", F.size("w").cast("long").alias("n_words"), *[phrase_places(F.col("w"), p.split()).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    at = F.flatten(F.array(*[f"p{i}" for i in range(len(PHRASES))]))
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(x)) for i, x in enumerate(PHRASES.values())]))
    base = found.select("_key", "_same", "n_words", at.alias("at"), labels.alias("base"))
    hits = template_matches(rows, ["_key", "_same"], "_text", templates, containment)
    hits = hits.groupBy("_key", "_same").agg(F.collect_set("label").alias("more"), F.max("containment").alias("most")).alias("h")
    out = base.alias("b").join(hits, F.col("b._key").eqNullSafe(F.col("h._key")) & (F.col("b._same") == F.col("h._same")), "left")
    joined = lambda c: F.concat_ws(",", F.array_sort(F.array_distinct(c)))
    return out.select(
        F.col("b._key").alias(key), "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"),
    )
