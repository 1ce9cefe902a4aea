"""License scans: phrases by place, and text blocks that contain most of a license template's words.

The second part is an exact set-similarity join, in DataFrame functions only. A block is a run of consecutive words, a quarter longer
than the template (or the whole text, if it is shorter), wherever its lines are broken. A template and a block are sets of words;
their containment is the share of the template's words that the block has. Template words are ordered by their frequency in the
corpus, rarest first, ties by the word itself. To contain at least `threshold` of a template of n words a block needs
a = ceil(threshold * n) of them, so

- prefix: one of the template's first n - a + 1 words is in the block
- length: the block lies in a tile of the text, of which at least a words must be different
- position: if that word is the template's j-th, it and the later of either side are what can still be common: 1 + min(tile's words - 1, n - j - 1) >= a

Tiles are stretches of a text that overlap by a block, so every block is in one; those without a prefix word go at once. What passes
is verified by intersections: of the whole tile, then of each block. Tiles stream past the broadcast index (a hash lookup each); neither
texts nor blocks are shuffled, only the few hits, pre-aggregated. Templates are a parameter of bounded size (MOST_WORDS) and travel
as a table; in the plan is one literal, of their prefix words.

Defined results: null and empty texts have no words, places or labels and score 0; repeated rows are scanned each; null ids are kept; rows
that share an id and a text get the same result. score is the greatest containment of a block that reaches the threshold, else 0.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (phrase, label)
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: (label, text); texts of one label count each. Notices as their licenses word them.
TEMPLATES = (
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("proprietary", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
MOST_WORDS = 20_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KELVIN, _OTHER = "\u212a", "\u212b"


def lowered(text: Column) -> Column:
    """A text in lower case, as far as ASCII words go: like lower-casing A-Z only, but much faster than a translation of each letter.

    Of all other letters only the Kelvin sign has an ASCII letter alone for its lower case, so it becomes another one first. Other
    letters' case does not matter here: they are word characters in either, and no phrase or template has any.
    """
    return F.lower(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(_KELVIN), F.lit(_OTHER)))


def words_in(text: Column) -> Column:
    """The words of a text, in order."""
    return F.array_remove(F.split(lowered(text), NOT_WORD), "")


def words_of(text: str) -> list[str]:
    """The words of a template, as words_in() has them."""
    kept = [c.lower() if "A" <= c <= "Z" else c for c in text]
    said = "".join(c if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f" else " " for c in kept)
    return [w for w in said.split(" ") if w]


def frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of the vocabulary stands in the column __w (a row per word of it comes to the driver)."""
    known = words.sparkSession.createDataFrame([(w,) for w in vocabulary], "w string")
    met = words.select(F.explode_outer("__w").alias("w")).join(F.broadcast(known), "w")  # at most MOST_WORDS
    return {r[0]: r[1] for r in met.groupBy("w").count().collect()}


def block_length(template_words: int) -> int:
    return template_words + -(-template_words // 4)


def index(templates, counts: dict[str, int], threshold: tuple[int, int]) -> list[dict]:
    """A row per template: label, words in the corpus's order, n, a and the words of a block."""
    out = []
    for label, text in templates:
        own = sorted(set(words_of(text)), key=lambda w: (counts.get(w, 0), w))
        if own:
            out.append({"label": label, "words": own, "n": len(own), "a": -(-threshold[0] * len(own) // threshold[1]), "block": block_length(len(words_of(text)))})
    return out


def contained(words: DataFrame, keys: list[str], templates=TEMPLATES, threshold: tuple[int, int] = (9, 10)) -> DataFrame:
    """keys, label and containment: the best of each place where blocks of the column __w reach threshold, a fraction (numerator, denominator)."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError("too many words of templates to broadcast")
    found = index(templates, frequencies(words, vocabulary), threshold)
    rows = [(w, t["label"], j, t["n"], t["a"], t["block"], t["words"]) for t in found for j, w in enumerate(t["words"][: t["n"] - t["a"] + 1])]
    prefixes = words.sparkSession.createDataFrame(rows, "w string, label string, j int, n int, a int, block int, words array<string>")
    w, most = F.col("__w"), max([t["block"] for t in found], default=1)
    # one literal, however many words
    first = F.from_json(F.lit(json.dumps(sorted({r[0] for r in rows}))), "array<string>")
    step, n = 3 * most, F.size(w)
    tile = lambda i: F.slice(w, F.greatest(i * step - most, F.lit(0)) + 1, F.lit(step + 2 * most))
    # explode_outer: an inner one would have its array made twice, once for a filter on its size
    tiles = F.filter(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), tile), lambda t: F.arrays_overlap(t, first))
    some = words.where(n > 0).select(*keys, F.explode_outer(tiles).alias("__t")).where(F.col("__t").isNotNull())
    met = some.select(*keys, "__t", F.explode_outer(F.array_intersect("__t", first)).alias("w")).join(F.broadcast(prefixes), "w")
    size = F.size(F.array_distinct("__t"))
    fits = met.where((size >= F.col("a")) & (F.least(size - 1, F.col("n") - F.col("j") - 1) + 1 >= F.col("a"))).where("size(array_intersect(words, __t)) >= a")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__t") - F.col("block")))
    best = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect("words", F.slice("__t", s + 1, F.col("block"))))))
    return fits.select(*keys, "label", "n", "a", best.alias("both")).where("both >= a").select(*keys, "label", (F.col("both") / F.col("n")).alias("containment"))


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, from 0."""
    first, *rest = phrase.split()
    at = F.transform(words, lambda w, i: F.when(reduce(and_, [F.get(words, i + k) == F.lit(x) for k, x in enumerate(rest, 1)], w == F.lit(first)), i))
    # most texts lack a word of it: they are not walked through
    return F.when(reduce(and_, [F.array_contains(words, x) for x in phrase.split()]), F.array_compact(at)).otherwise(F.array().cast("array<int>"))


def scan(df: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: tuple[int, int] = (9, 10), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    said = F.col(text).cast("string")
    one = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(said).alias("__k"), words_in(said).alias("__w"))
    found = one.select("doc_id", "__k", F.size("__w").cast("long").alias("n_words"), *[places(F.col("__w"), p).alias(f"__p{i}") for i, (p, _) in enumerate(phrases)])
    own = [F.col(f"__p{i}") for i in range(len(phrases))]
    base = found.select(
        "doc_id",
        "__k",
        "n_words",
        reduce(add, [F.size(c) for c in own]).cast("long").alias("n_base"),
        F.array_min(F.concat(*own)).cast("long").alias("first_word"),
        F.array_max(F.concat(*own)).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.size(c) > 0, F.lit(label)) for c, (_, label) in zip(own, phrases, strict=True)])))).alias("__base"),
    )
    more = contained(one, ["doc_id", "__k"], templates, threshold).groupBy("doc_id", "__k").agg(F.collect_set("label").alias("__more"), F.max("containment").alias("__score"))
    more = more.withColumnsRenamed({"doc_id": "__d", "__k": "__h"})
    none = F.array().cast("array<string>")
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("__k").eqNullSafe(F.col("__h")), "left")
    joined = lambda c: F.array_join(c, ",")
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("__base")).alias("base_labels"), joined(F.array_sort(F.array_union("__base", F.coalesce("__more", none)))).alias("labels"), F.coalesce("__score", F.lit(0.0)).alias("score"))
