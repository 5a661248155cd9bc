"""Licence scan by a positional index of rare template words.

Document frequencies of the template vocabulary are counted over the whole corpus (a table no
longer than that vocabulary). The rarest words of each template become its postings. A file's
rare licence words are looked up there; every hit proposes a place where the template would
start, the proposals of different words are intersected by comparing the words at those
relative positions, and a place counts once the template's mandatory phrase stands inside it.
All work on a document happens in its own row: nothing is shuffled but the word counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.columns import let

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence notices as (label, mandatory phrase, text), in normalised words.
TEMPLATES = [
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license",
     "licensed under the apache license version 2 0 the license you may not use this file except "
     "in compliance with the license"),
    ("gpl", "general public license",
     "this work is licensed under the gnu general public license version 3"),
    ("gpl", "general public license",
     "this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation"),
    ("lgpl", "lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of "
     "the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "affero general public license",
     "you can redistribute it and or modify it under the terms of the gnu affero general public "
     "license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("unlicense", "released into the public domain",
     "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution",
     "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
]

_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of a text as an array; null has none.

    Letters outside ASCII only ever stand in words that no template holds, so plain ``lower``
    does for them too.
    """

    def trimmed(parts: Column) -> Column:
        lead = (F.get(parts, 0) == "").cast("int")
        tail = (F.get(parts, F.size(parts) - 1) == "").cast("int")
        return F.slice(parts, lead + 1, F.greatest(F.size(parts) - lead - tail, F.lit(0)))

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), _APART, -1), trimmed)


def document_frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[dict, int]:
    """In how many documents each vocabulary word occurs, and how many documents there are."""
    kept = F.filter(F.array_distinct(words_of(F.col(text))), lambda w: w.isin(vocabulary))
    # the empty word stands for the document itself
    seen = docs.select(F.explode(F.concat(kept, F.array(F.lit("")))).alias("word"))
    counts = {r["word"]: r["n"] for r in seen.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts, counts.pop("", 0)


def postings(counts: dict, documents: int, anchors: int) -> list[list[tuple[str, int]]]:
    """For every template its ``anchors`` words of highest IDF, with all their positions."""

    def idf(word: str) -> float:
        return math.log((documents + 1) / (counts.get(word, 0) + 1))

    chosen = []
    for _, _, body in TEMPLATES:
        words = body.split()
        best = sorted(set(words), key=lambda w: (-idf(w), w))[:anchors]
        chosen.append([(w, i) for i, w in enumerate(words) if w in best])
    return chosen


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    anchors: int = 4,
    agree: float = 0.75,
    least: float = 0.7,
) -> DataFrame:
    """One row per document: id, n_words, places (start, label) of phrases, found templates.

    ``found`` is an array of (label, start, share): the template's words stand from word
    ``start`` on, at least ``agree`` of its rare words and ``least`` of all its words in place,
    and its mandatory phrase among them. Null and empty texts have no words; repeated rows are
    scanned each for itself; an empty table gives no rows.
    """
    vocabulary = sorted({w for _, _, body in TEMPLATES for w in body.split()})
    rare = postings(*document_frequencies(docs, text, vocabulary), anchors)
    looked_up = sorted({w for p in rare for w, _ in p})
    first_words = sorted({p.split()[0] for p in PHRASES})

    def spots(words: Column, wanted: list[str]) -> Column:
        marked = F.transform(words, lambda w, i: F.when(w.isin(wanted), i))
        return F.filter(marked, lambda i: i.isNotNull())

    def stands(words: Column, at: Column, phrase: list[str]) -> Column:
        test = F.lit(True)
        for k, w in enumerate(phrase):
            test = test & F.coalesce(F.get(words, at + k) == w, F.lit(False))
        return test

    def places(words: Column, at: Column) -> Column:
        label = None
        for phrase, name in PHRASES.items():
            label = (F.when if label is None else label.when)(
                stands(words, at, phrase.split()), F.lit(name)
            )
        return F.struct(at.alias("start"), label.alias("label"))

    template = F.array(
        *[
            F.struct(
                F.lit(label).alias("label"),
                F.lit(f" {phrase} ").alias("phrase"),
                F.array(*[F.lit(w) for w in body.split()]).alias("words"),
                F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for w, i in p]).alias("rare"),
            )
            for (label, phrase, body), p in zip(TEMPLATES, rare, strict=True)
        ]
    )

    def aligned(words: Column, hits: Column, t: Column) -> Column:
        """Places of one template."""
        proposed = F.array_distinct(
            F.flatten(
                F.transform(
                    hits,
                    lambda i: F.transform(
                        F.filter(t["rare"], lambda a: a["w"] == F.get(words, i)), lambda a: i - a["i"]
                    ),
                )
            )
        )
        length = F.size(t["words"])
        agreed = F.filter(
            proposed,
            lambda s: F.size(
                F.filter(t["rare"], lambda a: F.coalesce(F.get(words, s + a["i"]) == a["w"], F.lit(False)))
            )
            >= agree * F.size(t["rare"]),
        )

        def judged(s: Column) -> Column:
            window = F.slice(words, F.greatest(s, F.lit(0)) + 1, F.greatest(length + F.least(s, F.lit(0)), F.lit(0)))
            same = F.size(
                F.filter(
                    F.transform(t["words"], lambda w, k: F.coalesce(F.get(words, s + k) == w, F.lit(False))),
                    lambda x: x,
                )
            )
            has = F.contains(F.concat(F.lit(" "), F.array_join(window, " "), F.lit(" ")), t["phrase"])
            return F.struct(
                t["label"].alias("label"), s.alias("start"), (same / length).alias("share"), has.alias("has")
            )

        return F.filter(F.transform(agreed, judged), lambda f: f["has"] & (f["share"] >= least))

    none = "array<struct<label:string,start:int,share:double,has:boolean>>"

    def scanned(words: Column) -> Column:
        hits = spots(words, looked_up)
        found = F.when(
            F.exists(words, lambda w: w.isin(looked_up)),
            let(hits, lambda h: F.flatten(F.transform(template, lambda t: aligned(words, h, t)))),
        ).otherwise(F.array().cast(none))
        phrases = F.filter(
            F.transform(spots(words, first_words), lambda i: places(words, i)),
            lambda p: p["label"].isNotNull(),
        )
        return F.struct(
            F.size(words).cast("long").alias("n_words"), phrases.alias("places"), found.alias("found")
        )

    return docs.select(F.col(key).alias("doc_id"), let(words_of(F.col(text)), scanned).alias("scan")).select(
        "doc_id", "scan.n_words", "scan.places", "scan.found"
    )
