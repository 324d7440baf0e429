"""Licence scan with a positional rare-token index, built-in functions only.

Templates are short licence notices, word by word; each has mandatory key phrases. Inverse document frequencies of the
templates' words come from all documents. The index lists, for every key phrase, its two words of the highest frequency
weight with their positions (postings). In a file the rare words are looked up; where the first stands, the second must
stand at the postings' relative position (their intersection), and then the whole phrase is compared word by word. Around
a verified phrase the rest of its template is compared at the same relative positions; the weight of the words that agree
is the notice's score.

Every place of a phrase contains its rarest word, so no place is lost. A file is one row from scan to result: no row
is exploded or shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.decontamination import normal_words

NOTICE_SHARE = 0.6      # of a template's weight that has to stand around its phrase


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrases: tuple[str, ...]    # mandatory: all have to stand in the file, at the template's relative positions
    base: bool = False          # a bare phrase: each of its places counts by itself


# The required phrases and their labels, then customary short notices.
TEMPLATES = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
             ("permission is hereby granted free of charge", "deal in the software without restriction")),
    Template("apache-2", "licensed under the apache license version 2 0", ("the apache license",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
             ("gnu general public license as published by the free software foundation",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license",
             ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, dict[str, int]]:
    """Documents with a word, and for each word of the templates the documents that hold it, over all of ``docs``."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    held = docs.select(F.array_intersect(F.concat(F.array(F.lit("")), normal_words(F.col("text"))),
                                         F.array(*[F.lit(w) for w in ["", *vocabulary]])).alias("held"))
    counted = held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    found = {r["word"]: r["k"] for r in counted.collect()}  # at most the templates' words and the count of all rows
    return found.pop("", 0), found


def weights(rows: int, held: dict[str, int], templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of every template word."""
    return {w: math.log((rows + 1) / (held.get(w, 0) + 1)) + 1e-3 for t in templates for w in t.words.split()}


def index(weight: dict[str, float], templates: tuple[Template, ...] = TEMPLATES) -> F.Column:
    """One entry per key phrase: its words, its two rarest words' postings, and its template with the phrase's place in it."""
    entries = []
    for n, t in enumerate(templates):
        words = t.words.split()
        for phrase in t.phrases:
            p = phrase.split()
            starts = [i for i in range(len(words)) if words[i:i + len(p)] == p]
            if not starts:
                raise ValueError(f"the notice lacks its key phrase {phrase!r}")
            # distinct positions, rarest first; a phrase of one word is its own second posting
            rare = sorted(range(len(p)), key=lambda i: (-weight[p[i]], i))
            first, second = rare[0], rare[min(1, len(rare) - 1)]
            entries.append(F.struct(
                F.lit(n).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"),
                F.lit(len(t.phrases)).alias("phrases"), F.lit(t.phrases.index(phrase)).alias("phrase"),
                F.lit(p[first]).alias("rare"), F.lit(first).alias("rare_at"),
                F.lit(p[second]).alias("next"), F.lit(second - first).alias("next_by"),
                F.array(*[F.lit(w) for w in p]).alias("words"), F.lit(starts[0]).alias("start"),
                F.array(*[F.struct(F.lit(w).alias("word"), F.lit(weight[w]).alias("weight")) for w in words]).alias("notice"),
                F.lit(sum(weight[w] for w in words)).alias("whole")))
    return F.array(*entries)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, share: float = NOTICE_SHARE) -> DataFrame:
    """All columns of docs plus n_words (long) and ``places``: array of (template, label, base, start, score), one for
    each verified place of a base phrase (score 1) and each notice of which all key phrases stand at their places
    and at least ``share`` of the weight agrees (its start is the start of its first key phrase).

    A null or blank text has no words and no places. Repeated rows are rows like others; an empty table gives an empty
    one. Input columns named n_words or places are replaced, others carried along. Words are those of ``normal_words``."""
    rows, held = document_frequencies(docs, templates)
    weight = weights(rows, held, templates)
    anchors = sorted({max(p.split(), key=lambda w: weight[w]) for t in templates for p in t.phrases})
    names = [c for c in docs.columns if c not in ("n_words", "places")]
    entry = index(weight, templates)
    words = docs.select(*names, normal_words(F.col("text")).alias("_words"))
    # the file's rare licence words; most files have none and are done here
    rare = words.withColumn("_rare", F.array_intersect("_words", F.array(*[F.lit(w) for w in anchors])))

    def word(at: F.Column) -> F.Column:
        return F.when((at >= 0) & (at < F.size("_words")), F.get("_words", at))

    spots = F.filter(F.transform("_words", lambda w, i: F.when(F.array_contains("_rare", w), F.struct(w.alias("word"), i.alias("at")))), lambda s: s.isNotNull())
    # postings: the rarer word here, the other at its relative position, then the phrase
    aligned = F.flatten(F.transform(spots, lambda s: F.transform(
        F.filter(entry, lambda e: (e["rare"] == s["word"]) & (word(s["at"] + e["next_by"]) == e["next"])),
        lambda e: F.struct(e.alias("e"), (s["at"] - e["rare_at"]).alias("start")))))
    verified = F.filter(aligned, lambda a: (a["start"] >= 0) & (F.slice("_words", F.greatest(a["start"], F.lit(0)) + 1, F.size(a["e"]["words"])) == a["e"]["words"]))
    found = rare.withColumn("_found", F.when(F.size("_rare") > 0, verified))

    def agreeing(e: F.Column, origin: F.Column) -> F.Column:
        kept = F.transform(e["notice"], lambda x, j: F.when(word(origin + j) == x["word"], x["weight"]).otherwise(F.lit(0.0)))
        return F.least(F.lit(1.0), F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / e["whole"])

    def others(e: F.Column, origin: F.Column) -> F.Column:
        """Whether the template's other phrases stand at their places."""
        here = F.filter("_found", lambda b: (b["e"]["template"] == e["template"]) & (b["start"] - b["e"]["start"] == origin))
        return F.size(F.array_distinct(F.transform(here, lambda b: b["e"]["phrase"]))) == e["phrases"]

    scored = F.transform("_found", lambda a: F.struct(
        a["e"]["template"].alias("template"), a["e"]["label"].alias("label"), a["e"]["base"].alias("base"), a["start"].alias("start"),
        F.when(a["e"]["base"], F.lit(1.0)).when((a["e"]["phrase"] == 0) & others(a["e"], a["start"] - a["e"]["start"]),
                                                agreeing(a["e"], a["start"] - a["e"]["start"])).otherwise(F.lit(0.0)).alias("score")))
    places = F.coalesce(F.filter(scored, lambda s: s["score"] >= share),
                        F.array().cast("array<struct<template:int,label:string,base:boolean,start:int,score:double>>"))
    return found.select(*names, F.size("_words").cast("long").alias("n_words"), places.alias("places"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best place's,
    0 without any). Handling as in ``scan``."""
    def listed(labels: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"].cast("long"))
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        listed(F.transform(base, lambda p: p["label"])).alias("base_labels"), listed(F.transform("places", lambda p: p["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["score"])), F.lit(0.0)).alias("score"))
