"""Licence texts, by a positional index of their rarest words."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profileloom.llm.common import as_documents, lower_ascii


class Template(NamedTuple):
    text: str  # words of the licence
    label: str
    key: str = ""  # the part that must stand word for word; the whole text if not given
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def mandatory(self) -> list[str]:
        return (self.key or self.text).split()

    @property
    def lead(self) -> int:
        """Words of the text before the mandatory part."""
        return len(f" {self.text} ".split(f" {self.key or self.text} ", 1)[0].split())


#: Licence notices in lower case without punctuation, their labels, and the part that must stand.
TEMPLATES = (
    Template("gnu general public license", "gpl", base=True),
    Template("apache license", "apache", base=True),
    Template("cc by", "cc-by", base=True),
    Template("mit license", "mit", base=True),
    Template("gnu lesser general public license", "lgpl"),
    Template("gnu affero general public license", "agpl"),
    Template("mozilla public license", "mpl"),
    Template("eclipse public license", "epl"),
    Template("boost software license", "boost"),
    Template("artistic license", "artistic"),
    Template("python software foundation license", "psf"),
    Template("creative commons attribution", "cc-by"),
    Template("cc by sa", "cc-by-sa"),
    Template("cc0 1 0 universal", "cc0"),
    Template("the person who associated a work with this deed has dedicated the work to the public domain", "cc0", "has dedicated the work to the public domain"),
    Template("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "boost", "person or organization obtaining a copy of the software and accompanying documentation"),
    Template("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd", "redistribution and use in source and binary forms with or without modification"),
    Template("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", "permission to use copy modify and or distribute this software for any purpose"),
    Template("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", "for any purpose without fee and without a written agreement is hereby granted"),
    Template("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache", "you may not use this file except in compliance with the license"),
    Template("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    Template("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl", "source code form is subject to the terms of the mozilla public license"),
    Template("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("this is free and unencumbered software released into the public domain", "unlicense", "free and unencumbered software released into the public domain"),
)
#: Distinct words of a template's mandatory part that are looked up.
RAREST = 2


def _words(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the lower-cased text."""
    spaced = F.trim(F.regexp_replace(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def word_idf(words: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency, over all rows, of each word that a template must have; rows: words array<string>."""
    known = sorted({w for t in templates for w in t.mandatory})
    found = words.select(F.array_distinct(F.filter("words", lambda w: w.isin(known))).alias("found"))
    counts = found.select(F.explode(F.concat("found", F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r.w: r.n for r in counts.collect()}  # a row for each word of the templates, and one for all texts
    return {w: math.log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in known}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row of `docs`.

    The corpus is read twice: for the document frequency of each licence word, and for the scan. The index lists, for
    the rarest words of each template's mandatory part, their places in it. A text that has all of a template's looks up each of
    its words once; every posting gives a place where the template would start, a start that all of the template's postings
    agree on is a candidate, and it holds if the mandatory part stands there word for word. Only totals of words are shuffled.

    score: for held templates, the greatest of 1/2 + 1/2 of the share of the template's words that stand in their
    places; else half the greatest share of a template's looked up words that the text has. Null text counts as empty: no words,
    null places, empty labels, score 0. Null ids and repeated rows are scanned as they are, whole texts of any length; an empty table gives
    no rows; columns other than doc_id and text aren't read.
    """
    rows = as_documents(docs).select("doc_id", _words(F.col("text")).alias("words"))
    idf = word_idf(rows, templates)
    rarest = [sorted(set(t.mandatory), key=lambda w: (-idf[w], w))[:RAREST] for t in templates]
    index: dict[str, list[tuple[int, int]]] = {}
    for k, (t, rare) in enumerate(zip(templates, rarest, strict=True)):
        for at, w in enumerate(t.mandatory):
            if w in rare:
                index.setdefault(w, []).append((k, at))
    needed = F.array(*(F.lit(sum(k == j for places in index.values() for j, _ in places)) for k in range(len(templates))))
    mandatory = F.array(*(F.array(*map(F.lit, t.mandatory)) for t in templates))
    places = F.create_map(*(x for w, of in index.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("t"), F.lit(at).alias("at")) for k, at in of)))))
    shape = "array<struct<t:int,start:int>>"
    rows = rows.withColumn("found", F.array_distinct(F.filter("words", lambda w: w.isin(sorted(index)))))
    shares = [F.size(F.array_intersect("found", F.array(*map(F.lit, rare)))) / F.lit(len(rare)) for rare in rarest]
    rows = rows.withColumn("share", F.greatest(*shares, F.lit(0.0)))
    at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(sorted(index)))
    starts = F.flatten(F.transform(at, lambda x: F.transform(F.element_at(places, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("start")))))
    rows = rows.withColumn("starts", F.array_sort(F.when(F.col("share") == 1, starts).otherwise(F.array().cast(shape))))

    def holds(x: Column, i: Column) -> Column:
        agreed = F.get("starts", i + F.element_at(needed, x["t"] + 1) - 1) == x  # equal starts stand side by side
        there = F.slice("words", x["start"] + 1, F.size(F.element_at(mandatory, x["t"] + 1))) == F.element_at(mandatory, x["t"] + 1)
        return agreed & F.when(x["start"] >= 0, there).otherwise(F.lit(False))

    rows = rows.withColumn("held", F.coalesce(F.filter("starts", holds), F.array().cast(shape)))
    texts, leads = F.array(*(F.array(*map(F.lit, t.words)) for t in templates)), F.array(*(F.lit(t.lead) for t in templates))

    def in_place(x: Column) -> Column:
        text, begin = F.element_at(texts, x["t"] + 1), x["start"] - F.element_at(leads, x["t"] + 1)
        hits = F.filter(F.transform(text, lambda w, i: (begin + i >= 0) & (F.get("words", F.greatest(begin + i, F.lit(0))) == w)), lambda hit: F.coalesce(hit, F.lit(False)))
        return F.size(hits) / F.size(text)

    base_no = [k for k, t in enumerate(templates) if t.base]
    named = F.array(*(F.lit(t.label) for t in templates))
    base = F.transform(F.filter("held", lambda x: x["t"].isin(base_no)), lambda x: x["start"])

    def labels(held: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda x: F.element_at(named, x["t"] + 1)))), ",")

    score = F.when(F.size("held") > 0, 0.5 + F.array_max(F.transform("held", in_place)) / 2).otherwise(F.col("share") / 2)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), base.alias("base"), labels(F.filter("held", lambda x: x["t"].isin(base_no))).alias("base_labels"), labels(F.col("held")).alias("labels"), score.alias("score"))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").cast("long").alias("first_word"), F.array_max("base").cast("long").alias("last_word"), "base_labels", "labels", "score")
