"""Licence scan with a positional index of rare licence words, in DataFrame operations only.

The index maps a word to postings (template, position).  Each template posts its ANCHORS rarest words
among its mandatory key phrases, rarity being measured over all documents scanned (inverse document
frequency).  A file looks up every indexed word it holds; a posting (t, p) of a word at position i says
that template t may start at i - p, and a start that two words agree on is a candidate.  A candidate
counts once every mandatory key phrase of the template stands in place.  The base phrases are
templates of the same index whose phrase is all they have.  All of it is local to a row, apart from the
word frequencies; the cost of a file follows its own hits, not the number of templates.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Rarest words indexed of each template.
ANCHORS = 4
#: What a base phrase scores where no template stands.
BASE_SCORE = 0.5


def words_of(text: str) -> list[str]:
    """The words of a text as the scan sees them: only A-Z are lowered."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Public wordings of licence grants and notices, and the phrases without which a grant is
# not the licence's.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("Permission is hereby granted, free of charge", "obtaining a copy of this software")),
    Template("mit", "Released under the MIT License", ("MIT License",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("SPDX-License-Identifier: MIT",)),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("Apache License", "Version 2.0")),
    Template("apache", "SPDX-License-Identifier: Apache-2.0", ("SPDX-License-Identifier: Apache",)),
    Template("gpl", "This work is licensed under the GNU General Public License", ("GNU General Public License",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("redistribute it and/or modify it", "GNU General Public License")),
    Template("gpl", "SPDX-License-Identifier: GPL", ("SPDX-License-Identifier: GPL",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("GNU Lesser General Public License",)),
    Template("lgpl", "under the terms of the GNU Library General Public License as published by the Free Software Foundation", ("GNU Library General Public License",)),
    Template("lgpl", "SPDX-License-Identifier: LGPL", ("SPDX-License-Identifier: LGPL",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("GNU Affero General Public License",)),
    Template("agpl", "SPDX-License-Identifier: AGPL", ("SPDX-License-Identifier: AGPL",)),
    Template("gfdl", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", ("GNU Free Documentation License",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms", "with or without modification")),
    Template("bsd", "SPDX-License-Identifier: BSD", ("SPDX-License-Identifier: BSD",)),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("Permission to use, copy, modify", "with or without fee is hereby granted")),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License", ("Eclipse Public License",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", ("In no event will the authors be held liable for any damages",)),
    Template("boost", "Distributed under the Boost Software License, Version 1.0", ("Boost Software License",)),
    Template("artistic", "This package is distributed under the Artistic License 2.0", ("Artistic License",)),
    Template("wtfpl", "Do What The Fuck You Want To Public License", ("Do What The Fuck You Want To Public License",)),
    Template("psf", "This LICENSE AGREEMENT is between the Python Software Foundation and the Individual or Organization accessing and otherwise using this software", ("LICENSE AGREEMENT is between the Python Software Foundation",)),
    Template("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", ("without a written agreement is hereby granted",)),
    Template("eupl", "Licensed under the European Union Public Licence", ("European Union Public Licence",)),
    Template("cddl", "The contents of this file are subject to the terms of the Common Development and Distribution License", ("Common Development and Distribution License",)),
    Template("odbl", "This database is made available under the Open Database License", ("Open Database License",)),
    Template("ofl", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ("SIL Open Font License",)),
    Template("lppl", "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License", ("LaTeX Project Public License",)),
    Template("ms-pl", "This source is subject to the Microsoft Public License", ("Microsoft Public License",)),
    Template("ncsa", "University of Illinois/NCSA Open Source License", ("NCSA Open Source License",)),
    Template("cc-by", "Licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    Template("cc-by", "Licensed under CC BY 4.0", ("CC BY 4.0",)),
    Template("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution-ShareAlike",)),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0", ("CC BY-SA",)),
    Template("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution-NonCommercial",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    Template("cc-by-nd", "Licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", ("Creative Commons Attribution-NoDerivatives",)),
    Template("cc-by-nd", "Licensed under CC BY-ND 4.0", ("CC BY-ND",)),
    Template("cc0", "Licensed under CC0 1.0 Universal", ("CC0 1.0",)),
)


@dataclass(frozen=True)
class Entry:
    """A template in words, with the place of each mandatory phrase."""

    label: str
    base: bool
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]


def entries(templates=TEMPLATES) -> list[Entry]:
    """The base phrases and ``templates`` in words; a phrase that its template lacks is refused."""
    found = []
    for label, text, keys, base in [(b, p, (p,), True) for p, b in BASE] + [(t.label, t.text, t.keys, False) for t in templates]:
        words, placed = words_of(text), []
        for key in map(words_of, keys):
            at = next((i for i in range(len(words)) if key and words[i : i + len(key)] == key), None)
            if at is None:
                raise ValueError(f"template {label!r} lacks its phrase {' '.join(key)!r}")
            placed.append((at, tuple(key)))
        if not placed:
            raise ValueError(f"template {label!r} has no mandatory phrase")
        found.append(Entry(label, base, tuple(words), tuple(placed)))
    return found


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def _words() -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), use)[0]


def _matches(found: list[Entry], anchors: dict[int, list[str]]) -> Column:
    """Verified places of all templates in ``words``."""
    postings: dict[str, list[Column]] = {}
    for t, e in enumerate(found):
        for p, w in enumerate(e.words):
            if w in anchors[t]:
                postings.setdefault(w, []).append(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")))
    index = F.create_map(*(c for w, places in postings.items() for c in (F.lit(w), F.array(*places))))
    # Mandatory places alone are sure to be in place, so only they count for what must agree.
    need = F.array(*(F.lit(min(2, len({at + i for at, k in e.keys for i, w in enumerate(k) if w in anchors[t]}))) for t, e in enumerate(found)))
    keys = F.array(*(F.array(*(F.struct(F.lit(at).alias("at"), _strings(k).alias("k")) for at, k in e.keys)) for e in found))
    texts, labels, base = F.array(*(_strings(e.words) for e in found)), _strings(e.label for e in found), F.array(*(F.lit(e.base) for e in found))
    words = F.col("words")

    indexed = _once(F.array_intersect("present", _strings(sorted(postings))), lambda own: F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(own, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull()))
    starts = F.array_sort(F.flatten(F.transform(indexed, lambda x: F.transform(index[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["p"]).alias("o"))))))
    # In the sorted starts equal ones stand next to each other, so one look back tells whether two words
    # agree on a start, and one more whether it has been taken already.
    def taken(s: Column):
        def once(x: Column, j: Column) -> Column:
            second = (j > 0) & (x == F.get(s, j - 1))
            return F.when(F.get(need, x["t"]) < 2, ~second).otherwise(second & ~((j > 1) & (x == F.get(s, j - 2))))

        return F.filter(s, lambda x, j: F.coalesce(once(x, j), F.lit(False)))

    agreed = _once(starts, taken)

    def in_place(x: Column) -> Column:
        return F.forall(F.get(keys, x["t"]), lambda k: (x["o"] + k["at"] >= 0) & (F.slice(words, F.greatest(x["o"] + k["at"] + 1, F.lit(1)), F.size(k["k"])) == k["k"]))

    def described(x: Column) -> Column:
        text = F.get(texts, x["t"])
        held = F.size(F.filter(text, lambda w, p: F.coalesce(F.get(words, x["o"] + p) == w, F.lit(False)))) / F.size(text)
        return F.struct(F.get(labels, x["t"]).alias("label"), x["o"].alias("offset"), held.alias("share"), F.get(base, x["t"]).alias("base"))

    return F.transform(F.filter(agreed, in_place), described)


def scan(docs: DataFrame, templates=TEMPLATES, anchors: int = ANCHORS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, base (array of label and start), matches (array of
    label, offset, share).

    ``share`` is the part of a template's words that stand in place; a file may match any number of
    templates, any number of times; one base phrase may stand in several places.  Null text counts as
    empty and matches nothing; repeated rows come out alike; a doc_id may be null; other columns are
    ignored.  A start before the text's first word is possible where the words missing there are not
    mandatory.
    """
    found = entries(templates)
    phrases = {frozenset(w for _, k in e.keys for w in k) for e in found}
    vocab = sorted(set().union(*phrases))
    first = docs.select("doc_id", _words().alias("words"))
    first = first.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _strings(vocab)).alias("present"), "words")
    # A text that holds all words of no template's mandatory phrases can match nothing, so its words go.
    least = sorted(sorted(p) for p in phrases if not any(other < p for other in phrases))
    may = F.exists(F.array(*map(_strings, least)), lambda p: F.size(F.array_except(p, "present")) == 0)
    first = materialize(first.withColumn("words", F.when(may, F.col("words"))), "licence-words")
    row = first.agg(F.count("*").alias("total"), *(F.count_if(F.array_contains("present", w)).alias(f"w{i}") for i, w in enumerate(vocab))).first()
    idf = {w: math.log(1 + (row["total"] - row[f"w{i}"] + 0.5) / (row[f"w{i}"] + 0.5)) for i, w in enumerate(vocab)}

    rarest = {t: sorted({w for _, k in e.keys for w in k}, key=lambda w: (-idf[w], w))[:anchors] for t, e in enumerate(found)}
    placed = F.when(F.col("words").isNotNull(), _matches(found, rarest))
    out = first.select("doc_id", "n_words", F.coalesce(placed, F.array()).alias("m"))
    base = F.array_sort(F.transform(F.filter("m", lambda x: x["base"]), lambda x: F.struct(x["offset"].alias("start"), x["label"])))
    own = F.transform(F.filter("m", lambda x: ~x["base"]), lambda x: F.struct(x["label"], x["offset"], x["share"]))
    return out.select("doc_id", "n_words", base.alias("base"), own.alias("matches"))


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    line = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    share = F.array_max(F.transform("matches", lambda x: x["share"]))
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        line(labels("base")).alias("base_labels"),
        line(F.concat(labels("base"), labels("matches"))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, BASE_SCORE).otherwise(0.0), F.coalesce(share, F.lit(0.0))).alias("score"),
    )
