"""License scan by a positional rare-token index, in built-in functions only.

The templates below are licence notices, their short forms and tags. A word's IDF is taken over all documents of the
corpus, in a first pass that counts the templates' words only (a table of a few hundred rows). The index holds, for each
template, the postings (template, position) of its two rarest words, taken from its key phrase.

A file looks up the index's words that it holds, rarest first. Each occurrence gives the starts that its postings allow;
the starts of a template's rarest word are intersected with those of its second one, so only alignments that both agree on
are left. There the key phrase has to stand word by word; the score is the IDF-weighted share of the template's words that
stand within ``SLACK`` words of their place, so a notice with a word more or less is still found. An alignment may start
before the text: a file that begins in the midst of a notice lacks the words before.

Nothing but the counts is shuffled, and the scan happens inside one row; the index has a fixed size and is part of the plan.

Defined edge cases: a null text counts as empty: zero words, no label, score 0; null ids, repeated rows and other
columns do no harm; overlapping or repeated notices are all found; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import alnum_words

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, notice, key phrase.
TEMPLATES = [
    ("apache-2.0", "apache license version 2 0", "apache license version 2 0"),
    ("apache-2.0", "licensed under apache 2 0", "apache 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "the mit license mit", "mit license mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions"),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "gnu gpl v3", "gnu gpl v3"),
    ("gpl-2.0", "gnu gpl v2", "gnu gpl v2"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    ("lgpl-2.1", "gnu lesser general public license version 2 1", "lesser general public license version 2 1"),
    ("lgpl-2.1", "gnu lgpl v2 1", "gnu lgpl v2 1"),
    ("lgpl-3.0", "gnu lesser general public license version 3", "lesser general public license version 3"),
    ("agpl-3.0", "gnu affero general public license version 3", "affero general public license version 3"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "bsd 3 clause license", "bsd 3 clause license"),
    ("bsd-2-clause", "bsd 2 clause license", "bsd 2 clause license"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable"),
    ("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc0-1.0", "dedicated to the public domain under creative commons cc0 1 0 universal", "cc0 1 0 universal"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0", "creative commons attribution sharealike 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial 4 0"),
]
#: Names of licences in tags ("SPDX-License-Identifier: MIT"); each makes a template.
TAGS = "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 MPL-2.0 BSD-2-Clause BSD-3-Clause ISC EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense Zlib".split()
TEMPLATES += [(tag.lower(), f"spdx license identifier {words}", f"license identifier {words}") for tag in TAGS for words in [tag.lower().replace("-", " ").replace(".", " ")]]
SLACK = 2
MIN_SCORE = 0.75


def key_place(notice: str, key: str) -> int:
    """The key phrase's first word, counted from 0."""
    if f" {key} " not in f" {notice} ":
        raise ValueError(f"the notice lacks its key phrase: {key}")
    return len(f" {notice} "[: f" {notice} ".index(f" {key} ")].split())


def corpus_idf(docs: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES) -> dict[str, float]:
    """1 + ln((documents + 1) / (those with the word + 1)) of each word of the templates, rounded to 9 digits."""
    vocabulary = sorted({w for _, notice, _ in templates for w in notice.split()})
    held = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(F.lit(vocabulary), alnum_words(F.col(text))))).alias("w"))
    n = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}  # at most one row for each word of the templates
    return {w: round(1 + math.log((n.get("", 0) + 1) / (n.get(w, 0) + 1)), 9) for w in vocabulary}


def anchors(idf: dict[str, float], notice: str, key: str) -> list[tuple[str, int]]:
    """(word, position in the notice) of the key phrase's two rarest words, at their first places."""
    lead, parts = key_place(notice, key), key.split()
    rarest = sorted(set(parts), key=lambda w: (-idf[w], w))[:2]
    return [(w, lead + parts.index(w)) for w in rarest]


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    return F.when(
        F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(f" {phrase} ")),
        F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(parts)])),
    ).otherwise(F.array().cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] = TEMPLATES, min_score: float = MIN_SCORE, idf: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of ``docs``."""
    idf = corpus_idf(docs, text, templates) if idf is None else idf
    postings: dict[str, list[tuple[int, int, int]]] = {}  # word -> (rank, template, position)
    for t, (_, notice, key) in enumerate(templates):
        found = anchors(idf, notice, key)
        for rank in (0, 1):
            word, at = found[min(rank, len(found) - 1)]
            postings.setdefault(word, []).append((rank, t, at))
    vocabulary = F.lit(sorted(postings, key=lambda w: (-idf[w], w)))
    t = F.coalesce(F.col(text), F.lit(""))
    first = docs.select(F.col(doc_id).alias("doc_id"), alnum_words(t).alias("w"))
    w = F.col("w")
    looked = first.select(
        "doc_id", "w", F.size("w").cast("long").alias("n_words"), F.array_intersect(vocabulary, w).alias("rare"),
        F.array_contains(w, "public").alias("has_public"), F.array_contains(w, "by").alias("has_by"), F.array_contains(w, "reserved").alias("has_reserved"),
    )
    hint = {"cc by": "has_by", "general public license": "has_public", "all rights reserved": "has_reserved"}
    none = F.array().cast("array<int>")
    starts = [F.when(F.col(hint[p]), _phrase_starts(w, p)).otherwise(none).alias(f"s{k}") for k, p in enumerate(BASE)]
    placed = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains("rare", x), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    spots = looked.select("doc_id", "n_words", *starts, "w", F.when(F.size("rare") > 0, placed).alias("o"))

    def allowed(rank: int) -> Column:
        """Alignments that the occurrences of the templates' words of this rank allow."""
        rows = [(word, [(t, at) for r, t, at in ps if r == rank]) for word, ps in sorted(postings.items())]
        posted = F.create_map(*[x for word, ps in rows if ps for x in (F.lit(word), F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("p")) for a, b in ps]))])
        return F.flatten(F.filter(F.transform("o", lambda o: F.transform(F.element_at(posted, o["w"]), lambda p: F.struct(p["t"].alias("t"), (o["i"] - p["p"]).alias("s")))), lambda x: x.isNotNull()))

    aligned = spots.select("doc_id", "n_words", *[f"s{k}" for k in range(len(BASE))], "w", F.array_intersect(allowed(0), allowed(1)).alias("v"))
    whole = [sum(idf[x] for x in notice.split()) for _, notice, _ in templates]
    told = F.create_map(*[
        x for t, (label, notice, key) in enumerate(templates)
        for x in (F.lit(t), F.struct(F.lit(label).alias("label"), F.lit(key_place(notice, key)).alias("lead"), F.lit(key.split()).alias("key"), F.array(*[F.struct(F.lit(x).alias("w"), F.lit(idf[x] / whole[t]).alias("weight")) for x in notice.split()]).alias("notice")))
    ])

    def verified(v: Column) -> Column:
        of = F.element_at(told, v["t"])
        begin = v["s"] + of["lead"]
        stands = (begin >= 0) & (F.slice(w, F.greatest(begin, F.lit(0)) + 1, F.size(of["key"])) == of["key"])

        def weight(x: Column, j: Column) -> Column:
            low, high = F.greatest(v["s"] + j - SLACK, F.lit(0)), v["s"] + j + SLACK
            return F.when(F.array_contains(F.slice(w, low + 1, F.greatest(high - low + 1, F.lit(0))), x["w"]), x["weight"]).otherwise(0.0)

        score = F.aggregate(F.transform(of["notice"], weight), F.lit(0.0), lambda a, x: a + x)
        return F.when(stands, F.struct(of["label"].alias("label"), F.least(F.lit(1.0), F.round(score, 6)).alias("score")))

    found = F.filter(F.transform("v", verified), lambda m: m.isNotNull() & (m["score"] >= min_score))
    judged = aligned.select("doc_id", "n_words", *[f"s{k}" for k in range(len(BASE))], F.coalesce(found, F.array().cast("array<struct<label:string,score:double>>")).alias("m"))
    every = F.concat(*[F.col(f"s{k}") for k in range(len(BASE))])
    base = F.array_compact(F.array(*[F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values())]))
    best = F.coalesce(F.array_max(F.transform("m", lambda m: m["score"])), F.lit(0.0))
    return judged.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("m", lambda m: m["label"])))), ",").alias("labels"),
        F.when(F.size(every) > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op2_license_scan(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs)
