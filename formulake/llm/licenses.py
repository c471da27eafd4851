"""License scans: a positional index of rare words over licence templates. DataFrame functions only.

Templates are passages of licence texts and notices: key phrases that must
stand, with gaps of so many words between them. Words of key phrases are counted
over all documents; a template's three rarest (highest IDF) are its index
entries, with their positions. Each file's occurrences of such words are looked
up; an occurrence at p of a template word at q puts the template's start at
p - q. Starts on which all postings agree are verified by the key phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and labels whose places are counted. Fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further licences: label, and the template's key phrases in order, with the number of words between two of them. In the words of the public texts and notices. Fixed values.
LICENSES = {
    "agpl": ["gnu affero general public license"],
    "apache-2.0": ["apache license version 2 0"],
    "apache-2.0-notice": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"],
    "apache-2.0-text": ["each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"],
    "artistic-2.0": ["artistic license 2 0"],
    "boost-1.0": ["boost software license"],
    "boost-1.0-text": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "bsd": ["redistribution and use in source and binary forms", 4, "are permitted provided that the following conditions are met"],
    "bsd-2-text": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0, "redistributions in binary form must reproduce the above copyright notice"],
    "bsd-3-text": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-notice": ["bsd license"],
    "cc-by-4.0": ["cc by 4 0"],
    "cc-by-nc": ["cc by nc"],
    "cc-by-nd": ["cc by nd"],
    "cc-by-sa": ["cc by sa"],
    "cc-attribution": ["creative commons attribution"],
    "cc0": ["cc0 1 0"],
    "cc0-text": ["the person who associated a work with this deed has dedicated the work to the public domain"],
    "epl": ["eclipse public license"],
    "eupl": ["european union public licence"],
    "gfdl": ["gnu free documentation license"],
    "gfdl-notice": ["permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"],
    "gpl-2.0": ["general public license version 2"],
    "gpl-3.0": ["general public license version 3"],
    "gpl-notice": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu lesser general public license"],
    "lgpl-notice": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"],
    "mit": ["mit license"],
    "mit-text": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 7, "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "mpl": ["mozilla public license"],
    "mpl-2.0-notice": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["proprietary and confidential"],
    "public-domain": ["dedicated to the public domain"],
    "unlicense": ["free and unencumbered software released into the public domain"],
    "unlicense-text": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"],
    "zlib": ["this software is provided as is without any express or implied warranty", 0, "in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-text": ["altered source versions must be plainly marked as such and must not be misrepresented as being the original software"],
}

#: Index entries of a template.
RAREST = 3


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    #: (place, words) of each key phrase.
    keys: tuple[tuple[int, tuple[str, ...]], ...]

    @property
    def length(self) -> int:
        return self.keys[-1][0] + len(self.keys[-1][1])

    @property
    def words(self) -> list[tuple[int, str]]:
        """(place, word) of all words of key phrases."""
        return [(at + i, w) for at, own in self.keys for i, w in enumerate(own)]


def templates() -> list[Template]:
    out = []
    for base, own in ((True, {label: [phrase] for phrase, label in BASE.items()}), (False, LICENSES)):
        for label, parts in own.items():
            keys, at = [], 0
            for part in parts:
                if isinstance(part, int):
                    at += part
                else:
                    words = tuple(re.findall(WORD, part))
                    keys.append((at, words))
                    at += len(words)
            out.append(Template(label, base, tuple(keys)))
    return out


# A-Z and what is no part of a word, and what they become: cutting at single spaces costs a third of matching a pattern.
_FROM = "".join(chr(c) for c in range(128) if not re.match("[0-9a-z]", chr(c)))
_TO = "".join(c.lower() if c.isalpha() else " " for c in _FROM)


def _words(text_col: str) -> Column:
    """Lower-cased (A-Z only) words, those of ``WORD``, in order."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), _FROM, _TO), " "), "")


def _literal(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def document_frequency(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """In how many rows each template word occurs: one row a word, summed in each task first."""
    vocabulary = sorted({w for t in templates() for _, w in t.words})
    found = docs.select(F.explode(F.array_intersect(_words(text_col), _literal(vocabulary))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null texts count as empty: no words, no labels, score 0. Null ids and
    repeated rows give a row each; an empty table gives none; texts of any
    length are read whole. ``score`` is 1 - 0.5 ** (number of labels).
    """
    frequency = document_frequency(docs, text_col)
    # A template can stand only where all its words do: those with a word that no row has are left out.
    live = [t for t in templates() if all(frequency.get(w) for _, w in t.words)]
    # Index entries: a template's rarest words; ties by the later place.
    entries = [sorted(t.words, key=lambda x: (frequency[x[1]], -x[0]))[:RAREST] for t in live]
    rows = docs.select(F.col(id_col).alias("__id"), _words(text_col).alias("__w")).withColumn("n_words", F.size("__w").cast("long"))
    no_hits, no_words = F.expr("CAST(array() AS array<struct<t: int, at: int>>)"), F.expr("CAST(array() AS array<struct<w: string, i: int>>)")
    if not live:
        rows = rows.withColumn("__rare", no_words).withColumn("__hits", no_hits)
    else:
        first = sorted({own[0][1] for own in entries})
        wanted = sorted({w for own in entries for _, w in own})
        rare = F.filter(F.transform("__w", lambda w, i: F.when(w.isin(*wanted), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
        rows = rows.withColumn("__rare", F.when(F.arrays_overlap("__w", _literal(first)), rare).otherwise(no_words))
        hits = [_starts(t, own, k) for k, (t, own) in enumerate(zip(live, entries, strict=True))]
        rows = rows.withColumn("__hits", F.when(F.size("__rare") > 0, F.concat(*hits)).otherwise(no_hits))
    base = [k for k, t in enumerate(live) if t.base]
    rows = rows.withColumn("__base", F.filter("__hits", lambda h: h["t"].isin(*base) if base else F.lit(False)))
    at = F.transform("__base", lambda h: h["at"].cast("long"))
    names = _literal([t.label for t in live]) if live else F.expr("CAST(array() AS array<string>)")
    labels = lambda hits: F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.element_at(names, h["t"] + 1))))
    rows = rows.withColumn("__labels", labels("__hits"))
    return rows.select(
        F.col("__id").alias(id_col), "n_words", F.size("__base").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(labels("__base"), ",").alias("base_labels"), F.array_join("__labels", ",").alias("labels"), (F.lit(1.0) - F.pow(F.lit(0.5), F.size("__labels"))).alias("score"),
    )


def _starts(t: Template, entries: list[tuple[int, str]], k: int) -> Column:
    """(template, start) of each place where all the template's postings agree and its key phrases stand."""

    def posted(q: int, word: str) -> Column:
        return F.transform(F.filter("__rare", lambda x: (x["w"] == word) & (x["i"] >= q)), lambda x: x["i"] - q)

    start = F.array_distinct(posted(*entries[0]))
    for q, word in entries[1:]:
        start = F.array_intersect(start, posted(q, word))

    def stands(s: Column) -> Column:
        ok = s + t.length <= F.size("__w")
        for at, own in t.keys:
            if not {(at + i, w) for i, w in enumerate(own)} <= set(entries):  # the postings show short ones
                ok = ok & (F.slice("__w", s + (at + 1), F.lit(len(own))) == _literal(own))
        return ok

    return F.transform(F.filter(start, stands), lambda s: F.struct(F.lit(k).alias("t"), s.cast("int").alias("at")))
