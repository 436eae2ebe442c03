"""Licence scans with a positional index of rare words, in DataFrame operations only.

Every template is the words of a licence text, or of a sentence that names a licence, with a mandatory key
phrase at a fixed place in it. The index has, for each template, postings (word, place in the phrase) of the
words of its key phrase. A file looks up the ``POSTINGS`` of them with the highest inverse document frequency,
counted over all files; each of their places in the file says where the phrase would start, and only starts
on which all these postings agree stay. There the key phrase is verified word by word, and the template's
other words, weighted by their inverse document frequency, give the coverage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sphaera.llm.common import WORD_ANY_CASE, ascii_lower


@dataclass(frozen=True)
class Template:
    """A licence text's words; those from key_at on, key_words of them, must all be there."""

    label: str
    words: tuple[str, ...]
    key_at: int
    key_words: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_at : self.key_at + self.key_words]


def _template(label: str, text: str, key: str, base: bool = False) -> Template:
    words, phrase = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, words, at, len(phrase), base)


#: How many postings of a key phrase are intersected.
POSTINGS = 2

TEMPLATES = (
    _template("mit", "released under the mit license", "mit license", base=True),
    _template("apache", "licensed under the apache license version 2 0", "apache license", base=True),
    _template("gpl", "licensed under the gnu general public license version", "general public license", base=True),
    _template("lgpl", "under the gnu lesser general public license version", "lesser general public license"),
    _template("agpl", "under the gnu affero general public license version", "affero general public license"),
    _template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    _template("epl", "made available under the eclipse public license", "eclipse public license"),
    _template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    _template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    _template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    _template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    _template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1"),
    # The texts of permissive licences; a key phrase is one that variants of the text share.
    _template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
        "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the software",
        "person obtaining a copy of this software",
    ),
    _template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
        "code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "use in source and binary forms",
    ),
    _template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "be used to endorse or promote products derived from this software"),
    _template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
        "permission notice appear in all copies",
        "distribute this software for any purpose with or without fee",
    ),
    _template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "the authors be held liable for any damages arising from the use"),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def document_frequencies(files: DataFrame, text: str, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many files each of the given words occurs, and the number of files. The driver gets one row a
    word, so as many as the templates have."""
    edge = WORD_ANY_CASE[:-1]
    pattern = f"(?<!{edge})(?i:{'|'.join(sorted(words))})(?!{edge})"
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), F.lower))
    rows = files.select(F.explode(F.concat(found, F.array(F.lit("")))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    return {w: counts.get(w, 0) for w in words}, counts.get("", 0)


def scan(files: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """files with n_words, places (array of label, base, start, words, coverage; start counts words from 0
    and is that of the key phrase, which has ``words`` words) and score, the best coverage (0 without any).

    Null and empty texts have no words and no places. Places may overlap; all of them are listed, in the
    order of the templates and then of the file. Columns of files named like a result are replaced; an empty
    table stays empty; repeated rows come back as they came. Very long texts are scanned whole, in a task that
    holds their words.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    counts, n_files = document_frequencies(files, text, vocabulary)
    idf = {w: math.log((n_files + 1) / (counts[w] + 0.5)) for w in vocabulary}
    # Places in the key phrase of its rarest words, the first of those on a tie.
    postings = [sorted(range(t.key_words), key=lambda i, t=t: (-idf[t.key[i]], i))[:POSTINGS] for t in templates]
    looked_up = sorted({t.key[a] for t, places in zip(templates, postings) for a in places})

    results = ("n_words", "places", "score")
    kept = [F.col(f"`{c}`") for c in files.columns if c not in results]
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_ANY_CASE), F.lit(0))
    out = files.select(*kept, words.alias("__words"))

    def word(i) -> Column:
        return F.get(F.col("__words"), i)

    def is_word(i, w: str) -> Column:
        return F.coalesce(ascii_lower(word(i)) == w, F.lit(False))

    n = F.size("__words")
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # lower() is a quick first look; is_word() compares exactly.
    out = out.withColumn("__hits", F.filter(index, lambda i: F.lower(word(i)).isin(looked_up)))

    def places(t: Template, at: list[int]) -> Column:
        agreed = None
        for a in at:
            starts = F.transform(F.filter("__hits", lambda i: is_word(i, t.key[a])), lambda i: i - a)  # noqa: B023
            agreed = starts if agreed is None else F.array_intersect(agreed, starts)

        def verified(s):
            ok = s >= 0
            for k, w in enumerate(t.key):
                if k not in at:
                    ok = ok & is_word(s + k, w)
            return ok

        total = sum(idf[w] for w in t.words) or 1.0
        expected = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(idf[w] / total).alias("weight"), F.lit(k - t.key_at).alias("k")) for k, w in enumerate(t.words)])

        def place(s):
            there = lambda e: (s + e["k"] >= 0) & F.coalesce(ascii_lower(word(F.greatest(s + e["k"], F.lit(0)))) == e["w"], F.lit(False))
            mass = F.aggregate(expected, F.lit(0.0), lambda m, e: m + F.when(there(e), e["weight"]).otherwise(0.0))
            return F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), s.alias("start"), F.lit(t.key_words).alias("words"),
                F.least(mass, F.lit(1.0)).alias("coverage"),
            )

        return F.transform(F.filter(agreed, verified), place)

    out = out.withColumn("places", F.concat(*[places(t, at) for t, at in zip(templates, postings)]))
    best = F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0))
    return out.select(*[F.col(f"`{c}`") for c in files.columns if c not in results], n.cast("long").alias("n_words"), "places", best.alias("score"))


def digest(found: DataFrame, id: str = "doc_id") -> DataFrame:
    """The result of scan() as one flat row a file."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform("base", lambda p: p["start"].cast("long"))
    last = F.array_max(F.transform("base", lambda p: (p["start"] + p["words"] - 1).cast("long")))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return found.withColumn("base", base).select(
        id, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), last.alias("last_end"), labels("base").alias("base_labels"), labels("places").alias("labels"), "score",
    )
