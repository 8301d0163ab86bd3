"""License scan by a positional index of rare words, in DataFrame expressions only.

A template is a notice as words; the phrases in brackets are mandatory. The index has postings for the
``RARE`` words of each notice that the fewest of all documents have: the notice's number and the word's place in
it. A file looks up those of its words that are in the index. A word's place less its place in the notice
is where the notice would begin; beginnings on which at least ``AGREE`` postings of a notice meet are candidates,
and the mandatory phrases are verified there, each at its own place.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import ASCII_UPPER, fresh

#: A word of a license text: letters and digits, and everything beyond ASCII.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a notice in the index, and how many of them must agree on where it begins.
RARE, AGREE = 6, 2


class Template(NamedTuple):
    label: str
    base: bool
    #: Words in lower case, the mandatory ones in brackets.
    notice: str

    @property
    def words(self) -> list[str]:
        return self.notice.replace("[", "").replace("]", "").split()

    @property
    def must(self) -> list[bool]:
        """Whether each word is mandatory."""
        out, inside = [], False
        for w in self.notice.split():
            inside = inside or w.startswith("[")
            out.append(inside)
            inside = inside and not w.endswith("]")
        return out


#: Their mandatory phrases are the places that are counted. So that such a phrase alone is a candidate, at most
#: ``RARE - AGREE`` words stand around it.
BASE = (
    Template("mit", True, "released [under the mit license]"),
    Template("apache-2", True, "licensed under the [apache license version 2] 0"),
    Template("cc-by-nc", True, "licensed under [cc by nc] 4 0"),
)
#: Notices as they stand in files: headers, first sentences and titles.
NOTICES = (
    ("mit", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the [apache license version 2] 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "under the terms of the [gnu general public license] as published by the free software foundation either [version 3] of the license or at your option any later version"),
    ("gpl-2", "under the terms of the [gnu general public license] as published by the free software foundation either [version 2] of the license or at your option any later version"),
    ("gpl-3", "under the terms of the [gnu general public license version 3] as published by the free software foundation"),
    ("gpl-2", "under the terms of the [gnu general public license version 2] as published by the free software foundation"),
    ("lgpl", "under the terms of the [gnu lesser general public license] as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl-3", "under the terms of the [gnu affero general public license] as published by the free software foundation either [version 3] of the license or at your option any later version"),
    ("bsd", "[redistribution and use in source and binary forms with or without modification] are permitted provided that the following conditions are met"),
    ("bsd", "use of this source code is [governed by a bsd style license] that can be found in the license file"),
    ("mpl-2", "this source code form is subject to the terms of the [mozilla public license v 2] 0 if a copy of the mpl was not distributed with this file"),
    ("epl-2", "are made available under the terms of the [eclipse public license v 2] 0 which is available at"),
    ("isc", "permission to [use copy modify and or distribute this software for any purpose] with or without fee is hereby granted"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
    ("cc-by", "[creative commons attribution 4 0] international license"),
    ("cc-by-sa", "[creative commons attribution sharealike 4 0] international license"),
    ("cc-by-nd", "[creative commons attribution noderivatives 4 0] international license"),
    ("cc-by-nc", "[creative commons attribution noncommercial 4 0] international license"),
    ("cc-by-nc-sa", "[creative commons attribution noncommercial sharealike 4 0] international license"),
    ("cc-by-nc-nd", "[creative commons attribution noncommercial noderivatives 4 0] international license"),
    ("cc0", "[creative commons cc0] 1 0 universal public domain dedication"),
    ("cc0", "released under [cc0 1 0] universal"),
    ("proprietary", "copyright [all rights reserved]"),
)
#: Names by which a sentence puts something under a license.
NAMES = (
    ("gpl-3", "gnu general public license version 3"), ("gpl-3", "gnu gpl version 3"), ("gpl-3", "gnu gplv3"),
    ("gpl-2", "gnu general public license version 2"), ("gpl-2", "gnu gpl version 2"), ("gpl-2", "gnu gplv2"),
    ("lgpl", "gnu lesser general public license"), ("agpl-3", "gnu affero general public license"),
    ("apache-2", "apache license 2 0"), ("bsd", "bsd license"), ("bsd", "2 clause bsd license"), ("bsd", "3 clause bsd license"),
    ("mpl-2", "mozilla public license version 2"), ("mpl-2", "mozilla public license 2 0"),
    ("epl-2", "eclipse public license version 2"), ("epl-2", "eclipse public license 2 0"),
    ("isc", "isc license"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nd", "cc by nd 4 0"),
)
#: Identifiers of the SPDX list, as words; those that begin alike go on differently.
SPDX = (
    ("mit", "mit"), ("apache-2", "apache 2 0"), ("gpl-3", "gpl 3 0"), ("gpl-2", "gpl 2 0"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"),
    ("agpl-3", "agpl 3 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("mpl-2", "mpl 2 0"), ("epl-2", "epl 2 0"), ("isc", "isc"),
    ("unlicense", "unlicense"), ("cc0", "cc0 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc-by-nd", "cc by nd 4 0"),
    ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nc-sa", "cc by nc sa 4 0"), ("cc-by-nc-nd", "cc by nc nd 4 0"),
)
TEMPLATES = (
    *BASE,
    *(Template(label, False, notice) for label, notice in NOTICES),
    *(Template(label, False, f"licensed under the [{name}]") for label, name in NAMES),
    *(Template(label, False, f"[spdx license identifier {name}]") for label, name in SPDX),
)


def license_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for a null."""
    lower = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())
    return F.regexp_extract_all(lower, F.lit(LICENSE_WORD), F.lit(0))


def document_frequency(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many of all documents each word of the templates occurs."""
    words = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_intersect(license_words(F.col(text)), F.array(*map(F.lit, words)))).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: counts.get(w, 0) for w in words}


def rare_words(template: Template, frequency: dict[str, int]) -> dict[str, int]:
    """The notice's words of the highest inverse document frequency, with their first places in it. What no
    document has is of no use and comes last."""
    words = template.words
    return {w: words.index(w) for w in sorted(set(words), key=lambda w: (frequency[w] == 0, frequency[w], w))[:RARE]}


#: A beginning of notice t at place b of a file is the number t * _NOTICE + b + _BEFORE: beginnings of a notice
#: lie together when sorted, and one before the file's first word is a number, too.
_NOTICE, _BEFORE = 1 << 40, 1 << 20


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once a row."""
    return F.get(F.transform(F.array(value), then), 0)


def _notices(templates: tuple[Template, ...]) -> Column:
    return F.array(*(
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*(F.lit(i) for i, m in enumerate(t.must) if m)).alias("must"),
        )
        for t in templates
    ))


def _matches(words: Column, present: Column, postings: Column, notices: Column) -> Column:
    """The verified notices of a file, from its words that are in the index."""
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(present, F.get(words, i)))
    met = F.flatten(F.transform(hits, lambda i: F.transform(postings[F.get(words, i)], lambda p: p + i)))

    def agreed(x: Column) -> Column:
        """Numbers that stand ``AGREE`` times or more in a sorted array, once each."""
        at = F.sequence(F.lit(0), F.size(x) - 1)
        first = F.filter(at, lambda i: (F.get(x, i + AGREE - 1) == F.get(x, i)) & ((i == 0) | (F.get(x, i - 1) != F.get(x, i))))
        return F.when(F.size(x) > 0, F.transform(first, lambda i: F.get(x, i)))

    def verified(number: Column) -> Column:
        place = (number % _NOTICE).cast("int") - _BEFORE

        def look(t: Column) -> Column:
            here = lambda i: F.coalesce(F.get(words, place + i) == F.get(t["words"], i), F.lit(False))
            equal = F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), here)
            share = F.size(equal) / F.size(t["words"])
            found = F.struct(t["label"].alias("label"), t["base"].alias("base"), (place + F.get(t["must"], 0)).alias("place"), share.alias("share"))
            return F.when(F.forall(t["must"], here), found)

        return _let(F.get(notices, F.shiftright(number, 40).cast("int")), look)

    return F.array_compact(F.transform(_let(F.sort_array(met), agreed), verified))


def scan_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Places are word numbers from 0. ``n_base`` counts all places of mandatory phrases of base templates,
    overlapping ones too, ``first_word`` and ``last_word`` are the smallest and largest. Labels are
    distinct, sorted and joined by commas, empty without any. ``score`` is the largest share of a
    verified notice's words that stand at their places, 0 without one. A null text counts as empty.
    Repeated rows are scanned alike, and notices that tie are all found. Empty input: no rows. Columns that
    clash with the names above are prefixed. Two passes over the texts and no shuffle of them.
    """
    for t in templates:
        if not any(t.must) or len(set(t.words)) < AGREE:
            raise ValueError(f"a notice needs a mandatory phrase and {AGREE} words: {t.notice}")
        if t.base and len(set(t.words)) - len({w for w, m in zip(t.words, t.must, strict=True) if m}) > RARE - AGREE:
            raise ValueError(f"too many words around the phrase of a base template: {t.notice}")
    frequency = document_frequency(docs, text, templates)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    taken = {c.lower() for c in docs.columns} & set(names)
    found, *_ = fresh(docs, "found")
    postings: dict[str, list[int]] = {}
    for number, t in enumerate(templates):
        for word, at in rare_words(t, frequency).items():
            postings.setdefault(word, []).append(number * _NOTICE + _BEFORE - at)
    index = F.map_from_arrays(F.array(*map(F.lit, postings)), F.array(*(F.array(*(F.lit(p).cast("long") for p in ps)) for ps in postings.values())))
    indexed = F.array(*map(F.lit, postings))

    def scan(words: Column) -> Column:
        return _let(F.array_intersect(words, indexed), lambda present: F.struct(
            F.size(words).cast("long").alias("n"),
            F.when(F.size(present) >= AGREE, _matches(words, present, index, _notices(templates))).alias("m"),
        ))

    kept = docs.select(*[F.col(c).alias(f"_{c}") if c.lower() in taken else F.col(c) for c in docs.columns])
    scanned = kept.withColumn(found, _let(license_words(F.col(f"_{text}" if text.lower() in taken else text)), scan))
    none = F.from_json(F.lit("[]"), "array<struct<label:string,base:boolean,place:int,share:double>>")
    every = F.coalesce(F.col(f"{found}.m"), none)
    base = F.filter(every, lambda m: m["base"])

    def joined(ms: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")

    return scanned.withColumns({
        "n_words": F.col(f"{found}.n"), "n_base": F.size(base).cast("long"),
        "first_word": F.array_min(F.transform(base, lambda m: m["place"])).cast("long"),
        "last_word": F.array_max(F.transform(base, lambda m: m["place"])).cast("long"),
        "base_labels": joined(base), "labels": joined(every),
        "score": F.coalesce(F.array_max(F.transform(every, lambda m: m["share"])), F.lit(0.0)),
    }).drop(found)


#: The same by joins of rows: words of documents with words of notices.
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'), '{LICENSE_WORD}') AS w
  FROM documents
), notices (t, label, base, words, must) AS (VALUES
  {", ".join(f"({i}, '{t.label}', {t.base}, '{' '.join(t.words)}', '{''.join('01'[m] for m in t.must)}')" for i, t in enumerate(TEMPLATES))}
), parts AS (
  SELECT t, unnest(string_split(words, ' ')) AS word, unnest(range(len(string_split(words, ' ')))) AS pos, unnest(string_split(must, '')) = '1' AS must
  FROM notices
), every AS (
  SELECT r, unnest(w) AS word, unnest(range(len(w))) AS place FROM d
), hits AS (
  SELECT * FROM every WHERE word IN (SELECT word FROM parts)
), frequency AS (
  SELECT word, count(DISTINCT r) AS n FROM hits GROUP BY word
), firsts AS (
  SELECT t, word, min(pos) AS pos FROM parts GROUP BY t, word
), rare AS (
  SELECT t, word, pos FROM firsts LEFT JOIN frequency USING (word)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY n IS NULL, n, word) <= {RARE}
), candidates AS (
  SELECT r, t, place - pos AS b FROM hits JOIN rare USING (word) GROUP BY r, t, b HAVING count(*) >= {AGREE}
), standing AS (
  SELECT c.r, c.t, c.b, count(*) AS equal, count(*) FILTER (p.must) AS musts
  FROM candidates c JOIN parts p ON p.t = c.t JOIN hits h ON h.r = c.r AND h.place = c.b + p.pos AND h.word = p.word
  GROUP BY c.r, c.t, c.b
), sizes AS (
  SELECT t, count(*) AS size, count(*) FILTER (must) AS musts, min(pos) FILTER (must) AS start FROM parts GROUP BY t
), matches AS (
  SELECT r, label, base, b + start AS p, equal / size AS share FROM standing JOIN sizes USING (t, musts) JOIN notices USING (t)
), summed AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(p) FILTER (base) AS first_word, max(p) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM matches GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN summed USING (r)
"""
