"""License scan by a positional index of rare licence words, in DataFrame expressions alone.

Every licence notice is a template of words. Its rarest words, by inverse document frequency over
the templates, are its postings: (word, template, position). A file's rare licence words are looked
up in the postings; each occurrence votes for (template, file position - template position). Where
enough votes agree on one start, the template's mandatory key phrase must stand at its place too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is no part of a word, after A-Z became a-z; and the same before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A file without any of these has no phrase and no key phrase. Each phrase and key phrase has a
#: word with one of them, so what stands between words does not matter.
TRIGGER = "licen|permission|redistribution|domain"
#: Phrases of the base labels: label, words.
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
#: Licence notices: label, words of the template, mandatory key phrase.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit-notice", "released under the mit license", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version", "lesser general public license"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("cc-by-4.0", "licensed under cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "licensed under cc by nc 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "licensed under cc by nc sa 4 0"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "permission is granted to anyone to use this software for any purpose"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cddl-1.0", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("artistic-2.0", "released under the terms of the artistic license 2 0", "artistic license 2 0"),
    ("osl-3.0", "licensed under the open software license version 3 0", "open software license version 3 0"),
    ("cc0-1.0", "dedicated to the public domain under the creative commons cc0 1 0 universal public domain dedication", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
]
#: Share of a template's rarest words that are indexed, and share of these that must agree.
INDEXED, AGREE = 0.6, 0.6
#: Packs a template and a start into one long; starts may be a little below 0.
BIG, SHIFT = 1 << 40, 1 << 20


@dataclass
class Template:
    label: str
    key: list[str]
    key_at: int
    postings: list[tuple[str, int]]
    need: int


def templates() -> list[Template]:
    """The templates with their postings, by IDF over the templates (ties: the earlier position)."""
    words = [t.split() for _, t, _ in TEMPLATES]
    df: dict[str, int] = {}
    for w in words:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for (label, _, key), w in zip(TEMPLATES, words, strict=True):
        k = key.split()
        at = next(i for i in range(len(w)) if w[i : i + len(k)] == k)
        rare = sorted(range(len(w)), key=lambda i: (-math.log(len(words) / df[w[i]]), i))[: max(3, math.ceil(INDEXED * len(w)))]
        out.append(Template(label, k, at, [(w[i], i) for i in sorted(rare)], max(2, math.ceil(AGREE * len(rare)))))
    return out


def _array(items: list[Column]) -> Column:
    return F.array(*items)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of ``docs``.

    One scan without a shuffle; all work on a file is in its own row, and the index is a literal of
    fixed size. ``score`` is the largest share of a template's indexed words found in place; a file
    with base phrases alone has 0.5, one with neither 0. Null and empty texts have no words, null
    positions, empty label strings and score 0. Null and repeated doc_ids pass through.
    """
    index = templates()
    postings: dict[str, list[int]] = {}
    for t, template in enumerate(index):
        for word, at in template.postings:
            postings.setdefault(word, []).append(t * BIG + SHIFT - at)
    lookup = F.create_map(*(x for w, p in postings.items() for x in (F.lit(w), _array([F.lit(v).cast("long") for v in p]))))
    facts = _array(
        [F.struct(F.lit(t.label).alias("label"), F.lit(t.need).alias("need"), F.lit(len(t.postings)).alias("of"), F.lit(t.key_at).alias("at"), _array([F.lit(w) for w in t.key]).alias("key")) for t in index]
    )

    text = F.coalesce("text", F.lit(""))
    some = text.rlike(f"(?i){TRIGGER}")
    lowered = F.translate(text, UPPER, LOWER)
    empty = F.array().cast("array<string>")
    base = docs.select(
        "doc_id",
        F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"),
        F.when(some, F.regexp_extract_all(lowered, F.lit(f"({WORD})"), 1)).otherwise(empty).alias("words"),
    )
    words = F.col("words")

    def base_place(w: Column, i: Column) -> Column:
        """A phrase that ends at word i, as its start and label."""
        place = F.when(F.lit(False), F.struct(i.cast("long").alias("start"), F.lit("").alias("label")))
        for label, phrase in PHRASES.items():
            stands = w == phrase[-1]
            for back, word in enumerate(reversed(phrase[:-1]), 1):
                stands = stands & (F.get(words, i - back) == word)
            place = place.when(stands, F.struct((i - (len(phrase) - 1)).cast("long").alias("start"), F.lit(label).alias("label")))
        return place

    def votes(w: Column, i: Column) -> Column:
        """What an occurrence of an indexed word votes for."""
        return F.when(F.map_contains_key(lookup, w), F.transform(F.element_at(lookup, w), lambda v: v + i))

    located = base.select(
        "doc_id",
        "n_words",
        "words",
        F.array_compact(F.transform(words, base_place)).alias("places"),
        F.array_sort(F.flatten(F.array_compact(F.transform(words, votes)))).alias("votes"),
    )
    cast = F.col("votes")

    def matched(v: Column, i: Column) -> Column:
        """The first vote of a start that gets enough of them, if the key phrase stands there."""
        fact = F.get(facts, F.floor(v / BIG).cast("int"))
        start = (v % BIG - SHIFT).cast("int")
        agree = (F.get(cast, i + fact["need"] - 1) == v) & ((i == 0) | (F.get(cast, i - 1) != v))
        begin = start + fact["at"] + 1
        key = F.when(begin >= 1, F.slice(words, begin, F.size(fact["key"])) == fact["key"]).otherwise(False)
        share = F.size(F.filter(F.slice(cast, i + 1, fact["of"]), lambda x: x == v)) / fact["of"]
        return F.when(agree, F.when(key, F.struct(share.alias("share"), fact["label"].alias("label"))))

    found = located.select("doc_id", "n_words", "places", F.array_compact(F.transform(cast, matched)).alias("found"))
    label = lambda x: x["label"]
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    starts = F.transform("places", lambda x: x["start"])
    base_labels, own = F.transform("places", label), F.transform("found", label)
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.when(F.size("places") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        join(base_labels).alias("base_labels"),
        join(F.concat(base_labels, own)).alias("labels"),
        score.alias("score"),
    )


def oracle() -> str:
    """The same scan in SQL, for DuckDB, over ``documents``."""
    index = templates()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({q(w)}, {t}, {at})" for t, x in enumerate(index) for w, at in x.postings)
    facts = ", ".join(f"({t}, {q(x.label)}, {x.need}, {len(x.postings)}, {x.key_at}, [{', '.join(map(q, x.key))}])" for t, x in enumerate(index))
    return rf"""
WITH base AS (
  SELECT rowid_ AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)),
w AS (SELECT r, words, unnest(words) AS word, unnest(range(len(words))) AS i FROM base WHERE len(words) > 0),
places AS (
  SELECT r, i - 1 AS start, word_label AS label FROM (
    SELECT r, i, CASE WHEN words[i] = 'mit' THEN 'mit' WHEN words[i] = 'apache' THEN 'apache' END AS word_label FROM w WHERE word = 'license' AND i >= 1)
  WHERE word_label IS NOT NULL
  UNION ALL SELECT r, i - 2, 'gpl' FROM w WHERE word = 'license' AND i >= 2 AND words[i] = 'public' AND words[i - 1] = 'general'),
postings(word, t, pos) AS (VALUES {rows}),
facts(t, label, need, many, key_at, key) AS (VALUES {facts}),
votes AS (SELECT r, t, i - pos AS start, count(*) AS n FROM w JOIN postings USING (word) GROUP BY ALL),
found AS (
  SELECT v.r, label, n / many AS share FROM votes v JOIN facts f USING (t) JOIN base b ON b.r = v.r
  WHERE n >= need AND start + key_at >= 0 AND list_slice(words, start + key_at + 1, start + key_at + len(key)) = key),
p AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION ALL SELECT r, label FROM found) GROUP BY r),
s AS (SELECT r, max(share) AS share FROM found GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(share, CASE WHEN p.n > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM base LEFT JOIN p USING (r) LEFT JOIN l USING (r) LEFT JOIN s USING (r)
"""
