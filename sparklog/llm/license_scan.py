"""License scans by a positional rare-token index, all in DataFrame functions.

Templates are licence texts and notices, each with a mandatory key phrase. A first pass counts
in how many documents each licence word stands. The words of a key phrase with the highest
inverse document frequency are the template's index words; their postings are (template,
position). Each file's index words are looked up with their places; every place, less the
posting's position, is where the template would begin, and only beginnings on which all index
words of a template agree are kept. A place counts if the key phrase stands there word for
word. No text is shuffled: the second pass works inside each row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Words of a key phrase that are indexed.
INDEXED = 3
#: Label, licence text or notice, key phrase.
TEMPLATES = [
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software the software is provided
        as is without warranty of any kind express or implied""", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", """licensed under the apache license version 2 0 the license you may not use this file except in compliance
        with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
        warranties or conditions of any kind either express or implied""", "except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "creative commons attribution noncommercial"),
    ("cc-by-4", "creative commons attribution 4 0 international", "creative commons attribution 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation""", "under the terms of the gnu general public license"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer""", "redistribution and use in source and binary forms"),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies""", "use copy modify and or distribute this software"),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held
        liable for any damages arising from the use of this software""", "in no event will the authors be held liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
]
#: The phrases whose places are the base result.
BASE = ["under the mit license", "apache license version 2", "cc by nc"]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words: runs of a-z, 0-9 and characters beyond ASCII, A-Z lower-cased (null: none)."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _lit(xs: list) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def idf_of(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """Inverse document frequency, over all documents, of the words of a vocabulary. Only
    one row a vocabulary word reaches the driver."""
    seen = docs.select(F.explode(F.concat(F.array_intersect(words_of(F.col(text)), _lit(vocabulary)), _lit([""]))).alias("w"))
    df = {r.w: r.n for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df.get("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 0.5)) for w in vocabulary}


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, text: str = "text") -> DataFrame:
    """Adds n_words, places, base_places, base_labels, labels and score to docs.

    places: array of struct(start, label, template, phrase, coverage), one for each template
    at each place where its key phrase stands, start being the key phrase's first word; places
    that overlap all count. coverage is the IDF-weighted share of the template's words found at
    their positions. base_places: the distinct places of the base phrases. score: the largest
    coverage, 0 without a place. Of words of equal IDF the first in the phrase is indexed first.
    Null or empty texts have no words and no places; repeated rows are scanned alike. Columns
    of docs named like those added are replaced."""
    parts = [(label, notice.split(), key.split()) for label, notice, key in templates]
    idf = idf_of(docs, sorted({w for _, notice, _ in parts for w in notice}), text)
    rows, indexed = [], set()
    for k, (label, notice, key) in enumerate(parts):
        at = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        rare = sorted(range(at, at + len(key)), key=lambda i: (-idf[notice[i]], i))[:INDEXED]
        indexed |= {notice[i] for i in rare}
        rows.append(F.struct(
            F.lit(k).alias("template"), F.lit(label).alias("label"), F.lit(at).alias("at"), F.lit(" ".join(key)).alias("phrase"), _lit(key).alias("key"),
            F.array(*[F.struct(F.lit(notice[i]).alias("word"), F.lit(i).alias("pos")) for i in rare]).alias("index"),
            _lit(notice).alias("notice"), _lit([idf[w] for w in notice]).alias("idf"),
        ))
    lookup = _lit(sorted(indexed))
    df = docs.withColumn("_sparklog_w", words_of(F.col(text))).withColumn("n_words", F.size("_sparklog_w").cast("long"))
    w = F.col("_sparklog_w")
    hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(lookup, x), F.struct(x.alias("word"), i.alias("i")))), lambda h: h.isNotNull())
    df = df.withColumn("_sparklog_hit", F.when(F.arrays_overlap(w, lookup), hits).otherwise(F.array().cast("array<struct<word:string,i:int>>")))

    def begins(entry: Column) -> Column:
        """Where a template would begin by one of its index words."""
        return F.transform(F.filter("_sparklog_hit", lambda h: h["word"] == entry["word"]), lambda h: h["i"] - entry["pos"])

    def place(first: Column, p: Column) -> Column:
        got = F.aggregate(F.sequence(F.lit(0), F.size(p["notice"]) - 1), F.lit(0.0), lambda s, j: s + F.when(F.get(w, first + j) == F.get(p["notice"], j), F.get(p["idf"], j)).otherwise(0.0))
        of = F.aggregate(p["idf"], F.lit(0.0), lambda s, x: s + x)
        return F.struct((first + p["at"]).alias("start"), p["label"].alias("label"), p["template"].alias("template"), p["phrase"].alias("phrase"), F.least(F.lit(1.0), got / of).alias("coverage"))

    def of_template(p: Column) -> Column:
        agreed = F.aggregate(F.slice(p["index"], 2, INDEXED), begins(F.get(p["index"], F.lit(0))), lambda kept, entry: F.array_intersect(kept, begins(entry)))
        stands = lambda first: (first + p["at"] >= 0) & (F.slice(w, F.greatest(first + p["at"], F.lit(0)) + 1, F.size(p["key"])) == p["key"])
        return F.transform(F.filter(agreed, stands), lambda first: place(first, p))

    found = F.flatten(F.transform(F.filter(F.array(*rows), lambda p: F.exists("_sparklog_hit", lambda h: h["word"] == F.get(p["index"], F.lit(0))["word"])), of_template))
    none = F.array().cast("array<struct<start:int,label:string,template:int,phrase:string,coverage:double>>")
    df = df.withColumn("places", F.when(F.size("_sparklog_hit") > 0, F.array_sort(found)).otherwise(none))
    pl = F.col("places")
    based = F.array_distinct(F.transform(F.filter(pl, lambda p: p["phrase"].isin(base)), lambda p: F.struct(p["start"].alias("start"), p["phrase"].alias("phrase"), p["label"].alias("label"))))
    df = df.withColumn("base_places", based)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    return df.withColumns({
        "base_labels": names(F.col("base_places")), "labels": names(pl),
        "score": F.coalesce(F.array_max(F.transform(pl, lambda p: p["coverage"])), F.lit(0.0)),
    }).drop("_sparklog_w", "_sparklog_hit")


def oracle(table: str = "documents", templates=TEMPLATES, base=BASE) -> str:
    """DuckDB SQL of doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score, which tries every template at every word."""
    quoted = lambda xs: "[" + ",".join(f"'{x}'" for x in xs) + "]"
    parts = [(label, notice.split(), key.split()) for label, notice, key in templates]
    values = ",".join(
        f"('{label}', {quoted(notice)}, {quoted(key)}, {next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)}, {str(' '.join(key) in base).lower()})" for label, notice, key in parts
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}),
t(label, notice, key, pos, base) AS (VALUES {values}),
df AS (SELECT x, count(*) AS n FROM (SELECT unnest(list_distinct(w)) AS x FROM d) GROUP BY x),
v AS (SELECT DISTINCT unnest(notice) AS x FROM t),
idf AS (SELECT map(list(x), list(value)) AS m FROM (SELECT v.x, ln(((SELECT count(*) FROM d) + 1) / (coalesce(df.n, 0) + 0.5)) AS value FROM v LEFT JOIN df ON df.x = v.x)),
f AS (SELECT d.row, d.w, t.*, unnest(list_filter(range(len(d.w)), lambda i: d.w[i + 1] = t.key[1] AND d.w[i + 1 : i + len(t.key)] = t.key)) AS start FROM d, t WHERE list_has_all(d.w, t.key)),
p AS (SELECT row, label, base, start, list_sum(list_transform(range(len(notice)), lambda j: CASE WHEN start - pos + j >= 0 AND w[start - pos + j + 1] = notice[j + 1] THEN m[notice[j + 1]] ELSE 0.0 END))
  / list_sum(list_transform(notice, lambda x: m[x])) AS coverage FROM f, idf),
b AS (SELECT row, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p WHERE base GROUP BY row),
a AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM p GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(b.base_labels, '') AS base_labels, coalesce(a.labels, '') AS labels, round(least(1.0, coalesce(a.score, 0.0)), 6) AS score
FROM d LEFT JOIN b USING (row) LEFT JOIN a USING (row)"""
