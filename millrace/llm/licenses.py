"""License scan by a positional index of rare words; DataFrame functions only.

Each template (a license's notice) is indexed under its rarest words, by their document
frequency in the corpus, with their positions. A text's words that the index knows are looked
up; each posting says where the template would start, and postings that agree on it, up to
some words that were put in or left out, are an alignment. An alignment holds if it covers
enough of the template's weight and the template's key phrases stand in it word for word.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words: ASCII characters but for digits and lower-case letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Positions of a template that are indexed at most, one bit each.
BITS = 60
#: Words by which an alignment's postings may differ, in half of it; templates of at most so many words in all.
DRIFT, MOST_WORDS = 32, 200_000
#: Of a template's weight, that an alignment covers at least; the score of a bare phrase.
LEAST, PHRASE_SCORE = 0.5, 0.5


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]  # each has to stand in an alignment


#: Phrases that give a label by themselves.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices of public licenses, with phrases that a notice cannot lack.
TEMPLATES = (
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("gnu general public license", "version 3")),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ("gnu general public license", "version 2")),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", ("gnu lesser general public license",)),
    Template("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", ("gnu affero general public license",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache license", "version 2 0")),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "without restriction")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    Template("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software", "public domain")),
    Template("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", ("cc by nd",)),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(GAPS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def words_column(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")


@dataclass(frozen=True)
class Index:
    postings: list[tuple[str, int, int, int]]  # word, template, position, bit
    templates: list[tuple[int, str, list[int], int, list[int], int]]  # template, label, weights of the bits, their sum, key phrases, words
    phrases: list[tuple[int, str, int, list[str]]]  # phrase, its rarest word, that word's place in it, its words
    labels: dict[int, str]  # of base phrases


def build_index(docs_with: dict[str, int], n_docs: int, templates: tuple[Template, ...], base: tuple[tuple[str, str], ...]) -> Index:
    """docs_with: documents that hold a word, of n_docs. Of equally rare words the first by name comes first."""
    rarity = lambda w: (docs_with.get(w, 0), w)
    weigh = lambda w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * docs_with.get(w, 0) + 1)))
    phrases, known, labels = [], {}, {}
    for text, label in [*base, *((k, None) for t in templates for k in t.keys)]:
        own = tuple(words_of(text))
        if own not in known:
            known[own] = len(known)
            rare = min(own, key=rarity)
            phrases.append((known[own], rare, own.index(rare), list(own)))
        if label is not None:
            labels[known[own]] = label
    postings, rows = [], []
    for t, template in enumerate(templates):
        own, weights = words_of(template.text), []
        distinct = sorted(set(own), key=rarity)
        for word in distinct[: max(4, (len(distinct) + 1) // 2)]:
            places = [i for i, w in enumerate(own) if w == word]
            if len(weights) + len(places) > BITS:
                break
            postings += [(word, t, i, len(weights) + j) for j, i in enumerate(places)]
            weights += [weigh(word)] * len(places)
        rows.append((t, template.label, weights, sum(weights), [known[tuple(words_of(k))] for k in template.keys], len(own)))
    return Index(postings, rows, phrases, labels)


def corpus_index(df: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> Index:
    """The index, its words weighed by their document frequency in all of df."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)} | {w for text in (*[b for b, _ in base], *[k for t in templates for k in t.keys]) for w in words_of(text)})
    if sum(len(words_of(t.text)) for t in templates) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    own = df.select(words_column(F.col(f"`{text_col}`")).alias("words"))
    told = own.select(F.explode(F.concat(F.when(F.size("words") > 0, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), F.array_distinct(F.filter("words", lambda w: w.isin(vocabulary))))).alias("word"))
    found = {r["word"]: r["n"] for r in told.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of the templates at most
    return build_index(found, found.pop("", 0), templates, base)


def _phrases(phrases: list[tuple[int, str, int, list[str]]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("phrase"), F.lit(w).alias("word"), F.lit(p).alias("pos"), F.array(*map(F.lit, ws)).alias("words")) for i, w, p, ws in phrases])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE, index: Index | None = None) -> DataFrame:
    """A row for each of df's: doc_id, n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest
    start, from 0), base_labels, labels (with those of templates), found (alignments that hold) and score.

    score: the largest share of a template's weight that an alignment which holds covers,
    0.5 at least with a base phrase, else 0. Null and empty texts have no words; null and
    repeated ids are rows like others. Other columns of df are not read.
    """
    spark, index = df.sparkSession, index or corpus_index(df, text_col, templates, base)
    known = sorted({p[0] for p in index.postings} | {p[1] for p in index.phrases})
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), words_column(text).alias("words"))
    hit = F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(i.alias("at"), w.alias("word"))))
    any_hit = F.exists("words", lambda w: w.isin(known))  # most texts have none, and get no array for each word
    rows = rows.select("doc_id", "mark", "words", F.when(any_hit, F.filter(hit, lambda h: h.isNotNull())).otherwise(F.array().cast("array<struct<at:int,word:string>>")).alias("hits"))

    def stands(h: Column, p: Column) -> Column:
        return (p["word"] == h["word"]) & (h["at"] >= p["pos"]) & (F.slice("words", F.greatest(h["at"] - p["pos"], F.lit(0)) + 1, F.size(p["words"])) == p["words"])

    place = lambda h: F.transform(F.filter(_phrases(index.phrases), lambda p: stands(h, p)), lambda p: F.struct(p["phrase"].alias("phrase"), (h["at"] - p["pos"]).alias("at")))
    narrow = written(rows.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), "hits", F.flatten(F.transform("hits", place)).alias("places")), "hits")

    # Where a template would start, by each posting of a word that the text has; near starts meet in one of two grids.
    postings = spark.createDataFrame(index.postings or [("", 0, 0, 0)], "word string, template int, pos int, bit int")
    starts = narrow.select("doc_id", "mark", F.explode("hits").alias("h")).select("doc_id", "mark", F.col("h.word").alias("word"), F.col("h.at").alias("at")).join(F.broadcast(postings), "word")  # at most MOST_WORDS narrow rows
    start = F.col("at") - F.col("pos")
    cells = F.array(F.floor(start / DRIFT) * 2, F.floor((start + DRIFT // 2) / DRIFT) * 2 + 1)
    voted = starts.select("doc_id", "mark", "template", start.alias("start"), F.expr("shiftleft(1L, bit)").alias("one"), F.explode(cells).alias("cell"))
    aligned = voted.groupBy("doc_id", "mark", "template", "cell").agg(F.bit_or("one").alias("bits"), F.min("start").alias("start"))
    rules = spark.createDataFrame(index.templates or [(0, "", [0], 1, [0], 0)], "template int, label string, weights array<long>, total long, keys array<int>, length int")
    covered = F.expr("aggregate(sequence(0, size(weights) - 1), 0L, (s, i) -> s + IF(bit_get(bits, i) = 1, weights[i], 0L))")
    aligned = aligned.join(F.broadcast(rules), "template").where("total > 0").withColumn("covered", covered / F.col("total")).where(F.col("covered") >= LEAST)
    held = aligned.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("label", "covered", "start", "keys", "length")).alias("found"))  # of one text

    both = narrow.drop("hits").alias("n").join(held.alias("h"), F.col("n.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("n.mark") == F.col("h.mark")), "left").select("n.*", "h.found")
    has = lambda f, k: F.exists("places", lambda p: (p["phrase"] == k) & (p["at"] >= f["start"] - DRIFT) & (p["at"] <= f["start"] + f["length"] + DRIFT))
    holds = F.filter(F.coalesce("found", F.array().cast("array<struct<label:string,covered:double,start:int,keys:array<int>,length:int>>")), lambda f: F.forall(f["keys"], lambda k: has(f, k)))
    named = F.create_map(*[F.lit(x) for pair in index.labels.items() for x in pair]) if index.labels else F.create_map().cast("map<int,string>")
    based = F.transform(F.filter("places", lambda p: p["phrase"].isin(list(index.labels))), lambda p: F.struct(p["at"].alias("at"), F.element_at(named, p["phrase"]).alias("label")))
    out = both.select("doc_id", "n_words", based.alias("base"), holds.alias("found"))
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["covered"])), F.lit(0.0))
    labels = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    base_labels, own = F.transform("base", lambda p: p["label"]), F.transform("found", lambda f: f["label"])
    return out.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.transform("base", lambda p: p["at"])).cast("long").alias("first_word"), F.array_max(F.transform("base", lambda p: p["at"])).cast("long").alias("last_word"),
        labels(base_labels).alias("base_labels"), labels(base_labels, own).alias("labels"), F.transform("found", lambda f: F.struct(f["label"].alias("label"), f["start"].alias("start"), f["covered"].alias("covered"))).alias("found"),
        F.greatest(best, F.when(F.size("base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )


def oracle(templates: tuple[Template, ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> str:
    """scan() over documents as DuckDB SQL, without the column found."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cut = lambda text: f"list_filter(string_split_regex(translate({text}, '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '')"
    rows = ", ".join(f"({t}, {quote(x.label)}, {quote(x.text)})" for t, x in enumerate(templates))
    keys = ", ".join(f"({t}, {quote(k)})" for t, x in enumerate(templates) for k in x.keys)
    bases = ", ".join(f"({quote(p)}, {quote(label)})" for p, label in base)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {cut("coalesce(text, '')")} AS ws FROM documents),
        w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS spot FROM d),
        t AS (SELECT template, label, {cut("text")} AS ws FROM (VALUES {rows}) v(template, label, text)),
        tw AS (SELECT template, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM t),
        n AS (SELECT count(*) AS n FROM d WHERE len(ws) > 0),
        f AS (SELECT w, count(DISTINCT r) AS df FROM w WHERE w IN (SELECT w FROM tw) GROUP BY w),
        ranked AS (SELECT template, w, CAST(floor(1000 * ln((2 * n + 2) / (2 * df + 1))) AS BIGINT) AS weight, row_number() OVER (PARTITION BY template ORDER BY df, w) AS place,
                          sum(c) OVER (PARTITION BY template ORDER BY df, w) AS used, count(*) OVER (PARTITION BY template) AS many
                   FROM (SELECT template, w, count(*) AS c, coalesce(any_value(df), 0) AS df FROM tw LEFT JOIN f USING (w) GROUP BY ALL), n),
        anchors AS (SELECT template, w, weight FROM ranked WHERE place <= greatest(4, (many + 1) // 2) AND used <= {BITS}),
        posted AS (SELECT template, w, pos, weight FROM anchors JOIN tw USING (template, w)),
        total AS (SELECT template, sum(weight) AS total FROM posted GROUP BY template),
        starts AS (SELECT r, template, pos, weight, spot - pos AS start FROM w JOIN posted USING (w)),
        cells AS (SELECT r, template, pos, weight, start, unnest([CAST(floor(start / {DRIFT}) AS BIGINT) * 2, CAST(floor((start + {DRIFT // 2}) / {DRIFT}) AS BIGINT) * 2 + 1]) AS cell FROM starts),
        voted AS (SELECT r, template, cell, pos, any_value(weight) AS weight, min(start) AS start FROM cells GROUP BY r, template, cell, pos),
        aligned AS (SELECT r, template, cell, sum(weight) / any_value(total) AS covered, min(start) AS start FROM voted JOIN total USING (template) WHERE total > 0 GROUP BY r, template, cell HAVING covered >= {LEAST}),
        k AS (SELECT template, {cut("phrase")} AS ws FROM (VALUES {keys}) v(template, phrase)),
        b AS (SELECT {cut("phrase")} AS ws, label FROM (VALUES {bases}) v(phrase, label)),
        p AS (SELECT DISTINCT ws FROM (SELECT ws FROM k UNION ALL SELECT ws FROM b)),
        places AS (SELECT r, p.ws, spot FROM w JOIN p ON w.w = p.ws[1] JOIN d USING (r) WHERE list_slice(d.ws, spot + 1, spot + len(p.ws)) = p.ws),
        based AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_distinct(list(label)) AS own FROM places JOIN b USING (ws) GROUP BY r),
        missing AS (SELECT DISTINCT a.r, a.template, a.cell FROM aligned a JOIN k USING (template) JOIN t USING (template)
                    WHERE NOT EXISTS (SELECT 1 FROM places s WHERE s.r = a.r AND s.ws = k.ws AND s.spot BETWEEN a.start - {DRIFT} AND a.start + len(t.ws) + {DRIFT})),
        held AS (SELECT r, list(DISTINCT label) AS more, max(covered) AS covered FROM aligned ANTI JOIN missing USING (r, template, cell) JOIN t USING (template) GROUP BY r)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
               greatest(coalesce(covered, 0), CASE WHEN n_base > 0 THEN {PHRASE_SCORE} ELSE 0 END) AS score
        FROM d LEFT JOIN based USING (r) LEFT JOIN held USING (r)"""
