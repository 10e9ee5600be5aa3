"""License scans by diagonal voting, in DataFrame functions only.

Templates are short license notices. Every rolling run of ``K`` words of every text is
joined, by hash and then as text, to the template positions that hold the same run. A
hit at word i of the document and word j of the template votes for the diagonal i - j.
Votes are counted by diagonal; diagonals at most ``GAP`` apart, as they arise where a
word was put in or left out, are merged into one span; a span is verified by the share
of the template's words that its runs cover and by how densely they fill the span.

Beside them stand phrases of at most ``K`` words, found through the same join wherever
their words follow each other.

Texts are read and cut into words once. What crosses the network are the hits, which are few,
and one narrow row per document. The wanted runs are a fixed table of some hundred
rows, sent to every task. Rows of equal id and text are folded into one with a count
and unfolded at the end, so that a row repeated a million times is one row in the shuffle.

Defined cases: a null text has no words, its labels are empty and its score 0; a text
of fewer than ``K`` words has no runs, but may hold a phrase; a very long text is cut
into words and runs in one task and whole; repeated rows each get their result; ids may
repeat or be null; an empty table gives an empty result; further columns are ignored,
whatever their names. Where spans of one label tie, the label counts once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ASCII_WORD_PATTERN, LOWER, UPPER, ascii_lower, ascii_words, cut_lineage, find_ascii_words, row_keys, table, unfolded

K = 3
#: Words by which neighbouring diagonals may differ.
GAP = 3
#: Share of a template's words that a span must cover, and share of the span that they must fill.
COVERED, DENSE = 0.75, 0.6

# The contract's phrases, and the wording of public license notices.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = [
    ("agpl", "GNU Affero General Public License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


HEADER = -1


def wanted_runs(spark: SparkSession, templates: list[tuple[str, str]], phrases: dict[str, str], k: int) -> tuple[DataFrame, Column]:
    """run, template, label, t_words, j: what rolling runs are joined to; and the key of
    column ``run`` in that table. Templates are numbered from 0 and give their runs. The
    empty run, template ``HEADER``, stands before each text, so that every row is met once.
    Phrases follow the templates; one shorter than ``k`` words stands at the head of longer
    runs, so such a run's key is the phrase, unless a template has that run, too."""
    if any(len(p.split(" ")) > k for p in phrases):
        raise ValueError(f"phrases have at most {k} words; longer ones are templates")
    rows = [("", HEADER, "", 0, 0)]
    for t, (label, text) in enumerate(templates):
        words = find_ascii_words(ascii_lower(text))
        rows += [(" ".join(words[j : j + k]), t, label, len(words), j) for j in range(len(words) - k + 1)]
    own = {r[0] for r in rows} | set(phrases)
    key = F.col("run")
    for n, (phrase, label) in enumerate(sorted(phrases.items()), len(templates)):
        begun = sorted(r for r in own if r.startswith(f"{phrase} "))
        rows += [(r, n, label, len(phrase.split(" ")), 0) for r in [phrase, *begun]]
        if len(phrase.split(" ")) < k:
            key = F.when(F.col("run").startswith(f"{phrase} ") & ~F.col("run").isin(begun), phrase).otherwise(key)
    fields = {"as_text": "string", "template": "int", "label": "string", "t_words": "int", "j": "int"}
    literal = F.from_json(F.lit(json.dumps([dict(zip(fields, r)) for r in rows])), f"array<struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>>")
    return spark.range(1).select(F.inline(literal)), key


def rolled(docs: DataFrame, k: int) -> DataFrame:
    """k1, k2, doc_id, n_words, i, run: the run of ``k`` words at each word of every text (the
    last ones are shorter and equal no template's), and the empty one at -1."""
    words = docs.select("k1", "k2", "doc_id", ascii_words("text").alias("words"))
    later = lambda i: (F.get(F.col("words"), i + n) for n in range(1, k))
    runs = F.concat(F.array(F.lit("")), F.transform("words", lambda w, i: F.concat_ws(" ", w, *later(i))))
    held = words.select("k1", "k2", "doc_id", F.size("words").alias("n_words"), runs.alias("runs"))
    # outer, as a test for empty arrays would cut every text into words once more
    return held.select("k1", "k2", "doc_id", "n_words", F.posexplode_outer("runs").alias("pos", "run")).withColumn("i", F.col("pos") - 1)


def votes(docs: DataFrame, templates: list[tuple[str, str]], phrases: dict[str, str], k: int) -> DataFrame:
    """By row, template and diagonal: the template positions that are hit (a set, which the
    template's length bounds and repeated rows do not change), the first and last word of
    the document and the number of hits. Texts are read once, for all of it."""
    wanted, key = wanted_runs(docs.sparkSession, templates, phrases, k)
    sent = F.broadcast(wanted.withColumn("h", F.xxhash64("as_text")))  # a fixed table of some hundred rows
    hits = rolled(docs, k).withColumn("run", key).withColumn("h", F.xxhash64("run")).join(sent, "h").where(F.col("run") == F.col("as_text"))
    of = ["k1", "k2", "doc_id", "n_words", "template", "label", "t_words", (F.col("i") - F.col("j")).alias("diagonal")]
    return cut_lineage(hits.groupBy(*of).agg(F.collect_set("j").alias("at"), F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("times")))


def spans(counted: DataFrame, k: int, gap: int) -> DataFrame:
    """k1, k2, label, template, first, after (words), covered (share of the template's
    words) and dense (share of the span that they fill) of each run of diagonals."""
    along = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > gap).cast("int"), F.lit(0))
    chained = counted.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(along))
    merged = chained.groupBy("k1", "k2", "template", "label", "t_words", "chain").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min("first").alias("first"), (F.max("last") + k).alias("after"))
    words = F.size(F.array_distinct(F.flatten(F.transform("at", lambda j: F.sequence(j, j + k - 1)))))
    return merged.select("k1", "k2", "label", "template", "first", "after", (words / F.col("t_words")).alias("covered"), (words / (F.col("after") - F.col("first"))).alias("dense"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = K, gap: int = GAP, covered: float = COVERED, dense: float = DENSE) -> DataFrame:
    """doc_id, n_words, places (array of phrase places), spans (array of the verified spans
    with label, first, after, covered) and score of every row: the largest share of a
    template that any span covers, 1 where a phrase stands."""
    counted = votes(row_keys(docs), templates, phrases, k)
    rows = counted.where(F.col("template") == HEADER).select("k1", "k2", "doc_id", "n_words", "times")
    found = spans(counted.where(F.col("template").between(0, len(templates) - 1)), k, gap)
    verified = (F.col("covered") >= covered) & (F.col("dense") >= dense)
    span = F.when(verified, F.struct("first", "after", "label", "covered"))
    by_row = found.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.max("covered").alias("best"))
    place = F.struct(F.col("first").alias("at"), "label")
    places = counted.where(F.col("template") >= len(templates)).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(place)).alias("places"))
    joined = unfolded(rows.join(by_row, ["k1", "k2"], "left").join(places, ["k1", "k2"], "left"), "times")
    score = F.when(F.col("places").isNotNull(), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    none = lambda fields: F.array().cast(f"array<struct<{fields}>>")
    return joined.select("doc_id", "n_words", F.coalesce("places", none("at:int,label:string")).alias("places"), F.coalesce("spans", none("first:int,after:int,label:string,covered:double")).alias("spans"), score.alias("score"))


def op12_columns(found: DataFrame) -> DataFrame:
    base, own = F.col("places")["label"], F.col("spans")["label"]
    at = F.transform("places", lambda p: p["at"].cast("long"))
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        named(base).alias("base_labels"), named(F.concat(base, own)).alias("labels"), F.round("score", 6).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_columns(scan(table(spark, sf_dir, "documents")))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


OP12_SQL = rf"""
with template as (
    select i as template, label, regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '{ASCII_WORD_PATTERN}') as w
    from (values {", ".join(f"({i}, {_quoted(label)}, {_quoted(t)})" for i, (label, t) in enumerate(TEMPLATES))}) v(i, label, t)),
template_run as (
    select template, label, len(w) as n_words, j, w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] as run
    from (select *, unnest(range(len(w) - {K} + 1)) as j from template)),
doc as (
    select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ASCII_WORD_PATTERN}') as w from documents),
place as (
    select rid, i, p.label
    from (select rid, w, unnest(range(len(w))) as i from doc),
         (values {", ".join(f"({_quoted(p)}, {_quoted(label)}, {len(p.split())})" for p, label in PHRASES.items())}) p(phrase, label, n)
    where array_to_string(w[i + 1 : i + p.n], ' ') = p.phrase and len(w) >= i + p.n),
base as (select rid, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as base_labels from place group by rid),
doc_run as (select rid, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] as run from (select rid, w, unnest(range(len(w) - {K} + 1)) as i from doc)),
vote as (
    select rid, template, label, n_words, i - j as diagonal, list(j) as js, min(i) as first, max(i) as last
    from doc_run join template_run using (run) group by all),
fresh as (select *, coalesce(diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > {GAP}, false)::int as new from vote),
chain as (select *, sum(new) over (partition by rid, template order by diagonal) as chain from fresh),
words as (select rid, template, label, n_words, chain, first, last, unnest(js) as j from chain),
covering as (select rid, template, chain, count(distinct j + d) as n from words, (values {", ".join(f"({d})" for d in range(K))}) s(d) group by all),
span as (
    select rid, label, n / n_words as covered, n / (max(last) + {K} - min(first)) as dense
    from words join covering using (rid, template, chain) group by rid, template, chain, label, n, n_words),
own as (select rid, max(covered) as best, list(label) filter (covered >= {COVERED} and dense >= {DENSE}) as found from span group by rid),
named as (
    select rid, string_agg(distinct label, ',' order by label) as labels
    from (select rid, label from place union all select rid, unnest(found) from own) group by rid)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       round(case when n_base > 0 then 1.0::double else coalesce(best, 0) end, 6) as score
from doc left join base using (rid) left join own using (rid) left join named using (rid)
"""
