"""License scan by diagonal voting, in DataFrame functions only.

All rolling ``K``-word hashes of a document are joined with the places of the same hashes
in a fixed set of license templates.  Each match votes for the diagonal (document place minus
template place); neighbouring diagonals are merged, which bridges words that were added or left
out, and a merged diagonal is a find if its votes cover enough of the template and its span
is not much longer than the template.  The templates are a fixed list of this module (a few
kilobytes), so they are broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tremorlake.llm.text import NOT_ALNUM, table, words

K = 3
NEAR = 2  # diagonals this near are one
COVER = 0.6
STRETCH = 1.5

#: Phrases whose places are always reported (fixed values).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening words and notices of widespread licenses (fixed values).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def _kgrams(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, gram): the hash of the K words at each place."""
    at = lambda i: F.get("words", F.col("pos") + i)
    return (
        df.where(F.size("words") >= K)
        .select(*keep, "words", F.posexplode("words").alias("pos", "word"))
        .where(F.col("pos") <= F.size("words") - K)
        .select(*keep, "pos", F.xxhash64("word", *(at(i) for i in range(1, K))).alias("gram"))
    )


def template_places(spark: SparkSession) -> DataFrame:
    """(template, label, n, gram, place) of the fixed templates."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(t).alias("text")) for i, (label, t) in enumerate(TEMPLATES)))
    base = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    base = base.select("template", "label", words(F.col("text")).alias("words")).withColumn("n", F.size("words"))
    return _kgrams(base, "template", "label", "n").withColumnRenamed("pos", "place")


def _phrase_places(phrase: str) -> Column:
    parts = phrase.split()
    fits = lambda i: reduce(lambda a, b: a & b, (F.get("words", i + k) == p for k, p in enumerate(parts)))
    return F.filter(F.sequence(F.lit(0), F.size("words") - 1), fits)


def license_finds(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, label, first, last, cover): verified spans.

    ``docs`` has doc_id, text_hash and words.
    """
    votes = _kgrams(docs, "doc_id", "text_hash").join(F.broadcast(template_places(docs.sparkSession)), "gram")
    by = ["doc_id", "text_hash", "template", "label", "n"]
    diagonals = votes.groupBy(*by, (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        # repeated rows of one document vote alike; each place counts once
        F.count_distinct("pos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    order = W.partitionBy(*by).orderBy("diagonal")
    fresh = F.col("diagonal") - F.lag("diagonal").over(order) > NEAR
    merged = (
        diagonals.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
        .withColumn("run", F.sum("fresh").over(order))
        .groupBy(*by, "run")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), (F.max("last") + K).alias("last"))
    )
    cover = F.least(F.lit(1.0), F.col("votes") / (F.col("n") - K + 1))
    found = (cover >= COVER) & (F.col("last") - F.col("first") <= STRETCH * F.col("n"))
    return merged.where(found).select("doc_id", "text_hash", "template", "label", "first", "last", cover.alias("cover"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Places are counted in words from 0.  ``labels`` holds the labels of the base phrases and of
    all verified templates; ``score`` is 1 with a base phrase, else the best cover of a
    template, else 0.  A null or empty text has no words, no labels and score 0.  Repeated rows each
    get a row; rows are told apart by doc_id (null too) and text.  Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), words(text).alias("words"), F.contains(F.lower(text), F.lit("license")).alias("may"))
    none = F.array().cast("array<int>")
    places = {label: F.when(F.col("may") & (F.size("words") > 0), _phrase_places(p)).otherwise(none) for p, label in PHRASES.items()}
    own = base.select("doc_id", "text_hash", F.size("words").alias("n_words"), *(p.alias(f"at_{x}") for x, p in places.items()))
    every = F.concat(*(F.col(f"at_{x}") for x in places))
    label = lambda x: F.when(F.size(f"at_{x}") > 0, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    own = own.select("doc_id", "text_hash", "n_words", every.alias("every"), F.sort_array(F.concat(*map(label, places))).alias("base"))
    best = license_finds(base).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    same = F.col("o.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("o.text_hash") == F.col("b.text_hash"))
    out = own.alias("o").join(best.alias("b"), same, "left")
    labels = F.sort_array(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "o.doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", labels).alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {"op6_license_scan": op6_license_scan}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{}')".format(
    NOT_ALNUM.replace("[", "[^", 1)
)
_VALUES = ", ".join(f"({i}, '{x}', '{t}')" for i, (x, t) in enumerate(TEMPLATES))
_PHRASES = ", ".join(f"('{p}', '{x}', {len(p.split())})" for p, x in PHRASES.items())
ORACLE = {
    "op6_license_scan": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT template, label, {_WORDS} AS w FROM (VALUES {_VALUES}) AS x(template, label, text)),
tg AS (SELECT template, label, len(w) AS n, unnest(range(0, len(w) - {K - 1})) AS place, w FROM t),
tk AS (SELECT template, label, n, place, array_to_string(w[place + 1:place + {K}], ' ') AS gram FROM tg),
dp AS (SELECT rid, w, unnest(range(0, len(w))) AS pos FROM d),
b AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM dp, (VALUES {_PHRASES}) AS p(phrase, label, k) WHERE array_to_string(w[pos + 1:pos + k], ' ') = phrase GROUP BY rid),
m AS (SELECT rid, template, label, n, pos - place AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) AS hi
  FROM (SELECT rid, pos, array_to_string(w[pos + 1:pos + {K}], ' ') AS gram FROM dp) JOIN tk USING (gram) GROUP BY ALL),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS run FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > {NEAR} THEN 1 ELSE 0 END AS fresh FROM m)),
s AS (SELECT rid, label, least(1.0, sum(votes)::DOUBLE / (n - {K - 1})) AS cover, max(hi) + {K} - min(lo) AS span, n FROM r GROUP BY rid, template, label, n, run),
f AS (SELECT rid, list(DISTINCT label) AS more, max(cover) AS cover FROM s WHERE cover >= {COVER} AND span <= {STRETCH} * n GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(labels, '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(CASE WHEN labels IS NULL THEN [] ELSE string_split(labels, ',') END, coalesce(more, [])))), ',') AS labels,
  (CASE WHEN b.n > 0 THEN 1.0 ELSE coalesce(cover, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""
}
