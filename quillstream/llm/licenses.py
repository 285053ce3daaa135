"""License scans by diagonal voting, with DataFrame functions only.

Every word pair and every run of four words of a text is hashed and joined with the places of such runs in the
templates. A hit votes for a diagonal: the text's position less the template's, where the template
would begin. Votes are gathered by diagonal; for a phrase all its pairs have to vote for one. For a longer
template diagonals that lie at most `NEIGHBOURS` words apart are merged, since a word put in or left out moves the rest by
one, and the template is found if `SHARE` of its runs voted. Every hit is compared word by word before it
counts, so equal hashes alone decide nothing.

Templates are constants of the plan, so the broadcast side is bounded. Votes are bits of one number, so a group's
state does not grow; what is shuffled is a row for each document and one for each diagonal of it.

Words are runs of digits, letters and whatever is beyond ASCII; A-Z count as a-z.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows (same id and text) each
have their row, rows that share an id only are told apart by their text; texts of any length are read whole; a
place counts for every phrase that stands there; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
#: Beginnings of licenses and of the notices that name them, as words. A template has at most 63 runs of four words.
TEXTS = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
SHORT, LONG = 2, 4
#: Diagonals so far apart are one finding, which has to hold this share of a template's runs.
NEIGHBOURS, SHARE = 3, 0.6
MOST_RUNS = 63

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def runs() -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, whether a phrase, words in a run, runs in the template, place, run) of all templates."""
    out = []
    for t, (label, text, k) in enumerate([(*x, SHORT) for x in PHRASES] + [(*x, LONG) for x in TEXTS]):
        words = text.split()
        n = len(words) - k + 1
        if not 0 < n <= MOST_RUNS:
            raise ValueError(f"a template of {n} runs")
        out += [(t, label, k == SHORT, k, n, at, " ".join(words[at : at + k])) for at in range(n)]
    return out


def _rolled(hashes: Column, further: int) -> Column:
    """At each place the hash of what stands there and of what stands `further` places on."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(further + 1), F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _hashed(df: DataFrame, words: str) -> DataFrame:
    """df with `pairs` and `fours`: rolling hashes of the runs that begin at each word."""
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(F.lower(w))))
    df = df.withColumn("pairs", _rolled(F.col("_h"), 1)).drop("_h")
    return df.withColumn("fours", _rolled(F.col("pairs"), 2))


def template_frame(spark: SparkSession) -> DataFrame:
    """The templates' runs with their hashes."""
    rows = [F.struct(*(F.lit(v).alias(c) for v, c in zip(row, ("template", "label", "phrase", "k", "n_runs", "at", "run"), strict=True))) for row in runs()]
    listed = spark.range(1).select(F.inline(F.array(*rows))).withColumn("_words", F.split("run", " "))
    return _hashed(listed, "_words").withColumn("hash", F.when(F.col("k") == SHORT, F.element_at("pairs", 1)).otherwise(F.element_at("fours", 1))).drop("_words", "pairs", "fours")


def hits(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_words and a template's run (label, n_runs, at) with the place where it stands in the text;
    besides, for each row of docs, one of place -1."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", F.md5(text).alias("digest"), F.array_remove(F.split(text, _BETWEEN), "").alias("words"))
    hashed = _hashed(split, "words").withColumn("n_words", F.size("words"))
    # the first entry stands for the document itself, then come all pairs, then all runs of four
    listed = hashed.select("doc_id", "digest", "words", "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "pairs", "fours")).alias("entry", "hash"))
    found = listed.join(F.broadcast(template_frame(docs.sparkSession)), "hash", "left")
    place = F.when(F.col("entry") == 0, -1).otherwise((F.col("entry") - 1) % F.col("n_words"))
    same = F.translate(F.array_join(F.slice("words", F.col("place") + 1, F.col("k")), " "), _UPPER, _LOWER) == F.col("run")
    placed = found.filter("entry = 0 OR template IS NOT NULL").withColumn("place", place)
    return placed.filter((F.col("place") < 0) | same).select("doc_id", "digest", "n_words", "template", "label", "phrase", "n_runs", "at", "place")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of docs."""
    known = hits(docs)
    one_bit = F.expr("shiftleft(1L, at)")
    voted = known.groupBy("doc_id", "digest", "n_words", "template", "label", "phrase", "n_runs", F.when(F.col("place") >= 0, F.col("place") - F.col("at")).alias("diagonal")).agg(F.bit_or(one_bit).alias("votes"), F.count("*").alias("n"))
    by_template = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    # a phrase's diagonals stay apart: each is a place of its own
    starts = (F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(by_template) > NEIGHBOURS)).cast("int")
    grouped = voted.withColumn("finding", F.coalesce(starts, F.lit(1))).withColumn("finding", F.sum("finding").over(by_template.rowsBetween(Window.unboundedPreceding, 0)))
    findings = grouped.groupBy("doc_id", "digest", "n_words", "template", "label", "phrase", "n_runs", "finding").agg(F.bit_or("votes").alias("votes"), F.min("diagonal").alias("start"), F.sum("n").alias("n"))
    share = F.bit_count("votes") / F.col("n_runs")
    judged = findings.select("*", F.coalesce(F.when(F.col("phrase"), share == 1).otherwise(share >= SHARE), F.lit(False)).alias("holds"), share.alias("share"))
    base = F.col("holds") & F.col("phrase")
    whole = judged.groupBy("doc_id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(F.col("template").isNull(), F.col("n"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("holds"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("holds"), F.col("share"))), F.lit(0.0)).alias("score"),
    )
    each = whole.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _rows_as_sql() -> str:
    return ", ".join(f"({t}, '{label}', {str(phrase).upper()}, {k}, {n}, {at}, '{run}')" for t, label, phrase, k, n, at, run in runs())


ORACLE = rf"""
WITH template(template, label, phrase, k, n_runs, spot, run) AS (
  VALUES {_rows_as_sql()}
), split AS (
  SELECT row_number() OVER () AS rn, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT rn, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: struct_pack(place := i - 1, run := array_to_string(w[i : i + k - 1], ' ')))) AS x
  FROM split, (VALUES (2), (4)) lengths(k)
), votes AS (
  SELECT DISTINCT rn, template, label, phrase, n_runs, spot, x.place - spot AS diagonal FROM places p JOIN template t ON t.k = p.k AND t.run = p.x.run
), diagonals AS (
  SELECT rn, template, phrase, diagonal FROM votes GROUP BY ALL
), fresh AS (
  SELECT *, CASE WHEN NOT phrase AND diagonal - lag(diagonal) OVER (PARTITION BY rn, template ORDER BY diagonal) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS fresh FROM diagonals
), numbered AS (
  SELECT rn, template, diagonal, sum(fresh) OVER (PARTITION BY rn, template ORDER BY diagonal) AS finding FROM fresh
), findings AS (
  SELECT rn, label, phrase, min(diagonal) AS start, count(DISTINCT spot)::DOUBLE / n_runs AS share FROM votes JOIN numbered USING (rn, template, diagonal) GROUP BY rn, template, label, phrase, n_runs, finding
), held AS (
  SELECT * FROM findings WHERE share >= CASE WHEN phrase THEN 1 ELSE {SHARE} END
), by_row AS (
  SELECT rn, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM held GROUP BY rn
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM split LEFT JOIN by_row USING (rn)
"""
