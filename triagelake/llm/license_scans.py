"""License scans: an exact set-similarity join of text blocks with license notices.

A template is a notice and the share of its words that a block must contain.  The
blocks of a text for a template of ``m`` words are the runs of ``2 m`` words that
start at multiples of ``m``, so every run of ``m`` words lies whole in one.  The
join finds every block that contains the share, without looking at the others:

* **order** -- the words of all templates, rarest in the whole corpus first;
* **prefix filter** -- of a template of ``n`` different words of which ``need``
  must be there, any block that has enough has one of the ``n - need + 1`` rarest.
  Only occurrences of such words leave their text, each with what lies around it,
  and meet the table of prefixes in a broadcast join;
* **length filter** -- the block has ``need`` different template words at least;
* **positional filter** -- a pair is looked at from its rarest common word only,
  and only if enough words stand behind it in the order, on both sides;
* what is left is verified by intersection.

The corpus goes through one projection twice: to count template words, and to
join.  Both tables that reach the driver or the tasks are as long as the
templates.  A text's occurrences are merged within its task before the shuffle,
which moves a row of numbers per text.  All of it is Spark expressions.

Fixed phrases (``PHRASES``) are found word by word beside the join; their labels
are ``base_labels``, ``labels`` has those of the join as well.  ``score`` is the
greatest share of a notice found, 1 for a phrase.

Words are runs of ASCII letters and digits and of any character beyond ASCII, the
letters A-Z lowered.  Defined results: a null, empty or wordless text has no
places, empty labels and score 0; repeated rows give repeated rows; equal ids with
different texts are different rows; a null ``doc_id`` stays null; very long texts
are read whole, an occurrence carries at most ``4 M`` neighbours, ``M`` being the
longest template; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_LABELS = 63  # a bit each


class Template(NamedTuple):
    label: str
    notice: str
    share: float = 0.8

    @property
    def words(self) -> list[str]:
        return [w for w in re.split(GAP, self.notice.translate(str.maketrans(UPPER, LOWER))) if w]

    @property
    def tokens(self) -> list[str]:
        return sorted(set(self.words))

    @property
    def need(self) -> int:
        return max(1, -int(-self.share * len(self.tokens) // 1))


#: Phrases whose words stand consecutively, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices must be there whole.
TEMPLATES = (
    Template("mit", "MIT License", 1.0),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of "
             "this software and associated documentation files, to deal in the Software without "
             "restriction, including without limitation the rights to use, copy, modify, merge, "
             "publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("apache-2.0", "Apache License, Version 2.0", 1.0),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not "
             "use this file except in compliance with the License. You may obtain a copy of the License"),
    Template("gpl-2.0", "GNU General Public License version 2", 1.0),
    Template("gpl-3.0", "GNU General Public License version 3", 1.0),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the "
             "terms of the GNU General Public License as published by the Free Software Foundation, "
             "either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "GNU Lesser General Public License", 1.0),
    Template("agpl", "GNU Affero General Public License", 1.0),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, "
             "are permitted provided that the following conditions are met"),
    Template("mpl-2.0", "Mozilla Public License", 1.0),
    Template("epl", "Eclipse Public License", 1.0),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
             "with or without fee is hereby granted, provided that the above copyright notice and this "
             "permission notice appear in all copies"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc-by-nc", "CC BY NC", 1.0),
    Template("cc-by-sa", "CC BY SA", 1.0),
    Template("cc-by-nd", "CC BY ND", 1.0),
    Template("cc0", "CC0 1.0 Universal", 1.0),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("no-reproduction", "All rights reserved. No part of this publication may be reproduced, "
             "stored or transmitted in any form or by any means without the prior written permission "
             "of the publisher"),
)


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, GAP), "")


def phrase_places(words: Column, phrase: str) -> Column:
    """Ascending places where the phrase's words stand one after another."""
    parts = phrase.split()

    def place(word: Column, i: Column) -> Column:
        rest = [F.coalesce(F.get(words, i + k), F.lit("")) == p for k, p in enumerate(parts) if k]
        return F.when(reduce(and_, rest, word == parts[0]), i)

    found = F.array_compact(F.transform(words, place))
    none = F.array().cast("array<int>")
    return F.when(F.array_contains(words, parts[0]), found).otherwise(none)


def word_order(texts: DataFrame, templates: Sequence[Template] = TEMPLATES) -> list[str]:
    """All template words, rarest in ``text`` first; as long as the templates."""
    vocabulary = sorted({w for t in templates for w in t.tokens})
    counted = (
        texts.select(words_of(F.col("text")).alias("words"))
        .select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("token"))
        .groupBy("token")
        .count()
        .collect()
    )
    seen = {r["token"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _prefixes(templates: Sequence[Template], order: list[str]) -> dict[str, list[tuple[Template, int]]]:
    """Per prefix word: the templates it is in the prefix of, and its place in their order."""
    rank = {w: k for k, w in enumerate(order)}
    out: dict[str, list[tuple[Template, int]]] = {}
    for template in templates:
        tokens = sorted(template.tokens, key=rank.__getitem__)
        for k, token in enumerate(tokens[: len(tokens) - template.need + 1]):
            out.setdefault(token, []).append((template, k))
    return out


def prefix_table(
    spark: SparkSession, prefixes: dict[str, list[tuple[Template, int]]], order: list[str], labels: list[str]
) -> DataFrame:
    """``token, rank, entries``: one row per prefix word."""
    rank = {w: k for k, w in enumerate(order)}

    def entry(template: Template, place: int) -> Column:
        return F.struct(
            F.lit(1 << labels.index(template.label)).cast("bigint").alias("bit"),
            F.lit(len(template.words)).alias("m"),
            F.lit(template.need).alias("need"),
            F.lit(len(template.tokens) - place).alias("behind"),
            F.array(*map(F.lit, template.tokens)).alias("tokens"),
        )

    rows = [
        F.struct(
            F.lit(token).alias("token"),
            F.lit(rank[token]).alias("rank"),
            F.array(*[entry(t, k) for t, k in found]).alias("entries"),
        )
        for token, found in sorted(prefixes.items())
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _overlap(entry: Column, block: Column, rank: Column, order: Column) -> Column:
    """Template words in a block, seen from its rarest one; 0 where a filter says no.

    ``block`` are the different template words of the block, ``rank`` is where
    the occurrence's word stands in the order.
    """
    at = F.transform(block, lambda w: F.array_position(order, w).cast("int") - 1)
    behind = F.size(F.filter(at, lambda k: k >= rank))
    common = F.array_intersect(entry["tokens"], block)
    first = F.array_min(F.transform(common, lambda w: F.array_position(order, w).cast("int") - 1))
    passes = (
        (F.size(block) >= entry["need"])
        & (entry["behind"] >= entry["need"])
        & (behind >= entry["need"])
    )
    return F.when(passes, F.when(first == rank, F.size(common)).otherwise(0)).otherwise(0)


def _matches(order: list[str]) -> Column:
    """(bit, share) of the templates met around one occurrence (``near``, ``rank``, ``entries``)."""
    whole = F.array(*map(F.lit, order))
    around, at, rank = F.col("near")["around"], F.col("near")["at"], F.col("rank")

    def best(entry: Column) -> Column:
        def block(start: Column) -> Column:
            inside = F.filter(
                around, lambda x: (x["at"] >= start) & (x["at"] < start + 2 * entry["m"])
            )
            return F.array_distinct(F.transform(inside, lambda x: x["token"]))

        own = F.floor(at / entry["m"]).cast("int")
        starts = F.filter(F.array(own, own - 1), lambda b: b >= 0)
        overlaps = F.transform(starts, lambda b: _overlap(entry, block(b * entry["m"]), rank, whole))
        most = F.array_max(overlaps)
        return F.struct(
            entry["bit"].alias("bit"),
            F.when(most >= entry["need"], most / F.size(entry["tokens"])).otherwise(0.0).alias("share"),
        )

    return F.filter(F.transform("entries", best), lambda m: m["share"] > 0)


def _near(words: Column, vocabulary: list[str], prefix: list[str], reach: int) -> Column:
    """Occurrences of prefix words, each with the template words around it."""
    spots = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("at"))),
        lambda x: x["token"].isin(vocabulary),
    )

    def with_neighbours(occurrences: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            low = F.greatest(k - reach, F.lit(0))
            around = F.slice(occurrences, low + 1, k - low + reach + 1)
            return F.when(
                x["token"].isin(prefix),
                F.struct(x["token"].alias("token"), x["at"].alias("at"), around.alias("around")),
            )

        return F.array_compact(F.transform(occurrences, one))

    listed = F.array(*map(F.lit, prefix))
    found = F.get(F.transform(F.array(spots), with_neighbours), F.lit(0))
    return F.when(F.arrays_overlap(words, listed), found)


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` per row."""
    labels = sorted({t.label for t in templates})
    if len(labels) > MOST_LABELS:
        raise ValueError(f"at most {MOST_LABELS} labels, not {len(labels)}")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = word_order(texts, templates)
    prefixes = _prefixes(templates, order)
    reach = 2 * max(len(t.words) for t in templates)
    texts = texts.select(
        "doc_id",
        F.xxhash64("text").alias("_h1"),
        F.xxhash64(F.lit(1), F.col("text")).alias("_h2"),
        words_of(F.col("text")).alias("_words"),
    )
    words = F.col("_words")
    placed = texts.select(
        "doc_id", "_h1", "_h2",
        F.size(words).cast("bigint").alias("n_words"),
        F.array(*[phrase_places(words, p) for p, _ in phrases]).alias("_places"),
        F.explode_outer(F.array(_near(words, order, list(prefixes), reach))).alias("_near"),
    )
    every = F.flatten("_places")
    known = F.filter(
        F.transform(
            F.arrays_zip(F.col("_places"), F.array(*[F.lit(x) for _, x in phrases]).alias("label")),
            lambda z: F.when(F.size(z["_places"]) > 0, z["label"]),
        ),
        lambda x: x.isNotNull(),
    )
    based = placed.select(
        "doc_id", "_h1", "_h2", "n_words",
        F.size(every).cast("bigint").alias("n_base"),
        F.array_min(every).cast("bigint").alias("first_word"),
        F.array_max(every).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(known)), ",").alias("base_labels"),
        F.posexplode_outer("_near").alias("_k", "near"),
    )
    table = prefix_table(docs.sparkSession, prefixes, order, labels)
    keys = ["doc_id", "_h1", "_h2", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    # at most one row of the table per occurrence
    joined = based.join(F.broadcast(table), F.col("near.token") == F.col("token"), "left").select(
        *keys, "_k", F.posexplode_outer(_matches(order)).alias("_m", "match")
    )
    row = (F.coalesce("_k", F.lit(0)) == 0) & (F.coalesce("_m", F.lit(0)) == 0)
    per_text = joined.groupBy(*keys).agg(
        F.sum(row.cast("int")).alias("_copies"),
        F.bit_or(F.coalesce("match.bit", F.lit(0).cast("bigint"))).alias("_bits"),
        F.max(F.coalesce("match.share", F.lit(0.0))).alias("_share"),
    )
    added = F.array(*[
        F.when(F.col("_bits").bitwiseAND(F.lit(1 << k)) != 0, F.lit(x)) for k, x in enumerate(labels)
    ])
    base = F.filter(F.split("base_labels", ","), lambda x: x != "")
    return per_text.select(
        *[c for c in keys if c not in ("_h1", "_h2")],
        F.array_join(F.array_sort(F.array_union(base, F.array_compact(added))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("_share")).alias("score"),
        F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of every document of ``documents``."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    return scan_licenses(docs.select("doc_id", "text"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES_SQL = ", ".join(
    f"({k}, {_quoted(t.label)}, {len(t.words)}, {t.need}, {len(t.tokens)})" for k, t in enumerate(TEMPLATES)
)
_TOKENS_SQL = ", ".join(f"({k}, {_quoted(w)})" for k, t in enumerate(TEMPLATES) for w in t.tokens)
_PHRASES_SQL = " UNION ALL ".join(
    f"SELECT r, pos, {_quoted(label)} AS label FROM p WHERE "
    + " AND ".join(f"{'token' if k == 0 else f'next{k}'} = {_quoted(w)}" for k, w in enumerate(phrase.split()))
    for phrase, label in PHRASES
)
OP13_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
o AS MATERIALIZED (SELECT r, unnest(w) AS token, unnest(range(len(w))) AS pos FROM d),
p AS (SELECT *, lead(token, 1) OVER w AS next1, lead(token, 2) OVER w AS next2
      FROM o WINDOW w AS (PARTITION BY r ORDER BY pos)),
b AS MATERIALIZED ({_PHRASES_SQL}),
t(k, label, m, need, n) AS (VALUES {_TEMPLATES_SQL}),
v(k, token) AS (VALUES {_TOKENS_SQL}),
x AS (SELECT r, k, token, unnest([pos // m, pos // m - 1]) AS block FROM o JOIN v USING (token) JOIN t USING (k)),
f AS MATERIALIZED (
  SELECT r, label, max(c / n) AS share
  FROM (SELECT r, k, block, count(DISTINCT token) AS c FROM x WHERE block >= 0 GROUP BY r, k, block)
  JOIN t USING (k) WHERE c >= need GROUP BY r, label),
s AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY r),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
      FROM (SELECT r, label FROM b UNION ALL SELECT r, label FROM f) GROUP BY r),
q AS (SELECT r, max(share) AS share FROM f GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN s USING (r) LEFT JOIN l USING (r) LEFT JOIN q USING (r)
"""
