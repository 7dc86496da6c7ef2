"""License scan as an exact set-similarity join, with DataFrame functions only.

A text block holds a license template if it contains at least ``threshold`` of the template's different
words, all of those that the license cannot do without, and none that name another license. Blocks are a line
and up to ``span`` adjacent ones, so that wrapped notices are found whole. Words are ordered by their frequency in the whole table, rarest first,
and three filters leave few (block, template) pairs to verify:

* prefix: with ``need = ceil(threshold * size)`` words to share, a block that shares none of the
  rarest ``size - need + 1`` words of a template cannot hold it; blocks without any prefix word are
  dropped by one pattern before their lines are split;
* length: a block of fewer different words than ``need`` cannot hold it;
* position: a shared word and all the words behind it, on either side, must be able to make ``need``.

Only the words of the templates are counted and ordered; no other word can be shared. The templates
are a parameter of the operator, so what is broadcast has its size; documents are never broadcast.
Beside the templates, fixed phrases (the base ones and the licenses' names) are found as consecutive words,
also over line ends; all give labels.

Edge cases: a null text has no words; null and repeated ids and repeated rows keep their own rows;
an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = "[\\x00-/:-@\\[-`{-\\x7f]+"  # what separates words, before capitals are lowered
WORD = "[^\\x00-/:-@\\[-`{-\\x7f]"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

@dataclasses.dataclass(frozen=True)
class Template:
    """A notice: its text, the words that it must hold, and words by which another license is meant."""

    label: str
    text: str
    needs: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


# Fixed texts: the notices by which licenses are named.
TEMPLATES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc", "by", "4"), ("nc", "sa", "nd")),
    Template("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License",
             ("creative", "commons", "attribution", "4"), ("noncommercial", "sharealike", "noderivatives")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc", "by", "nc", "4"), ("sa", "nd")),
    Template("cc-by-nc-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             ("creative", "commons", "noncommercial", "4"), ("sharealike", "noderivatives")),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc", "by", "sa", "4"), ("nc", "nd")),
    Template("cc-by-sa-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             ("creative", "commons", "sharealike", "4"), ("noncommercial", "noderivatives")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "3"), ("lesser", "affero")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files, to deal in the Software without restriction", ("granted", "software")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met", ("redistribution", "binary")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla",)),
    Template("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
             ("fee", "software")),
)
# Short forms that name a license by themselves.
NAMES = {
    "mit license": "mit", "apache license version 2 0": "apache-2.0", "mozilla public license version 2 0": "mpl-2.0",
    "bsd license": "bsd", "isc license": "isc", "gnu general public license version 3": "gpl-3.0",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD + "+", text.translate(str.maketrans(UPPER, LOWER)))


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def any_word(words: list[str]) -> str:
    """Pattern that finds one of the words as a whole word, in any case of A-Z."""
    return f"(?i)(?<!{WORD})(?:{'|'.join(map(re.escape, sorted(words)))})(?!{WORD})"


def stands(phrase: str) -> str:
    """Pattern that finds the words of a phrase one after the other, in any case of A-Z."""
    return f"(?i)(?<!{WORD}){BETWEEN.join(map(re.escape, phrase.split()))}(?!{WORD})"


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the given words occurs in all texts; at most one number per given word."""
    found = docs.select(F.explode(F.filter(_split(whole_text()), lambda w: _lower(w).isin(words))).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy(_lower(F.col("w")).alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}


def phrase_places(words: Column, phrases: list[str]) -> Column:
    """Starts of all phrases in the words, a place counted once per phrase that stands there."""
    def begins(phrase: str, i: Column) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase.split()):
            found = found & F.coalesce(F.get(words, i + k) == word, F.lit(False))
        return found

    def starts(i: Column) -> Column:
        return F.filter(F.array(*[F.when(begins(p, i), i) for p in phrases]), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words)), starts))


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
    names: Mapping[str, str] = NAMES, threshold: float = 0.8, span: int = 3,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best containment of a template that some block of up to ``span`` lines holds, else 1 where
    a name of ``names`` stands, else 0.
    """
    sets = {i: sorted(set(words_of(t.text))) for i, t in enumerate(templates)}
    vocabulary = sorted({w for i, t in enumerate(templates) for w in (*sets[i], *t.needs, *t.without)})
    counts = frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    need = {label: math.ceil(threshold * len(s) - 1e-9) for label, s in sets.items()}
    ranked = {label: sorted(rank[w] for w in s) for label, s in sets.items()}
    prefix = {label: r[:len(r) - need[label] + 1] for label, r in ranked.items()}

    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair]) if rank else None
    gate = any_word([order[i] for i in sorted({i for p in prefix.values() for i in p})])

    def containment(label: int, block: Column, size: Column) -> Column:
        """Share of the template in a block (its ranks, rising, and its number of words), NULL if it does not hold it."""
        t, n = ranked[label], need[label]
        template = F.array(*map(F.lit, t))
        fits = F.lit(True)
        for w in templates[label].needs:
            fits = fits & F.array_contains(block, rank[w])
        for w in templates[label].without:
            fits = fits & ~F.array_contains(block, rank[w])

        def first_shared(at: Column) -> Column:
            # Words of the template and of the block from the first shared one on.
            left = F.when(at.isNotNull(), len(t) - F.array_position(template, at) + 1)
            right = F.size(block) - F.array_position(block, at) + 1
            shared = F.size(F.array_intersect(template, block))
            return F.when((F.least(left, right) >= n) & (shared >= n) & fits, shared / len(t))

        shares = F.filter(F.array(*map(F.lit, prefix[label])), lambda x: F.array_contains(block, x))
        return F.when((size >= n) & (F.size(shares) > 0), first_shared(F.get(shares, F.lit(0))))

    df = docs.select(F.col("doc_id").alias("doc_id"), whole_text().alias("_text"))
    df = df.withColumn("n_words", F.regexp_count("_text", F.lit(WORD + "+")).cast("long"))
    # Blocks of lines with a prefix word of some template in one of them, as sorted ranks beside the number of words.
    df = df.withColumn("_lines", F.when(F.col("_text").rlike(gate), F.split("_text", "\n")))
    marked = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(gate), i)), lambda i: i.isNotNull())
    places = F.array_distinct(F.flatten(F.transform(marked, lambda i: F.array(*[
        F.struct((i - back).alias("start"), F.lit(size).alias("size")) for size in range(1, span + 1) for back in range(size)]))))
    places = F.filter(places, lambda p: (p["start"] >= 0) & (p["start"] + p["size"] <= F.size("_lines")))
    df = df.withColumn("_block_words", F.transform(places, lambda p: F.array_distinct(_split(_lower(
        F.array_join(F.slice("_lines", p["start"] + 1, p["size"]), "\n"))))))
    df = df.withColumn("_blocks", F.transform("_block_words", lambda b: F.struct(
        F.array_sort(F.transform(F.filter(b, lambda w: w.isin(vocabulary)), lambda w: F.element_at(ranks, w))).alias("ranks"),
        F.size(b).alias("size"))))
    held = F.transform("_blocks", lambda b: F.array(*[
        F.struct(F.lit(templates[i].label).alias("label"), containment(i, b["ranks"], b["size"]).alias("share")) for i in sets]))
    df = df.withColumn("_held", F.filter(F.flatten(held), lambda x: x["share"].isNotNull()))
    base_phrases = list(phrases)
    for i, phrase in enumerate(base_phrases):
        df = df.withColumn(f"_has{i}", F.col("_text").rlike(stands(phrase)))
    some = F.greatest(*[F.col(f"_has{i}") for i in range(len(base_phrases))]) if len(base_phrases) > 1 else F.col("_has0")
    df = df.withColumn("_words", F.when(some, _split(_lower(F.col("_text")))))
    df = df.withColumn("_places", phrase_places(F.col("_words"), base_phrases))
    base = F.filter(F.array(*[F.when(F.col(f"_has{i}"), F.lit(phrases[p])) for i, p in enumerate(base_phrases)]),
                    lambda x: x.isNotNull())
    df = df.withColumn("_base", F.array_sort(F.array_distinct(base)))
    # One quick test for all names before each is looked for.
    any_name = F.lit(bool(names))
    for word in sorted(set.intersection(*[set(p.split()) for p in names])) if names else ():
        any_name = any_name & F.col("_text").rlike(f"(?i){re.escape(word)}")  # a word of every name
    if names:
        any_name = any_name & F.col("_text").rlike("|".join(map(stands, names)))
    named = F.filter(F.array(*[F.when(F.col("_text").rlike(stands(p)), F.lit(label)) for p, label in names.items()]).cast("array<string>"),
                     lambda x: x.isNotNull())
    df = df.withColumn("_named", F.when(any_name, named).otherwise(F.array().cast("array<string>")))
    added = F.concat(F.coalesce(F.transform("_held", lambda x: x["label"]), F.array().cast("array<string>")), F.col("_named"))
    return df.select(
        "doc_id", "n_words", F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("_places").cast("long").alias("first_word"), F.array_max("_places").cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", added))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_held", lambda x: x["share"])), F.when(F.size("_named") > 0, 1.0), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql(threshold: float = 0.8, span: int = 3) -> str:
    """The same result in DuckDB, every block of lines against every template."""
    word = "[^\\x00-/:-`{-\\x7f]+"
    templates = ", ".join(
        f"('{t.label}', {sorted(set(words_of(t.text)))}, {list(t.needs)}, {list(t.without)}::VARCHAR[])" for t in TEMPLATES)
    phrases = ", ".join(f"('{label}', {[*phrase.split()]})" for phrase, label in PHRASES.items())
    names = ", ".join(f"('{label}', {[*phrase.split()]})" for phrase, label in NAMES.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{word}') AS words FROM d),
phrases(label, p) AS (VALUES {phrases}),
names(label, p) AS (VALUES {names}),
templates(label, s, needs, without) AS (VALUES {templates}),
starts AS (SELECT r, words, unnest(range(0, len(words))) AS i FROM w),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS ls FROM starts, phrases
         WHERE words[i + 1:i + len(p)] = p GROUP BY r),
named AS (SELECT r, list(DISTINCT label) AS ls FROM starts, names WHERE words[i + 1] = p[1] AND words[i + 1:i + len(p)] = p GROUP BY r),
lines AS (SELECT r, string_split(t, chr(10)) AS ls FROM d),
wins AS (SELECT r, ls, z.s AS size, unnest(range(1, len(ls) + 1)) AS i FROM lines, (SELECT unnest(range(1, {span + 1})) AS s) z),
blocks AS (SELECT r, list_distinct(regexp_extract_all(array_to_string(ls[i:i + size - 1], chr(10)), '{word}')) AS b
           FROM wins WHERE i + size - 1 <= len(ls)),
held AS (SELECT r, max(c / len(s)) AS score, list(DISTINCT label) AS ls FROM (
           SELECT r, label, s, len(list_intersect(s, b)) AS c FROM blocks, templates
           WHERE list_has_all(b, needs) AND NOT list_has_any(b, without))
         WHERE c >= ceil({threshold} * len(s) - 1e-9) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_concat(coalesce(base.ls, []), coalesce(held.ls, [])), coalesce(named.ls, [])))), ','), '') AS labels,
  coalesce(held.score, CASE WHEN named.ls IS NOT NULL THEN 1.0 END, 0.0) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN held USING (r) LEFT JOIN named USING (r)"""


ORACLE = _sql()
