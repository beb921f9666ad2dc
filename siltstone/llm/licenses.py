"""License scan: sparse TF-IDF cosine of statements and licence files to templates, and inheritance from directories."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, load

#: Statements and openings of common licences: fixed values that texts are compared with.
TEMPLATES = [
    ("MIT", "released under the mit license"),
    ("MIT", "licensed under the mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "licensed under the apache license version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("GPL-3.0", "this work is licensed under the gnu general public license version 3"),
    ("GPL-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0"),
    ("CC-BY-NC-4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("MPL-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
]
#: Least cosine of a match, and least share of a document's words in matching statements that makes it its directory's licence file.
LEAST_COSINE, FILE_SHARE = 0.75, 0.3
#: Parts that the documents of a directory are dealt to.
SALTS = 64
#: Names of licence files; a licence file covers its directory. Fixed values.
FILE_NAMES = r"(?i)^(license|licence|copying|notice|unlicense)([._-].*)?$"
#: Words that most English texts hold; only the order in which words are chosen depends on them. Fixed values.
ORDINARY = frozenset("a and any are at be by can except file following for form in is it may not obtain of or person provided that the this to under use with without work you".split())
#: Least sum of squares of a template's unit vector over the words that a match shares with it (a little less, for rounding).
LEAST_SHARED = LEAST_COSINE**2 - 1e-6
#: Ends of paragraphs (a line without letters and digits lies between) and of statements; comment marks that are words.
PARAGRAPH, STATEMENT, MARKS = r"\n[^\p{L}\p{N}\n]*\n[^\p{L}\p{N}]*", r"\n|(?<=[.;])\s+(?=\p{Lu})", r"(?im)^[ \t]*(?:rem|dnl)[ \t]"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def weights() -> tuple[dict[str, float], list[dict[str, float]], float]:
    """(inverse document frequency by word, unit vector of each template, frequency weight of words in no template)."""
    bags = [re.findall(TOKEN, text) for _, text in TEMPLATES]
    idf = {w: math.log((1 + len(bags)) / (1 + sum(w in b for b in bags))) + 1 for b in bags for w in b}
    vectors = []
    for b in bags:
        v = {w: b.count(w) * idf[w] for w in b}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / size for w, x in v.items()})
    return idf, vectors, math.log(1 + len(bags)) + 1


def needed_words(vector: dict[str, float]) -> list[str]:
    """Words of which any text holds one if its cosine to the template of this unit vector is LEAST_COSINE or more.

    A cosine is at most the root of the sum of squares of the template's unit vector over the words that the text shares with
    it (Cauchy-Schwarz). So words are taken until those left sum to less: heaviest and longest first, ordinary ones last.
    """
    out, left = [], 1.0
    for w in sorted(vector, key=lambda w: (w in ORDINARY, -round(vector[w], 9), -len(w), w)):
        if left < LEAST_SHARED:
            break
        out.append(w)
        left -= vector[w] ** 2
    return out


def all_needed() -> list[str]:
    return sorted({w for v in weights()[1] for w in needed_words(v)})


def may_match(statement: Column) -> Column:
    """Whether a text has one of the words without which no template is matched; true of each text that matches."""
    return F.lower(statement).rlike(f"(?<![a-z0-9])(?:{'|'.join(map(re.escape, all_needed()))})(?![a-z0-9])")


def matches(paragraph: Column) -> Column:
    """Of a paragraph, a struct of `parts` (words of each statement) and `words`: an array of what matches, struct(best, at).

    best is struct(score, first, name) and at the places of the words that match. Statements are compared with all templates;
    windows with the template that has as many words. A window is passed over only if it has none of the template's needed
    words, or shares too little with it for the cosine to reach the threshold.
    """
    idf, vectors, other = weights()
    parts, words = paragraph["parts"], paragraph["words"]
    table = lambda v: F.create_map(*[F.lit(x) for pair in v.items() for x in pair])
    listed = lambda v: F.array(*map(F.lit, v))

    def once(value: Column, use) -> Column:
        """use(value), with value worked out once and not for each element of a lambda's array."""
        return F.get(F.transform(F.array(value), use), 0)

    def weighed(some: Column) -> Column:
        """(word, count times inverse document frequency): in sorted words, a word's count is the distance to the next one's beginning."""
        def runs(s: Column) -> Column:
            begins = F.filter(F.transform(s, lambda w, k: F.when((k == 0) | (F.get(s, k - 1) != w), k)), lambda k: k.isNotNull())
            row = lambda p, k, begins: F.struct(F.get(s, p).alias("w"), ((F.coalesce(F.get(begins, k + 1), F.size(s)) - p) * F.coalesce(F.try_element_at(table(idf), F.get(s, p)), F.lit(other))).alias("x"))
            return once(begins, lambda b: F.transform(b, lambda p, k: row(p, k, b)))

        return once(F.array_sort(some), runs)

    def score(bag: Column, i: int) -> Column:
        size = F.sqrt(F.aggregate(bag, F.lit(0.0), lambda a, k: a + k["x"] * k["x"]))
        return F.struct(F.round(F.aggregate(bag, F.lit(0.0), lambda a, k: a + k["x"] * F.coalesce(F.try_element_at(table(vectors[i]), k["w"]), F.lit(0.0))) / size, 9).alias("score"), F.lit(-i).alias("first"), F.lit(TEMPLATES[i][0]).alias("name"))

    def shared(some: Column, v: dict[str, float]) -> Column:
        return F.aggregate(F.array_intersect(some, listed(v)), F.lit(0.0), lambda a, w: a + F.pow(F.try_element_at(table(v), w), F.lit(2.0))) >= LEAST_SHARED

    def within(i: int) -> Column:
        v, n = vectors[i], len(re.findall(TOKEN, TEMPLATES[i][1]))
        last = F.greatest(F.size(words) - n + 1, F.lit(1))
        near = F.filter(F.when(shared(words, v), F.transform(words, lambda w, k: F.when(F.array_contains(listed(needed_words(v)), w), k + 1))).otherwise(F.array().cast("array<int>")), lambda p: p.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(near, lambda p: F.sequence(F.greatest(p - n + 1, F.lit(1)), F.least(p, last)))))
        windows = F.filter(F.transform(starts, lambda p: F.struct(p.alias("p"), F.slice(words, p, n).alias("s"))), lambda x: shared(x["s"], v))
        places = lambda x: F.filter(F.transform(x["s"], lambda w, k: F.when(F.array_contains(listed(v), w), x["p"] + k)), lambda p: p.isNotNull())
        bags = F.transform(windows, lambda x: F.struct(weighed(x["s"]).alias("bag"), places(x).alias("at")))
        return F.transform(bags, lambda x: F.struct(score(x["bag"], i).alias("best"), x["at"].alias("at")))

    placed = F.transform(parts, lambda s, k: F.struct(s.alias("s"), F.size(F.flatten(F.slice(parts, F.lit(1), k))).alias("p")))
    stated = F.filter(placed, lambda x: F.arrays_overlap(x["s"], listed(all_needed())))
    bags = F.transform(stated, lambda x: F.struct(weighed(x["s"]).alias("bag"), F.sequence(x["p"] + 1, x["p"] + F.size(x["s"])).alias("at")))
    lines = F.transform(bags, lambda x: F.struct(F.array_max(F.array(*[score(x["bag"], i) for i in range(len(TEMPLATES))])).alias("best"), x["at"].alias("at")))
    return F.filter(F.concat(lines, *map(within, range(len(TEMPLATES)))), lambda m: m["best"]["score"] >= LEAST_COSINE)


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", path: Column, text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, path, own_license, own_score, license, inherited_from. DataFrame functions only.

    Whole texts are cut into paragraphs, and these into statements at line ends and after full stops; as statements also
    wrap and run on, each window of a paragraph of as many words as a template has is compared with that template too, across
    line ends and comment marks. Words are counted, weighted by inverse document frequency in the templates, and the cosine is
    computed from the own words of a statement or window, sparse, in a projection (the templates are a fixed table of a few
    dozen words). Only what can't reach the threshold, as its words show, is not compared. A document's
    licence is that of its best statement or window of cosine 0.75 or more; ties go to the name first in order. A licence file is a
    document of such a name, or one of whose words 30 % are matched; it covers its directory. A document
    without a licence of its own has that of the nearest directory above that one covers (of several the most frequent, then
    the first by name): its ancestors are joined with the covered directories by path.

    Null or empty texts have no licence of their own; a null path inherits nothing. Rows that repeat an id or a path are rows
    of their own. Extra columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), path.alias("path"), text.alias("_text"))
    words = lambda s: F.regexp_extract_all(F.lower(s), F.lit(f"({TOKEN})"), F.lit(1))
    cut = F.transform(F.filter(F.split("_text", PARAGRAPH), may_match), lambda p: F.transform(F.split(F.regexp_replace(p, MARKS, ""), STATEMENT), words))
    found = F.transform(F.transform(cut, lambda parts: F.struct(parts.alias("parts"), F.flatten(parts).alias("words"))), matches)
    each = F.transform(found, lambda m: F.struct(F.array_max(F.transform(m, lambda x: x["best"])).alias("best"), F.size(F.array_distinct(F.flatten(F.transform(m, lambda x: x["at"])))).alias("n")))
    looked = docs.withColumn("_found", F.filter(each, lambda m: m["n"] > 0))
    best = F.array_max(F.transform("_found", lambda m: m["best"]))
    inside = F.aggregate("_found", F.lit(0), lambda a, m: a + m["n"])
    parts = F.split("path", "/")
    own = Scratch(df.sparkSession, "licenses").keep(looked.select("doc_id", "path", best["name"].alias("own_license"), best["score"].alias("own_score"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("_dir"),
                        ((inside > 0) & ((inside >= FILE_SHARE * F.regexp_count("_text", F.lit(r"\S+"))) | F.element_at(parts, -1).rlike(FILE_NAMES))).alias("_file")), "own")  # texts are compared once

    counted = own.where("_file and path is not null").groupBy("_dir", "own_license").agg(F.count(F.lit(1)).alias("n"))
    covered = counted.groupBy("_dir").agg(F.min_by("own_license", F.struct(-F.col("n"), "own_license")).alias("_license"))
    dirs = own.where("path is not null").select("_dir").distinct()
    levels = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(levels)), lambda k: F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), k), "/"))).alias("_above")).distinct()
    nearest = above.join(covered.withColumnRenamed("_dir", "_above"), "_above").groupBy("_dir").agg(F.max_by(F.struct("_above", "_license"), F.length("_above")).alias("_near"))
    salt = F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS)).cast("int")  # so that a directory of very many documents is no single task
    nearest = nearest.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = own.withColumn("_salt", salt).join(nearest, ["_dir", "_salt"], "left")
    inherits = F.col("own_license").isNull() & F.col("path").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", F.when(inherits, F.col("_near._license"))).alias("license"), F.when(inherits, F.col("_near._above")).alias("inherited_from"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(load(spark, sf_dir, "documents"), path=path)
