"""License detection by ordered signature rules, in DataFrame functions only.

Texts are compared as words: A-Z in lower case, runs of letters, digits and non-ASCII characters, one space between. A rule is a
regular expression over whole words with a label, a tier and a confidence. Rules are written as phrases around license names
and versions (``FAMILIES`` x ``FORMS``) and as a few full sentences (``SENTENCES``); some hundred expressions come out. Two gates keep them
from most texts: a text must hold one of a few general stems, and a rule is tried only where its keyword occurs, found by an
equi-join of the text's keywords with the rules.

Overlaps are resolved per text: a detection falls where another of the same or a higher tier covers its words (of equal
spans the higher tier stays, then the earlier rule). Sorted by start and falling end, whatever covers a detection stands before it, so
one running maximum of the end per tier decides, without comparing detections in pairs.

The base phrases are counted in every text apart from the rules, and their labels always stay. Null and empty texts have no
words, no labels and score zero. Repeated rows are labelled alike, rows that share a doc_id each by their own text. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringsight.llm.columns import ascii_lower, literal_table, once

#: Phrase -> label.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
BASE_SCORE = 0.6

#: Fixed values: (label, keyword, name as words, versions). A version is written as words, so 2.0 is "2 0".
FAMILIES = [
    ("apache", "apache", "apache", ("1 0", "1 1", "2 0", "2")),
    ("gpl", "gnu", "gnu general public", ("1", "2", "3", "1 0", "2 0", "3 0")),
    ("gpl", "gpl", "gpl", ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", "gnu", "gnu (?:lesser|library) general public", ("2", "2 1", "3", "3 0")),
    ("lgpl", "lgpl", "lgpl", ("2", "2 1", "3", "3 0")),
    ("agpl", "gnu", "gnu affero general public", ("1", "3", "3 0")),
    ("agpl", "agpl", "agpl", ("1", "3", "3 0")),
    ("gfdl", "gnu", "gnu free documentation", ("1 1", "1 2", "1 3")),
    ("mit", "mit", "mit", ()),
    ("mit", "expat", "expat", ()),
    ("x11", "x11", "x11", ()),
    ("bsd", "bsd", "bsd", ("2 clause", "3 clause", "4 clause", "0 clause")),
    ("bsd", "berkeley", "berkeley software distribution", ()),
    ("mpl", "mozilla", "mozilla public", ("1 0", "1 1", "2 0")),
    ("mpl", "mpl", "mpl", ("1 0", "1 1", "2 0")),
    ("epl", "eclipse", "eclipse public", ("1 0", "2 0")),
    ("epl", "epl", "epl", ("1 0", "2 0")),
    ("cddl", "cddl", "cddl", ("1 0", "1 1")),
    ("cddl", "distribution", "common development and distribution", ("1 0", "1 1")),
    ("cpl", "common", "common public", ("1 0",)),
    ("eupl", "eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("eupl", "union", "european union public", ("1 0", "1 1", "1 2")),
    ("ofl", "ofl", "(?:sil )?ofl", ("1 0", "1 1")),
    ("ofl", "font", "(?:sil )?open font", ("1 0", "1 1")),
    ("artistic", "artistic", "artistic", ("1 0", "2 0")),
    ("bsl", "boost", "boost software", ("1 0",)),
    ("busl", "business", "business source", ("1 0", "1 1")),
    ("isc", "isc", "isc", ()),
    ("zlib", "zlib", "zlib(?: libpng)?", ()),
    ("psf", "python", "python(?: software foundation)?", ("2", "2 0")),
    ("ruby", "ruby", "ruby", ()),
    ("php", "php", "php", ("3 0", "3 01")),
    ("openssl", "openssl", "openssl", ()),
    ("ms-pl", "microsoft", "microsoft public", ()),
    ("ms-rl", "microsoft", "microsoft reciprocal", ()),
    ("odbl", "odbl", "odbl", ("1 0",)),
    ("odbl", "database", "open (?:data commons open )?database", ("1 0",)),
    ("osl", "osl", "osl", ("1 0", "2 0", "2 1", "3 0")),
    ("osl", "open", "open software", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic", "academic free", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("ecl", "educational", "educational community", ("1 0", "2 0")),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ()),
    ("w3c", "w3c", "w3c(?: software)?", ()),
    ("wtfpl", "wtfpl", "wtfpl", ("2",)),
    ("cecill", "cecill", "cecill", ("1 0", "1 1", "2 0", "2 1")),
    ("postgresql", "postgresql", "postgresql", ()),
    ("cc-by", "cc", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by", "commons", "creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "commons", "creative commons attribution share ?alike", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "commons", "creative commons attribution non ?commercial", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "commons", "creative commons attribution no ?deriv(?:ative)?s?(?: works)?", ("1 0", "2 0", "2 5", "3 0", "4 0")),
]

#: Fixed values: (tier, confidence, expression with name, version and the rest of the phrase). {v} forms need a version.
FORMS = [
    (4, 1.0, "spdx license identifier {n} {v}(?: (?:only|or later))?"),
    (4, 1.0, "spdx license identifier {n}(?: (?:only|or later))?"),
    (3, 0.95, "(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{n}(?: international| unported)?(?: licen[cs]e)?(?: version| v)? {v}(?: (?:or|and) (?:any )?later(?: version)?)?"),
    (3, 0.9, "(?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[cs]e)?"),
    (2, 0.8, "{n}(?: public)?(?: licen[cs]e)?(?: version| v)? {v}(?: licen[cs]e)?"),
    (1, 0.6, "{n}(?: style| like)? licen[cs]e"),
]

#: Fixed values: (label, keyword, tier, confidence, expression).
SENTENCES = [
    ("mit", "permission", 5, 1.0, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", 5, 1.0, "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", 5, 1.0, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "redistribute", 5, 1.0, "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", 5, 1.0, "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache", "compliance", 5, 1.0, "you may not use this file except in compliance with the license"),
    ("unlicense", "encumbered", 5, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unencumbered", 5, 1.0, "this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense", 3, 0.9, "(?:the )?unlicense"),
    ("cc0", "cc0", 3, 0.9, "cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", "domain", 2, 0.7, "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("wtfpl", "wtfpl", 2, 0.8, "wtfpl"),
    ("proprietary", "reserved", 2, 0.6, "all rights reserved"),
    ("proprietary", "proprietary", 2, 0.6, "proprietary and confidential"),
    ("warranty", "warranty", 1, 0.4, "without warranty of any kind"),
]

#: Rules are tried on texts that hold one of these.
STEMS = ("licen", "spdx", "permission", "redistribut", "compliance", "encumbered", "cc0", "domain", "wtfpl", "reserved", "proprietary", "warranty")
TIERS = (1, 2, 3, 4, 5)
_MARK = "\x01"


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(order, keyword, expression, label, tier, confidence), every rule once."""
    found = []
    for label, keyword, name, versions in FAMILIES:
        for tier, confidence, form in FORMS:
            for version in versions if "{v}" in form else ("",):
                found.append((keyword, form.replace("{n}", name).replace("{v}", version), label, tier, confidence))
    found += [(keyword, phrase, label, tier, confidence) for label, keyword, tier, confidence, phrase in SENTENCES]
    unique = dict.fromkeys(found)
    return [(i, keyword, f" {phrase}(?= )", label, tier, confidence) for i, (keyword, phrase, label, tier, confidence) in enumerate(unique)]


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _prepare(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, its number of words, and its words where a stem occurs."""
    lowered = once(docs.select("doc_id", "text"), "_low", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    gate = reduce(lambda a, b: a | b, [F.contains("_low", F.lit(s)) for s in STEMS])
    plain = F.when(gate, F.concat(F.lit(" "), F.regexp_replace("_low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), F.lit(" ")))
    count = F.regexp_count("_low", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    hashed = F.xxhash64("_low").alias("_hash")
    return once(lowered.select("doc_id", hashed, count.cast("long").alias("n_words"), plain.alias("_plain")), "_text", F.regexp_replace("_plain", "^ +| +$", " ")).drop("_plain")


def base_places(prepared: DataFrame) -> DataFrame:
    """Counts and places of the base phrases."""
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        at = F.regexp_instr("_text", F.lit(f" {phrase}(?= )"))
        n = F.coalesce(F.regexp_count("_text", F.lit(f" {phrase}(?= )")), F.lit(0)).cast("long")
        counts.append(n)
        firsts.append(F.when(at > 0, _spaces(F.left("_text", at - 1)).cast("long")))
        lasts.append(F.when(at > 0, _spaces(F.regexp_extract("_text", f"(?s)^(.*) {phrase} ", 1)).cast("long")))
        labels.append(F.when(n > 0, F.lit(label)))
    known = F.array_sort(F.array_compact(F.array(*labels)))
    return prepared.select(
        "doc_id",
        "_hash",
        "n_words",
        reduce(lambda a, b: a + b, counts).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        known.alias("_base"),
    )


def detections(prepared: DataFrame, table: DataFrame) -> DataFrame:
    """(doc_id, _hash, order, label, tier, confidence, start, end): every match of every rule, in words, before suppression."""
    gated = prepared.filter("_text is not null")
    words = sorted({r[1] for r in rules()})
    has = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col("_text"), F.concat(F.lit(" "), w, F.lit(" "))))
    tried = gated.select("doc_id", "_hash", "_text", F.explode(has).alias("keyword")).join(table, "keyword")
    cut = F.split(F.regexp_replace(F.col("_text"), F.col("expression"), F.lit(f"{_MARK}$0{_MARK}")), _MARK)
    parts = tried.select("doc_id", "_hash", "order", "label", "tier", "confidence", cut.alias("parts")).filter(F.size("parts") > 1)
    counted = F.transform("parts", _spaces)
    each = parts.select("doc_id", "_hash", "order", "label", "tier", "confidence", F.posexplode(counted).alias("nth", "n")).distinct()
    run = Window.partitionBy("doc_id", "_hash", "order").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum("n").over(run)).filter("nth % 2 = 1")
    return placed.select("doc_id", "_hash", "order", "label", "tier", "confidence", (F.col("end") - F.col("n")).alias("start"), "end")


def surviving(found: DataFrame) -> DataFrame:
    """Detections that no other of the same or a higher tier covers."""
    order = (F.col("start"), F.col("end").desc(), F.col("tier").desc(), F.col("order"))
    before = Window.partitionBy("doc_id", "_hash").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = [F.max(F.when(F.col("tier") >= t, F.col("end"))).over(before) for t in TIERS]
    own = F.get(F.array(*reach), F.col("tier") - 1)
    return found.withColumn("_reach", own).filter("_reach is null or _reach < end").drop("_reach")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, for every row."""
    spark: SparkSession = docs.sparkSession
    table = literal_table(spark, ("order", "keyword", "expression", "label", "tier", "confidence"), rules())
    prepared = _prepare(docs)
    kept = surviving(detections(prepared, table))
    own = kept.groupBy("doc_id", "_hash").agg(F.collect_set("label").alias("_own"), F.max("confidence").alias("_best"))
    own = own.select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_own", "_best")
    joined = base_places(prepared).join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_h")), "left")
    nothing = F.array().cast("array<string>")
    labels = F.array_sort(F.array_distinct(F.concat(F.col("_base"), F.coalesce("_own", nothing))))
    score = F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(BASE_SCORE)).otherwise(0.0))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
