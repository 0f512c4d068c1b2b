"""License scans with DataFrame functions only: ordered signature rules behind a keyword prefilter.

Rules are hand-written (here and in ``license_rules``); names of licenses come in three forms of a mention.
A text becomes its lower-case words with single spaces.  From each rule's wordings follow a few words of
which every match has one; those of all rules, looked up in the text's words, decide whether any rule can
match at all.  In the texts that pass, a rule's own words and then its keyword decide whether its expression runs.  Detections carry a priority; one that lies inside a detection of higher priority, or inside a
longer one of its own, is suppressed.  Everything is a projection over one scan: no exchange, and each row by itself.

Cases: null and empty texts have no words and no labels; detections of one interval go by priority,
and those of equal priority on it all stay; repeated rows give repeated results; an empty table gives an
empty result; other columns are not read; letters beyond A-Z keep their case.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuboid.llm import common
from cuboid.llm.license_rules import covering, signatures

#: Base phrases, always reported.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: What parts words; A-Z are letters still when it is applied.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# Names: label, keyword, expression over single-spaced words; a space in front of all words and one behind them count for keywords.
_V = "(?:version |ver |v ?)?"
_NAMES = [
    ("gpl-1.0", "gnu", f"gnu general public license {_V}1(?: 0)?"),
    ("gpl-2.0", "gnu", f"gnu general public license {_V}2(?: 0)?"),
    ("gpl-3.0", "gnu", f"gnu general public license {_V}3(?: 0)?"),
    ("gpl-2.0-or-later", "gnu", f"gnu general public license {_V}2(?: 0)? or (?:any )?later"),
    ("gpl-3.0-or-later", "gnu", f"gnu general public license {_V}3(?: 0)? or (?:any )?later"),
    ("gpl-2.0", "gpl", "gpl ?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", "gpl ?v?3(?: 0)?"),
    ("lgpl", "gnu", "gnu lesser general public license"),
    ("lgpl-2.0", "gnu", f"gnu library general public license {_V}2(?: 0)?"),
    ("lgpl-2.1", "gnu", f"gnu lesser general public license {_V}2 1"),
    ("lgpl-3.0", "gnu", f"gnu lesser general public license {_V}3(?: 0)?"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2 1"),
    ("lgpl-3.0", "lgpl", "lgpl ?v?3(?: 0)?"),
    ("agpl-3.0", "affero", f"gnu affero general public license(?: {_V}3(?: 0)?)?"),
    ("agpl-3.0", "agpl", "agpl ?v?3(?: 0)?"),
    ("gfdl", "gnu", "gnu free documentation license"),
    ("apache-1.1", "apache", f"apache (?:software )?license {_V}1 1"),
    ("apache-2.0", "apache", f"apache (?:software )?license {_V}2(?: 0)?"),
    ("mit", " mit ", "mit license"),
    ("mit-0", " mit ", "mit no attribution(?: license)?"),
    ("x11", "x11", "x11 license"),
    ("isc", " isc ", "isc license"),
    ("bsd", "bsd", "bsd (?:style )?license"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)(?: license)?"),
    ("mpl-1.1", "mozilla", f"mozilla public license {_V}1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public license {_V}2(?: 0)?"),
    ("epl-1.0", "eclipse", f"eclipse public license {_V}1(?: 0)?"),
    ("epl-2.0", "eclipse", f"eclipse public license {_V}2(?: 0)?"),
    ("cddl-1.0", "cddl", f"cddl(?: {_V}1(?: 0)?)?"),
    ("cpl-1.0", "common public", f"common public license(?: {_V}1(?: 0)?)?"),
    ("eupl-1.2", "european union", f"european union public licen[cs]e(?: {_V}1 2)?"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("bsl-1.0", "boost", f"boost software license(?: {_V}1(?: 0)?)?"),
    ("artistic-1.0", "artistic", f"artistic license {_V}1(?: 0)?"),
    ("artistic-2.0", "artistic", f"artistic license {_V}2(?: 0)?"),
    ("psf-2.0", "python", f"python software foundation license(?: {_V}2(?: 0)?)?"),
    ("postgresql", "postgresql", "postgresql license"),
    ("ofl-1.1", "open font", f"(?:sil )?open font license(?: {_V}1 1)?"),
    ("odbl-1.0", "open database", f"open database license(?: {_V}1(?: 0)?)?"),
    ("odc-by", "open data commons", "open data commons attribution license"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-pdm", "public domain", "public domain mark(?: 1 0)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("openssl", "openssl", "openssl license"),
    ("php-3.01", "php", "php license(?: 3 0?1)?"),
    ("ms-pl", "microsoft", "microsoft public license"),
    ("rail", "openrail", "openrail(?: m)?(?: license)?"),
]
# Creative Commons: every combination of terms and version, in short and in long form.
_TERMS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nc": "attribution non ?commercial", "by-nd": "attribution no ?deriv(?:ative)?s?", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
for _t, _long in _TERMS.items():
    for _version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        _n = _version.replace(".", " ")
        _NAMES += [
            (f"cc-{_t}-{_version}", "cc by", f"cc {_t.replace('-', ' ')} {_n}"),
            (f"cc-{_t}-{_version}", "creative commons", f"creative commons {_long} (?:license )?{_n}(?: (?:international|unported|generic))?"),
        ]
# Forms of a mention: expression, priority.  A form that says more stands above one that says less.
_FORMS = (
    ("{0}", 2),
    ("(?:is |are )?licensed under (?:the )?(?:terms of (?:the )?)?{0}", 4),
    ("(?:released|distributed|published|available|provided) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{0}", 4),
)
# Sentences of the texts of licenses and of notices.
_TEXTS = (
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    ("isc", "fee is hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 5),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted", 5),
    ("bsd-3-clause", "endorse or promote", "neither the name of .{1,80}? may be used to endorse or promote products", 5),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation", 5),
    ("gpl", "warranty of", "without even the implied warranty of merchantability or fitness for a particular purpose", 1),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license", 5),
    ("mpl-2.0", "source code form", "this source code form is subject to the terms of the mozilla public license", 5),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 5),
    ("bsl-1.0", "accompanying file", "accompanying file license 1 0 txt or copy at", 5),
    ("zlib", "altered source", "altered source versions must be plainly marked as such", 5),
    ("public-domain", "public domain", "(?:released|placed|dedicated) (?:in)?to the public domain", 3),
    ("all-rights-reserved", "rights reserved", "all rights reserved", 1),
    ("copyright-notice", "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}", 1),
    ("proprietary", "proprietary", "proprietary and confidential", 2),
    ("no-warranty", " as is ", "provided as is without warranty", 1),
    ("spdx", "spdx", "spdx license identifier [a-z0-9]+(?: [0-9]){0,2}", 3),
)
#: (label, keyword, expression, priority), in the order of their priority.
RULES = sorted(
    [(label, word, form.format(name), p) for label, word, name in _NAMES for form, p in _FORMS] + [*_TEXTS, *signatures()],
    key=lambda r: -r[3],
)
TOP = max(r[3] for r in RULES)
#: Words of which every match of a rule's expression has one whole, by expression; none for those that leave too much open.
_COVER = {pattern: covering(pattern) for _, _, pattern, _ in RULES}
#: Of the base phrases one word each, too.
TRIGGERS = tuple(sorted({w for words in _COVER.values() for w in words or ()} | {phrase.split()[0] for phrase, _ in BASE}))
_UNCOVERED = tuple(sorted({word for _, word, pattern, _ in RULES if _COVER[pattern] is None}))
#: A text without any of these has no detection: whole words, and the keywords of rules that no words cover.
PREFILTER = tuple(f" {w} " for w in TRIGGERS) + _UNCOVERED


def _words_in(piece: Column) -> Column:
    """Words of a piece of the double-spaced text."""
    return F.floor((F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))) / 2).cast("long")


def _base(doubled: Column) -> Column:
    """For each base phrase the number of its places, the first and the last start."""
    out = []
    for phrase, label in BASE:
        n = len(phrase.split())
        pieces = F.split(doubled, f" {phrase.replace(' ', '  ')} ", -1)
        hits = (F.size(pieces) - 1).cast("long")
        before = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(0).cast("long"), lambda acc, p: acc + _words_in(p))
        found = F.when(hits > 0, F.struct(F.lit(label).alias("label"), hits.alias("n"), _words_in(pieces[0]).alias("first"), (before + n * (hits - 1)).alias("last")))
        out.append(found)
    return F.array_compact(F.array(*out))


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, though it stands in the body of other functions."""
    return F.transform(F.array(value), fn)[0]


def _detections(line: Column, present: Column) -> Column:
    """(start, -end, -priority, label) of every match of the rules that have one of their words in ``present``, and their keyword in the text."""
    by_word: dict[tuple, list[Column]] = {}
    for label, word, expression, priority in RULES:
        rule = F.struct(F.lit(label).alias("label"), F.lit(f"(?<= )(?:{expression})(?= )").alias("pattern"), F.lit(priority).alias("priority"))
        by_word.setdefault((word, _COVER[expression] or ()), []).append(rule)
    # Each keyword is looked for once, however many rules have it.
    none = F.array().cast("array<string>")
    groups = F.array(*(F.struct(F.lit(word).alias("word"), (F.array(*map(F.lit, cover)) if cover else none).alias("cover"), F.array(*rules).alias("rules")) for (word, cover), rules in by_word.items()))
    near = F.filter(groups, lambda g: ((F.size(g["cover"]) == 0) | F.arrays_overlap(g["cover"], present)) & F.contains(line, g["word"]))
    due = F.flatten(F.transform(near, lambda g: g["rules"]))

    def places(r: Column) -> Column:
        hits = F.regexp_extract_all(line, r["pattern"], F.lit(0))
        pairs = F.arrays_zip(F.split(line, r["pattern"], -1).alias("gap"), hits.alias("hit"))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,back:int,rank:int,label:string>>").alias("found"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + F.length(x["gap"])
            end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
            one = F.array(F.struct(start.alias("start"), (-end).alias("back"), (-r["priority"]).alias("rank"), r["label"].alias("label")))
            return F.struct(end.alias("at"), F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one)).alias("found"))

        return F.aggregate(pairs, empty, step, lambda acc: acc["found"])

    return F.array_sort(F.flatten(F.transform(due, places)))


def _kept(found: Column) -> Column:
    """Labels and the highest priority of detections that lie in none of higher priority, nor in a longer one of their own.

    ``found`` is sorted by start, then from the longest: of each priority the furthest end so far, and the start of the first
    detection that reached it, tell whether a detection lies in another one.
    """
    none = F.array_repeat(F.lit(-1), TOP + 2)
    empty = F.struct(none.alias("ends"), none.alias("starts"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        start, end, rank = x["start"], -x["back"], -x["rank"]
        own = F.element_at(acc["ends"], rank + 1)
        above = F.array_max(F.slice(acc["ends"], rank + 2, F.lit(TOP + 2)))
        inside = (above >= end) | (own > end) | ((own == end) & (F.element_at(acc["starts"], rank + 1) < start))
        further = end > own
        ends = F.transform(acc["ends"], lambda e, i: F.when((i == rank) & further, end).otherwise(e))
        starts = F.transform(acc["starts"], lambda e, i: F.when((i == rank) & further, start).otherwise(e))
        labels = F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x["label"])))
        best = F.when(inside, acc["best"]).otherwise(F.greatest(acc["best"], rank))
        return F.struct(ends.alias("ends"), starts.alias("starts"), labels.alias("labels"), best.alias("best"))

    return F.aggregate(found, empty, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of the base phrases, labels and a score (share of the highest priority reached)."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    words = common.texts(docs).select("doc_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SEPARATORS, " ")).alias("words"))
    # Those of the triggers that the text has; lower-case by more than A-Z, so at least as many.
    present = F.array_intersect(F.split(F.lower("words"), " ", -1), F.array(*map(F.lit, TRIGGERS)))
    n_words = F.when(F.col("words") == "", 0).otherwise(F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    listed = words.select("doc_id", n_words.cast("long").alias("n_words"), "words", present.alias("present"))
    low = F.concat(F.lit(" "), F.lower("words"), F.lit(" "))
    gate = F.size("present") > 0
    for word in _UNCOVERED:
        gate = gate | F.contains(low, F.lit(word))
    gated = listed.select("doc_id", "n_words", "present", F.when(gate, F.translate("words", upper, lower)).alias("line"))
    doubled = F.concat(F.lit("  "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit("  "))
    single = F.concat(F.lit(" "), F.col("line"), F.lit(" "))
    both = F.struct(single.alias("line"), F.col("present").alias("present"))
    more = _let(both, lambda x: _kept(_detections(x["line"], x["present"])))
    found = gated.select("doc_id", "n_words", F.when(F.col("line").isNotNull(), _let(doubled, _base)).alias("base"), F.when(F.col("line").isNotNull(), more).alias("more"))
    none = F.array().cast("array<string>")
    base_labels = F.array_sort(F.coalesce(F.transform("base", lambda x: x["label"]), none))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce("more.labels", none)))
    best = F.greatest(F.coalesce("more.best", F.lit(0)), F.when(F.size(base_labels) > 0, 2).otherwise(0))
    total = F.coalesce(F.aggregate("base", F.lit(0).cast("long"), lambda acc, x: acc + x["n"]), F.lit(0).cast("long"))
    return found.select(
        "doc_id", "n_words", total.alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["last"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        (best / TOP).cast("double").alias("score"),
    )


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))

