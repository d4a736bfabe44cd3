"""License scans: ordered signature rules over words, in DataFrame functions alone.

A text is lower-cased (A-Z only) and written as its words in angle brackets, '<mit><license>', so that every pattern
begins and ends at words and places are counted by brackets. A rule has a label, a priority, a weight, keywords and a
pattern. The keywords are looked for first: a rule runs on a text only if the text contains all of them, and most texts
contain none. The detections of a text are then resolved:

* one that lies within another of the same priority is dropped (of equal ones, all but the first rule's), and
* one that shares a word with another of higher priority is dropped,

judged on all detections of the text, not on those left. Detections are sorted once and swept forwards and backwards in
runs of `RUN`, with the furthest end (the nearest start) of each priority carried along, so no pairs are formed. Everything
happens within the row: there is no shuffle, and nothing is gathered across rows.

Base places of three phrases are counted apart and always give their labels. The score is the largest weight of a
detection that is left, 0 without one.

Defined cases: a null text counts as an empty one; an empty text, or one without words, has no words, no places, empty
labels, null first and last word and score 0. Texts of any length are read whole. Repeated rows, rows of one doc_id and
rows without one are judged alike, row by row. Detections of equal place and priority are settled by the order of the
rules. Other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Priorities: a vague mention, a name, a granting sentence, a license's own text, a machine-readable tag.
VAGUE, NAME, GRANT, TEXT, TAG = range(5)
LEVELS = 5
WEIGHTS = {VAGUE: 0.3, NAME: 0.8, GRANT: 0.9, TEXT: 0.95, TAG: 1.0}
#: Detections that one sweep takes before the carried ends are worked out anew.
RUN = 512


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    #: Parts of the bracketed text that the text must contain.
    keywords: tuple[str, ...]
    pattern: str
    weight: float


def compiled(words: str) -> str:
    """A pattern over words as a regular expression over the bracketed text.

    Each part is a regular expression for one word; '~' before it makes it optional, and '*4' stands for up to four words.
    """
    out = []
    for part in words.split():
        if re.fullmatch(r"\*[0-9]+", part):
            out.append(f"(?:<[^>]*>){{0,{part[1:]}}}")
        elif part.startswith("~"):
            out.append(f"(?:<{part[1:]}>)?")
        else:
            out.append(f"<{part}>")
    return "".join(out)


V = "~(version|v|ver)"
#: Names of licenses: label, keywords besides 'licen' (or instead of it, where they begin with '!'), the name.
NAMES = (
    ("mit", "<mit>", "mit licen[sc]e"),
    ("mit", "<expat>", "expat licen[sc]e"),
    ("mit-0", "!<no><attribution>", "mit no attribution ~licen[sc]e"),
    ("x11", "<x11>", "x11 licen[sc]e"),
    ("isc", "<isc>", "isc licen[sc]e"),
    ("apache-1.0", "<apache>", f"apache ~software licen[sc]e {V} (1|v1) 0"),
    ("apache-1.1", "<apache>", f"apache ~software licen[sc]e {V} (1|v1) 1"),
    ("apache-2.0", "<apache>", f"apache ~software licen[sc]e {V} (2|v2) ~0"),
    ("apache-2.0", "<apache>", "apache (2|v2) ~0 ~software licen[sc]e"),
    ("apache", "<apache>", "apache ~software licen[sc]e"),
    ("gpl-1.0", "<general><public>", f"~gnu general public licen[sc]e {V} (1|v1) ~0"),
    ("gpl-2.0", "<general><public>", f"~gnu general public licen[sc]e {V} (2|v2) ~0"),
    ("gpl-3.0", "<general><public>", f"~gnu general public licen[sc]e {V} (3|v3) ~0"),
    ("gpl-2.0-or-later", "<general><public>", f"~gnu general public licen[sc]e {V} (2|v2) ~0 or ~at ~your ~option ~any ~(later|newer|higher) ~version"),
    ("gpl-3.0-or-later", "<general><public>", f"~gnu general public licen[sc]e {V} (3|v3) ~0 or ~at ~your ~option ~any ~(later|newer|higher) ~version"),
    ("gpl", "<general><public>", "~gnu general public licen[sc]e"),
    ("gpl", "!<gnu><gpl>", "gnu gpl"),
    ("gpl-2.0", "!<gplv2>", "~gnu gplv2"),
    ("gpl-3.0", "!<gplv3>", "~gnu gplv3"),
    ("lgpl-2.0", "<general><public>", f"~gnu (lesser|library) general public licen[sc]e {V} (2|v2) ~0"),
    ("lgpl-2.1", "<general><public>", f"~gnu (lesser|library) general public licen[sc]e {V} (2|v2) 1"),
    ("lgpl-3.0", "<general><public>", f"~gnu (lesser|library) general public licen[sc]e {V} (3|v3) ~0"),
    ("lgpl", "<general><public>", "~gnu (lesser|library) general public licen[sc]e"),
    ("agpl-3.0", "<affero>", f"~gnu affero general public licen[sc]e {V} (3|v3) ~0"),
    ("agpl", "<affero>", "~gnu affero general public licen[sc]e"),
    ("gfdl-1.3", "<documentation>", f"~gnu free documentation licen[sc]e {V} (1|v1) 3"),
    ("gfdl", "<documentation>", "~gnu free documentation licen[sc]e"),
    ("bsd-2-clause", "<bsd>", "(2|two) clause bsd ~style licen[sc]e"),
    ("bsd-3-clause", "<bsd>", "(3|three) clause bsd ~style licen[sc]e"),
    ("bsd-4-clause", "<bsd>", "(4|four) clause bsd ~style licen[sc]e"),
    ("bsd-2-clause", "<bsd>", "(simplified|freebsd) bsd licen[sc]e"),
    ("bsd-3-clause", "<bsd>", "(modified|revised|new) bsd licen[sc]e"),
    ("0bsd", "<bsd>", "zero clause bsd licen[sc]e"),
    ("bsd", "<bsd>", "bsd ~style licen[sc]e"),
    ("mpl-1.0", "<mozilla>", f"mozilla public licen[sc]e {V} (1|v1) 0"),
    ("mpl-1.1", "<mozilla>", f"mozilla public licen[sc]e {V} (1|v1) 1"),
    ("mpl-2.0", "<mozilla>", f"mozilla public licen[sc]e {V} (2|v2) ~0"),
    ("mpl", "<mozilla>", "mozilla public licen[sc]e"),
    ("epl-1.0", "<eclipse>", f"eclipse public licen[sc]e {V} (1|v1) ~0"),
    ("epl-2.0", "<eclipse>", f"eclipse public licen[sc]e {V} (2|v2) ~0"),
    ("epl", "<eclipse>", "eclipse public licen[sc]e"),
    ("eupl-1.2", "<european>", f"european union public licen[sc]e {V} (1|v1) 2"),
    ("eupl", "<european>", "european union public licen[sc]e"),
    ("cddl-1.0", "<distribution>", f"common development and distribution licen[sc]e {V} (1|v1) 0"),
    ("cddl", "<distribution>", "common development and distribution licen[sc]e"),
    ("cpl-1.0", "<common><public>", f"common public licen[sc]e {V} (1|v1) 0"),
    ("cpal-1.0", "<common><public>", "common public attribution licen[sc]e"),
    ("osl-3.0", "<open><software>", f"open software licen[sc]e {V} (3|v3) 0"),
    ("osl", "<open><software>", "open software licen[sc]e"),
    ("afl-3.0", "<academic>", f"academic free licen[sc]e {V} (3|v3) 0"),
    ("afl", "<academic>", "academic free licen[sc]e"),
    ("artistic-1.0", "<artistic>", f"artistic licen[sc]e {V} (1|v1) 0"),
    ("artistic-2.0", "<artistic>", f"artistic licen[sc]e {V} (2|v2) ~0"),
    ("artistic", "<artistic>", "artistic licen[sc]e"),
    ("bsl-1.0", "<boost>", "boost software licen[sc]e"),
    ("busl-1.1", "<business>", "business source licen[sc]e"),
    ("sspl-1.0", "<server><side>", "server side public licen[sc]e"),
    ("elastic-2.0", "<elastic>", f"elastic licen[sc]e {V} (2|v2) ~0"),
    ("unlicense", "<unlicense>", "the unlicense"),
    ("wtfpl", "!<wtfpl>", "wtfpl"),
    ("zlib", "<zlib>", "zlib ~libpng licen[sc]e"),
    ("libpng", "<libpng>", "libpng licen[sc]e"),
    ("ftl", "<freetype>", "freetype ~project licen[sc]e"),
    ("psf-2.0", "<python>", "python software foundation licen[sc]e"),
    ("php-3.01", "<php>", f"php licen[sc]e {V} (3|v3) 01"),
    ("php", "<php>", "php licen[sc]e"),
    ("ruby", "<ruby>", "ruby licen[sc]e"),
    ("ncsa", "<ncsa>", "~university ~of ~illinois ncsa ~open ~source licen[sc]e"),
    ("postgresql", "<postgresql>", "postgresql licen[sc]e"),
    ("ofl-1.1", "<open><font>", "~sil open font licen[sc]e"),
    ("odbl-1.0", "<open><database>", "open database licen[sc]e"),
    ("odc-by-1.0", "<open><data>", "open data commons attribution licen[sc]e"),
    ("pddl-1.0", "<public><domain>", "~open ~data ~commons public domain dedication and licen[sc]e"),
    ("cecill", "<cecill>", "cecill ~free ~software licen[sc]e"),
    ("ms-pl", "<microsoft>", "microsoft public licen[sc]e"),
    ("ms-rl", "<microsoft>", "microsoft reciprocal licen[sc]e"),
    ("openssl", "<openssl>", "openssl licen[sc]e"),
    ("vim", "<vim>", "vim licen[sc]e"),
    ("llama", "<llama>", "llama ~[0-9] ~[0-9] community licen[sc]e ~agreement"),
    ("openrail", "<rail>", "~creativeml open rail ~m licen[sc]e"),
    ("ogl-uk-3.0", "<open><government>", f"open government licen[sc]e {V} (3|v3) ~0"),
    ("ogl-uk", "<open><government>", "open government licen[sc]e"),
)

#: Creative Commons: the parts of each license beside attribution, as words of its name and of its short form.
COMMONS = (
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ~alike", "by sa"),
    ("cc-by-sa", "attribution sharealike", "by sa"),
    ("cc-by-nc", "attribution non ~commercial", "by nc"),
    ("cc-by-nc", "attribution noncommercial", "by nc"),
    ("cc-by-nd", "attribution no ~derivatives", "by nd"),
    ("cc-by-nd", "attribution noderiv(ative)?s", "by nd"),
    ("cc-by-nc-sa", "attribution noncommercial sharealike", "by nc sa"),
    ("cc-by-nc-sa", "attribution non commercial share alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution noncommercial noderiv(ative)?s", "by nc nd"),
    ("cc-by-nc-nd", "attribution non commercial no derivatives", "by nc nd"),
)

#: Tags: label and the words of its identifier, after 'SPDX-License-Identifier' or 'license'.
TAGS = tuple(
    (label, label.replace("-", " ").replace(".", " "))
    for label in (
        *("mit", "mit-0", "x11", "isc", "apache-1.0", "apache-1.1", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "mpl-1.1", "mpl-2.0", "epl-1.0", "epl-2.0", "eupl-1.2", "cddl-1.0", "cpl-1.0", "osl-3.0", "afl-3.0"),
        *("artistic-1.0", "artistic-2.0", "bsl-1.0", "busl-1.1", "sspl-1.0", "elastic-2.0", "unlicense", "wtfpl", "zlib", "libpng", "ftl", "psf-2.0", "php-3.01", "ncsa", "postgresql", "ofl-1.1", "odbl-1.0", "odc-by-1.0", "pddl-1.0", "cecill-2.1"),
        *("ms-pl", "ms-rl", "openssl", "vim", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "cc-by-nc-sa-4.0", "cc-by-nc-nd-4.0", "gfdl-1.3", "gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0"),
    )
)

#: Addresses of license texts.
ADDRESSES = (
    ("mit", "<opensource>", "opensource org licenses? mit ~license"),
    ("apache-2.0", "<apache>", "apache org licenses license 2 0"),
    ("bsd-3-clause", "<opensource>", "opensource org licenses? bsd (3|license)"),
    ("bsd-2-clause", "<opensource>", "opensource org licenses? bsd 2"),
    ("gpl-3.0", "<gnu>", "gnu org licenses gpl 3 0"),
    ("gpl-2.0", "<gnu>", "gnu org licenses ~old ~licenses gpl 2 0"),
    ("gpl", "<gnu>", "gnu org licenses ~gpl ~html"),
    ("lgpl", "<gnu>", "gnu org licenses lgpl"),
    ("agpl", "<gnu>", "gnu org licenses agpl"),
    ("gfdl", "<gnu>", "gnu org licenses fdl"),
    ("mpl-2.0", "<mozilla>", "mozilla org mpl 2 0"),
    ("epl-2.0", "<eclipse>", "eclipse org legal epl 2 0"),
    ("cc0-1.0", "<creativecommons>", "creativecommons org publicdomain zero"),
    ("unlicense", "<unlicense>", "unlicense org"),
    ("ofl-1.1", "<sil>", "scripts sil org ofl"),
)

#: Sentences of the licenses' own texts: label, keywords, words.
SENTENCES = (
    ("mit", ("permission", "<charge>"), "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("permission", "<substantial>"), "the above copyright notice and this permission notice ~shall ~be included in all copies or substantial portions of the software"),
    ("isc", ("permission", "<fee>"), "permission to use copy modify and ~or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", ("redistribut", "<binary>"), "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", ("<endorse>", "<promote>"), "neither the names? of *12 may be used to endorse or promote products"),
    ("bsd-4-clause", ("<advertising>",), "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", ("licen", "<obtain>"), "you may not use this file except in compliance with the license you may obtain a copy of the license at *8 licenses license 2 0"),
    ("apache-2.0", ("licen", "<apache>"), "licensed under the apache license version 2 0 the license"),
    ("apache-2.0", ("licen", "<compliance>"), "you may not use this file except in compliance with the license"),
    ("gpl-2.0-or-later", ("licen", "<foundation>"), "terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", ("licen", "<foundation>"), "terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", ("licen", "<foundation>"), "terms of the gnu general public license as published by the free software foundation"),
    ("gpl", ("licen", "<received>"), "you should have received a copy of the gnu general public license along with"),
    ("lgpl", ("licen", "<foundation>"), "terms of the gnu (lesser|library) general public license as published by the free software foundation"),
    ("lgpl", ("licen", "<received>"), "you should have received a copy of the gnu (lesser|library) general public license along with"),
    ("agpl", ("licen", "<affero>"), "terms of the gnu affero general public license as published by the free software foundation"),
    ("gfdl", ("permission", "<documentation>"), "permission is granted to copy distribute and ~or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", ("licen", "<mozilla>"), "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", ("licen", "<mozilla>"), "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", ("licen", "<accompanying>"), "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", ("licen", "<distribution>"), "the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", ("permission", "<organization>"), "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", ("warrant", "<implied>"), "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", ("permission", "<anyone>"), "permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("unlicense", ("<unencumbered>",), "this is free and unencumbered software released into the public domain"),
    ("wtfpl", ("<fuck>",), "do what the fuck you want to"),
    ("cc0-1.0", ("<dedicated>",), "has dedicated the work to the public domain"),
    ("cc0-1.0", ("<waive",), "waived all copyright and related or neighboring rights"),
    ("public-domain", ("<public><domain>",), "(placed|released|dedicated|is) *2 (in|into|to) the public domain"),
    ("ofl-1.1", ("licen", "<font>"), "this font software is licensed under the sil open font license"),
    ("openssl", ("<openssl>",), "this product includes software developed by the openssl project"),
    ("php", ("licen", "<php>"), "this source file is subject to version 3 ~0 ~01 of the php license"),
    ("artistic", ("<artistic>",), "under the same terms as perl itself *12 artistic"),
    ("ncsa", ("<burdens>",), "to deal with the software without restriction *30 burdens"),
    ("proprietary", ("<confidential>",), "proprietary and confidential"),
    ("proprietary", ("<strictly>", "prohibited"), "unauthori[sz]ed copying of this file *4 is strictly prohibited"),
)

#: Mentions that name no license.
MENTIONS = (
    ("unknown", ("licen",), "(licensed|released|distributed|available|published) under *6 licen[sc]e"),
    ("unknown", ("lizenz",), "(lizenziert|veröffentlicht) unter *6 lizenz"),
    ("unknown", ("licen",), "(publié|publiée|distribué|distribuée) sous *4 licence"),
    ("unknown", ("licen",), "(publicado|publicada|distribuido|distribuida) bajo *4 licencia"),
)

GRANTING = "(licensed|released|distributed|available|published|provided|covered|redistribute|use) *3 (under|by|with) *6"


def default_rules() -> tuple[Rule, ...]:
    """All rules, in order: names and the sentences that grant them, tags, addresses, sentences of the texts, mentions."""
    out: list[Rule] = []

    def add(label: str, priority: int, keywords: tuple[str, ...], words: str) -> None:
        out.append(Rule(label, priority, keywords, compiled(words), WEIGHTS[priority]))

    for label, keyword, name in NAMES:
        keywords = (keyword[1:],) if keyword.startswith("!") else ("licen", keyword)
        add(label, NAME, keywords, name)
        add(label, GRANT, keywords, f"{GRANTING} {name}")
    for label, name, short in COMMONS:
        for version in ("4 0", "3 0", "2 0", ""):
            own = label + (f"-{version.replace(' ', '.')}" if version else "")
            add(own, NAME, ("<creative><commons>",), f"creative commons {name} ~international ~unported {version} ~international ~unported ~licen[sc]e")
    for label, short in dict.fromkeys((label, short) for label, _, short in COMMONS):
        for version in ("4 0", "3 0", "2 0"):
            add(f"{label}-{version.replace(' ', '.')}", NAME, ("<cc><by>",), f"cc {short} {version}")
        for version in ("4 0", "3 0", "2 0", ""):
            add(label + (f"-{version.replace(' ', '.')}" if version else ""), NAME, ("<cc><by>", "licen"), f"licen[sc]ed? ~under ~(a|the) cc {short} {version}")
        for version in ("4 0", "3 0", "2 0"):
            add(f"{label}-{version.replace(' ', '.')}", TAG, ("<creativecommons>",), f"creativecommons org licenses {short} {version}")
    add("cc0-1.0", NAME, ("<cc0>",), "cc0 ~1 ~0 ~universal")
    for label, words in TAGS:
        first = words.split()[0]
        add(label, TAG, ("<spdx>", f"<{first}>"), f"spdx license identifier {words} ~or ~(later|only)")
        add(label, NAME, ("licen", f"<{first}>"), f"licen[sc]e {words}")
    for label, keyword, words in ADDRESSES:
        add(label, TAG, ("licen", keyword) if "licens" in words else (keyword,), words)
    for label, keywords, words in SENTENCES:
        add(label, TEXT, keywords, words)
    for label, keywords, words in MENTIONS:
        add(label, VAGUE, keywords, words)
    return tuple(out)


RULES = default_rules()


def bracketed(text: Column) -> Column:
    """The words of a text, lower-cased from A to Z, in angle brackets; a null text is an empty one."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.replace(F.concat(F.lit("<"), F.regexp_replace(lowered, NOT_WORD, "><"), F.lit(">")), F.lit("<>"), F.lit(""))


def n_words(words: Column) -> Column:
    return (F.octet_length(words) - F.octet_length(F.replace(words, F.lit("<"), F.lit("")))).cast("long")


def phrase(words: str) -> str:
    return "".join(f"<{w}>" for w in words.split())


def base_columns(words: Column) -> dict[str, Column]:
    """n_base, first_word, last_word and base: the labels, sorted, as an array."""
    counts, firsts, lasts, labels = [], [], [], []
    for p, label in BASE:
        text = phrase(p)
        there = words.contains(text)
        counts.append(F.when(there, F.regexp_count(words, F.lit(text)).cast("long")).otherwise(F.lit(0)))
        firsts.append(F.when(there, n_words(F.substring(words, F.lit(1), F.instr(words, text) - 1))))
        after = F.instr(F.reverse(words), text[::-1]) - 1  # characters behind the last place
        lasts.append(F.when(there, n_words(words) - n_words(F.right(words, after)) - len(p.split())))
        labels.append(F.when(there, F.lit(label)))
    return {
        "n_base": reduce(lambda a, b: a + b, counts),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def rule_table(rules: tuple[Rule, ...]) -> Column:
    """The rules as one constant array; as long as the rules, whatever the documents."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"named_struct('at', {i}, 'priority', {r.priority}, 'keywords', array({', '.join(map(quoted, r.keywords))}), 'pattern', {quoted(r.pattern)})" for i, r in enumerate(rules)]
    return F.expr(f"array({', '.join(rows)})")


def keywords_of(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({k for r in rules for k in r.keywords})


def first_keywords(rules: tuple[Rule, ...]) -> list[str]:
    """Keywords such that every rule has one of them: its first one."""
    return sorted({r.keywords[0] for r in rules})


def spans(words: Column, pattern: Column, at: Column, priority: Column) -> Column:
    """The places of a pattern, leftmost and not overlapping: structs (start, -stop, -priority, rule), counted in words."""

    def marked(m: Column) -> Column:
        parts = F.split(m, "<")  # the i-th one ends where the word at i begins
        of = lambda mark: F.array_compact(F.transform(parts, lambda x, i: F.when(x.contains(mark), i)))
        zipped = F.arrays_zip(of("(").alias("start"), of(")").alias("stop"))
        found = F.transform(zipped, lambda z: F.struct(z["start"].alias("start"), (-z["stop"]).alias("back"), (-priority).alias("rank"), at.alias("rule")))
        return F.when(m == words, F.array().cast("array<struct<start:int,back:int,rank:int,rule:int>>")).otherwise(found)

    return F.flatten(F.transform(F.array(F.regexp_replace(words, pattern, F.lit("($0)"))), marked))


def detections_of(words: Column, present: Column, rules: tuple[Rule, ...]) -> Column:
    """All places of all rules whose keywords are there, sorted."""
    active = F.filter(rule_table(rules), lambda r: F.forall(r["keywords"], lambda k: F.array_contains(present, k)))
    return F.array_sort(F.flatten(F.transform(active, lambda r: spans(words, r["pattern"], r["at"], r["priority"]))))


def resolved(hits: Column, run: int = RUN) -> Column:
    """The sorted detections that are left, by two sweeps."""
    levels = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    judged = F.transform(hits, lambda h: F.struct(h.alias("hit"), F.lit(True).alias("ok")))

    def sweep(rows: Column, carried, meets, grown) -> Column:
        """rows in order, not ok where they meet what is carried along; grown: the carried state after a row."""

        def step(acc: Column, row: Column) -> Column:
            h = row["hit"]
            return F.struct(grown(acc["state"], h).alias("state"), F.concat(acc["rows"], F.array(F.struct(h.alias("hit"), (row["ok"] & ~meets(acc["state"], h)).alias("ok")))).alias("rows"))

        def part(c: Column) -> Column:
            start = F.struct(carried(F.slice(rows, F.lit(1), c * run)).alias("state"), F.filter(rows, lambda x: F.lit(False)).alias("rows"))
            return F.aggregate(F.slice(rows, c * run + 1, F.lit(run)), start, step, lambda acc: acc["rows"])

        runs = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / run).cast("int"))
        return F.flatten(F.transform(runs, part))

    level = lambda state, h, more=0: F.try_element_at(state, -h["rank"] + 1 + more)
    # forwards: the furthest end so far of each priority and above
    ends = lambda before: F.transform(levels, lambda p: F.coalesce(F.array_max(F.transform(before, lambda x: F.when(-x["hit"]["rank"] >= p, -x["hit"]["back"]))), F.lit(0)))
    further = lambda state, h: F.transform(state, lambda x, p: F.when(-h["rank"] >= p, F.greatest(x, -h["back"])).otherwise(x))
    within = lambda state, h: (level(state, h) >= -h["back"]) | F.coalesce(level(state, h, 1) > h["start"], F.lit(False))
    # backwards: the nearest start of each priority and above
    far = F.lit(2**31 - 1)
    starts = lambda behind: F.transform(levels, lambda p: F.coalesce(F.array_min(F.transform(behind, lambda x: F.when(-x["hit"]["rank"] >= p, x["hit"]["start"]))), far))
    nearer = lambda state, h: F.transform(state, lambda x, p: F.when(-h["rank"] >= p, F.least(x, h["start"])).otherwise(x))
    outranked = lambda state, h: F.coalesce(level(state, h, 1) < -h["back"], F.lit(False))
    forth = once(judged, lambda rows: sweep(rows, ends, within, further))
    back = once(F.reverse(forth), lambda rows: sweep(rows, starts, outranked, nearer))
    return F.when(F.size(hits) == 0, hits).otherwise(F.transform(F.filter(F.reverse(back), lambda x: x["ok"]), lambda x: x["hit"]))


def once(value: Column, use) -> Column:
    """use(value), with value worked out once, whatever the optimizer moves where."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, run: int = RUN) -> DataFrame:
    """docs with scan: hits (the detections that are left), n_words and the base columns. Texts without a keyword have no hits."""
    all_keywords = F.array(*[F.lit(k) for k in keywords_of(rules)])

    def scan(words: Column) -> Column:
        gate = reduce(lambda a, b: a | b, [words.contains(k) for k in first_keywords(rules)])
        found = once(F.filter(all_keywords, lambda k: F.contains(words, k)), lambda present: once(detections_of(words, present, rules), lambda hits: resolved(hits, run)))
        hits = F.when(gate, found).otherwise(F.array().cast("array<struct<start:int,back:int,rank:int,rule:int>>"))
        return F.struct(hits.alias("hits"), n_words(words).alias("n_words"), *[c.alias(k) for k, c in base_columns(words).items()])

    return docs.withColumn("scan", once(bracketed(F.col("text")), scan))


def detections(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, label, rule, priority, weight, start and stop (in words) of each detection that is left."""
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules).select("doc_id", F.explode("scan.hits").alias("h"))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("h.rule") + 1)
    return rows.select("doc_id", of([r.label for r in rules]).alias("label"), F.col("h.rule").alias("rule"), (-F.col("h.rank")).alias("priority"), of([r.weight for r in rules]).alias("weight"), F.col("h.start").alias("start"), (-F.col("h.back")).alias("stop"))


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, run: int = RUN) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs."""
    rows = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules, run).select("doc_id", "scan.*")
    names, weights = F.array(*[F.lit(r.label) for r in rules]), F.array(*[F.lit(float(r.weight)) for r in rules])
    found = F.transform("hits", lambda h: F.element_at(names, h["rule"] + 1))
    score = F.coalesce(F.array_max(F.transform("hits", lambda h: F.element_at(weights, h["rule"] + 1))), F.lit(0.0))
    labels = F.array_sort(F.array_distinct(F.concat("base", found)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n  ".join(f"({i}, {quoted(r.label)}, {r.priority}, {r.weight}, [{', '.join(map(quoted, r.keywords))}], {quoted(r.pattern)})" for i, r in enumerate(RULES))
    places = "\n  UNION ALL ".join(f"SELECT rid, {quoted(label)} AS label, {quoted(phrase(p))} AS p FROM w WHERE contains(words, {quoted(phrase(p))})" for p, label in BASE)
    gate = " OR ".join(f"contains(words, {quoted(k)})" for k in first_keywords(RULES))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT rid, doc_id, replace('<' || regexp_replace(t, '{NOT_WORD}', '><', 'g') || '>', '<>', '') AS words FROM d),
gated AS (SELECT rid, words FROM w WHERE {gate}),
rules(rule, label, priority, weight, keywords, pattern) AS (VALUES
  {rows}),
found AS (SELECT rid, label, string_split(words, p) AS parts, words FROM w JOIN (SELECT rid AS r2, label, p FROM (
  {places}) q) q ON rid = r2),
n AS (SELECT rid, len(words) - len(replace(words, '<', '')) AS n_words FROM w),
base AS (
  SELECT f.rid, sum(len(parts) - 1)::BIGINT AS n_base, min(len(parts[1]) - len(replace(parts[1], '<', '')))::BIGINT AS first_word,
    max(n_words - (len(parts[-1]) - len(replace(parts[-1], '<', ''))) - CASE label WHEN 'gpl' THEN 3 ELSE 2 END)::BIGINT AS last_word, list_sort(list_distinct(list(label))) AS labels
  FROM found f JOIN n ON n.rid = f.rid GROUP BY 1),
marked AS (
  SELECT rid, rule, label, priority, weight, string_split(regexp_replace(words, pattern, '(\0)', 'g'), '<') AS parts
  FROM gated JOIN rules ON list_bool_and(list_transform(keywords, lambda k: contains(words, k))) AND regexp_matches(words, pattern)),
placed AS (
  SELECT rid, rule, label, priority, weight, list_filter(list_transform(range(len(parts)), lambda i: CASE WHEN contains(parts[i + 1], '(') THEN i END), lambda x: x IS NOT NULL) AS starts,
    list_filter(list_transform(range(len(parts)), lambda i: CASE WHEN contains(parts[i + 1], ')') THEN i END), lambda x: x IS NOT NULL) AS stops FROM marked),
hits AS (SELECT rid, rule, label, priority, weight, unnest(starts) AS s, unnest(stops) AS e FROM placed),
kept AS (
  SELECT * FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits g WHERE g.rid = h.rid AND (
      g.priority > h.priority AND g.s < h.e AND g.e > h.s
      OR g.priority = h.priority AND g.s <= h.s AND g.e >= h.e AND (g.s < h.s OR g.e > h.e OR g.rule < h.rule)))),
own AS (SELECT rid, list(DISTINCT label) AS labels, max(weight) AS score FROM kept GROUP BY 1)
SELECT w.doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w JOIN n ON n.rid = w.rid LEFT JOIN base ON base.rid = w.rid LEFT JOIN own ON own.rid = w.rid
"""


#: The same result in SQL, with the default rules.
ORACLE_SQL = _oracle()
