"""License scan with ordered signature rules.

A rule is a regular expression over a text's words, with the words it cannot do without
(its keywords), a label, a weight and a place in the order. Only rules whose keywords are all
among a text's words are tried. Where detections overlap, the one of the highest priority
stands, of one rule's the longest, and all that lie in it, contain or cross it are suppressed.
"""

import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import BoundedCache, plain_words

# Phrases that always count, and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Families of licenses: label, pattern of the name, keywords, versions. A rule is made for
# each family and each phrase that names a license, and one for each version.
FAMILIES = [
    ("apache", r"apache", "apache", ["1 0", "1 1", "2 0"]),
    ("mit", r"mit", "mit", []),
    ("bsd", r"(?:new |simplified |modified |revised )?bsd", "bsd", ["0", "2", "3", "4"]),
    ("isc", r"isc", "isc", []),
    ("mpl", r"mozilla public", "mozilla public", ["1 0", "1 1", "2 0"]),
    ("epl", r"eclipse public", "eclipse public", ["1 0", "2 0"]),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", "general public", ["2 0", "2 1", "3"]),
    ("agpl", r"(?:gnu )?affero general public", "affero general public", ["1", "3"]),
    ("gpl", r"gnu general public", "gnu general public", ["1", "2", "3"]),
    ("gfdl", r"(?:gnu )?free documentation", "free documentation", ["1 1", "1 2", "1 3"]),
    ("cddl", r"common development and distribution", "development distribution", ["1 0", "1 1"]),
    ("cpl", r"common public", "common public", ["1 0"]),
    ("eupl", r"european union public", "european union public", ["1 0", "1 1", "1 2"]),
    ("osl", r"open software", "open software", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", r"academic free", "academic free", ["1 1", "2 0", "3 0"]),
    ("artistic", r"artistic", "artistic", ["1 0", "2 0"]),
    ("bsl", r"boost software", "boost software", ["1 0"]),
    ("busl", r"business source", "business source", ["1 0", "1 1"]),
    ("unlicense", r"the unlicense", "unlicense", []),
    ("wtfpl", r"do what the fuck you want to public", "what want public", ["1", "2"]),
    ("zlib", r"zlib", "zlib", []),
    ("ofl", r"(?:sil )?open font", "open font", ["1 0", "1 1"]),
    ("psf", r"python software foundation", "python software foundation", ["2"]),
    ("ms-pl", r"microsoft public", "microsoft public", []),
    ("ms-rl", r"microsoft reciprocal", "microsoft reciprocal", []),
    ("odbl", r"open (?:data ?commons )?(?:open )?database", "open database", ["1 0"]),
    ("odc-by", r"open data commons attribution", "commons attribution", ["1 0"]),
    ("sspl", r"server side public", "server side public", ["1"]),
    ("elastic", r"elastic", "elastic", ["2 0"]),
    ("postgresql", r"postgresql", "postgresql", []),
    ("openssl", r"openssl", "openssl", []),
    ("php", r"php", "php", ["3 0", "3 01"]),
    ("ruby", r"ruby", "ruby", []),
    ("vim", r"vim", "vim", []),
    ("lppl", r"latex project public", "latex project public", ["1 0", "1 1", "1 2", "1 3"]),
    ("qpl", r"q public", "q public", ["1 0"]),
    ("ncsa", r"university of illinois ncsa open source", "illinois ncsa", []),
    ("cecill", r"cecill", "cecill", ["1 1", "2 0", "2 1"]),
    ("mulan", r"mulan (?:permissive|public)", "mulan", ["1", "2"]),
    ("openrail", r"(?:creativeml )?open ?rail", "", []),
]

# Phrases that name a license: pattern around the name, words needed besides, weight.
PHRASES = [
    (r"licen[cs]ed under (?:the )?(?:terms of the )?{name}(?: licen[cs]e)?", "under", 0.95),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of the )?"
     r"{name}(?: licen[cs]e)?", "under", 0.9),
    (r"subject to the terms of the {name}(?: licen[cs]e)?", "subject terms", 0.9),
    (r"spdx licen[cs]e identifier {name}", "spdx identifier", 0.95),
    (r"(?:the )?{name} licen[cs]e", "", 0.6),
]

# Texts and notices that are recognised by their own words: label, pattern, keywords, weight.
NOTICES = [
    ("cc0", r"cc0(?: 1 0)?", "cc0", 0.8),
    ("cc0", r"creative commons zero", "creative commons zero", 0.9),
    ("cc-by-nc-nd", r"cc by nc nd(?: \d \d)?", "cc by nc nd", 0.9),
    ("cc-by-nc-sa", r"cc by nc sa(?: \d \d)?", "cc by nc sa", 0.9),
    ("cc-by-nc", r"cc by nc(?: \d \d)?", "cc by nc", 0.9),
    ("cc-by-nd", r"cc by nd(?: \d \d)?", "cc by nd", 0.9),
    ("cc-by-sa", r"cc by sa(?: \d \d)?", "cc by sa", 0.9),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv\w*",
     "creative commons attribution", 0.9),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike",
     "creative commons attribution", 0.9),
    ("cc-by-nc", r"creative commons attribution non ?commercial",
     "creative commons attribution", 0.9),
    ("cc-by-nd", r"creative commons attribution no ?deriv\w*", "creative commons attribution", 0.9),
    ("cc-by-sa", r"creative commons attribution share ?alike", "creative commons attribution", 0.9),
    ("cc-by", r"creative commons attribution(?: \d \d)?", "creative commons attribution", 0.85),
    ("public-domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain",
     "public domain", 0.8),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy",
     "permission hereby granted", 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose",
     "permission purpose", 0.95),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution binary", 0.95),
    ("warranty", r"provided as is without warranty of any kind", "warranty", 0.6),
    ("warranty", r"without any warranty without even the implied warranty", "implied warranty", 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 0.5),
    ("copyright", r"all content copyright", "content copyright", 0.5),
    ("proprietary", r"proprietary and confidential", "proprietary confidential", 0.8),
    ("proprietary", r"(?:unauthorized|unauthorised) (?:copying|reproduction|distribution)", "", 0.7),
    ("proprietary", r"may not be reproduced", "reproduced", 0.6),
    ("terms", r"terms of (?:use|service)", "terms", 0.3),
]


# Sentences of license texts, headers and agreements: label, pattern, keywords, weight.
BODIES = [
    ("agpl", r"your modified version must prominently offer all users interacting with it remotely",
     "prominently interacting remotely", 0.95),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the "
     r"terms of the gnu (?:lesser|library) general public licen[cs]e", "library redistribute gnu", 0.95),
    ("lgpl", r"contains no derivative of any portion of the library but is designed to work with the "
     r"library", "derivative library", 0.9),
    ("gpl", r"is free software you can redistribute it and or modify it under the terms of the gnu "
     r"general public licen[cs]e", "redistribute gnu", 0.95),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "received gnu", 0.95),
    ("gpl", r"designed to take away your freedom to share and change", "freedom share", 0.9),
    ("gpl", r"when we speak of free software we are referring to freedom not price",
     "referring freedom price", 0.9),
    ("gpl-2", r"copy and distribute verbatim copies of the program s source code", "verbatim program", 0.9),
    ("gpl-3", r"no covered work shall be deemed part of an effective technological measure",
     "technological measure", 0.95),
    ("gpl-3", r"to propagate a work means to do anything with it", "propagate", 0.9),
    ("gnu", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document",
     "verbatim permitted", 0.9),
    ("gfdl", r"copy distribute and or modify this document under the terms of the gnu free documentation",
     "gnu documentation", 0.95),
    ("gfdl", r"no invariant sections no front cover texts", "invariant cover", 0.95),
    ("apache-2.0", r"software distributed under the licen[cs]e is distributed on an as is basis",
     "distributed basis", 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e",
     "file except compliance", 0.9),
    ("apache-2.0", r"grants to you a perpetual worldwide non exclusive no charge royalty free "
     r"irrevocable (?:copyright|patent)?", "perpetual irrevocable", 0.9),
    ("apache-1.1", r"this product includes software developed by the apache software foundation",
     "includes apache", 0.9),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e",
     "form mozilla", 0.95),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file", "mpl distributed", 0.95),
    ("mpl-1.1", r"contents of this file are subject to the mozilla public licen[cs]e version 1 1",
     "contents mozilla", 0.95),
    ("epl", r"program is provided under the terms of this eclipse public licen[cs]e",
     "eclipse provided", 0.95),
    ("epl", r"constitutes recipient s acceptance of this agreement", "recipient acceptance", 0.8),
    ("cddl", r"subject to the terms of the common development and distribution licen[cs]e",
     "development distribution subject", 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice",
     "redistributions retain", 0.9),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice",
     "redistributions reproduce", 0.9),
    ("bsd-3", r"neither the name of (?:\S+ ){1,14}may be used to endorse or promote products",
     "neither endorse promote", 0.95),
    ("bsd-4", r"all advertising materials mentioning features or use of this software",
     "advertising mentioning", 0.95),
    ("warranty", r"in no event shall (?:\S+ ){1,16}be liable for any", "event liable", 0.6),
    ("warranty", r"implied warranties of merchantability", "merchantability", 0.6),
    ("mit", r"this permission notice shall be included in all copies or substantial portions",
     "permission substantial portions", 0.95),
    ("mit", r"the software is provided as is without warranty of any kind express or implied",
     "software provided warranty express", 0.85),
    ("x11", r"except as contained in this notice the names? of (?:\S+ ){1,10}shall not be used",
     "contained notice shall", 0.9),
    ("isc", r"permission to use copy modify and distribute this software (?:\S+ ){0,4}for any purpose "
     r"with or without fee", "permission purpose fee", 0.95),
    ("zlib", r"the origin of this (?:software|source code) must not be misrepresented",
     "origin misrepresented", 0.95),
    ("zlib", r"altered source versions must be plainly marked as such", "altered plainly", 0.95),
    ("bsl", r"any person or organization obtaining a copy of the software and accompanying "
     r"documentation covered by this licen[cs]e", "organization accompanying", 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain",
     "unencumbered", 0.95),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software",
     "anyone publish compile sell", 0.95),
    ("wtfpl", r"you just do what the fuck you want to", "just fuck", 0.95),
    ("beerware", r"you think this stuff is worth it you can buy (?:me|us) a beer", "worth beer", 0.95),
    ("json", r"the software shall be used for good not evil", "good evil", 0.95),
    ("cc", r"creative commons corporation is not a law firm", "creative commons corporation", 0.9),
    ("cc", r"this (?:work|article|content|site|book|image) is licen[cs]ed under a creative commons",
     "creative commons", 0.9),
    ("cc", r"bound by the terms and conditions of this creative commons", "bound creative", 0.9),
    ("cc", r"terms of this creative commons public licen[cs]e", "creative commons public", 0.9),
    ("cc-by", r"open access article (?:\S+ ){0,6}under the terms of the creative commons attribution",
     "open access attribution", 0.95),
    ("cc0", r"to the extent possible under law (?:\S+ ){1,10}waived all copyright", "extent waived", 0.95),
    ("cc0", r"no copyright this work has been identified as", "identified", 0.7),
    ("ofl", r"this font software is licen[cs]ed under the sil open font", "font sil", 0.95),
    ("ofl", r"cannot be released under any other type of licen[cs]e", "released type", 0.8),
    ("artistic", r"state the conditions under which a package may be copied", "conditions package", 0.95),
    ("ms-pl", r"if you use the software you accept this licen[cs]e", "accept software", 0.7),
    ("sspl", r"make the functionality of the program (?:\S+ ){0,6}available to third parties as a service",
     "functionality service", 0.95),
    ("busl", r"right to copy modify create derivative works redistribute and make non production use",
     "derivative production", 0.95),
    ("elastic", r"may not provide the software to third parties as a hosted or managed service",
     "hosted managed", 0.95),
    ("commons-clause", r"does not grant to you the right to sell the software", "grant sell", 0.95),
    ("polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter|internal use)",
     "polyform", 0.95),
    ("blueoak", r"blue oak model licen[cs]e", "blue oak", 0.95),
    ("openrail", r"you agree not to use the model or derivatives of the model", "model derivatives", 0.95),
    ("llama", r"llama (?:\d )*community licen[cs]e agreement", "llama community", 0.95),
    ("odbl", r"database is made available under the open database licen[cs]e", "database available", 0.95),
    ("psf", r"psf hereby grants licensee a nonexclusive royalty free", "psf licensee", 0.95),
    ("openssl", r"includes software developed by the openssl project", "openssl developed", 0.95),
    ("ijg", r"based in part on the work of the independent jpeg group", "independent jpeg", 0.95),
    ("unicode", r"obtaining a copy of (?:the )?(?:unicode )?data files", "unicode files", 0.9),
    ("ogl", r"contains public sector information licen[cs]ed under the open government",
     "sector government", 0.95),
    ("ogl", r"open government licen[cs]e(?: v?\d(?: \d)?)?", "open government", 0.85),
    ("crown", r"crown copyright", "crown copyright", 0.8),
    ("eula", r"end user licen[cs]e agreement", "end user agreement", 0.9),
    ("eula", r"(?:installing|copying|downloading|using) (?:\S+ ){0,8}you agree to be bound by",
     "agree bound", 0.8),
    ("eula", r"reverse engineer decompile or disassemble", "reverse decompile", 0.9),
    ("eula", r"the software is licen[cs]ed not sold", "software sold", 0.9),
    ("eula", r"you may not (?:sell )?rent lease (?:or )?(?:lend|loan|sublicense)", "rent lease", 0.85),
    ("proprietary", r"confidential and proprietary information", "confidential information", 0.8),
    ("proprietary", r"contains (?:valuable )?trade secrets", "trade secrets", 0.8),
    ("proprietary", r"for internal use only", "internal", 0.5),
    ("reserved", r"no part of this (?:publication|book|work|document|site) may be reproduced",
     "part reproduced", 0.9),
    ("reserved", r"stored in a retrieval system or transmitted in any form or by any means",
     "retrieval transmitted", 0.9),
    ("reserved", r"without (?:the )?(?:express )?(?:prior )?written (?:permission|consent) of",
     "without written", 0.7),
    ("noncommercial", r"for (?:personal|private|educational)(?: and| or)? non ?commercial use(?: only)?",
     "use", 0.7),
    ("permission", r"(?:used|reprinted|reproduced) (?:by|with) (?:kind )?permission", "permission", 0.6),
]


@dataclass(frozen=True)
class Rule:
    """A signature; ``priority`` is its place in the order, the first one the highest."""

    label: str
    pattern: re.Pattern
    keywords: frozenset
    weight: float
    base: bool = False


def _rule(label: str, pattern: str, keywords: str, weight: float, base: bool = False) -> Rule:
    # Texts are words with one space before, between and behind them.
    return Rule(label, re.compile(f"(?<= ){pattern}(?= )".encode()),
                frozenset(keywords.encode().split()), weight, base)


def default_rules() -> list[Rule]:
    """Some hundred signatures, the specific ones before the general ones."""
    versioned, plain = [], []
    for label, name, words, versions in FAMILIES:
        for shape, needed, weight in PHRASES:
            pattern = shape.format(name=name)
            keywords = f"{words} {needed}".strip()
            for version in versions:
                versioned.append(_rule(
                    f"{label}-{version.replace(' ', '.')}",
                    f"{pattern}(?: version| v)? (?:v )?{version}(?: or (?:any )?later)?",
                    keywords, weight))
                if not version.endswith(" 0"):
                    continue
                versioned.append(_rule(
                    f"{label}-{version.replace(' ', '.')}",
                    f"{pattern}(?: version)? v?{version[:-2]}", keywords, weight))
            plain.append(_rule(label, pattern, keywords, weight))
    notices = [_rule(*n) for n in BODIES + NOTICES]
    base = [_rule(label, phrase, phrase, 0.5, True) for phrase, label in BASE_PHRASES.items()]
    return versioned + notices + plain + base


class Scanner:
    """Rules ready to be applied; ``scan`` gives what one text holds."""

    def __init__(self, rules: list[Rule] | None = None):
        self.rules = default_rules() if rules is None else rules
        self.by_keyword: dict[bytes, list[int]] = {}
        self.always = []
        for i, rule in enumerate(self.rules):
            if rule.keywords:
                # One keyword leads to the rule, the longest, which is likely the rarest.
                self.by_keyword.setdefault(max(rule.keywords, key=lambda k: (len(k), k)), []).append(i)
            else:
                self.always.append(i)
        self.words = frozenset(self.by_keyword)
        # What the default rules without keywords need all the same.
        self.gate = re.compile(rb"licen[cs]|rail|unauthori[sz]ed" if rules is None else b"")

    def scan(self, text: str | None) -> dict:
        words = plain_words(text)
        present = self.words.intersection(words)
        hits = []
        joined = b" " + b" ".join(words) + b" "
        tried = list(self.always) if self.gate.search(joined) else []
        if present:
            own = set(words)
            tried += [i for w in present for i in self.by_keyword[w]
                      if self.rules[i].keywords <= own]
        for i in sorted(tried):
            hits += [(m.start(), m.end(), i) for m in self.rules[i].pattern.finditer(joined)]
        return self._summary(len(words), joined, hits)

    def _summary(self, n_words: int, joined: bytes, hits: list) -> dict:
        base = sorted(h for h in hits if self.rules[h[2]].base)
        starts = [h[0] for h in base]
        shown = self._resolved(hits)
        base_labels = {self.rules[h[2]].label for h in base}
        labels = base_labels | {self.rules[h[2]].label for h in shown}
        detections, at, word = [], 0, -1
        for start, end, i in shown:
            word += joined.count(b" ", at, start)
            at = start
            detections.append({"label": self.rules[i].label, "first": word,
                               "last": word + joined.count(b" ", start, end)})
        return {
            "n_words": n_words,
            "n_base": len(base),
            "first_word": joined.count(b" ", 0, starts[0]) - 1 if base else None,
            "last_word": joined.count(b" ", 0, starts[-1]) - 1 if base else None,
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(labels)),
            "score": 1 - math.prod(1 - self.rules[h[2]].weight for h in shown),
            "detections": detections,
        }

    @staticmethod
    def _resolved(hits: list) -> list:
        """Hits by place: in the order of their priority, and longer ones first, each hit is
        shown that neither lies in, contains nor crosses one shown before it."""
        shown: list = []
        for hit in sorted(hits, key=lambda h: (h[2], h[0] - h[1], h[0])):
            at = bisect_left(shown, hit)
            if (at == 0 or shown[at - 1][1] <= hit[0]) and (
                    at == len(shown) or shown[at][0] >= hit[1]):
                shown.insert(at, hit)
        return shown


_DETECTIONS = pa.list_(
    pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
)
_FIELDS = [
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
    ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
    ("score", pa.float64()), ("detections", _DETECTIONS),
]
SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, detections array<struct<label:string,first:bigint,last:bigint>>"
)
_scanners: BoundedCache = BoundedCache(lambda rules: Scanner(rules and list(rules)), limit=4)


def license_scan(rules: list[Rule] | None = None):
    """Column function: what the rules find in a text, as a struct of ``SCHEMA``."""
    key = None if rules is None else tuple(rules)

    @F.arrow_udf(SCHEMA)
    def scan(text: pa.Array) -> pa.Array:
        scanner = _scanners[key]
        return pa.array([scanner.scan(t.as_py()) for t in text], pa.struct(_FIELDS))

    return scan


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text",
            rules: list[Rule] | None = None) -> DataFrame:
    """One row per document with its ``doc_id`` and the columns of ``SCHEMA``.

    Word numbers count from 0 and are null where no base phrase stands. A null text has
    no words. The score is the chance that one of the shown detections is right, each
    with its rule's weight.
    """
    return docs.select(F.col(doc_id).alias("doc_id"), license_scan(rules)(text).alias("r")).select(
        "doc_id", "r.*"
    )
