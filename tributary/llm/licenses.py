"""License scans with ordered signature rules.

A text is lower-cased (A-Z) and reduced to words joined by single blanks. Rules are regular
expressions over that form, each with a label, a priority, a weight and keywords, of which every
match holds at least one. A text is first searched for the keywords; only the rules of the keywords found are run. Detections are then
taken in the order of priority, length and place; one whose interval lies within an interval taken
before is suppressed. The four base phrases are counted apart and their labels always stay.

The rules are the product of the names below and the contexts in which licenses are named, so
that each license has a rule for its tag, for a grant, for a heading and for a bare mention, and
hand-written rules for sentences that only the text or the notice of one license has.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.texts import whole

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Label, keywords (one in each alternative at least), and how the license is named in lower-case words.
NAMES = (
    ("gpl-1.0", "general", r"gnu general public license(?: version| v)? 1(?: 0)?"),
    ("gpl-2.0", "general", r"gnu general public license(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "general", r"gnu general public license(?: version| v)? 3(?: 0)?"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: version)? v?1(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version)? v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version)? v?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2.0", "lesser library", r"gnu (?:library|lesser) general public license(?: version| v)? 2(?: 0)?"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public license(?: version| v)? 2 1"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public license(?: version| v)? 3(?: 0)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version)? v?2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version)? v?3(?: 0)?(?: only| or later)?"),
    ("agpl-3.0", "affero", r"gnu affero general public license(?:(?: version| v)? 3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version)?(?: v?3(?: 0)?)?(?: only| or later)?"),
    ("gfdl", "documentation", r"gnu free documentation license(?:(?: version)? 1 [123])?"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version)? 1 0"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? v?2(?: 0)?(?: license)?"),
    ("mit", "mit", r"(?:the )?mit(?: expat)? license"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)(?: license)?"),
    ("x11", "x11", r"x11(?: license| consortium license)"),
    ("isc", "isc", r"isc license"),
    ("bsd-2-clause", "bsd freebsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?"),
    ("0bsd", "0bsd zero", r"(?:zero clause bsd|0bsd)(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style)? license"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? 1(?: [01])?"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?:(?: version| v)? 2(?: 0)?)?"),
    ("mpl-2.0", "mpl", r"mpl v?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?:(?: version| v)? 2(?: 0)?)?"),
    ("cddl-1.0", "distribution", r"common development and distribution license(?:(?: version)? 1(?: [01])?)?"),
    ("cpl-1.0", "common", r"common public license(?:(?: version)? 1(?: 0)?)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?:(?: v| version)? ?1 [012])?"),
    ("artistic-1.0", "artistic", r"artistic license(?: version)? 1(?: 0)?"),
    ("artistic-2.0", "artistic", r"artistic license(?:(?: version)? 2(?: 0)?)?"),
    ("bsl-1.0", "boost", r"boost software license(?:(?: version)? 1(?: 0)?)?"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: (?:version )?2)?"),
    ("python-2.0", "python", r"python(?: software foundation)? license(?:(?: version)? 2(?: 0)?)?"),
    ("php-3.01", "php", r"php license(?:(?: version)? 3(?: 0?1)?)?"),
    ("ofl-1.1", "open", r"sil open font license(?:(?: version)? 1 [01])?"),
    ("afl-3.0", "academic", r"academic free license(?:(?: version)? 3(?: 0)?)?"),
    ("osl-3.0", "open", r"open software license(?:(?: version)? 3(?: 0)?)?"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license(?:(?: v| version)? ?1(?: 0)?)?"),
    ("openssl", "openssl", r"openssl license"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? license"),
    ("bsl-1.1", "business", r"business source license(?:(?: version)? 1 1)?"),
    ("sspl-1.0", "server", r"server side public license(?:(?: version| v)? 1(?: 0)?)?"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?(?! nd| sa)"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?(?! nc| nd| sa)"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1234] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1234] [05])?(?! no| share)"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1234] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1234] [05])?(?! non| no| share)"),
    ("gpl", "general", r"gnu general public license(?!(?: version| v)? [123])"),
    ("lgpl", "lesser", r"gnu lesser general public license(?!(?: version| v)? [23])"),
    ("apache", "apache", r"apache(?: software)? license(?!(?: version)? v?[12])"),
)

# Context, pattern around the name, priority (higher wins), weight of a detection.
CONTEXTS = (
    ("tag", r"spdx license identifier {}", 40, 1.0),
    ("grant", r"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{}", 30, 0.95),
    ("terms", r"(?:subject to|terms of|governed by|covered by|conditions of) (?:the )?{}", 25, 0.85),
    ("reference", r"see (?:the )?(?:file )?(?:license|copying|notice)? ?(?:for )?(?:the )?{}", 20, 0.7),
    ("mention", r"{}", 10, 0.5),
)

# Label, keyword, words that only that license's own text has, weight.
SENTENCES = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.98),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 0.98),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.8),
    ("proprietary", "rights", r"all rights reserved", 0.4),
    ("proprietary", "confidential", r"confidential and proprietary", 0.7),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.98),
    ("zlib", "altered", r"this notice may not be removed or altered from any source distribution", 0.95),
    ("zlib", "liable", r"in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("mit", "restriction", r"to deal in the software without restriction including without limitation the rights to use", 0.95),
    ("ncsa", "restriction", r"to deal with the software without restriction including without limitation the rights to use", 0.95),
    ("isc", "appear", r"provided that the above copyright notice and this permission notice appear in all copies", 0.8),
    ("hpnd", "sell", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 0.95),
    ("postgresql", "agreement", r"for any purpose without fee and without a written agreement is hereby granted", 0.95),
    ("bsl-1.0", "organization", r"to any person or organization obtaining a copy of the software and accompanying documentation", 0.98),
    ("bsd-3-clause", "endorse", r"nor the names of its contributors may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd", "express", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties", 0.8),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("apache-2.0", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0.98),
    ("apache-2.0", "contributor", r"grant of patent license subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", 0.95),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 0.7),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 0.9),
    ("php-3.01", "php", r"products derived from this software may not be called php", 0.95),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "guarantee", r"the gnu general public license is intended to guarantee your freedom to share and change", 0.9),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 0.98),
    ("agpl-3.0", "copyleft", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", 0.98),
    ("agpl-3.0", "remotely", r"if your software can interact with users remotely through a computer network", 0.95),
    ("agpl-3.0", "remote", r"remote network interaction use with the gnu general public license", 0.95),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.95),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 0.98),
    ("gfdl", "documentation", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.98),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 0.98),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.98),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 0.98),
    ("epl", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license", 0.98),
    ("cddl-1.0", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 0.98),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service", 0.95),
    ("bsl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 0.98),
    ("ms-pl", "royalty", r"each contributor grants you a non exclusive worldwide royalty free copyright license to reproduce its contribution", 0.9),
    ("artistic-1.0", "intent", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic-2.0", "establishes", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 0.98),
    ("python-2.0", "psf", r"this license agreement is between the python software foundation psf and the individual or organization", 0.98),
    ("ofl-1.1", "bundled", r"versions of the font software may be bundled redistributed and or sold with any software", 0.95),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.98),
    ("cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 0.98),
    ("wtfpl", "verbatim", r"to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", 0.98),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff", 0.95),
    ("json", "evil", r"the software shall be used for good not evil", 0.95),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited", 0.8),
)


@dataclass(frozen=True)
class Signature:
    label: str
    keywords: str
    priority: int
    weight: float
    pattern: str


def signatures() -> list[Signature]:
    """All rules, the strongest first."""
    rules = [Signature(label, word, priority, weight, context.format(f"(?:{name})")) for label, word, name in NAMES for _, context, priority, weight in CONTEXTS]
    rules += [Signature(label, word, 35, weight, pattern) for label, word, pattern, weight in SENTENCES]
    return sorted(rules, key=lambda r: -r.priority)


class _Reach:
    """The farthest end of the intervals that start at a place or before it: a tree of prefix maxima."""

    def __init__(self, size: int):
        self.size, self.tree = size, {}

    def add(self, start: int, end: int) -> None:
        at = start + 1
        while at <= self.size:
            self.tree[at] = max(self.tree.get(at, -1), end)
            at += at & -at

    def at(self, start: int) -> int:
        at, best = start + 1, -1
        while at:
            best = max(best, self.tree.get(at, -1))
            at -= at & -at
        return best


class Scanner:
    """The rules compiled, by keywords."""

    def __init__(self):
        rules = signatures()
        self.rules = [(r, re.compile(rb"(?<= )" + r.pattern.encode() + rb"(?= )")) for r in rules]
        self.by_word: dict[bytes, list[int]] = {}
        for i, rule in enumerate(rules):
            for word in rule.keywords.encode().split():
                self.by_word.setdefault(word, []).append(i)
        self.gate = re.compile(rb"(?<= )(?:" + b"|".join(sorted(map(re.escape, self.by_word))) + rb")(?= )")
        self.base = [(b" " + phrase.encode() + b" ", label) for phrase, label in BASE]

    def detections(self, line: bytes) -> list[tuple[int, int, Signature]]:
        """``(start, end, rule)`` of the detections that stay, in the order they were taken."""
        words = {m.group() for m in self.gate.finditer(line)}
        found = []
        for i in sorted({i for w in words for i in self.by_word[w]}):
            rule, pattern = self.rules[i]
            found += [(-rule.priority, m.start() - m.end(), m.start(), m.end(), i) for m in pattern.finditer(line)]
        taken: list[tuple[int, int, Signature]] = []
        reach = _Reach(len(line))
        for _, _, start, end, i in sorted(found):
            if reach.at(start) < end:
                taken.append((start, end, self.rules[i][0]))
                reach.add(start, end)
        return taken

    def scan(self, text: str) -> tuple:
        """Counts, base places, labels, score and detected spans (word places) of one whole text."""
        words = _WORD.findall(text.encode().lower())
        line = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.base:
            at = line.find(phrase)
            while at >= 0:
                places.append(at)
                labels.add(label)
                at = line.find(phrase, at + 1)
        taken = self.detections(line)
        keep = 1.0
        for _, _, rule in taken:
            keep *= 1.0 - rule.weight
        if places:
            keep = min(keep, 0.5)
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32) if taken or places else np.zeros(0, np.int64)
        word_at = lambda at: None if at is None else int(np.searchsorted(blanks, at))
        spans = [(word_at(a) - 1, word_at(b), rule.label, rule.priority) for a, b, rule in taken]
        first, last = (min(places), max(places)) if places else (None, None)
        return (
            len(words),
            len(places),
            word_at(first),
            word_at(last),
            ",".join(sorted(labels)),
            ",".join(sorted(labels | {rule.label for _, _, rule in taken})),
            round(1.0 - keep, 6),
            spans,
        )


@functools.cache
def scanner() -> Scanner:
    return Scanner()


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first_word: long, end_word: long, label: string, priority: int>>"
)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base phrases, labels, score and the spans of the detections.

    One pass without a shuffle. Null and empty texts give no words, no labels and score 0. Base
    phrases are counted at every place, overlapping ones too. Equal detections (same priority,
    place and length) go to the earlier rule. Repeated rows stay, null ids pass through. Texts of
    any length are scanned whole, in time that grows with length and detections but for a logarithm.
    """

    @F.pandas_udf(FIELDS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [scanner().scan(t or "") for t in texts]
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")[:7]] + ["spans"])
        names = ("first_word", "end_word", "label", "priority")
        out["spans"] = [[dict(zip(names, s, strict=True)) for s in spans] for spans in out["spans"]]
        return out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"})

    return docs.select(F.col(id_col), scan(whole(text_col)).alias("s")).select(F.col(id_col), "s.*")
