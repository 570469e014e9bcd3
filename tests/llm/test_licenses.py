from __future__ import annotations

import re
from collections import Counter

import pytest
import regex as regex_module  # look-behinds of any width, as Java has them

from stellate.llm import licenses
from tests.llm import awkward

TEXTS = [
    "Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0. Under the mit LICENSE, and cc-by-nc; CC BY NC 4.0",
    "under themit license cc by ncé under the mit licenses",
    "This work is licensed under the GNU General Public License, version 3.",
    "under the terms of the GNU Lesser General Public License, version 2.1, SPDX-License-Identifier: MIT",
    "cc\nby\tnc " * 400,
    "BSD 3-clause license and the new BSD license; Mozilla Public License 2.0",
    "licence? CC0 1.0 — unlicense license",
]


def plain(text: str | None) -> tuple:
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    joined = " " + " ".join(words) + " "
    found = []
    for keyword, label, regex, priority, confidence in licenses.rules():
        if (any(w in low for w in licenses.GATES) or re.search(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by", low)) and keyword in joined:
            for m in regex_module.finditer(regex, joined):
                first = joined.count(" ", 0, m.start()) - 1
                found.append((first, -(first + m[0].count(" ")), priority, label, confidence))
    found.sort()
    more, score = set(), 0.0
    for i, d in enumerate(found):
        if not any(-e[1] >= -d[1] for e in found[:i]):  # earlier start or same place, reaching as far
            more.add(d[3])
            score = max(score, d[4])
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if places else score,
    )


def test_scan_matches_brute_force(spark):
    rows = awkward.document_rows() + [(300 + i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = licenses.scan(awkward.documents(spark, rows)).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *plain(r[1])) for r in rows)


def test_rules_find_what_they_are_for(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(awkward.documents(spark, rows)).collect()}
    assert got[0] == "mit" and got[3] == "gpl-3" and got[4] == "lgpl-2.1,mit"
    assert set(got[1].split(",")) == {"apache-2", "cc-by-nc", "mit"}
    assert set(got[6].split(",")) == {"bsd-3-clause", "mpl-2"}


def example(regex: str) -> str:
    """A text that the regex matches: optional parts left out, the first of several choices."""
    body = regex.removeprefix("(?<= )").removesuffix("(?= )")
    if "(?<= spdx" in body:
        return "SPDX-License-Identifier: " + example(body[: body.index("(?= )")])
    while True:
        inner = re.search(r"\(\?:([^()]*)\)(\?|\{\d+,\d+\})?", body)
        if not inner:
            break
        told = "" if inner[2] == "?" or (inner[2] or "").startswith("{0") else inner[1].split("|")[0]
        body = body[: inner.start()] + told + body[inner.end() :]
    body = re.sub(r"(\[[^]]*\]|.)\?", "", body)
    body = re.sub(r"\[\^ \]\+", "any", body)
    body = re.sub(r"\[(.)[^]]*\][+*]?", r"\1", body)
    return body


def test_every_rule_matches_and_passes_its_gates():
    rules = licenses.rules()
    assert len(rules) >= 300 and [r[3] for r in rules] == list(range(len(rules)))
    assert len({r[2] for r in rules}) == len(rules)
    for keyword, _, regex, _, _ in rules:
        text = example(regex)
        joined = " " + " ".join(re.findall(licenses.WORD, text.lower())) + " "
        assert regex_module.search(regex, joined), (regex, text)
        assert keyword in joined, (keyword, text)
        assert any(w in text.lower() for w in licenses.GATES) or "cc by" in joined, text


NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including"),
    ("bsd", "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that"),
    ("bsd,bsd-2-clause,bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer. 3. Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("gpl-2", "either version 2 of the License, or (at your option) any later version."),
    ("gpl,gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl,lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"),
    ("gpl-3", "This is GNU GPLv3 code"),
    ("apache-2", "see http://www.apache.org/licenses/LICENSE-2.0 for it"),
    ("gpl-2", "// SPDX-License-Identifier: GPL-2.0-or-later"),
    ("apache-2,mit", "SPDX-License-Identifier: Apache-2.0 OR MIT"),
    ("bsd-3-clause,gpl-2,mit", "# SPDX-License-Identifier: (GPL-2.0-only OR BSD-3-Clause) AND MIT"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("epl-2", "are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0", "has waived all copyright and related or neighboring rights to this work; http://creativecommons.org/publicdomain/zero/1.0/"),
    ("mit", '{"name": "x", "license": "MIT"}'), ("apache-2", "license = Apache-2.0"), ("agpl-3", "https://www.gnu.org/licenses/agpl-3.0.html"),
    ("perl", "you may use it under the same terms as Perl itself"), ("ofl-1.1", "http://scripts.sil.org/OFL"),
    ("public-domain", "This file is in the public domain."), ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("", "He has a license to drive; all rights reserved."), ("", "version 2 of the text"), ("", "gnu and gnat live in Africa"), ("", "the software was given to the public"),
    ("", "permission to use the hall is granted"), ("", "an attribution to Rembrandt, by 4.0 of the experts"), ("", "Apache helicopters and a MIT professor"), ("", "X11 windows, zlib streams and vim"),
]


def test_labelled_notices(spark):
    """Notices, texts, addresses and expressions with their licenses: precision and recall over all labels."""
    rows = [(i, t, None, None, None) for i, (_, t) in enumerate(NOTICES)]
    got = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in licenses.scan(awkward.documents(spark, rows)).collect()}
    want = {i: set(filter(None, n.split(","))) for i, (n, _) in enumerate(NOTICES)}
    right = sum(len(got[i] & want[i]) for i in want)
    wrong = [(NOTICES[i], got[i]) for i in want if got[i] != want[i]]
    assert right / sum(map(len, got.values())) >= 0.95 and right / sum(map(len, want.values())) >= 0.95, wrong


def test_no_python_in_the_plan(spark):
    plan = licenses.scan(awkward.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(spark):
    assert licenses.scan(awkward.empty(spark)).collect() == []
