"""License scan with ordered signature rules, in DataFrame functions only.

A rule is a regex over a text's words joined by single spaces, with a keyword, a label, a priority and a confidence. Rules are
sentences of license texts, notices, addresses of licenses, identifiers in tags, names in running text, and fields of package files.
A few plain words gate a text, each rule's keyword gates the rule, and only then does its regex run; as each is a
literal of its own, Spark compiles it once. Detections are sorted by start, longest first,
then by priority, and one pass drops what lies inside an earlier one. Everything
happens inside the row: no shuffle, no join, and one text's detections are the most that is held.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases asked for, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Label, keyword, name as words, version as words. A keyword is part of every wording of the name.
NAMES = (
    ("mit", "mit", "mit", ""),
    ("apache-1.1", "apache", "apache(?: software)?", "1 1"),
    ("apache-2", "apache", "apache(?: software)?", "2(?: 0)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|simplified bsd|freebsd)", ""),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd)", ""),
    ("bsd", "bsd", "(?:original )?bsd", ""),
    ("gpl-1", "general public", "(?:gnu )?general public", "1(?: 0)?"),
    ("gpl-2", "general public", "(?:gnu )?general public", "2(?: 0)?"),
    ("gpl-3", "general public", "(?:gnu )?general public", "3(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl(?: ?v?[23])?", ""),
    ("lgpl-2.1", "lesser general public", "(?:gnu )?lesser general public", "2 1"),
    ("lgpl-3", "lesser general public", "(?:gnu )?lesser general public", "3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ""),
    ("agpl-3", "affero", "(?:gnu )?affero general public", "3(?: 0)?"),
    ("mpl-1.1", "mozilla", "mozilla public", "1 1"),
    ("mpl-2", "mozilla", "mozilla public", "2(?: 0)?"),
    ("epl-1", "eclipse", "eclipse public", "1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public", "2(?: 0)?"),
    ("cddl-1", "common development", "common development and distribution", "1(?: 0)?"),
    ("cpl-1", "common public", "common public", "1(?: 0)?"),
    ("isc", "isc", "isc", ""),
    ("zlib", "zlib", "zlib(?: libpng)?", ""),
    ("unlicense", "unlicen", "unlicense", ""),
    ("wtfpl", "wtfpl", "wtfpl", ""),
    ("artistic-1", "artistic", "artistic", "1(?: 0)?"),
    ("artistic-2", "artistic", "artistic", "2(?: 0)?"),
    ("bsl-1", "boost", "boost software", "1(?: 0)?"),
    ("ofl-1.1", "open font", "(?:sil )?open font", "1 1"),
    ("odbl-1", "open database", "open database", "1(?: 0)?"),
    ("pddl-1", "public domain dedication", "public domain dedication and", "1(?: 0)?"),
    ("eupl-1.2", "european union", "european union public", "1 2"),
    ("ms-pl", "microsoft", "microsoft public", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal", ""),
    ("psf-2", "python software", "python software foundation", "2(?: 0)?"),
    ("php-3", "php", "php", "3(?: 0| 01)?"),
    ("ruby", "ruby", "ruby", ""),
    ("zpl-2", "zope", "zope public", "2(?: [01])?"),
    ("osl-3", "open software", "open software", "3(?: 0)?"),
    ("afl-3", "academic free", "academic free", "3(?: 0)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?", ""),
    ("postgresql", "postgresql", "postgresql", ""),
    ("x11", "x11", "x11", ""),
    ("vim", "vim", "vim", ""),
    ("openssl", "openssl", "openssl", ""),
    ("cc0", "cc0", "cc0", "1(?: 0)?"),
    ("cc-by", "cc by", "(?:creative commons )?cc by", "[1-4](?: [05])?"),
    ("cc-by-sa", "cc by sa", "(?:creative commons )?cc by sa", "[1-4](?: [05])?"),
    ("cc-by-nd", "cc by nd", "(?:creative commons )?cc by nd", "[1-4](?: [05])?"),
    ("cc-by-nc", "cc by nc", "(?:creative commons )?cc by nc", "[1-4](?: [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", "(?:creative commons )?cc by nc sa", "[1-4](?: [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", "(?:creative commons )?cc by nc nd", "[1-4](?: [05])?"),
)

#: Label, keyword and a sentence of the license's text or of the notice that it asks for.
TEXTS = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsl-1", "permission is hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ncsa", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software (?:[^ ]+ ){1,12}to deal with the software without restriction"),
    ("ofl-1.1", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("unicode", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of (?:data files|the unicode data files)"),
    ("x11", "x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission to use", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission to use", "permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted"),
    ("curl", "name of a copyright", "except as contained in this notice the name of a copyright holder shall not be used in advertising"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse or promote", "neither the names? of (?:[^ ]+ ){1,14}may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse or promote", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", "do what the fuck you want to(?: public license)?"),
    ("beerware", "buy me a beer", "you think this stuff is worth it you can buy me a beer in return"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("apache-2", "except in compliance", "licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license"),
    ("apache-2", "apache license", "apache license version 2 0 january 2004"),
    ("apache-1.1", "apache software", "this product includes software developed by the apache software foundation"),
    ("apache-1", "apache group", "this product includes software developed by the apache group"),
    ("gpl-1", "general public", "gnu general public license version 1 february 1989"),
    ("gpl-2", "general public", "gnu general public license version 2 june 1991"),
    ("gpl-3", "general public", "gnu general public license version 3 29 june 2007"),
    ("lgpl-2", "library general", "gnu library general public license version 2 june 1991"),
    ("lgpl-2.1", "lesser general", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", "lesser general", "gnu lesser general public license version 3 29 june 2007"),
    ("agpl-3", "affero general", "gnu affero general public license version 3 19 november 2007"),
    ("gfdl-1.3", "free documentation", "gnu free documentation license version 1 3 3 november 2008"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla public", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1", "mozilla public", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", "netscape public", "the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-1", "eclipse public", "made available under the terms of the eclipse public license v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse public", "made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2 0"),
    ("cpl-1", "common public", "made available under the terms of the common public license v(?:ersion)? ?1 0"),
    ("ibm-pl-1", "ibm public", "made available under the terms of the ibm public license"),
    ("cddl-1", "common development", "subject to the terms of the common development and distribution license"),
    ("eupl-1.2", "eupl", "licensed under the eupl version 1 2"),
    ("artistic-1", "artistic license", "the artistic license preamble the intent of this document is to state the conditions"),
    ("artistic-2", "artistic license", "the artistic license 2 0 copyright"),
    ("perl", "same terms as perl", "under the same terms as perl(?: [0-9]{1,2}){0,3} itself"),
    ("ruby", "as ruby", "under the same terms as ruby(?: itself)?"),
    ("psf-2", "python software", "python software foundation license version 2"),
    ("php-3", "php software", "this product includes php software freely available from"),
    ("openssl", "openssl project", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "eric young", "this product includes cryptographic software written by eric young"),
    ("libpng", "png reference library", "the png reference library is supplied as is"),
    ("ijg", "independent jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("w3c", "by obtaining", "by obtaining(?: using and or copying)? this work you (?:the licensee )?agree that you have read understood and will comply"),
    ("ms-pl", "accompanying software", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("postgresql", "without a written", "for any purpose without fee and without a written agreement is hereby granted"),
    ("tcl", "scriptics", "copyrighted by the regents of the university of california sun microsystems inc scriptics corporation"),
    ("ofl-1.1", "font software", "this font software is licensed under the sil open font license version 1 1"),
    ("cc0", "neighboring rights", "waived all copyright and related or neighboring rights"),
    ("cc0", "associated a work", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("pddl-1", "public domain dedication", "made available under the public domain dedication and license v1 0"),
    ("odbl-1", "open database", "made available under the open database license"),
    ("odc-by-1", "open data commons", "made available under the open data commons attribution license"),
    ("public-domain", "public domain", "this (?:work|software|file|code|document|program) (?:is|has been)(?: hereby)?(?: placed| released| dedicated| put)? (?:in|into|to) the public domain"),
    ("public-domain", "public domain", "i (?:hereby )?(?:place|release|dedicate) this (?:work|software|file|code|program) (?:in|into|to) the public domain"),
    ("public-domain", "copyright interest", "dedicate(?:s|d)? any and all copyright interest in the software to the public domain"),
)

#: What the notice of a family says of its version, and the label's end.
_VERSIONED = (("general public", "gpl", ("1", "2", "3")), ("lesser general public", "lgpl", ("2 1", "3")),
              ("library general public", "lgpl", ("2",)), ("affero general public", "agpl", ("1", "3")), ("free documentation", "gfdl", ("1 2", "1 3")))

#: Label and address, as words.
ADDRESSES = (
    ("mit", "opensource org licenses? mit(?: license)?"), ("mit", "mit license org"), ("mit", "choosealicense com licenses mit"),
    ("apache-2", "apache org licenses license 2 0"), ("apache-2", "opensource org licenses? apache 2 0"), ("apache-2", "choosealicense com licenses apache 2 0"),
    ("apache-1.1", "apache org licenses license 1 1"), ("apache-1.1", "opensource org licenses? apache 1 1"),
    ("bsd-2-clause", "opensource org licenses? bsd 2 clause"), ("bsd-3-clause", "opensource org licenses? bsd 3 clause"),
    ("bsd", "opensource org licenses? bsd license"), ("bsd-2-clause", "freebsd org copyright freebsd license"),
    ("gpl-1", "gnu org (?:copyleft|licenses)(?: old licenses)? gpl 1 0"), ("gpl-2", "gnu org (?:copyleft|licenses)(?: old licenses)? gpl 2 0"),
    ("gpl-3", "gnu org (?:copyleft|licenses) gpl 3 0"), ("gpl", "gnu org (?:copyleft|licenses) gpl(?: html| txt)?"),
    ("lgpl-2.1", "gnu org (?:copyleft|licenses)(?: old licenses)? lgpl 2 1"), ("lgpl-2", "gnu org (?:copyleft|licenses)(?: old licenses)? lgpl 2 0"),
    ("lgpl-3", "gnu org (?:copyleft|licenses) lgpl 3 0"), ("lgpl", "gnu org (?:copyleft|licenses) lgpl(?: html| txt)?"),
    ("agpl-3", "gnu org licenses agpl 3 0"), ("agpl", "gnu org licenses agpl(?: html| txt)?"), ("gfdl-1.3", "gnu org licenses fdl 1 3"), ("gfdl", "gnu org (?:copyleft|licenses) fdl(?: html| txt)?"),
    ("gpl-2", "opensource org licenses? gpl 2 0"), ("gpl-3", "opensource org licenses? gpl 3 0"), ("lgpl-2.1", "opensource org licenses? lgpl 2 1"),
    ("lgpl-3", "opensource org licenses? lgpl 3 0"), ("agpl-3", "opensource org licenses? agpl 3 0"),
    ("mpl-2", "mozilla org(?: en us)? mpl 2 0"), ("mpl-1.1", "mozilla org(?: en us)? mpl 1 1"), ("mpl-1.1", "mozilla org mpl mpl 1 1"), ("mpl-2", "opensource org licenses? mpl 2 0"),
    ("epl-1", "eclipse org legal epl v10"), ("epl-2", "eclipse org legal epl (?:2 0|v20)"), ("epl-1", "opensource org licenses? epl 1 0"), ("epl-2", "opensource org licenses? epl 2 0"),
    ("isc", "opensource org licenses? isc(?: license(?: txt)?)?"), ("zlib", "opensource org licenses? zlib(?: license)?"), ("zlib", "zlib net zlib license"),
    ("bsl-1", "boost org license 1 0"), ("bsl-1", "opensource org licenses? bsl 1 0"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"), ("wtfpl", "sam zoy org wtfpl"),
    ("artistic-2", "opensource org licenses? artistic(?: license)? 2 0"), ("artistic-2", "perlfoundation org artistic license 2 0"), ("artistic-1", "opensource org licenses? artistic(?: license)? 1 0"),
    ("cddl-1", "opensource org licenses? cddl 1 0"), ("cddl-1", "opensolaris org os licensing"), ("cpl-1", "opensource org licenses? cpl1? ?1?0? php"), ("eupl-1.2", "joinup ec europa eu (?:[^ ]+ ){0,6}eupl"),
    ("ms-pl", "opensource org licenses? ms pl"), ("ms-rl", "opensource org licenses? ms rl"), ("ncsa", "opensource org licenses? ncsa"), ("php-3", "php net license 3 01"),
    ("psf-2", "docs python org 3 license"), ("postgresql", "opensource org licenses? postgresql"), ("ofl-1.1", "scripts sil org ofl"), ("ofl-1.1", "openfontlicense org"),
    ("cc0", "creativecommons org publicdomain zero 1 0"), ("public-domain", "creativecommons org publicdomain mark 1 0"), ("cc-by", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", "creativecommons org licenses by sa [1-4] [05]"), ("cc-by-nd", "creativecommons org licenses by nd [1-4] [05]"), ("cc-by-nc", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa [1-4] [05]"), ("cc-by-nc-nd", "creativecommons org licenses by nc nd [1-4] [05]"), ("odbl-1", "opendatacommons org licenses odbl"),
    ("pddl-1", "opendatacommons org licenses pddl"), ("odc-by-1", "opendatacommons org licenses by"), ("osl-3", "opensource org licenses? osl 3 0"), ("afl-3", "opensource org licenses? afl 3 0"),
)

#: Label and identifier in tags and package files, as words.
IDENTIFIERS = (
    ("mit", "mit"), ("mit", "mit 0"), ("x11", "x11"), ("apache-1", "apache 1 0"), ("apache-1.1", "apache 1 1"), ("apache-2", "apache 2(?: 0)?"), ("bsd", "bsd"), ("bsd-0-clause", "0bsd"), ("bsd-1-clause", "bsd 1 clause"),
    ("bsd-2-clause", "bsd 2 clause(?: patent)?"), ("bsd-3-clause", "bsd 3 clause(?: clear| lbnl)?"), ("bsd-4-clause", "bsd 4 clause"), ("gpl-1", "gpl 1 0(?: only| or later)?"), ("gpl-2", "gplv2"), ("gpl-3", "gplv3"),
    ("gpl-2", "gpl 2 0(?: only| or later)?"), ("gpl-3", "gpl 3 0(?: only| or later)?"), ("lgpl-2", "lgpl 2 0(?: only| or later)?"), ("lgpl-2.1", "lgpl 2 1(?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-1", "agpl 1 0(?: only| or later)?"), ("agpl-3", "agpl 3 0(?: only| or later)?"), ("gfdl-1.2", "gfdl 1 2(?: only| or later)?"), ("gfdl-1.3", "gfdl 1 3(?: only| or later)?"), ("mpl-1", "mpl 1 0"), ("mpl-1.1", "mpl 1 1"),
    ("mpl-2", "mpl 2 0"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"), ("cpl-1", "cpl 1 0"), ("cddl-1", "cddl 1 0"), ("cddl-1.1", "cddl 1 1"), ("eupl-1.1", "eupl 1 1"), ("eupl-1.2", "eupl 1 2"), ("isc", "isc"), ("zlib", "zlib"),
    ("libpng", "libpng 2 0"), ("bsl-1", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("artistic-1", "artistic 1 0(?: perl)?"), ("artistic-2", "artistic 2 0"), ("psf-2", "psf 2 0"), ("python-2", "python 2 0"),
    ("php-3", "php 3 01?"), ("ruby", "ruby"), ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("openssl", "openssl"), ("vim", "vim"), ("w3c", "w3c"), ("zpl-2", "zpl 2 [01]"), ("osl-3", "osl 3 0"), ("afl-3", "afl 3 0"), ("ms-pl", "ms pl"),
    ("ms-rl", "ms rl"), ("ofl-1.1", "ofl 1 1"), ("curl", "curl"), ("hpnd", "hpnd"), ("json", "json"), ("beerware", "beerware"), ("unicode", "unicode (?:dfs 2016|3 0)"), ("blueoak-1", "blueoak 1 0 0"), ("sspl-1", "sspl 1 0"), ("upl-1", "upl 1 0"),
    ("cecill-2.1", "cecill 2 1"), ("cc0", "cc0 1 0"), ("cc-by", "cc by [1-4] [05]"), ("cc-by-sa", "cc by sa [1-4] [05]"), ("cc-by-nd", "cc by nd [1-4] [05]"), ("cc-by-nc", "cc by nc [1-4] [05]"), ("cc-by-nc-sa", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd [1-4] [05]"), ("odbl-1", "odbl 1 0"), ("odc-by-1", "odc by 1 0"), ("pddl-1", "pddl 1 0"), ("ecl-2", "ecl 2 0"), ("ipl-1", "ipl 1 0"), ("rpl-1.5", "rpl 1 5"), ("qpl-1", "qpl 1 0"), ("lppl-1.3c", "lppl 1 3c"),
)

#: The terms of the attribution family by their names.
CREATIVE = (("cc-by-nc-sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"), ("cc-by-nc", "attribution non ?commercial"),
            ("cc-by-sa", "attribution share ?alike"), ("cc-by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?"), ("cc-by", "attribution"), ("cc0", "cc0|zero"))

#: A text that any rule can match has one of these, or a cc followed by by; single words, as white space between words may be of any kind.
GATES = (
    "licen", "spdx", "gpl", "gnu", "cc0", "permission", "redistribution", "commons", "domain", "software", "unencumbered", "fuck", "wtfpl", "zoy", "beer",
    "misrepresented", "endorse", "advertising", "neighboring", "deed", "eclipse", "mozilla", "apache", "perl", "ruby", "php", "zlib", "jpeg", "png",
    "agreement", "understood", "eupl", "opensolaris", "scriptics", "sil", "version",
)

def _up_to(times: int, body: str) -> str:
    """``body`` at most so many times, written out, as look-behinds want it."""
    return f"(?:{body}{_up_to(times - 1, body)})?" if times else ""


_ID_WORD = "[a-z0-9]{1,20} "
_EXPRESSION = " spdx license identifier " + _up_to(3, f"{_ID_WORD}{_up_to(5, _ID_WORD)}(?:or|and|with) ")
_UNDER = r"(?:(?:licen[cs]ed|released|distributed|published|provided|available) under (?:the )?(?:terms of (?:the )?)?|subject to (?:the )?(?:terms of (?:the )?)?|under the )"


def rules() -> list[tuple[str, str, str, int, float]]:
    """(keyword, label, regex, priority, confidence) of every rule, in priority order: what is most telling first."""
    out: list[tuple[str, str, str, int, float]] = []

    def add(keyword: str, label: str, body: str, confidence: float) -> None:
        out.append((keyword, label, f"(?<= ){body}(?= )", len(out), confidence))

    for label, words in IDENTIFIERS:  # in a tag, also behind the operators of an expression; what stands before is looked at last
        out.append(("spdx license identifier", label, f"(?<= ){words}(?= )(?<={_EXPRESSION}{words})", len(out), 0.98))
    for label, keyword, sentence in TEXTS:
        add(keyword, label, sentence, 0.9)
    for keyword, family, versions in _VERSIONED:
        for version in versions:
            label = f"{family}-{version.replace(' ', '.')}"
            add(keyword, label, rf"(?:gnu )?{keyword} license as published by the free software foundation (?:either )?version {version}(?: of the license)?(?: or at your option any later version)?", 0.95)
            add(keyword, label, rf"(?:gnu )?{keyword} license (?:version |v ?)?{version}(?: 0)?(?: or(?: at your option)? (?:any )?later(?: version)?)?", 0.85)
    for version in ("1", "2", "3"):
        add("gpl", f"gpl-{version}", rf"(?:gnu )?gpl ?(?:version |v ?)?{version}(?: 0)?(?: or later)?", 0.8)
        add("gpl", f"lgpl-{version}" if version != "2" else "lgpl-2.1", rf"(?:gnu )?lgpl ?(?:version |v ?)?{'2 1' if version == '2' else version}(?: 0)?(?: or later)?", 0.8)
        add("gpl", f"agpl-{version}", rf"(?:gnu )?agpl ?(?:version |v ?)?{version}(?: 0)?(?: or later)?", 0.8)
        add("either version", f"gpl-{version}", rf"either version {version} of the license or at your option any later version", 0.5)
    for label, words in ADDRESSES:
        add(max(words.split("(")[0].replace("?", "").split(), key=len), label, words, 0.9)
    for label, words in CREATIVE:
        add("creative commons", label, rf"creative commons (?:{words})(?: [1-4] [05])?(?: (?:international|unported|generic))?(?: (?:public )?licen[cs]e)?", 0.9)
    for label, keyword, name, version in NAMES:
        licence = " licen[cs]e" if not label.startswith("cc") else "(?: licen[cs]e)?"
        told = f" (?:version |v)?{version}" if version else ""
        add(keyword, label, f"{_UNDER}{name}{licence}{told if not label.startswith('cc') else f'(?:{told})?' if told else ''}", 0.95)
        add(keyword, label, f"{name}{licence}{told}", 0.85 if version else 0.6)
        if label.startswith("cc"):
            add(keyword, label, name, 0.5)
    for label, words in IDENTIFIERS:  # a field of a package file
        add("licen", label, f"(?:project |package )?licen[cs]e(?: expression| name| type)? {words}", 0.7)
    return out


def lowered(text: str) -> Column:
    """A-Z in lower case, everything else as it is; null is empty."""
    return F.translate(
        F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def _places(joined: Column, regex: Column) -> tuple[Column, Column]:
    """First and last word index of each match: matches are marked, and marked words keep their place."""
    words = F.split(F.regexp_replace(joined, regex, F.lit("\x01$0\x02")), " ")
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    starts = F.transform(F.filter(at, lambda x: x["w"].startswith("\x01")), lambda x: x["i"] - 1)
    ends = F.transform(F.filter(at, lambda x: x["w"].endswith("\x02")), lambda x: x["i"] - 1)
    return starts, ends


def _hits(joined: Column) -> Column:
    """Priorities of the rules that match: the keyword first, then the rule's own literal regex. Rules of one keyword share its look-up."""
    by: dict[str, list[tuple[str, int]]] = {}
    for keyword, _, regex, priority, _ in rules():
        by.setdefault(keyword, []).append((regex, priority))
    none = F.array().cast("array<int>")
    found = [
        F.when(F.contains(joined, F.lit(keyword)), F.array_compact(F.array(*[F.when(F.rlike(joined, F.lit(r)), F.lit(p)) for r, p in some]))).otherwise(none)
        for keyword, some in by.items()
    ]
    return F.flatten(F.array(*found))


def _detections(joined: Column, hits: Column) -> Column:
    """Detections of the rules that hit, as an array of (start, -end, priority, label, confidence)."""
    table = F.array(*[
        F.struct(F.lit(n).alias("label"), F.lit(r).alias("regex"), F.lit(p).alias("priority"), F.lit(float(c)).alias("confidence"))
        for _, n, r, p, c in rules()
    ])

    def matches(priority: Column) -> Column:
        rule = F.get(table, priority)
        starts, ends = _places(joined, rule["regex"])
        return F.zip_with(
            starts,
            ends,
            lambda s, e: F.struct(
                s.alias("start"), (-e).alias("minus_end"), rule["priority"].alias("priority"),
                rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            ),
        )

    return F.array_sort(F.flatten(F.transform(hits, matches)))


def _survivors(detections: Column) -> Column:
    """Labels and best confidence of detections that do not lie inside an earlier one, in one pass."""
    start = F.struct(
        F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence")
    )

    def step(state: Column, d: Column) -> Column:
        outside = -d["minus_end"] > state["reach"]
        return F.struct(
            F.greatest(state["reach"], -d["minus_end"]).alias("reach"),
            F.when(outside, F.array_union(state["labels"], F.array(d["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(outside, F.greatest(state["confidence"], d["confidence"])).otherwise(state["confidence"]).alias("confidence"),
        )

    return F.aggregate(detections, start, step)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: word count, places and labels of the base phrases, all labels and a score.

    The score is 1 with a base phrase, else the best confidence of a surviving rule, else 0. Null and empty texts have no
    words, places or labels; repeated rows and null ids keep their row; an empty table gives an empty result; other
    columns are not looked at.
    """
    low = F.col("_low")
    gate = reduce(lambda a, b: a | b, [low.contains(word) for word in GATES]) | (low.contains("cc") & low.rlike(f"cc{_GAP}by"))
    joined = F.when(gate, F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1)), " "), F.lit(" ")))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), lowered(text).alias("_low"))
    rows = rows.select("doc_id", F.regexp_count(low, F.lit(WORD)).cast("long").alias("n_words"), joined.alias("_joined"))
    base = [F.when(F.contains("_joined", F.lit(f" {p} ")), _places(F.col("_joined"), F.lit(f"(?<= ){p}(?= )"))[0]) for p, _ in BASE]
    none = F.array().cast("array<int>")
    rows = rows.select("doc_id", "n_words", "_joined", _hits(F.col("_joined")).alias("_hits"), *[F.coalesce(b, none).alias(f"_b{i}") for i, b in enumerate(base)])
    every = F.concat(*[F.col(f"_b{i}") for i in range(len(BASE))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(n)) for i, (_, n) in enumerate(BASE)]))
    empty = F.struct(F.lit(-1).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"))
    found = F.when(F.coalesce(F.size("_hits"), F.lit(0)) == 0, empty).otherwise(_survivors(_detections(F.col("_joined"), F.col("_hits"))))
    rows = rows.select("doc_id", "n_words", every.alias("_at"), labels.alias("_base"), found.alias("_found"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        join(F.col("_base")).alias("base_labels"),
        join(F.concat("_base", "_found.labels")).alias("labels"),
        F.when(F.size("_at") > 0, 1.0).otherwise(F.col("_found.confidence")).alias("score"),
    )
