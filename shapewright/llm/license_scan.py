"""Operator 7: license scan by ordered signature rules.

A rule is a hand-written expression over a text's lower-cased words joined by single blanks, with a
keyword that must be in the text (one Aho-Corasick pass finds all keywords), a label, a priority and
a confidence. Of detections that read one place, the one of highest priority stands: one that lies
inside a standing one, or overlaps it with the same label or in the license's name, is suppressed.
Neighbours that share but a word like "license" both stand. The base phrases are found apart from the rules and always stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, utf8_buffers, with_fields

BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# label | name in words, an expression | words of its SPDX id
FAMILIES = r"""
mit | (?:mit|expat)(?: style)? | mit
apache-2 | apache(?: software foundation)?(?: software)?(?: license)?(?: version| v)? ?2(?: 0)? | apache 2 0
apache-1.1 | apache(?: software)? license(?: version| v)? 1 1 | apache 1 1
gpl-1 | gnu (?:general public license|gpl)(?: version| v)? ?1(?: 0)? | gpl 1 0(?: only| or later)?
gpl-2 | gnu (?:general public license|gpl)(?: version| v)? ?2(?: 0)? | gpl 2 0(?: only| or later)?
gpl-3 | gnu (?:general public license|gpl)(?: version| v)? ?3(?: 0)? | gpl 3 0(?: only| or later)?
lgpl-2 | gnu (?:library|lesser) general public license(?: version| v)? ?2(?: 0)? | lgpl 2 0(?: only| or later)?
lgpl-2.1 | gnu (?:lesser general public license|lgpl)(?: version| v)? 2 1 | lgpl 2 1(?: only| or later)?
lgpl-3 | gnu (?:lesser general public license|lgpl)(?: version| v)? ?3(?: 0)? | lgpl 3 0(?: only| or later)?
agpl-3 | (?:gnu )?(?:affero general public license|agpl)(?: version| v)? ?3(?: 0)? | agpl 3 0(?: only| or later)?
gfdl-1 | gnu free documentation license(?: version| v)?(?: 1 [123])? | gfdl 1 [123](?: only| or later)?
bsd-2-clause | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) | bsd 2 clause
bsd-3-clause | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd) | bsd 3 clause
bsd-4-clause | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) | bsd 4 clause
0bsd | (?:zero clause bsd|bsd zero clause|0bsd) | 0bsd
isc | (?:isc|internet systems consortium) | isc
mpl-1.1 | mozilla public license(?: version| v)? 1 [01] | mpl 1 [01]
mpl-2 | mozilla public license(?: version| v)? ?2(?: 0)? | mpl 2 0
epl-1 | eclipse public license(?: version| v)? ?1(?: 0)? | epl 1 0
epl-2 | eclipse public license(?: version| v)? ?2(?: 0)? | epl 2 0
eupl-1.2 | european union public licen[cs]e(?: version| v)?(?: 1 [12])? | eupl 1 [12]
cddl-1 | common development and distribution license(?: version| v)?(?: 1 [01])? | cddl 1 [01]
cpl-1 | common public license(?: version| v)?(?: 1 0)? | cpl 1 0
artistic-1 | artistic license(?: version| v)? ?1(?: 0)? | artistic 1 0
artistic-2 | artistic license(?: version| v)? ?2(?: 0)? | artistic 2 0
bsl-1 | boost software license(?: version| v)?(?: 1 0)? | bsl 1 0
zlib | (?:zlib|zlib libpng) | zlib
unlicense | unlicense | unlicense
wtfpl | do what the f\w+ you want to public license | wtfpl
cc0-1 | (?:cc0|creative commons zero)(?: 1 0)?(?: universal)? | cc0 1 0
cc-by | (?:cc by|creative commons attribution)(?: [1-4] [05])?(?! nc| sa| nd| non| share| no) | cc by [1-4] [05]
cc-by-sa | (?:cc by sa|creative commons attribution share ?alike)(?: [1-4] [05])? | cc by sa [1-4] [05]
cc-by-nd | (?:cc by nd|creative commons attribution no ?deriv\w*)(?: [1-4] [05])? | cc by nd [1-4] [05]
cc-by-nc | (?:cc by nc(?! sa| nd)|creative commons attribution non ?commercial)(?: [1-4] [05])?(?! share| no) | cc by nc [1-4] [05]
cc-by-nc-sa | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] [05])? | cc by nc sa [1-4] [05]
cc-by-nc-nd | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)(?: [1-4] [05])? | cc by nc nd [1-4] [05]
odbl-1 | open (?:data commons open )?database license(?: version| v)?(?: 1 0)? | odbl 1 0
ofl-1.1 | (?:sil )?open font license(?: version| v)?(?: 1 [01])? | ofl 1 [01]
ms-pl | microsoft public license | ms pl
ms-rl | microsoft reciprocal license | ms rl
python-2 | python(?: software foundation)? license(?: version| v)?(?: 2(?: 0)?)? | psf 2 0
php-3 | php license(?: version| v)?(?: 3 0[01])? | php 3 0[01]?
ruby | ruby license | ruby
postgresql | postgresql licen[cs]e | postgresql
openssl | openssl license | openssl
curl | curl license | curl
w3c | w3c software(?: notice and)? license | w3c
x11 | (?:x11|x consortium) | x11
ncsa | (?:ncsa|university of illinois ncsa) open source license | ncsa
vim | vim license | vim
bsl-1.1 | business source license(?: version| v)?(?: 1 [01])? | busl 1 1
sspl-1 | server side public license(?: version| v)?(?: 1(?: 0)?)? | sspl 1 0
elastic-2 | elastic license(?: version| v)?(?: 2(?: 0)?)? | elastic 2 0
all-rights-reserved | all rights reserved | all rights reserved
"""

# form of a mention | priority | confidence | keywords, one of which each match has. NAME and SPDX stand for the family's.
FORMS = (
    (r"spdx license identifier SPDX", 50, 1.0, ("spdx",)),
    (
        r"(?:licensed|released|distributed|available|published|provided|covered)(?: to you)? (?:under|by|with)(?: the)?(?: terms of(?: the)?)?(?: conditions of(?: the)?)? NAME(?: license)?",
        40,
        0.95,
        ("licensed", "released", "distributed", "available", "published", "provided", "covered"),
    ),
    (r"(?:under|subject to|according to|in accordance with)(?: the)?(?: terms of(?: the)?)? NAME licen[cs]e", 30, 0.9, ("licen",)),
    (r"(?:license|licence)(?: is)?(?: the)? NAME(?: license)?", 20, 0.8, ("licen",)),
    (r"NAME license(?: agreement)?", 10, 0.6, ("licen",)),
)
# label | short or unversioned name, as FAMILIES
SHORT = r"""
gpl-1 | gpl(?: license)?(?: version| ?v)? ?1(?: 0)? | gpl 1 0
gpl-2 | gpl(?: license)?(?: version| ?v)? ?2(?: 0)?(?! 1) | gpl 2 0
gpl-3 | gpl(?: license)?(?: version| ?v)? ?3(?: 0)? | gpl 3 0
lgpl-2 | lgpl(?: license)?(?: version| ?v)? ?2(?: 0)?(?! 1) | lgpl 2 0
lgpl-2.1 | lgpl(?: license)?(?: version| ?v)? ?2 1 | lgpl 2 1
lgpl-3 | lgpl(?: license)?(?: version| ?v)? ?3(?: 0)? | lgpl 3 0
agpl-3 | agpl(?: license)?(?: version| ?v)? ?3(?: 0)? | agpl 3 0
gpl | (?:gnu )?(?:(?<!lesser )(?<!library )(?<!affero )(?<!gnu )general public license|gnu general public license|gpl(?: license)?)(?!(?: version| ?v)? ?[123](?: |$)) | gpl
lgpl | (?:gnu )?(?:(?:lesser|library) general public license|lgpl(?: license)?)(?!(?: version| ?v)? ?[23](?: |$)) | lgpl
agpl | (?:gnu )?(?:affero general public license|agpl(?: license)?)(?!(?: version| ?v)? ?3(?: |$)) | agpl
bsd | bsd(?: style)?(?! [0234] clause| zero clause) | bsd
apache | apache(?: software)? license(?!(?: version| v)? ?[12](?: |$)) | apache
mpl-2 | mpl(?: version| ?v)? ?2(?: 0)? | mpl 2 0
epl-2 | epl(?: version| ?v)? ?2(?: 0)? | epl 2 0
"""
_BSD, _TAIL = "redistribution and use in source and binary forms", "(?:(?! redistribution and use in source).){0,2500}?"
_FREE = "permission is hereby granted free of charge to any person"
_ISC = "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"
# label | wording of a license or notice, an expression | keyword in it
BODIES = rf"""
mit | {_FREE} obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software | granted free of charge
ncsa | {_FREE} obtaining a copy of this software and associated documentation files(?: the software)? to deal with the software | granted free of charge
bsl-1 | {_FREE} or organization obtaining a copy of the software and accompanying documentation | granted free of charge
isc | {_ISC} provided that the above copyright notice and this permission notice appear in all copies(?!.{{0,900}}the name of a copyright holder shall not) | with or without fee
curl | {_ISC} provided that the above copyright notice and this permission notice appear in all copies(?=.{{0,900}}the name of a copyright holder shall not) | with or without fee
0bsd | {_ISC}(?! provided) | with or without fee
bsd-4-clause | {_BSD}(?={_TAIL} all advertising materials mentioning features)(?!{_TAIL} may not be called) | redistribution and use
bsd-3-clause | {_BSD}(?={_TAIL} (?:neither the name|may not be used to endorse))(?!{_TAIL} (?:all advertising materials mentioning|may not be called)) | redistribution and use
bsd-2-clause | {_BSD}(?={_TAIL} redistributions in binary form must reproduce)(?!{_TAIL} (?:all advertising materials mentioning|may not be called|neither the name|used to endorse)) | redistribution and use
bsd | {_BSD}(?!{_TAIL} (?:redistributions in binary form must reproduce|neither the name|all advertising materials mentioning|may not be called|used to endorse)) | redistribution and use
apache-1.1 | {_BSD}(?={_TAIL} may not be called apache) | redistribution and use
php-3 | {_BSD}(?={_TAIL} may not be called php) | redistribution and use
openssl | {_BSD}(?={_TAIL} may not be called openssl) | redistribution and use
apache-2 | apache org licenses license 2 0 | apache
apache-2 | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license | contributor
mpl-2 | each contributor hereby grants you a world wide royalty free non exclusive license | contributor
gpl-2 | gnu general public license as published by the free software foundation(?: either)? version 2 | free software foundation
gpl-3 | gnu general public license as published by the free software foundation(?: either)? version 3 | free software foundation
lgpl-2 | gnu (?:library|lesser) general public license as published by the free software foundation(?: either)? version 2(?! 1) | free software foundation
lgpl-2.1 | gnu lesser general public license as published by the free software foundation(?: either)? version 2 1 | free software foundation
lgpl-3 | gnu lesser general public license as published by the free software foundation(?: either)? version 3 | free software foundation
agpl-3 | gnu affero general public license as published by the free software foundation(?: either)? version 3 | free software foundation
gpl-3 | the gnu general public license is a free copyleft license for software and other kinds of works | copyleft
agpl-3 | the gnu affero general public license is a free copyleft license for software and other kinds of works | copyleft
unlicense | this is free and unencumbered software released into the public domain | unencumbered
zlib | in no event will the authors be held liable for any damages arising from the use of this software | held liable
wtfpl | you just do what the f\w+ you want to | you just do what
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement | without a written agreement
x11 | the name of the x consortium shall not be used | x consortium
python-2 | psf is making python available to licensee | psf
gpl-2 | the licenses for most software are designed to take away your freedom to share and change it | take away your freedom
gpl-3 | the licenses for most software and other practical works are designed to take away your freedom to share and change the works | take away your freedom
gpl-2 | this license applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this general public license | notice placed by the copyright
gpl-3 | you may convey verbatim copies of the program s source code as you receive it in any medium | convey verbatim
gpl-2 | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium | distribute verbatim
lgpl-2 | this license the library general public license applies to certain designated software libraries | designated software
lgpl-2.1 | this license the lesser general public license applies to some specially designated software packages | specially designated
lgpl-3 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license | incorporates the terms
agpl-3 | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network | remotely through
gfdl-1 | the purpose of this license is to make a manual textbook or other (?:functional and useful|written) document free in the sense of freedom | textbook
mpl-2 | this source code form is subject to the terms of the mozilla public license | source code form
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 [01] | contents of this file
cddl-1 | the contents of this file are subject to the terms of the common development and distribution license | contents of this file
epl-1 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 | accompanying materials
epl-2 | this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 | accompanying materials
epl-1 | the accompanying program is provided under the terms of this eclipse public license | accompanying program
cpl-1 | the accompanying program is provided under the terms of this common public license | accompanying program
apache-2 | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 | in compliance with the license
apache-2 | terms and conditions for use reproduction and distribution 1 definitions license shall mean the terms and conditions | reproduction and distribution
apache-2 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis | as is basis
artistic-1 | the intent of this document is to state the conditions under which a package may be copied | intent of this document
artistic-2 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed | given free software
zlib | this notice may not be removed or altered from any source distribution | removed or altered
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software | plainly marked
ofl-1.1 | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects | collaborative font
ofl-1.1 | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself | font software
cc0-1 | the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights | jurisdictions
cc0-1 | (?:has )?(?:dedicated the work to the public domain by )?waiv(?:ing|ed) all (?:of )?(?:his or her|their) rights to the work worldwide under copyright law | worldwide under copyright
cc-by | this work is licensed under a creative commons attribution (?:[1-4] [05] )?(?:international|generic|unported)(?: license)? | creative commons
cc-by-sa | this work is licensed under a creative commons attribution share ?alike (?:[1-4] [05] )?(?:international|generic|unported)(?: license)? | creative commons
cc-by-nc | this work is licensed under a creative commons attribution non ?commercial (?:[1-4] [05] )?(?:international|generic|unported)(?: license)? | creative commons
cc-by-nd | this work is licensed under a creative commons attribution no ?deriv(?:ative|atives|s) (?:[1-4] [05] )?(?:international|generic|unported)(?: license)? | creative commons
cc-by | creativecommons org licenses by [1-4] [05] | creativecommons
cc-by-sa | creativecommons org licenses by sa [1-4] [05] | creativecommons
cc-by-nd | creativecommons org licenses by nd [1-4] [05] | creativecommons
cc-by-nc | creativecommons org licenses by nc [1-4] [05] | creativecommons
cc-by-nc-sa | creativecommons org licenses by nc sa [1-4] [05] | creativecommons
cc-by-nc-nd | creativecommons org licenses by nc nd [1-4] [05] | creativecommons
cc0-1 | creativecommons org publicdomain zero 1 0 | creativecommons
gpl | gnu org licenses gpl | gnu org
lgpl | gnu org licenses lgpl | gnu org
agpl | gnu org licenses agpl | gnu org
mit | opensource org licenses mit(?: license)? | opensource org
bsd-2-clause | opensource org licenses bsd 2 clause | opensource org
bsd-3-clause | opensource org licenses bsd 3 clause | opensource org
isc | opensource org licenses isc(?: license)? | opensource org
mpl-2 | mozilla org mpl 2 0 | mozilla org
ms-pl | this license governs use of the accompanying software if you use the software you accept this license(?!.{0,1500}reciprocal grants) | accompanying software
ms-rl | this license governs use of the accompanying software if you use the software you accept this license(?=.{0,1500}reciprocal grants) | accompanying software
openssl | this product includes software developed by the openssl project for use in the openssl toolkit | openssl toolkit
php-3 | this product includes php software freely available from | php software
w3c | permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted | without fee or royalty
bsl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work | non production use
sspl-1 | if you make the functionality of the program or a modified version available to third parties as a service | as a service
elastic-2 | you may not provide the software to third parties as a hosted or managed service | managed service
eupl-1.2 | this european union public licen[cs]e the eupl applies to the work | eupl
odbl-1 | the open database license odbl is a license agreement intended to allow users to freely share modify and use this database | odbl
unlicense | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary | compiled binary
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed | changing it is allowed
json | the software shall be used for good not evil | not evil
beerware | if we meet some day and you think this stuff is worth it you can buy me a beer in return | buy me a beer
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted | without fee is hereby granted
icu | permission is hereby granted free of charge to any person obtaining a copy of the (?:unicode )?data files and any associated documentation | data files
cecill | this agreement is a free software license agreement that is the result of discussions between its authors | result of discussions
afl-3 | licensed under the academic free license(?: version)?(?: 3 0)? | academic free
osl-3 | licensed under the open software license(?: version)?(?: 3 0)? | open software license
commons-clause | the license does not grant to you the right to sell the software | right to sell
public-domain | (?:is|are|been) (?:hereby )?(?:released|placed|dedicated) (?:in|into|to) the public domain | public domain
all-rights-reserved | no part of this (?:publication|book|work|document) may be reproduced (?:distributed or transmitted |stored in a retrieval system )?(?:in any form )?(?:or by any means )?without (?:the )?(?:prior )?(?:written )?permission | may be reproduced
"""
FULL_NAME = (r"NAME", 15, 0.85)
#: Names that are said of licenses only, so that they count without "license" beside them; the keyword of each.
#: Every alternative of such a name has one of these keywords; "gpl" is in lgpl and agpl too.
TELLING = {"public licen": "public", "gpl": "gpl", "creative commons": "creative", "cc by": "cc", "cc0": "cc", "documentation license": "documentation", "font license": "font", "database license": "database", "distribution license": "distribution", "unlicense": "unlicense", "apache": "apache", "rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    label: str
    expression: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    confidence: float


def signature_rules() -> list[Rule]:
    """Every family and short name in every form, and the wordings: about 480 rules, most important first."""
    rules = []
    for line in (FAMILIES + SHORT).strip().splitlines():
        if not line:
            continue
        label, name, spdx = line.split(" | ")
        telling = [word for part, word in TELLING.items() if part in name]
        for form, priority, confidence, keywords in [*FORMS, *([(*FULL_NAME, tuple(telling))] if telling else [])]:
            body = form.replace("NAME", f"(?P<name>{name})").replace("SPDX", f"(?P<name>{spdx})")
            rules.append(Rule(label, re.compile(rf"(?<![^ ]){body}(?![^ ])"), keywords, priority, confidence))
    for line in BODIES.strip().splitlines():
        label, wording, keyword = line.split(" | ")
        rules.append(Rule(label, re.compile(rf"(?<![^ ])(?P<name>{wording})(?![^ ])"), (keyword,), 45, 0.95))
    return sorted(rules, key=lambda r: -r.priority)


class Scanner:
    def __init__(self) -> None:
        self.rules = signature_rules()
        self.by_keyword: dict[str, list[Rule]] = {}
        self.keywords = ahocorasick.Automaton()
        for r in self.rules:
            for key in r.keywords:
                self.by_keyword.setdefault(key, []).append(r)
        for key in self.by_keyword:
            self.keywords.add_word(key, key)
        self.keywords.make_automaton()
        self.table = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) that stand, in joined words."""
        keys = {key for _, key in self.keywords.iter(text)}
        rules = {id(r): r for key in keys for r in self.by_keyword[key]}
        found = [(m.span(), m.span("name"), r) for r in rules.values() for m in r.expression.finditer(text)]
        # important first, then long, then early
        found.sort(key=lambda d: (-d[2].priority, d[0][0] - d[0][1], d[0][0], d[2].label))
        standing: list[tuple[int, int, Rule]] = []
        # what stands, by the stretches of 256 characters that it reaches into: names don't overlap, so few share one
        near: dict[int, list[tuple[int, int, int, int, str]]] = {}
        for (a, b), (c, d), r in found:
            cells = range(a >> 8, (b - 1 >> 8) + 1)
            if not any((x <= a and b <= y) or (a < y and x < b and r.label == label) or (c < v and u < d) for k in cells for x, y, u, v, label in near.get(k, ())):
                standing.append((a, b, r))
                for k in cells:
                    near.setdefault(k, []).append((a, b, c, d, r.label))
        return sorted(standing, key=lambda d: d[:2])

    def scan(self, data: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = data.translate(self.table).split()
        text = b" ".join(words)
        base, places = set(), []
        for phrase, label in BASE.items():
            p = phrase.encode()
            if p in text:
                padded, p = b" " + text + b" ", b" " + p + b" "
                at, counted, word = padded.find(p), 0, 0
                while at >= 0:
                    word += padded.count(b" ", counted, at)
                    counted = at
                    places.append(word)
                    base.add(label)
                    at = padded.find(p, at + 1)
        labels, score = set(base), 1.0 if base else 0.0
        for _, _, r in self.detections(text.decode("utf-8", "replace")):
            labels.add(r.label)
            score = max(score, r.confidence)
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


_SCANNERS: list[Scanner] = []
COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id and the scan's columns.

    Null and empty texts have no words, no places, empty labels and score 0. Places are counted once
    per phrase; repeated rows are scanned alike; an empty table gives no rows. Texts are scanned whole,
    in time that grows with their length; of detections that tie in priority and length the first in the
    text stands, then the label first in the alphabet. Columns but doc_id and text aren't read.
    """
    docs = docs.select("doc_id", "text")

    def scanned(batches) -> Iterator[pa.RecordBatch]:
        if not _SCANNERS:
            _SCANNERS.append(Scanner())
        scan = _SCANNERS[0].scan
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            offsets, data = utf8_buffers(batch.column("text"))
            rows = [scan(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.mapInArrow(scanned, with_fields(docs.select("doc_id"), COLUMNS))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES: dict[str, str] = {}
