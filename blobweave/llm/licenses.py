"""License scan: ordered signature rules with a keyword gate and suppression of overlaps.

A text is lower-cased and cut into words, which are joined by single spaces; the
rules are regular expressions over that.  A rule is tried only where its keyword
occurs.  Of the detections found, the one of highest priority (then the longest,
the first, the earliest rule) is accepted first, and any other whose interval an
accepted one contains is suppressed.  The base phrases are counted at all places
and their labels always stay.

Defined results: a null text has no words; no phrase gives null places, empty
labels and score 0; repeated rows are scanned alike.  Texts are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices_of, texts_of

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_CONFIDENCE = 0.9
#: Bytes of text that are scanned before results are passed on.
SLICE_BYTES = 2_000_000

#: Signature families, written by hand: label, keyword, priority, patterns, versions.  {v} stands for each
#: version in turn ("2 0" is version 2.0, as points separate words); a label gets its version behind a dash.
FAMILIES = [
    ("apache", "apache", 80, ["apache license(?: version)? {v}", "apache software license(?: version)? {v}", "spdx license identifier apache {v}", "apache org licenses license {v}"], ["1 0", "1 1", "2 0"]),
    ("apache", "apache", 50, ["licensed under the apache license", "apache (?:software )?license"], []),
    ("gpl", "general public license", 80, ["gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) {v}", "general public license v{v}", "version {v} of the (?:gnu )?general public license"], ["1", "2", "3", "2 0", "3 0"]),
    ("gpl", "gpl", 80, ["gpl ?v?{v}(?: only| or later)?", "gnu gpl(?: version)? {v}", "spdx license identifier gpl {v}"], ["1", "2", "3", "2 0", "3 0"]),
    ("lgpl", "lesser general public license", 85, ["lesser general public license(?: version| v)? {v}", "version {v} of the (?:gnu )?lesser general public license"], ["2", "2 1", "3", "3 0"]),
    ("lgpl", "library general public license", 85, ["library general public license(?: version| v)? {v}"], ["2", "2 0"]),
    ("lgpl", "lgpl", 85, ["lgpl ?v?{v}(?: only| or later)?", "spdx license identifier lgpl {v}"], ["2", "2 1", "3", "3 0"]),
    ("lgpl", "lesser general public license", 60, ["gnu lesser general public license"], []),
    ("agpl", "affero general public license", 85, ["affero general public license(?: version| v)? {v}", "version {v} of the (?:gnu )?affero general public license"], ["1", "3", "3 0"]),
    ("agpl", "agpl", 85, ["agpl ?v?{v}(?: only| or later)?"], ["1", "3", "3 0"]),
    ("agpl", "affero general public license", 60, ["gnu affero general public license"], []),
    ("gfdl", "free documentation license", 80, ["free documentation license(?: version| v)? {v}"], ["1 1", "1 2", "1 3"]),
    ("gfdl", "free documentation license", 50, ["gnu free documentation license"], []),
    ("mpl", "mozilla", 80, ["mozilla public license(?: version| v)? {v}", "mozilla org mpl {v}"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", 75, ["mpl ?v?{v}", "subject to the terms of the mozilla public license v {v}"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", 80, ["eclipse public license(?: version| v)? {v}", "eclipse org legal epl v{v}"], ["1 0", "2 0"]),
    ("edl", "eclipse", 75, ["eclipse distribution license(?: version| v)? {v}"], ["1 0"]),
    ("cddl", "common development and distribution", 80, ["common development and distribution license(?: cddl)?(?: version| v)? {v}"], ["1 0", "1 1"]),
    ("cddl", "cddl", 70, ["cddl ?{v}"], ["1 0", "1 1"]),
    ("cpl", "common public license", 75, ["common public license(?: version| v)? {v}"], ["1 0"]),
    ("ipl", "ibm public license", 75, ["ibm public license(?: version| v)? {v}"], ["1 0"]),
    ("eupl", "european union public", 80, ["european union public licen[cs]e(?: version| v)? {v}"], ["1 0", "1 1", "1 2"]),
    ("eupl", "eupl", 75, ["eupl ?v?{v}"], ["1 0", "1 1", "1 2"]),
    ("osl", "open software license", 75, ["open software license(?: version| v)? {v}"], ["1 0", "1 1", "2 0", "2 1", "3 0"]),
    ("afl", "academic free license", 75, ["academic free license(?: version| v)? {v}"], ["1 1", "1 2", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic", 70, ["artistic license(?: version)? {v}"], ["1 0", "2 0"]),
    ("artistic", "artistic", 50, ["under the artistic license", "clarified artistic license"], []),
    ("ecl", "educational community", 75, ["educational community license(?: version| v)? {v}"], ["1 0", "2 0"]),
    ("rpl", "reciprocal public", 75, ["reciprocal public license(?: version| v)? {v}"], ["1 1", "1 5"]),
    ("cecill", "cecill", 75, ["cecill(?: version| v)? ?{v}", "cecill (?:free software )?license agreement version {v}"], ["1", "1 0", "2", "2 0", "2 1"]),
    ("cecill-b", "cecill b", 76, ["cecill b(?: version| v)? ?{v}"], ["1", "1 0"]),
    ("cecill-c", "cecill c", 76, ["cecill c(?: version| v)? ?{v}"], ["1", "1 0"]),
    ("mulan", "mulan", 75, ["mulan psl v{v}", "mulan permissive software license(?: version| v)? ?{v}"], ["1", "2"]),
    ("ofl", "open font", 75, ["(?:sil )?open font license(?: version| v)? {v}"], ["1 0", "1 1"]),
    ("odbl", "open database", 75, ["open database license(?: odbl)?(?: version| v)? ?{v}"], ["1 0"]),
    ("odc-by", "open data commons", 75, ["open data commons attribution license(?: version| v)? ?{v}"], ["1 0"]),
    ("pddl", "public domain dedication", 75, ["open data commons public domain dedication(?: and)? license"], []),
    ("bsd-0-clause", "bsd", 70, ["(?:bsd (?:0|zero) clause|0bsd)"], []),
    ("bsd-2-clause", "bsd", 70, ["bsd (?:2|two) clause", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", "bsd", 70, ["bsd (?:3|three) clause", "(?:new|modified|revised) bsd license"], []),
    ("bsd-4-clause", "bsd", 70, ["bsd (?:4|four) clause", "original bsd license"], []),
    ("bsd", "bsd", 40, ["bsd (?:style )?licen[cs]ed?", "under the bsd license"], []),
    ("bsd", "redistribution and use", 60, ["redistribution and use in source and binary forms with or without modification are permitted"], []),
    ("bsd-3-clause", "neither the name", 65, ["neither the names? of (?:the )?(?:copyright holders?|authors?|organization|university|company)"], []),
    ("bsd-3-clause", "endorse or promote", 65, ["may be used to endorse or promote products derived from this software"], []),
    ("mit", "mit", 60, ["mit licen[cs]ed?", "under the mit license", "the mit license(?: mit)?", "spdx license identifier mit"], []),
    ("mit", "free of charge", 65, ["permission is hereby granted free of charge to any person obtaining a copy of this software"], []),
    ("mit", "as is", 45, ["the software is provided as is without warranty of any kind express or implied"], []),
    ("isc", "isc", 60, ["isc licen[cs]ed?", "spdx license identifier isc"], []),
    ("isc", "with or without fee", 65, ["permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"], []),
    ("zlib", "zlib", 55, ["zlib(?: libpng)? licen[cs]e"], []),
    ("zlib", "without any express", 60, ["this software is provided as is without any express or implied warranty"], []),
    ("boost", "boost", 70, ["boost software license(?: version)? {v}", "distributed under the boost software license version {v}"], ["1 0"]),
    ("unlicense", "unlicense", 70, ["the unlicense", "unlicense org"], []),
    ("unlicense", "unencumbered", 70, ["this is free and unencumbered software released into the public domain"], []),
    ("wtfpl", "do what the", 70, ["do what the \\w+ you want to public license"], []),
    ("psf", "python software foundation", 70, ["python software foundation license(?: version)? {v}"], ["2"]),
    ("psf", "psf", 55, ["psf license(?: agreement)?"], []),
    ("php", "php license", 70, ["php license(?: version)? {v}"], ["2 02", "3 0", "3 01"]),
    ("postgresql", "postgresql", 60, ["postgresql licen[cs]e"], []),
    ("openssl", "openssl", 60, ["openssl licen[cs]e", "openssl project for use in the openssl toolkit"], []),
    ("ruby", "ruby", 55, ["ruby licen[cs]e", "same terms as ruby"], []),
    ("perl", "perl", 55, ["same terms as perl(?: itself)?"], []),
    ("vim", "vim", 55, ["vim licen[cs]e"], []),
    ("ms-pl", "microsoft", 65, ["microsoft public license"], []),
    ("ms-rl", "microsoft", 65, ["microsoft reciprocal license"], []),
    ("upl", "universal permissive", 70, ["universal permissive license(?: version| v)? {v}"], ["1 0"]),
    ("ncsa", "ncsa", 65, ["(?:university of illinois )?ncsa open source license"], []),
    ("w3c", "w3c", 60, ["w3c software(?: notice and)? licen[cs]e"], []),
    ("x11", "x11", 60, ["x11 licen[cs]e", "mit x11"], []),
    ("cc0", "cc0", 80, ["cc0(?: {v})?(?: universal)?", "cc0 {v} universal public domain dedication"], ["1 0"]),
    ("cc0", "creative commons", 75, ["creative commons (?:public domain dedication|zero)"], []),
    ("cc", "creative commons", 30, ["creative commons(?: public)? license", "creative commons"], []),
    ("public-domain", "public domain", 50, ["(?:released|placed|dedicated) (?:in|into|to) the public domain", "in the public domain", "public domain"], []),
    ("copyright", "copyright", 35, ["copyright(?: c)? (?:19|20)\\d\\d(?: (?:19|20)\\d\\d)?", "copyright by \\w+", "copyrighted material"], []),
    ("reserved", "reserved", 40, ["all rights (?:are )?reserved", "some rights reserved", "no part of this (?:publication|book|work) may be reproduced"], []),
    ("proprietary", "proprietary", 45, ["proprietary and confidential", "proprietary (?:license|software|information)"], []),
    ("proprietary", "unauthorized", 50, ["unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|work|software)"], []),
    ("no-commercial", "commercial use", 40, ["non ?commercial use only", "not for commercial use", "for non ?commercial use"], []),
    ("permission", "permission", 35, ["(?:used|reprinted|reproduced) (?:with|by) permission", "without (?:the )?(?:prior )?written permission"], []),
    ("terms", "terms of use", 30, ["subject to (?:the|our) terms of use", "terms of use apply"], []),
    ("licensed", "licen", 20, ["licen[cs]ed under(?: the)?(?: terms of)?", "released under (?:the|a) \\w+(?: \\w+)? licen[cs]e", "see (?:the )?licen[cs]e(?: file)? for (?:more )?(?:details|information)"], []),
    ("bsd", "redistributions", 58, ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"], []),
    ("bsd-4-clause", "advertising", 68, ["all advertising materials mentioning features or use of this software must display"], []),
    ("bsd-protection", "bsd protection", 65, ["bsd protection license"], []),
    ("bsd-patent", "bsd", 66, ["bsd (?:2 clause )?plus patent", "bsd 2 clause patent"], []),
    ("mit", "above copyright notice", 55, ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"], []),
    ("mit-0", "mit", 68, ["mit no attribution", "mit 0 licen[cs]e"], []),
    ("mit-modern", "modern variant", 60, ["mit license modern variant"], []),
    ("apache", "apache", 55, ["you may not use this file except in compliance with the license", "apache org licenses", "asl 2 0"], []),
    ("apache", "unless required by", 45, ["unless required by applicable law or agreed to in writing"], []),
    ("gpl", "gnu", 45, ["gnu gpl", "gnu public license", "gnu copyleft"], []),
    ("gpl", "free software foundation", 50, ["published by the free software foundation", "as published by the free software foundation either version"], []),
    ("gpl", "any later version", 40, ["or (?:at your option )?any later version"], []),
    ("gpl", "without even the implied", 55, ["without even the implied warranty of merchantability or fitness for a particular purpose"], []),
    ("gpl-classpath", "classpath exception", 88, ["classpath exception", "with the classpath exception"], []),
    ("gpl-linking", "linking exception", 80, ["(?:static|dynamic) linking exception", "linking exception"], []),
    ("lgpl", "lgpl", 60, ["gnu lgpl", "under the lgpl"], []),
    ("agpl", "agpl", 60, ["gnu agpl", "under the agpl"], []),
    ("sspl", "server side public", 78, ["server side public license(?: version| v)? ?1?", "sspl v?1"], []),
    ("busl", "business source", 78, ["business source license(?: 1 1)?", "busl 1 1"], []),
    ("elastic", "elastic license", 75, ["elastic license(?: 2 0)?"], []),
    ("commons-clause", "commons clause", 75, ["commons clause(?: license condition)?"], []),
    ("confluent", "confluent community", 70, ["confluent community license"], []),
    ("polyform", "polyform", 75, ["polyform (?:noncommercial|small business|free trial|internal use|shield|perimeter) license"], []),
    ("prosperity", "prosperity public", 72, ["prosperity public license"], []),
    ("parity", "parity public", 72, ["parity public license"], []),
    ("blueoak", "blue oak", 75, ["blue oak model license"], []),
    ("hippocratic", "hippocratic", 75, ["hippocratic license"], []),
    ("json", "good not evil", 75, ["the software shall be used for good not evil"], []),
    ("beerware", "beer", 70, ["beer ?ware license", "buy me a beer in return"], []),
    ("catosl", "computer associates", 65, ["computer associates trusted open source license"], []),
    ("sleepycat", "sleepycat", 68, ["sleepycat (?:public )?license"], []),
    ("qpl", "q public", 68, ["q public license"], []),
    ("npl", "netscape public", 68, ["netscape public license"], []),
    ("nposl", "non profit open software", 70, ["non profit open software license"], []),
    ("spl", "sun public", 66, ["sun public license"], []),
    ("sissl", "sun industry standards", 68, ["sun industry standards source license"], []),
    ("scsl", "sun community source", 66, ["sun community source license"], []),
    ("apsl", "apple public source", 70, ["apple public source license"], []),
    ("rpsl", "realnetworks", 68, ["realnetworks public source license"], []),
    ("nokia", "nokia open source", 66, ["nokia open source license"], []),
    ("intel", "intel open source", 66, ["intel open source license"], []),
    ("lucent", "lucent public", 66, ["lucent public license"], []),
    ("motosoto", "motosoto", 64, ["motosoto open source license"], []),
    ("naumen", "naumen", 64, ["naumen public license"], []),
    ("nethack", "nethack", 64, ["nethack general public license"], []),
    ("oclc", "oclc", 64, ["oclc research public license"], []),
    ("ogl", "open government licen", 72, ["open government licen[cs]e(?: version| v)? ?[123]?(?: 0)?"], []),
    ("ogc", "open geospatial", 64, ["open geospatial consortium (?:software )?license"], []),
    ("oml", "open market", 62, ["open market license"], []),
    ("ldp", "linux documentation project", 64, ["linux documentation project copying license", "ldp general public license"], []),
    ("opl", "open publication", 66, ["open publication licen[cs]e"], []),
    ("open-content", "open content", 64, ["open content licen[cs]e"], []),
    ("fal", "free art", 66, ["free art license", "licence art libre"], []),
    ("dsl", "design science", 64, ["design science license"], []),
    ("cdla", "community data license", 74, ["community data license agreement (?:permissive|sharing)"], []),
    ("dl-de", "datenlizenz deutschland", 72, ["datenlizenz deutschland (?:namensnennung|zero)"], []),
    ("etalab", "licence ouverte", 70, ["licence ouverte(?: open licence)?", "etalab 2 0"], []),
    ("open-data", "open data license", 55, ["under an open data license", "open data license"], []),
    ("bigscience", "rail", 74, ["bigscience (?:open ?)?rail", "open ?rail(?: m)? license", "responsible ai license"], []),
    ("llama", "llama", 74, ["llama(?: \\d)?(?: \\d)? community license(?: agreement)?"], []),
    ("community-license", "community license agreement", 60, ["\\w+ community license agreement"], []),
    ("lppl", "latex project public", 70, ["latex project public license"], []),
    ("gust", "gust font", 68, ["gust font license"], []),
    ("bitstream", "bitstream vera", 66, ["bitstream vera (?:fonts )?copyright"], []),
    ("ubuntu-font", "ubuntu font", 68, ["ubuntu font licen[cs]e"], []),
    ("arphic", "arphic", 66, ["arphic public license"], []),
    ("imagemagick", "imagemagick", 62, ["imagemagick license"], []),
    ("libpng", "libpng", 62, ["libpng license", "png reference library license"], []),
    ("libtiff", "libtiff", 62, ["libtiff license"], []),
    ("curl", "curl", 58, ["curl license"], []),
    ("jpeg", "independent jpeg group", 64, ["independent jpeg group"], []),
    ("unicode", "unicode", 60, ["unicode (?:license|terms of use)"], []),
    ("icu", "icu", 58, ["icu license"], []),
    ("tcl", "tcl", 55, ["tcl tk license"], []),
    ("xnet", "x net", 55, ["x net license"], []),
    ("zope", "zope public", 68, ["zope public license"], []),
    ("plexus", "plexus", 55, ["plexus classworlds license"], []),
    ("spencer", "henry spencer", 55, ["henry spencer regex library license"], []),
    ("hpnd", "historical permission", 66, ["historical permission notice and disclaimer"], []),
    ("fair", "fair license", 60, ["usage of the works is permitted provided that this instrument is retained", "under the fair license"], []),
    ("0bsd", "with or without fee", 60, ["use copy modify and or distribute this software for any purpose with or without fee"], []),
    ("multics", "multics", 55, ["multics license"], []),
    ("entessa", "entessa", 55, ["entessa public license"], []),
    ("watcom", "sybase open watcom", 62, ["sybase open watcom public license"], []),
    ("vovida", "vovida", 58, ["vovida software license"], []),
    ("frameworx", "frameworx", 58, ["frameworx open license"], []),
    ("jabber", "jabber open source", 60, ["jabber open source license"], []),
    ("ricoh", "ricoh source code", 60, ["ricoh source code public license"], []),
    ("sugarcrm", "sugarcrm", 60, ["sugarcrm public license"], []),
    ("yahoo", "yahoo public", 60, ["yahoo public license"], []),
    ("eula", "end user license agreement", 50, ["end user license agreement", "this license agreement is a legal agreement between you"], []),
    ("trial", "evaluation", 40, ["for evaluation purposes only", "evaluation license agreement"], []),
    ("academic", "academic use", 45, ["for academic use only", "for (?:research|educational) purposes only", "non commercial research purposes"], []),
    ("personal", "personal use", 40, ["for personal use only", "personal and non commercial use"], []),
    ("no-redistribution", "redistribut", 45, ["may not be (?:published|broadcast) rewritten or redistributed", "redistribution (?:is )?(?:strictly )?prohibited", "do not redistribute"], []),
    ("no-copying", "may be reproduced", 44, ["may not be reproduced", "may be reproduced in any form", "may be reproduced without permission"], []),
    ("no-derivatives", "derivative", 42, ["no derivative works?", "derivative works are not permitted"], []),
    ("attribution", "attribution", 32, ["attribution required", "attribution is required", "with proper attribution"], []),
    ("fair-use", "fair use", 30, ["fair use notice", "fair use (?:act|doctrine)"], []),
    ("dmca", "dmca", 40, ["dmca (?:notice|takedown|policy)", "digital millennium copyright act"], []),
    ("trademark", "trademark", 30, ["registered trademarks? of", "trademarks? (?:are|is) the property of (?:their|its) respective owners?"], []),
    ("patent", "patent", 30, ["patent pending", "protected by (?:us )?patents?"], []),
    ("confidential", "confidential", 40, ["strictly confidential", "confidential and proprietary", "company confidential"], []),
    ("crown", "crown copyright", 55, ["crown copyright"], []),
    ("us-government", "united states government", 52, ["works? of the united states government", "united states government works?"], []),
    ("copyleft", "copyleft", 45, ["strong copyleft", "weak copyleft", "copyleft license"], []),
    ("licensed", "permission", 30, ["permission is granted to (?:anyone|copy|make)", "permission is hereby granted"], []),
    ("warranty", "warrant", 25, ["without warranty of any kind", "no express or implied warranties", "disclaims? all warranties"], []),
    ("liability", "liable", 25, ["in no event shall the (?:authors?|copyright holders?|contributors) be liable", "shall not be held liable for any damages"], []),
]
#: Creative Commons licenses are built by rule: each set of terms, each version, short and long names.
CC_TERMS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: bytes
    priority: int
    pattern: re.Pattern[bytes]


def sure_texts(pattern: str) -> list[str]:
    """Texts that whatever ``pattern`` matches holds: what lies outside of groups, classes and optional letters."""
    for part in (r"\[[^\]]*\][?*+]?", r"\\[a-z][?*+]?"):
        pattern = re.sub(part, "\0", pattern)
    while (shorter := re.sub(r"\((?:\?:)?[^()]*\)[?*+]?", "\0", pattern)) != pattern:
        pattern = shorter
    return [text for text in re.sub(r".[?*]", "\0", pattern).strip().split("\0") if text.strip()]


def make_rules() -> list[Rule]:
    """All rules in order: the families, each version of each pattern, then Creative Commons.

    A rule's keyword is its family's if all that the pattern matches holds it, else the longest text that does.
    """

    def rule(label: str, keyword: str, priority: int, pattern: str) -> Rule:
        sure = sure_texts(pattern)
        if sure and not any(keyword in text for text in sure):
            keyword = max(sure, key=len)
        return Rule(label, keyword.encode(), priority, re.compile(f"(?<= ){pattern.strip()}(?= )".encode()))

    rules = []
    for label, keyword, priority, patterns, versions in FAMILIES:
        for pattern in patterns:
            for v in versions or [""]:
                name = f"{label}-{v.replace(' ', '.')}" if v else label
                rules.append(rule(name, keyword, priority + 2 * len(v.split()), pattern.replace("{v}", v)))
    for short, long in CC_TERMS.items():
        name = f"cc-{short.replace(' ', '-')}"
        terms = 10 * len(short.split())
        for v in CC_VERSIONS:
            rules.append(rule(f"{name}-{v.replace(' ', '.')}", "cc", 60 + terms, f"cc {short}(?: license)? {v}"))
            rules.append(rule(f"{name}-{v.replace(' ', '.')}", "creative commons", 60 + terms, f"creative commons {long}(?: license)?(?: version)? {v}"))
            rules.append(rule(f"{name}-{v.replace(' ', '.')}", "creativecommons", 60 + terms, f"creativecommons org licenses {short} {v}"))
        rules.append(rule(name, "cc", 50 + terms, f"cc {short}"))
        rules.append(rule(name, "creative commons", 50 + terms, f"creative commons {long}"))
    return rules


RULES = make_rules()
KEYWORDS = sorted({r.keyword for r in RULES})
PHRASES = {f" {phrase} ".encode(): label for phrase, label in BASE.items()}
#: One entry per byte: A-Z in lower case, ASCII other than letters and digits a space.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass
class Scan:
    n_words: int
    places: list[int]
    base_labels: list[str]
    detections: list[tuple[int, int, str, int]]  # first character, end, label, priority

    @property
    def labels(self) -> list[str]:
        return sorted({*self.base_labels, *(d[2] for d in self.detections)})

    @property
    def score(self) -> float:
        """1 - the product of what each label leaves open: a priority of p leaves 1 - p / 110."""
        best = dict.fromkeys(self.base_labels, BASE_CONFIDENCE)
        for _, _, label, priority in self.detections:
            best[label] = max(best.get(label, 0.0), min(priority, 100) / 110)
        open_ = 1.0
        for label in sorted(best):
            open_ *= 1 - best[label]
        return 1 - open_


def suppress(found: list[tuple[int, int, int, int, str]]) -> list[tuple[int, int, str, int]]:
    """Detections (priority, start, end, rule, label) without those that an accepted one contains.

    Detections are taken in order of rank.  ``reach`` holds, for accepted starts in
    order, ends that grow: an interval is contained exactly if the last start at or
    before its own has an end at or beyond its own.
    """
    kept: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    reach: list[int] = []
    for priority, start, end, _, label in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        at = bisect_right(starts, start)
        if at and reach[at - 1] >= end:
            continue
        kept.append((start, end, label, priority))
        # intervals that this one reaches beyond tell nothing more
        to = at
        while to < len(starts) and reach[to] <= end:
            to += 1
        if at and starts[at - 1] == start:
            at -= 1
        starts[at:to], reach[at:to] = [start], [end]
    return sorted(kept)


def scan(text: bytes) -> Scan:
    words = text.translate(_FOLD).split()
    if not words:
        return Scan(0, [], [], [])
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        at, upto, before = joined.find(phrase), 0, 0
        while at >= 0:
            before, upto = before + joined.count(b" ", upto, at), at  # spaces before the phrase
            places.append(before)
            base.add(label)
            at = joined.find(phrase, at + 1)
    here = {k for k in KEYWORDS if k in joined}
    found = []
    if here:
        for number, rule in enumerate(RULES):
            if rule.keyword in here:
                found += [(rule.priority, m.start(), m.end(), number, rule.label) for m in rule.pattern.finditer(joined)]
    return Scan(len(words), places, sorted(base), suppress(found))


OUT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string,priority:long>>"


def scan_documents(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with what the scan of ``text`` found; detections hold character places in the joined words."""
    schema = T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(OUT).fields)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices_of(batches, SLICE_BYTES):
            got = [scan(t) for t in texts_of(batch["text"])]
            columns = [
                pa.array([s.n_words for s in got], pa.int64()), pa.array([len(s.places) for s in got], pa.int64()),
                pa.array([min(s.places, default=None) for s in got], pa.int64()), pa.array([max(s.places, default=None) for s in got], pa.int64()),
                pa.array([",".join(s.base_labels) for s in got], pa.string()), pa.array([",".join(s.labels) for s in got], pa.string()), pa.array([s.score for s in got], pa.float64()),
                pa.array([[dict(zip(("start", "end", "label", "priority"), d, strict=True)) for d in s.detections] for s in got], span),
            ]
            yield pa.RecordBatch.from_arrays([batch[c] for c in keep] + columns, schema.names)

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")
