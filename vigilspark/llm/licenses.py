r"""License scans: ordered signature rules, gated by keywords, with suppression of what a better detection contains.

A rule has a label, a tier, a weight, a keyword and a regular expression. A text that holds none of the keywords is done
after one look. Otherwise the rules whose keyword occurs are run, and only these. Detections are intervals of characters.
Of two detections the one that lies inside the other goes if the other's tier is as good or better (tiers: 0 passages of license
texts and tags, 1 notices and addresses, 2 names with a version, 3 names); equal intervals of a tier keep the first rule of
the list. That relation is transitive, so what goes doesn't depend on the order of removal. Detections that only
overlap in part both stay.
Built-in functions only; one pass, no shuffle. Work grows with the length of the text and its detections.

Base phrases (mit license, apache license, general public license) are rules of their own that nothing suppresses in the
base columns. Null text: empty, no words, no labels, score 0. Repeated rows are scanned each; an empty table gives no rows.
Texts are scanned whole. Columns of docs that are named like a result give way to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans

WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"  # with A-Z: the letters before they become lower case
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TIERS = 4
LICENSE = ("license", "licence", "licensed", "licenced", "licenses", "licences")
#: How names of families are written as one word.
FAMILIES = {x: (x, f"{x}s", f"{x}ed", *[f"{x}{v}{n}" for v in ("", "v", "version") for n in "123"]) for x in ("gpl", "lgpl", "agpl")} | {
    f"commercial {x} only": ("commercial", "noncommercial") for x in ("use", "purposes")
}


@dataclass(frozen=True)
class Rule:
    label: str
    tier: int
    weight: float
    keyword: str  # without it the pattern can't match; it is sought in the text whose A-Z are lower case and whose characters outside words are single spaces
    pattern: str  # for Java, on text whose A-Z are lower case

    @property
    def gate(self) -> str:
        return re.sub("[^0-9a-z]+", " ", self.keyword)

    @property
    def stems(self) -> tuple[str, ...]:
        """Whole words of which a match has one at least."""
        if any(w.startswith("licen") for w in self.gate.split()):
            return LICENSE
        if self.gate in FAMILIES:
            return FAMILIES[self.gate]
        return (max(self.gate.split(), key=len),)


def phrase(words: str) -> str:
    """A pattern on whole words; a space stands for up to twenty characters that belong to none, so line breaks and comment marks don't matter.

    What precedes the first word is looked at after that word has been found: Java skips through a text to a literal word, but not to a look-behind.
    """
    first = re.match("[a-z0-9]+(?![?*{])", words)
    start = f"{first[0]}(?<!{WORD}{first[0]})" if first else f"(?<!{WORD})"
    return start + words[first.end() if first else 0 :].replace(".{", r"[\s\S]{").replace(" ", GAP + "{1,20}") + rf"(?!{WORD})"


def address(pattern: str) -> str:
    """The same for an address, which begins with a literal word."""
    first = re.match("[a-z0-9]+", pattern)[0]
    return f"{first}(?<!{WORD}{first})" + pattern[len(first) :]


# Passages that only the text of a license has: (label, keyword, pattern).
PASSAGES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", "permission to use", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-2-clause", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions"),
    ("bsd-2-clause", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name", "neither the names? of .{1,80}?nor the names of its contributors may be used to endorse"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "use reproduction and distribution", "terms and conditions for use reproduction and distribution"),
    ("apache-1.1", "end-user documentation", "the end user documentation included with the redistribution"),
    ("gpl", "redistribute it", "this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "everyone is permitted to copy", "everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("lgpl", "work that uses the library", "a work that uses the library"),
    ("agpl-3.0", "general public licen", "remote network interaction use with the gnu general public license"),
    ("mpl-2.0", "mozilla public licen", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla public licen", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v?1 0"),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "in jurisdictions that recognize", "in jurisdictions that recognize copyright laws the author"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "be misrepresented", "the origin of this software must not be misrepresented"),
    ("bsl-1.0", "machine executable object", "unless such copies or derivative works are solely in the form of machine executable object code"),
    ("wtfpl", "fuck you want", "do what the fuck you want to(?: public license)?"),
    ("cc0-1.0", "neighboring rights", "dedicate(?:d)? .{1,60}?(?:and )?waiv(?:e|ed|ing) all .{0,40}?copyright and related(?: or| and) neighboring rights"),
    ("artistic-2.0", "permitted to use the standard version", "you are permitted to use the standard version and create and use modified versions"),
    ("postgresql", "postgresql", "in no event shall the .{1,60}? be liable to any party .{1,200}? postgresql"),
    ("python-2.0", "python software foundation", "psf is making python available to licensee on an as is basis"),
    ("python-2.0", "python software foundation", "this license agreement is between the python software foundation"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("ofl-1.1", "reserved font name", "no modified version of the font software may use the reserved font name s?"),
    ("beerware", "stuff is worth it", "this stuff is worth it you can buy me a beer in return"),
    ("json", "good not evil", "the software shall be used for good not evil"),
    ("ms-pl", "microsoft public license", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("proprietary", "all rights reserved", "all rights reserved unauthorized (?:copying|use|reproduction)"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "confidential and proprietary", "confidential and proprietary"),
    ("proprietary", "may not be reproduced", "no part of this (?:work|document|publication|book) may be reproduced"),
    ("elastic-2.0", "hosted or managed service", "you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", "make the functionality", "if you make the functionality of the program .{1,60}? available to third parties as a service"),
    ("busl-1.1", "fourth anniversary", "effective on the change date or the fourth anniversary"),
    ("commons-clause", "commons clause", "does not grant to you the right to sell the software"),
    ("cc", "creative commons", "creative commons corporation is not a law firm and does not provide legal services"),
    ("llama", "llama", "meta grants? you a non exclusive worldwide non transferable"),
    ("openrail", "openrail", "use based restrictions .{1,80}? as an enforceable provision"),
]

# Notices: (label, keyword, pattern).
NOTICES = [
    ("mit", "mit licen", "(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e"),
    ("mit", "mit licensed", "mit licensed"),
    ("apache-2.0", "apache", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e(?: version)?(?: v)? ?2(?: 0)?"),
    ("bsd", "bsd", "(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd(?: style)? licen[cs]e"),
    ("bsd-style", "bsd-style", "governed by a bsd style license that can be found in the license file"),
    ("isc", "isc licen", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e"),
    ("mpl-2.0", "mozilla", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?"),
    ("public-domain", "the public domain", "(?:placed|released|dedicated|put)(?: in| into| to)? the public domain"),
    ("public-domain", "public domain", "this (?:work|file|code|text|document) is (?:in|hereby in) the public domain"),
    ("cc", "creative commons", "(?:licensed|released|distributed|available|published) under (?:a |the )?creative commons"),
    ("proprietary", "all rights reserved", "copyright .{0,60}?all rights reserved"),
    ("proprietary", "licensed material", "licensed materials property of"),
    ("dual", "dual licensed", "dual licensed under"),
    ("dual", "at your option either", "at your option either"),
    ("gpl", "gpl", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl"),
    ("lgpl", "lgpl", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl"),
    ("agpl", "agpl", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl"),
    ("zlib", "zlib", "(?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib licen[cs]e"),
    *[("free-use", f"free for {x} use", f"free for {x} use") for x in ("personal", "non commercial", "noncommercial", "educational", "academic")],
    ("non-commercial", "commercial use", "(?:not|no) for commercial use"),
    ("non-commercial", "commercial use only", "for non ?commercial use only"),
    ("non-commercial", "commercial purposes only", "non ?commercial purposes only"),
    ("no-derivatives", "no derivative works", "no derivative works (?:are )?(?:permitted|allowed)"),
]

# Addresses: (label, keyword, pattern as it stands).
ADDRESSES = [
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"), ("apache-1.1", "apache.org/licenses", r"apache\.org/licenses/license-1\.1"),
    ("mit", "opensource.org/licenses", r"opensource\.org/licenses?/mit(?![a-z0-9-])"), ("isc", "opensource.org/licenses", r"opensource\.org/licenses?/isc(?![a-z0-9-])"),
    ("bsd-2-clause", "opensource.org/licenses", r"opensource\.org/licenses?/bsd-2-clause"), ("bsd-3-clause", "opensource.org/licenses", r"opensource\.org/licenses?/bsd-3-clause"),
    ("artistic-2.0", "opensource.org/licenses", r"opensource\.org/licenses?/artistic-2\.0"), ("zlib", "opensource.org/licenses", r"opensource\.org/licenses?/zlib(?![a-z0-9-])"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/(?:licenses|copyleft)/gpl(?![-a-z0-9])"), ("gpl-2.0", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"), ("gpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/gpl-3\.0"),
    ("lgpl", "gnu.org/licenses", r"gnu\.org/(?:licenses|copyleft)/lgpl(?![-a-z0-9])"), ("lgpl-2.1", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"), ("lgpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/lgpl-3\.0"),
    ("agpl-3.0", "gnu.org/licenses", r"gnu\.org/licenses/agpl(?:-3\.0)?(?![-a-z0-9])"), ("gfdl", "gnu.org/licenses", r"gnu\.org/licenses/fdl"),
    ("mpl-2.0", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/2\.0"), ("mpl-1.1", "mozilla.org", r"mozilla\.org/(?:en-us/)?mpl/(?:mpl-)?1\.1"),
    ("epl-2.0", "eclipse.org", r"eclipse\.org/(?:legal/epl-2\.0|org/documents/epl-2\.0)"), ("epl-1.0", "eclipse.org", r"eclipse\.org/legal/epl-v10"), ("edl-1.0", "eclipse.org", r"eclipse\.org/org/documents/edl-v10"),
    ("unlicense", "unlicense.org", r"unlicense\.org(?![a-z0-9.-])"), ("wtfpl", "wtfpl.net", r"wtfpl\.net"), ("bsl-1.0", "boost.org", r"boost\.org/license_1_0"), ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("public-domain", "creativecommons.org", r"creativecommons\.org/publicdomain/mark/1\.0"), ("ofl-1.1", "scripts.sil.org", r"scripts\.sil\.org/ofl"), ("eupl", "joinup", r"joinup\.ec\.europa\.eu/[a-z0-9/_.-]*eupl"),
    ("odbl-1.0", "opendatacommons.org", r"opendatacommons\.org/licenses/odbl"), ("odc-by-1.0", "opendatacommons.org", r"opendatacommons\.org/licenses/by"), ("pddl-1.0", "opendatacommons.org", r"opendatacommons\.org/licenses/pddl"),
    ("ogl-3.0", "nationalarchives.gov.uk", r"nationalarchives\.gov\.uk/doc/open-government-licence/version/3"), ("elastic-2.0", "elastic.co", r"elastic\.co/licensing/elastic-license"), ("sspl-1.0", "mongodb.com", r"mongodb\.com/licensing/server-side-public-license"),
    ("busl-1.1", "mariadb.com", r"mariadb\.com/bsl"), ("psf", "python.org", r"python\.org/(?:psf/license|[a-z0-9/.]*license\.html)"), ("postgresql", "postgresql.org", r"postgresql\.org/about/licen[cs]e"),
]

# Names, a version where the label has one: (label, tier, keyword, pattern).
NAMES = [
    ("apache-2.0", 2, "apache", "apache(?: software)? licen[cs]e(?: version)?(?: v)? ?2(?: 0)?"), ("apache-1.1", 2, "apache", "apache(?: software)? licen[cs]e(?: version)?(?: v)? ?1 1"), ("apache-2.0", 2, "apache", "apache 2(?: 0)?(?: licen[cs]ed?)?"),
    ("bsd-2-clause", 2, "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd) licen[cs]e"), ("bsd-3-clause", 2, "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd) licen[cs]e"),
    ("bsd-4-clause", 2, "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd) licen[cs]e"), ("bsd", 3, "bsd", "bsd(?: style)? licen[cs]e"), ("isc", 3, "isc licen", "isc licen[cs]e"), ("zlib", 3, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("mit-0", 2, "mit no attribution", "mit no attribution(?: licen[cs]e)?"), ("mit", 3, "mit licen", "mit licen[cs]e"), ("mit", 3, "expat licen", "expat licen[cs]e"), ("mit", 3, "x11 licen", "x11 licen[cs]e"), ("gpl", 3, "gpl", "(?:gnu )?gpl(?:ed|s)?"), ("lgpl", 3, "lgpl", "(?:gnu )?lgpl"), ("agpl", 3, "agpl", "(?:gnu )?agpl"),
    ("gpl", 3, "general public licen", "(?:gnu )?general public licen[cs]e"), ("lgpl", 3, "lesser general public licen", "(?:gnu )?lesser general public licen[cs]e"), ("lgpl", 3, "library general public licen", "(?:gnu )?library general public licen[cs]e"),
    ("agpl", 3, "affero", "(?:gnu )?affero general public licen[cs]e"), ("gfdl", 3, "free documentation licen", "(?:gnu )?free documentation licen[cs]e"), ("gfdl", 3, "gfdl", "gfdl"),
    ("mpl-2.0", 2, "mozilla public licen", "mozilla public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?"), ("mpl-1.1", 2, "mozilla public licen", "mozilla public licen[cs]e(?: version)?(?: v)? ?1 1"), ("mpl", 3, "mozilla public licen", "mozilla public licen[cs]e"),
    ("mpl-2.0", 2, "mpl 2", "mpl 2(?: 0)?"), ("mpl-2.0", 2, "mpl v", "mpl v ?2(?: 0)?"), ("epl-2.0", 2, "eclipse public licen", "eclipse public licen[cs]e(?: version)?(?: v)? ?2(?: 0)?"), ("epl-1.0", 2, "eclipse public licen", "eclipse public licen[cs]e(?: version)?(?: v)? ?1(?: 0)?"), ("epl", 3, "eclipse public licen", "eclipse public licen[cs]e"),
    ("edl-1.0", 2, "eclipse distribution licen", "eclipse distribution licen[cs]e"), ("cddl-1.1", 2, "common development and distribution", "common development and distribution licen[cs]e(?: version)?(?: v)? ?1 1"), ("cddl-1.0", 2, "common development and distribution", "common development and distribution licen[cs]e"),
    ("cddl", 3, "cddl", "cddl"), ("cpl-1.0", 2, "common public licen", "common public licen[cs]e"), ("ipl-1.0", 2, "ibm public licen", "ibm public licen[cs]e"), ("apsl-2.0", 2, "apple public source", "apple public source licen[cs]e"), ("artistic-2.0", 2, "artistic licen", "artistic licen[cs]e 2(?: 0)?"),
    ("artistic", 3, "artistic licen", "artistic licen[cs]e"), ("bsl-1.0", 2, "boost software licen", "boost software licen[cs]e"), ("unlicense", 2, "unlicense", "the unlicense"), ("wtfpl", 2, "wtfpl", "wtfpl"), ("cc0-1.0", 2, "cc0", "cc0(?: 1 0)?"),
    ("public-domain", 3, "public domain", "public domain"), ("ms-pl", 2, "microsoft public licen", "microsoft public licen[cs]e"), ("ms-rl", 2, "microsoft reciprocal licen", "microsoft reciprocal licen[cs]e"), ("ofl-1.1", 2, "open font licen", "(?:sil )?open font licen[cs]e"),
    ("eupl-1.2", 2, "european union public licen", "european union public licen[cs]e(?: version)?(?: v)? ?1 2"), ("eupl", 3, "european union public licen", "european union public licen[cs]e"), ("cecill", 3, "cecill", "cecill(?: [bc])?"), ("osl-3.0", 2, "open software licen", "open software licen[cs]e"),
    ("afl-3.0", 2, "academic free licen", "academic free licen[cs]e"), ("upl-1.0", 2, "universal permissive licen", "universal permissive licen[cs]e"), ("ncsa", 2, "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e"), ("psf", 2, "python software foundation licen", "python software foundation licen[cs]e"),
    ("postgresql", 2, "postgresql licen", "postgresql licen[cs]e"), ("php-3.01", 2, "php licen", "php licen[cs]e"), ("ruby", 2, "ruby licen", "ruby licen[cs]e"), ("openssl", 2, "openssl licen", "openssl licen[cs]e"), ("zpl-2.1", 2, "zope public licen", "zope public licen[cs]e"),
    ("w3c", 2, "w3c software", "w3c software (?:notice and )?licen[cs]e"), ("qpl-1.0", 2, "q public licen", "q public licen[cs]e"), ("vim", 2, "vim licen", "vim licen[cs]e"), ("curl", 2, "curl licen", "curl licen[cs]e"), ("beerware", 2, "beerware licen", "beerware licen[cs]e"), ("beerware", 2, "beer ware licen", "beer ware licen[cs]e"), ("json", 2, "json licen", "json licen[cs]e"),
    ("odbl-1.0", 2, "open database licen", "open database licen[cs]e"), ("odc-by-1.0", 2, "open data commons attribution", "open data commons attribution licen[cs]e"), ("ogl-3.0", 2, "open government licen", "open government licen[cs]e"), ("cdla", 3, "community data licen", "community data licen[cs]e agreement"),
    ("elastic-2.0", 2, "elastic licen", "elastic licen[cs]e(?: 2 0| v2)?"), ("sspl-1.0", 2, "server side public licen", "server side public licen[cs]e"), ("busl-1.1", 2, "business source licen", "business source licen[cs]e"), ("polyform", 3, "polyform", "polyform (?:noncommercial|small business|shield|perimeter|strict)"),
    ("commons-clause", 2, "commons clause", "commons clause"), ("openrail", 3, "openrail", "(?:creativeml )?openrail(?: [ms])?"), ("llama", 3, "llama", "llama [0-9 ]{1,3} community licen[cs]e"), ("gemma", 3, "gemma", "gemma terms of use"), ("proprietary", 3, "all rights reserved", "all rights reserved"),
    ("gust-font", 2, "gust font licen", "gust font licen[cs]e"), ("lppl-1.3c", 2, "latex project public licen", "latex project public licen[cs]e"), ("mulanpsl-2.0", 2, "mulan", "mulan permissive software licen[cs]e"), ("nasa-1.3", 2, "nasa open source", "nasa open source agreement"), ("rpl-1.5", 2, "reciprocal public licen", "reciprocal public licen[cs]e"),
    ("sleepycat", 2, "sleepycat", "sleepycat licen[cs]e"), ("xfree86", 2, "xfree86", "xfree86 licen[cs]e"), ("intel", 2, "intel open source licen", "intel open source licen[cs]e"), ("lpl-1.02", 2, "lucent public licen", "lucent public licen[cs]e"), ("nposl-3.0", 2, "non-profit open software", "non profit open software licen[cs]e"),
    ("parity-7.0", 2, "parity public licen", "parity public licen[cs]e"), ("blueoak-1.0", 2, "blue oak", "blue oak model licen[cs]e"), ("cal-1.0", 2, "cryptographic autonomy", "cryptographic autonomy licen[cs]e"), ("ecl-2.0", 2, "educational community licen", "educational community licen[cs]e"), ("fair", 2, "fair licen", "fair licen[cs]e"),
]
# Families whose rules differ by a number only: (label, long name, its keyword, versions).
VERSIONS = [
    ("gpl", "(?:gnu )?general public licen[cs]e", "general public licen", ["1.0", "2.0", "3.0"]),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "general public licen", ["2.0", "2.1", "3.0"]),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "affero general public licen", ["1.0", "3.0"]),
]
CC = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_WORDS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative|s|atives)", "nc": "non ?commercial"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]


def number(version: str) -> str:
    """A version as it is written; a zero at the end may be missing."""
    major, minor = version.split(".")
    return major + (f"(?: {minor})?" if minor == "0" else f" {minor}")


def rules() -> list[Rule]:
    """All rules in order: what comes first wins among equal intervals of a tier."""
    out = [Rule(label, 0, 0.99, k, phrase(p)) for label, k, p in PASSAGES]
    out.append(Rule("spdx", 0, 0.99, "spdx-license-identifier", r"spdx-license-identifier:[ \t]*[a-z0-9.+-]+(?:[ \t]+(?:or|and|with)[ \t]+[a-z0-9.+-]+)*"))
    out += [Rule(label, 1, 0.95, k, phrase(p)) for label, k, p in NOTICES]
    out += [Rule(label, 1, 0.9, k, address(p)) for label, k, p in ADDRESSES]
    for label, name, k, versions in VERSIONS:
        for v in versions:
            long, short = f"{name}(?: version| v)? ?{number(v)}", f"{label}(?: version| v)? ?{number(v)}"
            later = "(?: of the licen[cs]e)?(?: or)? (?:at your option )?(?:any )?later(?: version)?"
            out.append(Rule(f"{label}-{v}-or-later", 1, 0.95, k, phrase(f"{name} .{{0,80}}?(?:version|v) ?{number(v)}{later}")))
            out.append(Rule(f"{label}-{v}-or-later", 1, 0.95, label, phrase(short + later)))
            out.append(Rule(f"{label}-{v}", 2, 0.9, k, phrase(long)))
            out.append(Rule(f"{label}-{v}", 2, 0.9, label, phrase(short)))
    for kind in CC:
        words = " ".join(CC_WORDS[x] for x in kind.split("-"))
        short, long, k = f"cc {kind.replace('-', ' ')}", f"creative commons {words}", f"cc {kind.replace('-', ' ')}"
        for v in CC_VERSIONS:
            out.append(Rule(f"cc-{kind}-{v}", 2, 0.9, k, phrase(f"{short} {number(v)}")))
            out.append(Rule(f"cc-{kind}-{v}", 1, 0.9, "creativecommons.org", address(rf"creativecommons\.org/licenses/{kind}/{v.replace('.', chr(92) + '.')}")))
            out.append(Rule(f"cc-{kind}-{v}", 2, 0.9, "creative commons", phrase(f"{long}(?: international| unported| generic| licen[cs]e)*? ?{number(v)}")))
        out.append(Rule(f"cc-{kind}", 3, 0.7, "creative commons", phrase(long)))
        out.append(Rule(f"cc-{kind}", 3, 0.7, k, phrase(short)))
    out += [Rule(label, tier, 0.85 if tier == 2 else 0.6, k, phrase(p)) for label, tier, k, p in NAMES]
    out.append(Rule("cc", 3, 0.5, "creative commons", phrase("creative commons")))
    return out


def base_rules() -> list[Rule]:
    """The base phrases as rules of the last tier."""
    return [Rule(label, 3, 0.7, p, phrase(p).replace("{1,20}", "++")) for p, label in BASE.items()]


DETECTION = "struct<start: bigint, back: bigint, tier: int, ord: int, label: string, weight: double>"


def detect(docs: DataFrame, text: str = "text", catalogue: list[Rule] | None = None) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score and detections (start, end, label, weight): those that stay, in order."""
    catalogue = [*base_rules(), *(rules() if catalogue is None else catalogue)]
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in added])
    df = docs.select(carried.alias("_row"), common.whole(F.col(text)).alias("_text"))
    # Two gates. First a whole word of the keyword, in lower case by the rules of Unicode, which neither adds nor splits words; then the keyword itself.
    stems = sorted({w for r in catalogue for w in r.stems})
    df = df.withColumn("_words", F.split(F.lower("_text"), GAP + "++", -1))
    ends = lambda k: F.when(F.element_at("_words", k) == "", 1).otherwise(0)
    df = df.select("_row", "_text", F.greatest(F.lit(0), F.size("_words") - ends(1) - ends(-1)).cast("long").alias("n_words"), F.array_intersect("_words", F.lit(stems)).alias("_stems"))
    df = df.withColumn("_low", F.when(F.size("_stems") > 0, F.translate("_text", UPPER, LOWER))).drop("_text")
    t = F.col("_low")
    column = lambda name, values: F.lit(values).alias(name)
    every = F.arrays_zip(
        column("ord", list(range(len(catalogue)))), column("label", [r.label for r in catalogue]), column("tier", [r.tier for r in catalogue]), column("weight", [r.weight for r in catalogue]),
        column("stems", [list(r.stems) for r in catalogue]), column("keyword", [r.gate for r in catalogue]), column("pattern", [r.pattern for r in catalogue]),
    )
    gated = lambda plain: F.filter(every, lambda r: F.arrays_overlap(F.col("_stems"), r["stems"]) & F.contains(plain, r["keyword"]))
    df = df.withColumn("_rules", F.when(t.isNotNull(), common.let(F.regexp_replace(t, GAP + "++", " "), gated))).drop("_stems")

    def places(r: Column) -> Column:
        """The detections of one rule: matches, and their places from the lengths of what lies between."""

        def with_gaps(m: Column) -> Column:
            gaps = F.slice(F.split(t, r["pattern"], -1), F.lit(1), F.size(m))
            ends = spans.running(F.zip_with(m, gaps, lambda x, y: (F.length(x) + F.length(y)).cast("bigint")), lambda a, x: a + x, F.lit(0).cast("bigint"))
            return F.transform(F.arrays_zip(m.alias("m"), ends.alias("e")), lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), (-x["e"]).alias("back"), r["tier"].alias("tier"), r["ord"].alias("ord"), r["label"].alias("label"), r["weight"].alias("weight")))

        return common.let(F.regexp_extract_all(t, r["pattern"], F.lit(0)), lambda m: F.when(F.size(m) > 0, with_gaps(m)).otherwise(F.array().cast(f"array<{DETECTION}>")))

    df = df.withColumn("_all", F.when(F.size("_rules") > 0, F.array_sort(F.flatten(F.transform("_rules", places)))).otherwise(F.array().cast(f"array<{DETECTION}>"))).drop("_rules")
    n = len(BASE)
    df = df.withColumn("_base", F.filter("_all", lambda d: d["ord"] < n))
    df = df.withColumn("_kept", outermost(F.col("_all")))
    # words before the first and after the last base phrase
    head, tail = F.substr(t, F.lit(1), F.element_at("_base", 1)["start"].cast("int")), F.substr(t, (1 - F.element_at("_base", -1)["back"]).cast("int"))
    sizes = F.element_at(F.lit([len(p.split()) for p in BASE]), F.element_at("_base", -1)["ord"] + 1)
    count = lambda c: F.regexp_count(c, F.lit(WORD + "++")).cast("long")
    names = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"])))
    weights = F.transform(names("_kept"), lambda x: F.array_max(F.transform(F.filter("_kept", lambda d: d["label"] == x), lambda d: d["weight"])))
    return df.select(
        F.col("_row.*"), F.col("n_words"), F.size("_base").cast("long").alias("n_base"), F.when(F.size("_base") > 0, count(head)).alias("first_word"),
        F.when(F.size("_base") > 0, F.col("n_words") - count(tail) - sizes).alias("last_word"), F.array_join(names("_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names("_base"), names("_kept"))), ",").alias("labels"), F.round(1 - F.aggregate(weights, F.lit(1.0), lambda a, w: a * (1 - w)), 6).alias("score"),
        F.transform("_kept", lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("end"), d["label"].alias("label"), d["weight"].alias("weight"))).alias("detections"),
    ).drop("_")


def outermost(found: Column) -> Column:
    """Of detections in order of (start, -end, tier, rule), those that no earlier one of their tier or a better one reaches round."""

    def keep(all_: Column) -> Column:
        zero = F.lit(-1).cast("bigint")
        upto = lambda k: F.transform(all_, lambda d: F.when(d["tier"] <= k, -d["back"]).otherwise(zero))
        reach = [spans.running(upto(k), spans.MOST, zero) for k in range(TIERS)]
        zipped = F.arrays_zip(all_.alias("d"), *[r.alias(f"r{k}") for k, r in enumerate(reach)])

        def stays(x: Column, i: Column, z: Column) -> Column:
            best = F.lit(None)
            for k in range(TIERS):
                best = F.when(x["d"]["tier"] == k, F.get(z, i - 1)[f"r{k}"]).otherwise(best)
            return (i == 0) | (best < -x["d"]["back"])

        return common.let(zipped, lambda z: F.transform(F.filter(z, lambda x, i: stays(x, i, z)), lambda x: x["d"]))

    return F.when(F.size(found) > 1, common.let(found, keep)).otherwise(found)


def report(docs: DataFrame) -> DataFrame:
    df = detect(docs.select("doc_id", "text"))
    return df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
