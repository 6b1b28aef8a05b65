"""License signatures: an ordered table of hand-written rules.

A rule is written as words.  Each word stands for one word of the text (words are
compared in lower case, punctuation between them does not matter) and is itself a regular
expression; ``word?`` may be missing, ``a|b`` are alternatives, ``...`` stands for at most four
words.  Rules are tried in the order of the table; earlier families and longer
forms have priority.  The keyword is a word without which the rule cannot
match; it gates the regular expression.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    priority: int  # lower wins
    keyword: str
    words: str
    weight: float  # how sure a match is


# Families: label, keyword, then the forms of the name.  Fixed values.
FAMILIES: list[tuple[str, str, list[str]]] = [
    ("agpl-3.0", "affero", ["gnu? affero general public license version? 3 0?", "affero gpl version? 3 0?", "gnu affero general public license"]),
    ("lgpl-3.0", "lesser", ["gnu? lesser general public license version? 3 0?"]),
    ("lgpl-2.1", "lesser", ["gnu? lesser general public license version? 2 1", "gnu? lesser general public license"]),
    ("lgpl-2.0", "library", ["gnu? library general public license version? 2 0?", "gnu? library general public license"]),
    ("gpl-3.0", "general", ["gnu? general public license version? 3 0?", "gnu? general public license v3"]),
    ("gpl-2.0", "general", ["gnu? general public license version? 2 0?", "gnu? general public license v2"]),
    ("gpl-1.0", "general", ["gnu? general public license version? 1 0?"]),
    ("gfdl-1.3", "documentation", ["gnu? free documentation license version? 1 3", "gnu? free documentation license"]),
    ("gfdl-1.2", "documentation", ["gnu? free documentation license version? 1 2"]),
    ("apache-2.0", "apache", ["apache software? license version? 2 0?", "apache software? license v2"]),
    ("apache-1.1", "apache", ["apache software? license version? 1 1"]),
    ("apache-1.0", "apache", ["apache software? license version? 1 0"]),
    ("mit-0", "attribution", ["mit no attribution license?"]),
    ("mit", "mit", ["mit x11 license", "mit expat license", "the mit license"]),
    ("x11", "x11", ["x11 license"]),
    ("expat", "expat", ["expat license"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause license?", "original bsd license", "four clause bsd license?"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause license?", "new bsd license", "revised bsd license", "modified bsd license", "three clause bsd license?"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause license?", "simplified bsd license", "bsd license", "two clause bsd license?"]),
    ("bsd-2-clause", "freebsd", ["freebsd license"]),
    ("0bsd", "bsd", ["zero clause bsd license?", "0 clause bsd license?"]),
    ("isc", "isc", ["isc license"]),
    ("isc", "consortium", ["internet systems consortium license"]),
    ("zlib", "zlib", ["zlib libpng license", "zlib license"]),
    ("libpng", "libpng", ["libpng license"]),
    ("mpl-2.0", "mozilla", ["mozilla public license version? 2 0?", "mozilla public license v2"]),
    ("mpl-1.1", "mozilla", ["mozilla public license version? 1 1"]),
    ("mpl-1.0", "mozilla", ["mozilla public license version? 1 0"]),
    ("epl-2.0", "eclipse", ["eclipse public license version? v? 2 0?"]),
    ("epl-1.0", "eclipse", ["eclipse public license version? v? 1 0", "eclipse public license"]),
    ("edl-1.0", "eclipse", ["eclipse distribution license version? v? 1 0"]),
    ("cpl-1.0", "common", ["common public license version? 1 0?"]),
    ("cddl-1.1", "distribution", ["common development and distribution license version? 1 1"]),
    ("cddl-1.0", "distribution", ["common development and distribution license version? 1 0", "common development and distribution license"]),
    ("eupl-1.2", "union", ["european union public licen[cs]e version? v? 1 2", "european union public licen[cs]e"]),
    ("eupl-1.1", "union", ["european union public licen[cs]e version? v? 1 1"]),
    ("cecill-2.1", "cecill", ["cecill free? software? license agreement? version? 2 1", "cecill license"]),
    ("cecill-b", "cecill", ["cecill b license?"]),
    ("cecill-c", "cecill", ["cecill c license?"]),
    ("artistic-2.0", "artistic", ["artistic license version? 2 0"]),
    ("artistic-1.0", "artistic", ["artistic license version? 1 0", "perl artistic license"]),
    ("bsl-1.0", "boost", ["boost software license version? 1 0", "boost software license"]),
    ("busl-1.1", "business", ["business source license version? 1 1", "business source license"]),
    ("sspl-1.0", "server", ["server side public license version? v? 1?"]),
    ("elastic-2.0", "elastic", ["elastic license version? v? 2 0?", "elastic license"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense license"]),
    ("wtfpl", "want", ["do what the fuck you want to public license version? 2?"]),
    ("cc0-1.0", "cc0", ["cc0 1 0 universal", "cc0 1 0", "cc0 public domain dedication", "cc0"]),
    ("cc0-1.0", "zero", ["creative commons zero v?1? 0?"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd [1-4]? [05]?"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa [1-4]? [05]?"]),
    ("cc-by-nc", "cc", ["cc by nc [1-4]? [05]?"]),
    ("cc-by-nd", "cc", ["cc by nd [1-4]? [05]?"]),
    ("cc-by-sa", "cc", ["cc by sa [1-4]? [05]?"]),
    ("cc-by-4.0", "cc", ["cc by 4 0"]),
    ("cc-by-3.0", "cc", ["cc by 3 0"]),
    ("cc-by-2.5", "cc", ["cc by 2 5"]),
    ("cc-by-2.0", "cc", ["cc by 2 0"]),
    ("cc-by-nc-nd", "noncommercial", ["creative commons attribution noncommercial noderiv\\w* [1-4]? [05]? international|unported? license?"]),
    ("cc-by-nc-sa", "noncommercial", ["creative commons attribution noncommercial sharealike [1-4]? [05]? international|unported? license?"]),
    ("cc-by-nc", "noncommercial", ["creative commons attribution noncommercial [1-4]? [05]? international|unported? license?"]),
    ("cc-by-nd", "attribution", ["creative commons attribution noderiv\\w* [1-4]? [05]? international|unported? license?"]),
    ("cc-by-sa", "sharealike", ["creative commons attribution sharealike [1-4]? [05]? international|unported? license?"]),
    ("cc-by", "attribution", ["creative commons attribution [1-4]? [05]? international|unported? license?"]),
    ("odbl", "database", ["open data commons open database license", "open database license"]),
    ("odc-by", "attribution", ["open data commons attribution license"]),
    ("pddl", "dedication", ["public domain dedication and license"]),
    ("ogl-uk-3.0", "government", ["open government licen[cs]e version? v? 3 0?", "open government licen[cs]e"]),
    ("python-2.0", "python", ["python software foundation license version? 2?"]),
    ("python-2.0", "psf", ["psf license agreement?"]),
    ("php-3.01", "php", ["php license version? 3 01", "php license"]),
    ("ruby", "ruby", ["ruby license", "terms of ruby"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e"]),
    ("openssl", "openssl", ["openssl license", "openssl ssleay license"]),
    ("ofl-1.1", "sil", ["sil open font license version? 1 1", "sil open font license"]),
    ("ms-pl", "microsoft", ["microsoft public license", "microsoft permissive license"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal license"]),
    ("apsl-2.0", "apple", ["apple public source license version? 2 0?"]),
    ("afl-3.0", "academic", ["academic free license version? v? 3 0", "academic free license"]),
    ("osl-3.0", "software", ["open software license version? v? 3 0", "open software license"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source license", "ncsa open source license"]),
    ("upl-1.0", "permissive", ["universal permissive license version? v? 1? 0?"]),
    ("vim", "vim", ["vim license"]),
    ("w3c", "w3c", ["w3c software notice and license", "w3c software license"]),
    ("unicode", "unicode", ["unicode license agreement", "unicode inc license agreement"]),
    ("icu", "icu", ["icu license"]),
    ("curl", "curl", ["curl license"]),
    ("json", "evil", ["software shall be used for good not evil"]),
    ("beerware", "beer", ["beer ware license", "the beerware? beer license"]),
    ("polyform", "polyform", ["polyform noncommercial license", "polyform small business license", "polyform shield license"]),
    ("llama", "llama", ["llama 2|3 community license agreement?", "llama community license"]),
    ("openrail", "openrail", ["creativeml openrail m?", "bigscience openrail m?", "openrail m license"]),
    ("public-domain", "domain", ["dedicated to the public domain", "released into the public domain", "in the public domain"]),
    ("proprietary", "reserved", ["all rights reserved"]),
]

# Short identifiers as they stand after a tag or a verb of licensing; label, keyword, form.  Fixed values.
SHORT: list[tuple[str, str, str]] = [
    ("gpl-3.0", "gplv3", "gplv3"), ("gpl-2.0", "gplv2", "gplv2"), ("gpl-3.0", "gpl", "gpl v?3 0? only|or?"), ("gpl-2.0", "gpl", "gpl v?2 0? only|or?"),
    ("lgpl-3.0", "lgplv3", "lgplv3"), ("lgpl-2.1", "lgpl", "lgpl 2 1"), ("lgpl-3.0", "lgpl", "lgpl v?3 0?"), ("agpl-3.0", "agplv3", "agplv3"),
    ("agpl-3.0", "agpl", "agpl v?3 0?"), ("mpl-2.0", "mpl", "mpl 2 0"), ("epl-2.0", "epl", "epl 2 0"), ("apache-2.0", "apache", "apache 2 0"),
    ("bsd-3-clause", "bsd", "bsd 3 clause"), ("bsd-2-clause", "bsd", "bsd 2 clause"), ("0bsd", "0bsd", "0bsd"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"),
    ("mit", "mit", "mit"), ("unlicense", "unlicense", "unlicense"), ("bsl-1.0", "bsl", "bsl 1 0"), ("cc0-1.0", "cc0", "cc0 1 0"),
    ("ofl-1.1", "ofl", "ofl 1 1"), ("artistic-2.0", "artistic", "artistic 2 0"), ("wtfpl", "wtfpl", "wtfpl"), ("ms-pl", "pl", "ms pl"),
    ("odbl", "odbl", "odbl 1? 0?"), ("eupl-1.2", "eupl", "eupl 1 2"), ("python-2.0", "psf", "psf 2 0"),
]

# Phrases of license texts themselves; label, keyword, words.  Fixed values.
TEXTS: list[tuple[str, str, str]] = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy ... software"),
    ("mit", "warranty", "the software is provided as is without warranty of any kind express or implied"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("isc", "purpose", "permission to use copy modify and or? distribute this software for any purpose with or without fee"),
    ("apache-2.0", "limitations", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "fitness", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "later", "either version 2|3 of the license or at your option any later version"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("cc-by-sa", "share", "share alike if you remix transform or build upon the material"),
    ("cc-by", "credit", "you must give appropriate credit provide a link to the license"),
]

VERBS = "licensed|released|distributed|available|published|covered"


def _rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label: str, keyword: str, words: str, weight: float) -> None:
        out.append(Rule(len(out), label, len(out), keyword, words, weight))

    for label, keyword, words in TEXTS:
        add(label, keyword, words, 0.95)
    for label, keyword, forms in FAMILIES:
        for form in forms:
            # A notice, then the bare name.
            add(label, keyword, f"{VERBS} under the|a|an? terms? of? the? {form}", 1.0)
            add(label, keyword, form, 0.8)
    for label, keyword, form in SHORT:
        add(label, keyword, f"spdx license identifier {form}", 1.0)
        add(label, keyword, f"{VERBS} under the|a|an? {form} license?", 0.9)
        add(label, keyword, f"license {form}", 0.7)
    return out


RULES = _rules()

# The base phrases, found as consecutive words.  Fixed values.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


def pattern(words: str) -> str:
    """Regular expression over text in which every word stands between two spaces of its own."""
    out = []
    for word in words.split(" "):
        optional = word.endswith("?") and word != "?"
        body = word[:-1] if optional else word
        if word == "...":
            out.append("(?: [^ ]+ ){0,4}?")
        elif "|" in body:
            out.append(f"(?: (?:{body}) )" + "?" * optional)
        else:
            out.append(f"(?: {body} )?" if optional else f" {body} ")
    return "".join(out)
