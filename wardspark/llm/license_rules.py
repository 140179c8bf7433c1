"""Signature rules of the license scan.

A rule is a regular expression over lower-case words joined by single spaces. It is anchored at its first word and gated
by a keyword that the document must contain. ``rank`` settles overlaps: the higher one wins.
"""

from dataclasses import dataclass

IDENTIFIER, GRANT, NOTICE, NAME, HINT = 5, 4, 3, 2, 1

#: Words that open a statement of the kind "released under the ... license".
GRANT_WORDS = ("licensed", "licenced", "released", "distributed", "available", "provided", "published", "offered", "dual", "covered", "governed")
GRANT_TAIL = r"(?:licensed )?(?:under|by|with)(?: the)?(?: terms of)?(?: the)?(?: following)?"


@dataclass(frozen=True)
class Rule:
    label: str
    starts: tuple[str, ...]  # the words it can begin with
    pattern: str  # the whole expression, first word included
    keyword: str  # what the document must contain, and every match does
    rank: int


#: label | short identifier in words | first word and the rest of the full name | keyword
NAMES = [
    ("mit", "mit", "mit license", "licen"),
    ("mit-0", "mit 0", "mit no attribution(?: license)?", "attribution"),
    ("x11", "x11", "x11 license", "licen"),
    ("isc", "isc", "isc license", "licen"),
    ("apache-1.1", "apache 1 1", "apache (?:software )?license (?:version |v )?1 1", "licen"),
    ("apache-2.0", "apache 2 0", "apache (?:software )?license(?: version| v)? ?2(?: 0)?", "licen"),
    ("apache-2.0", "apache2", "apache (?:2|v2|2 0) license", "licen"),
    ("apache", "apache", "apache(?: software)? license", "licen"),
    ("bsd-0-clause", "0bsd", "zero clause bsd(?: license)?", "bsd"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause(?: simplified)?(?: license)?", "bsd"),
    ("bsd-2-clause", "bsd 2 clause freebsd", "simplified bsd license", "licen"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause(?: new| revised)?(?: license)?", "bsd"),
    ("bsd-3-clause", "bsd 3 clause new", "(?:new|revised|modified) bsd license", "licen"),
    ("bsd-4-clause", "bsd 4 clause", "bsd 4 clause(?: original)?(?: license)?", "bsd"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "licen"),
    ("agpl-3.0", "agpl 3 0", "gnu affero general public license(?: version| v)? ?3(?: 0)?", "licen"),
    ("agpl", "agpl", "(?:gnu )?affero general public license", "licen"),
    ("lgpl-2.0", "lgpl 2 0", "gnu library general public license(?: version| v)? ?2(?: 0)?", "licen"),
    ("lgpl-2.1", "lgpl 2 1", "gnu lesser general public license(?: version| v)? ?2 1", "licen"),
    ("lgpl-3.0", "lgpl 3 0", "gnu lesser general public license(?: version| v)? ?3(?: 0)?", "licen"),
    ("lgpl", "lgpl", "(?:gnu )?(?:lesser|library) general public license", "licen"),
    ("gpl-1.0", "gpl 1 0", "gnu general public license(?: version| v)? ?1(?: 0)?", "licen"),
    ("gpl-2.0", "gpl 2 0", "gnu general public license(?: version| v)? ?2(?: 0)?", "licen"),
    ("gpl-3.0", "gpl 3 0", "gnu general public license(?: version| v)? ?3(?: 0)?", "licen"),
    ("gpl-2.0", "gplv2", "(?:gpl2|gpl 2|gplv2|gpl v2|gpl v 2|gpl version 2)(?: 0)?", "gpl"),
    ("gpl-3.0", "gplv3", "(?:gpl3|gpl 3|gplv3|gpl v3|gpl v 3|gpl version 3)(?: 0)?", "gpl"),
    ("gpl", "gpl", "gnu general public license", "licen"),
    ("gfdl", "gfdl", "gnu free documentation license", "licen"),
    ("gfdl-1.3", "gfdl 1 3", "gnu free documentation license(?: version| v)? ?1 3", "licen"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license(?: version| v)? ?1 1", "licen"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license(?: version| v)? ?2(?: 0)?", "licen"),
    ("mpl", "mpl", "mozilla public license", "licen"),
    ("epl-1.0", "epl 1 0", "eclipse public license(?: version| v)? ?1(?: 0)?", "licen"),
    ("epl-2.0", "epl 2 0", "eclipse public license(?: version| v)? ?2(?: 0)?", "licen"),
    ("epl", "epl", "eclipse public license", "licen"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license(?: version)?(?: 1 0)?", "licen"),
    ("cpl-1.0", "cpl 1 0", "common public license(?: version)?(?: 1 0)?", "licen"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e(?: version| v)?(?: 1 2)?", "licen"),
    ("cecill-2.1", "cecill 2 1", "cecill(?: free software)? license(?: agreement)?", "licen"),
    ("cc0-1.0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", "cc0"),
    ("cc0-1.0", "cc zero", "creative commons (?:zero|cc0)", "creative commons"),
    ("cc-by-1.0", "cc by 1 0", "creative commons attribution 1 0(?: generic)?(?: license)?", "creative commons"),
    ("cc-by-2.0", "cc by 2 0", "creative commons attribution 2 0(?: generic)?(?: license)?", "creative commons"),
    ("cc-by-3.0", "cc by 3 0", "creative commons attribution 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-4.0", "cc by 4 0", "creative commons attribution 4 0(?: international)?(?: public)?(?: license)?", "creative commons"),
    ("cc-by-sa-3.0", "cc by sa 3 0", "creative commons attribution share ?alike 3 0(?: unported)?(?: license)?", "creative commons"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "creative commons attribution share ?alike 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nc-4.0", "cc by nc 4 0", "creative commons attribution non ?commercial 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nd-4.0", "cc by nd 4 0", "creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: license)?", "creative commons"),
    ("cc-by-sa", "cc by sa", "creative commons attribution share ?alike(?: license)?", "creative commons"),
    ("cc-by-nc", "cc by nc", "creative commons attribution non ?commercial(?: license)?", "creative commons"),
    ("cc-by-nd", "cc by nd", "creative commons attribution no ?deriv(?:ative)?s(?: license)?", "creative commons"),
    ("cc-by", "cc by", "creative commons attribution(?: license)?", "creative commons"),
    ("unlicense", "unlicense", "unlicense", "licen"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license", "licen"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "licen"),
    ("libpng", "libpng", "libpng license", "licen"),
    ("bsl-1.0", "bsl 1 0", "boost software license(?: version)?(?: 1 0)?", "licen"),
    ("artistic-1.0", "artistic 1 0", "artistic license(?: version)? 1(?: 0)?", "licen"),
    ("artistic-2.0", "artistic 2 0", "artistic license(?: version)? 2(?: 0)?", "licen"),
    ("artistic", "artistic", "artistic license", "licen"),
    ("perl", "perl 5", "same terms as perl(?: itself)?", "perl"),
    ("psf-2.0", "psf 2 0", "python software foundation license(?: version)?(?: 2)?", "licen"),
    ("php-3.01", "php 3 01", "php license(?: version)?(?: 3 0 ?1)?", "licen"),
    ("ruby", "ruby", "ruby license", "licen"),
    ("openssl", "openssl", "openssl license", "licen"),
    ("ofl-1.1", "ofl 1 1", "sil open font license(?: version)?(?: 1 1)?", "licen"),
    ("ofl-1.1", "ofl", "open font license", "licen"),
    ("ms-pl", "ms pl", "microsoft public license", "licen"),
    ("ms-rl", "ms rl", "microsoft reciprocal license", "licen"),
    ("afl-3.0", "afl 3 0", "academic free license(?: version| v)?(?: 3 0)?", "licen"),
    ("osl-3.0", "osl 3 0", "open software license(?: version| v)?(?: 3 0)?", "licen"),
    ("ncsa", "ncsa", "university of illinois(?: ncsa)? open source license", "licen"),
    ("upl-1.0", "upl 1 0", "universal permissive license(?: version| v)?(?: 1 0)?", "licen"),
    ("odbl-1.0", "odbl 1 0", "open (?:data commons open )?database license(?: version| v)?(?: 1 0)?", "licen"),
    ("odc-by-1.0", "odc by 1 0", "open data commons attribution license(?: version| v)?(?: 1 0)?", "licen"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and license(?: version| v)?(?: 1 0)?", "licen"),
    ("postgresql", "postgresql", "postgresql license", "licen"),
    ("elastic-2.0", "elastic 2 0", "elastic license(?: version)?(?: 2 0)?", "licen"),
    ("sspl-1.0", "sspl 1 0", "server side public license(?: version| v)?(?: 1)?", "licen"),
    ("busl-1.1", "busl 1 1", "business source license(?: version)?(?: 1 1)?", "licen"),
    ("openrail", "openrail", "(?:creativeml )?(?:openrail|open rail)(?: m)?(?: license)?", "rail"),
    ("llama", "llama2", "llama (?:2|3|3 1) community license(?: agreement)?", "licen"),
    ("proprietary", "licenseref proprietary", "proprietary license", "licen"),
]

#: Statements without a license's name. Of a clause with a holder's name in it, the part behind the name is the statement, so that names may be of any length.
STATEMENTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", NOTICE),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice", NOTICE),
    ("mit", "the software is provided as is without warranty of any kind", "without warranty", NOTICE),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use", NOTICE),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution", NOTICE),
    ("bsd", "redistributions of source code must retain the above copyright notice", "redistributions", NOTICE),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", "redistributions", NOTICE),
    ("bsd-3-clause", "nor the names of its contributors may be used", "contributors", NOTICE),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", "advertising", NOTICE),
    ("bsd", "this software is provided by the (?:copyright holders|regents|author)", "is provided by", NOTICE),
    ("apache-2.0", "you may not use this file except in compliance with the license", "in compliance", NOTICE),
    ("apache-2.0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org", NOTICE),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software", "applicable law", NOTICE),
    ("gpl", "this program is free software you can redistribute it and or modify it", "free software", NOTICE),
    ("gpl", "this program is distributed in the hope that it will be useful", "in the hope", NOTICE),
    ("gpl", "you should have received a copy of the gnu general public license", "should have received", NOTICE),
    ("lgpl", "this library is free software you can redistribute it and or modify it", "free software", NOTICE),
    ("lgpl", "you should have received a copy of the gnu lesser general public license", "should have received", NOTICE),
    ("agpl", "you should have received a copy of the gnu affero general public license", "should have received", NOTICE),
    ("gpl-2.0-or-later", "either version 2 of the license or at your option any later version", "later version", NOTICE),
    ("gpl-3.0-or-later", "either version 3 of the license or at your option any later version", "later version", NOTICE),
    ("lgpl-2.1-or-later", "either version 2 1 of the license or at your option any later version", "later version", NOTICE),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "source code form", NOTICE),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license", "contents of this file", NOTICE),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "accompanying materials", NOTICE),
    ("cddl-1.0", "the contents of this file are subject to the terms of the common development", "contents of this file", NOTICE),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted", NOTICE),
    ("zlib", "altered source versions must be plainly marked as such", "plainly marked", NOTICE),
    ("zlib", "the origin of this software must not be misrepresented", "misrepresented", NOTICE),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered", NOTICE),
    ("wtfpl", "you just do what the fuck you want to", "just do what", NOTICE),
    ("cc0-1.0", "has waived all copyright(?: and related| related)", "waived", NOTICE),
    ("cc-by", "this work is licensed under a creative commons attribution", "creative commons", NOTICE),
    ("ofl-1.1", "this font software is licensed under the sil open font license", "font software", NOTICE),
    ("artistic-2.0", "this is free software you can redistribute it and or modify it under the artistic license", "artistic", NOTICE),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose", "permission to use", NOTICE),
    ("openssl", "this product includes software developed by the openssl project", "openssl", NOTICE),
    ("apache-1.1", "this product includes software developed by the apache software foundation", "apache", NOTICE),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", NOTICE),
    ("public-domain", "(?:is|are) in the public domain", "public domain", NOTICE),
    ("public-domain", "public domain", "public domain", HINT),
    ("public-domain", "no rights reserved", "rights reserved", NOTICE),
    ("cc", "some rights reserved", "rights reserved", NOTICE),
    ("proprietary", "proprietary and confidential", "proprietary", NOTICE),
    ("proprietary", "confidential and proprietary", "proprietary", NOTICE),
    ("proprietary", "unauthorized (?:copying|reproduction|use|distribution) (?:.+? )?prohibited", "unauthorized", NOTICE),
    ("proprietary", "may not be reproduced(?: or distributed| in any form)? without", "reproduced", NOTICE),
    ("proprietary", "no part of this (?:publication|work|document) may be reproduced", "reproduced", NOTICE),
    ("proprietary", "for internal use only", "internal use", NOTICE),
    ("proprietary", "not for redistribution", "redistribution", NOTICE),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", HINT),
    ("copyright", "all copyrights? reserved", "copyright", HINT),
    ("cc", "creative commons license", "creative commons", HINT),
    ("cc", "creative commons", "creative commons", HINT),
    ("see-license", "see (?:the )?(?:accompanying )?license(?: file| txt| md)? (?:file|for|in)", "licen", HINT),
    ("see-license", "see copying(?: file| txt)?", "copying", HINT),
    ("non-commercial", "for non ?commercial (?:use|purposes) only", "commercial", NOTICE),
    ("non-commercial", "(?:academic|research) purposes only", "purposes only", HINT),
    ("permission", "(?:used|reprinted|reproduced) (?:with|by) permission(?: of)?", "permission", HINT),
    ("terms-of-use", "(?:terms of (?:use|service))", "terms of", HINT),
    ("eula", "end user license agreement", "end user", NOTICE),
    ("copyleft", "copyleft", "copyleft", HINT),
    ("trademark", "(?:are|is a) registered trademarks? of", "trademark", HINT),
]

#: The phrases whose places are always reported, whatever the other rules say.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]


def first_words(pattern: str) -> list[str]:
    """The words an expression can begin with: its first word, or the choices of a leading group."""
    if not pattern.startswith("("):
        return [pattern.split(" ")[0].split("(")[0]]
    group, optional = pattern[pattern.index(":") + 1 : pattern.index(")")], pattern[pattern.index(")") + 1 :].startswith("?")
    words = [choice.split(" ")[0] for choice in group.split("|")]
    return words + (first_words(pattern[pattern.index(")") + 2 :]) if optional else [])


#: Short names of one word that mean a license by themselves. Other single words are also names of products (apache, zlib, x11),
#: so they count only in documents that speak of a license: for them the keyword is a condition, for all other rules it only saves work.
PLAIN_SHORT = ("gpl", "cc0", "wtfpl", "unlicense")
#: Short names that are no rule of their own: too common as plain words.
COMMON_SHORT = ("mit", "isc", "ruby", "perl 5", "artistic", "elastic 2 0")


def needs_context(short: str) -> bool:
    """Whether a short name by itself counts only in documents that speak of a license."""
    return " " not in short and not any(p in short for p in PLAIN_SHORT)


def rules() -> list[Rule]:
    """All rules, in order of precedence among equal rank and length. Whatever a rule matches contains its keyword, but for :func:`needs_context`."""
    found = [Rule(label, tuple(first_words(pattern)), pattern, keyword, rank) for label, pattern, keyword, rank in STATEMENTS]
    grant = f"(?:{'|'.join(GRANT_WORDS)}) {GRANT_TAIL}"
    for label, short, name, keyword in NAMES:
        found.append(Rule(label, ("spdx",), f"spdx license identifier {short}", "licen", IDENTIFIER))
        found.append(Rule(label, GRANT_WORDS, f"{grant} {name}", keyword, GRANT))
        found.append(Rule(label, GRANT_WORDS, f"{grant} {short}", f" {short}", GRANT))
        found.append(Rule(label, tuple(first_words(name)), name, keyword, NAME))
        if short not in COMMON_SHORT:
            found.append(Rule(label, tuple(first_words(short)), short, "licen" if needs_context(short) else short, NAME))
    return found
