"""Licence scans: known sentences become identifiers, and sequences of identifiers meet ordered licence rules."""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from shrinkwise.llm.common import fields, map_batches

# Names of licences as notices give them, normalised, and their identifiers.
NAMES = {
    "mit": "MIT", "mit license": "MIT", "x11 license": "X11", "isc": "ISC", "isc license": "ISC",
    "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0": "Apache-2.0", "apache 2.0 license": "Apache-2.0", "apache software license version 2.0": "Apache-2.0", "apache-2.0": "Apache-2.0",
    "bsd license": "BSD-3-Clause", "bsd 3 clause license": "BSD-3-Clause", "3 clause bsd license": "BSD-3-Clause", "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "bsd-3-clause": "BSD-3-Clause",
    "bsd 2 clause license": "BSD-2-Clause", "2 clause bsd license": "BSD-2-Clause", "simplified bsd license": "BSD-2-Clause", "freebsd license": "BSD-2-Clause", "bsd-2-clause": "BSD-2-Clause",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license v2": "GPL-2.0", "gnu gpl v2": "GPL-2.0", "gplv2": "GPL-2.0", "gpl 2.0": "GPL-2.0", "gpl-2.0": "GPL-2.0", "gpl-2.0-only": "GPL-2.0",
    "gnu general public license version 3": "GPL-3.0", "gnu general public license v3": "GPL-3.0", "gnu gpl v3": "GPL-3.0", "gplv3": "GPL-3.0", "gpl 3.0": "GPL-3.0", "gpl-3.0": "GPL-3.0", "gpl-3.0-only": "GPL-3.0", "gnu general public license version 3.0": "GPL-3.0", "gnu general public license version 2.0": "GPL-2.0",
    "gnu general public license": "GPL", "gnu gpl": "GPL", "gpl": "GPL",
    "gnu lesser general public license version 2.1": "LGPL-2.1", "gnu lgpl v2.1": "LGPL-2.1", "lgplv2.1": "LGPL-2.1", "lgpl-2.1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "lgplv3": "LGPL-3.0", "lgpl-3.0": "LGPL-3.0",
    "gnu affero general public license version 3": "AGPL-3.0", "gnu agpl v3": "AGPL-3.0", "agplv3": "AGPL-3.0", "agpl-3.0": "AGPL-3.0",
    "mozilla public license version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "mpl 2.0": "MPL-2.0", "mpl-2.0": "MPL-2.0",
    "eclipse public license version 2.0": "EPL-2.0", "eclipse public license v2.0": "EPL-2.0", "epl-2.0": "EPL-2.0", "boost software license version 1.0": "BSL-1.0", "bsl-1.0": "BSL-1.0",
    "cc0": "CC0-1.0", "cc0 1.0": "CC0-1.0", "cc0-1.0": "CC0-1.0", "cc by 4.0": "CC-BY-4.0", "cc by sa 4.0": "CC-BY-SA-4.0", "cc by nc 4.0": "CC-BY-NC-4.0", "cc by nd 4.0": "CC-BY-ND-4.0", "cc by nc sa 4.0": "CC-BY-NC-SA-4.0", "cc by nc nd 4.0": "CC-BY-NC-ND-4.0", "cc by 3.0": "CC-BY-3.0", "cc by sa 3.0": "CC-BY-SA-3.0",
    "creative commons attribution 4.0 international license": "CC-BY-4.0", "creative commons attribution sharealike 4.0 international license": "CC-BY-SA-4.0", "creative commons attribution noncommercial 4.0 international license": "CC-BY-NC-4.0",
    "unlicense": "Unlicense", "zlib license": "Zlib", "wtfpl": "WTFPL", "artistic license 2.0": "Artistic-2.0",
    "0bsd": "0BSD", "mit-0": "MIT-0", "zlib": "Zlib", "ncsa": "NCSA", "postgresql license": "PostgreSQL", "postgresql": "PostgreSQL", "python-2.0": "Python-2.0", "psf-2.0": "PSF-2.0", "ofl-1.1": "OFL-1.1", "sil open font license version 1.1": "OFL-1.1",
    "bsd-4-clause": "BSD-4-Clause", "bsd-1-clause": "BSD-1-Clause", "bsd 4 clause license": "BSD-4-Clause", "original bsd license": "BSD-4-Clause", "bsd": "BSD-3-Clause", "bsd style license": "BSD-3-Clause", "expat license": "MIT", "expat": "MIT",
    "apache license v2.0": "Apache-2.0", "apache v2 license": "Apache-2.0", "apache license v2": "Apache-2.0", "apache 2 license": "Apache-2.0", "boost software license": "BSL-1.0", "boost license": "BSL-1.0", "boost software license 1.0": "BSL-1.0",
    "gnu lesser general public license": "LGPL", "gnu library general public license": "LGPL", "gnu lgpl": "LGPL", "lgpl": "LGPL", "gnu lesser general public license v2.1": "LGPL-2.1", "gnu lesser general public license version 3.0": "LGPL-3.0", "gnu lesser general public license v3": "LGPL-3.0", "gnu lgpl v3": "LGPL-3.0", "gnu lesser general public license version 2": "LGPL-2.0", "gnu library general public license version 2": "LGPL-2.0", "lgpl-2.0": "LGPL-2.0",
    "gnu affero general public license": "AGPL", "gnu agpl": "AGPL", "agpl": "AGPL", "gnu affero general public license v3": "AGPL-3.0", "gnu affero general public license version 3.0": "AGPL-3.0", "gpl version 2": "GPL-2.0", "gpl version 3": "GPL-3.0", "gpl v2": "GPL-2.0", "gpl v3": "GPL-3.0", "gpl2": "GPL-2.0", "gpl3": "GPL-3.0", "gnu general public license v2.0": "GPL-2.0", "gnu general public license v3.0": "GPL-3.0",
    "mozilla public license version 1.1": "MPL-1.1", "mpl 1.1": "MPL-1.1", "eclipse public license v1.0": "EPL-1.0", "eclipse public license version 1.0": "EPL-1.0", "eclipse public license 1.0": "EPL-1.0", "eclipse public license 2.0": "EPL-2.0", "epl-1.0": "EPL-1.0",
    "common development and distribution license": "CDDL-1.0", "cddl-1.0": "CDDL-1.0", "cc0 1.0 universal": "CC0-1.0", "creative commons zero": "CC0-1.0", "artistic-2.0": "Artistic-2.0", "eupl-1.2": "EUPL-1.2",
}


def _creative_commons() -> dict[str, str]:
    """Short and long names of the Creative Commons licences and their identifiers."""
    words = {"nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    names = {}
    for parts in ((), ("sa",), ("nc",), ("nd",), ("nc", "sa"), ("nc", "nd")):
        for version, ending in (("2.0", "generic"), ("2.5", "generic"), ("3.0", "unported"), ("4.0", "international")):
            short, long = " ".join(("by", *parts, version)), " ".join(("attribution", *(words[p] for p in parts), version))
            license_id = "-".join(("CC-BY", *(p.upper() for p in parts), version))
            names |= {name: license_id for name in (f"cc {short}", f"creative commons {long}", f"creative commons {long} {ending}")}
            names |= {f"creative commons {long} {ending} license": license_id, f"creative commons {long} license": license_id}
    return names


NAMES |= _creative_commons()
# Sentences of licence texts and of their usual notices, by identifier. What stands in braces may differ.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of {the copyright holder} nor the names of {its} contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This {program} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd-name-not": "The name of {the author} may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-names-either": "Neither the name of {the University} nor the names of {its contributors} may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "apache-granted": "The {ASF} licenses this file to you under the Apache License, Version 2.0 (the \"License\")",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "mpl1-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")",
    "cddl-subject": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "apache-title": "Apache License Version 2.0, January 2004",
    "boost-title": "Boost Software License - Version 1.0 - August 17th, 2003",
}
# Rules in the order in which they are tried; the sentences of a rule follow each other in a text.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")), ("MIT", ("mit-grant", "mit-notice")), ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")), ("BSD-1-Clause", ("bsd-grant", "bsd-source")), ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-notice", "apache-use", "apache-copy")), ("Apache-2.0", ("apache-notice", "apache-use")), ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")), ("GPL-3.0-or-later", ("gpl-free",)), ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")), ("GPL-2.0-or-later", ("gpl2-free",)),
    ("MPL-2.0", ("mpl-subject",)), ("Unlicense", ("unlicense-free",)),
    ("MIT-0", ("mit0-grant",)), ("ISC", ("isc-grant-and",)), ("0BSD", ("0bsd-grant",)), ("Zlib", ("zlib-grant",)), ("BSL-1.0", ("boost-grant",)),
    ("Apache-2.0", ("apache-granted", "apache-use", "apache-copy")), ("Apache-2.0", ("apache-granted", "apache-use")), ("Apache-2.0", ("apache-granted",)),
    ("MPL-1.1", ("mpl1-subject", "apache-use")), ("MPL-1.1", ("mpl1-subject",)), ("CDDL-1.0", ("cddl-subject",)),
    ("GPL-3.0", ("gpl3-title",)), ("GPL-2.0", ("gpl2-title",)), ("LGPL-3.0", ("lgpl3-title",)), ("LGPL-2.1", ("lgpl21-title",)), ("AGPL-3.0", ("agpl3-title",)),
    ("Apache-2.0", ("apache-title",)), ("BSL-1.0", ("boost-title",)),
)


def _bsd_rules() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """Rules of the BSD licences with each wording of the clause on names, and with the one on advertising."""
    start, names = ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-names", "bsd-names-either", "bsd-name-not")
    four = tuple(("BSD-4-Clause", (*start, "bsd-advertising", name)) for name in names)
    return (*four, ("BSD-4-Clause", (*start, "bsd-advertising")), *(("BSD-3-Clause", (*start, name)) for name in names[1:]))


def _gnu_terms() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """Sentences of the GNU licences' notices behind the program's name, and their rules."""
    terms = "you can redistribute it and/or modify it under the terms of the GNU {} Public License"
    by = "as published by the Free Software Foundation"
    sentences, rules = {}, []
    for family, short, versions in (("General", "GPL", "23"), ("Lesser General", "LGPL", ("2", "2.1", "3")), ("Library General", "LGPL", "2"), ("Affero General", "AGPL", "3")):
        for version in versions:
            start, license_id = terms.format(family), f"{short}-{version if '.' in version else version + '.0'}"
            only = [f"{start} version {version} {by}", f"{start} {by}, version {version} of the License", f"{start} {by}; version {version} of the License", f"{start} {by}, version {version}", f"{start} {by}; version {version}"]
            later = [f"{start} {by}{sign} either version {version} of the License, or (at your option) any later version" for sign in ",;"]
            for name, texts in ((f"{license_id}-only", only), (f"{license_id}-or-later", later)):
                for n, text in enumerate(texts):
                    key = f"{family} {name} {n}"
                    sentences[key] = text
                    rules += [(name.removesuffix("-only"), (key, "gpl-hope")), (name.removesuffix("-only"), (key,))]
    return sentences, tuple(rules)


_GNU_SENTENCES, _GNU_RULES = _gnu_terms()
SENTENCES |= _GNU_SENTENCES
# The longest sequences of identifiers are tried first; among equally long ones, in the order above.
RULES = tuple(sorted((*RULES, *_bsd_rules(), *_GNU_RULES), key=lambda rule: -len(rule[1])))

_SIGNS = re.compile(r"[^a-z0-9.+\s-]+")
_LONE = re.compile(r"(?<!\S)[.+-]+(?!\S)")
#: Sentence ends, but for the colon of a tag, and empty lines.
_BREAK = re.compile(r"(?:[.;!?]|(?<!dentifier)(?i:(?<!license)(?<!licence)(?<!license[\"'])):)[.;:!?]*(?=\s|$)|\n\s*\n")
#: Beginnings of comment lines that would end a sentence or be words of it.
_COMMENT = re.compile(r"^[ \t]*(?:;+|!+|dnl|rem)(?=[ \t]|$)", re.MULTILINE | re.IGNORECASE)
_LINES = re.compile(r"\n+")
_ITEM = re.compile(r"^(?:\d{1,2}|[a-z]|i{2,3}|iv) ")
_NOTICE = re.compile(r"(?:licensed|licenced|released|distributed|published|provided|available|covered|governed) (?:under|(?<=governed )by) (?:either (?:of )?)?(?:the |an? )?(?:terms (?:and conditions )?of (?:the |an? )?)?(?:either (?:of )?(?:the )?)?")
_TAG = re.compile(r"(?:^|.* )spdx-license-identifier (.+)$")
_SPDX = "spdx-license-identifier "
_LICENSE_TAG = re.compile(r"^licen[sc]e (.+)$")
#: Every match of `_NOTICE` holds one of these.
_NOTICE_WORDS = ("ed under ", "able under ", "governed by ")
_OR_LATER = re.compile(r"or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?(?: at your option)?(?= |$)")
#: Names as notices are looked up, without hyphens, and the most words that one has.
_NAME_IDS = {name.replace("-", " "): license_id for name, license_id in NAMES.items()}
_NAME_WORDS = max(len(name.split()) for name in _NAME_IDS)
#: Words behind a name that is neither called a licence nor has a version.
_AFTER_NAMES = frozenset(("license", "licence", "licenses", "licences", "see"))
_SLOT = re.compile(r"\{[^}]*\}")
#: Words that may stand in the place of one in braces, sentence ends among them, and lines that such a sentence has, at most.
SLOT_WORDS, SLOT_BREAKS, SLOT_LINES = 20, 3, 12


class Known(NamedTuple):
    """A known sentence or a notice, and the places of its first and last piece."""

    first: int
    last: int
    name: str


class Finding(NamedTuple):
    """A licence, the place of the first sentence that says so, and how many do."""

    license: str
    sentence: int
    n_sentences: int


def scan_licenses(files: DataFrame, rel_path: str = "rel_path", text: str = "text") -> DataFrame:
    """Licences that every file's text names or quotes: (rel_path, licenses, findings, n_open), a row per input row.

    A text is split into sentences, also at line ends where a run of lines is a known one; signs that begin comment
    lines are no part of them. A normalised sentence (lower case, signs and white space as single spaces) maps to the
    identifier of a known licence sentence, in which names of holders or programs may differ (at most `SLOT_WORDS`
    words), or to the notice of licences by name: "licensed under ...", a line "License: ...", or an SPDX tag with an
    expression, each licence of which is one. Known sentences that hold points or colons are split in the same way, and
    their pieces are put together again where they follow each other. The identifiers, in order, are matched
    against licence rules: from each place, the first rule whose sentences follow there, with at most `GAP`
    unknown ones between, is a finding and uses them up; a notice is a rule by itself. `licenses` is the distinct licences in
    order of name, `findings` has (license, sentence, n_sentences) in order of place, `n_open` counts known sentences that
    no rule used, and SPDX tags without any known licence.

    Null and empty texts have no findings. Rows that share a rel_path are scanned each by itself; rel_path may be
    any column. Other columns are ignored. No rows give no rows.
    """

    def run(batch: pa.RecordBatch, known: Sentences) -> dict[str, object]:
        found = [scan(t or "", known) for t in batch.column(1).to_pylist()]
        return {
            rel_path: batch.column(0),
            "licenses": [sorted({f.license for f in findings}) for findings, _ in found],
            "findings": [[f._asdict() for f in findings] for findings, _ in found],
            "n_open": [n for _, n in found],
        }

    schema = fields(files, [rel_path], "licenses array<string>, findings array<struct<license: string, sentence: bigint, n_sentences: bigint>>, n_open bigint")
    return map_batches(files.select(rel_path, text), run, schema, known_sentences)


#: Unknown sentences between two of a rule at most.
GAP = 2


class Sentences:
    """Known sentences as normalised pieces: looked up whole, by their beginnings, and with words in their slots."""

    def __init__(self, sentences: dict[str, str]) -> None:
        split = {name: _pieces(text) for name, text in sentences.items()}
        #: Sentences by the piece that they begin with, those of most pieces first.
        self.sequences: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
        for name, pieces in sorted(split.items(), key=lambda item: -len(item[1])):
            self.sequences.setdefault(pieces[0], []).append((name, pieces))
        every = {p for pieces in split.values() for p in pieces}
        self.whole = frozenset(p for p in every if "{}" not in p)
        self.beginnings = frozenset(" ".join(words[:n]) for p in self.whole if (words := p.split()) for n in range(1, len(words)))
        self.slotted: dict[str, list[tuple[str, str, re.Pattern[str]]]] = {}
        for p in sorted(every - self.whole):
            any_words = rf"\S+(?: \S+){{0,{SLOT_WORDS - 1}}}?"
            pattern = re.compile(any_words.join(re.escape(part) for part in p.split("{}")))
            self.slotted.setdefault(p.split()[0], []).append((p, p.split("{}")[0], pattern))

    def piece(self, plain: str) -> str | None:
        """The known piece that a normalised sentence is."""
        if plain in self.whole:
            return plain
        slotted = self.slotted.get(plain.split(" ", 1)[0], ())
        return next((p for p, _, pattern in slotted if pattern.fullmatch(plain)), None)

    def may_go_on(self, plain: str) -> bool:
        """Whether a known piece without slots begins so."""
        return plain in self.beginnings

    def has_slot_open(self, plain: str) -> bool:
        """Whether it begins as a piece with slots does, up to the first or beyond."""
        slotted = self.slotted.get(plain.split(" ", 1)[0])
        return slotted is not None and any(plain.startswith(head) or head.startswith(f"{plain} ") for _, head, _ in slotted)


def known_sentences() -> Sentences:
    """The fixed sentences, prepared for looking up."""
    return Sentences(SENTENCES)


def _pieces(sentence: str) -> tuple[str, ...]:
    return tuple("{}".join(normalised(part, " ") for part in p.split("{}")).strip() for p in _BREAK.split(_SLOT.sub("{}", sentence)))


def normalised(sentence: str, kept: str = "") -> str:
    """Lower case; signs other than points, hyphens and plus as white space, and that as single spaces. Points and hyphens
    at the ends and by themselves are dropped; `kept` is a space if spaces at the ends are kept as one."""
    plain = _SIGNS.sub(" ", sentence.lower())
    joined = " ".join(plain.split()).strip(".- ")
    if " -" in joined or " ." in joined or " +" in joined:
        joined = " ".join(_LONE.sub(" ", joined).split())
    if kept:
        return (kept if plain[:1].isspace() else "") + joined + (kept if joined and plain[-1:].isspace() else "")
    return joined


def identifier(plain: str, known: Sentences, in_lines: bool = False) -> str | None:
    """The known piece that a normalised sentence is, or `notice:` with the licences that it names, or None."""
    found = known.piece(plain)
    if not found and _ITEM.match(plain):
        found = known.piece(_ITEM.sub("", plain))
    return found or _notice(plain, in_lines)


def _notice(plain: str, in_lines: bool) -> str | None:
    """`notice:` with the licences named in a sentence, separated by '|'; tags stand in a line of their own."""
    names: list[str] = []
    if any(w in plain for w in _NOTICE_WORDS):
        for notice in _NOTICE.finditer(plain):
            names += _named(plain[notice.end() :])[0]
    if not in_lines:
        if _SPDX in plain and (tag := _TAG.match(plain)):
            return "notice:" + "|".join(_named(tag[1], any_follows=True)[0])
        if not names and plain.startswith("licen") and (tag := _LICENSE_TAG.match(plain)):
            tagged, whole = _named(tag[1])
            names = tagged if whole else []
    return "notice:" + "|".join(names) if names else None


def _named(text: str, any_follows: bool = False) -> tuple[list[str], bool]:
    """Licences that a text names at its beginning, joined by or, and, with; and whether nothing else follows.

    The longest known name counts. One that is neither called a licence nor has a version must be all, or have the word
    licence behind it. An exception after `with` is no licence."""
    words = text.replace("-", " ").split()
    found: list[str] = []
    at = 0
    while at < len(words):
        name, to, plus = _longest_name(words, at)
        if name is None:
            break
        behind = " ".join(words[to : to + 8])
        later = _OR_LATER.match(behind)
        surely = any_follows or later or plus or any(c.isdigit() for c in "".join(words[at:to])) or "licen" in " ".join(words[at:to])
        if not surely and to < len(words) and words[to] not in _AFTER_NAMES and not (words[to] in ("or", "and") and _longest_name(words, to + 1)[0]):
            break
        found.append(name + ("-or-later" if later or plus else ""))
        at = to + (len(later[0].split()) if later else 0)
        at += at < len(words) and words[at] in ("only", "license", "licence")
        if words[at : at + 1] == ["with"]:
            exception = next((n for n in range(at, len(words)) if words[n].startswith("exception")), at)
            at = min(exception + 1, len(words)) if exception > at else at
            at += at < len(words) and words[at][:1].isdigit()
        if at < len(words) and words[at] in ("or", "and"):
            at += 1 + (words[at + 1 : at + 2] == ["the"])
        else:
            break
    return found, bool(found) and at >= len(words)


def _longest_name(words: list[str], at: int) -> tuple[str | None, int, bool]:
    """The licence of the longest known name from a word on, the word behind it, and whether it ends with a plus."""
    for to in range(min(len(words), at + _NAME_WORDS), at, -1):
        name = " ".join(words[at:to])
        for plain, plus in ((name, False), (name.removesuffix("+"), True)):
            if plain in _NAME_IDS and (not plus or name != plain):
                return _NAME_IDS[plain], to, plus
    return None, at, False


def scan(text: str, known: Sentences) -> tuple[list[Finding], int]:
    """Findings of a text and the number of known sentences left over."""
    ids: list[Known] = []
    sentences = _BREAK.split(_COMMENT.sub("", text))
    at = 0
    while at < len(sentences):
        name, to = _across_breaks(sentences, at, known)
        # A notice may be the beginning of a known sentence that follows other lines.
        names = [name] if name and not name.startswith("notice:") else _in_lines(_LINES.split(sentences[at]), known)
        if name and all(n.startswith("notice:") for n in names):
            names = [name]
        ids += [Known(at, to - 1, n) for n in names]
        at = to
    findings, at, left = [], 0, 0
    found = _assembled(ids, known)
    while at < len(found):
        rule = next(((name, len(seq)) for name, seq in _RULES_FROM.get(found[at].name, ()) if _follows(found[at : at + len(seq)], seq)), None)
        if found[at].name.startswith("notice:"):
            names = found[at].name.removeprefix("notice:")
            findings += [Finding(name, found[at].first, 1) for name in names.split("|") if name]
            left += not names
        elif rule:
            findings.append(Finding(rule[0], found[at].first, rule[1]))
        else:
            left += 1
        at += rule[1] if rule else 1
    return findings, left


def _across_breaks(sentences: list[str], at: int, known: Sentences) -> tuple[str | None, int]:
    """Identifier of the sentence at a place, and the place behind it: a name in a slot may hold sentence ends."""
    plain = normalised(sentences[at])
    name = identifier(plain, known, "\n" in sentences[at])
    if name is None and known.has_slot_open(_ITEM.sub("", plain)):
        for to in range(at + 2, min(at + 2 + SLOT_BREAKS, len(sentences) + 1)):
            if found := known.piece(_ITEM.sub("", normalised("\n".join(sentences[at:to])))):
                return found, to
    return name, at + 1


def _in_lines(lines: list[str], known: Sentences) -> list[str]:
    """Identifiers of a sentence's runs of lines that are known, and of single lines."""
    names, at = [], 0
    while len(lines) > 1 and at < len(lines):
        behind, to, plain = at + 1, at + 1, normalised(lines[at])
        name = identifier(plain, known)
        # The longest known run of lines counts.
        while plain and to < len(lines) and (known.may_go_on(plain) or (known.has_slot_open(plain) and to < at + SLOT_LINES)):
            to += 1
            plain = normalised("\n".join(lines[at:to]))
            if longer := known.piece(plain):
                name, behind = longer, to
        names += [name] if name else []
        at = behind
    return names


#: Rules by the sentence that they begin with.
_RULES_FROM: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _rule in RULES:
    _RULES_FROM.setdefault(_rule[1][0], []).append(_rule)


def _assembled(ids: list[Known], known: Sentences) -> list[Known]:
    """Known sentences and notices; pieces that do not make up a sentence are none."""
    out, at = [], 0
    while at < len(ids):
        if ids[at].name.startswith("notice:"):
            out.append(ids[at])
            at += 1
            continue
        found = next((x for x in known.sequences.get(ids[at].name, ()) if _adjoin(ids[at : at + len(x[1])], x[1])), None)
        if found:
            out.append(Known(ids[at].first, ids[at + len(found[1]) - 1].last, found[0]))
        at += len(found[1]) if found else 1
    return out


def _adjoin(ids: list[Known], pieces: tuple[str, ...]) -> bool:
    return tuple(i.name for i in ids) == pieces and all(b.first == a.last + 1 for a, b in zip(ids, ids[1:]))


def _follows(ids: list[Known], sequence: tuple[str, ...]) -> bool:
    return tuple(i.name for i in ids) == sequence and all(b.first - a.last <= GAP + 1 for a, b in zip(ids, ids[1:]))
